"""Evaluation of judgements against gold labels, and screening statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import is_defect


def percent(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(100.0 * a, b), 1)


def candidates(label: Column) -> Column:
    """The truths that an algorithm's label may stand for."""
    return F.when(label == v.BUMP_OR_MANHOLE, F.array(F.lit(v.MANHOLE), F.lit(v.BUMP))).when(label == v.SHALLOW, F.array(F.lit(v.POTHOLE), F.lit(v.FLAT))).when(label == v.UNDECIDED, F.array().cast("array<string>")).otherwise(F.array(label))


def latest(records: DataFrame, key: str = "event_id", order: str = "line") -> DataFrame:
    """The last record of each key."""
    return records.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")


def judged(gold: DataFrame, reviews: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """Gold rows with their review's state and label; with keys (model), once for each that reviewed anything.

    gold: event_id, truth_label, imu_label; reviews: keys, event_id, source, visual_label.
    """
    if keys:
        gold = gold.crossJoin(F.broadcast(reviews.select(*keys).distinct()))  # a row for each model
    r = reviews.select(*keys, "event_id", "source", "visual_label", F.lit(True).alias("reviewed"))
    state = F.when(F.col("reviewed").isNull(), "missing").when(F.col("source").isin("parse_failed", "net_failed"), F.col("source")).when(F.col("source") == "l0_blocked", "blocked").when(F.col("visual_label").isNull(), "parse_failed").otherwise("judged")
    return gold.join(r, [*keys, "event_id"], "left").withColumn("state", state).withColumn("label", F.when(F.col("state") == "blocked", v.BLOCKED).when(F.col("state") == "judged", F.col("visual_label")))


def metrics(gold: DataFrame, reviews: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """All rates in one aggregation, of all reviews or of each key's (model)."""
    d = judged(gold, reviews, keys)
    has, truth, label = F.col("label").isNotNull(), F.col("truth_label"), F.col("label")
    quiet = truth.isin(v.FLAT, v.BLOCKED)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    t, p = is_defect(truth), is_defect(label)
    base = candidates(F.col("imu_label"))
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_gold"), count(has).alias("n_judged"), count(F.col("state") == "parse_failed").alias("parse_failed"), count(F.col("state") == "net_failed").alias("net_failed"), count(F.col("state") == "blocked").alias("l0_blocked"),
        count(has & (truth != v.BLOCKED)).alias("an"), count(has & (truth != v.BLOCKED) & (label == truth)).alias("ah"), count(has & quiet).alias("hn"), count(has & quiet & label.isin(*v.SPECIFIC)).alias("hh"),
        count(label == v.BLOCKED).alias("un"), count(has & (t == p)).alias("bh"), count(has & t & ~p).alias("missed_defect"), count(has & ~t & p).alias("false_defect"), count(has & t & p).alias("tp"),
        count(truth != v.BLOCKED).alias("bn"), count((truth != v.BLOCKED) & F.array_contains(base, truth)).alias("bah"), count(quiet).alias("bhn"),
        count(quiet & (F.size(F.array_intersect(base, F.array(*map(F.lit, v.SPECIFIC)))) > 0) & ~F.array_contains(base, v.FLAT)).alias("bhh"),
    )
    c = F.col
    return agg.select(
        *keys, "n_gold", "n_judged", "parse_failed", "net_failed", "l0_blocked", percent(c("n_gold") - c("parse_failed") - c("net_failed"), c("n_gold")).alias("json_compliance"), percent(c("ah"), c("an")).alias("agreement"), percent(c("hh"), c("hn")).alias("hallucination"),
        percent(c("un"), c("n_judged")).alias("unable_rate"), percent(c("bh"), c("n_judged")).alias("binary_agreement"), "missed_defect", "false_defect", percent(c("tp"), c("tp") + c("missed_defect")).alias("defect_recall"), percent(c("tp"), c("tp") + c("false_defect")).alias("defect_precision"),
        percent(c("bah"), c("bn")).alias("baseline_agreement"), percent(c("bhh"), c("bhn")).alias("baseline_hallucination"),
    )


def confusion(d: DataFrame, truth: str = "truth_label", label: str = "label") -> DataFrame:
    return d.filter(F.col(label).isNotNull()).groupBy(truth, label).agg(F.count(F.lit(1)).alias("n"))


def review_cost(d: DataFrame) -> DataFrame:
    flagged = F.count_if(is_defect(F.col("label")))
    captured = F.count_if(is_defect(F.col("label")) & is_defect(F.col("truth_label")))
    return d.agg(flagged.alias("flagged"), captured.alias("captured")).withColumn("cost", F.round(F.try_divide(F.col("flagged").cast("double"), F.col("captured")), 2))


def rank_auc(d: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Rank-sum AUC per key with average ranks.

    Ranks are found on distinct scores, so a window holds one row per score, never per sample.
    """
    ties = d.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(positive)).alias("p"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("rank", before + (F.col("c") + 1) / 2.0)
    agg = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("n1"), F.sum(F.col("c") - F.col("p")).cast("double").alias("n0"))
    auc = F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0"))
    return agg.select(*keys, auc.alias("auc")).withColumn("best", F.greatest("auc", 1 - F.col("auc"))).withColumn("verdict", F.when(F.col("best") >= 0.65, "strong").when(F.col("best") >= 0.58, "weak").otherwise("none"))


def agent_statistics(traces: DataFrame) -> DataFrame:
    """traces: event_id, rounds array<struct<status,label>>, escalated."""
    n = F.size("rounds")
    return traces.agg(F.count(F.lit(1)).alias("traces"), F.count_if(n > 1).alias("loops"), F.coalesce(F.sum(n), F.lit(0)).alias("calls"), F.round(F.avg(n), 2).alias("calls_per_event"), F.count_if("escalated").alias("escalated"))


def change_chains(traces: DataFrame) -> DataFrame:
    """The labels of all good rounds, for events judged more than once."""
    good = F.transform(F.filter("rounds", lambda r: r["status"] == "ok"), lambda r: r["label"])
    return traces.select("event_id", good.alias("chain")).filter(F.size("chain") >= 2)


# fixed values: gates of the evaluation, and what an agent must not cost more than
GATES = (("一致率≥75%", "agreement", 75.0, True), ("幻觉率≤10%", "hallucination", 10.0, False), ("JSON合规≥95%", "json_compliance", 95.0, True))
MOST_COST = 3.4


def passed() -> list[Column]:
    """struct(gate, passed) of every gate; a rate that can't be told does not pass."""
    return [F.struct(F.lit(name).alias("gate"), F.coalesce(F.col(c) >= bound if least else F.col(c) <= bound, F.lit(False)).alias("passed")) for name, c, bound, least in GATES]


def cell(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("—"))


def report(gold: DataFrame, reviews: DataFrame) -> DataFrame:
    """model, line (its row of the comparison), matrix (its confusion as a Markdown table), gates, text (the section of the report).

    reviews: model, event_id, source, visual_label. One text for each model by aggregation; a matrix has a row and a column for each label that occurs.
    """
    keys = ["model"]
    rates = metrics(gold, reviews, keys)
    columns = ("json_compliance", "agreement", "hallucination", "unable_rate", "binary_agreement", "defect_recall", "defect_precision", "missed_defect", "false_defect", "parse_failed", "net_failed")
    line = F.concat(F.lit("| "), F.col("model"), F.lit(" | "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    cells = confusion_by(judged(gold, reviews, keys), keys)
    labels = cells.groupBy(*keys).agg(F.array_sort(F.collect_set("truth_label")).alias("t"), F.array_sort(F.collect_set("label")).alias("p")).select(*keys, F.array_sort(F.array_union("t", "p")).alias("labels"))
    counts = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "truth_label", "label"), F.col("n").cast("string")))).alias("counts"))
    row = lambda t: F.concat(F.lit("| **"), t, F.lit("** | "), F.array_join(F.transform("labels", lambda q: F.coalesce(F.element_at("counts", F.concat_ws("|", t, q)), F.lit("0"))), " | "), F.lit(" |"))
    head = F.concat(F.lit("| | "), F.array_join("labels", " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size("labels") + 1))
    matrix = F.concat(head, F.lit("\n"), F.array_join(F.transform("labels", row), "\n"))
    told = F.array_join(F.transform(F.array(*passed()), lambda g: F.concat(g["gate"], F.when(g["passed"], " ✅").otherwise(" ❌"))), "；")
    made = rates.join(labels.join(counts, keys).select(*keys, matrix.alias("matrix")), keys, "left").withColumn("line", line).withColumn("gates", told)
    base = F.concat(F.lit("基线：一致率 "), cell("baseline_agreement"), F.lit("%、幻觉率 "), cell("baseline_hallucination"), F.lit("%"))
    text = F.concat_ws("\n\n", F.concat(F.lit("### "), F.col("model")), F.col("line"), base, F.coalesce("matrix", F.lit("")), F.concat(F.lit("门槛判定："), F.col("gates")))
    return made.select("model", "line", "matrix", "gates", text.alias("text"))


def confusion_by(d: DataFrame, keys: list[str]) -> DataFrame:
    return d.filter(F.col("label").isNotNull()).groupBy(*keys, "truth_label", "label").agg(F.count(F.lit(1)).alias("n"))


def gain(gold: DataFrame, reviews: DataFrame, base: str, agent: str, most_cost: float = MOST_COST) -> DataFrame:
    """base_recall, base_cost, agent_recall, agent_cost, verdict of an agent against a single call.

    effective: recall rises and a captured defect costs at most `most_cost` flagged events; frontier: recall rises but cost too; none: recall does not
    rise; incomplete: one of the two has no review.
    """
    both = reviews.filter(F.col("model").isin(base, agent))
    d = judged(gold, both, ["model"])
    t, p = is_defect(F.col("truth_label")), is_defect(F.col("label"))
    by = d.groupBy("model").agg(F.count_if(p).alias("flagged"), F.count_if(p & t).alias("captured"), F.count_if(F.col("label").isNotNull() & t).alias("defects"))
    by = by.select("model", percent(F.col("captured"), F.col("defects")).alias("recall"), F.round(F.try_divide(F.col("flagged").cast("double"), F.col("captured")), 2).alias("cost"))
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    one = by.agg(of(base, "recall").alias("base_recall"), of(base, "cost").alias("base_cost"), of(agent, "recall").alias("agent_recall"), of(agent, "cost").alias("agent_cost"))
    rises = F.col("agent_recall") > F.col("base_recall")
    verdict = F.when(rises.isNull(), "incomplete").when(rises & (F.col("agent_cost") <= most_cost), "effective").when(rises, "frontier").otherwise("none")
    return one.withColumn("verdict", verdict)
