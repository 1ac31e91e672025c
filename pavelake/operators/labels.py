"""Annotation tables: validation, conflicts, agreement, manifests, leak guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v

CONFIDENCES = ("high", "mid", "low")
# fixed values: what looks like a secret, what may be published
SECRET = r"(?i)(sk-[A-Za-z0-9]{16,}|AKID[A-Za-z0-9]{16,}|(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{16,})"
TEXT_FILES = r"(?i)\.(py|js|json|md|txt|html|yml|yaml|toml|ini|cfg|env|xml|csv)$"
OPEN_LABELS = ("labels/schema.md", "labels/MANIFEST.csv", "labels/README.md")
OUTPUT_FOLDERS = r"^(out|vis|fused|out_selftest|out_fused_selftest)/"
LONGEST_LINE = 500


# fixed values: columns of annotation files, and what severities there are
EVENT_FIELDS = ("event_id", "t_start_ms", "t_end_ms", "peak", "imu_label", "truth_label", "is_false_positive", "confidence", "note", "labeled_by", "labeled_at")
FRAME_FIELDS = ("frame_id", "t_ms", "source", "vision_label", "truth_label", "severity", "occlusion", "confidence", "note", "labeled_by", "labeled_at")
SEVERITIES = ("light", "medium", "severe")


def missing_fields(columns: list[str]) -> list[str]:
    """Columns that an annotation file of its kind lacks."""
    return [c for c in (EVENT_FIELDS if kind_by_header(columns) == "event" else FRAME_FIELDS) if c not in columns]


def issues(labels: DataFrame, key: str = "event_id") -> DataFrame:
    """key, issue: one row per violation; key is event_id or frame_id, columns as the file has them (a missing column counts as empty).

    An id that occurs again is reported once for each further row. Confidence, severity and occlusion may be empty; a truth label, and for
    events the flag of false positives, may not.
    """
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in labels.columns else F.lit(None).cast("string")
    strange = lambda c, domain: text(c).isNotNull() & ~text(c).isin(*domain)
    no_id = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    found = [
        F.when(no_id, "empty_id"), F.when(~no_id & (F.col("__place") > 1), "duplicate_id"),
        F.when(text("truth_label").isNull(), "empty_truth"), F.when(strange("truth_label", v.TRUTHS), "truth_out_of_domain"),
        F.when(strange("confidence", CONFIDENCES), "bad_confidence"),
    ]
    if key == "event_id":
        found.append(F.when(~F.coalesce(text("is_false_positive").isin("0", "1"), F.lit(False)), "bad_flag"))
    else:
        found += [F.when(strange("severity", SEVERITIES), "bad_severity"), F.when(strange("occlusion", ("0", "1")), "bad_occlusion")]
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
    return labels.withColumn("__place", place).select(key, F.explode(F.array_compact(F.array(*found))).alias("issue"))


def conflicts(labels: DataFrame, key: str = "event_id", truth: str = "truth_label", source: str = "source_file") -> DataFrame:
    """Keys that have more than one truth, with all of them."""
    filled = labels.filter(F.nullif(F.trim(truth), F.lit("")).isNotNull())
    agg = filled.groupBy(key).agg(F.sort_array(F.collect_set(truth)).alias("truths"), F.sort_array(F.collect_set(source)).alias("files"))
    return agg.filter(F.size("truths") > 1)


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """n, po, pe, kappa and verdict from two label columns: one partial aggregation by label pair."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col(a).alias("k")).agg(F.sum("c").alias("x"))
    columns = cells.groupBy(F.col(b).alias("k")).agg(F.sum("c").alias("y"))
    chance = rows.join(columns, "k").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    out = n.crossJoin(chance).withColumn("po", F.try_divide(F.col("same").cast("double"), F.col("n"))).withColumn("pe", F.coalesce("xy", F.lit(0.0)) / F.nullif(F.col("n").cast("double") * F.col("n"), F.lit(0.0)))
    k = F.when(F.col("pe") == 1, 0.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return out.withColumn("kappa", k).withColumn("verdict", F.when(F.col("kappa") >= 0.75, "good").when(F.col("kappa") >= 0.60, "fair").when(F.col("kappa").isNotNull(), "poor")).select(F.coalesce("n", F.lit(0)).alias("n"), "po", "pe", "kappa", "verdict")


def disagreements(pairs: DataFrame, a: str = "a", b: str = "b", k: int = 5) -> DataFrame:
    """The k most frequent unequal pairs."""
    return pairs.filter(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), a, b).limit(k)


def overlay(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Gold labels with adjudicated values put over them where these are filled."""
    e = extra.select("event_id", F.nullif(F.trim("truth_label"), F.lit("")).alias("t2"), F.col("is_false_positive").alias("f2"), F.lit(True).alias("seen"))
    return base.join(e, "event_id", "left").select("event_id", F.coalesce("t2", "truth_label").alias("truth_label"), F.coalesce("f2", "is_false_positive").alias("is_false_positive"), F.coalesce("seen", F.lit(False)).alias("adjudicated"))


def leaks(files: DataFrame, path: str, text: str, pattern: str = SECRET) -> DataFrame:
    """The first line with a secret of each file; lines of more than LONGEST_LINE characters, their end included, are not looked at."""
    parts = files.select(path, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("parts"))
    lines = parts.select(path, F.size("parts").alias("n"), F.posexplode("parts").alias("line", "body"))
    ended = (F.col("line") < F.col("n") - 1).cast("int")
    hits = lines.filter((F.length("body") + ended <= LONGEST_LINE) & F.col("body").rlike(pattern))
    return hits.groupBy(path).agg((F.min("line") + 1).cast("bigint").alias("line"))


def scanned(path: Column) -> Column:
    """Whether a file's text is looked at for secrets."""
    return path.rlike(TEXT_FILES)


def forbidden_path(path: Column) -> Column:
    """All reasons why a path may not be published; empty if it may."""
    return F.array_compact(F.array(
        F.when(path.rlike(r"(?i)\.zip$") & ~path.startswith("examples/"), "zip"),
        F.when(path.startswith("labels/") & ~path.isin(*OPEN_LABELS), "labels"),
        F.when(path.startswith("golden/"), "golden"),
        F.when(path.rlike(OUTPUT_FOLDERS), "output"),
    ))


def kind_by_header(columns: list[str]) -> str:
    """What an annotation file is of; a header of both kinds is one of events."""
    # fixed values: columns that only one kind has
    marks = {"event": {"event_id", "imu_label"}, "frame": {"frame_id", "vision_label"}}
    return next((kind for kind, own in marks.items() if own & set(columns)), "unknown")


def annotators(a: DataFrame, b: DataFrame, key: str = "event_id", truth: str = "truth_label", order: str = "line") -> DataFrame:
    """key, side (both, only_a, only_b), a, b: two annotators' labels beside each other; of a repeated key the last row by `order` counts."""
    one = lambda df, name: df.filter(F.nullif(F.col(key).cast("string"), F.lit("")).isNotNull()).groupBy(key).agg(F.max_by(F.coalesce(F.trim(truth), F.lit("")), order).alias(name))
    both = one(a, "a").join(one(b, "b"), key, "full")
    return both.select(key, F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both").alias("side"), "a", "b")


def register(manifest: DataFrame, packs: DataFrame) -> DataFrame:
    """packs with registered: false where the manifest, or an earlier row of packs by order, has that pack_id already."""
    first = F.row_number().over(Window.partitionBy("pack_id").orderBy("order")) == 1
    known = manifest.select("pack_id").distinct().withColumn("known", F.lit(True))
    return packs.withColumn("first", first).join(known, "pack_id", "left").withColumn("registered", F.col("first") & F.col("known").isNull()).drop("first", "known")


def manifest(files: DataFrame) -> DataFrame:
    """One row per pack: files, events, share labelled, status."""
    agg = files.groupBy("pack_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.nullif(F.trim("truth_label"), F.lit("")).isNotNull()).alias("labelled"))
    return agg.withColumn("label_status", F.when(F.col("labelled") == 0, "todo").when(F.col("labelled") < F.col("events"), "wip").otherwise("done"))
