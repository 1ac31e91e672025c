"""Key frames, frame quality, evidence features and self-check rules of the judging loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import evidence_tier
from .joins import interval_join


def keyframes(frames: DataFrame, pre_ms: int = -400) -> DataFrame:
    """event_id, role, t_ms, offset_ms, gap_ms: the frame before, at and last after each event.

    frames: event_id, t0_ms, t_ms. The last role repeats the latest frame where no other is left.
    """
    f = frames.withColumn("off", F.col("t_ms") - F.col("t0_ms"))
    agg = f.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("off", "t_ms"))).alias("fs"))

    def nearest(rest, target):
        return F.array_min(F.transform(rest, lambda x: F.struct(F.abs(x["off"] - target).alias("d"), x["off"].alias("off"), x["t_ms"].alias("t_ms"))))

    agg = agg.withColumn("a", nearest(F.col("fs"), pre_ms))
    agg = agg.withColumn("rest", F.filter("fs", lambda x: x["t_ms"] != F.col("a.t_ms"))).withColumn("b", nearest(F.col("rest"), 0))
    agg = agg.withColumn("left", F.filter("rest", lambda x: x["t_ms"] != F.col("b.t_ms")))
    last = F.coalesce(F.array_max(F.when(F.size("left") > 0, F.col("left"))), F.array_max("fs"))
    row = lambda role, off, t, gap: F.struct(F.lit(role).alias("role"), off.alias("offset_ms"), t.alias("t_ms"), gap.alias("gap_ms"))
    picked = F.array(row("pre", F.col("a.off"), F.col("a.t_ms"), F.col("a.d")), F.when(F.col("b").isNotNull(), row("impact", F.col("b.off"), F.col("b.t_ms"), F.col("b.d"))), row("post_proxy", F.col("c.off"), F.col("c.t_ms"), F.lit(None).cast("bigint")))
    return agg.withColumn("c", last).select("event_id", F.explode(F.array_compact(picked)).alias("k")).select("event_id", "k.*")


def frame_flags(mean: Column, std: Column, uniq: Column, cast: Column) -> Column:
    """struct(flat, tinted, dark, suspect, blocked)."""
    flat, tinted, dark = (std < 9) & (uniq < 400), cast > 40, mean < 40
    return F.struct(flat.alias("flat"), tinted.alias("tinted"), dark.alias("dark"), (flat | tinted).alias("suspect"), (flat | tinted | dark).alias("blocked"))


def event_features(samples: DataFrame, events: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Vertical extremes, crest over the local floor and the displacement after each event.

    samples: pack_id, t_ms, hp, vz; events: pack_id, id, t0_ms, duration_ms, peak, and columns of theirs to be kept,
    so that nobody joins them again by an id that may come back. One interval join over the widest of the three windows, then conditional aggregates.
    """
    s = samples.select("pack_id", F.col("t_ms").alias("ts"), "hp", "vz")
    t1 = F.col("t0_ms") + F.col("duration_ms")
    of_event = list(dict.fromkeys(["pack_id", "id", "t0_ms", "duration_ms", "peak", *kept]))
    e = events.select(of_event)
    near = interval_join(s, e, ["pack_id"], "ts", F.col("t0_ms") - 3000, t1 + 3000, 4000, how="left")
    inside = (F.col("ts") >= F.col("t0_ms")) & (F.col("ts") <= t1)
    after = (F.col("ts") >= t1 + 300) & (F.col("ts") <= t1 + 900)
    agg = near.groupBy(of_event).agg(
        F.min(F.when(inside, F.col("vz"))).alias("vz_min"), F.max(F.when(inside, F.col("vz"))).alias("vz_max"),
        # without the last digits, which depend on the order of the sum and would decide on tiers and roundings
        F.round(F.percentile(F.abs("hp"), F.lit(v.NOISE_QUANTILE)), 12).alias("q"), F.round(F.avg(F.when(after, F.col("hp"))), 12).alias("post"),
    )
    floor = F.greatest(F.col("q"), F.lit(v.NOISE_FLOOR))
    ratio = F.when(F.col("peak") > 1e-9, F.col("post") / F.col("peak"))
    return agg.select(
        "pack_id", "id", F.when(F.col("q").isNotNull(), floor).alias("noise_floor"), F.when(F.col("q").isNotNull(), F.col("peak") / floor).alias("crest"), "vz_min", "vz_max",
        F.when(F.col("vz_min").isNotNull(), F.when(F.abs("vz_max") > F.abs("vz_min"), "凸起").otherwise("凹陷")).alias("bump"), (F.col("vz_max") - F.col("vz_min")).alias("vz_pp"), ratio.alias("post_ratio"), *kept,
    )


def self_check(label: Column, confidence: Column, crest: Column, usable: Column, done: Column, post_ratio: Column | None = None, enforce_r1: bool = False) -> Column:
    """The rules that fire, as array<struct<rule, action>>; done: actions already taken."""
    defect = F.coalesce(label.isin(*v.DEFECTS), F.lit(False))
    fire = lambda rule, action: F.struct(F.lit(rule).alias("rule"), action.alias("action"))
    more = F.when(F.array_contains(done, "r2_more_frames"), "r2_escalate").otherwise("r2_more_frames")
    rules = [
        F.when(usable <= 1, fire("R2", more)),
        F.when(defect & (evidence_tier(crest) == "弱") & ~F.array_contains(done, "r3_two_frames"), fire("R3", F.lit("r3_two_frames"))),
        F.when(confidence == "low", fire("R4", F.lit("r4_escalate"))),
    ]
    if enforce_r1 and post_ratio is not None:
        rules.insert(0, F.when(defect & post_ratio.isNotNull() & (post_ratio <= v.POST_RATIO), fire("R1", F.lit("r1_post_wave"))))
    return F.array_compact(F.array(*rules))


def confidence(label: Column, crest: Column, usable: Column, fired: Column, escalated: Column) -> Column:
    """Derived, never declared: two modes agree high, frames agree mid, else low.

    For what is no defect: two usable frames high, one mid, none low.
    """
    defect = F.coalesce(label.isin(*v.DEFECTS), F.lit(False))
    other = F.when(usable >= 2, "high").when(usable == 1, "mid").otherwise("low")
    has = lambda rule: F.array_contains(fired, rule)
    return F.when(escalated, "low").when(~defect, other).when(has("R1"), "low").when(evidence_tier(crest).isin("强", "中") & (usable >= 2), "high").when((usable >= 2) & ~has("R3"), "mid").otherwise("low")


def event_filter(blocked: Column, low_speed: Column, post_ratio: Column, crest: Column) -> Column:
    """The first reason to look again at an event, or null."""
    conflict = post_ratio.isNotNull() & (post_ratio <= v.POST_RATIO)
    return F.when(blocked, "blocked").when(low_speed, "low_speed").when(conflict, "conflict").when(evidence_tier(crest) == "弱", "uncertain")


def even_sample(items: Column, k: int) -> Column:
    """About k evenly spaced elements, first and last included, each once."""
    n = F.size(items)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(i * (n - 1) / F.lit(max(k - 1, 1))).cast("int") + 1)
    return F.when(n <= k, items).otherwise(F.transform(F.array_distinct(picks), lambda i: F.element_at(items, i)))


def review_contract(label: Column, conf: Column, why: Column) -> Column:
    """struct(visual_label, confidence, why, source): what of a model's answer is accepted."""
    c = F.lower(F.trim(conf))
    good = F.coalesce(F.trim(label).isin(*v.TRUTHS) & c.isin("high", "mid", "low"), F.lit(False))
    return F.when(good, F.struct(F.trim(label).alias("visual_label"), c.alias("confidence"), F.substring(why, 1, 300).alias("why"), F.lit("llm").alias("source"))).otherwise(F.struct(F.lit(None).cast("string").alias("visual_label"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("why"), F.lit("parse_failed").alias("source")))


def pending(events: DataFrame, results: DataFrame) -> DataFrame:
    """Events without a decisive result; failed ones are tried again."""
    done = results.filter(F.col("visual_label").isNotNull() | (F.col("source") == "l0_blocked"))
    return events.join(done.select("event_id"), "event_id", "left_anti")


def severity_rank(label: Column) -> Column:
    from ..functions.scalar import lookup

    return lookup(label, {v.POTHOLE: 5, v.CRACK: 4, v.ROUGH: 3, v.MANHOLE: 2, v.MARKING: 1, v.FLAT: 0}, 0)


def worst_of(findings: DataFrame, key: str = "event_id") -> DataFrame:
    """The gravest, then surest finding of each event."""
    best = F.struct(severity_rank(F.col("label")).alias("s"), F.col("conf"), F.col("label"))
    return findings.groupBy(key).agg(F.max(best).alias("m"), F.count(F.lit(1)).alias("frames")).select(key, F.col("m.label").alias("label"), F.col("m.conf").alias("conf"), "frames")


def attention(reviews: DataFrame) -> DataFrame:
    """Counts for the summary panel: per label, and what needs a look."""
    failed = F.col("source").isin("parse_failed", "net_failed")
    needs = failed | (F.col("confidence") == "low") | F.col("escalated")
    return reviews.groupBy(F.coalesce("visual_label", F.lit("—")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(needs).alias("attention"), F.count_if(failed).alias("failed"))


def latest_rounds(rounds: DataFrame) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy(F.desc("round"))
    return rounds.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
