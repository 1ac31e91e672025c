"""Agent logs: traces, reviews and escalations put together per event, their validation and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_ENDS = ("escalated", "budget_exhausted", "no_new_evidence", "net_failed", "parse_failed")
FAILED = ("net_failed", "parse_failed")


def join_logs(traces: DataFrame, reviews: DataFrame, escalations: DataFrame) -> DataFrame:
    """One row per event: the last trace and review, counts, status and whether it needs attention.

    traces: event_id, line, final, escalated; reviews: event_id, line, source, visual_label; escalations: event_id.
    """
    t = traces.groupBy("event_id").agg(F.max_by("final", "line").alias("final"), F.max("escalated").alias("escalated"), F.count(F.lit(1)).alias("n_traces"))
    r = reviews.groupBy("event_id").agg(F.max_by("source", "line").alias("source"), F.max_by("visual_label", "line").alias("visual_label"), F.count(F.lit(1)).alias("n_reviews"))
    e = escalations.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_escalations"))
    j = t.join(r, "event_id", "full").join(e, "event_id", "full")
    status = F.coalesce("final", "source", F.lit("unknown"))
    needs = (F.coalesce("n_escalations", F.lit(0)) > 0) | F.coalesce("escalated", F.lit(False)) | status.isin(*OPEN_ENDS) | F.coalesce(F.col("source").isin(*FAILED), F.lit(False))
    warning = F.when(F.greatest(F.coalesce("n_traces", F.lit(0)), F.coalesce("n_reviews", F.lit(0))) > 1, "repeated").when(F.col("n_traces").isNull(), "no_trace")
    return j.select("event_id", status.alias("status"), needs.alias("attention"), "visual_label", "source", warning.alias("warning"))


def problems(records: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, problem of log records: bad ids, ids that the pack does not have, another pack, missing rounds.

    records: event_id string, pack_id, n_rounds; events: pack_id, event_id long.
    """
    number = F.col("event_id").try_cast("bigint")
    known = events.select(F.col("event_id").alias("known_id"), F.col("pack_id").alias("known_pack"))
    j = records.withColumn("number", number).join(known, number == F.col("known_id"), "left")
    found = F.array(
        F.when(number.isNull() | (number < 0), "bad_id"), F.when((number >= 0) & F.col("known_id").isNull(), "unknown_event"),
        F.when(F.col("pack_id") != F.col("known_pack"), "other_pack"), F.when(F.col("n_rounds").isNull(), "no_rounds"),
    )
    return j.select("event_id", F.explode(F.array_compact(found)).alias("problem"))


def vision_records(joined: DataFrame) -> DataFrame:
    """Reviews to hand on: decided ones; failed and blocked ones are skipped, one of an unknown source is an error."""
    known = F.when(F.col("source") == "llm", True).when(F.col("source").isin(*FAILED, "l0_blocked"), False)
    return joined.filter(F.col("source").isNotNull()).filter(F.coalesce(known, F.raise_error(F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(": unknown source "), F.col("source"))).cast("boolean")))


def summarize(events: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key: events, reviews, what needs a look, low speed known or not.

    events: keys, event_id, low_speed string; reviews: keys (event_id alone tells no packs apart), event_id, attention, agree.
    """
    r = reviews.select(*keys, "event_id", "attention", "agree", F.lit(True).alias("reviewed"))
    j = events.join(r, [*keys, "event_id"], "left")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("reviewed").isNull()).alias("unreviewed"), F.count_if("attention").alias("attention"), F.count_if(~F.col("agree")).alias("disagree"),
        F.count_if(F.col("low_speed") == "1").alias("low_speed"), F.count_if(~F.coalesce(F.col("low_speed").isin("0", "1"), F.lit(False))).alias("low_speed_unknown"),
    )


def checklist(counts: DataFrame, expected: dict[str, Column]) -> DataFrame:
    """pack_id, item, value, expected, ok: what a recording holds against what its metadata says."""
    rows = [F.struct(F.lit(k).alias("item"), F.col(k).cast("bigint").alias("value"), x.cast("bigint").alias("expected")) for k, x in expected.items()]
    return counts.select("pack_id", F.explode(F.array(*rows)).alias("c")).select("pack_id", "c.*").withColumn("ok", F.col("expected").isNull() | (F.col("value") == F.col("expected")))


def collection_window(exported_at: Column, duration_s: Column, offset_hours: int = 8) -> Column:
    """struct(start, end, evening): local begin and end of a recording from its UTC export time."""
    end = F.timestamp_micros((F.unix_micros(exported_at.cast("timestamp")) + F.lit(offset_hours * 3_600_000_000)).cast("bigint"))
    start = F.timestamp_micros((F.unix_micros(end) - (duration_s * 1_000_000).cast("bigint")).cast("bigint"))
    return F.struct(F.date_format(start, "yyyy-MM-dd HH:mm").alias("start"), F.date_format(end, "yyyy-MM-dd HH:mm").alias("end"), (F.hour(start) + F.minute(start) / 60 >= 16.5).alias("evening"))


def schema_problems(reports: DataFrame, schema_id: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """event_id, problem of review rows: bad origin, blank text, ids that repeat or are negative; with schema_id another schema
    (column schema), with known (pack_id, event_id) ids that the pack does not have."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("event_id"))
    rows = reports.withColumn("copies", copies)
    found = [
        F.when(~F.coalesce(F.col("generated").isin("llm", "human_example"), F.lit(False)), "bad_origin"), F.when(F.coalesce(F.trim("why"), F.lit("")) == "", "blank_text"),
        F.when(F.col("event_id") < 0, "negative_id"), F.when(F.col("copies") > 1, "repeated_id"),
    ]
    if schema_id is not None:
        found.append(F.when(~F.coalesce(F.col("schema") == schema_id, F.lit(False)), "other_schema"))
    if known is not None:
        rows = rows.join(known.select("pack_id", "event_id").distinct().withColumn("__known", F.lit(True)), ["pack_id", "event_id"], "left")
        found.append(F.when(F.col("__known").isNull(), "unknown_event"))
    return rows.select("event_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))
