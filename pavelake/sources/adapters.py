"""The entities of the domain as views over general event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_MS = 1704067200000
USERS_PER_PACK = 10  # makes packs of about 40 samples a second, however many users there are
IMU_LABELS = ("坑洼", "减速带", "井盖", "粗糙路面", "误报", "")
VISION_LABELS = ("平路", "坑洼", "裂缝", "粗糙路面", "井盖", "标线", "")
WHYS = ("纵向延伸", "横向贯通", "网状")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index, values):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def samples(spark: SparkSession, sf_dir: str, divisor: int = 155000) -> DataFrame:
    """pack_id, event_id, t_ms, hp, vz, speed, lat, lon, label_raw."""
    return samples_of(table(spark, sf_dir, "events"), divisor)


def samples_of(e: DataFrame, divisor: int = 155000, extra: list[str] | tuple = ()) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - EPOCH_MS
    return e.select(
        F.floor(F.col("user_id") / USERS_PER_PACK).alias("pack_id"), "event_id", F.floor(ms / divisor).cast("bigint").alias("t_ms"),
        (F.col("value") / 20 * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).alias("hp"), (F.col("value") / 30 - 1).alias("vz"), (F.col("value") / 100).alias("speed"),
        (31.23 + (F.col("event_id") % 97) * 1e-4).alias("lat"), (121.47 + (F.col("event_id") % 89) * 1e-4).alias("lon"), F.col("event_type").alias("label_raw"), *extra,
    )


def imu_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pack_id, t_ms, duration, peak, label, final_type, lat, lon of recorded events."""
    s = samples(spark, sf_dir).filter(F.col("label_raw").isin("error", "purchase"))
    return s.select(F.col("event_id").alias("id"), "pack_id", "t_ms", ((F.col("event_id") % 90) / 100).alias("duration"), F.abs("hp").alias("peak"), pick(F.col("event_id"), IMU_LABELS).alias("label"), pick(F.col("event_id"), IMU_LABELS[:4]).alias("final_type"), "lat", "lon", "speed")


def vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pack_id, t_ms, vision_label, vision_conf, vision_why, lat, lon: of half the events, and of sweeps."""
    s = samples(spark, sf_dir)
    has = (F.col("label_raw") == "click") | ((F.col("label_raw") == "error") & (F.col("event_id") % 3 > 0))
    return s.filter(has).select(F.col("event_id").alias("id"), "pack_id", "t_ms", pick(F.col("event_id"), VISION_LABELS).alias("vision_label"), ((F.col("event_id") % 50) / 100 + 0.45).alias("vision_conf"), pick(F.col("event_id"), WHYS).alias("vision_why"), F.when(F.col("event_id") % 11 > 0, F.col("lat")).alias("lat"), F.when(F.col("event_id") % 11 > 0, F.col("lon")).alias("lon"))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accelerations as a phone gives them: gravity along the third axis, shaken by every thirtieth sample's value."""
    s = samples(spark, sf_dir)
    shaken = F.when(F.col("event_id") % 30 == 0, F.col("hp") * 2).otherwise(F.col("hp") / 20)
    return s.select("pack_id", "event_id", "t_ms", (F.col("vz") / 20).alias("ax"), (F.col("vz") / -30).alias("ay"), (9.81 + shaken).alias("az"), "lat", "lon", "speed")


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples as one recording, at about 60 samples a second for 100 000 of them."""
    return samples(spark, sf_dir, 1600).withColumn("pack_id", F.lit(0).cast("bigint"))


def pack_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packs' metadata says of them: right for most, wrong or missing for some, by the pack's number."""
    p = F.col("pack_id")
    counted = samples(spark, sf_dir).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t_ms") - F.min("t_ms")).alias("ms"))
    one_in = lambda k, x, other=None: F.when(p % k == 0, other).otherwise(x)
    return counted.select(
        "pack_id", pick(p, (8, 8, 7, 6)).alias("version"), one_in(7, (47 + p % 15).cast("double")).alias("sample_rate_hz"), one_in(5, F.col("n"), F.col("n") + 1).alias("sample_count"),
        one_in(11, F.col("ms") / 1000.0, F.col("ms") / 900.0).alias("duration_s"), (p % 6).cast("int").alias("event_count"), F.when(p % 4 == 1, 2).alias("gate_blocked_segments"), one_in(9, F.lit(True), F.lit(False)).alias("speed_usable"),
        one_in(3, (p % 10) / 10.0).cast("double").alias("suspect_ratio"), one_in(4, p % 2 == 0).alias("gaps_usable"), one_in(2, F.lit(0.25)).alias("floor_active_ratio"),
        (p % 3).cast("int").alias("mode_changes"), (p % 5 > 1).alias("mode_consistent"), pick(p, ("2026-09-24T08:05:00Z", "2026-09-24T09:40:00Z", "yesterday", None)).alias("exported_at"), one_in(2, F.lit(640), None).cast("int").alias("frame_width"),
    )


def sweep_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_id, t_ms, brightness, lap_var of sweep frames; a few can't be decoded, and one pack in 13 has none that can."""
    s = samples(spark, sf_dir).filter("label_raw = 'view'")
    there = (F.col("event_id") % 17 > 0) & (F.col("pack_id") % 13 > 0)
    return s.select("pack_id", "t_ms", F.when(there, F.col("event_id") % 200 - F.col("t_ms") / 400).alias("brightness"), F.when(there, (F.col("event_id") % 300).cast("double")).alias("lap_var"))


def recorded_events(events: DataFrame) -> DataFrame:
    """Replayed events as a collector may have stored them: starts off by a millisecond, and in some packs the first or the second missing."""
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("t0_ms"))
    e = events.withColumn("place", place)
    extra = e.filter((F.col("place") == 1) & (F.col("pack_id") % 4 == 1)).withColumn("t0_ms", F.col("t0_ms") - 900).withColumn("peak", F.lit(3.0))
    kept = e.filter(~((F.col("pack_id") % 7 == 3) & (F.col("place") == 2)))
    return kept.unionByName(extra).select("pack_id", (F.col("t0_ms") + F.col("t0_ms") % 3 - 1).alias("t0_ms"), (F.col("peak") * (1 + (F.col("t0_ms") % 5) / 100)).alias("peak"))


#: the same views for DuckDB
SAMPLES_SQL = """samples AS (
  SELECT user_id // 10 AS pack_id, event_id, CAST(floor((epoch_ms(ts) - 1704067200000) / 155000) AS BIGINT) AS t_ms,
    value / 20 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS hp, value / 30 - 1 AS vz, value / 100 AS speed,
    31.23::DOUBLE + (event_id % 97) * 1e-4::DOUBLE AS lat, 121.47::DOUBLE + (event_id % 89) * 1e-4::DOUBLE AS lon, event_type AS label_raw FROM events
)"""
IMU_SQL = (
    SAMPLES_SQL
    + """, imu AS (
  SELECT event_id AS id, pack_id, t_ms, (event_id % 90) / 100 AS duration, abs(hp) AS peak, (['坑洼','减速带','井盖','粗糙路面','误报',''])[CAST(event_id % 6 + 1 AS INT)] AS label,
    (['坑洼','减速带','井盖','粗糙路面'])[CAST(event_id % 4 + 1 AS INT)] AS final_type, lat, lon, speed FROM samples WHERE label_raw IN ('error', 'purchase')
)"""
)
VISION_SQL = """vision AS (
  SELECT event_id AS id, pack_id, t_ms, (['平路','坑洼','裂缝','粗糙路面','井盖','标线',''])[CAST(event_id % 7 + 1 AS INT)] AS vision_label, (event_id % 50) / 100 + 0.45::DOUBLE AS vision_conf,
    (['纵向延伸','横向贯通','网状'])[CAST(event_id % 3 + 1 AS INT)] AS vision_why, CASE WHEN event_id % 11 > 0 THEN lat END AS lat, CASE WHEN event_id % 11 > 0 THEN lon END AS lon
  FROM samples WHERE label_raw = 'click' OR (label_raw = 'error' AND event_id % 3 > 0)
)"""
