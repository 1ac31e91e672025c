"""Streams run to their end over the driver's tables, into files that a checkpoint stands behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..operators.graph import shared_folder
from ..sources import adapters as a
from ..streaming import online
from .registry import query
from .sensor import NEW


def _stream(spark, d) -> DataFrame:
    schema = a.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")


def _written(out: DataFrame) -> DataFrame:
    """Run a stream over all that is there into Parquet files in the shared folder; they are the result."""
    spark = out.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, online.ROCKSDB)
    try:
        writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# an event that is open at a recording's end is told once the watermark, ten minutes behind the latest sample of all, is ten minutes past the recording's last
@query(NEW + """, w AS (SELECT user_id // 10 AS pack_id, epoch_us(max(ts)) // 1000 AS ms, (SELECT epoch_us(max(ts)) // 1000 FROM events) AS latest FROM events GROUP BY 1),
x AS (SELECT pack_id, ev.t0 AS t0_ms, ev.dur AS duration_ms, ev.peak AS peak FROM f WHERE ev IS NOT NULL
UNION ALL SELECT f.pack_id, f.t0, f.t - f.t0, f.peak FROM f JOIN z ON f.pack_id = z.pack_id AND f.i = z.i JOIN w ON w.pack_id = f.pack_id WHERE f.t0 IS NOT NULL AND ms + 600000 <= latest - 600000)
SELECT pack_id, t0_ms, duration_ms, round(peak, 6) AS peak FROM x""")
def stream_detector(spark, d):
    raw = _stream(spark, d)
    stream = a.samples_of(raw, extra=["ts"]).select("pack_id", "event_id", "t_ms", "hp", "speed", F.col("ts").cast("timestamp").alias("ts"))
    return _written(online.detect(stream)).select("pack_id", "t0_ms", "duration_ms", rnd(F.col("peak")).alias("peak"))


# sessions that the watermark has passed by
@query("""WITH s AS (SELECT user_id // 10 AS pack_id, ts, ts - lag(ts) OVER (PARTITION BY user_id // 10 ORDER BY ts) >= INTERVAL 30 MINUTE AS new FROM events),
n AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY pack_id ORDER BY ts) AS k FROM s),
g AS (SELECT pack_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY pack_id, k)
SELECT pack_id, epoch_us("start") AS start_us, epoch_us("end") AS end_us, n FROM g WHERE epoch_us("end") // 1000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 600000""")
def stream_sessions(spark, d):
    stream = _stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("user_id") / 10).alias("pack_id"))
    w = F.col("session_window")
    return _written(online.sessions(stream)).select("pack_id", F.unix_micros(w["start"]).alias("start_us"), F.unix_micros(w["end"]).alias("end_us"), "n")
