"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from pavelake.operators import detector
from pavelake.streaming import online

from .test_domain import SAMPLE, ride


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, online.ROCKSDB)
    yield
    spark.conf.set(key, before)


def files_of(spark, batch, folder, parts):
    """The samples of every pack in files by time, with a clock that runs with t_ms."""
    timed = batch.withColumn("ts", F.timestamp_millis(F.lit(1704067200000) + F.col("t_ms")))
    step = batch.agg(F.max("t_ms")).first()[0] // parts + 1
    for i in range(parts):
        timed.filter(F.floor(F.col("t_ms") / step) == i).coalesce(1).write.mode("append").parquet(folder)
    return timed.schema


def run(spark, schema, source, sink, state, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = online.detect(stream, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(online.OUT).parquet(sink)


def told(d):
    return sorted((r.pack_id, r.t0_ms, r.duration_ms, round(r.peak, 6)) for r in d.collect())


@pytest.mark.parametrize("version", [0.8, 0.6])
def test_stream_equals_batch(spark, tmp_path, version):
    batch = spark.createDataFrame(ride([5, 15, 25, 35, 45]), SAMPLE)
    schema = files_of(spark, batch, str(tmp_path / "in"), 3)
    got = run(spark, schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), version=version)
    want = told(detector.events(detector.replay(batch, version)))
    assert told(got) == want and want


def test_restart_and_the_flush_at_a_recordings_end(spark, tmp_path):
    """Stopped inside an event and started again from the checkpoint; the event open when the recording falls silent is told by the timer."""
    loud = {*range(2000, 2101, 20), *range(4980, 5001, 20)}
    rows = [(1, i, t, 9.0 if t in loud else 0.01, 1.0) for i, t in enumerate(range(0, 5001, 20))]
    other = [(2, 10_000 + i, t, 0.01, 1.0) for i, t in enumerate(range(0, 3_000_000, 60_000))]
    one, rest = (spark.createDataFrame([r for r in rows if (r[2] < 2050) == early], SAMPLE) for early in (True, False))
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = files_of(spark, one, source, 1)
    assert run(spark, schema, source, sink, state).count() == 0
    files_of(spark, rest, source, 1)
    run(spark, schema, source, sink, state)
    files_of(spark, spark.createDataFrame(other, SAMPLE), source, 1)
    got = run(spark, schema, source, sink, state)
    want = told(detector.events(detector.replay(spark.createDataFrame(rows, SAMPLE))))
    assert told(got) == want and [x[1] for x in want] == [2000, 4980] and want[1][1] + want[1][2] == 5000
    assert run(spark, schema, source, sink, state).count() == 2  # nothing is told twice


def test_windows_and_sessions(spark, tmp_path):
    d = spark.range(100).select((F.col("id") % 2).alias("pack_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"), F.lit(1.0).alias("hp"))
    late = spark.range(1).select(F.lit(9).cast("long").alias("pack_id"), F.lit(999).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(1704067200 + 10**6)).alias("ts"), F.lit(1.0).alias("hp"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    for name, out in (("w", online.windowed(stream)), ("s", online.sessions(stream)), ("u", online.distinct_samples(stream))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 100
    assert spark.table("s").count() == 2 and spark.table("s").agg(F.sum("n")).first()[0] == 100
    assert spark.table("u").count() == 101


def test_samples_of_one_time_are_judged_by_the_same_noise(spark, tmp_path):
    """Every sample is there twice: both are in the noise before the first is judged, as in the replay of a table."""
    batch = spark.createDataFrame(ride([5, 15, 25, 35, 45]), SAMPLE)
    batch = batch.unionByName(batch.withColumns({"event_id": F.col("event_id") + 1_000_000, "hp": F.col("hp") * 0.9}))
    schema = files_of(spark, batch, str(tmp_path / "in"), 1)
    got = told(run(spark, schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")))
    assert got == told(detector.events(detector.replay(batch, 0.8))) and got
