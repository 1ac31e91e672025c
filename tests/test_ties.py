"""Rows that share an id, and values at a threshold or halfway between two printed ones: one rule in queries and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pavelake.functions.scalar import rnd_scaled, threshold
from pavelake.operators import detector, joins
from pavelake.operators import timeseries as ts
from pavelake.operators.folds import TrailingQuantile
from pavelake.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """Events whose ids come back at other times in the same packs."""
    d = tmp_path_factory.mktemp("shared")
    duckdb.sql(f"copy (select event_id, ts + to_seconds(k * 20000) as ts, user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet', (select unnest(range(3)) as k)) to '{d}/events.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["mutual_nearest", "keyframes", "interval_slice", "context_mask"])
def test_shared_ids(spark, shared, name):
    got = QUERIES[name](spark, shared)
    columns = ", ".join(got.columns)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{shared}/events.parquet'")
    want = con.sql(f"select {columns} from ({ORACLES[name]})").fetchall()
    assert len(want) > 50 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_mutual_nearest_counts_repeated_rows_once(spark):
    make = lambda rows: spark.createDataFrame(rows, "pack_id long, id long, t_ms long")
    got = joins.mutual_nearest(make([(0, 1, 10)] * 3 + [(0, 1, 1000)]), make([(0, 2, 12)] * 2 + [(0, 2, 1003)]), 20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 2), (0, 1, 2, 3)]


def test_threshold_has_no_last_digits(spark):
    noise = 0.6994999999999999 + 2.3e-16  # what an interpolation gives for 0.6995
    assert noise != 0.6995 and spark.range(1).select(threshold(F.lit(noise))).first()[0] == 2.798


def test_replay_of_rows_of_one_time_and_id(spark):
    rows = [(0, 1000, 1, 5.0, 1.0, 0.0, 9.0, False), (0, 1000, 1, 1.3, 1.0, 0.0, 9.0, False), (0, 1100, 2, 0.1, 1.0, 0.0, 9.0, False)]
    schema = "pack_id long, t_ms long, event_id long, hp double, thr double, dead double, speed double, gated boolean"
    found = [[tuple(r) for r in detector.found_in(spark.createDataFrame(r, schema).coalesce(1)).collect()] for r in (rows, [rows[1], rows[0], rows[2]])]
    assert found[0] == found[1] and ("in_event", 1000) in {x[1:3] for x in found[0]}


def test_halves_are_moved(spark, tmp_path):
    """The root mean square of one sample of 0.0005 * k among 64 lies halfway for odd k."""
    con = duckdb.connect()
    con.sql(f"""copy (select i::bigint as event_id, timestamp '2024-01-01' + to_milliseconds((case when i % 65 = 0 then 1 else 1001 end + (i // 65) * 10000) * 155000) as ts, 1::bigint as user_id,
        case when i % 65 = 0 then 'error' else 'view' end as event_type, case when i % 65 = 1 then (2 * (i // 65) + 1) / 100 else 0 end as value, '' as props from range(6500) t(i)) to '{tmp_path}/events.parquet'""")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(f"select id, n, ctx_rms from ({ORACLES['context_mask']})").fetchall()
    got = QUERIES["context_mask"](spark, str(tmp_path)).select("id", "n", "ctx_rms").collect()
    assert len(want) == 100 and sorted(map(tuple, got)) == sorted(want) and {n for _, n, _ in want} == {64}
    assert dict((i, x) for i, _, x in want)[0] == pytest.approx(0.000063, abs=1e-9)


@pytest.mark.parametrize("name", ["feature_block", "feature_block_digest"])
def test_texts_of_shared_ids(spark, shared, name):
    """An id that comes back is an event at each of its times, not every pair of them."""
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{shared}/events.parquet'")
    got = QUERIES[name](spark, shared)
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize(("digits", "values"), [(8, (-0.485578125, -1.946328125, -3.640640625)), (6, (-0.0508415, 0.0021875, 2.5e-7))])
def test_halfway_values_are_rounded_as_in_sql(spark, digits, values):
    """Products of decimals lie a last digit off the half or on it; both engines decide by the scaled number."""
    near = [x * (1 + k * 2.0**-52) for x in values for k in (-1, 0, 1)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in near], "x double").select(rnd_scaled(F.col("x"), digits)).collect()]
    assert got == [duckdb.execute(f"select round(?::double, {digits}) + 0.0", [x]).fetchall()[0][0] for x in near]


def test_linear_resample_at_size(spark):
    """Three points of sf0.1 lie halfway between two printed values."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    want = con.sql(f"select pack_id, t_ms, hp from ({ORACLES['linear_resample']})").fetchall()
    assert sorted(map(tuple, QUERIES["linear_resample"](spark, sf).select("pack_id", "t_ms", "hp").collect())) == sorted(want)


def test_recorded_order(spark):
    """Of one event_id the earlier sample first, what has no event_id last: 10, 30, 20, 40 and not 40, 10, ..."""
    rows = [(0, None, 40), (0, 2, 20), (0, 1, 30), (0, 1, 10)]
    assert tuple(ts.gaps(spark.createDataFrame(rows, "pack_id long, event_id long, t_ms long"), 15).first()) == (0, 0, 1, 2)


def test_rows_without_a_time_end_no_quantile():
    fold = TrailingQuantile(100, 0.5)
    got = [q for row in ((None, 9.0), (None, 7.0), (0, 1.0), (50, -3.0)) for q in fold.push(*row)] + fold.end()
    assert got == [8.0, 8.0, 1.0, 2.0]


@pytest.mark.parametrize("name", ["qc_checks", "sampling_gaps", "even_sampling", "missed_segments"])
def test_shared_ids_in_checks(spark, shared, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{shared}/events.parquet'")
    got = QUERIES[name](spark, shared)
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_events_without_a_pack_or_a_time(spark, tmp_path):
    """They have no samples around them, so neither query nor SQL slices any."""
    con = duckdb.connect()
    con.sql(f"copy (select event_id, case when event_id % 7 > 0 then ts end as ts, case when event_id % 5 > 0 then user_id end as user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = QUERIES["interval_slice"](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLES['interval_slice']})").fetchall()
    assert len(want) > 50 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
