"""Every query beside its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from pavelake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(x):
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 5)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    return x.item() if isinstance(x, np.generic) else x


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(con.sql(ORACLES[name]).df())
    else:
        assert len(got.columns)


def test_geojson_gathers_nothing(spark):
    assert "collect_list" not in QUERIES["geojson_features"](spark, SF)._jdf.queryExecution().toString()


def beside(spark, folder, name, events):
    """A query and its SQL over a few events: (event_id, t_ms, user_id, event_type, value)."""
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + to_milliseconds({t * 155000}), {u}, '{kind}', {x}::DOUBLE)" for i, t, u, kind, x in events)
    c = duckdb.connect()
    c.sql(f"copy (select i::BIGINT as event_id, t as ts, u::BIGINT as user_id, kind as event_type, x as value, '' as props from (values {rows}) v(i, t, u, kind, x)) to '{folder}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    return QUERIES[name](spark, str(folder)).toPandas(), c.sql(ORACLES[name]).df()


@pytest.mark.parametrize("name", ["feature_block", "feature_block_digest"])
def test_ratio_halfway_between_printed_ones(spark, tmp_path, name):
    got, want = beside(spark, tmp_path, name, [(90, 0, 1, "error", 40.0), (92, 500, 1, "view", 2.5)])  # 0.125 / 2
    assert rows(got) == rows(want)
    assert name != "feature_block" or "比值 0.063" in got["block"][0]


@pytest.mark.parametrize("name, column", [("ema_fold", "ema"), ("linear_resample", "hp"), ("pack_samples", "hp"), ("asof_hold", "hp"), ("recording_ema", "ema")])
def test_zero_has_no_sign(spark, tmp_path, name, column):
    got, want = beside(spark, tmp_path, name, [(1, 0, 1, "view", 0.0), (3, 500, 1, "view", 0.0), (4, 900, 1, "view", 2.0)])
    assert rows(got) == rows(want)
    assert not np.signbit(want[column].to_numpy(float)).any() and not np.signbit(got[column].to_numpy(float)).any()


def test_control_of_one_recording_sums_by_time(spark):
    assert "__squares" in QUERIES["qc_recording"](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["even_sampling", "sampling_gaps"])
def test_repeated_event_ids(spark, tmp_path, name):
    got, want = beside(spark, tmp_path, name, [(1, 1000, 1, "error", 2.0), (1, 0, 1, "error", 2.0), (2, 1100, 1, "view", 2.0)])
    assert rows(got) == rows(want)
    assert name != "sampling_gaps" or got[["backward", "long_gaps"]].values.tolist() == [[0, 1]]


def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert "informative" in got.columns and got.count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
