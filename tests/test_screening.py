"""Candidate features in one pass over blocks of time, beside the joins that each of them is stated by."""

import numpy as np
import pytest

from pavelake.operators import screening

NAMES = [*screening.SHAPE, *screening.SURROUNDINGS, "az_drift"]


@pytest.fixture(scope="module")
def ride(spark):
    rng = np.random.default_rng(3)
    rows, events = [], []
    for pack in (1, 2):
        t = np.sort(rng.integers(-5000, 70_000, 1500))  # across three blocks, with repeated times
        for i, at in enumerate(t):
            rows.append((pack, i, int(at), None if i % 41 == 0 else float(rng.normal()), *map(float, rng.normal(size=4)), None if i % 29 == 0 else float(rng.normal()), float(rng.normal())))
        events += [(pack, i, int(rng.integers(-4000, 69_000)), int(rng.integers(0, 900)), 5.0) for i in range(40)]
    events += [(1, 100, 20_000, 12_000, 5.0), (1, 101, 29_990, 500, 5.0), (1, 101, 45_000, 500, 5.0), (2, 102, 500_000, 100, 5.0), (3, 103, 0, 100, 5.0)]
    samples = spark.createDataFrame(rows, "pack_id long, event_id long, t_ms long, hp double, vz double, ax double, ay double, az double, gx double, gy double").selectExpr("*", "vz / 3 as gz")
    return samples, spark.createDataFrame(events, "pack_id long, id long, t0_ms long, duration_ms long, speed double")


def test_candidates_equal_the_joins(ride):
    s, e = ride
    joined = screening.shapes(s, e).join(screening.surroundings(s, e), ["pack_id", "id"]).join(screening.drifts(s, e), ["pack_id", "id"])
    want = {(r.pack_id, r.id): r for r in joined.dropDuplicates(["pack_id", "id"]).collect()}
    rows = screening.candidates(s, e).collect()
    got = {(r.pack_id, r.id): r for r in rows}
    assert len(want) > 60 and {(1, 100), (1, 101)} <= set(want) and set(got) == set(want)
    for key in want.keys() - {(1, 101)}:  # two events of one id are two shapes by the definition of shapes
        a, b = ([r[n] for n in NAMES] for r in (got[key], want[key]))
        assert [x is None for x in a] == [x is None for x in b], key
        assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None], rel=1e-9, abs=1e-12, nan_ok=True), key


def test_candidates_pair_no_sample_with_every_event(ride):
    """Samples meet events by blocks only: nothing but long or repeated events goes through the interval join."""
    s, e = ride
    short = screening.apart(e)[0]
    assert short.count() == 82 and {r.id for r in screening.apart(e)[1].collect()} == {100, 101}
    plan = screening.candidates(s, e)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_over_ranges():
    x = np.random.default_rng(1).normal(size=37)
    lo, hi = (a.ravel() for a in np.meshgrid(np.arange(38), np.arange(38)))
    for op, none in ((np.add, 0.0), (np.maximum, -np.inf)):
        assert screening.over_ranges(x, lo, hi, op, none) == pytest.approx([op.reduce(x[a:b], initial=none) if b > a else none for a, b in zip(lo, hi)])
