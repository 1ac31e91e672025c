"""Filters and peaks over blocks equal those over whole recordings."""

import numpy as np
import pandas as pd
import pytest

from pavelake.operators import block_filters as bf
from pavelake.operators import spectral


def series(seed, n):
    rng = np.random.default_rng(seed)
    return 9.8 + np.cumsum(rng.normal(0, 0.02, n)) + rng.normal(0, 0.3, n) + 6 * (rng.random(n) < 0.01)


@pytest.mark.parametrize("block_rows", [40, 700, 10_000])
def test_zero_phase(spark, block_rows):
    data = {1: series(1, 3000), 2: series(2, 41), 3: series(3, 5), 4: series(4, 1)}
    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"pack_id": p, "i": np.arange(len(x)), "a": x, "b": -2 * x}) for p, x in data.items()]))
    for sections in (spectral.butterworth(4, 0.5, 100.0, "low"), spectral.butterworth_band(4, 1.0, 20.0, 100.0)):
        got = bf.zero_phase(rows, sections, ["a", "b"], block_rows).toPandas().sort_values(["pack_id", "i"])
        for p, x in data.items():
            own = got[got.pack_id == p]
            assert own.i.tolist() == list(range(len(x)))
            want = spectral.zero_phase(sections, x)
            assert np.abs(own.a - want).max() < 1e-9 and np.abs(own.b + 2 * want).max() < 1e-9


@pytest.mark.parametrize("block_rows", [300, 1700])
def test_prepare(spark, block_rows):
    rows = pd.concat([pd.DataFrame({"pack_id": p, "t_ms": 70 + 10 * np.arange(n), "ax": series(p, n) / 20, "ay": series(p + 5, n) / 30, "az": series(p + 9, n)}) for p, n in ((1, 2500), (2, 900))])
    d = spark.createDataFrame(rows)
    a, b = (x.toPandas().sort_values(["pack_id", "t_ms"]).reset_index(drop=True) for x in (bf.prepare(d, 100.0, block_rows), spectral.prepare(d)))
    assert a[["pack_id", "t_ms", "event_id"]].equals(b[["pack_id", "t_ms", "event_id"]])
    assert all(np.abs(a[c] - b[c]).max() < 1e-9 for c in ("lin_mag", "vz", "bp_mag", "bp_vz"))


def staged(seed, n):
    """Steps, plateaus and slopes, so that tops are flat, equal and cross borders."""
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.integers(0, 9, n).astype(float), rng.choice([1, 1, 2, 3, 30], n))[:n]
    x[n // 3 : n // 2] = np.linspace(9, 1, n // 2 - n // 3)
    return x


@pytest.mark.parametrize("block_rows", [1, 7, 64, 5000])
def test_peaks(spark, block_rows):
    data = {p: staged(p, n) for p, n in ((1, 900), (2, 300), (3, 100))}
    data[4] = np.full(400, 5.0)
    if block_rows == 1:
        data = {2: data[2]}
    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"pack_id": p, "t_ms": 10 * np.arange(len(x)), "event_id": np.arange(len(x)), "bp_mag": x, "floor": 0.1 + 0.4 * (np.arange(len(x)) % 50 > 25)}) for p, x in data.items()]))
    got = sorted(map(tuple, bf.peaks(rows, block_rows=block_rows).collect()))
    assert got == sorted(map(tuple, spectral.peaks(rows).collect())) and len(got) > 8


@pytest.mark.parametrize("seed", range(8))
def test_stairs(seed):
    """What blocks hand on gives the prominences of the whole series."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, 120).astype(float)
    want = spectral.prominences(x, np.arange(120))
    cuts = [0, *sorted(rng.choice(np.arange(1, 120), 9, replace=False).tolist()), 120]
    parts = [x[a:b] for a, b in zip(cuts, cuts[1:])]
    left, right = bf.Stairs(), bf.Stairs()
    before = [left.push(0, k, *bf.staircase(p.tolist()))[0][1:] for k, p in enumerate(parts)]
    after = [right.push(0, k, *bf.staircase(p[::-1].tolist()))[0][1:] for k, p in reversed(list(enumerate(parts)))][::-1]
    got = np.concatenate([bf.block_prominences(p, np.arange(len(p)), b, a) for p, b, a in zip(parts, before, after)])
    assert np.array_equal(got, want)


def test_numbers(spark):
    """Rows numbered in time, block by block."""
    rows = [(p, e, (e * 7919) % 5000) for p in (1, 2) for e in range(300)]
    got = bf.numbered(spark.createDataFrame(rows, "pack_id long, event_id long, t_ms long"), 400).collect()
    for p in (1, 2):
        own = sorted((r.t_ms, r.event_id, r.i) for r in got if r.pack_id == p)
        assert [i for *_, i in own] == list(range(300))


def test_empty(spark):
    none = spark.createDataFrame([], "pack_id long, i long, a double")
    assert bf.zero_phase(none, spectral.butterworth(4, 0.5, 100.0, "low"), ["a"]).count() == 0
    assert bf.peaks(spark.createDataFrame([], "pack_id long, t_ms long, event_id long, bp_mag double, floor double")).count() == 0
