"""The null-hypothesis query draws as many replicates as the reference: 20 of each kind."""

import pytest

from pavelake.operators import qc, quality
from pavelake.plans import QUERIES

from .test_queries import SF, pytestmark  # noqa: F401


def test_twenty_of_each_kind(spark, monkeypatch):
    drawn = []
    real = quality.surrogates
    monkeypatch.setattr(quality, "surrogates", lambda *a, **k: drawn.append(real(*a, **k)) or drawn[-1])
    got = QUERIES["surrogate_events"](spark, SF).collect()
    noise = drawn[0].groupBy("pack_id", "kind").agg({"replicate": "count", "n_events": "avg"}).collect()
    assert got and {r["count(replicate)"] for r in noise} == {20}
    means = {(r.pack_id, r.kind): r["avg(n_events)"] for r in noise}
    for r in got:
        assert r.stationary == pytest.approx(means[r.pack_id, "stationary"]) and r.envelope == pytest.approx(means[r.pack_id, "envelope"])
        assert r.informative == (r.n_events > max(r.stationary, r.envelope))


def test_facts_of_a_document_come_from_all_frames(spark):
    """Of 400 sweep frames the one that 300 evenly spaced ones leave out is dark and blurred."""
    frames = [(0, t, 100.0, 100.0) for t in range(400)]
    missed = next(i for i in range(400) if i not in {k * 399 // 299 for k in range(300)})
    frames[missed] = (0, missed, 0.0, 0.0)
    d = spark.createDataFrame(frames, "pack_id long, t_ms long, brightness double, lap_var double")
    every, some = qc.frame_facts(d).first(), qc.frame_facts(d, 300).first()
    assert (every.frames, every.decoded, every.dark_ratio, every.blur_ratio) == (400, 400, 1 / 400, 1 / 400)
    assert (some.frames, some.decoded, some.dark_ratio) == (400, 300, 0)


def test_document_asks_for_all_frames(spark, monkeypatch):
    asked = []
    real = qc.frame_facts
    monkeypatch.setattr(qc, "frame_facts", lambda frames, cap=None: asked.append(cap) or real(frames, cap))
    QUERIES["qc_document"](spark, SF)
    assert asked == [None]
