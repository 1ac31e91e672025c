"""Alignment by islands, evaluation report and gain, totals, result files, log rules."""

import random

import pytest
from pyspark.sql import functions as F

from pavelake import vocab as v
from pavelake.operators import evaluate, joins, logs, rollup
from pavelake.sources import sinks


def brute(imu, vision, tolerance):
    """The rule as it is stated, one vision event after the other over all free ones."""
    out, used = [], set()
    for p, vid, t in sorted(x for x in vision if x[2] is not None):
        free = [(abs(x[2] - t), x[1]) for x in imu if x[0] == p and x[:2] not in used and x[2] is not None]
        if free and min(free)[0] <= tolerance:
            used.add((p, min(free)[1]))
            out.append((p, vid, min(free)[1]))
    return sorted(out)


@pytest.mark.parametrize("seed,tolerance", [(1, 5), (2, 40), (3, 0), (4, 100_000)])
def test_alignment(spark, seed, tolerance):
    rng = random.Random(seed)
    rows = lambda n: [(p, i * 3 + rng.randrange(3), rng.choice([None, rng.randrange(600), rng.randrange(60) * 10])) for p in (1, 2) for i in range(n)]
    imu, vision = rows(60), rows(80)
    shape = "pack_id long, id long, t_ms long"
    got = joins.align_greedy(spark.createDataFrame(imu, shape), spark.createDataFrame(vision, shape), tolerance)
    assert sorted(map(tuple, got.collect())) == brute(imu, vision, tolerance)
    assert joins.align_greedy(spark.createDataFrame([], shape), spark.createDataFrame(vision, shape), 5).count() == 0


def test_free_times():
    rng = random.Random(5)
    rows = [(rng.randrange(40), i) for i in range(300)]
    free, left = joins.FreeTimes([t for t, _ in rows], [i for _, i in rows]), dict((i, t) for t, i in rows)
    for _ in range(320):
        t = rng.randrange(-5, 45)
        want = min(((abs(x - t), i) for i, x in left.items()), default=(None, None))
        want = want[1] if want[0] is not None and want[0] <= 7 else None
        assert free.take(t, 7) == want
        left.pop(want, None)


@pytest.fixture(scope="module")
def judged(spark):
    gold = spark.createDataFrame([(1, v.POTHOLE, v.POTHOLE), (2, v.FLAT, v.MANHOLE), (3, v.POTHOLE, v.FLAT), (4, v.BLOCKED, v.UNDECIDED)], "event_id long, truth_label string, imu_label string")
    rows = [("one", 1, "llm", v.POTHOLE), ("one", 2, "llm", v.FLAT), ("one", 3, "llm", v.FLAT), ("one", 4, "l0_blocked", None), ("two", 1, "llm", v.POTHOLE), ("two", 2, "llm", v.ROUGH), ("two", 3, "llm", v.POTHOLE), ("two", 4, "net_failed", None)]
    return gold, spark.createDataFrame(rows, "model string, event_id long, source string, visual_label string")


def test_report(judged):
    got = {r.model: r for r in evaluate.report(*judged).collect()}
    assert got["one"].line == "| one | 100.0 | 66.7 | 0.0 | 25.0 | 75.0 | 50.0 | 100.0 | 1 | 0 | 0 | 0 |"
    assert got["one"].gates == "一致率≥75% ❌；幻觉率≤10% ✅；JSON合规≥95% ✅"
    assert got["two"].gates == "一致率≥75% ❌；幻觉率≤10% ❌；JSON合规≥95% ❌"
    matrix = got["two"].matrix.split("\n")
    assert matrix[0] == f"| | {' | '.join(sorted([v.POTHOLE, v.FLAT, v.ROUGH]))} |" and matrix[1] == "|---|---|---|---|"
    row = next(x for x in matrix if x.startswith(f"| **{v.POTHOLE}**"))
    assert row.count("2") == 1 and row.count("0") == 2
    assert got["one"].text.startswith("### one\n\n| one |") and "基线：一致率" in got["one"].text


def test_gain(judged):
    gold, reviews = judged
    r = evaluate.gain(gold, reviews, "one", "two").first()
    assert (r.base_recall, r.base_cost, r.agent_recall, r.agent_cost, r.verdict) == (50.0, 1.0, 100.0, 1.5, "effective")
    assert evaluate.gain(gold, reviews, "one", "two", most_cost=1.2).first().verdict == "frontier"
    assert evaluate.gain(gold, reviews, "two", "one").first().verdict == "none"
    assert evaluate.gain(gold, reviews, "one", "three").first().verdict == "incomplete"


def test_totals(spark):
    d = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, None, 5.0, 3.0), (2, "a", 1.0, 2.0)], "pack_id long, kind string, peak double, duration double")
    got = sorted(((r.level, r.pack_id or 0, r.kind or "", r.events, r.max_peak, r.mean_duration) for r in rollup.rolled_up(d, ["pack_id", "kind"]).collect()))
    assert got == [(0, 1, "", 1, 5.0, 3.0), (0, 1, "a", 1, 2.0, 1.0), (0, 2, "a", 1, 1.0, 2.0), (1, 1, "", 2, 5.0, 2.0), (1, 2, "", 1, 1.0, 2.0), (2, 0, "", 3, 5.0, 2.0)]
    cube = {(tuple(r.over), r.pack_id, r.kind): r.events for r in rollup.cubed(d, ["pack_id", "kind"]).collect()}
    assert cube[(("pack_id",), None, "a")] == 2 and cube[(("pack_id",), None, None)] == 1 and cube[(("pack_id", "kind"), None, None)] == 3 and len(cube) == 8


def test_result_files(spark, tmp_path):
    events = spark.createDataFrame([(1.5, 2, v.POTHOLE), (0.5, 1, 'a "b", c')], "peak double, id long, final_type string")
    importance = spark.createDataFrame([("rms", 0.2), ("peak", 0.8)], "feature string, importance double")
    assert sinks.write_analysis(str(tmp_path), events, importance=importance) == ["events.csv", "feature_importance.csv"]
    text = (tmp_path / "events.csv").read_bytes()
    assert text.startswith("﻿id,peak,final_type\n1,0.5,".encode()) and text.decode("utf-8-sig").splitlines()[1] == '1,0.5,"a ""b"", c"'
    assert (tmp_path / "feature_importance.csv").read_text("utf-8-sig").splitlines()[1:] == ["peak,0.8", "rms,0.2"]
    with pytest.raises(ValueError, match="more than 1"):
        sinks.markdown_table(importance, most=1)


def test_unknown_sources_are_an_error(spark):
    d = spark.createDataFrame([(1, "llm"), (2, "net_failed"), (3, None), (4, "l0_blocked")], "event_id long, source string")
    assert [r.event_id for r in logs.vision_records(d).collect()] == [1]
    with pytest.raises(Exception, match="unknown source oracle"):
        logs.vision_records(d.union(spark.createDataFrame([(5, "oracle")], "event_id long, source string"))).collect()


def test_reviews_of_another_pack_do_not_count(spark):
    events = spark.createDataFrame([(1, 7, "0"), (2, 7, "1")], "pack_id long, event_id long, low_speed string")
    got = logs.summarize(events, spark.createDataFrame([(2, 7, True, False)], "pack_id long, event_id long, attention boolean, agree boolean"), ["pack_id"]).orderBy("pack_id").collect()
    assert [(r.unreviewed, r.attention, r.disagree) for r in got] == [(1, 0, 0), (0, 1, 1)]


def test_schema_problems(spark):
    d = spark.createDataFrame([(1, 5, "llm", "x", "s.v0"), (1, 6, "llm", "x", "t"), (1, 7, "other", " ", None)], "pack_id long, event_id long, generated string, why string, schema string")
    known = spark.createDataFrame([(1, 5), (2, 6), (1, 7)], "pack_id long, event_id long")
    got = sorted((r.event_id, r.problem) for r in logs.schema_problems(d, "s.v0", known).collect())
    assert got == [(6, "other_schema"), (6, "unknown_event"), (7, "bad_origin"), (7, "blank_text"), (7, "other_schema")]
    assert logs.schema_problems(d.filter("event_id < 7")).count() == 0
