"""Calls with retries, the bounded loop, prompts and first-level records."""

import json

import pytest
from pyspark.sql import functions as F

from pavelake import vocab as v
from pavelake.operators import agent


def says(label, confidence="mid", why="x"):
    return json.dumps({"visual_label": label, "confidence": confidence, "why": why})


def script(*answers):
    """A model that gives these answers in turn, the last one for ever; exceptions are raised."""
    left = list(answers)

    def model(request):
        x = left.pop(0) if len(left) > 1 else left[0]
        if isinstance(x, Exception):
            raise x
        return x

    return model


RECORD = {"event_id": 1, "blocked": False, "text": "t", "keyframes": ["a", "b", "c"], "usable": 3, "spare": ["d", "e", "f", "g", "h"], "crest": 9.0}


@pytest.mark.parametrize("answers,status,tries,waits", [
    ([says(v.POTHOLE)], "ok", 1, []), ([OSError("x"), OSError("x"), says(v.FLAT)], "ok", 3, [2, 4]), ([OSError("x")], "net_failed", 4, [2, 4, 8]),
    ([agent.Permanent("no")], "net_failed", 1, []), (["no json", says(v.FLAT)], "ok", 2, []), (["no json"], "parse_failed", 2, []), (["[1]", "{}"], "parse_failed", 2, []),
    ([OSError("x"), "no json", OSError("x"), says(v.FLAT)], "ok", 4, [2, 4]),
])
def test_calls(answers, status, tries, waits):
    waited = []
    got = agent.call(script(*answers), {}, waited.append)
    assert (got[1], got[2], waited) == (status, tries, waits)


@pytest.mark.parametrize("change,answers,final,label,confidence,calls,actions", [
    ({}, [says(v.POTHOLE)], "converged", v.POTHOLE, "high", 1, []),
    ({"blocked": True}, [says(v.POTHOLE)], "blocked", v.BLOCKED, "high", 0, []),
    ({"crest": 1.5}, [says(v.LONGITUDINAL)], "converged", v.LONGITUDINAL, "mid", 2, ["r3_two_frames"]),
    ({"crest": 1.5, "spare": []}, [says(v.LONGITUDINAL)], "no_new_evidence", v.LONGITUDINAL, "low", 1, ["r3_two_frames"]),
    ({"usable": 0}, [says(v.FLAT)], "escalated", v.FLAT, "low", 2, ["r2_more_frames"]),
    ({"usable": 1}, [says(v.FLAT)], "escalated", v.FLAT, "low", 2, ["r2_more_frames"]),
    ({"usable": 2}, [says(v.FLAT)], "converged", v.FLAT, "high", 1, []),
    ({"usable": 0, "spare": ["d"]}, [says(v.FLAT)], "escalated", v.FLAT, "low", 2, ["r2_more_frames"]),
    ({}, [says(v.POTHOLE, "low")], "escalated", v.POTHOLE, "low", 1, []),
    ({}, [agent.Permanent("no")], "net_failed", None, None, 8, []),
    ({}, ["no json"], "parse_failed", None, None, 8, []),
    ({}, [says("nonsense"), says(v.FLAT, "HIGH ")], "converged", v.FLAT, "high", 2, []),
])
def test_loop(change, answers, final, label, confidence, calls, actions):
    got = agent.judge_event(RECORD | change, script(*answers), lambda s: None)
    assert (got["final"], got["visual_label"], got["confidence"], got["calls"], got["actions"]) == (final, label, confidence, calls, actions)
    assert got["rounds"] <= agent.MOST_ROUNDS and got["calls"] <= agent.MOST_CALLS


def test_new_frames_are_shown():
    seen = []

    def model(request):
        seen.append(request["frames"])
        return says(v.POTHOLE)

    agent.judge_event(RECORD | {"crest": None, "usable": 1}, model)
    assert seen == [["a", "b", "c"], ["a", "b", "c", "d", "e", "f", "g", "h"]]


def test_run(spark):
    rows = [(i, i % 4 == 0, f"event {i}", ["a"], 3, ["d"], 9.0) for i in range(20)]
    d = spark.createDataFrame(rows, "event_id long, blocked boolean, text string, keyframes array<string>, usable int, spare array<string>, crest double").repartition(3)

    def model(request):
        return '{"visual_label": "坑洼", "confidence": "high", "why": "y"}'

    got = agent.run(d, model).collect()
    assert len(got) == 20 and all((r.final == "blocked") == (r.event_id % 4 == 0) and (r.calls == 0) == (r.final == "blocked") for r in got)
    assert agent.run(d.limit(0), model).count() == 0


def test_prompts(spark):
    d = spark.createDataFrame([(7, -400, 0, None, [200, -600, 0], "B")], "id long, a int, b int, c int, o array<int>, block string")
    three = d.select(agent.prompt(F.col("id"), {"pre": F.col("a"), "impact": F.col("b"), "post_proxy": F.col("c")}, F.col("block"))).first()[0]
    assert three.startswith("事件 #7。") and "冲击前 -400ms" in three and "冲击即时 +0ms" in three and "最近帧 +0ms。" in three and "\n\nB\n\n" in three
    many = d.select(agent.prompt_of_many(F.col("id"), F.col("o"), F.col("block"))).first()[0]
    assert "3 帧连续画面" in many and "第1帧-600ms，第2帧+0ms，第3帧+200ms" in many


def test_records(spark):
    events = spark.createDataFrame([(1,), (2,), (3,)], "event_id long")
    frames = spark.createDataFrame([(1, "pre", 10, -400, 0), (1, "impact", 20, 0, 0), (2, "pre", 30, -300, 100)], "event_id long, role string, t_ms long, offset_ms long, gap_ms long")
    checks = spark.createDataFrame([(1, 10, 20.0, 50.0, 900.0, 1.0), (1, 20, 120.0, 50.0, 900.0, 1.0), (2, 30, 120.0, 3.0, 10.0, 1.0)], "event_id long, t_ms long, brightness double, std double, uniq double, cast double")
    got = {r.event_id: r for r in agent.records(events, frames, checks, spark.createDataFrame([(1, 8.0)], "event_id long, crest double")).collect()}
    assert [got[i].blocked for i in (1, 2, 3)] == [False, True, True] and got[3].visual_label_preset == v.BLOCKED and got[1].visual_label_preset is None
    assert [k.blocked for k in got[1].keyframes] == [True, False] and got[1].crest == 8.0 and got[2].crest is None
