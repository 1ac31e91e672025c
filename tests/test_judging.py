"""A judging run that is killed half-way and started again."""

import json

import pytest

from pavelake import vocab as v
from pavelake.operators import agent, judging

SHAPE = "event_id long, blocked boolean, text string, keyframes array<string>, usable int, spare array<string>, crest double"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, i % 10 == 0, f"event {i}", ["a"], 3, ["d"], 9.0) for i in range(60)]
    return spark.createDataFrame([*rows, rows[7]], SHAPE).repartition(3)


def asks(log, killed_at=None, silent=()):
    """A model that writes down whom it was asked about, fails for some, and at one of them takes the task with it."""

    def model_of(record):
        def model(request):
            if record["event_id"] == killed_at:
                raise SystemExit("lost executor")
            with open(log, "a") as f:
                f.write(f"{record['event_id']}\n")
            if record["event_id"] in silent:
                raise agent.Permanent("no")
            return json.dumps({"visual_label": v.POTHOLE, "confidence": "high", "why": "y"})

        return model

    return model_of


def test_killed_and_started_again(spark, records, tmp_path):
    log, out = tmp_path / "asked", str(tmp_path / "out")
    with pytest.raises(Exception, match="(?i)lost executor|crashed|exit"):
        judging.judge_into(records, asks(log, killed_at=31), out, buckets=4, flush=1).collect()
    first = log.read_text().split()
    assert len(first) < 54
    told = judging.judge_into(records, asks(log), out, buckets=4, flush=5).collect()
    asked = log.read_text().split()
    assert sorted(map(int, asked)) == [i for i in range(60) if i % 10]  # each event once, over both runs
    assert sum(r.calls for r in told) == len(asked) - len(first) and sum(r.judged + r.skipped for r in told) == 61
    got = {r.event_id: r for r in judging.reviews(spark, out).collect()}
    assert len(got) == 60 and all((got[i].final == "blocked") == (i % 10 == 0) for i in got)
    again = judging.judge_into(records, asks(log), out, buckets=4).collect()
    assert sum(r.calls for r in again) == 0 and sum(r.skipped for r in again) == 61


def test_undecided_ones_are_asked_again(spark, records, tmp_path):
    log, out = tmp_path / "asked", str(tmp_path / "out")
    judging.judge_into(records, asks(log, silent={3, 4}), out, buckets=4, wait=lambda s: None).collect()
    assert {r.event_id for r in judging.reviews(spark, out).filter("visual_label is null").collect()} == {3, 4}
    told = judging.judge_into(records, asks(log), out, buckets=4).collect()
    assert sum(r.judged for r in told) == 2
    assert judging.reviews(spark, out).filter("visual_label is null").count() == 0


def test_empty(spark, records, tmp_path):
    assert judging.judge_into(records.limit(0), asks(tmp_path / "l"), str(tmp_path / "out"), buckets=2).count() == 0
