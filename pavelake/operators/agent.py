"""Judging events with a model: evidence, prompts, calls with retries, and the bounded loop of checks and further evidence.

The model is any function from a request to text; it is handed in, and runs inside tasks, one event after the other in each of them, so
concurrency is the number of tasks at work. Nothing here opens a connection.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from .judge import frame_flags

# fixed values: bounds of the loop, waits in seconds after a failed call, actions
MOST_ROUNDS, MOST_CALLS, WAITS, PARSE_TRIES, LONGEST_WHY = 3, 8, (2, 4, 8), 2, 300
EVIDENCE = {"r1_post_wave": 1, "r2_more_frames": 3, "r3_two_frames": 2, "r4_more_evidence": 4}
CONFIDENCES = ("high", "mid", "low")


class Permanent(Exception):
    """What a model function raises when asking again is of no use (a wrong request, no permission)."""


def call(model: Callable[[dict], str], request: dict, wait: Callable[[float], None] = time.sleep) -> tuple[dict | None, str, int, str]:
    """answer, status (ok, net_failed, parse_failed), tries, error of one request.

    A schedule of waits is used up by calls that fail, whatever was answered between them; an answer that is no JSON object with a
    visual_label is asked for once more; a Permanent failure ends it.
    """
    waits, unread, problem = iter(WAITS), 0, ""
    for tries in itertools.count(1):
        try:
            answer = read_answer(model(request))
        except Permanent as e:
            return None, "net_failed", tries, told(e)
        except ValueError as e:
            unread, problem = unread + 1, told(e)
            if unread == PARSE_TRIES:
                return None, "parse_failed", tries, problem
        except Exception as e:  # noqa: BLE001
            pause = next(waits, None)
            if pause is None:
                return None, "net_failed", tries, told(e)
            wait(pause)
        else:
            return answer, "ok", tries, ""
    raise AssertionError


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def read_answer(text: str | None) -> dict:
    answer = json.loads(text or "")
    if not isinstance(answer, dict) or "visual_label" not in answer:
        raise ValueError("no visual_label")
    return answer


def accepted(answer: dict) -> dict:
    """What of an answer counts; raises ValueError if its label or confidence is not a known one."""
    label, confidence = str(answer.get("visual_label", "")).strip(), str(answer.get("confidence", "")).strip().lower()
    if label not in v.TRUTHS or confidence not in CONFIDENCES:
        raise ValueError(f"unknown {label!r} or {confidence!r}")
    return {"visual_label": label, "confidence": confidence, "why": str(answer.get("why", ""))[:LONGEST_WHY]}


def fired(record: dict, review: dict, usable: int, done: set[str]) -> list[tuple[str, str]]:
    """Rules that ask for more evidence or for a person, as (rule, action)."""
    out = []
    crest = record.get("crest")
    weak = crest is None or crest < v.MEDIUM
    if usable <= 1:
        out.append(("R2", "r2_escalate" if "r2_more_frames" in done else "r2_more_frames"))
    if review["visual_label"] in v.DEFECTS and weak and "r3_two_frames" not in done:
        out.append(("R3", "r3_two_frames"))
    if review["confidence"] == "low":
        out.append(("R4", "r4_escalate"))
    return out


def derived(record: dict, review: dict, usable: int, rules: set[str], escalated: bool) -> str:
    """The confidence that the evidence allows; what the model says of its own counts for nothing."""
    if escalated:
        return "low"
    if review["visual_label"] not in v.DEFECTS:
        return "high" if usable >= 2 else "mid" if usable == 1 else "low"
    crest = record.get("crest")
    if crest is not None and crest >= v.MEDIUM and usable >= 2:
        return "high"
    return "mid" if usable >= 2 and "R3" not in rules else "low"


def judge_event(record: dict, model: Callable[[dict], str], wait: Callable[[float], None] = time.sleep) -> dict:
    """The review and the trace of one event.

    record: event_id, blocked, text, keyframes, usable, spare (names of frames beyond the key frames), crest. Ends: blocked, converged,
    escalated, no_new_evidence, budget_exhausted, net_failed, parse_failed.
    """
    usable, spare = int(record.get("usable") or 0), list(record.get("spare") or ())
    out = {"event_id": record["event_id"], "visual_label": None, "confidence": None, "why": "", "source": "llm", "final": None, "rounds": 0, "calls": 0, "actions": [], "trace": []}
    if record.get("blocked"):
        return out | {"visual_label": v.BLOCKED, "confidence": "high", "source": "l0_blocked", "final": "blocked"}
    frames, text, done, extra, review, fires = list(record.get("keyframes") or ()), record["text"], set(), 0, None, []
    while out["final"] is None:
        answer, status, _, error = call(model, {"text": text, "frames": frames}, wait)
        out["calls"] += 1
        new = None
        if status == "ok":
            try:
                new = accepted(answer)
            except ValueError as e:
                status, error = "parse_failed", str(e)
        if new is None:
            out["trace"].append({"round": out["rounds"], "status": status, "label": None, "error": error})
            if out["calls"] >= MOST_CALLS:
                return out | {"source": status, "final": status}
            continue
        review = new
        out["trace"].append({"round": out["rounds"], "status": "ok", "label": review["visual_label"], "error": ""})
        fires = fired(record, review, usable, done)  # frames gathered later don't mend the lack of key frames
        if not fires:
            out["final"] = "converged"
        elif out["rounds"] >= MOST_ROUNDS or out["calls"] >= MOST_CALLS:
            out["final"] = "budget_exhausted"
        elif any(action.endswith("_escalate") for _, action in fires):
            out["final"] = "escalated"
        else:
            wanted = [action for _, action in fires if action not in done]
            done |= set(wanted)
            count = sum(EVIDENCE.get(action, 0) for action in wanted)
            got, spare = spare[:count], spare[count:]
            if not got:
                out["final"] = "no_new_evidence"
            else:
                out["rounds"] += 1
                extra += len(got)
                frames = frames + got
                text = f"{record['text']}\n\n上一轮判读：{review['visual_label']}（{review['confidence']}）。补充证据：{'、'.join(wanted)}，新增 {len(got)} 帧。请重新判读。"
    escalated = out["final"] == "escalated"
    confidence = derived(record, review, usable + extra, {rule for rule, _ in fires}, escalated)
    return out | review | {"confidence": confidence, "actions": sorted(done)}


REVIEW = "event_id long, visual_label string, confidence string, why string, source string, final string, rounds int, calls int, actions array<string>, trace array<struct<round:int,status:string,label:string,error:string>>"


def plain(record: dict) -> dict:
    """A row of a pandas frame with lists for arrays and None for what is missing."""
    return {k: x.tolist() if hasattr(x, "tolist") else None if isinstance(x, float) and x != x else x for k, x in record.items()}


def run(records: DataFrame, model: Callable[[dict], str], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Reviews of all records; a failed task judges its events anew, so results should be written through pending() of judge.py."""

    def each(batches):
        for pdf in batches:
            rows = [judge_event(plain(r), model, wait) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REVIEW.split(", ")])

    return records.mapInPandas(each, REVIEW)


def prompt(event_id: Column, offsets: dict[str, Column], block: Column) -> Column:
    """The request for three frames, with signed offsets to the impact."""
    signed = lambda role: F.format_string("%+dms", F.coalesce(offsets[role], F.lit(0)).cast("int"))
    return F.concat(
        F.format_string("事件 #%d。以下为车轮上方前视摄像头在同一事件的 3 帧画面\n", event_id), F.lit("（第 1 帧：冲击前 "), signed("pre"), F.lit("；第 2 帧：冲击即时 "), signed("impact"), F.lit("；第 3 帧：冲击后最近帧 "), signed("post_proxy"),
        F.lit("。\n负值表示该帧摄于冲击发生之前，缺陷本体通常位于画面中下部前方）。\n\n"), block, F.lit("\n\n请按系统提示的词表与规则输出 JSON 判读。"),
    )


def prompt_of_many(event_id: Column, offsets: Column, block: Column) -> Column:
    """The request for any number of frames in order of time."""
    listed = F.array_join(F.transform(F.array_sort(offsets), lambda o, i: F.format_string("第%d帧%+dms", i + 1, o.cast("int"))), "，")
    return F.concat(F.format_string("事件 #%d。以下为车轮上方前视摄像头在同一事件的 %d 帧连续画面\n（", event_id, F.size(offsets)), listed, F.lit("。负值表示该帧摄于冲击发生之前，缺陷本体通常位于画面中下部前方；\n帧与帧之间路面在画面中逐渐靠近/移出，可互相印证）。\n\n"), block, F.lit("\n\n请按系统提示的词表与规则输出 JSON 判读。"))


def records(events: DataFrame, keyframes: DataFrame, checks: DataFrame, features: DataFrame) -> DataFrame:
    """First-level records: an event with its key frames and their checks, its features, and whether all its frames are blocked.

    events: event_id; keyframes: event_id, role, t_ms, offset_ms, gap_ms; checks: event_id, t_ms, brightness, std, uniq, cast; features: event_id and
    more. An event without frames counts as blocked.
    """
    flags = frame_flags(F.col("brightness"), F.col("std"), F.col("uniq"), F.col("cast"))
    seen = keyframes.join(checks.select("event_id", "t_ms", "brightness", flags.alias("flags")), ["event_id", "t_ms"], "left")
    blocked = F.coalesce("flags.blocked", F.lit(True))
    per = seen.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("offset_ms", "role", "t_ms", "gap_ms", "brightness", blocked.alias("blocked")))).alias("keyframes"), F.bool_and(blocked).alias("blocked"),
    )
    out = events.select("event_id").join(per, "event_id", "left").join(features, "event_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(True)))
    return out.withColumn("visual_label_preset", F.when(F.col("blocked"), v.BLOCKED))
