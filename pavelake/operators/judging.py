"""Judging that can be stopped and started again: reviews are appended as they are made, and nobody is asked twice.

Events are dealt to buckets by a hash of their id; a bucket is judged by one task, which first reads what earlier runs, or earlier tries of itself, have
written for it, and leaves out the events that are decided there. Reviews go to new files of `flush` events, each put in place whole,
so a task that is lost loses the calls since its last file at most. Events that failed (no answer, none that can be read) are written too, but
asked again by the next run. Two copies of a task at work at once (speculation) may both ask for an event; of its reviews one counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.packs import place
from .agent import REVIEW, judge_event, plain

COUNTS = "bucket long, judged long, skipped long, calls long"


def decisive(review: dict) -> bool:
    return review.get("visual_label") is not None or review.get("source") == "l0_blocked"


def decided(path: str, bucket: int) -> set[int]:
    """Events of a bucket that some run has decided."""
    system, folder = place(f"{path}/bucket-{bucket:06d}")
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out = set()
    for f in found:
        if f.path.endswith(".json"):
            with system.open_input_stream(f.path) as s:
                out |= {r["event_id"] for r in map(json.loads, s.read().decode().splitlines()) if decisive(r)}
    return out


def append(path: str, bucket: int, reviews: list[dict]) -> None:
    system, folder = place(f"{path}/bucket-{bucket:06d}")
    system.create_dir(folder, recursive=True)
    name = f"{folder}/{uuid.uuid4().hex}"
    with system.open_output_stream(f"{name}.part") as out:
        out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in reviews).encode())
    system.move(f"{name}.part", f"{name}.json")


def judge_into(records: DataFrame, model_of: Callable[[dict], Callable[[dict], str]], path: str, buckets: int = 256, flush: int = 32, wait: Callable[[float], None] | None = None) -> DataFrame:
    """bucket, judged, skipped, calls of this run; the reviews are in the folder `path` (see reviews()).

    records: as for agent.judge_event; model_of gives the model for a record. The number of buckets must stay the same from run to run.
    """
    more = {"wait": wait} if wait else {}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, known, held, count = None, set(), [], None

        def done() -> list[tuple]:
            if held:
                append(path, bucket, held)
                held.clear()
            return [(bucket, *count)] if count else []

        out: list[tuple] = []
        for pdf in batches:
            for record in map(plain, pdf.to_dict("records")):
                if record["__bucket"] != bucket:
                    out += done()
                    bucket = record["__bucket"]
                    known, count = decided(path, bucket), [0, 0, 0]
                if record["event_id"] in known:
                    count[1] += 1
                    continue
                review = judge_event(record, model_of(record), **more)
                known.add(record["event_id"])  # a repeated row is not asked for again in this run
                held.append(review)
                count[0], count[2] = count[0] + 1, count[2] + review["calls"]
                if len(held) >= flush:
                    append(path, bucket, held)
                    held.clear()
        yield pd.DataFrame(out + done(), columns=["bucket", "judged", "skipped", "calls"])

    dealt = records.withColumn("__bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)))
    return dealt.repartition(buckets, "__bucket").sortWithinPartitions("__bucket", "event_id").mapInPandas(each, COUNTS)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """One review of each event: a decisive one if there is any."""
    found = spark.read.schema(REVIEW).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).withColumn("file", F.input_file_name())
    best = Window.partitionBy("event_id").orderBy((F.col("visual_label").isNotNull() | (F.col("source") == "l0_blocked")).desc(), F.desc("file"))
    return found.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "file")
