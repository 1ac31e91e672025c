"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 phrases: each is the longest known phrase and one more character. The set of
phrases is hashed and kept as a minimum hash in each of `bins` parts of the hash space. The share of
bins that agree, among those that are not empty in both, estimates the Jaccard likeness of two phrase sets.

Documents are dealt by ranges of doc_id and sorted within, so that a document meets the next one
in its own task; each range's last document is paired with the next range's first in a small join. Which range a document
is in is computed from its own id and text by bounds drawn once from a sample, so both ways see the same ranges. The
edited text shares the parse of what it shares with the text.

Defined results: null counts as empty; two empty texts have likeness 1, an empty one and another 0;
null doc_ids come first in order, rows of equal doc_id are ordered by a hash of the text, then the text, so a hot id or no id
is dealt to many ranges; repeated rows follow one another; a very long text is parsed in whole; a single document is
its own next one; an empty table gives an empty result; columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, partitions_for, table

BINS = 128
SAMPLE = 10_000
PARTS_PER_TASK = 4
_EMPTY = np.iinfo(np.uint64).max
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def parse(text: str, known: dict[str, None], open_phrase: str = "") -> str:
    """Add the phrases of the text to `known`, in order; gives the phrase that is still open."""
    phrase = open_phrase
    for c in text:
        phrase += c
        if phrase not in known:
            known[phrase] = None
            phrase = ""
    return phrase


def phrase_hashes(text: str, lengths: list[int], skip: int) -> np.ndarray:
    """Hashes of the phrases after the first `skip`; phrases lie side by side from the text's beginning."""
    ends = np.cumsum(np.array(lengths, dtype=np.int64))
    if len(ends) <= skip:
        return np.zeros(0, np.uint64)
    base = int(ends[skip - 1]) if skip else 0
    points = np.frombuffer(text[base : int(ends[-1])].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(tokens.mix(points + np.uint64(1)) * tokens.powers(tokens._R, len(points)), out=sums[1:])
    z = ends[skip:] - base
    a = np.concatenate([[0], z[:-1]])
    return tokens.mix((sums[z] - sums[a]) * tokens.powers(tokens._R_INV, len(points) + 1)[a])


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    low = np.full(bins, _EMPTY, dtype=np.uint64)
    np.minimum.at(low, (hashes % np.uint64(bins)).astype(np.intp), hashes >> np.uint64(8))
    return low


def printed(low: np.ndarray) -> str:
    """Four hex digits a bin; ffff marks an empty one."""
    short = np.where(low == _EMPTY, 0xFFFF, np.minimum(tokens.mix(low) & np.uint64(0xFFFF), np.uint64(0xFFFE))).astype(">u2")
    return short.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != _EMPTY) | (b != _EMPTY)
    n = int(used.sum())
    return float(((a == b) & used).sum() / n) if n else 1.0


def fingerprints(text: str, following: str, bins: int):
    """Sketch of the text, sketch of its edited text, the edited text."""
    n = len(text)
    q = n // 4
    shared = text[: n - q]
    known: dict[str, None] = {}
    phrase = parse(shared, known)
    count, others = len(known), known.copy()
    low = sketch(phrase_hashes(shared, list(map(len, known)), 0), bins)
    parse(text[n - q :], known, phrase)
    own = np.minimum(low, sketch(phrase_hashes(text, list(map(len, known)), count), bins))
    edited = shared + following[:q]
    parse(following[:q], others, phrase)
    return own, np.minimum(low, sketch(phrase_hashes(edited, list(map(len, others)), count), bins)), edited


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def row_of(doc_id, text: str, own, other, edited: str, following) -> tuple:
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), printed(own), printed(other), likeness(own, other), likeness(own, following))


def neighbours(bins: int):
    """mapInArrow over sorted documents with their part: all of a part but the last with the next one, fingerprinted.

    A task may hold several parts, one after the other; no part is in two tasks.
    """

    def run(batches):
        part = before = None  # the document that waits for the next one
        waiting = None  # a row that waits for the next document's sketch
        out = []
        for batch in batches:
            for at, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text or ""
                if at != part and before is not None:
                    if waiting is not None:
                        out.append(row_of(*waiting, fingerprints(before[1], "", bins)[0]))
                    before = waiting = None
                part = at
                if before is not None:
                    made = fingerprints(before[1], text, bins)
                    if waiting is not None:
                        out.append(row_of(*waiting, made[0]))
                    waiting = (*before, *made)
                before = (doc_id, text)
                if len(out) >= 500:
                    yield batch_of(out)
                    out = []
        if waiting is not None:
            out.append(row_of(*waiting, fingerprints(before[1], "", bins)[0]))
        if out:
            yield batch_of(out)

    return run


def pairs(bins: int):
    """mapInArrow over doc_id, text, next text."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text, following = text or "", following or ""
                rows.append(row_of(doc_id, text, *fingerprints(text, following, bins), fingerprints(following, "", bins)[0]))
            if rows:
                yield batch_of(rows)

    return run


def part_of(at: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds lie at or below a place; looked up in rows of bounds, then in one row."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    values = ",".join(f"named_struct('id',{i}L,'mark',{m}L)" for i, m in bounds)
    rows = F.expr(f"transform(sequence(0, {(len(bounds) - 1) // width}), r -> slice(array({values}), r * {width} + 1, {width}))")
    row = F.greatest(F.size(F.filter(rows, lambda r: r[0] <= at)) - 1, F.lit(0))
    return row * width + F.size(F.filter(rows[row], lambda b: b <= at))


def with_next(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    at = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), mark.alias("mark"))
    # the order's bounds, once: about SAMPLE places. They only say where parts end, not what results are. There are more parts than
    # tasks, so that a task's share can be evened out by whole parts
    tasks = partitions_for(docs)
    share = SAMPLE / max(docs.count(), 1)
    places = sorted(tuple(r["at"]) for r in docs.select(at.alias("at")).filter(F.rand(7) < share).collect())
    parts = PARTS_PER_TASK * tasks
    bounds = sorted({places[len(places) * k // parts] for k in range(1, parts)}) if places else []
    order = ["part", F.col("doc_id").asc_nulls_first(), "mark", F.col("text").asc_nulls_first()]
    placed = docs.select("doc_id", "text", at.alias("at")).select(part_of(F.col("at"), bounds).alias("part"), "doc_id", "text", F.col("at.mark").alias("mark"))
    sorted_ = placed.repartitionByRange(tasks, "part").sortWithinPartitions(*order)
    within = sorted_.select("part", "doc_id", "text").mapInArrow(neighbours(bins), SCHEMA)
    # the first and the last document of each part: found on ids and marks, then their texts looked up; no text is dealt out
    narrow = F.struct(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    keyed = placed.withColumn("key", narrow)
    keys = keyed.groupBy("part").agg(F.min("key").alias("a"), F.max("key").alias("z"))
    keys = keys.select("part", F.explode(F.array(F.struct(F.lit(True).alias("begins"), F.col("a").alias("key")), F.struct(F.lit(False).alias("begins"), F.col("z").alias("key")))).alias("e")).select("part", "e.*")
    full = F.struct("key.*", F.col("text").isNotNull().alias("has"), F.coalesce("text", F.lit("")).alias("text"))
    found = keyed.join(F.broadcast(keys), ["part", "key"]).withColumn("full", full).groupBy("part").agg(F.min(F.when(F.col("begins"), F.col("full"))).alias("first"), F.max(F.when(~F.col("begins"), F.col("full"))).alias("last"))
    ends = cut(found)
    # one row for each part
    by = Window.orderBy("part")
    follow = ends.select("part").withColumn("following", F.coalesce(F.lead("part").over(by), F.min("part").over(Window.partitionBy())))
    last = ends.select("part", "last").join(follow, "part").join(ends.select(F.col("part").alias("following"), "first"), "following")
    last = last.select(F.when(F.col("last.there"), F.col("last.id")).alias("doc_id"), F.col("last.text").alias("text"), F.col("first.text").alias("next"))
    return within.unionByName(last.mapInArrow(pairs(bins), SCHEMA))


def op4_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
