"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per task and then merged, name at most `counters` digests that may be
frequent; every digest with more than rows/counters copies is among them. A second pass counts
those candidates exactly (map-side partial sums, so a hot digest never meets in one task) and the
verified winners, at most `counters` rows whatever the input, are broadcast: hot groups are
resolved map-side. Only the remaining digests, each of a bounded share of the rows, are shuffled.

Defined results: null text counts as empty; an empty table gives an empty result; of rows that
also share the doc_id one stays; a null doc_id is the smallest; a very long text is hashed in whole. Other columns, whatever their
names, are left alone.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, packed, small, table

COUNTERS = 1024


def shrink(counts: Counter, counters: int) -> Counter:
    """Keep at most `counters` entries: subtract the largest count that must go (Misra-Gries)."""
    if len(counts) <= counters:
        return counts
    floor = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - floor for k, v in counts.items() if v > floor})


def summary(counters: int):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                counts[x["values"]] += x["counts"]
            counts = shrink(counts, counters)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["digest", "weight"])

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, uid: one narrow row per document. uid tells repeated rows apart."""
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(norm, 256).alias("digest")).withColumn("uid", F.monotonically_increasing_id())


def winners(rows: DataFrame, counters: int) -> DataFrame:
    """Verified heavy digests with their group's size and the row that stays: `counters` rows at most."""
    heads = rows.select("digest").mapInArrow(summary(counters), "digest string, weight long")
    likely = heads.groupBy("digest").agg(F.sum("weight").alias("weight")).filter("weight > 1").orderBy(F.desc("weight"), "digest").limit(counters).select("digest")
    exact = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    stays = rows.join(F.broadcast(exact), "digest").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("uid").alias("keep_uid"))
    return exact.join(F.broadcast(stays), "digest")


def groups(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = cut(digests(docs, id_col, text_col))
    heavy = cut(winners(rows, counters))
    tagged = rows.join(F.broadcast(heavy), "digest", "left")
    hot = tagged.filter("keep_uid is not null").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("digest").alias("text_sha256"))
    by = Window.partitionBy("digest")
    cold = tagged.filter("keep_uid is null").select("doc_id", "digest", "uid")
    cold = cold.select(
        "doc_id",
        F.max("doc_id").over(by).alias("keep_id"),
        F.count(F.lit(1)).over(by).alias("group_size"),
        (F.row_number().over(by.orderBy(F.col("doc_id").desc_nulls_last(), F.desc("uid"))) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return hot.unionByName(cold)


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in text and doc_id one.

    What stays of a group is decided on narrow rows. Losers of heavy groups go map-side; the remaining groups of
    more than one are joined back on their digest, which moves texts only where those groups are too many to be broadcast.
    """
    rows = cut(digests(docs))
    heavy = cut(winners(rows, counters).select("digest"))

    def stays(some: DataFrame) -> DataFrame:
        by_id = some.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("c"))
        agg = by_id.groupBy("digest").agg(F.max(F.struct("doc_id", "c")).alias("m"), F.sum("c").alias("n")).filter("n > 1")
        return cut(agg.select("digest", F.struct(F.col("m.doc_id").alias("id"), F.col("m.c").alias("c")).alias("keep")))

    d = packed(docs).withColumn("digest", F.sha2(lower_ascii(F.coalesce("d.text", F.lit(""))), 256))
    hot, cold = stays(rows.join(F.broadcast(heavy), "digest")), stays(rows.join(F.broadcast(heavy), "digest", "left_anti"))
    lives = F.col("keep").isNull() | F.col("d.doc_id").eqNullSafe(F.col("keep.id"))
    d = d.join(F.broadcast(hot), "digest", "left").filter(lives).withColumnRenamed("keep", "first")
    d = d.join(small(cold), "digest", "left").filter(lives).select("d", "digest", F.coalesce("first.c", "keep.c", F.lit(1)).alias("c"))
    if hot.unionByName(cold).filter("keep.c > 1").isEmpty():
        return d.select("d.*")
    one = F.row_number().over(Window.partitionBy("digest").orderBy(F.lit(1)))
    ties = d.filter("c > 1").withColumn("n", one).filter("n = 1")
    return d.filter("c = 1").select("d.*").union(ties.select("d.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
