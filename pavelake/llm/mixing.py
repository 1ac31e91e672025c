"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

A document's copies (at most `repeats`) queue up at its source in an order shuffled by a hash of
the document. A copy's virtual finish time is the source's cumulative words, this copy included,
divided by the source's target; all copies are range-sorted by finish time and served until the budget, the
words of the whole input, is used up.

No task holds a source: cumulative sums go over hash buckets of a source first (one row per source
and bucket), then inside a bucket. The range sort deals copies to tasks by sampled bounds of finish time; words are
summed by range and only the range in which the budget ends is ordered row by row. The first copy that no longer fits is
one row; every document then counts its own copies before it.

Defined results: null text and texts without words have size 0 and are taken 0 times; a null source
is a source of its own, last in order; identical rows are numbered, so each has its own place in the queue;
without any words all targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, packed, partitions_for, table

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
ROWS_PER_BUCKET = 50_000
ROWS_PER_RANGE = 1_000_000
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffling key of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _key(F.col("doc_id"), F.col("text")).alias("key"))


def _key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, place (in order of sources), target from source, source_size: one row per source.

    Water filling in closed form: by rising cap/weight a source is capped as long as the level
    that the rest would share lies above its own.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    t = sources.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("used", F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("rest", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    everyone = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce("used", F.lit(0))) / F.col("rest"))
    free = F.col("level") * F.col("weight") <= F.col("most")
    t = t.withColumn("final", F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everyone))
    level = F.coalesce(F.col("final.level"), F.lit(float("inf")))
    return t.select("source", "source_size", "place", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(level * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def queue(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, key, uid, place (the source's), source_size, target and through: the words of the
    row's source up to and with this row, in shuffled order. uid numbers the rows, identical ones too."""
    rows = cut(sized(docs).withColumn("uid", F.monotonically_increasing_id()))
    n = rows.count()
    hexes = next(h for h in range(2, 15) if 16**h * ROWS_PER_BUCKET >= 16 * n)
    bucketed = rows.withColumn("bucket", F.substring("key", 1, hexes))
    buckets = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bucketed.withColumn("upto", F.sum("size").over(inside)).alias("d").join(starts.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))).select("d.*", (F.col("start") + F.col("upto")).alias("through"))
    joined = placed.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return cut(joined.select("d.doc_id", "d.source", "d.size", "d.key", "d.uid", "d.through", "s.place", "s.source_size", "s.target"))


def turn(copy: Column) -> Column:
    """What a copy is served by: its finish time, then source, key and row."""
    finish = (copy * F.col("source_size") + F.col("through")) / F.col("target")
    return F.struct(finish.alias("finish"), F.col("place"), F.col("key"), F.col("uid"), copy.alias("copy"))


def first_left_out(queued: DataFrame, repeats: int = REPEATS) -> Column | None:
    """The turn of the first copy that no longer fits the budget, or null if all fit.

    Copies are range-sorted by turn over all tasks. Words are summed by range, so only the range in which
    the budget ends is looked at row by row; it holds about ROWS_PER_RANGE copies, however many there are.
    """
    facts = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"), F.count(F.lit(1)).alias("n")).first()
    ranges = max(partitions_for(queued), repeats * facts["n"] // ROWS_PER_RANGE + 1)
    copy = F.explode(F.array(*[F.lit(i).cast("long") for i in range(repeats)]))
    copies = queued.filter("size > 0").withColumn("copy", copy).select("size", turn(F.col("copy")).alias("turn"))
    ordered = copies.repartitionByRange(ranges, "turn").sortWithinPartitions("turn")
    ordered = cut(ordered.withColumn("range", F.spark_partition_id()))
    # one row for each range
    line = ordered.groupBy("range").agg(F.sum("size").alias("words")).withColumn("through", F.sum("words").over(Window.orderBy("range")))
    edge = line.filter(F.col("through") > facts["budget"]).orderBy("range").first()
    if edge is None:
        return None
    served = F.sum("size").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = ordered.filter(F.col("range") == edge["range"]).withColumn("served", served + edge["through"] - edge["words"])
    out = inside.filter(F.col("served") > facts["budget"]).orderBy("turn").first()["turn"]
    as_is = turn(F.lit(0).cast("long"))
    kinds = queued.select(as_is.alias("turn")).schema["turn"].dataType
    return F.struct(*[F.lit(out[f.name]).cast(f.dataType).alias(f.name) for f in kinds])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, key, source and uid for every row."""
    queued = queue(docs, weights, repeats)
    end = first_left_out(queued, repeats)
    fits = (lambda i: turn(F.lit(i).cast("long")) < end) if end is not None else (lambda i: F.lit(True))
    times = sum((fits(i).cast("int") for i in range(repeats)), F.lit(0))
    times = F.when(F.col("size") > 0, times).otherwise(0)
    return queued.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), "key", "source", "uid")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mixture itself: each document as often as it was taken, with all its columns.

    In a source's shuffled order all documents up to one are taken equally often, those after it
    once less. So a row a source says what to take, and no text is shuffled: up to BROADCAST_SOURCES sources these rows are
    broadcast. Of identical rows at that very place some are taken once more than others; they are counted,
    not placed. Columns must be of types that can be grouped (no maps).
    """
    taken = mix(docs, weights, repeats).filter("size > 0").withColumn("times", (F.col("taken") / F.col("size")).cast("int"))
    ends = taken.groupBy("source").agg(F.max(F.struct("times", "key")).alias("last"), F.min("times").alias("least"))
    ends = cut(ends.select(F.col("source").alias("of"), F.col("last.times").alias("most"), "least", F.col("last.key").alias("last")))
    ends = F.broadcast(ends) if ends.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else ends
    at = F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("last")) & (F.col("times") == F.col("most"))
    ties = cut(taken.join(ends, at).groupBy("of", "most", "least", "last").agg(F.count(F.lit(1)).alias("ties")))
    ties = F.broadcast(ties) if ties.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else ties
    d = packed(docs).filter(F.coalesce("d.text", F.lit("")).rlike(WORD)).withColumn("key", _key(F.col("d.doc_id"), F.col("d.text")))
    d = d.join(ties, F.col("d.source").eqNullSafe(F.col("of")))
    times = F.when(F.col("key") < F.col("last"), F.col("most")).otherwise(F.col("least"))
    plain = d.filter(F.col("key") != F.col("last")).select("d", times.cast("long").alias("times"))
    # rows of the last key: equal ones are one group with a count, and copies are dealt over the groups in order
    edge = d.filter(F.col("key") == F.col("last")).groupBy("d", "of", "key", "most", "least", "ties").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of", "key").orderBy(F.xxhash64("d"), "d").rowsBetween(Window.unboundedPreceding, -1)
    more = F.least(F.greatest(F.col("ties") - F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(0)), F.col("n"))
    edge = edge.select("d", (more * F.col("most") + (F.col("n") - more) * F.col("least")).alias("times"))
    both = plain.unionByName(edge).filter("times > 0")
    return both.select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select("d.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("key", "source", "uid")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS uid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
         coalesce(CAST(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS used,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s
), l AS (SELECT *, (budget - used) / rest AS level FROM r
), t AS (
  SELECT source, source_size, budget,
         least(weight * (SELECT arg_min(level, 3 * source_size / weight) FROM l WHERE level * weight <= 3 * source_size), CAST(3 * source_size AS DOUBLE)) AS target
  FROM l
), q AS (
  SELECT d.*, t.source_size, t.target, t.budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size, d.uid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, copy, (copy * source_size + through) / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0
), v AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, uid, copy ROWS UNBOUNDED PRECEDING) AS served FROM c
), k AS (SELECT uid, count(*) AS times FROM v WHERE served <= budget GROUP BY uid)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (uid)
"""
