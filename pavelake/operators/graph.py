"""Connected components of an edge list, and the cut of lineage that such rounds need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="pavelake-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Narrow rows (a few numbers) that are worth a task of their own.
TASK_ROWS = 20_000


def fewer(rows: DataFrame, n: int) -> DataFrame:
    """`n` narrow rows in as many partitions as they fill, never more than there are: a shuffle leaves a file or more for each
    task before it, so rounds over a small table would leave far more bytes of files than of rows."""
    return rows.coalesce(max(1, -(-n // TASK_ROWS)))


def components(edges: DataFrame, most_rounds: int = 60, hot: int = 2000) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has an edge; edges: a, b.

    Alternating large-star and small-star steps until the edge set no longer changes. Each is a
    minimum per node and a join back to it. A star's centre may have a third of all edges: minima are summed map-side, and the
    join back broadcasts the minima of centres with more than 1/`hot` of the edges (fewer than 2 * `hot` rows), so no task
    gathers a centre's leaves. Lineage is cut in every round. Every step has as many tasks as its edges fill (there are never more
    of them than in the round before, and twice as many with both directions).
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        n, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == seen or not n:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        seen = (n, mark)
        e = fewer(e, n)
        limit = max(2 * n // hot, 1000)
        ends = e.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").count() if n > limit else None
        split = ends is not None and ends.agg(F.max("count")).first()[0] > limit
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        large = _with_least(e.union(e.select("v", "u")).toDF("u", "v"), limit, split)
        large = fewer(large.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v"), n).distinct()
        # small star: u and its smaller neighbours go to the smallest of them; there are no more of these than of neighbours before
        small = _with_least(fewer(large, n), limit, split)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(fewer(fewer(small, n).distinct(), n))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _with_least(pairs: DataFrame, limit: int, split: bool) -> DataFrame:
    """u, v, m: each pair with the least v of its u; centres above the limit are split where there are any."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    if not split:
        return pairs.join(least.select("u", "m"), "u")
    hot = least.filter(F.col("c") > limit).select("u", F.col("m").alias("__hot"))
    tagged = pairs.join(F.broadcast(hot), "u", "left")
    cold = tagged.filter("__hot is null").select("u", "v").join(least.filter(F.col("c") <= limit).select("u", "m"), "u")
    return cold.select("u", "v", "m").union(tagged.filter("__hot is not null").select("u", "v", F.col("__hot").alias("m")))
