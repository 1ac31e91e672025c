"""Helpers that the corpus operators share: reading tables, cutting lineage, column checks."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct d, so that no name of theirs meets one of ours; select("d.*") gives them back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("d"))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def released(run: Callable, after: Callable | None = None) -> Callable:
    """A task function that gives freed memory back to the system when it is done; workers live on, for other stages."""

    def task(batches):
        yield from run(batches)
        if after:
            after()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return task


def row_mark(prefix: str = "") -> Column:
    """128 bits of doc_id and text, by which a row is found again."""
    i, t = F.col(f"{prefix}doc_id"), F.col(f"{prefix}text")
    return F.struct(F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that where every byte is ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def partitions_for(df: DataFrame, least: int = 8) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


HEAVY = 2000
FEW = 200_000


def small(rows: DataFrame) -> DataFrame:
    """The rows with a broadcast hint if there are at most FEW of them (narrow rows, some 20 MB); counted first, so rows should be
    cheap to read again. Results are the same either way."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join rows with a table of distinct keys that carries each key's number of rows, hot keys split.

    Keys with more than 1/HEAVY of all rows are fewer than HEAVY, so they can be broadcast to the rows;
    there each such key is split into parts of about that share, and its row in `counted` is repeated for each
    part. `counted` should be cheap to read again; its column `count` is dropped.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    limit = max(total // HEAVY, 1000)
    parts = F.when(F.col(count) > limit, F.ceil(F.col(count) / limit)).otherwise(1).cast("int")
    heavy = counted.filter(F.col(count) > limit).select(*keys, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("__part", F.coalesce(F.pmod(spread, F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    other = counted.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(other, [*keys, "__part"], how).drop("__part")
