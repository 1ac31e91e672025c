"""Totals of events over levels: each pack and type, each pack, all; or every combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facts(peak: str = "peak", duration: str = "duration") -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), F.max(peak).alias("max_peak"), F.avg(duration).alias("mean_duration")]


def rolled_up(events: DataFrame, keys: list[str], peak: str = "peak", duration: str = "duration") -> DataFrame:
    """keys, level (how many of the keys are summed over), events, max_peak, mean_duration: from the finest rows to the total.

    One partial aggregation feeds all levels. level tells a total from a key that is null.
    """
    out = events.rollup(*keys).agg(F.grouping_id().alias("g"), *facts(peak, duration))
    return out.withColumn("level", F.bit_count("g").cast("int")).drop("g")


def cubed(events: DataFrame, keys: list[str], peak: str = "peak", duration: str = "duration") -> DataFrame:
    """As rolled_up over every subset of the keys; over (array of strings) names the keys that are summed over."""
    out = events.cube(*keys).agg(F.grouping_id().alias("g"), *facts(peak, duration))
    over = [F.when(F.shiftright("g", len(keys) - 1 - i) % 2 == 1, k) for i, k in enumerate(keys)]
    return out.withColumn("over", F.array_compact(F.array(*over))).drop("g")
