"""Joins the domain needs beyond equality: intervals, nearest in time, merges with a tolerance."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, begin: Column, end: Column, bucket_ms: int, how: str = "inner") -> DataFrame:
    """Points within [begin, end] of spans with equal keys: an equality join on time buckets.

    Columns of the two sides must differ but for the keys. For how="left" all spans stay, those with nulls and repeated ones too.
    """
    if how == "left":
        spans = cut(spans.withColumn("__span", F.monotonically_increasing_id()))
    dealt = spans.withColumn("__b", begin).withColumn("__e", end)
    dealt = dealt.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__b") / bucket_ms), F.floor(F.greatest("__b", "__e") / bucket_ms))))
    placed = points.withColumn("__bucket", F.floor(F.col(t) / bucket_ms))
    inside = (F.col(t) >= F.col("__b")) & (F.col(t) <= F.col("__e"))
    hits = dealt.join(placed, [*keys, "__bucket"]).filter(inside).drop("__bucket", "__b", "__e")
    if how == "inner":
        return hits
    alone = spans.join(hits.select("__span").distinct(), "__span", "left_anti")
    return hits.unionByName(alone, allowMissingColumns=True).drop("__span")


def align_greedy(imu: DataFrame, vision: DataFrame, tolerance_ms: int) -> DataFrame:
    """pack_id, vision_id, imu_id: vision events in id order each take the nearest free IMU event, the one of the smaller id of equals.

    Where neither list has an event for more than the tolerance no match reaches across, so a pack falls into islands that are
    aligned each by itself: those with one event of either kind by an expression, the others one group at a time. Columns pack_id, id, t_ms.
    """
    side = lambda df, kind: df.filter("t_ms is not null").select(F.col("pack_id").cast("long").alias("pack_id"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "t_ms")
    both = side(imu, "imu").unionByName(side(vision, "vision"))
    order = Window.partitionBy("pack_id").orderBy("t_ms", "kind", "id")
    new = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(order) > tolerance_ms, F.lit(True)).cast("long")
    placed = both.withColumn("island", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    island = Window.partitionBy("pack_id", "island")
    counted = placed.withColumns({k: F.count_if(F.col("kind") == k).over(island) for k in ("imu", "vision")}).filter("imu > 0 and vision > 0")
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("id", "t_ms")))
    pairs = counted.filter("imu = 1 and vision = 1").groupBy("pack_id", "island").agg(one("vision").alias("v"), one("imu").alias("i"))
    pairs = pairs.filter(F.abs(F.col("v.t_ms") - F.col("i.t_ms")) <= tolerance_ms).select("pack_id", F.col("v.id").alias("vision_id"), F.col("i.id").alias("imu_id"))

    def match(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seen, free = pdf[pdf["kind"] == "vision"].sort_values("id"), FreeTimes(*pdf.loc[pdf["kind"] == "imu", ["t_ms", "id"]].to_numpy().T.tolist())
        out = [(key[0], vid, got) for vid, t in zip(seen["id"].tolist(), seen["t_ms"].tolist()) if (got := free.take(t, tolerance_ms)) is not None]
        return pd.DataFrame(out, columns=["pack_id", "vision_id", "imu_id"])

    many = counted.filter("imu > 1 or vision > 1").select("pack_id", "island", "kind", "id", "t_ms")
    return pairs.unionByName(many.groupBy("pack_id", "island").applyInPandas(match, "pack_id long, vision_id long, imu_id long"))


class FreeTimes:
    """Events in order of time of which the nearest free one is taken; those taken are skipped by pointers that are shortened as they are followed."""

    def __init__(self, times: list, ids: list):
        rows = sorted(zip(times, ids))
        self.times, self.ids = [t for t, _ in rows], [i for _, i in rows]
        self.up = list(range(len(rows) + 1))  # the first free place at or after each
        self.down = list(range(len(rows) + 1))  # one more than the last free place before each

    @staticmethod
    def follow(pointers: list[int], at: int) -> int:
        end = at
        while pointers[end] != end:
            end = pointers[end]
        while pointers[at] != end:
            pointers[at], at = end, pointers[at]
        return end

    def take(self, t: float, most: float) -> int | None:
        at = bisect_left(self.times, t)
        right, left = self.follow(self.up, at), self.follow(self.down, at) - 1
        near = [right] if right < len(self.ids) else []
        if left >= 0:  # of one time the smallest id
            near.append(self.follow(self.up, bisect_left(self.times, self.times[left])))
        best = min(near, key=lambda k: (abs(self.times[k] - t), self.ids[k]), default=None)
        if best is None or abs(self.times[best] - t) > most:
            return None
        self.up[best], self.down[best + 1] = best + 1, best
        return self.ids[best]


def mutual_nearest(left: DataFrame, right: DataFrame, tolerance_ms: int) -> DataFrame:
    """pack_id, left_id, right_id, gap: pairs that are each other's nearest within the tolerance.

    An event is an id at a time: repeated rows count once, and of equally near events the smaller id, then the earlier one is nearest.
    """
    a = left.select("pack_id", F.col("id").alias("left_id"), F.col("t_ms").alias("left_t")).distinct()
    b = right.select("pack_id", F.col("id").alias("right_id"), F.col("t_ms").alias("right_t")).distinct()
    near = interval_join(b, a, ["pack_id"], "right_t", F.col("left_t") - tolerance_ms, F.col("left_t") + tolerance_ms, max(tolerance_ms, 1))
    near = near.withColumn("gap", F.abs(F.col("left_t") - F.col("right_t")))
    by_left = F.row_number().over(Window.partitionBy("pack_id", "left_id", "left_t").orderBy("gap", "right_id", "right_t"))
    by_right = F.row_number().over(Window.partitionBy("pack_id", "right_id", "right_t").orderBy("gap", "left_id", "left_t"))
    return near.withColumn("a", by_left).withColumn("b", by_right).filter("a = 1 and b = 1").select("pack_id", "left_id", "right_id", "gap")


def tolerant_merge(real: DataFrame, replayed: DataFrame, tolerance_ms: int = 3) -> DataFrame:
    """pack_id, matched, unmatched: two sorted lists walked together, as of two recordings of one event list."""

    def walk(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = sorted(a["t_ms"]), sorted(b["t_ms"])
        i = j = matched = 0
        lost = 0
        while i < len(x):
            if j < len(y) and abs(x[i] - y[j]) <= tolerance_ms:
                matched, i, j = matched + 1, i + 1, j + 1
            elif j < len(y) and y[j] < x[i]:
                j += 1
            else:
                lost, i = lost + 1, i + 1
        return pd.DataFrame([(key[0], matched, lost)], columns=["pack_id", "matched", "unmatched"])

    return real.select("pack_id", "t_ms").groupBy("pack_id").cogroup(replayed.select("pack_id", "t_ms").groupBy("pack_id")).applyInPandas(walk, "pack_id long, matched long, unmatched long")


def sweep_findings(frames: DataFrame, sweeps: DataFrame, rank: Column, least: int = 2) -> DataFrame:
    """Records of findings that only sweep frames show: id -1, -2, ... in file order within a pack, position and speed by time.

    frames: pack_id, file, t_ms, label, conf, why; sweeps: pack_id, t_ms, lat, lon, speed_kmh, of which the last of a time counts.
    """
    only = frames.filter(rank >= least).withColumn("id", -F.row_number().over(Window.partitionBy("pack_id").orderBy("file")))
    meta = sweeps.groupBy("pack_id", "t_ms").agg(F.max(F.struct("row", "lat", "lon", "speed_kmh")).alias("m")).select("pack_id", "t_ms", "m.lat", "m.lon", "m.speed_kmh")
    made = only.join(meta, ["pack_id", "t_ms"], "left")
    return made.select("pack_id", "id", F.lit("sweep").alias("source"), "t_ms", "lat", "lon", "speed_kmh", F.col("label").alias("vision_label"), F.round("conf", 3).alias("vision_conf"), F.col("why").alias("vision_why"), F.lit(1).alias("vision_frames"), F.col("file").alias("vision_driver_frame"), F.array("label").alias("vision_all_labels"))


def in_segment(events: DataFrame, segments: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """events with segment: by their own segment_id where that is a number, else the first segment that holds their time.

    events: pack_id, id, t_ms, segment_id (text); segments: pack_id, segment_id (number), t_start_ms, t_end_ms.
    """
    named = F.col("segment_id").try_cast("bigint")
    known = events.filter(named.isNotNull()).withColumn("segment", named)
    open_ = events.filter(named.isNull())
    spans = segments.select("pack_id", F.col("segment_id").alias("number"), F.col("t_start_ms").alias("from_ms"), F.col("t_end_ms").alias("to_ms"))
    found = interval_join(open_.select("pack_id", "id", "t_ms"), spans, ["pack_id"], "t_ms", F.col("from_ms"), F.col("to_ms"), bucket_ms).groupBy("pack_id", "id").agg(F.min("number").alias("segment"))
    return known.unionByName(open_.join(found, ["pack_id", "id"], "left"))
