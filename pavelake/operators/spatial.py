"""Positions: neighbours by grid cells, clusters as connected components, roll-ups, the health index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import haversine_m, lookup, plane_m, priority, rnd, severity
from .graph import components


def cells(df: DataFrame, metres: float, max_latitude: float = 60.0) -> DataFrame:
    """Adds cx, cy: cells at least `metres` wide up to max_latitude, so neighbours lie in adjacent cells."""
    lon = metres / (v.LON_M * math.cos(math.radians(max_latitude)))
    return df.withColumn("cx", F.floor(F.col("lon") / lon)).withColumn("cy", F.floor(F.col("lat") / (metres / v.LAT_M)))


def around(df: DataFrame) -> DataFrame:
    """Each row once for its own and every adjacent cell."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return df.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")


def neighbours(points: DataFrame, metres: float) -> DataFrame:
    """a, b: ids of points within `metres` of each other, a < b. An equality join on grid cells.

    Points at one place are one node for this, so a spot visited often sends one row.
    """
    p = cells(points.select("id", "lat", "lon").filter("lat is not null and lon is not null"), metres)
    left = p.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "cx", "cy")
    right = around(p).select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "cx", "cy")
    near = plane_m(F.col("lat_a") - F.col("lat_b"), F.col("lon_a") - F.col("lon_b"), (F.col("lat_a") + F.col("lat_b")) / 2) <= metres
    return left.join(right, ["cx", "cy"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")


def cluster(points: DataFrame, metres: float = v.CLUSTER_M) -> DataFrame:
    """points with cluster (its smallest id) and confirmations; points without position have neither.

    Points are first merged by exact position, so repeated passes over a spot don't multiply pairs.
    """
    spots = points.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("id").alias("id"))
    found = components(neighbours(spots, metres))
    named = spots.join(found.withColumnRenamed("node", "id"), "id", "left").select("lat", "lon", F.coalesce("root", "id").alias("cluster"))
    placed = points.join(named, ["lat", "lon"], "left")
    sizes = placed.filter("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("confirmations"))
    return placed.join(sizes, "cluster", "left")


def rollup(clustered: DataFrame, digits: tuple[int, int] = (7, 3)) -> DataFrame:
    """One row per cluster, positions and sizes rounded to so many digits: centre, count, strongest peak, mean duration, majority type (first seen wins ties)."""
    located = clustered.filter("cluster is not null")
    kinds = located.groupBy("cluster", "final_type").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    vote = kinds.groupBy("cluster").agg(F.max_by("final_type", F.struct(F.col("c"), -F.col("first"))).alias("final_type"))
    facts = located.groupBy("cluster").agg(rnd(F.avg("lon"), digits[0]).alias("lon"), rnd(F.avg("lat"), digits[0]).alias("lat"), F.count(F.lit(1)).alias("confirmations"), rnd(F.max("peak"), digits[1]).alias("peak"), rnd(F.avg("duration"), digits[1]).alias("duration"))
    return facts.join(vote, "cluster")


def track_km(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Length of the polyline through the points of each key, on the plane at their mean latitude."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(*order)
    step = plane_m(F.col("lat") - F.lag("lat").over(o), F.col("lon") - F.lag("lon").over(o), F.avg("lat").over(w))
    return points.filter("lat is not null and lon is not null").withColumn("m", step).groupBy(*keys).agg((F.coalesce(F.sum("m"), F.lit(0.0)) / 1000).alias("km"))


def health_index(kind: Column, confirmations: Column, km: Column) -> Column:
    """100 without defects, falling with their weighted density; an aggregate expression."""
    weight = severity(kind) * (1 + F.log(F.greatest(confirmations, F.lit(1)).cast("double")))
    density = F.coalesce(F.sum(weight), F.lit(0.0)) / F.greatest(km, F.lit(v.LEAST_KM))
    return 100 * F.exp(-density / v.HEALTH_K)


def distance_m(samples: DataFrame, most_gap_ms: int = 5000, meta: DataFrame | None = None) -> DataFrame:
    """Trapezoid distance per pack from speed; invalid steps and long gaps count nothing. Where no step counts, what `meta` (pack_id, distance_m) says."""
    w = Window.partitionBy("pack_id").orderBy("t_ms", "event_id")
    dt = F.col("t_ms") - F.lag("t_ms").over(w)
    metres = F.when((dt > 0) & (dt <= most_gap_ms), (F.col("speed") + F.lag("speed").over(w)) / 2 * dt / 1000)
    known = samples.withColumn("m", metres).groupBy("pack_id").agg(F.sum("m").alias("m"))
    if meta is None:
        return known.select("pack_id", F.coalesce("m", F.lit(0.0)).alias("metres"))
    return known.join(meta.select("pack_id", "distance_m"), "pack_id", "left").select("pack_id", F.coalesce("m", "distance_m", F.lit(0.0)).alias("metres"))


def features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """id, feature: a GeoJSON Feature a row, which suits maps of any size (one feature a line)."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    located = rows.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return located.select("id", F.to_json(feature).alias("feature"))


def feature_collection(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON string: points with properties, ordered by id; for maps of bounded size."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "feature"))), lambda x: x["feature"]), ",")
    return features(rows, properties).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


def cluster_features(clustered: DataFrame, digits: tuple[int, int, int] = (7, 2, 3)) -> DataFrame:
    """Rows for a map of clusters: no single observation, only what they amount to. Digits of position, peak and duration."""
    r = rollup(clustered, (digits[0], 12))
    kind = F.coalesce("final_type", F.lit(v.OTHER))
    base = lookup(kind, v.SCORE, 70)
    return r.select(F.col("cluster").alias("id"), "lon", "lat", "cluster", kind.alias("kind"), "confirmations", F.round("peak", digits[1]).alias("max_peak"), F.round("duration", digits[2]).alias("mean_duration"), base.alias("severity_score"), priority(kind, F.col("confirmations")).alias("maintenance_priority"))


def first_within(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
    """id, target: the first target (by id) within `metres`; great-circle distance, cell join.

    Both sides are merged by exact position first, so repeated passes over a spot don't multiply pairs.
    """
    first = targets.groupBy("lat", "lon").agg(F.min("id").alias("target"))
    t = cells(first, metres).select("target", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), "cx", "cy")
    spots = points.filter("lat is not null and lon is not null").select("lat", "lon").distinct()
    near = haversine_m(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")) <= metres
    found = around(cells(spots, metres)).join(t, ["cx", "cy"]).filter(near).groupBy("lat", "lon").agg(F.min("target").alias("target"))
    return points.select("id", "lat", "lon").join(found, ["lat", "lon"]).groupBy("id").agg(F.min("target").alias("target"))
