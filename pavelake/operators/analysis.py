"""From raw samples to events, classes, clusters and the road-health index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import priority, rnd, rule_class
from . import spatial, spectral
from . import timeseries as ts
from .joins import interval_join

FS, WINDOW_S, FLOOR_S = 100.0, 0.64, 3.0
NAMES = ("peak", "rms", "kurtosis", "skew", "duration", "impulse", "zero_crossings", "energy_low", "energy_high", "asymmetry")
DIGITS = {"energy_low": 4, "energy_high": 4}


def on_grid(samples: DataFrame, fs: float = FS) -> DataFrame:
    """Axes interpolated, position and speed held, on each pack's uniform grid. samples: pack_id, event_id, t_ms, ax, ay, az, lat, lon, speed."""
    return ts.resample(samples, int(1000 / fs), ["ax", "ay", "az"], ("lat", "lon", "speed"))


def described(rows: DataFrame, keys: list[str], x: str, fs: float) -> DataFrame:
    """All window features: the moments, and the shares of spectral power of windows of at most 128 samples."""
    moments = ts.window_features(rows, keys, x, fs)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t_ms", "event_id", x))), lambda r: r[x])
    power = rows.groupBy(*keys).agg(ordered.alias("w")).select(*keys, spectral.band_energy(fs)("w").alias("e")).select(*keys, "e.*")
    return moments.join(power, keys).withColumns({c: F.when(F.col("peak").isNotNull(), F.col(c)) for c in ("energy_low", "energy_high")})


def detect_events(samples: DataFrame, fs: float = FS) -> DataFrame:
    """pack_id, id, t_ms, features, lat, lon, speed_ms, mag_peak, final_type of every event; samples as for on_grid."""
    grid = on_grid(samples, fs)
    ready = spectral.prepare(grid, fs)
    floored = ts.centered_quantile_floor(ready, max(8, int(FLOOR_S * fs)), x="bp_mag")
    kept = ts.merge_peaks(spectral.peaks(floored, fs)).select("pack_id", F.col("event_id").alias("at"), F.col("t_ms").alias("peak_ms"))
    half = int(WINDOW_S * fs / 2)
    around = interval_join(ready.select("pack_id", "event_id", "t_ms", "bp_vz", "bp_mag"), kept, ["pack_id"], "event_id", F.col("at") - half, F.col("at") + half, 4 * half)
    features = described(around, ["pack_id", "at"], "bp_vz", fs).filter("peak is not null")
    tops = around.groupBy("pack_id", "at").agg(F.max("bp_mag").alias("mag_peak"), F.first("peak_ms").alias("t_ms"))
    placed = grid.select("pack_id", "t_ms", "lat", "lon", F.col("speed").alias("speed_ms"))
    number = F.row_number().over(ts.Window.partitionBy("pack_id").orderBy("t_ms")) - 1
    found = features.join(tops, ["pack_id", "at"]).join(placed, ["pack_id", "t_ms"]).withColumn("id", number)
    rounded = [rnd(F.col(c), DIGITS.get(c, 3)).alias(c) for c in (*NAMES, "mag_peak")]
    return found.select("pack_id", "id", "t_ms", *rounded, "lat", "lon", "speed_ms").withColumn("final_type", rule_class(F.col("duration"), F.col("skew")))


def analyze(samples: DataFrame, fs: float = FS) -> DataFrame:
    """events with cluster, confirmations and priority. Clusters are found across packs; ids are unique by pack and id."""
    events = detect_events(samples, fs).withColumn("event", F.col("id")).withColumn("id", F.col("pack_id") * 1_000_000 + F.col("id"))
    clustered = spatial.cluster(events)
    return clustered.withColumn("priority", priority(F.col("final_type"), F.col("confirmations")))


def summary(events: DataFrame) -> DataFrame:
    """pack_id, events, clusters, track_km, health index and counts of types and priorities, one row per pack; events as from analyze."""
    km = spatial.track_km(events, ["pack_id"], ["t_ms", "id"])
    counts = lambda c: events.groupBy("pack_id", c).agg(F.count(F.lit(1)).alias("n")).groupBy("pack_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"{c}s"))
    agg = events.join(km, "pack_id", "left").groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("cluster").alias("clusters"), rnd(F.first("km"), 3).alias("track_km"),
        rnd(spatial.health_index(F.col("final_type"), F.col("confirmations"), F.coalesce(F.first("km"), F.lit(0.0))), 1).alias("road_health_index"),
    )
    return agg.join(counts("final_type"), "pack_id").join(counts("priority"), "pack_id")
