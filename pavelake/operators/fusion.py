"""Fusion of IMU events and vision records by the decision table R0 to R15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import crack_kind
from .spatial import first_within


def decide(imu: Column, vision: Column, conf: Column, why: Column) -> Column:
    """struct(final, conf, rule) for a vision record with or without an IMU label (rules R1 to R13)."""
    vl = crack_kind(vision, why)
    vc = F.coalesce(conf, F.lit(0.5))
    impulse = imu.isin(*v.IMPULSES)
    crack = vl.isin(*v.CRACKS)

    def to(final, score, rule):
        score = score if isinstance(score, Column) else F.lit(float(score))
        final = final if isinstance(final, Column) else F.lit(final)
        return F.struct(final.alias("final"), score.alias("conf"), F.lit(rule).alias("rule"))

    upto = lambda most, base, slope: F.least(F.lit(most), base + slope * vc)
    alone = (
        F.when(crack, to(vl, upto(0.85, 0.55, 0.3), "R1"))
        .when(vl == v.ROUGH, to(v.ROUGH, upto(0.75, 0.45, 0.3), "R2"))
        .when(vl == v.POTHOLE, to(v.SHALLOW, 0.40, "R3"))
        .when(vl == v.MANHOLE, to(v.MANHOLE, 0.35, "R3"))
        .otherwise(to(v.FLAT, upto(0.9, 0.5, 0.4), "R4"))
    )
    both = (
        F.when((vl == v.FLAT) & impulse, to(v.BUMP_OR_MANHOLE, 0.70, "R5"))
        .when(vl == v.FLAT, to(imu, 0.65, "R6"))
        .when((vl == v.POTHOLE) & impulse, to(v.POTHOLE, 0.95, "R7"))
        .when(vl == v.POTHOLE, to("粗糙路面破损", 0.60, "R8"))
        .when(crack & impulse, to(F.concat(vl, F.lit("(含局部沉降)")), 0.65, "R9"))
        .when(crack, to(vl, 0.75, "R10"))
        .when(vl == v.ROUGH, to(v.ROUGH, 0.85, "R11"))
        .when(vl == v.MANHOLE, to(v.MANHOLE, 0.80, "R12"))
        .otherwise(to(imu, 0.55, "R13"))
    )
    return F.when(imu.isNull(), alone).otherwise(both)


def merge(imu: DataFrame, vision: DataFrame, dedup_m: float = v.DEDUP_M) -> DataFrame:
    """All ids of both sides with final, conf, rule, merged_into, source.

    imu: id, label, lat, lon, peak; vision: id, vision_label, vision_conf, vision_why, lat, lon.
    """
    i = imu.select("id", F.nullif("label", F.lit("")).alias("imu"), F.coalesce(F.col("label").isin(*v.NOISE), F.lit(False)).alias("noise"), F.col("lat").alias("ilat"), F.col("lon").alias("ilon"), F.lit(True).alias("has_imu"))
    w = vision.select("id", F.nullif("vision_label", F.lit("")).alias("vision"), "vision_conf", "vision_why", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    lone = w.join(i.select("id"), "id", "left_anti").filter("vlat is not null and vlon is not null")
    near = first_within(lone.select("id", F.col("vlat").alias("lat"), F.col("vlon").alias("lon")), i.filter("not noise and ilat is not null").select("id", F.col("ilat").alias("lat"), F.col("ilon").alias("lon")), dedup_m)
    both = i.join(w, "id", "full").join(near, "id", "left")
    made = lambda final, conf, rule: F.struct(final.alias("final"), F.lit(conf).alias("conf"), F.lit(rule).alias("rule"))
    out = (
        F.when(F.col("has_imu") & F.col("noise"), made(F.lit(v.FALSE_ALARM), 0.9, "R0"))
        .when(F.col("target").isNotNull(), made(F.lit(v.REPEATED), 0.0, "R15"))
        .when(F.col("vision").isNull(), made(F.coalesce("imu", F.lit(v.UNKNOWN)), 0.5, "R14"))
        .otherwise(decide(F.col("imu"), F.col("vision"), F.col("vision_conf"), F.col("vision_why")))
    )
    return both.withColumn("o", out).select("id", "o.final", F.round("o.conf", 3).alias("conf"), "o.rule", "imu", "vision", F.when(F.col("o.rule") == "R15", F.col("target")).alias("merged_into"), F.when(F.col("has_imu"), "event").otherwise("sweep").alias("source"), F.coalesce("ilat", "vlat").alias("lat"), F.coalesce("ilon", "vlon").alias("lon"))


def summary(fused: DataFrame) -> DataFrame:
    return fused.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("source") == "event").alias("imu_events"),
        F.count_if(F.col("source") == "sweep").alias("sweeps"),
        F.count_if(F.col("rule") == "R15").alias("deduped"),
        F.count_if(F.col("imu").isNull() & ~F.col("rule").isin("R15", "R0")).alias("vision_only"),
        F.count_if(F.col("rule") == "R7").alias("dual"),
        F.count_if(F.col("lat").isNotNull() & ~F.col("final").isin(v.FLAT, v.FALSE_ALARM, v.UNKNOWN, v.REPEATED)).alias("mapped"),
    )
