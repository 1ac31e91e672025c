"""Scalar expressions of the domain: all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as v


def rnd(x: Column, digits: int = 6) -> Column:
    """Round at the outer edge, null for NaN."""
    return F.round(F.when(F.isnan(x), None).otherwise(x), digits)


def rnd_scaled(x: Column, digits: int = 6) -> Column:
    """Round at the outer edge as DuckDB does, the scaled number and halves away from zero: of values halfway between two printed ones both give the same."""
    scale = float(10**digits)
    return F.round(F.when(F.isnan(x), None).otherwise(x) * scale) / scale


def lookup(key: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for k, val in reversed(values.items()):
        out = F.when(key == k, F.lit(val)).otherwise(out)
    return out


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * v.EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def plane_m(dlat: Column, dlon: Column, lat: Column) -> Column:
    """Distance on the local plane at latitude `lat`."""
    return F.hypot(dlon * v.LON_M * F.cos(F.radians(lat)), dlat * v.LAT_M)


def rule_class(duration: Column, skew: Column) -> Column:
    return F.when(duration > 0.62, v.ROUGH).when(duration >= 0.28, v.BUMP).when(skew > 1, v.MANHOLE).otherwise(v.POTHOLE)


def priority(kind: Column, confirmations: Column) -> Column:
    base = lookup(kind, v.PRIORITY, "低")
    return F.when((confirmations >= 3) & (base == "中"), "高").otherwise(base)


def severity(kind: Column) -> Column:
    return lookup(F.coalesce(kind, F.lit(v.OTHER)), v.SEVERITY, v.UNKNOWN_SEVERITY)


def refractory_ms(speed: Column, version: Column) -> Column:
    """Dead time after an event by software version (a number such as 0.8) and speed in m/s."""
    least, most, still = v.REFRACTORY_MS
    moving = F.least(F.greatest(v.BLIND_ZONE_M / speed * 1000, F.lit(least)), F.lit(most))
    return F.when(version < 0.7, most).when(speed > 0.5, moving).otherwise(still)


def version_number(text: Column) -> Column:
    """major + minor/10 style pair as a struct; missing or bad parts count as 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\.")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    bad = F.get(parts, F.lit(0)).try_cast("int").isNull()
    return F.when(bad, F.struct(F.lit(0).alias("major"), F.lit(0).alias("minor"))).otherwise(F.struct(part(0).alias("major"), part(1).alias("minor")))


def threshold(noise: Column) -> Column:
    """Without the noise's last digits, which hang on the order of a sum or of an interpolation and would decide on samples at the threshold."""
    return F.greatest(F.lit(v.MIN_THRESHOLD), v.NOISE_FACTOR * F.greatest(F.round(noise, 12), F.lit(v.NOISE_FLOOR)))


def evidence_tier(crest: Column) -> Column:
    return F.when(crest >= v.STRONG, "强").when(crest >= v.MEDIUM, "中").otherwise("弱")


def is_defect(label: Column) -> Column:
    return F.coalesce(label.isin(*v.DEFECTS), F.lit(False))


def crack_kind(label: Column, why: Column) -> Column:
    """The general crack label made specific by its reason; alligator where nothing is said."""
    why = F.coalesce(why, F.lit(""))
    special = F.when(why.contains("纵向"), v.LONGITUDINAL).when(why.contains("横向"), v.TRANSVERSE).otherwise(v.ALLIGATOR)
    return F.when(label == v.CRACK, special).otherwise(label)


def classical_image_rule(f: dict[str, Column]) -> Column:
    """label and conf from blob_px, blob_ratio, elongation, crack_px, crack_ratio, crack_elong, orient, std."""
    pothole = (f["blob_px"] >= 60) & (f["blob_ratio"] > 0.008) & (f["elongation"] < 4)
    crack = (f["crack_px"] >= 60) & (f["crack_elong"] >= 3) & (f["crack_ratio"] > 0.003)
    along = (F.abs(f["orient"]) < 45) | (F.abs(f["orient"]) > 135)
    made = lambda label, conf: F.struct(label.alias("label"), conf.cast("double").alias("conf"))
    return (
        F.when(pothole, made(F.lit(v.POTHOLE), F.least(F.lit(0.9), 0.45 + 8 * f["blob_ratio"])))
        .when(crack, made(F.when(along, v.LONGITUDINAL).otherwise(v.TRANSVERSE), F.least(F.lit(0.85), 0.35 + 12 * f["crack_ratio"])))
        .when(f["std"] > 1.5, made(F.lit(v.ROUGH), F.least(F.lit(0.8), 0.3 + f["std"] / 20)))
        .otherwise(made(F.lit(v.FLAT), F.lit(0.8)))
    )


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def feature_text(f: dict[str, Column]) -> Column:
    """The evidence block handed to a judging model."""
    lines = [
        F.lit("IMU 证据（由确定性代码预计算，模型不得重新解读数值）："),
        F.concat(F.lit("- 证据强度："), evidence_tier(f["crest"])),
        F.format_string("- 持续时长：%d ms", f["duration_ms"]),
        F.when(f["bump"].isNotNull(), F.format_string("- 垂直分量：%s（上下极值差 %.1f）", f["bump"], f["vz_pp"])),
        F.when(f["post_ratio"].isNull(), F.lit("- 事件后持续位移：无有效数据")).otherwise(F.concat(F.format_string("- 事件后持续位移：比值 %.3f", f["post_ratio"]), F.when(f["post_ratio"] > v.POST_RATIO, "（>0.089，含持续位移成分）").otherwise(""))),
        F.concat(F.format_string("- 记录时车速：%.1f km/h；低速标记：", f["speed_kmh"]), F.when(f["low_speed"], "是").otherwise("否")),
        F.concat(F.lit("- 算法自动标签："), F.coalesce(F.nullif(f["auto_label"], F.lit("")), F.lit("无")), F.lit("（供对照，不供采信）")),
    ]
    return F.concat_ws("\n", *lines)


def gsd_mm(x_mm: Column, height_mm: float = 1000.0, hfov_deg: float = 68.0, width_px: Column | int = 480) -> Column:
    """Ground sampling distance at a distance, for a camera at a height."""
    focal = width_px / (2 * F.tan(F.radians(F.lit(hfov_deg)) / 2))
    return (height_mm * height_mm + x_mm * x_mm) / (height_mm * focal)
