"""Quality control of recordings: facts per pack, tidy checks, the verdict, the report.

Facts are one row per pack, gathered by aggregations over samples, replayed and recorded events and frames. Checks are
expressions over that row; a check that does not apply is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import gsd_mm, refractory_ms, threshold
from . import detector, quality
from . import timeseries as ts
from .graph import cut
from .joins import interval_join
from .logs import collection_window

# fixed values: limits of the checks
LEAST_RATE, MOST_SUSPECT, LEAST_CREST, TAIL_CREST, LEAST_CV, DARK, BLURRED, GAP_MS = 50.0, 0.5, 2.0, 4.0, 0.25, 50.0, 50.0, 800
MOST_OVER, MOST_BLURRED_SHARE, MOST_DARK_SHARE, LEAST_R, START_MS, FRAME_CAP = 0.02, 0.3, 0.2, -0.3, 3, 300
FEW = 200_000


def replay_by_version(samples: DataFrame, versions: DataFrame, mode: str = "ride") -> tuple[DataFrame, DataFrame]:
    """Samples with version, rms and thr, and what the replay finds, each pack by the formulas of its version (pack_id, version: 8, 7 or less).

    Both are cut: the samples are read once, the state machine runs once, and all facts come from these two.
    """
    few = versions.limit(FEW + 1).count() <= FEW
    known = samples.join(F.broadcast(versions) if few else versions, "pack_id").withColumn("rms", ts.rolling_rms())
    old = F.coalesce(F.col("version") < 8, F.lit(False))
    noisy = known.filter(~old).withColumn("noise", F.col("rms")).unionByName(ts.rolling_quantile(known.filter(old), "noise"))
    dead = F.coalesce(*(F.when(F.col("version") >= low, refractory_ms(F.col("speed"), F.lit(x))) for low, x in ((8, 0.8), (7, 0.7), (-1, 0.6)))).cast("double")
    ready = noisy.withColumn("thr", threshold(F.col("noise"))).drop("noise")
    ready = cut(ready)
    gated = F.col("version") < 7 if "test" not in mode else F.lit(False)
    return ready, cut(detector.found_in(ready.withColumns({"dead": dead, "gated": gated})))


def reproduced(recorded: DataFrame, replayed: DataFrame, thresholds: DataFrame, tolerance_ms: int = START_MS) -> DataFrame:
    """pack_id, n_pack, matched, lost, first_only, first_ratio, peak_ratio_median.

    recorded, replayed: pack_id, t0_ms, peak. A recorded start is met where the replay has one within the tolerance; events are apart by the dead
    time, so each start meets one at most. first_ratio: the first recorded peak over the threshold at its start.
    """
    by_time = Window.partitionBy("pack_id").orderBy("t0_ms", "peak")
    left = recorded.withColumn("place", F.row_number().over(by_time)).select("pack_id", F.col("t0_ms").alias("rt"), F.col("peak").alias("rpeak"), "place")
    right = replayed.withColumn("n", F.row_number().over(by_time)).select("pack_id", "t0_ms", "peak", "n")
    met = interval_join(right, left, ["pack_id"], "t0_ms", F.col("rt") - tolerance_ms, F.col("rt") + tolerance_ms, 1000).select("pack_id", "place").distinct().withColumn("met", F.lit(True))
    side = left.join(met, ["pack_id", "place"], "left").groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n_pack"), F.count_if("met").alias("matched"), F.count_if(F.col("met").isNull()).alias("lost"),
        (F.count_if(F.col("met").isNull() & (F.col("place") == 1)) == 1).alias("first_lost"), F.min(F.struct("place", "rt", "rpeak")).alias("first"),
    )
    at = thresholds.select("pack_id", "t_ms", "thr").join(side.select("pack_id", "first.rt", "first.rpeak"), "pack_id").filter("t_ms >= rt").groupBy("pack_id").agg(F.min(F.struct("t_ms", "thr")).alias("at"), F.first("rpeak").alias("rpeak"))
    ratio = at.select("pack_id", F.when(F.col("at.thr") > 0, F.col("rpeak") / F.col("at.thr")).alias("first_ratio"))
    counts = right.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_rep"))
    pairs = left.join(right, (left.pack_id == right.pack_id) & (left.place == right.n)).select(left.pack_id, (F.col("peak") / F.col("rpeak")).alias("q"), F.col("rpeak"))
    same = side.join(counts, "pack_id").filter("n_pack = n_rep").select("pack_id")
    peaks = pairs.filter("rpeak > 0").join(same, "pack_id").groupBy("pack_id").agg(F.round(F.median("q") + 1e-9, 4).alias("peak_ratio_median"))
    out = side.join(ratio, "pack_id", "left").join(peaks, "pack_id", "left")
    return out.select("pack_id", "n_pack", "matched", "lost", (F.col("first_lost") & (F.col("lost") == 1)).alias("first_only"), "first_ratio", "peak_ratio_median")


def frame_facts(frames: DataFrame, cap: int | None = None) -> DataFrame:
    """pack_id, frames, decoded, brightness and blur of all sweep frames, or of at most `cap` evenly spaced ones where one is given. frames: pack_id, t_ms, brightness, lap_var (null where it can't be decoded)."""
    seconds = F.when(F.col("brightness").isNotNull(), F.col("t_ms") / 1000)  # corr() would end the query where one brightness fills a pack
    taken = frames if cap is None else evenly_spaced(frames, cap)
    return taken.groupBy("pack_id").agg(
        (F.count(F.lit(1)) if cap is None else F.max("n")).alias("frames"), F.count("brightness").alias("decoded"), F.median("lap_var").alias("lap_var_median"), F.avg((F.col("lap_var") < BLURRED).cast("double")).alias("blur_ratio"),
        F.avg((F.col("brightness") < DARK).cast("double")).alias("dark_ratio"), F.median("brightness").alias("brightness_median"),
        F.when((F.count("brightness") > 10) & (F.stddev_pop("brightness") > 0), F.try_divide(F.covar_pop(seconds, "brightness"), F.stddev_pop(seconds) * F.stddev_pop("brightness"))).alias("brightness_time_r"),
    )


def evenly_spaced(frames: DataFrame, cap: int) -> DataFrame:
    """At most `cap` frames of each pack, with n, how many there are."""
    w = Window.partitionBy("pack_id")
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("t_ms", "brightness", "lap_var")) - 1
    numbered = frames.withColumn("n", n).withColumn("i", i)
    # frame i is taken if it is k * (n - 1) div (cap - 1) for a whole k
    k = F.expr(f"(i * {cap - 1} + n - 2) div (n - 1)")
    return numbered.filter((F.col("n") <= cap) | (F.floor(k * (F.col("n") - 1) / F.lit(cap - 1)) == F.col("i")))


def facts(ready: DataFrame, found: DataFrame, meta: DataFrame, recorded: DataFrame, frames: DataFrame, null_test: DataFrame | None = None, frame_cap: int | None = FRAME_CAP) -> DataFrame:
    """One row per pack of `meta`. ready, found: as replay_by_version gives them of samples pack_id, event_id (recorded order), t_ms, hp, speed; null_test: pack_id, informative; frame_cap: as frame_facts has it."""
    events = detector.events(found)
    steps = ready.withColumn("dt", F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("pack_id").orderBy(*ts.recorded())))
    timing = steps.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n_rows"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("dur_real"),
        F.count_if(F.col("dt") == 0).alias("repeated"), F.count_if(F.col("dt") < 0).alias("backward"), F.count_if(F.col("dt") > GAP_MS).alias("gaps"),
    )
    iv = F.col("t0_ms") - F.lag("t0_ms").over(Window.partitionBy("pack_id").orderBy("t0_ms"))
    rhythm = events.withColumn("iv", iv).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_rep"), F.min("iv").alias("min_iv"), F.when(F.avg("iv") > 0, F.stddev_pop("iv") / F.avg("iv")).alias("cv"), F.avg(F.when(F.col("iv").isNotNull(), F.col("iv").between(1400, 2100).cast("double"))).alias("share_1400_2100"))
    lost = found.groupBy("pack_id").pivot("what", ["speed_gate", "refractory", "in_event"]).agg(F.count(F.lit(1)))
    parts = [
        timing, rhythm, lost, quality.over_threshold(ready), quality.crest(events, ready), frame_facts(frames, frame_cap),
        reproduced(recorded, events, ready),
    ] + ([null_test.select("pack_id", "informative")] if null_test is not None else [])
    out = reduce(lambda a, b: a.join(b, "pack_id", "left"), parts, meta)
    zero = ["n_rows", "repeated", "backward", "gaps", "n_rep", "speed_gate", "refractory", "in_event", "frames", "decoded", "n_pack", "matched", "lost"]
    out = out.fillna(0, zero).fillna(False, ["first_only"])
    return out if null_test is not None else out.withColumn("informative", F.lit(None).cast("boolean"))


def reproduction_status() -> Column:
    """pass, warn_first_event, warn_legacy or fail."""
    missing = F.col("n_pack") - F.col("n_rep")
    few = missing <= F.greatest(F.lit(2), F.floor(F.col("n_pack") * 0.02))
    return (
        F.when((missing == 0) & (F.coalesce("event_count", F.lit(0)) == F.col("n_pack")), "pass").when((missing == 1) & F.col("first_only"), "warn_first_event")
        .when((F.col("version") < 8) & (F.col("n_pack") > 0) & (F.col("matched") >= 0.8 * F.col("n_pack")) & few, "warn_legacy").otherwise("fail")
    )


def checks(rows: DataFrame) -> DataFrame:
    """pack_id, grp, item, value, threshold, status, subject: one row per check that applies."""
    c = F.col
    old = c("version") < 8
    dead = F.when(c("version") < 7, v.REFRACTORY_MS[1]).otherwise(v.REFRACTORY_MS[0])
    window = collection_window(c("exported_at").try_cast("timestamp"), F.coalesce("duration_s", F.lit(0.0)))
    ok = lambda x, bad: F.when(F.coalesce(x, F.lit(False)), "pass").otherwise(bad)
    relative = F.abs(c("dur_real") - c("duration_s")) / F.greatest(c("duration_s"), F.lit(1.0))
    few = c("n_rep") < 3
    by_version = reproduction_status()
    listed = [  # group, item, subject, value, threshold, status, applies
        ("meta", "sample_rate_hz", None, c("sample_rate_hz"), ">=50", F.when(c("sample_rate_hz").isNull(), "fail").otherwise(ok(c("sample_rate_hz") >= LEAST_RATE, "warn")), None),
        ("meta", "sample_count", None, c("sample_count"), "= rows", ok(c("sample_count") == c("n_rows"), "fail"), None),
        ("meta", "duration_s", None, c("dur_real"), "within 2%", ok(relative < 0.02, "warn"), F.coalesce(c("duration_s"), F.lit(0.0)) != 0),
        ("meta", "gate_blocked_segments", None, F.coalesce(c("gate_blocked_segments"), F.lit(0)), "=0", ok(F.coalesce(c("gate_blocked_segments"), F.lit(0)) == 0, "warn"), None),
        ("meta", "speed_usable", None, c("speed_usable").cast("int"), "true", ok(c("speed_usable"), "fail"), None),
        ("meta", "suspect_ratio", None, c("suspect_ratio"), "<0.5", F.when(c("suspect_ratio").isNull(), "info").otherwise(ok(c("suspect_ratio") < MOST_SUSPECT, "fail")), None),
        ("meta", "sampling_gaps_usable", None, c("gaps_usable").cast("int"), "true", F.when(c("gaps_usable").isNull(), "info").otherwise(ok(c("gaps_usable"), "fail")), None),
        ("meta", "floor_active_ratio", None, c("floor_active_ratio"), "<0.5", F.lit("info"), c("floor_active_ratio").isNotNull()),
        ("meta", "mode_consistent", None, c("mode_consistent").cast("int"), "true", ok(c("mode_consistent"), "warn"), F.coalesce(c("mode_changes"), F.lit(0)) > 0),
        ("meta", "mode", None, F.lit(None), "", F.lit("info"), F.coalesce(c("mode_changes"), F.lit(0)) == 0),
        ("sampling", "repeated", None, c("repeated"), "", F.lit("info"), c("n_rows") >= 2),
        ("sampling", "backward", None, c("backward"), "=0", ok(c("backward") == 0, "fail"), c("n_rows") >= 2),
        ("sampling", "gaps", None, c("gaps"), "=0", ok(c("gaps") == 0, "warn"), c("n_rows") >= 2),
        ("reproduction", "events", None, c("n_rep"), "= recorded", F.when(by_version == "pass", "pass").when(by_version == "fail", "fail").otherwise("warn"), None),
        ("periodicity", "too_few", None, c("n_rep"), ">=3", F.lit("info"), few),
        ("periodicity", "min_interval", None, c("min_iv"), "apart from the dead time", ok(~((c("cv") < LEAST_CV) & (c("min_iv") < dead * 1.4)), "warn"), ~few),
        ("periodicity", "interval_cv", None, c("cv"), ">=0.25", F.when(c("cv") < LEAST_CV, "warn").otherwise("pass"), ~few),
        ("periodicity", "old_threshold", None, F.lit(None), "retired", F.lit("fail"), ~few & old),
        ("crest", "none", None, F.lit(None), "", F.lit("info"), c("n_rep") == 0),
        ("crest", "median", None, c("crest_median"), ">=2", ok(c("crest_median") >= LEAST_CREST, "fail"), c("crest_median").isNotNull()),
        ("crest", "share_ge4", None, c("crest_ge4"), "", F.lit("info"), c("crest_ge4").isNotNull()),
        ("missed", "speed_gate", None, c("speed_gate"), "", ok(c("speed_gate") == 0, "warn"), c("version") < 7),
        ("missed", "refractory", None, c("refractory"), "", F.lit("info"), None),
        ("missed", "in_event", None, c("in_event"), "", F.lit("info"), None),
        ("threshold", "over_ratio", None, c("over_ratio"), "<=0.02", F.when(c("over_ratio") > MOST_OVER, "warn").otherwise("pass"), None),
        ("null_hypothesis", "informative", None, c("informative").cast("int"), "real > both kinds of noise", F.when(c("informative").isNull(), "info").otherwise(ok(c("informative"), "fail")), None),
        ("vision", "frames", None, c("frames"), "", F.lit("info"), c("frames") == 0),
        ("vision", "decoded", "vision_frames", c("decoded"), ">0", F.lit("fail"), (c("frames") > 0) & (c("decoded") == 0)),
        ("vision", "brightness_time_r", "vision_frames", c("brightness_time_r"), ">=-0.3", ok(c("brightness_time_r") >= LEAST_R, "warn"), c("brightness_time_r").isNotNull()),
        ("vision", "blur_ratio", "vision_frames", c("blur_ratio"), "<0.3", ok(c("blur_ratio") < MOST_BLURRED_SHARE, "warn"), c("decoded") > 0),
        ("vision", "dark_ratio", "vision_frames", c("dark_ratio"), "<0.2", ok(c("dark_ratio") < MOST_DARK_SHARE, "warn"), c("decoded") > 0),
        ("physics", "evening", None, window["evening"].cast("int"), "not evening", F.when(window["evening"], "warn").otherwise("pass"), c("exported_at").try_cast("timestamp").isNotNull()),
        ("physics", "exported_at", None, F.lit(None), "a time", F.lit("info"), c("exported_at").isNotNull() & c("exported_at").try_cast("timestamp").isNull()),
        ("physics", "gsd_1m", None, gsd_mm(F.lit(1000.0), width_px=F.coalesce("frame_width", F.lit(480))), "<=2.5", F.lit("info"), None),
    ]
    made = [
        F.when(F.lit(True) if applies is None else applies, F.struct(F.lit(g).alias("grp"), F.lit(i).alias("item"), value.cast("double").alias("value"), F.lit(limit).alias("threshold"), status.alias("status"), F.lit(subject).cast("string").alias("subject")))
        for g, i, subject, value, limit, status, applies in listed
    ]
    return rows.select("pack_id", F.explode(F.array_compact(F.array(*made))).alias("c")).select("pack_id", "c.*")


def verdict(rows: DataFrame, found: DataFrame) -> DataFrame:
    """pack_id, fail, warn, repro_status, can_judge, imu, vision_frames."""
    eyes = F.col("subject") == "vision_frames"
    n = found.groupBy("pack_id").agg(F.count_if(F.col("status") == "fail").alias("fail"), F.count_if(F.col("status") == "warn").alias("warn"), F.count_if((F.col("status") == "fail") & eyes).alias("blind"), F.count_if((F.col("status") == "warn") & eyes).alias("dim"))
    status = rows.select("pack_id", "version", "informative", reproduction_status().alias("repro_status"))
    imu = (F.col("repro_status") != "fail") & F.coalesce("informative", F.lit(True))
    return n.join(status, "pack_id").select(
        "pack_id", "fail", "warn", "repro_status", (imu & (F.col("blind") == 0) & (F.col("version") >= 8)).alias("can_judge"), F.when(imu, "usable").otherwise("unusable").alias("imu"),
        F.when(F.col("blind") > 0, "unusable").when(F.col("dim") > 0, "degraded").otherwise("usable").alias("vision_frames"),
    )


def document(rows: DataFrame, found: DataFrame) -> DataFrame:
    """pack_id, qc_json, digest_md: a JSON document and one Markdown line for each recording; its checks are a few dozen."""
    listed = found.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("grp", "item", "value", "threshold", "status", "subject"))).alias("checks"))
    all_ = listed.join(verdict(rows, found), "pack_id").join(rows.select("pack_id", "n_rep", "n_pack", "matched", "peak_ratio_median", "cv", "crest_median", "over_ratio"), "pack_id")
    body = F.to_json(F.struct(
        F.lit("pavelake.qc.v1").alias("schema"), "pack_id", "checks", F.struct("n_rep", "n_pack", "matched", "peak_ratio_median", F.col("repro_status").alias("status")).alias("reproduction"),
        F.struct("cv").alias("periodicity"), F.struct("crest_median", "over_ratio").alias("signal"), F.struct("can_judge", "fail", "warn", "imu", "vision_frames").alias("verdict"),
    ))
    line = F.format_string("| %s | %s | %d/%d | %d fail, %d warn | %s |", F.col("pack_id").cast("string"), F.when(F.col("can_judge"), "可判").otherwise("不该判"), F.col("matched"), F.col("n_pack"), F.col("fail"), F.col("warn"), "repro_status")
    return all_.select("pack_id", body.alias("qc_json"), line.alias("digest_md"))
