"""Queries on sample streams: rates, thresholds, windows, the detector."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import refractory_ms, rnd, rnd_scaled, rule_class
from ..operators import analysis, block_filters, blocks, detector, ml, quality, spatial, spectral
from ..operators import timeseries as ts
from ..operators.graph import shared_folder
from ..sources import adapters as a
from ..sources import packs
from .registry import query

S = "WITH " + a.SAMPLES_SQL
RING = "PARTITION BY pack_id ORDER BY t_ms RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
THR = f"greatest(1.2, 4 * greatest(round(sqrt(avg(hp * hp) OVER ({RING.format(1000)})), 12), 0.02))"


@query(S + """, g AS (SELECT pack_id, t_ms - lag(t_ms) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id) AS dt FROM samples),
l AS (SELECT pack_id, list_sort(list(dt) FILTER (WHERE dt > 0)) AS steps, median(dt) FILTER (WHERE dt > 0) AS m FROM g GROUP BY pack_id)
SELECT pack_id, round(coalesce(1000.0::DOUBLE / m, 100), 6) AS fs, round(coalesce(1000.0::DOUBLE / steps[CAST(len(steps) // 2 + 1 AS INT)], 100), 6) AS fs_upper FROM l""")
def source_rate(spark, d):
    return ts.source_rate(a.samples(spark, d)).select("pack_id", rnd(F.col("fs")).alias("fs"), rnd(F.col("fs_upper")).alias("fs_upper"))


@query(S + """, g AS (SELECT pack_id, t_ms - lag(t_ms) OVER (PARTITION BY pack_id ORDER BY event_id, t_ms) AS dt FROM samples)
SELECT pack_id, count(*) FILTER (WHERE dt = 0) AS repeated, count(*) FILTER (WHERE dt < 0) AS backward, count(*) FILTER (WHERE dt > 800) AS long_gaps FROM g GROUP BY pack_id""")
def sampling_gaps(spark, d):
    return ts.gaps(a.samples(spark, d))


@query(S + f", r AS (SELECT pack_id, event_id, {THR} AS thr, hp FROM samples) SELECT pack_id, event_id, round(thr, 6) AS thr, abs(hp) > thr AS over FROM r")
def rolling_rms_threshold(spark, d):
    return ts.noise_threshold(a.samples(spark, d), 0.8).select("pack_id", "event_id", rnd(F.col("thr")).alias("thr"), (F.abs("hp") > F.col("thr")).alias("over"))


@query(S + f" SELECT pack_id, event_id, round(greatest(1.2, 4 * greatest(round(quantile_cont(abs(hp), 0.2) OVER ({RING.format(3000)}), 12), 0.02)), 6) AS thr FROM samples")
def rolling_quantile_threshold(spark, d):
    return ts.noise_threshold(a.samples(spark, d), 0.6).select("pack_id", "event_id", rnd(F.col("thr")).alias("thr"))


@query(S + """, r AS (SELECT *, CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(abs(hp), 0.2) OVER w END AS raw FROM samples WINDOW w AS (PARTITION BY pack_id ORDER BY t_ms, event_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
SELECT pack_id, event_id, round(greatest(coalesce(raw, first_value(raw IGNORE NULLS) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(raw IGNORE NULLS) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.02), 0.02), 6) AS floor FROM r""")
def centered_quantile_floor(spark, d):
    out = ts.centered_quantile_floor(a.samples(spark, d), 20)
    return out.select("pack_id", "event_id", rnd(F.coalesce("floor", F.lit(0.02))).alias("floor"))


@query(S + """ SELECT pack_id, event_id, round(greatest(coalesce(stddev_samp(hp) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 0.2), 0.2), 6) AS floor FROM samples""")
def centered_std_floor(spark, d):
    return ts.centered_std_floor(a.samples(spark, d), 20).select("pack_id", "event_id", rnd(F.col("floor")).alias("floor"))


ORDERED = S + """, o AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY t_ms, event_id) AS i FROM samples)"""


@query("WITH RECURSIVE " + ORDERED.removeprefix("WITH ") + """, e AS (
  SELECT pack_id, i, event_id, t_ms, (1 - exp(-(1.0::DOUBLE / 60) / 0.010::DOUBLE)) * hp AS s FROM o WHERE i = 1
  UNION ALL SELECT o.pack_id, o.i, o.event_id, o.t_ms, exp(-least((o.t_ms - e.t_ms) / 1000.0::DOUBLE, 0.2) / 0.010::DOUBLE) * e.s + (1 - exp(-least((o.t_ms - e.t_ms) / 1000.0::DOUBLE, 0.2) / 0.010::DOUBLE)) * o.hp
  FROM e JOIN o ON o.pack_id = e.pack_id AND o.i = e.i + 1
) SELECT pack_id, event_id, round(s, 6) + 0.0 AS ema FROM e""")
def ema_fold(spark, d):
    return ts.ema(a.samples(spark, d)).select("pack_id", "event_id", rnd_scaled(F.col("ema")).alias("ema"))


def detector_sql(thr: str, dead: str, gate: str = "false") -> str:
    return "WITH RECURSIVE " + a.SAMPLES_SQL + f""", o AS (SELECT *, {thr} AS thr, {dead} AS dead, abs(hp) AS a, row_number() OVER (PARTITION BY pack_id ORDER BY t_ms, event_id, abs(hp), speed) AS i FROM samples),
f AS (
  SELECT pack_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS fin, CAST(NULL AS BIGINT) AS t0, CAST(0 AS DOUBLE) AS peak, CAST(NULL AS BIGINT) AS t, CAST(NULL AS STRUCT(t0 BIGINT, dur BIGINT, peak DOUBLE)) AS ev, CAST(NULL AS VARCHAR) AS why FROM (SELECT DISTINCT pack_id FROM samples)
  UNION ALL
  SELECT o.pack_id, o.i,
    CASE WHEN f.t0 IS NOT NULL AND ((o.a < o.thr * 0.5 AND o.t_ms - f.t0 > 60) OR o.t_ms - f.t0 > 3000) THEN o.t_ms ELSE f.fin END,
    CASE WHEN f.t0 IS NOT NULL THEN CASE WHEN (o.a < o.thr * 0.5 AND o.t_ms - f.t0 > 60) OR o.t_ms - f.t0 > 3000 THEN NULL ELSE f.t0 END
         WHEN o.a > o.thr AND NOT ({gate}) AND o.t_ms - f.fin > o.dead THEN o.t_ms END,
    CASE WHEN f.t0 IS NOT NULL THEN CASE WHEN o.a > o.thr THEN greatest(f.peak, o.a) ELSE f.peak END WHEN o.a > o.thr AND NOT ({gate}) AND o.t_ms - f.fin > o.dead THEN o.a ELSE f.peak END,
    o.t_ms,
    CASE WHEN f.t0 IS NOT NULL AND ((o.a < o.thr * 0.5 AND o.t_ms - f.t0 > 60) OR o.t_ms - f.t0 > 3000) THEN {{'t0': f.t0, 'dur': o.t_ms - f.t0, 'peak': CASE WHEN o.a > o.thr THEN greatest(f.peak, o.a) ELSE f.peak END}} END,
    CASE WHEN o.a <= o.thr THEN NULL WHEN f.t0 IS NOT NULL THEN 'in_event' WHEN {gate} THEN 'speed_gate' WHEN o.t_ms - f.fin <= o.dead THEN 'refractory' END
  FROM f JOIN o ON o.pack_id = f.pack_id AND o.i = f.i + 1
), z AS (SELECT pack_id, max(i) AS i FROM o GROUP BY pack_id)"""


NEW = detector_sql(THR, "CASE WHEN speed > 0.5 THEN least(greatest(1.2 / speed * 1000, 250), 1500) ELSE 800 END")
OLD = detector_sql(f"greatest(1.2, 4 * greatest(round(quantile_cont(abs(hp), 0.2) OVER ({RING.format(3000)}), 12), 0.02))", "1500", "o.speed < 8 / 3.6")
EVENTS = """, e AS (SELECT pack_id, ev.t0 AS t0_ms, ev.dur AS duration_ms, ev.peak AS peak FROM f WHERE ev IS NOT NULL
  UNION ALL SELECT f.pack_id, f.t0, f.t - f.t0, f.peak FROM f JOIN z ON f.pack_id = z.pack_id AND f.i = z.i WHERE f.t0 IS NOT NULL)"""


@query(NEW + EVENTS + " SELECT pack_id, t0_ms, duration_ms, round(peak, 6) AS peak FROM e")
def detector_replay(spark, d):
    return detector.events(detector.replay(a.samples(spark, d))).select("pack_id", "t0_ms", "duration_ms", rnd(F.col("peak")).alias("peak"))


@query(OLD + EVENTS + " SELECT pack_id, t0_ms, duration_ms, round(peak, 6) AS peak FROM e")
def detector_replay_old(spark, d):
    return detector.events(detector.replay(a.samples(spark, d), 0.6)).select("pack_id", "t0_ms", "duration_ms", rnd(F.col("peak")).alias("peak"))


@query(OLD + """, m AS (SELECT pack_id, why, t, t - lag(t) OVER (PARTITION BY pack_id, why ORDER BY t, i) AS gap, i FROM f WHERE why IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN gap > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY pack_id, why ORDER BY t, i) AS seg FROM m),
g AS (SELECT pack_id, why, seg, count(*) AS n, max(t) - min(t) AS ms FROM s GROUP BY ALL)
SELECT pack_id, why, CAST(sum(n) AS BIGINT) AS samples, count(*) AS segments, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS longest_ms FROM g GROUP BY pack_id, why""")
def missed_segments(spark, d):
    lost = detector.missed(detector.replay(a.samples(spark, d), 0.6))
    w = ts.Window.partitionBy("pack_id", "why").orderBy("t_ms")
    new = F.coalesce((F.col("t_ms") - F.lag("t_ms").over(w) > 500).cast("int"), F.lit(0))
    runs = lost.withColumn("new", new).withColumn("seg", F.sum("new").over(w)).groupBy("pack_id", "why", "seg").agg(F.count(F.lit(1)).alias("n"), (F.max("t_ms") - F.min("t_ms")).alias("ms"))
    return runs.groupBy("pack_id", "why").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("segments"), F.sum("ms").alias("total_ms"), F.max("ms").alias("longest_ms"))


@query(S + f""", r AS (SELECT *, {THR} AS thr FROM samples), x AS (SELECT pack_id, t_ms, event_id, hp, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id) > 500 THEN 1 ELSE 0 END AS new FROM r WHERE abs(hp) > thr),
i AS (SELECT *, sum(new) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM x), g AS (SELECT pack_id, segment, min(t_ms) AS t0_ms, max(t_ms) AS t1_ms, count(*) AS n, max(abs(hp)) AS peak FROM i GROUP BY pack_id, segment),
k AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY t1_ms - t0_ms DESC, t0_ms) AS place FROM g)
SELECT pack_id, t0_ms, t1_ms, n, round(peak, 6) AS peak, place FROM k WHERE place <= 3""")
def exceedance_islands(spark, d):
    s = ts.noise_threshold(a.samples(spark, d), 0.8)
    return ts.longest(ts.islands(s, F.abs("hp") > F.col("thr"))).select("pack_id", "t0_ms", "t1_ms", "n", rnd(F.col("peak")).alias("peak"), "place")


@query(S + """, p AS (SELECT event_id, speed, unnest([0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE]) AS version FROM samples)
SELECT event_id, version, round(CASE WHEN version < 0.7 THEN 1500.0 WHEN speed > 0.5 THEN least(greatest(1.2 / speed * 1000, 250), 1500) ELSE 800 END, 6) AS ms FROM p""")
def refractory(spark, d):
    s = a.samples(spark, d).withColumn("version", F.explode(F.array(*map(F.lit, (0.6, 0.7, 0.8)))))
    return s.select("event_id", "version", rnd(refractory_ms(F.col("speed"), F.col("version"))).alias("ms"))


@query(S + """, m AS (SELECT *, lag(hp) OVER w AS l, lead(hp) OVER w AS r FROM samples WINDOW w AS (PARTITION BY pack_id ORDER BY t_ms, event_id)), p AS (SELECT * FROM m WHERE hp > l AND hp > r AND hp >= 1.2),
g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id) AS gap FROM p) SELECT pack_id, event_id, t_ms, round(hp, 6) AS hp FROM g WHERE gap IS NULL OR gap >= 300""")
def peak_merge(spark, d):
    s = a.samples(spark, d)
    return ts.merge_peaks(ts.local_maxima(s, F.lit(1.2))).select("pack_id", "event_id", "t_ms", rnd(F.col("hp")).alias("hp"))


FEATURES_SQL = """, i AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY t_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY pack_id) AS n FROM samples),
x AS (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 15) / 8) AS BIGINT)), least(i // 8, (n - 16) // 8) + 1)) AS win FROM i WHERE n >= 16),
w AS (SELECT *, hp - avg(hp) OVER (PARTITION BY pack_id, win) AS w FROM x), y AS (SELECT *, max(abs(w)) OVER (PARTITION BY pack_id, win) AS top, (w < 0) <> (lag(w) OVER (PARTITION BY pack_id, win ORDER BY t_ms, event_id) < 0) AS turn FROM w),
k AS (SELECT pack_id, win AS "window", max(top) AS peak, sqrt(avg(w * w)) AS rms, avg(pow(w, 4)) / pow(avg(pow(w, 2)), 2) AS kurtosis, avg(pow(w, 3)) / pow(avg(pow(w, 2)), 1.5) AS skew, count(*) FILTER (WHERE abs(w) > 0.3 * top) / 40.0::DOUBLE AS duration, coalesce(sum(abs(w)) FILTER (WHERE abs(w) > 0.3 * top), 0) / 40.0::DOUBLE AS impulse,
  CAST(count(*) FILTER (WHERE turn) AS DOUBLE) AS zero_crossings, sum(greatest(w, 0)) AS up, sum(greatest(-w, 0)) AS down FROM y GROUP BY pack_id, win)"""
POWER_SQL = """, q AS (SELECT pack_id, win, j, w * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY pack_id, win ORDER BY t_ms, event_id) - 1 AS j FROM w)),
z AS (SELECT pack_id, win, k, (pow(sum(h * cos(2 * pi() * k * j / 16)), 2) + pow(sum(h * sin(2 * pi() * k * j / 16)), 2)) * CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END AS p FROM q, (SELECT unnest(range(0, 9)) AS k) GROUP BY pack_id, win, k),
en AS (SELECT pack_id, win, sum(p) FILTER (WHERE k BETWEEN 1 AND 3) / sum(p) AS energy_low, sum(p) FILTER (WHERE k BETWEEN 4 AND 8) / sum(p) AS energy_high FROM z GROUP BY pack_id, win)"""


@query(S + FEATURES_SQL + POWER_SQL + ' SELECT k.pack_id, "window", round(peak, 8) AS peak, round(rms, 8) AS rms, round(kurtosis, 8) AS kurtosis, round(skew, 8) AS skew, round(duration, 8) AS duration, round(impulse, 8) AS impulse, zero_crossings, round(CASE WHEN down <= 1e-6 THEN 5.0 ELSE up / down END, 8) AS asymmetry, round(energy_low, 8) AS energy_low, round(energy_high, 8) AS energy_high FROM k JOIN en ON en.pack_id = k.pack_id AND en.win = k."window"')
def window_features(spark, d):
    w = ts.sliding_windows(a.samples(spark, d), 16, 8)
    f = analysis.described(w, ["pack_id", "window"], "hp", 40.0)
    return f.select(F.col("pack_id"), F.col("window").cast("bigint").alias("window"), *[rnd(F.col(c), 8).alias(c) for c in f.columns[2:]])


@query(S + FEATURES_SQL + """ SELECT pack_id, "window", CASE WHEN duration > 0.62 THEN '粗糙路面' WHEN duration >= 0.28 THEN '减速带' WHEN skew > 1 THEN '井盖' ELSE '坑洼' END AS kind FROM k""")
def rule_classify(spark, d):
    f = ts.window_features(ts.sliding_windows(a.samples(spark, d), 16, 8), ["pack_id", "window"], "hp", 40.0)
    return f.select("pack_id", F.col("window").cast("bigint").alias("window"), rule_class(F.col("duration"), F.col("skew")).alias("kind"))


@query(S + FEATURES_SQL + """, c AS (SELECT pack_id, win, label_raw, count(*) AS c, min(i) AS p FROM x GROUP BY pack_id, win, label_raw), o AS (SELECT *, row_number() OVER (PARTITION BY pack_id, win ORDER BY c DESC, p) AS place FROM c)
SELECT pack_id, win AS window, label_raw FROM o WHERE place = 1""")
def sliding_majority(spark, d):
    w = ts.sliding_windows(a.samples(spark, d), 16, 8).withColumn("window", F.col("window").cast("bigint"))
    return ts.majority(w, ["pack_id", "window"], "label_raw", ["t_ms", "event_id"])


@query(S + " SELECT pack_id, t_ms // 5000 AS bucket, count(*) AS n, round(max(abs(hp)), 6) AS peak, round(sqrt(avg(hp * hp)), 6) AS rms FROM samples GROUP BY ALL")
def five_second_profile(spark, d):
    return ts.profile(a.samples(spark, d)).select("pack_id", "bucket", "n", rnd(F.col("peak")).alias("peak"), rnd(F.col("rms")).alias("rms"))


@query(S + """, g AS (SELECT pack_id, unnest(range(min(t_ms), max(t_ms) + 1, 500)) AS t_ms FROM samples GROUP BY pack_id),
b AS (SELECT *, row_number() OVER (PARTITION BY pack_id, t_ms ORDER BY event_id DESC) AS k FROM samples)
SELECT g.pack_id, g.t_ms, round(b.hp, 6) + 0.0 AS hp, b.event_id FROM g ASOF JOIN (SELECT * FROM b WHERE k = 1) b ON g.pack_id = b.pack_id AND g.t_ms >= b.t_ms""")
def asof_hold(spark, d):
    s = a.samples(spark, d)
    grid = s.groupBy("pack_id").agg(F.min("t_ms").alias("x"), F.max("t_ms").alias("y")).select("pack_id", F.explode(F.sequence("x", "y", F.lit(500).cast("bigint"))).alias("t_ms"))
    last = s.groupBy("pack_id", "t_ms").agg(F.max_by("hp", "event_id").alias("hp"), F.max("event_id").alias("event_id"))
    return ts.step_hold(grid, last, ["hp", "event_id"]).select("pack_id", "t_ms", rnd(F.col("hp")).alias("hp"), "event_id")


@query(S + """, g AS (SELECT pack_id, unnest(range(min(t_ms), max(t_ms) + 1, 250)) AS t_ms FROM samples GROUP BY pack_id), u AS (SELECT pack_id, t_ms, avg(hp) AS hp FROM samples GROUP BY pack_id, t_ms),
p AS (SELECT g.*, u.t_ms AS pt, u.hp AS ph FROM g ASOF JOIN u ON g.pack_id = u.pack_id AND g.t_ms >= u.t_ms), q AS (SELECT p.*, u.t_ms AS qt, u.hp AS qh FROM p ASOF JOIN u ON p.pack_id = u.pack_id AND p.t_ms <= u.t_ms)
SELECT pack_id, t_ms, round(ph + (qh - ph) * CASE WHEN qt = pt THEN 0 ELSE (t_ms - pt) / (qt - pt) END, 8) + 0.0 AS hp FROM q""")
def linear_resample(spark, d):
    return ts.resample(a.samples(spark, d), 250, ["hp"]).select("pack_id", "t_ms", rnd_scaled(F.col("hp"), 8).alias("hp"))


@query(S + """, g AS (SELECT pack_id, t_ms - lag(t_ms) OVER w AS dt, (speed + lag(speed) OVER w) / 2 AS v FROM samples WINDOW w AS (PARTITION BY pack_id ORDER BY t_ms, event_id))
SELECT pack_id, round(coalesce(sum(CASE WHEN dt > 0 AND dt <= 5000 THEN v * dt / 1000 END), 0), 6) AS metres FROM g GROUP BY pack_id""")
def trapezoid_distance(spark, d):
    return spatial.distance_m(a.samples(spark, d)).select("pack_id", rnd(F.col("metres")).alias("metres"))


@query(S + """, n AS (SELECT * REPLACE (CASE WHEN pack_id % 3 > 0 THEN speed END AS speed) FROM samples), g AS (SELECT pack_id, t_ms - lag(t_ms) OVER w AS dt, (speed + lag(speed) OVER w) / 2 AS v FROM n WINDOW w AS (PARTITION BY pack_id ORDER BY t_ms, event_id)), m AS (SELECT DISTINCT pack_id, pack_id * 10.0 AS d FROM samples WHERE pack_id % 4 > 0)
SELECT g.pack_id, round(coalesce(sum(CASE WHEN dt > 0 AND dt <= 20 THEN v * dt / 1000 END), any_value(m.d), 0), 6) AS metres FROM g LEFT JOIN m ON m.pack_id = g.pack_id GROUP BY g.pack_id""")
def distance_fallback(spark, d):
    """Steps above 20 ms count nothing here, and a third of the recordings has no speed, so that some fall back to their metadata."""
    s = a.samples(spark, d)
    meta = s.select("pack_id").distinct().filter("pack_id % 4 > 0").withColumn("distance_m", F.col("pack_id") * 10.0)
    return spatial.distance_m(s.withColumn("speed", F.when(F.col("pack_id") % 3 > 0, F.col("speed"))), 20, meta).select("pack_id", rnd(F.col("metres")).alias("metres"))


@query(S + """, g AS (SELECT pack_id, t_ms, label_raw, t_ms - lag(t_ms) OVER (PARTITION BY pack_id ORDER BY t_ms, event_id) AS dt FROM samples), l AS (SELECT pack_id, list_sort(list(dt) FILTER (WHERE dt > 0)) AS steps FROM g GROUP BY pack_id)
SELECT g.pack_id, count(*) AS samples, round((max(t_ms) - min(t_ms)) / 1000, 6) AS duration_s, round(any_value(1000 / steps[len(steps) // 2 + 1]), 6) AS fs_hz, count(*) FILTER (WHERE label_raw = 'error') AS event_count, count(*) FILTER (WHERE label_raw = 'view') AS sweep_count FROM g JOIN l ON l.pack_id = g.pack_id GROUP BY g.pack_id""")
def pack_probe(spark, d):
    """What a registry may know of a recording; positions are never read."""
    s = a.samples(spark, d).select("pack_id", "event_id", "t_ms", "label_raw")
    counts = s.groupBy("pack_id").agg(F.count(F.lit(1)).alias("samples"), rnd((F.max("t_ms") - F.min("t_ms")) / 1000).alias("duration_s"), F.count_if(F.col("label_raw") == "error").alias("event_count"), F.count_if(F.col("label_raw") == "view").alias("sweep_count"))
    return counts.join(ts.source_rate(s).select("pack_id", rnd(F.col("fs_upper")).alias("fs_hz")), "pack_id")


@query(S + """, r AS (SELECT *, count(*) OVER (PARTITION BY pack_id) AS n, row_number() OVER (PARTITION BY pack_id ORDER BY t_ms, event_id) - 1 AS i FROM samples)
SELECT pack_id, event_id, i FROM r WHERE i % greatest(1, CAST(ceil(n / 48) AS BIGINT)) = 0""")
def waveform_stride(spark, d):
    return ts.stride(a.samples(spark, d)).select("pack_id", "event_id", F.col("i").cast("bigint").alias("i"))


CHANNELS = ("hp", "vz", "speed")


@query(S + """, g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY pack_id ORDER BY event_id) AS dt FROM samples) SELECT pack_id, count(*) AS n, """ + ", ".join(f"round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in CHANNELS) + """,
round(median(dt), 6) AS dt_median, max(dt) AS dt_max, coalesce(min(dt), 1) > 0 AS monotonic, round(avg(CASE WHEN speed >= 8 / 3.6 THEN 1.0 ELSE 0 END), 6) AS moving, round((max(lat) - min(lat)) * 110540, 6) AS north_m, round((max(lon) - min(lon)) * 111320 * cos(radians(avg(lat))), 6) AS east_m FROM g GROUP BY pack_id""")
def pack_profile(spark, d):
    s = a.samples(spark, d).withColumn("dt", F.col("t_ms") - F.lag("t_ms").over(ts.in_time(["event_id"])))
    by = [rnd(f(c)).alias(f"{c}_{name}") for c in CHANNELS for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    return s.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n"), *by, rnd(F.median("dt")).alias("dt_median"), F.max("dt").alias("dt_max"), F.coalesce(F.bool_and(F.col("dt") > 0), F.lit(True)).alias("monotonic"), rnd(F.avg((F.col("speed") >= v.GATE_MS).cast("double"))).alias("moving"),
        rnd((F.max("lat") - F.min("lat")) * v.LAT_M).alias("north_m"), rnd((F.max("lon") - F.min("lon")) * v.LON_M * F.cos(F.radians(F.avg("lat")))).alias("east_m"))


@query(S + """, v AS (SELECT unnest([2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE, 5.0::DOUBLE, 6.0::DOUBLE]) AS k), n AS (SELECT *, sqrt(avg(hp * hp) OVER (PARTITION BY pack_id ORDER BY t_ms RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)) AS rms FROM samples),
c AS (SELECT k, label_raw = 'error' AS truth, abs(hp) > greatest(1.2, k * greatest(rms, 0.02) / 4) AS hit FROM n, v)
SELECT k, round(count(*) FILTER (WHERE truth AND hit) / count(*) FILTER (WHERE truth), 6) AS recall, round(count(*) FILTER (WHERE hit AND NOT truth) / count(*) FILTER (WHERE NOT truth), 6) AS false_rate FROM c GROUP BY k""")
def param_grid(spark, d):
    n = a.samples(spark, d).withColumn("rms", ts.rolling_rms())
    grid = n.withColumn("k", F.explode(F.array(*map(F.lit, (2.0, 3.0, 4.0, 5.0, 6.0)))))
    hit, truth = F.abs("hp") > F.greatest(F.lit(1.2), F.col("k") * F.greatest("rms", F.lit(0.02)) / 4), F.col("label_raw") == "error"
    return grid.groupBy("k").agg(rnd(F.count_if(truth & hit) / F.count_if(truth)).alias("recall"), rnd(F.count_if(hit & ~truth) / F.count_if(~truth)).alias("false_rate"))


@query(NEW + EVENTS + """, g AS (SELECT pack_id, t0_ms - lag(t0_ms) OVER (PARTITION BY pack_id ORDER BY t0_ms) AS iv FROM e)
SELECT pack_id, count(*) AS events, round(stddev_pop(iv) / avg(iv), 6) AS cv, min(iv) AS min_iv, round(avg(CASE WHEN iv IS NOT NULL THEN CASE WHEN iv BETWEEN 1400 AND 2100 THEN 1.0 ELSE 0 END END), 6) AS share_1400_2100 FROM g GROUP BY pack_id HAVING count(*) >= 3""")
def periodicity(spark, d):
    r = quality.rhythm(detector.events(detector.replay(a.samples(spark, d))))
    return r.select("pack_id", "events", rnd(F.col("cv")).alias("cv"), "min_iv", rnd(F.col("share_1400_2100")).alias("share_1400_2100"))


@query(NEW + EVENTS + """, r AS (SELECT pack_id, t_ms, max(rms) AS rms FROM (SELECT pack_id, t_ms, sqrt(avg(hp * hp) OVER (PARTITION BY pack_id ORDER BY t_ms RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)) AS rms FROM samples) GROUP BY ALL)
SELECT e.pack_id, round(median(peak / rms), 6) AS crest_median, round(avg(CASE WHEN peak / rms >= 4 THEN 1.0 ELSE 0 END), 6) AS crest_ge4 FROM e JOIN r ON e.pack_id = r.pack_id AND e.t0_ms = r.t_ms WHERE rms > 1e-9 GROUP BY e.pack_id""")
def crest(spark, d):
    s = a.samples(spark, d)
    c = quality.crest(detector.events(detector.replay(s)), s.withColumn("rms", ts.rolling_rms()))
    return c.select("pack_id", rnd(F.col("crest_median")).alias("crest_median"), rnd(F.col("crest_ge4")).alias("crest_ge4"))


@query(S + " SELECT pack_id, round(corr(t_ms, hp), 6) AS r, round(median(hp), 6) AS median_hp FROM samples GROUP BY pack_id HAVING count(*) > 2")
def corr_time(spark, d):
    m = a.samples(spark, d).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"), F.corr("t_ms", "hp").alias("r"), F.median("hp").alias("m")).filter("n > 2")
    return m.select("pack_id", rnd(F.col("r")).alias("r"), rnd(F.col("m")).alias("median_hp"))


@query()
def surrogate_events(spark, d):
    s = a.samples(spark, d)
    noise = quality.surrogates(s)
    real = detector.counts(detector.replay(s), s)
    return quality.informative(real, noise)


@query()
def spectral_events(spark, d):
    return spectral.detect(ts.resample(a.raw_samples(spark, d), 10, ["ax", "ay", "az"]))


@query()
def analyze_events(spark, d):
    """Raw samples to events with features, class, cluster and priority."""
    return analysis.analyze(a.raw_samples(spark, d)).drop("event")


@query()
def analyze_summary(spark, d):
    """Raw samples to the health index and the counts of every recording."""
    found = analysis.summary(analysis.analyze(a.raw_samples(spark, d)))
    return found.withColumns({c: F.to_json(c) for c in ("final_types", "prioritys")})


def _windows(spark, d):
    w = ts.sliding_windows(a.samples(spark, d), 64, 32).withColumn("window", F.col("window").cast("bigint"))
    f = analysis.described(w, ["pack_id", "window"], "hp", 100.0).na.drop()
    return f.join(ts.majority(w, ["pack_id", "window"], "label_raw", ["t_ms", "event_id"]), ["pack_id", "window"]), list(analysis.NAMES)


@query()
def rf_windows(spark, d):
    """Importances of a forest of 400 trees with balanced weights, as the reference setting has it."""
    ready, names = _windows(spark, d)
    _, _, model = ml.train(ready, names, "label_raw")
    return spark.createDataFrame(ml.importance(model, names), "feature string, importance double")


@query()
def rf_report(spark, d):
    """Precision, recall and F1 of each label on held-out windows, and F1-macro over five folds."""
    ready, names = _windows(spark, d)
    return ml.report(ready, names, "label_raw", trees=50)


@query(S + f" SELECT pack_id, round(avg(CASE WHEN abs(hp) > thr THEN 1.0 ELSE 0 END), 6) AS over_ratio FROM (SELECT *, {THR} AS thr FROM samples) GROUP BY pack_id")
def over_threshold_ratio(spark, d):
    return quality.over_threshold(ts.noise_threshold(a.samples(spark, d), 0.8)).withColumn("over_ratio", rnd(F.col("over_ratio")))


# one recording of all samples, its blocks dealt over tasks
ONE = S.replace("user_id // 10 AS pack_id", "CAST(0 AS BIGINT) AS pack_id").replace("/ 155000)", "/ 1600)").replace("epoch_ms(ts)", "epoch_us(ts) // 1000")


@query(ONE + f", q AS (SELECT *, greatest(1.2, 4 * greatest(round(quantile_cont(abs(hp), 0.2) OVER ({RING.format(3000)}), 12), 0.02)) AS old, {THR} AS thr FROM samples) SELECT event_id, round(thr, 6) AS thr, round(old, 6) AS old_thr FROM q")
def recording_thresholds(spark, d):
    """Both thresholds of one long recording, in blocks."""
    s = a.recording(spark, d)
    length = blocks.fitting(s)
    both = blocks.noise_threshold(s, 0.8, length).join(blocks.noise_threshold(s, 0.7, length).select("event_id", F.col("thr").alias("old")), "event_id")
    return both.select("event_id", rnd(F.col("thr")).alias("thr"), rnd(F.col("old")).alias("old_thr"))


@query("WITH RECURSIVE " + ONE.removeprefix("WITH ") + """, o AS (SELECT event_id, t_ms, hp, row_number() OVER (ORDER BY t_ms, event_id) AS i FROM samples),
g AS (SELECT *, exp(-least(coalesce((t_ms - lag(t_ms) OVER (ORDER BY i)) / 1000.0::DOUBLE, 1.0::DOUBLE / 60), 0.2) / 0.010::DOUBLE) AS a FROM o),
l AS (SELECT list(a ORDER BY i) AS a, list(hp ORDER BY i) AS x FROM g),
e AS (SELECT CAST(1 AS BIGINT) AS i, (1 - a[1]) * x[1] AS s FROM l UNION ALL SELECT e.i + 1, l.a[e.i + 1] * e.s + (1 - l.a[e.i + 1]) * l.x[e.i + 1] FROM e, l WHERE e.i < len(l.a))
SELECT o.event_id, round(s, 6) + 0.0 AS ema FROM e JOIN o USING (i)""")
def recording_ema(spark, d):
    """Smoothing of one long recording, in blocks."""
    return blocks.ema(a.recording(spark, d)).select("event_id", rnd(F.col("ema")).alias("ema"))


ONE_REPLAYED = detector_sql(f"greatest(1.2, 4 * greatest(round(quantile_cont(abs(hp), 0.2) OVER ({RING.format(3000)}), 12), 0.02))", "CASE WHEN speed > 0.5 THEN least(greatest(1.2 / speed * 1000, 250), 1500) ELSE 800 END").replace(a.SAMPLES_SQL, ONE.removeprefix("WITH "))


@query(ONE_REPLAYED + EVENTS + " SELECT t0_ms, duration_ms, round(peak, 6) AS peak FROM e")
def recording_replay(spark, d):
    """The detector over one long recording, in blocks, by the formulas of version 0.7."""
    return detector.events(blocks.replay(a.recording(spark, d), 0.7)).select("t0_ms", "duration_ms", rnd(F.col("peak")).alias("peak"))


def filter_sql(name: str, source: str, sections) -> str:
    """A recursive table of k (from 1) and y: the list `source`.v filtered by second-order sections, from the steady state of its first value."""
    n = len(sections)
    unit = block_filters.steady(sections, 1.0)
    number = lambda x: f"({float(x)!r}::DOUBLE)"
    first = ", ".join(f"{number(u)} * v[1] AS s{j}" for j, u in enumerate(unit))
    step = f"SELECT k, v[k + 1] AS x0, {', '.join(f's{j}' for j in range(2 * n))} FROM {name}, {source} WHERE k < len(v)"
    for j, (b, _) in enumerate(sections):
        step = f"SELECT *, {number(b[0])} * x{j} + s{2 * j} AS x{j + 1} FROM ({step})"
    states = ", ".join(f"{number(b[1])} * x{j} - {number(c[1])} * x{j + 1} + s{2 * j + 1}, {number(b[2])} * x{j} - {number(c[2])} * x{j + 1}" for j, (b, c) in enumerate(sections))
    return f"{name} AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS y, {first} FROM {source} UNION ALL SELECT k + 1, x{n}, {states} FROM ({step}))"


BAND = spectral.butterworth_band(4, 1.0, 20.0, 100.0)


@query("WITH RECURSIVE " + ONE.removeprefix("WITH ") + """, l AS (SELECT list(hp ORDER BY t_ms, event_id) AS x, list(event_id ORDER BY t_ms, event_id) AS ids, count(*) AS n FROM samples),
e AS (SELECT list_concat([2 * x[1] - x[29 - k] FOR k IN range(1, 28)], x, [2 * x[n] - x[n - k] FOR k IN range(1, 28)]) AS v FROM l), """ + filter_sql("f", "e", BAND)
+ ", r AS (SELECT list(y ORDER BY k DESC) FILTER (WHERE k > 0) AS v FROM f), " + filter_sql("g", "r", BAND) + """
SELECT ids[n + 28 - k] AS event_id, round(y, 6) + 0.0 AS bp FROM g, l WHERE k BETWEEN 28 AND n + 27""")
def recording_band_pass(spark, d):
    """Band-pass of one long recording without a shift of phase, in blocks; its rows stand for a grid of 100 a second."""
    rows = block_filters.numbered(a.recording(spark, d)).select("pack_id", "i", "event_id", "hp")
    found = block_filters.zero_phase(rows.select("pack_id", "i", "hp"), BAND, ["hp"], 1024)
    return rows.select("pack_id", "i", "event_id").join(found, ["pack_id", "i"]).select("event_id", rnd(F.col("hp")).alias("bp"))


@query()
def recording_peaks(spark, d):
    """Peaks in the motion of one long recording of raw accelerations, filters and peaks in blocks."""
    s = a.raw_samples(spark, d).withColumn("pack_id", F.lit(0).cast("bigint"))
    grid = block_filters.numbered(s).select("pack_id", (F.col("i") * 10).alias("t_ms"), "ax", "ay", "az")
    ready = block_filters.prepare(grid, block_rows=1024).withColumn("floor", F.lit(v.NOISE_FLOOR))
    return block_filters.peaks(ready, block_rows=1024).select("t_ms", rnd(F.col("bp_mag")).alias("height"))


@query(S + """ SELECT CAST(pack_id AS VARCHAR) AS pack_id, t_ms, round(hp, 6) + 0.0 AS hp, speed, label_raw FROM samples""")
def pack_samples(spark, d):
    """Samples written as ZIP packs, one for each recording, and read back from their samples.csv."""
    s = a.samples(spark, d).select("pack_id", "t_ms", "hp", "speed", "lat", "lon", "label_raw")
    path = f"{shared_folder(spark).rstrip('/')}/packs-{uuid.uuid4().hex}"
    packs.write_packs(s, s.filter("label_raw = 'error'").select("pack_id", "t_ms", F.col("label_raw").alias("final_label")), path).write.format("noop").mode("overwrite").save()
    back = packs.read_member(spark, path, "samples.csv", "pack_id string, t_ms long, hp double, speed double, label_raw string")
    return back.withColumn("hp", rnd(F.col("hp")))
