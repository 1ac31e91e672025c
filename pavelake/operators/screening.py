"""Candidate features of events: the shape of the hit itself, and the hit against its surroundings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from .joins import interval_join
from .spectral import bases, find_peaks

AXES = ("ax", "ay", "az", "gx", "gy", "gz")
SHAPE = ("rise_ms", "decay_ms", "ringdown", "zc_rate", "hf_ratio", "centroid", "kurtosis", "spatial_m", "vz_impulse", "second_peak_ms")
RATE = 60.0


def shape_of(t: np.ndarray, hp: np.ndarray, vz: np.ndarray, speed: float, duration_ms: float) -> dict | None:
    """Ten numbers of one hit, or nothing where there are fewer than ten samples."""
    if len(hp) < 10:
        return None
    a = np.abs(hp)
    p = int(a.argmax())
    peak, after, at = float(a[p]), a[p:], t[p:]
    calm = after < 0.3 * peak
    still = np.flatnonzero(calm[:-3] & calm[1:-2] & calm[2:-1]) if len(calm) > 3 else []
    rings = (after[1:-1] > 0.3 * peak) & (after[1:-1] >= after[:-2]) & (after[1:-1] >= after[2:])
    again = np.flatnonzero((after[1:] > 0.6 * peak) & (at[1:] - t[p] <= 250))
    free = hp - hp.mean()
    power = np.abs(np.fft.rfft(free))
    f = np.fft.rfftfreq(len(free), 1 / RATE)
    low, high = float((power[f < 10] ** 2).sum()), float((power[(f >= 10) & (f <= 30)] ** 2).sum())
    spread = float(free.std()) or 1e-9
    return {
        "rise_ms": float(t[p] - t[0]), "decay_ms": float(at[still[0]] - t[p]) if len(still) else None, "ringdown": float(rings.sum()),
        "zc_rate": float((np.diff(np.sign(hp)) != 0).sum()) / max((t[-1] - t[0]) / 1000, 1e-6) * 0.1, "hf_ratio": high / max(low + high, 1e-9), "centroid": float((f * power).sum() / max(power.sum(), 1e-9)),
        "kurtosis": float(((free / spread) ** 4).mean()), "spatial_m": speed * duration_ms / 1000, "vz_impulse": float(np.trapezoid(vz, t) / 1000) / max(peak, 1e-9), "second_peak_ms": float(at[again[0] + 1] - t[p]) if len(again) else 0.0,
    }


#: events are dealt by blocks of so many ms of their start; longer ones than MOST_MS take the join
BLOCK_MS, MOST_MS = 30_000, 10_000
SURROUNDINGS = ("ctx_rms_5s", "ctx_rms_15s", *(f"p2p_{x}" for x in AXES), "contrast_5s", "contrast_15s", "p2p_horiz_max", "p2p_gyro_max")


def over_ranges(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, op: np.ufunc, none: float) -> np.ndarray:
    """op over x[lo:hi] of each pair, in steps of 1, 2, 4, ... places, so that no pair is walked through; `none` where that is empty."""
    out, at, left = np.full(len(lo), none), lo.copy(), np.maximum(hi - lo, 0)
    size, level = 1, x
    while (left >= size).any():
        on = np.flatnonzero(left & size)
        out[on] = op(out[on], level[at[on]])
        at[on] += size
        level = op(level[:-size], level[size:])
        size *= 2
    return out


def surroundings_of(t: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]], t0: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Samples of each hit itself, and SURROUNDINGS of hits t0..t1 among samples in order of time; columns: values, and which are missing."""
    first = lambda x: np.searchsorted(t, x, "left")
    after = lambda x: np.searchsorted(t, x, "right")
    a, z = first(t0 - 150), after(t1 + 400)
    spans = {"own": [(a, z)], "5s": [(first(t0 - 5000), a), (z, after(t1 + 5000))], "15s": [(first(t0 - 15_000), a), (z, after(t1 + 15_000))]}

    def fold(x, which, op, none):
        parts = [over_ranges(x, lo, hi, op, none) for lo, hi in spans[which]]
        return parts[0] if len(parts) == 1 else op(*parts)

    def rms(which):
        x, missing = columns["hp"]
        n = fold((~missing).astype(float), which, np.add, 0.0)
        return np.sqrt(fold(np.where(missing, 0.0, x * x), which, np.add, 0.0) / np.maximum(n, 1))

    def swing(axis, which):
        x, missing = columns[axis]
        top, low = fold(np.where(missing, -np.inf, x), which, np.maximum, -np.inf), fold(np.where(missing, np.inf, x), which, np.minimum, np.inf)
        return np.subtract(top, low, out=np.zeros(len(top)), where=~(top < low))

    with np.errstate(invalid="ignore"):
        own, out = rms("own"), {f"ctx_rms_{k}": rms(k) for k in ("5s", "15s")}
        out |= {f"p2p_{x}": swing(x, "own") / np.maximum(swing(x, "5s"), 1e-9) for x in AXES}
        out |= {f"contrast_{k}": own / np.maximum(out[f"ctx_rms_{k}"], 1e-9) for k in ("5s", "15s")}
    return z - a, out | {"p2p_horiz_max": np.maximum(out["p2p_ax"], out["p2p_ay"]), "p2p_gyro_max": np.maximum(np.maximum(out["p2p_gx"], out["p2p_gy"]), out["p2p_gz"])}


def stray_of(az: np.ndarray) -> float:
    """How far the sliding mean strays from the median; 0 for up to 20 samples."""
    k = max(len(az) // 20, 1)
    return float(np.abs(np.convolve(az, np.ones(k) / k, mode="valid") - np.median(az)).max()) if len(az) > 20 else 0.0


def by_blocks(samples: DataFrame, events: DataFrame, back_ms: int, ahead_ms: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(samples, events) on blocks of a pack's time: events that start in it, samples from back_ms before it to ahead_ms after their latest end.

    samples: pack_id, ts and others; events: pack_id, t0_ms, duration_ms (0 to MOST_MS) and others. A sample goes to the blocks that have events.
    """
    dealt = events.withColumn("block", F.floor(F.col("t0_ms") / BLOCK_MS))
    near = F.sequence(F.floor((F.col("ts") - MOST_MS - ahead_ms) / BLOCK_MS), F.floor((F.col("ts") + back_ms) / BLOCK_MS))
    placed = samples.withColumn("block", F.explode(near)).join(dealt.select("pack_id", "block").distinct(), ["pack_id", "block"], "left_semi")
    return placed.groupBy("pack_id", "block").cogroup(dealt.groupBy("pack_id", "block")).applyInArrow(run, schema)


def column(of: pa.Table, name: str, order: np.ndarray | None = None) -> np.ndarray:
    x = of.column(name).to_numpy()
    return x if order is None else x[order]


def apart(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that blocks can do, and the few that they can't: long ones, and those that share an id, which are one event there."""
    named = events.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("pack_id", "id")))
    short = F.coalesce((F.col("__n") == 1) & F.col("t0_ms").isNotNull() & F.col("duration_ms").between(0, MOST_MS), F.lit(False))
    return named.filter(short).drop("__n"), named.filter(~short).drop("__n")


def candidates(samples: DataFrame, events: DataFrame) -> DataFrame:
    """pack_id, id, SHAPE, SURROUNDINGS and az_drift of events with 8 samples or more: shapes, surroundings and drifts in one pass over the samples.

    samples: pack_id, event_id, t_ms, hp, vz and AXES; events: pack_id, id, t0_ms, duration_ms, speed.
    """
    s = samples.select("pack_id", F.col("event_id").alias("n"), F.col("t_ms").alias("ts"), "hp", "vz", *AXES).filter("ts is not null")
    few, others = apart(events.select("pack_id", "id", "t0_ms", "duration_ms", "speed"))
    names = ["pack_id", "id", *SHAPE, *SURROUNDINGS, "az_drift"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.lexsort([column(left, c) for c in ("vz", "hp", "n", "ts")])
        t, hp, vz = (column(left, c, order) for c in ("ts", "hp", "vz"))
        t0, duration = column(right, "t0_ms"), column(right, "duration_ms")
        n, found = surroundings_of(t, {c: (column(left, c, order), left.column(c).is_null().to_numpy()[order]) for c in ("hp", *AXES)}, t0, t0 + duration)
        kept = np.flatnonzero(n >= 8)
        az = column(left, "az", np.lexsort([column(left, c) for c in ("az", "ts")]))
        time, spans = t.astype(float), [(t0 - 150, t0 + duration + 900), (t0 - 1000, t0 + duration + 1200)]
        (a, z), (b, e) = ((np.searchsorted(t, x, "left"), np.searchsorted(t, y, "right")) for x, y in spans)
        speed = column(right, "speed")
        made = [shape_of(time[a[i] : z[i]], hp[a[i] : z[i]], vz[a[i] : z[i]], float(speed[i]), float(duration[i])) or dict.fromkeys(SHAPE) for i in kept]
        own = {k: pa.array([m[k] for m in made], pa.float64(), from_pandas=True) for k in SHAPE}
        around = {k: pa.array(found[k][kept], pa.float64()) for k in SURROUNDINGS}
        ids = {k: right.column(k).cast(pa.int64()).combine_chunks().take(pa.array(kept)) for k in ("pack_id", "id")}
        drift = pa.array([stray_of(az[b[i] : e[i]]) for i in kept], pa.float64(), from_pandas=True)
        return pa.table(ids | own | around | {"az_drift": drift})

    schema = "pack_id long, id long, " + ", ".join(f"{k} double" for k in names[2:])
    rest = shapes(samples, others).join(surroundings(samples, others), ["pack_id", "id"]).join(drifts(samples, others), ["pack_id", "id"])
    return by_blocks(s, few, 15_000, 15_000, run, schema).unionByName(rest.select(*names))


def shapes(samples: DataFrame, events: DataFrame) -> DataFrame:
    """pack_id, id and the ten shape features of each event; null where there are too few samples.

    samples: pack_id, event_id, t_ms, hp, vz; events: pack_id, id, t0_ms, duration_ms, speed. What is gathered of an event is the second around it.
    """
    s = samples.select("pack_id", F.col("event_id").alias("n"), F.col("t_ms").alias("ts"), "hp", "vz")
    e = events.select("pack_id", "id", "t0_ms", "duration_ms", "speed")
    near = interval_join(s, e, ["pack_id"], "ts", F.col("t0_ms") - 150, F.col("t0_ms") + F.col("duration_ms") + 900, 2000)
    rows = near.groupBy("pack_id", "id", "duration_ms", "speed").agg(F.array_sort(F.collect_list(F.struct("ts", "n", "hp", "vz"))).alias("w"))

    def run(batches):
        for pdf in batches:
            out = []
            for pack, key, duration, speed, w in pdf[["pack_id", "id", "duration_ms", "speed", "w"]].itertuples(index=False):
                t, hp, vz = (np.array([x[k] for x in w], float) for k in ("ts", "hp", "vz"))
                found = shape_of(t, hp, vz, float(speed), float(duration)) or dict.fromkeys(SHAPE)
                out.append((pack, key, *(found[k] for k in SHAPE)))
            yield pd.DataFrame(out, columns=["pack_id", "id", *SHAPE])

    return rows.mapInPandas(run, "pack_id long, id long, " + ", ".join(f"{k} double" for k in SHAPE))


def surroundings(samples: DataFrame, events: DataFrame) -> DataFrame:
    """pack_id, id, ctx_rms and contrast within 5 and 15 s, each axis' swing over that of 5 s around, the largest of two groups of axes.

    samples: pack_id, t_ms, hp and AXES; events: pack_id, id, t0_ms, duration_ms. One interval join over the widest window, then
    conditional aggregates; events of fewer than 8 samples are left out.
    """
    s = samples.select("pack_id", F.col("t_ms").alias("ts"), "hp", *AXES)
    e = events.select("pack_id", "id", "t0_ms", (F.col("t0_ms") + F.col("duration_ms")).alias("t1_ms"))
    near = interval_join(s, e, ["pack_id"], "ts", F.col("t0_ms") - 15_000, F.col("t1_ms") + 15_000, 15_000)
    own = F.col("ts").between(F.col("t0_ms") - 150, F.col("t1_ms") + 400)
    around = ~own & F.col("ts").between(F.col("t0_ms") - 5000, F.col("t1_ms") + 5000)
    rms = lambda where: F.coalesce(F.sqrt(F.avg(F.when(where, F.col("hp") * F.col("hp")))), F.lit(0.0))
    swing = lambda axis, where: F.coalesce(F.max(F.when(where, F.col(axis))) - F.min(F.when(where, F.col(axis))), F.lit(0.0))
    ratios = [(swing(x, own) / F.greatest(swing(x, around), F.lit(1e-9))).alias(f"p2p_{x}") for x in AXES]
    agg = near.groupBy("pack_id", "id").agg(F.count_if(own).alias("n"), rms(own).alias("own"), rms(around).alias("ctx_rms_5s"), rms(~own).alias("ctx_rms_15s"), *ratios).filter("n >= 8")
    contrast = lambda c: F.col("own") / F.greatest(c, F.lit(1e-9))
    out = agg.withColumn("contrast_5s", contrast("ctx_rms_5s")).withColumn("contrast_15s", contrast("ctx_rms_15s"))
    return out.withColumn("p2p_horiz_max", F.greatest("p2p_ax", "p2p_ay")).withColumn("p2p_gyro_max", F.greatest("p2p_gx", "p2p_gy", "p2p_gz")).drop("n", "own")


def drifts(samples: DataFrame, events: DataFrame) -> DataFrame:
    """pack_id, id, az_drift: how far the sliding mean of az strays from its median between 1 s before and 1.2 s after; 0 for up to 20 samples."""
    s = samples.select("pack_id", F.col("t_ms").alias("ts"), "az")
    e = events.select("pack_id", "id", "t0_ms", (F.col("t0_ms") + F.col("duration_ms")).alias("t1_ms"))
    near = interval_join(s, e, ["pack_id"], "ts", F.col("t0_ms") - 1000, F.col("t1_ms") + 1200, 3000)
    rows = near.groupBy("pack_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "az"))), lambda x: x["az"]).alias("az"))

    @F.pandas_udf("double")
    def stray(windows: pd.Series) -> pd.Series:
        return windows.map(lambda x: stray_of(np.asarray(x, float)))

    return rows.select("pack_id", "id", stray("az").alias("az_drift"))


def decay_ms(samples: DataFrame, events: DataFrame, share: float = 0.3) -> DataFrame:
    """pack_id, id, decay_ms: from an event's strongest sample to the first one below `share` of it that is still below three samples on.

    The last sample of the window stands for samples beyond it. samples: pack_id, event_id, t_ms, hp; events: pack_id, id, t0_ms, duration_ms.
    """
    s = samples.select("pack_id", F.col("event_id").alias("n"), F.col("t_ms").alias("ts"), F.abs("hp").alias("a"))
    e = events.select("pack_id", "id", "t0_ms", "duration_ms")
    near = interval_join(s, e, ["pack_id"], "ts", F.col("t0_ms") - 150, F.col("t0_ms") + F.col("duration_ms") + 900, 2000)
    w = Window.partitionBy("pack_id", "id")
    top = near.withColumn("top", F.max(F.struct("a", -F.col("ts"), -F.col("n"))).over(w))
    after = top.withColumn("peak", F.col("top.a")).withColumn("peak_ms", -F.col("top.col2")).filter("ts > peak_ms or (ts = peak_ms and n >= -top.col3)")
    o = w.orderBy("ts", "n")
    below = (F.col("a") < share * F.col("peak")).cast("int")
    last = F.last("below").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    then = after.withColumn("below", below).withColumn("then", F.coalesce(F.lead("below", 3).over(o), last))
    return then.groupBy("pack_id", "id").agg(F.min(F.when((F.col("below") == 1) & (F.col("then") == 1), F.col("ts") - F.col("peak_ms"))).alias("decay_ms"))


def ranked(features: DataFrame, truth: Column, names: list[str]) -> DataFrame:
    """feature, auc, verdict of every feature: how well it parts hits from the rest, by ranks."""
    from .evaluate import rank_auc

    long = features.withColumn("pos", truth).select("pos", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("score")) for n in names])).alias("x")).select("pos", "x.*").filter("score is not null and pos is not null")
    return rank_auc(long, ["feature"], "score", "pos")


#: fixed value: a peak within so many milliseconds of a true hit (not as many) has found it
NEAR_MS = 600


def grid(prepared: DataFrame, truths: DataFrame, fs: float = 100.0, ks: tuple[float, ...] = (3.0, 4.0, 5.0, 6.0)) -> DataFrame:
    """variant, k, recall, false_alarms: means over rides of peaks against true hits (within 0.6 s), for each way to find the floor.

    prepared: pack_id (a ride), t_ms, event_id, bp_mag; truths: pack_id, t_ms.
    """
    floors = [(f"std {w:g} s", w, None) for w in (1.0, 2.0, 3.0)] + [(f"quantile {q:g} of {w:g} s", w, q) for w in (2.0, 3.0, 5.0) for q in (0.1, 0.2, 0.3)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, t, out = pdf.sort_values(["t_ms", "event_id"])["bp_mag"].to_numpy(float), np.sort(pdf["t_ms"].to_numpy()), []
        base = bases(x)
        for name, w, q in floors:
            n = max(8, int(w * fs))
            if q is None:
                floor = np.maximum(pd.Series(x).rolling(n, center=True, min_periods=1).std().fillna(0.2), 0.2).to_numpy()
            else:
                floor = np.maximum(pd.Series(np.abs(x)).rolling(n, center=True, min_periods=max(4, n // 4)).quantile(q).bfill().ffill().fillna(0.0), v.NOISE_FLOOR).to_numpy()
            for k in ks:
                p = find_peaks(x, np.maximum(v.MIN_THRESHOLD, k * floor), np.maximum(v.MIN_THRESHOLD / 2, k / 2 * floor), max(1, int(0.04 * fs)), base)
                kept = p[np.diff(p, prepend=-(10**9)) >= 0.3 * fs]
                out += [(key[0], name, k, int(at)) for at in t[kept]]
        return pd.DataFrame(out, columns=["pack_id", "variant", "k", "t_ms"])

    peaks = prepared.select("pack_id", "t_ms", "event_id", "bp_mag").groupBy("pack_id").applyInPandas(run, "pack_id long, variant string, k double, t_ms long")
    pairs = truths.select("pack_id", F.col("t_ms").alias("true_ms"))
    settings = peaks.sparkSession.createDataFrame([(name, k) for name, *_ in floors for k in ks], "variant string, k double")
    near = interval_join(pairs, peaks, ["pack_id"], "true_ms", F.col("t_ms") - NEAR_MS + 1, F.col("t_ms") + NEAR_MS - 1, 2 * NEAR_MS)
    hits = near.select("variant", "k", "pack_id", "true_ms").distinct().groupBy("variant", "k", "pack_id").agg(F.count(F.lit(1)).alias("hit"))
    n = peaks.groupBy("variant", "k", "pack_id").agg(F.count(F.lit(1)).alias("n"))
    rides = settings.join(truths.groupBy("pack_id").agg(F.count(F.lit(1)).alias("true")), how="cross")  # 48 settings a ride
    all_ = rides.join(hits, ["variant", "k", "pack_id"], "left").join(n, ["variant", "k", "pack_id"], "left").fillna(0, ["hit", "n"])
    return all_.groupBy("variant", "k").agg(F.avg(F.col("hit") / F.col("true")).alias("recall"), F.avg(F.col("n") - F.col("hit")).alias("false_alarms"))


def best(settings: DataFrame, least_recall: float = 0.95, most_false: float = 0.2, limit: int = 10) -> DataFrame:
    """The settings that will do, fewest false alarms first."""
    return settings.filter((F.col("recall") >= least_recall) & (F.col("false_alarms") <= most_false)).orderBy("false_alarms", F.desc("recall"), "variant", "k").limit(limit)
