"""Per-pack time series: gaps, rolling statistics, folds, resampling, islands. All windows are keyed by pack_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.scalar import threshold
from .folds import CenteredQuantile, Ema, TrailingQuantile, appended

PACK = ["pack_id"]


def in_time(order: list[str] | None = None):
    return Window.partitionBy(*PACK).orderBy(*(order or ["t_ms", "event_id"]))


def in_range(back_ms: int, ahead_ms: int = 0):
    return Window.partitionBy(*PACK).orderBy("t_ms").rangeBetween(-back_ms, ahead_ms)


def recorded() -> list[Column]:
    """The order in which samples were recorded: by event_id, of one event_id by time; what has none comes last, as in SQL."""
    return [F.col(c).asc_nulls_last() for c in ("event_id", "t_ms")]


def gaps(samples: DataFrame, gap_ms: int = 800) -> DataFrame:
    """Counts of repeated, backward and long steps per pack, in recorded order."""
    dt = F.col("t_ms") - F.lag("t_ms").over(in_time(recorded()))
    return samples.withColumn("dt", dt).groupBy(*PACK).agg(F.count_if(F.col("dt") == 0).alias("repeated"), F.count_if(F.col("dt") < 0).alias("backward"), F.count_if(F.col("dt") > gap_ms).alias("long_gaps"))


def source_rate(samples: DataFrame, fallback: float = 100.0) -> DataFrame:
    """Sampling rate from the median positive step, and from its upper-middle element."""
    stepped = samples.withColumn("dt", F.col("t_ms") - F.lag("t_ms").over(in_time()))
    # a row for each length of step, however many steps there are
    counts = stepped.filter("dt > 0").groupBy(*PACK, "dt").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(*PACK)
    ranked = counts.withColumns({"upto": F.sum("c").over(by.orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.sum("c").over(by)})
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(k), F.col("dt")))
    found = ranked.groupBy(*PACK).agg(at((F.col("n") - 1) / 2).alias("lower"), at(F.col("n") / 2).alias("upper"))
    rates = samples.select(*PACK).distinct().join(found, PACK, "left")
    return rates.select(*PACK, F.coalesce(2000.0 / (F.col("lower") + F.col("upper")), F.lit(fallback)).alias("fs"), F.coalesce(1000.0 / F.col("upper"), F.lit(fallback)).alias("fs_upper"))


def rolling_rms(x: str = "hp", ms: int = v.RMS_MS) -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)).over(in_range(ms)))


def rolling_quantile(samples: DataFrame, name: str, x: str = "hp", ms: int = v.QUANTILE_MS, q: float = v.NOISE_QUANTILE) -> DataFrame:
    """Adds the quantile of |x| over the last `ms`: an ordered window slides along each pack, in linear time."""
    return appended(samples, name, x, lambda: TrailingQuantile(ms, q))


def noise_threshold(samples: DataFrame, version: float) -> DataFrame:
    """Adds thr by the formula of the recording's version."""
    if version >= 0.8:
        return samples.withColumn("thr", threshold(rolling_rms()))
    return rolling_quantile(samples, "noise").withColumn("thr", threshold(F.col("noise"))).drop("noise")


def centered_quantile_floor(samples: DataFrame, width: int, q: float = v.NOISE_QUANTILE, floor: float = v.NOISE_FLOOR, x: str = "hp") -> DataFrame:
    """Quantile of |x| in a frame of `width` rows around each, then filled backward and forward."""
    out = appended(samples, "raw", x, lambda: CenteredQuantile(width, q, max(4, width // 4)))
    upto = (Window.unboundedPreceding, Window.currentRow)
    # a frame up to the current row is linear; one that reaches ahead to the end is not
    back = F.last("raw", ignorenulls=True).over(in_time([F.desc("t_ms"), F.desc("event_id")]).rowsBetween(*upto))
    ahead = F.last("raw", ignorenulls=True).over(in_time().rowsBetween(*upto))
    return out.withColumn("floor", F.greatest(F.coalesce("raw", back, ahead), F.lit(floor))).drop("raw")


def centered_std_floor(samples: DataFrame, width: int, floor: float = 0.2, x: str = "hp") -> DataFrame:
    frame = in_time().rowsBetween(-(width // 2), width - width // 2 - 1)
    return samples.withColumn("floor", F.greatest(F.coalesce(F.stddev_samp(x).over(frame), F.lit(floor)), F.lit(floor)))


def islands(samples: DataFrame, flag: Column, gap_ms: int = 500) -> DataFrame:
    """Runs of flagged samples; a longer gap than gap_ms parts them."""
    hit = samples.filter(flag)
    new = (F.col("t_ms") - F.lag("t_ms").over(in_time()) > gap_ms).cast("int")
    marked = hit.withColumn("segment", F.sum(F.coalesce(new, F.lit(0))).over(in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*PACK, "segment").agg(F.min("t_ms").alias("t0_ms"), F.max("t_ms").alias("t1_ms"), F.count(F.lit(1)).alias("n"), F.max(F.abs("hp")).alias("peak")).withColumn("ms", F.col("t1_ms") - F.col("t0_ms"))


def longest(segments: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy(*PACK).orderBy(F.desc("ms"), "t0_ms")
    return segments.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def ema(samples: DataFrame, x: str = "hp") -> DataFrame:
    """Time-aware exponential smoothing of a signal: pack_id, t_ms, event_id, ema."""
    return appended(samples.select(*PACK, "t_ms", "event_id", x), "ema", x, Ema).drop(x)


def resample(samples: DataFrame, step_ms: int, columns: list[str], held: tuple[str, ...] = ()) -> DataFrame:
    """Linear interpolation on a uniform grid from each pack's first to last sample; of `held` columns the last sample's value at or
    before, of one time that of the largest event_id.

    Each sample gives the grid's points up to the next one, so only samples are sorted, however many points lie between them.
    """
    p = [F.avg(c).alias(c) for c in columns] + ([F.max_by(F.struct(*held), "event_id").alias("__held")] if held else [])
    # a set number of partitions: they are small here, and would be put together to a few before the points are made
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    once = samples.filter("t_ms is not null").repartition(parts, *PACK).groupBy(*PACK, "t_ms").agg(*p).withColumnRenamed("t_ms", "__t")
    order = Window.partitionBy(*PACK).orderBy("__t")
    first = F.first("__t").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step, t = F.lit(step_ms).cast("bigint"), F.col("__t")
    spans = once.withColumns({"__a": first, "__q": F.lead(F.struct("__t", *columns)).over(order)})
    # the first point at or after the sample, and the last one before the next sample
    begin = F.col("__a") + F.expr(f"(__t - __a + {step_ms - 1}) div {step_ms}") * step
    end = F.col("__a") + F.expr(f"(coalesce(__q.__t - 1, __t) - __a) div {step_ms}") * step
    points = spans.withColumns({"__b": begin, "__e": end}).filter("__b <= __e").withColumn("t_ms", F.explode(F.sequence("__b", "__e", step)))
    at = F.col("t_ms") == t
    w = F.when(at, 0.0).otherwise((F.col("t_ms") - t) / (F.col("__q.__t") - t))
    q = lambda c: F.when(at, F.col(c)).otherwise(F.col(f"__q.{c}"))
    return points.select(*PACK, "t_ms", *[(F.col(c) + (q(c) - F.col(c)) * w).alias(c) for c in columns], *[F.col(f"__held.{c}").alias(c) for c in held])


def step_hold(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """As-of join: for each left row the last right row at or before it, else the pack's first one."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.select(*PACK, "t_ms", *columns).withColumn("side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*PACK).orderBy("t_ms", "side")
    held = F.last(F.when(F.col("side") == 0, F.struct(*columns)), True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first(F.when(F.col("side") == 0, F.struct(*columns)), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = [c for c in left.columns]
    out = both.withColumn("h", F.coalesce(held, first)).filter("side = 1")
    return out.select(*own, *[F.col(f"h.{c}").alias(c) for c in columns])


def sliding_windows(samples: DataFrame, width: int = 64, hop: int = 32) -> DataFrame:
    """Each sample once for every complete window of rows that holds it: adds window."""
    i = F.row_number().over(in_time()) - 1
    rows = samples.withColumn("i", i).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PACK)))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (width - 1)) / hop)).cast("int")
    last = F.least(F.floor(F.col("i") / hop), F.floor((F.col("n") - width) / hop)).cast("int")
    return rows.filter((F.col("n") >= width) & (first <= last)).withColumn("window", F.explode(F.sequence(first, last)))


def majority(df: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """The most frequent label per key; the one seen first wins a tie."""
    seen = df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = seen.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("p"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("c"), -F.col("p"))).alias(label))


def merge_peaks(peaks: DataFrame, gap_ms: int = 300) -> DataFrame:
    """The first of each burst: a peak goes if the one before, kept or not, is nearer than gap_ms."""
    before = F.lag("t_ms").over(in_time())
    return peaks.withColumn("before", before).filter(F.col("before").isNull() | (F.col("t_ms") - F.col("before") >= gap_ms)).drop("before")


def local_maxima(samples: DataFrame, height: Column, x: str = "hp") -> DataFrame:
    w = in_time()
    return samples.withColumn("l", F.lag(x).over(w)).withColumn("r", F.lead(x).over(w)).filter((F.col(x) > F.col("l")) & (F.col(x) > F.col("r")) & (F.col(x) >= height)).drop("l", "r")


def window_features(rows: DataFrame, keys: list[str], x: str, fs: float) -> DataFrame:
    """Moments of mean-free windows; null where a window has under 8 samples or no amplitude."""
    w = Window.partitionBy(*keys)
    free = rows.withColumn("w", F.col(x) - F.avg(x).over(w))
    free = free.withColumn("peak", F.max(F.abs("w")).over(w)).withColumn("turn", (F.signum("w") < 0) != (F.signum(F.lag("w").over(w.orderBy("t_ms", "event_id"))) < 0))
    agg = free.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("peak").alias("peak"),
        F.sqrt(F.avg(F.col("w") * F.col("w"))).alias("rms"),
        F.avg(F.pow("w", F.lit(4))).alias("m4"),
        F.avg(F.pow("w", F.lit(3))).alias("m3"),
        F.avg(F.pow("w", F.lit(2))).alias("m2"),
        F.count_if(F.abs("w") > 0.3 * F.col("peak")).alias("over"),
        F.sum(F.when(F.abs("w") > 0.3 * F.col("peak"), F.abs("w")).otherwise(0.0)).alias("active"),
        F.count_if("turn").alias("zero_crossings"),
        F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0.0)).alias("up"),
        F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)).alias("down"),
    )
    ok = (F.col("n") >= 8) & (F.col("peak") >= 1e-9)
    values = {
        "peak": F.col("peak"), "rms": F.col("rms"), "kurtosis": F.col("m4") / F.pow("m2", F.lit(2)), "skew": F.col("m3") / F.pow("m2", F.lit(1.5)),
        "duration": F.col("over") / fs, "impulse": F.col("active") / fs, "zero_crossings": F.col("zero_crossings").cast("double"),
        "asymmetry": F.when(F.col("down") <= 1e-6, 5.0).otherwise(F.col("up") / F.col("down")),
    }
    return agg.select(*keys, *[F.when(ok, x).alias(name) for name, x in values.items()])


def stride(rows: DataFrame, most: int = 48) -> DataFrame:
    """At most about `most` evenly spaced samples of each pack."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*PACK))
    step = F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    return rows.withColumn("step", step).withColumn("i", F.row_number().over(in_time()) - 1).filter(F.col("i") % F.col("step") == 0)


def profile(samples: DataFrame, bucket_ms: int = 5000) -> DataFrame:
    return samples.groupBy(*PACK, F.floor(F.col("t_ms") / bucket_ms).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("hp")).alias("peak"), F.sqrt(F.avg(F.col("hp") * F.col("hp"))).alias("rms"))
