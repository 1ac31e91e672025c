"""Zero-phase filters and peaks of one recording over many tasks.

Blocks of `block_rows` grid samples are rows with an array, so a block's work is one call and no task holds a recording.

A cascade of second-order sections is linear: a block ends in P(rows) * start + own, where own is what it ends with from rest and P a power of
the cascade's transition matrix. So a first pass runs every block from rest, a scan over blocks (two numbers a section and column for each) gives
the true starts, and a second pass runs from those; the second pass also sums up the way back, which a third one runs.

Prominence needs the lowest value since higher ground on either side. A block passes on its staircase: the values that are
higher than all behind them in the block, with the lowest value since. The scan merges staircases to a stack; a block's own peaks ask it for what lies before the block.
Flat tops may cross borders: the open run of equal values is the state of a fold whose blocks run again until their starts agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import vocab as v
from . import spectral
from .blocks import BLOCK_MS, KEYS, blocked, started
from .folds import reduced
from .graph import cut

BLOCK_ROWS = 8192


def numbered(samples: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """samples with i, the row's number in its pack by t_ms and event_id from 0: counts of blocks are summed up, rows are numbered in blocks."""
    rows = blocked(samples, block_ms)
    before = Window.partitionBy("pack_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).select(*KEYS, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*KEYS).orderBy("t_ms", "event_id")) - 1
    return rows.withColumn("i", inside).join(starts, list(KEYS)).withColumn("i", F.col("start") + F.col("i")).drop("start", "block")


def in_blocks(rows: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS, offset: int = 0) -> DataFrame:
    """pack_id, block, at (the first row's number), v (array of structs of the columns): rows (pack_id, i, columns) by stretches of i."""
    block = F.floor((F.col("i") + offset) / block_rows)
    arrays = rows.withColumn("block", block).groupBy(*KEYS).agg(F.min("i").alias("at"), F.sort_array(F.collect_list(F.struct("i", *columns))).alias("v"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(arrays.repartition(n, *KEYS))


def over_blocks(blocks: DataFrame, work: Callable, result: str, *more: str) -> DataFrame:
    """pack_id, block and what work(columns as arrays, *more of the row) gives as a tuple of lists or numbers."""
    schema = T.StructType.fromDDL(f"pack_id long, block long, {result}")
    kind = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, size = batch.column("v").flatten(), batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in range(1, flat.type.num_fields)]
            ends = np.cumsum(size)
            out = []
            for pack, block, b, n, *rest in zip(*(batch.column(c).to_pylist() for c in KEYS), ends.tolist(), size.tolist(), *(batch.column(c).to_pylist() for c in more)):
                out.append((pack, block, *work([c[b - n : b] for c in columns], *rest)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return blocks.select(*KEYS, "v", *more).mapInArrow(run, schema)


# ---- sections with a state


def run_from(sections, x: np.ndarray, state: list[float]) -> tuple[list[float], list[float]]:
    """Values filtered from a state of two numbers for each section, and the state in which that ends."""
    values, out = x.tolist(), []
    for k, (b, a) in enumerate(sections):
        b0, b1, b2 = b.tolist()
        _, a1, a2 = a.tolist()
        z1, z2 = state[2 * k], state[2 * k + 1]
        done = []
        for value in values:
            y = b0 * value + z1
            z1 = b1 * value - a1 * y + z2
            z2 = b2 * value - a2 * y
            done.append(y)
        values = done
        out += [z1, z2]
    return values, out


def steady(sections, value: float) -> list[float]:
    """The state in which a constant input has settled."""
    out = []
    for b, a in sections:
        gain = b.sum() / a.sum()
        z2 = (b[2] - a[2] * gain) * value
        out += [(b[1] - a[1] * gain) * value + z2, z2]
        value *= gain
    return [float(x) for x in out]


def transition(sections) -> np.ndarray:
    """What a step without input makes of a state."""
    unit = np.eye(2 * len(sections))
    return np.array([run_from(sections, np.zeros(1), unit[k].tolist())[1] for k in range(len(unit))]).T


class Starts:
    """From what blocks do, in order, the state that each starts in."""

    def __init__(self, sections):
        self.sections, self.step, self.powers, self.state = sections, transition(sections), {}, None

    def push(self, _: int, block: int, rows: int, first: list[float], own: list[float]) -> list:
        size = 2 * len(self.sections)
        if self.state is None:
            self.state = [s for x in first for s in steady(self.sections, x)]
        out = (block, self.state)
        power = self.powers.setdefault(rows, np.linalg.matrix_power(self.step, rows))
        states, own_states = np.array(self.state).reshape(-1, size), np.array(own).reshape(-1, size)
        self.state = (states @ power.T + own_states).ravel().tolist()
        return [out]

    def end(self) -> list:
        return []


def starts_of(summed: DataFrame, sections, sign: int) -> DataFrame:
    ordered = summed.select("pack_id", (sign * F.col("block")).alias("t_ms"), F.lit(0).alias("event_id"), "block", "rows", "first", "own")
    found = reduced(ordered, ("t_ms", "block", "rows", "first", "own"), lambda: Starts(sections), "number bigint, start array<double>")
    return cut(found.withColumnRenamed("number", "block"))


SUM = "rows long, first array<double>, own array<double>"


def zero_phase(rows: DataFrame, sections, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pack_id, i and the columns filtered forward and backward, with odd extension at both ends.

    rows: pack_id, i (0, 1, ... without gaps in each pack), columns (double, no nulls).
    """
    pad, size = 3 * (2 * len(sections) + 1), 2 * len(sections)
    values = F.struct(*columns)
    ends = rows.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(values, "i").alias("first"), F.max_by(values, "i").alias("last"))
    near = rows.join(ends, "pack_id").withColumn("pad", F.least(F.lit(pad), F.col("n") - 1))
    mirrored = lambda at, edge: [at.alias("i"), *((2 * F.col(f"{edge}.{c}") - F.col(c)).alias(c) for c in columns)]
    head = near.filter("i between 1 and pad").select("pack_id", *mirrored(-F.col("i"), "first"))
    tail = near.filter("i between n - 1 - pad and n - 2").select("pack_id", *mirrored(2 * (F.col("n") - 1) - F.col("i"), "last"))
    blocks = in_blocks(rows.select("pack_id", "i", *columns).unionByName(head).unionByName(tail), columns, block_rows, pad)

    def rest(xs: list[np.ndarray]) -> tuple:
        return len(xs[0]), [float(x[0]) for x in xs], [s for x in xs for s in run_from(sections, x, [0.0] * size)[1]]

    def forward(xs: list[np.ndarray], start: list[float]) -> tuple:
        ys = [run_from(sections, x, start[k * size : (k + 1) * size])[0] for k, x in enumerate(xs)]
        back = [np.array(y[::-1]) for y in ys]
        return (*rest(back), [y for one in ys for y in one])

    def backward(_: list[np.ndarray], ys: list[float], start: list[float]) -> tuple:
        n = len(ys) // len(columns)
        return ([y for k in range(len(columns)) for y in run_from(sections, np.array(ys[k * n : (k + 1) * n])[::-1], start[k * size : (k + 1) * size])[0][::-1]],)

    known, _ = started(blocks, starts_of(over_blocks(blocks, rest, SUM), sections, 1))
    there = cut(over_blocks(known, forward, f"{SUM}, ys array<double>", "start"))
    back, _ = started(blocks.join(there.select(*KEYS, "ys"), list(KEYS)), starts_of(there, sections, -1))
    done = over_blocks(back, backward, "zs array<double>", "ys", "start").join(blocks.select(*KEYS, "at"), list(KEYS))
    n = F.size("zs") / len(columns)
    cells = done.select("pack_id", "at", "zs", n.cast("int").alias("n"), F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("k"))
    found = cells.select("pack_id", (F.col("at") + F.col("k")).alias("i"), *(F.get("zs", F.col("k") + j * F.col("n")).alias(c) for j, c in enumerate(columns)))
    found = found.join(ends.select("pack_id", F.col("n").alias("all"), F.col("first").alias("only")), "pack_id").filter("i >= 0 and i < all")
    # a single value stays as it is
    return found.select("pack_id", "i", *(F.when(F.col("all") == 1, F.col(f"only.{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def prepare(resampled: DataFrame, fs: float = 100.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As spectral.prepare: pack_id, t_ms, event_id, lin_mag, vz, bp_mag, bp_vz; resampled: pack_id, t_ms, ax, ay, az on a grid of whole steps."""
    step = int(1000 / fs)
    begin = resampled.groupBy("pack_id").agg(F.min("t_ms").alias("t0"))
    rows = resampled.join(begin, "pack_id").select("pack_id", "t_ms", F.floor((F.col("t_ms") - F.col("t0")) / step).alias("i"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ax", "ay", "az")))
    rows = cut(rows)
    slow = zero_phase(rows, spectral.butterworth(4, 0.5, fs, "low"), ["ax", "ay", "az"], block_rows)
    both = rows.join(slow.select("pack_id", "i", *(F.col(c).alias(f"g{c[1]}") for c in ("ax", "ay", "az"))), ["pack_id", "i"])
    axes = [(F.col(f"a{k}") - F.col(f"g{k}"), F.col(f"g{k}")) for k in "xyz"]
    total = lambda xs: xs[0] + xs[1] + xs[2]
    gravity = F.greatest(F.sqrt(total([g * g for _, g in axes])), F.lit(1e-6))
    motion = cut(both.select("pack_id", "i", "t_ms", F.sqrt(total([f * f for f, _ in axes])).alias("lin_mag"), (total([f * g for f, g in axes]) / gravity).alias("vz")))
    band = zero_phase(motion.select("pack_id", "i", F.col("lin_mag").alias("bp_mag"), F.col("vz").alias("bp_vz")), spectral.butterworth_band(4, 1.0, min(20.0, 0.45 * fs), fs), ["bp_mag", "bp_vz"], block_rows)
    return motion.join(band, ["pack_id", "i"]).select("pack_id", "t_ms", F.col("i").alias("event_id"), "lin_mag", "vz", "bp_mag", "bp_vz")


# ---- peaks

INF = float("inf")


def staircase(x: list[float]) -> tuple[list[float], list[float], float]:
    """Seen from the end backwards: values higher than all behind them, the lowest value between each and the one behind, the lowest before the last."""
    heights, lows, low, top = [], [], INF, -INF
    for value in reversed(x):
        if value > top:
            heights.append(value)
            lows.append(low)
            low, top = INF, value
        else:
            low = min(low, value)
    return heights, lows, low


def climb(heights: list[float], lows: list[float], rest: float, height: float) -> float:
    """The lowest value of a staircase on the way to ground higher than `height`, or in all of it."""
    low = INF
    for h, between in zip(heights, lows):
        low = min(low, between)
        if h > height:
            return low
        low = min(low, h)
    return min(low, rest)


class Stairs:
    """From the blocks' staircases, in order, that of all blocks before each."""

    def __init__(self):
        self.heights, self.lows, self.rest = [], [], INF

    def push(self, _: int, block: int, heights: list[float], lows: list[float], rest: float) -> list:
        out = (block, self.heights, self.lows, self.rest)
        top, low = heights[0] if len(heights) == 1 else max(heights), rest
        kept = [k for k, h in enumerate(self.heights) if h > top]
        first = kept[0] if kept else len(self.heights)
        low = min([low, *self.lows[: first + 1], *self.heights[:first]])
        if kept:
            self.heights, self.lows = heights + self.heights[first:], lows + [low, *self.lows[first + 1 :]]
        else:
            self.heights, self.lows, self.rest = heights, lows, min(low, self.rest)
        return [out]

    def end(self) -> list:
        return []


class BorderTops:
    """Flat tops that touch a border of a block, from each block's first and last run of equal values."""

    def __init__(self):
        self.value, self.begin, self.rising = None, 0, False

    def close(self, end: int, after: float) -> list:
        return [((self.begin + end) // 2,)] if self.rising and after < self.value else []

    def push(self, _: int, at: int, n: int, first: float, first_n: int, second: float | None, last: float, last_n: int, before_last: float | None) -> list:
        out = []
        if self.value is None or first != self.value:
            if self.value is not None:
                out += self.close(at - 1, first)
            self.rising = self.value is not None and first > self.value
            self.value, self.begin = first, at
        if first_n < n:
            out += self.close(at + first_n - 1, second)
            self.value, self.begin, self.rising = last, at + n - last_n, last > before_last
        return out

    def end(self) -> list:
        return []


def runs(x: np.ndarray) -> tuple:
    """n, first value, its run's length, the next value, last value, its run's length, the value before."""
    change = np.flatnonzero(x[1:] != x[:-1])
    if not len(change):
        return len(x), float(x[0]), len(x), None, float(x[-1]), len(x), None
    a, b = int(change[0]), int(change[-1])
    return len(x), float(x[0]), a + 1, float(x[a + 1]), float(x[-1]), len(x) - b - 1, float(x[b])


def block_prominences(x: np.ndarray, p: np.ndarray, before: tuple, after: tuple) -> np.ndarray:
    """Of values p of a block, with the staircases of what lies before and after it."""

    def lowest(y: np.ndarray, at: np.ndarray, stairs: tuple) -> np.ndarray:
        own = np.array(spectral.lowest_since_higher(y.tolist()))[at]
        record = np.maximum.accumulate(y)[at] <= y[at]  # nothing higher in the block on this side
        for k in np.flatnonzero(record).tolist():
            own[k] = min(own[k], climb(*stairs, y[at[k]]))
        return own

    left, right = lowest(x, p, before), lowest(x[::-1], len(x) - 1 - p, after)
    return x[p] - np.maximum(left, right)


def peaks(ready: DataFrame, fs: float = 100.0, k: float = v.NOISE_FACTOR, least: float = v.MIN_THRESHOLD, x: str = "bp_mag", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As spectral.peaks; ready: pack_id, t_ms, event_id (0, 1, ... in each pack), x, floor."""
    rows = ready.select("pack_id", F.col("event_id").alias("i"), F.col(x).alias("x"), "floor", F.col("t_ms").cast("double").alias("t"))
    blocks = in_blocks(rows, ["x", "floor", "t"], block_rows)
    edge = "n long, first double, first_n long, second double, last double, last_n long, before_last double"
    stairs = lambda side: f"h_{side} array<double>, l_{side} array<double>, r_{side} double"
    facts = cut(over_blocks(blocks, lambda c: (*runs(c[0]), *staircase(c[0].tolist()), *staircase(c[0][::-1].tolist())), f"{edge}, {stairs('left')}, {stairs('right')}").join(blocks.select(*KEYS, "at"), list(KEYS)))
    ordered = lambda sign: facts.withColumns({"t_ms": sign * F.col("block"), "event_id": F.lit(0)})
    borders = reduced(ordered(1), ("t_ms", "at", *(c.split()[0] for c in edge.split(", "))), BorderTops, "i bigint")
    borders = borders.withColumn("block", F.floor(F.col("i") / block_rows)).groupBy(*KEYS).agg(F.collect_list("i").alias("borders"))
    side = lambda sign, name: reduced(ordered(sign), ("t_ms", "block", f"h_{name}", f"l_{name}", f"r_{name}"), Stairs, f"number bigint, {stairs(name)}").withColumnRenamed("number", "block")

    def found(columns: list[np.ndarray], at: int, borders: list[int] | None, *stairs) -> tuple:
        y, floor, t = columns
        p = np.unique(np.concatenate([spectral.local_maxima(y), np.array(borders or [], dtype=np.int64) - at]))
        p = p[y[p] >= np.maximum(least, k * floor[p])]
        prominent = block_prominences(y, p, stairs[:3], stairs[3:]) if len(p) else y[p]
        return ([(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(p + at, y[p], prominent - np.maximum(least / 2, k / 2 * floor[p]), t[p])],)

    known, _ = started(blocks, cut(side(1, "left").join(side(-1, "right"), list(KEYS)).join(borders, list(KEYS), "left")))
    shape = "array<struct<i:double,x:double,over:double,t:double>>"
    tops = over_blocks(known, lambda *a: ([dict(zip(("i", "x", "over", "t"), q)) for q in found(*a)[0]],), f"p {shape}", "at", "borders", *(f"{c}_{s}" for s in ("left", "right") for c in "hlr"))
    tops = tops.select("pack_id", F.explode("p").alias("p")).select("pack_id", F.col("p.i").cast("long").alias("i"), "p.x", "p.over", F.col("p.t").cast("long").alias("t"))
    long_enough = facts.groupBy("pack_id").agg(F.sum("n").alias("all")).filter(F.col("all") >= int(2 * fs) + 8).select("pack_id")
    kept = apart(tops.join(long_enough, "pack_id", "left_semi"), max(1, int(0.04 * fs))).filter("over >= 0")
    return kept.select("pack_id", F.col("t").alias("t_ms"), F.col("i").alias("event_id"), F.col("x").alias(x))


def apart(tops: DataFrame, distance: int) -> DataFrame:
    """Peaks with those nearer than `distance` to a higher kept one left out. A gap of that size parts peaks that have no bearing on each other."""
    order = Window.partitionBy("pack_id").orderBy("i")
    new = F.coalesce(F.col("i") - F.lag("i").over(order) >= distance, F.lit(True)).cast("long")
    islands = tops.withColumn("island", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def run(pdf):
        pdf = pdf.sort_values("i")
        at, keep = pdf["i"].to_numpy(), np.ones(len(pdf), bool)
        for j in np.argsort(pdf["x"].to_numpy(), kind="stable")[::-1].tolist():
            if keep[j]:
                keep &= (np.abs(at - at[j]) >= distance) | (np.arange(len(at)) == j)
        return pdf[keep]

    many = Window.partitionBy("pack_id", "island")
    sized = islands.withColumn("size", F.count(F.lit(1)).over(many))
    single = sized.filter("size = 1").drop("size", "island")
    return single.unionByName(sized.filter("size > 1").drop("size").groupBy("pack_id", "island").applyInPandas(run, "pack_id long, i long, x double, over double, t long, island long").drop("island"))
