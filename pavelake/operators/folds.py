"""Sequential work over recordings: rows of a pack in time order, a bounded state, Arrow batches in and out.

Packs are dealt to tasks by a shuffle and sorted there, so a task streams through one pack after the other; it holds the state of one
pack and the few rows that wait for their value, never a whole recording. Time is linear in the number of rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import vocab as v

ORDER = ["t_ms", "event_id"]


class Ema:
    """Exponential smoothing with the time that has passed; a missing value leaves the state as it is."""

    def __init__(self, s: float = 0.0, last: float | None = None):
        self.s, self.last = s, last

    def push(self, t: float, x: float | None) -> list:
        dt = v.EMA_FIRST_S if self.last is None else (t - self.last) / 1000.0
        self.last = t
        if x is None:
            return [None]
        a = math.exp(-min(dt, v.EMA_CAP_S) / v.EMA_TAU_S)
        self.s = a * self.s + (1 - a) * x
        return [self.s]

    def end(self) -> list:
        return []


def at_quantile(ordered: list[float], q: float) -> float | None:
    """Linear interpolation between the neighbours in an ordered list."""
    if not ordered:
        return None
    place = q * (len(ordered) - 1)
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


class TrailingQuantile:
    """Quantile of |x| over the last `ms`, both ends and rows of the same time included. The window is kept in order."""

    def __init__(self, ms: int, q: float):
        self.ms, self.q = ms, q
        self.ring: deque = deque()
        self.ordered: list[float] = []
        self.t, self.waiting = None, 0

    def push(self, t: int, x: float | None) -> list:
        done = self.end() if t != self.t else []
        if t != self.t:
            while self.ring and (self.ring[0][0] is None or t - self.ring[0][0] > self.ms):  # rows without a time see each other only
                del self.ordered[bisect_left(self.ordered, self.ring.popleft()[1])]
        self.t, self.waiting = t, self.waiting + 1
        if x is not None:
            self.ring.append((t, abs(x)))
            insort(self.ordered, abs(x))
        return done

    def end(self) -> list:
        n, self.waiting = self.waiting, 0
        return [at_quantile(self.ordered, self.q)] * n


class CenteredQuantile:
    """Quantile of |x| over `width` rows around each; null where fewer than `least` rows are there."""

    def __init__(self, width: int, q: float, least: int):
        self.back, self.ahead, self.q, self.least = width // 2, width - width // 2 - 1, q, least
        self.ring: deque = deque()
        self.ordered: list[float] = []
        self.seen = self.given = 0

    def push(self, t: int, x: float | None) -> list:
        self.seen += 1
        self.ring.append(None if x is None else abs(x))
        if x is not None:
            insort(self.ordered, abs(x))
        return [self._next()] if self.seen - 1 - self.given >= self.ahead else []

    def _next(self) -> float | None:
        # rows of the window: given-back .. given+ahead, as far as they are there
        first = self.seen - len(self.ring)
        while first < self.given - self.back:
            gone = self.ring.popleft()
            if gone is not None:
                del self.ordered[bisect_left(self.ordered, gone)]
            first += 1
        self.given += 1
        return at_quantile(self.ordered, self.q) if len(self.ring) >= self.least else None

    def end(self) -> list:
        return [self._next() for _ in range(self.seen - self.given)]


def in_packs(samples: DataFrame, keys: tuple[str, ...] = ("pack_id",), partitions: int | None = None, dealt: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Packs, or what else the keys part, dealt to tasks (unless they are so already), in time order; rows of one time and event_id by `ties`."""
    if not dealt:
        samples = samples.repartition(partitions, *keys) if partitions else samples.repartition(*keys)
    return samples.sortWithinPartitions(*keys, *ORDER, *ties)


def appended(samples: DataFrame, name: str, x: str, make: Callable, keys: tuple[str, ...] = ("pack_id",), start: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """samples with a double column more: what a fold over each key's (t_ms, x) gives for each row.

    A row may get its value some rows later; batches wait until all of theirs are there. make gets the columns of `start` from a key's first row.
    """
    schema = T.StructType([*samples.schema.fields, T.StructField(name, T.DoubleType())])
    t_at, x_at, *rest = (samples.columns.index(c) for c in ("t_ms", x, *keys, *start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: deque = deque()
        values: list = []
        pack, fold = object(), None

        def ready():
            nonlocal values
            while pending and len(values) >= pending[0].num_rows:
                batch = pending.popleft()
                own, values = values[: batch.num_rows], values[batch.num_rows :]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], [*batch.schema.names, name])

        for batch in batches:
            if not batch.num_rows:
                continue
            pending.append(batch)
            for t, value, *p in zip(*(batch.column(i).to_pylist() for i in (t_at, x_at, *rest))):
                if p[: len(keys)] != pack:
                    values += fold.end() if fold else []
                    pack, fold = p[: len(keys)], make(*p[len(keys) :])
                values += fold.push(t, value)
            yield from ready()
        values += fold.end() if fold else []
        yield from ready()

    return in_packs(samples, keys, dealt=dealt).mapInArrow(run, schema)


def reduced(samples: DataFrame, columns: tuple[str, ...], make: Callable, result: str, keys: tuple[str, ...] = ("pack_id",), dealt: bool = False) -> DataFrame:
    """keys and result (DDL): the rows that a fold over each key's rows gives, some at each push of a row's columns, some at the end."""
    schema = T.StructType([*(samples.schema[k] for k in keys), *T.StructType.fromDDL(result).fields])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, out = None, None, []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if fold is None or row[: len(keys)] != key:
                    out += [(*key, *x) for x in fold.end()] if fold else []
                    key, fold = row[: len(keys)], make()
                out += [(*key, *x) for x in fold.push(*row[len(keys) :])]
            if len(out) > 10_000:
                yield table()
                out = []
        out += [(*key, *x) for x in fold.end()] if fold else []
        if out:
            yield table()

    return in_packs(samples, keys, dealt=dealt).select(*keys, *columns).mapInArrow(run, schema)
