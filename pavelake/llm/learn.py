"""What the two trained operators share: the bounded sample of labelled rows and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learnt from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, most_rows: int, most_bytes: int, rare_first: bool = False) -> tuple[DataFrame, dict[int, float]]:
    """label, text, key of labelled rows that are not held out: at most `most_rows` rows of at most `most_bytes`
    bytes of text together; and how many labelled rows each row of a class stands for.

    Rows are chosen in the order of a hash of the id, so the choice is the same in every run; whole texts, and a text that
    no longer fits is passed over. With `rare_first` label 1 may take up half of either bound before others
    are looked at. The largest of an id's labels counts, and one of an id's texts. The chosen labels are at most `most_rows` rows
    of a few numbers, which pass through the driver and are broadcast; no text is shuffled but those chosen.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = known.orderBy(order, "doc_id").limit(most_rows)
    if rare_first:
        some = known.filter("label = 1").orderBy(order, "doc_id").limit(most_rows // 2).union(known.filter("label = 0").orderBy(order, "doc_id").limit(most_rows - most_rows // 2))
    mark = F.struct(F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min(mark).alias("m")).select("doc_id", "label", "m.mark", "m.bytes", order.alias("at")).collect()
    rest, chosen, taken = most_bytes, [], {0: 0, 1: 0}
    for r in sorted(found, key=lambda r: (rare_first and r["label"] == 0, r["at"], r["doc_id"])):
        room = rest - most_bytes // 2 if rare_first and r["label"] == 1 else rest
        if r["bytes"] <= room:
            rest -= r["bytes"]
            chosen.append((r["doc_id"], r["label"], r["mark"]))
            taken[r["label"]] += 1
    use = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int, mark long")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(F.broadcast(use), ["doc_id", "mark"]).dropDuplicates(["doc_id"])
    return rows.select("label", "text", F.xxhash64("doc_id").alias("key")), {k: counts[k] / n for k, n in taken.items() if n}


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; x has a column of ones, `weight` weighs its rows."""
    c = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (c * (p - y)) + penalty * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / size if size else 1.0)
        if size < 1e-8:
            break
    return w
