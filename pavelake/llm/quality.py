"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: words, word pairs, word endings, and the shapes of one, two and
three words (case, digits, marks, length, repetition), hashed into 2**18 buckets. Each
indicator is scaled by the log-count ratio of its bucket between the classes; a linear model with hinge loss is
fitted on these by dual coordinate descent, and its margin is turned into a probability by a line that is
fitted to margins of documents by models that have not seen them.

Fitted on at most `most_rows` labelled rows of at most `most_bytes` bytes of text (documented bounds of the sample, which alone
passes through the driver); every text is scored in whole. Labels, language, source and id are never inputs of a score.

Defined results: null and blank texts have no n-grams and score what an unknown document scores; repeated rows get equal
scores and are learnt from once; a very long text counts as any other, and is passed over in the fit where it exceeds what is left
of the bound; of several labels of an id the largest counts; without labels of both classes every score is the share of
label 1 (0.5 without any label); an empty table gives an empty result; columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table
from .learn import held_out, labelled, logistic, sigmoid

BUCKETS = 1 << 18
MOST_ROWS = 8000
MOST_BYTES = 16 << 20
THRESHOLD = 0.7
COST = 1.0
EPOCHS = 12
FOLDS = 3


def _count(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=sums[1:])
    return sums[ends] - sums[starts]


def indicators(texts):
    """For each slice: rows and buckets of the distinct n-grams, sorted by row."""
    for s in tokens.slices(texts):
        words, data = s.word_hashes(lower=True), s.data
        n = len(words)
        row = s.row_of_word()
        length = s.ends - s.starts
        upper = _count((data >= 65) & (data <= 90), s.starts, s.ends)
        lower = _count((data >= 97) & (data <= 122), s.starts, s.ends)
        digit = _count((data >= 48) & (data <= 57), s.starts, s.ends)
        wide = _count(data >= 128, s.starts, s.ends)
        marks = length - upper - lower - digit - wide
        again = np.zeros(n, bool)
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        shape = np.minimum(upper, 2)
        for part, most in ((lower, 1), (digit, 2), (marks, 3), (wide, 1), (length // 4, 3), (again, 1)):
            shape = shape * (most + 1) + np.minimum(part, most)
        shape = tokens.mix(shape.astype(np.uint64) + np.uint64(1))
        ends = np.zeros(n, np.uint64)
        for back in (1, 2, 3):
            at = s.ends - back
            ends = ends * np.uint64(257) + np.where(at >= s.starts, data[np.maximum(at, 0)] + np.uint64(1), np.uint64(0))
        grams, owner = [], []
        for kind, (values, k) in enumerate(((words, 1), (words, 2), (tokens.mix(ends), 1), (shape, 1), (shape, 2), (shape, 3))):
            h = values if k == 1 else tokens.gram_hashes(values, k)
            if not len(h):
                continue
            inside = row[: len(h)] == row[k - 1 :]
            h = tokens.mix(h + np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % 2**64))
            grams.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
            owner.append(row[: len(h)][inside])
        both = np.unique(np.concatenate(owner) * BUCKETS + np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        yield s, both // BUCKETS, both % BUCKETS


def features(batches):
    """mapInArrow over label, text, key: the buckets of each row as bytes."""
    for batch in batches:
        out = []
        for s, rows, buckets in indicators(batch.column(1)):
            cut = np.searchsorted(rows, np.arange(s.rows + 1))
            out += [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["label", "key", "buckets"])


def log_count_ratio(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.ones(BUCKETS), np.ones(BUCKETS)]
    for x, label in zip(docs, y):
        counts[label][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(docs: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, costs: np.ndarray, epochs: int) -> np.ndarray:
    """Linear hinge-loss model by coordinate steps on the dual; the last weight is the bias."""
    w = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(docs))
    rng = np.random.default_rng(7)
    norms = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(docs)):
            x, v = docs[i], values[i]
            gradient = y[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def scaled(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[x]
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, folds: int = FOLDS) -> dict:
    """The model: bucket weights and the calibration of margins.

    Margins are calibrated on documents by models that have not seen them (`folds` parts, at every size); the model itself learns from all rows.
    """
    rows = labelled(docs, labels, column, most_rows, most_bytes)[0].mapInArrow(features, "label int, key long, buckets binary").collect()
    rows.sort(key=lambda r: (r["key"], bytes(r["buckets"])))
    y = np.array([r["label"] for r in rows], dtype=np.int64)
    x = [np.frombuffer(bytes(r["buckets"]), dtype=np.int32) for r in rows]
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return {"weights": np.zeros(BUCKETS, np.float32), "ratio": np.zeros(BUCKETS, np.float32), "bias": 0.0, "line": (float(np.log(share / (1 - share))), 0.0)}
    part = np.zeros(len(y), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        part[own] = np.arange(len(own)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        seen, new = np.flatnonzero(part != k), np.flatnonzero(part == k)
        margins[new] = margins_of([x[i] for i in new], *train([x[i] for i in seen], y[seen]))
    line = logistic(np.stack([np.ones(len(y)), margins], axis=1), y)
    w, ratio = train(x, y)
    return {"weights": w[:-1].astype(np.float32), "ratio": ratio.astype(np.float32), "bias": float(w[-1]), "line": (float(line[0]), float(line[1]))}


def train(x: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the bias last) and log-count ratios of a model of these rows; all zero where one class is missing."""
    count = np.bincount(y, minlength=2)
    if not count.all():
        return np.zeros(BUCKETS + 1), np.zeros(BUCKETS)
    ratio = log_count_ratio(x, y)
    weight = len(y) / (2.0 * count)
    return dual_coordinate_descent(x, [scaled(d, ratio) for d in x], 2 * y - 1, COST * weight[y], EPOCHS), ratio


def margins_of(x: list[np.ndarray], w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.array([w[d] @ scaled(d, ratio) + w[-1] for d in x])


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input

    def run(batches):
        m = spread.value
        ratio = m["ratio"].astype(np.float64)
        product, square = m["weights"] * ratio, ratio * ratio
        for batch in batches:
            out = []
            for s, rows, buckets in indicators(batch.column(2)):
                norm = np.sqrt(np.bincount(rows, weights=square[buckets], minlength=s.rows))
                margin = np.bincount(rows, weights=product[buckets], minlength=s.rows) / np.where(norm > 0, norm, 1.0) + m["bias"]
                out.append(sigmoid(m["line"][0] + m["line"][1] * margin))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
