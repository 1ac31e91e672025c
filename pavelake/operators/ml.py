"""Window classification with a random forest: training, held-out report, folds, importances."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, FOLDS = 400, 5


def balanced(windows: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows of rare labels weigh more, so that all labels weigh the same. There is a row a label to broadcast."""
    counts = windows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter(F.col(label).isNotNull())
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    return windows.join(F.broadcast(counts.select(label, (F.lit(total[0] or 1) / (F.lit(total[1] or 1) * F.col("n"))).alias("weight"))), label)


def train(windows: DataFrame, features: list[str], label: str, trees: int = TREES, seed: int = 42):
    """The indexer, the vector column's assembler and the model; labels weigh the same."""
    index = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="skip").fit(windows)
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    forest = RandomForestClassifier(labelCol="label_id", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=10, seed=seed)
    return index, ready, forest.fit(ready.transform(index.transform(balanced(windows, label))))


def predicted(model: tuple, windows: DataFrame, label: str) -> DataFrame:
    """truth, guess of each window."""
    index, ready, forest = model
    names = F.array(*map(F.lit, index.labels))
    found = forest.transform(ready.transform(index.transform(windows)))
    return found.select(F.col(label).alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("guess"))


def scores(found: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support from truth and guess: one row a label."""
    cells = found.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    by_truth = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = cells.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    both = by_truth.join(by_guess, "label", "left").fillna(0, ["guessed"])
    p, r = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)), F.col("hit") / F.col("support")
    return both.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def dealt(windows: DataFrame, keys: list[str], folds: int) -> DataFrame:
    return windows.withColumn("fold", F.pmod(F.xxhash64(*keys), F.lit(folds)))


def fold_scores(windows: DataFrame, keys: list[str], features: list[str], label: str, folds: int = FOLDS, trees: int = TREES, only: int | None = None) -> list[list]:
    """The rows of `scores` of each fold, a row a label; folds are dealt by a hash of the keys, and windows are worked out once for all of them."""
    rows, out = dealt(windows, keys, folds).persist(), []
    for k in range(folds) if only is None else [only]:
        model = train(rows.filter(F.col("fold") != k), features, label, trees)
        out.append(scores(predicted(model, rows.filter(F.col("fold") == k), label)).collect())
    rows.unpersist()
    return out


def macro_f1(rows: list) -> float:
    return sum(r.f1 for r in rows) / len(rows) if rows else 0.0


def cross_validate(windows: DataFrame, keys: list[str], features: list[str], label: str, folds: int = FOLDS, trees: int = TREES) -> list[float]:
    """F1-macro of each fold."""
    return [macro_f1(x) for x in fold_scores(windows, keys, features, label, folds, trees)]


def report(windows: DataFrame, features: list[str], label: str, keys: tuple[str, ...] = ("pack_id", "window"), trees: int = TREES, folds: int = FOLDS) -> DataFrame:
    """label, precision, recall, f1, support on a held-out fifth, and as label "macro f1 of folds" mean and deviation over folds in f1 and recall.

    With five folds the held-out fifth is the first of them, so its forest is not grown twice.
    """
    found = fold_scores(windows, list(keys), features, label, folds, trees)
    f1 = [macro_f1(x) for x in found]
    mean = sum(f1) / len(f1)
    deviation = (sum((x - mean) ** 2 for x in f1) / len(f1)) ** 0.5
    held = found[0] if folds == 5 else fold_scores(windows, list(keys), features, label, 5, trees, only=0)[0]
    lines = [tuple(r) for r in held] + [("macro f1 of folds", None, deviation, mean, len(f1))]
    return windows.sparkSession.createDataFrame(lines, "label string, precision double, recall double, f1 double, support long")


def importance(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda x: -x[1])
