"""Shared helpers: word hashing, hot-key joins, components."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pavelake.llm import tokens
from pavelake.llm.common import join_counted
from pavelake.operators.graph import components
from pavelake.llm.substring_dedup import leftmost_minima

TEXTS = ["a b  c", None, "", "x", "  lead trail \n", "é ü\tq", "Abc abc", "\x0b\x0c", "z" * 3000]


def test_words_of_slices():
    found = []
    for s in tokens.slices(pa.array(TEXTS)):
        for r in range(s.rows):
            found.append([s.data[s.starts[i] : s.ends[i]].tobytes().decode() for i in range(s.ptr[r], s.ptr[r + 1])])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_slices_do_not_change_hashes(monkeypatch):
    texts = pa.array([" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(40)])
    whole = np.concatenate([s.word_hashes() for s in tokens.slices(texts)])
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    parts = [s.word_hashes() for s in tokens.slices(texts)]
    assert len(parts) > 5 and (np.concatenate(parts) == whole).all()
    lower = next(tokens.slices(pa.array(["ABC abc aBc"]))).word_hashes(lower=True)
    assert len(set(lower.tolist())) == 1


def test_grams_tell_order():
    h = next(tokens.slices(pa.array(["a b a b a c"]))).word_hashes()
    g = tokens.gram_hashes(h, 2)
    assert g[0] == g[2] and g[1] == g[3] and len(set(g.tolist())) == 3


def test_leftmost_minima():
    x = np.random.default_rng(0).integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 3, 5, 7, 16, 24):
        assert (leftmost_minima(x, width) == [i + int(np.argmin(x[i : i + width])) for i in range(200 - width + 1)]).all()


def test_hot_keys_are_split(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).cast("long").alias("k"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).withColumn("v", F.col("k") * 2)
    for how in ("inner", "left"):
        got = join_counted(rows, counted, ["k"], "c", F.col("id"), how)
        assert got.columns == ["k", "id", "v"] and got.count() == 6000
        assert got.filter("v <> 2 * k or v is null").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_have_as_many_tasks_as_edges_fill(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.range(200).selectExpr("id a", "id + 1 b"))
        # the edges themselves and the distinct roots, which alone are dealt anew
        assert found.rdd.getNumPartitions() <= 1 + 64
        assert {r.root for r in found.collect()} == {0} and found.count() == 201
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
