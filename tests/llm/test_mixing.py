from collections import Counter

import duckdb
from pyspark.sql import functions as F

from pavelake.llm import mixing

from .test_dedup import same, split


def test_targets_fill_up(spark):
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")).collect()}
    assert found["a"] == 30.0 and found[None] == 0.0
    assert abs(found["b"] - 1980 * 2 / 3) < 1e-6 and abs(sum(found.values()) - 2010) < 1e-6


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted((g.doc_id is None, g.doc_id, g.size) for g in got if g.doc_id is not None) == sorted((False, r[0], len(split(r[1]))) for r in rows if r[0] is not None)
    assert all(g.taken <= 3 * g.size and (not g.size or g.taken % g.size == 0) for g in got)
    total, taken = sum(g.size for g in got), sum(g.taken for g in got)
    assert taken <= total and taken >= total - max(g.size for g in got)
    assert sorted((str(g.doc_id), g.taken) for g in got) == sorted((str(g.doc_id), g.taken) for g in mixing.mix(docs.repartition(5)).collect())


def test_documents_are_repeated(docs):
    got = mixing.mixed_documents(docs)
    taken = Counter()
    for r in mixing.mix(docs).filter("taken > 0").collect():
        taken[r.doc_id, r.source] += r.taken // r["size"]
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in got.collect()) == taken


def test_repeated_rows(spark):
    """A source of one row 3000 times, and one of different rows: taken words come near the targets."""
    rows = [(7, "x", "a", 1, "z")] * 3000 + [(100 + i, f"w{i}", "b", 1, "z") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, d string").repartition(5)
    got = mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in got) and sum(r.taken for r in got) == 6000
    kept = Counter(r.source for r in mixing.mixed_documents(d).collect())
    assert kept == Counter({r.source: r.taken for r in got})


def test_repeated_rows_sql(spark, tmp_path):
    rows = [(7, "x y", "a")] * 40 + [(100 + i, f"w{i} v", ("b", None)[i % 2]) for i in range(50)] + [(None, "x y", "a")] * 3 + [(8, "x y", "b")] * 20
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    a, b = mixing.op8_mix_sources(spark, str(tmp_path)).toPandas(), con.sql(mixing.OP8_SQL).df()
    same(*(x.fillna({"doc_id": -1}).astype({"doc_id": "int64"}) for x in (a, b)))


def test_names_that_clash(spark):
    names = ["d", "key", "of", "last", "most", "times", "copy", "uid", "a.b"]
    d = spark.createDataFrame([(i, f"t {i}", "s", *range(9)) for i in range(20)] * 2, ["doc_id", "text", "source", *names])
    got = mixing.mixed_documents(d)
    assert got.columns == d.columns and got.count() == 40


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_without_words(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix(d).collect()] == [(0, 0, 0.0)] * 2


def test_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    same(mixing.op8_mix_sources(spark, folder).toPandas(), con.sql(mixing.OP8_SQL).df())
