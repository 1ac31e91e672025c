"""Token files: exact round trips, random access, order over files, and the library's own ids."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pavelake.llm import token_files as tf


@pytest.mark.parametrize("width", range(1, 33))
def test_pack(width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 1 << width, 77, dtype=np.uint64)
    assert len(tf.pack(values, width)) == 10 * width
    assert tf.unpack(tf.pack(values, width), width)[:77].tolist() == values.tolist()


@pytest.mark.parametrize("seed,top", [(0, 2), (1, 49_408), (2, 300), (3, 2**32 - 1)])
def test_any_id_and_any_stretch(seed, top):
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(6000) < 0.7, rng.integers(0, min(top, 200), 6000), rng.integers(0, top + 1, 6000)).astype(np.uint32)
    counts = np.array([0, 1, 2500, 0, 3499])
    file = tf.from_bytes(tf.encoded([5, None, 7, 8, -9], counts, ids))
    assert file.documents()[0] == [5, None, 7, 8, -9] and np.diff(file.documents()[1]).tolist() == counts.tolist()
    assert file.ids(0, 6000).tolist() == ids.tolist()
    assert [file.at(i) for i in range(0, 6000, 7)] == ids[::7].tolist()
    for _ in range(200):
        a, b = sorted(rng.integers(0, 6001, 2).tolist())
        assert file.ids(a, b).tolist() == ids[a:b].tolist()


def test_a_single_id_reads_few_bytes():
    rng = np.random.default_rng(4)
    data = tf.encoded([1], np.array([10**6]), rng.integers(0, 49_408, 10**6).astype(np.uint32))
    file, read = tf.from_bytes(data), []
    true = file.file.read
    file.file = type("Counted", (), {"seek": file.file.seek, "read": lambda _, n: read.append(n) or true(n)})()
    file.at(876_543)
    assert sum(read) < 400 < len(data)


def test_widths_are_the_best():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 8, 5000), rng.integers(0, 40_000, 300)]).astype(np.uint32)
    size = lambda widths: sum(int((ids >= (1 << sum(widths[:i]) if i else 0)).sum()) * (w + (0 if i == len(widths) - 1 else 1 + 32 / 512)) for i, w in enumerate(widths))
    every = [[16], *([a, 16 - a] for a in range(1, 16)), *([a, b, 16 - a - b] for a in range(1, 15) for b in range(1, 16 - a))]
    assert size(tf.best_widths(ids)) <= min(map(size, every)) + 1e-6
    assert tf.best_widths(np.zeros(3, np.uint32)) == [1] and sum(tf.best_widths(np.array([2**32 - 1], np.uint32))) == 32


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


SIGNS = ["a", "B", "é", "é", "́", "\x0b", "\x0c", "\r\n", " ", "  ", "\t", "\x1c", "\x85", "\xa0", "'s", "'", "12", "<|endoftext|>", "<|startoftext|>", "Σ", "ς", "İ", "語", "　", "‍", "!?", "\0", "À", "ÿ", "×", "÷", "ß", "<", "|", "q", "Z9", ".,", "_", "~"]


def test_encoder_is_the_library(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(14))) for _ in range(3000)] + [None, "", "x" * 5000, "y" * 200 + " y"]
    want = library(texts)
    for size, most, by_runs in ((64, 10, True), (4 << 20, 10**6, True), (500, 30, False)):
        monkeypatch.setattr(tf, "SLICE_BYTES", size)
        monkeypatch.setattr(tf, "MOST_WORDS", most)
        got, made = [], tf.Encoder(tf.default_tokenizer(), by_runs=by_runs)
        for first, counts, ids in made.encode(pa.array(texts, pa.string())):
            assert first == len(got)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want


def expected(rows):
    """doc_id, start, n, crc of rows in order of doc_id, nulls first; ties don't matter for distinct ids."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (i, _), ids in zip(rows, library([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_in_order(spark, docs, tmp_path):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").dropDuplicates(["doc_id"]).collect()]
    d = spark.createDataFrame([(i, t, "c", 1, [2], 3) for i, t in rows], "doc_id long, text string, tie string, start int, ids array<int>, n_tokens int").repartition(4)
    tf.write_documents(d, str(tmp_path), tf.default_tokenizer(), partitions=7)
    got = tf.read_documents(spark, f"file://{tmp_path}", "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)
    ids = {r.doc_id: r.ids for r in tf.read_documents(spark, str(tmp_path)).collect()}
    assert [ids[i] for i, _ in rows] == library([t for _, t in rows])
    one = sorted(p for p in tmp_path.iterdir() if p.suffix == ".tok")[0]
    assert tf.open_file(str(one)).ids(0, 5).tolist() == [x for r in sorted((r for r in got), key=lambda r: r.start) for x in ids[r.doc_id]][:5]


def test_files_are_closed_at_their_bound_and_written_from_ids(spark, tmp_path):
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.expr("transform(sequence(0, cast(id as int)), x -> x * 1000)").alias("ids")).coalesce(1)
    spark.dataSource.register(tf.TokenCodes)
    d.write.format("token_codes").mode("append").option("file_ids", 100).save(str(tmp_path))
    assert len([p for p in tmp_path.iterdir() if p.suffix == ".tok"]) == 1  # a batch is not parted
    got = tf.read_documents(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert all(r.ids == [1000 * x for x in range(r.doc_id + 1)] and r.start == r.doc_id * (r.doc_id + 1) // 2 for r in got) and len(got) == 50


def test_files_that_no_commit_names_are_not_read(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None)], "doc_id long, text string")
    (tmp_path / "part-000000-0000-lost.tok").write_bytes(b"half a file")
    tf.write_documents(d, str(tmp_path), tf.default_tokenizer(), partitions=3)
    got = tf.read_documents(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and sorted(map(str, (r.ids for r in got))) == sorted(map(str, library(["a b", "a b", "c", None])))


def test_empty(spark, empty, tmp_path):
    tf.write_documents(empty, str(tmp_path), tf.default_tokenizer(), partitions=2)
    assert tf.read_documents(spark, str(tmp_path)).count() == 0


def test_query(spark, folder):
    got = tf.op13_token_files(spark, folder)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in got.orderBy("start").collect()] == expected(rows)
