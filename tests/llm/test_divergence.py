"""Divergence audit against brute force in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pavelake.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, item string, value long, first long"


def brute(rows, least=3, k=200):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, ws in docs:
        groups[lang].add(source)
        df[lang].update(set(ws))
        count[lang, source].update(ws)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least]
        v = len(kept)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n[s] + v) for t in kept} for s in sources}
        every = sum(n.values())
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 1) // (every + v) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def made(seed=1, n=160, rare=0):
    rng = random.Random(seed)
    words = ["Haus", "haus", "né", "NÉ", "İx", "語", "ẞ", "a1b", "x_y", "x@y", "\x7fz", "A" * 40] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.choice([12, 40, 102])]) for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "ä", None]), "t", 1, "i", 2, 3))
    for i in range(rare):  # many terms of one count: ties
        rows += [(1000 + i, f"tie{'x' * (i % 7)}{chr(97 + i % 26)}{chr(97 + i // 26)}é", "en", "b", "t", 1, "i", 2, 3)] * 3
    return rows + [(None, None, "en", "empty", "t", 1, "i", 2, 3), (5, "1 2 3", "xx", "only", "t", 1, "i", 2, 3), (6, "", "xx", "two", "t", 1, "i", 2, 3), rows[0], (7, "long é " * 30_000, "en", "c", "t", 1, "i", 2, 3)]


@pytest.mark.parametrize("k,ties,slices", [(200, 1000, 8 << 20), (5, 0, 64), (17, 3, 1000)])
def test_audit(spark, monkeypatch, k, ties, slices):
    rows = made(rare=120)
    monkeypatch.setattr(dv, "SLICE_BYTES", slices)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(dv.audit(d, k=k, ties=ties)) == brute(rows, k=k)


def test_split_joins(spark, monkeypatch):
    """As where groups are too many to be broadcast."""
    rows = made(2)
    monkeypatch.setattr(dv, "FEW", 1)
    assert found(dv.audit(spark.createDataFrame(rows, SCHEMA), k=9, ties=0)) == brute(rows, k=9)


def test_sql(spark, tmp_path):
    rows = made(3)
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(dv.OP12_SQL).df()[["lang", "source", "part", "item", "value", "rank"]]
    got = found(dv.op12_source_divergence(spark, str(tmp_path)))
    assert sorted(map(tuple, want.astype(object).itertuples(index=False))) == got == brute(rows)


def test_empty(spark):
    assert dv.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_kept_terms(spark):
    got = found(dv.audit(spark.createDataFrame([(1, "a b", "l", "x"), (2, "c", "l", "y")], "doc_id long, text string, lang string, source string")))
    assert got == [("l", "x", "pair", "y", 0, 1), ("l", "y", "pair", "x", 0, 1)]


def test_share_of_large_counts(spark):
    pairs = [(9 * 10**13, 8 * 10**14), (0, 1), (10**13 + 7, 10**13 + 9), (3, 10**14)]
    got = spark.createDataFrame(pairs, "n long, t long").select(dv.share(F.col("n"), F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [1 + 10**9 * (n + 1) // t for n, t in pairs]


@pytest.mark.parametrize("k", [1, 7, 400])
def test_kth_value(spark, k):
    rng = random.Random(k)
    rows = [(g, rng.choice([0, 3, 2**16, 2**33, 2**62, rng.randrange(2**40), rng.randrange(2**62)]), f"i{i}") for g in "ab" for i in range(300)]
    got = {r.g: (r.edge, r.need) for r in dv.kth_value(spark.createDataFrame(rows, "g string, value long, item string"), ["g"], k).collect()}
    for g in "ab":
        values = sorted((v for x, v, _ in rows if x == g), reverse=True)
        assert got[g] == ((values[k - 1], k - sum(v > values[k - 1] for v in values)) if k < 300 else (-1, 0))


def test_ties_by_utf8(spark):
    """All of one value, long shared beginnings, characters of one to four bytes."""
    items = sorted({"p" * n + e + c for n in (0, 300) for e in ("", "q", "é") for c in ["", "z", "ß", "語", "𝄞", "￮"] + [chr(0x4E00 + i) for i in range(40)]})
    rows = spark.createDataFrame([("g", i, 5) for i in items] + [("h", "one", 5)], "g string, item string, value long")
    for k in (1, 60, 200):
        got = [r.item for r in dv.top_rows(rows, ["g"], k, 0).filter("g = 'g'").orderBy("rank").collect()]
        assert got == sorted(items, key=lambda s: s.encode())[:k]


def test_pairs_in_pieces(monkeypatch):
    """Pieces of any size give the sums of one."""
    rng = np.random.default_rng(1)
    lists = [[{"gid": int(g), "p": int(rng.integers(5, 10**9)), "base": int(g) + 1} for g in rng.permutation(9)[: rng.integers(2, 9)]] for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists)], ["s"])
    sums = []
    for size in (1, 10, 1 << 20):
        monkeypatch.setattr(dv, "PAIRS_AT_ONCE", size)
        got = Counter()
        for b in dv.shared_terms([batch]):
            for r in b.to_pylist():
                got[r["a"], r["b"]] += r["value"]
        sums.append(got)
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for row in lists:
        for x in row:
            for y in row:
                if x is not y:
                    want[x["gid"], y["gid"]] += f(x["p"], y["p"]) - f(x["p"], y["base"]) - f(x["base"], y["p"]) + f(x["base"], y["base"])
    assert sums[0] == sums[1] == sums[2] == want
