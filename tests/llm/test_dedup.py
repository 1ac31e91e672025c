"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from pavelake.llm import exact_dedup, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall(text or "")


def oracle(folder, sql):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    return con.sql(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert key(a) == key(b)


def test_exact_groups(docs, rows):
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    for text, ids in groups.items():
        mine = [g for g in got if g.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert len(mine) == len(ids) and sum(g.kept for g in mine) == 1
        assert {g.group_size for g in mine} == {len(ids)} and {g.keep_id for g in mine} == {max(known) if known else None}
        assert [g.doc_id for g in mine if g.kept] == [max(known) if known else None]


def test_exact_few_counters_is_whole(docs, rows):
    a, b = exact_dedup.groups(docs, counters=2).toPandas(), exact_dedup.groups(docs, counters=1000).toPandas()
    same(a, b)


def test_summary_keeps_heavy_ones():
    counts = Counter({"a": 50, "b": 30, "c": 1, "d": 1})
    assert set(exact_dedup.shrink(counts, 2)) == {"a", "b"}


def test_exact_keeps_columns(docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(r[1] or "").translate(LOWER) for r in rows})


def test_copies_of_one_id(spark):
    """A hot group of rows equal in id and text, ties below the heavy ones, names that clash."""
    rows = [(9, "Hot")] * 300 + [(1, "hot")] * 50 + [(2, "b")] * 3 + [(3, "B"), (None, "c"), (None, "c"), (4, None), (5, "")]
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, d int, digest int, keep int, c int").repartition(6)
    for counters in (1, 1024):
        kept = exact_dedup.drop_copies(d, counters)
        assert kept.columns == d.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(9, "Hot"), (3, "B"), (None, "c"), (5, "")])


def test_empty_tables(empty):
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def near_truth(rows, threshold=85):
    sets = []
    for r in rows:
        w = split((r[1] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 900, 150])
def test_near_groups(docs, rows, block):
    got = near_dedup.near_groups(docs, 85, block=block).collect()
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got) == near_truth(rows)
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def chained(n, width, step, first=0):
    """Texts of which each shares 0.8 or more with the next ones only."""
    return [(first + i, " ".join(f"v{first}_{k}" for k in range(i * step, i * step + width))) for i in range(n)]


@pytest.mark.parametrize("block", [400, 3000])
def test_large_clusters(spark, block):
    """Long chains, stars and strangers in one cluster of candidates: nothing is lost where classes are settled or split."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(100)]
    star = [(1000 + i, " ".join(f"x{i}" if k in (i % 100, (i * 7) % 100) else w for k, w in enumerate(base))) for i in range(60)]
    far = [(2000 + i, " ".join(f"y{i}_{k}" if rng.random() < 0.04 else w for k, w in enumerate(base))) for i in range(40)]
    rows = chained(40, 100, 3) + star + far + chained(30, 60, 4, 5000) + star[:5] + [(3, None), (None, star[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # more tables than usual, so that no candidate is missed and the truth is exact
    got = near_dedup.near_groups(d, 80, tables=25, block=block).collect()
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got) == near_truth(rows, 80)


def test_search_knows_what_is_settled():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    settled = np.arange(30) < 12
    close = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
    links = list(near_dedup.search(list(range(30)), sets, 60, settled))
    assert all(not (settled[a] and settled[b]) for a, b in links)

    def groups(pairs):
        root = list(range(30))
        for a, b in [*((0, i) for i in range(12)), *pairs]:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return [root.index(r) for r in root]

    assert groups(links) == groups([(i, j) for i in range(30) for j in range(i) if close(i, j)])


def test_near_keeps_one_of_each(docs, rows):
    kept = near_dedup.keep_one(docs, 85)
    assert kept.columns == docs.columns
    expected = {c for _, n, c in near_truth(rows) if n}
    ids = {r.doc_id for r in kept.collect() if split(r.text)}
    assert ids == expected


def substring_truth(rows, window=35):
    where = Counter()
    lists = [split(r[1]) for r in rows]
    for w in lists:
        where.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for r, w in zip(rows, lists):
        gone = set()
        for i in range(len(w) - window + 1):
            if where[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_substrings(docs, rows):
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == substring_truth(rows)
    assert all(hashlib.sha256(g.kept_text.encode()).hexdigest() == g.kept_sha256 for g in got)


@pytest.mark.parametrize("window,gram", [(9, 4), (35, 12)])
def test_substrings_of_texts_that_repeat_themselves(spark, window, gram):
    """Rings that begin anywhere, paths that follow themselves, passages that part and meet."""
    rng = random.Random(11)
    ring, path = [f"r{i}" for i in range(17)], [f"p{i}" for i in range(60)]
    texts = [ring[k:] + ring * rng.randrange(2, 9) + ring[: rng.randrange(17)] for k in (0, 3, 9)] + [ring[5:] + ring * 2, ring * 3]
    texts += [path, path * 2, path[:40], path[20:], ["x"] + path + ["y"] + path[10:50], path + [f"q{i}" for i in range(50)], [f"q{i}" for i in range(50)] + path]
    texts += [["a"] * n for n in (5, 34, 35, 36, 90)] + [["a", "b"] * 40, ["a", "b"] * 30 + ["c"] * 40]
    texts += [[f"v{rng.randrange(3)}" for _ in range(rng.randrange(20, 150))] for _ in range(15)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window, gram).collect()
    assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == substring_truth(rows, window)


def test_substrings_other_window(docs, rows):
    got = substring_dedup.remove_repeats(docs, window=9, gram=4).collect()
    assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == substring_truth(rows, 9)


def test_sql(spark, folder):
    for query, sql in ((exact_dedup.op7_exact_dedup, exact_dedup.OP7_SQL), (near_dedup.op9_near_dedup, near_dedup.OP9_SQL), (substring_dedup.op1_substring_dedup, substring_dedup.OP1_SQL)):
        same(query(spark, folder).toPandas(), oracle(folder, sql))
