"""The conversation trie against brute force, whatever the partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pavelake.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, kind int, part long, digest string"


def rows_of(seed=3, convs=140):
    rng = random.Random(seed)
    base, out = [("user", f"hello {i}") for i in range(4)], []
    for c in [*range(convs), -7, -200, 350, 100_000]:
        n = rng.choice([1, 2, 3, 6, 7, 9, 40])
        turns = [base[rng.randrange(4)] if rng.random() < 0.7 else (rng.choice(["user", None, ""]), rng.choice([None, "", "é ü 語", "x" * 3000])) for _ in range(n)]
        out += [(c, (None if t == 0 and c % 5 == 0 else t), r, x, "k", 1, 2, "d") for t, (r, x) in enumerate(turns)]
    out += [(400 + i, t, "user", f"same {t}", "k", 1, 2, "d") for i in range(90) for t in range(8)]  # copies
    out += [(None, 0, "user", "no conversation", "k", 1, 2, "d"), out[5], out[5]]
    return out


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        whole[c] = own.get(base, [])[:h] + ts[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in sorted(whole.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
        ends[tuple(ts)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def plain(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_trie(talk, partitions):
    assert plain(pt.trie(pt.rebuilt(pt.sequences(talk)), partitions)) == brute(rows_of())


def test_query_and_sql(spark, tmp_path):
    rows = [r for r in dict.fromkeys(rows_of(9, 120))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = pt.op11_prefix_trie(spark, str(tmp_path))
    assert plain(got) == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(pt.OP11_SQL).df().fillna({"parent_conv_id": -1})
    assert sorted(map(tuple, want[pt.NODE].astype({"parent_conv_id": "int64"}).itertuples(index=False))) == plain(got)


def test_empty(spark, talk):
    assert pt.trie(pt.rebuilt(pt.sequences(talk.limit(0)))).count() == 0


def test_only_turnless(spark):
    """Heads of blocks that are not there and too few own turns: one root whose members all end there."""
    ids = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1]
    d = spark.createDataFrame([(c, 0, "user", "x") for c in ids], "conv_id long, turn long, role string, text string")
    got = plain(pt.trie(pt.rebuilt(pt.sequences(d)), 4))
    assert got == [(ids[0], 0, -1, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_chunks_of_ids(spark, monkeypatch):
    d = spark.createDataFrame([(100 * c, 0, "user", "x") for c in range(500)], "conv_id long, turn long, role string, text string")
    want = hashlib.sha256(",".join(str(100 * c) for c in range(500)).encode()).hexdigest()
    assert {r[-1] for r in plain(pt.trie(pt.rebuilt(pt.sequences(d)), 16)) if r[1]} == {want}


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree(seed):
    """The merged stream is sorted, whole, and carries true LCPs."""
    rng = random.Random(seed)
    block = [bytes([i]) * 16 for i in range(3)]
    strings = [b"".join(rng.choices(block, k=rng.randrange(12))) for _ in range(200)]
    runs = [pt.sorted_run(strings[i : i + 23], list(range(i, min(i + 23, 200))), [np.zeros(len(s) // 16, int) for s in strings[i : i + 23]]) for i in range(0, 200, 23)]
    out = list(pt.LoserTree(runs))
    assert [(s, c) for s, c, _, _ in out] == sorted(zip(strings, range(200)))
    assert [h for *_, h in out][1:] == [pt.common(a[0], b[0]) for a, b in zip(out, out[1:])]


def test_merging_compares_shared_turns_once(monkeypatch):
    """Strings of 500 shared turns: merging looks at about as many turns as are new."""
    runs = [pt.sorted_run([b"a" * 8000 + bytes([r, i]) * 8 for i in range(50)], list(range(r * 50, r * 50 + 50)), [np.zeros(501, int)] * 50) for r in range(8)]
    seen, true = [], pt.common
    monkeypatch.setattr(pt, "common", lambda a, b, known=0: seen.append(true(a, b, known) - known) or true(a, b, known))
    assert len(list(pt.LoserTree(runs))) == 400
    assert sum(seen) <= 500 * 8
