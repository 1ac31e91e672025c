"""The trained operators: held-out accuracy, gradients, edge cases; and the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest

from pavelake.llm import quality, toxicity
from pavelake.llm.common import table


def scored(spark, folder, query, column):
    got = {r.doc_id: r for r in query(spark, folder).collect()}
    labels = {r.doc_id: r[column] for r in table(spark, folder, "labels").collect() if r.doc_id in got and r[column] is not None}
    held = [(got[i].predicted, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.values())
    assert len(got) == table(spark, folder, "documents").count()
    return np.mean([p == y for p, y in held])


def test_quality(spark, folder):
    assert scored(spark, folder, quality.op2_quality, "quality") > 0.95


def test_toxicity(spark, folder):
    assert scored(spark, folder, toxicity.op5_toxicity, "toxic") > 0.95


def test_spans_are_offsets(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [texts[r.doc_id].encode()[s.begin : s.end].decode() for r in toxicity.score(docs, model).collect() for s in r.spans]
    assert {"vile", "idiotish", "scumword"} <= {w for f in found for w in f.split()}


def test_edges(spark, docs, empty, folder):
    labels = table(spark, folder, "labels")
    none = labels.limit(0)
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, none, column)
        got = module.score(docs, model).collect()
        assert len(got) == docs.count() and len({r.score for r in got}) == 1
        assert module.score(empty, model).count() == 0
        assert all(not r.held_out for r in got if r.doc_id is None)


def test_clean_documents_keep_columns(docs, spark, folder):
    source = table(spark, folder, "documents")
    model = toxicity.fit(source, table(spark, folder, "labels"))
    kept = toxicity.clean_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=6), rng.normal(size=(2, 2))
    p = toxicity.Chains(np.array([0, 6])).marginals(e, t)[0]
    weights = {y: np.exp(sum(e[i] * y[i] for i in range(6)) + sum(t[y[i], y[i + 1]] for i in range(5))) for y in itertools.product((0, 1), repeat=6)}
    total = sum(weights.values())
    assert np.allclose(p, [sum(w for y, w in weights.items() if y[i]) / total for i in range(6)])


def plain_marginals(e, t):
    """Forward and backward, one token after the other."""
    m, n = np.exp(t), len(e)
    a, b = np.ones((n, 2)), np.ones((n, 2))
    a[0] = 1, np.exp(e[0])
    for i in range(1, n):
        a[i] = a[i - 1] @ m * [1, np.exp(e[i])]
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = m @ (b[i + 1] * [1, np.exp(e[i + 1])])
        b[i] /= b[i].sum()
    p = a * b
    return p[:, 1] / p.sum(axis=1)


def test_chains_are_whole_documents():
    """Neighbours on either side of a run's end see one another; empty, short and long documents side by side."""
    rng = np.random.default_rng(2)
    sizes = [0, 1, 64, 65, 300, 0, 129, 63, 5000, 0]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    e, t = rng.normal(size=ptr[-1]) * 3, np.array([[0.5, -1.0], [-2.0, 3.0]])
    p, ahead, behind = toxicity.Chains(ptr).marginals(e, t)
    for x, y in zip(ptr, ptr[1:]):
        if y > x:
            assert np.allclose(p[x:y], plain_marginals(e[x:y], t))
    flat, t = np.zeros(300), np.array([[0.5, -1.0], [-1.0, 0.5]])
    plain = toxicity.Chains(np.array([0, 300])).marginals(flat, t)[0]
    flat[63] = 20
    assert abs(toxicity.Chains(np.array([0, 300])).marginals(flat, t)[0][64] - plain[64]) > 1e-2


def test_the_sample_is_bounded(spark):
    from pavelake.llm.learn import labelled

    d = spark.createDataFrame([(i % 50, "w " * (5000 if i % 50 == 3 else 20)) for i in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(50)] + [(20, 0)], "doc_id long, toxic int")
    rows, stands = labelled(d, labels, "toxic", 20, 600, rare_first=True)
    got = rows.collect()
    assert sum(len(r.text) for r in got) <= 600 and len(got) == len({r.key for r in got}) and sum(r.label for r in got) >= 3
    assert all(len(r.text) == 40 for r in got) and stands[0] > stands[1] >= 1


def test_dual_coordinate_descent_parts_classes():
    docs = [np.array([i % 2, 2 + i % 3]) for i in range(60)]
    values = [np.ones(2) / np.sqrt(2)] * 60
    y = np.array([1 if i % 2 else -1 for i in range(60)])
    w = quality.dual_coordinate_descent(docs, values, y, np.ones(60), 20)
    assert all(np.sign(w[d] @ v + w[-1]) == t for d, v, t in zip(docs, values, y))


def test_pipeline(spark, folder):
    """Each stage against its plain meaning, on what the stage before kept."""
    import corpus_pipeline
    from pavelake.llm import bpe

    from .test_dedup import LOWER, near_truth, split

    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        a, b = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        ids = [r["doc_id"] for r in b]
        if name == "toxicity":
            gone = {r["doc_id"] for r in a} - set(ids)
            assert all("idiotish" in r["text"] for r in a if r["doc_id"] in gone) and len(gone) > 80
        elif name == "exact dedup":
            best = {}
            for r in a:
                k = (r["text"] or "").translate(LOWER)
                best[k] = max(best.get(k, -1), r["doc_id"])
            assert sorted(ids) == sorted(best.values())
        elif name == "near dedup":
            truth = near_truth([(r["doc_id"], r["text"]) for r in a], 80)
            assert sorted(ids) == sorted(i for i, n, c in truth if i == c)
        else:
            words = lambda rs: sum(len(split(r["text"])) for r in rs)
            assert set(ids) <= {r["doc_id"] for r in a} and 0.9 * words(a) <= words(b) <= words(a)
            assert max(ids.count(i) for i in set(ids)) <= 3
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.run(spark, folder)
    plain = bpe.encode(docs, bpe.default_tokenizer(), whole=False)
    key = lambda d: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in d.collect())
    assert key(last) == key(plain)


def test_scores_do_not_hang_on_neighbours(spark, folder):
    """Each text by itself scores what it scores among others, and by the plain sum over its distinct buckets."""
    import pyarrow as pa

    docs = table(spark, folder, "documents").limit(60)
    model = quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    together = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        (_, _, buckets), *rest = quality.indicators(pa.array([r.text])) if r.text else ((None, None, np.zeros(0, int)),)
        assert not rest
        x = {int(b) for b in buckets}
        ratio = {b: float(model["ratio"][b]) for b in x}
        norm = sum(v * v for v in ratio.values()) ** 0.5 or 1.0
        margin = sum(float(model["weights"][b]) * ratio[b] for b in x) / norm + model["bias"]
        score = 1 / (1 + np.exp(-(model["line"][0] + model["line"][1] * margin)))
        assert abs(together[r.doc_id] - score) < 1e-5


def test_dual_meets_the_primal():
    """The fitted model's objective is that of a long descent on the primal."""
    rng = np.random.default_rng(4)
    docs = [rng.choice(30, 6, replace=False) for _ in range(80)]
    y = np.array([1 if (d < 12).sum() + rng.normal() > 2.4 else -1 for d in docs])
    values = [np.ones(6) / np.sqrt(6)] * 80
    w = quality.dual_coordinate_descent(docs, values, y, np.ones(80), 400)
    x = np.zeros((80, 31))
    for i, (d, v) in enumerate(zip(docs, values)):
        x[i, d], x[i, 30] = v, 1
    cost = lambda u: 0.5 * u @ u + np.maximum(0, 1 - y * (x @ u)).sum()
    u, best = np.zeros(31), np.inf
    for k in range(1, 20_001):
        u = u - (u - (y * (y * (x @ u) < 1)) @ x) / k
        best = min(best, cost(u))
    mine = cost(np.append(w[:30], w[-1]))
    assert mine <= best * 1.01


def test_token_features():
    """Marks at the ends and the case of A-Z don't count; words with one beginning share its feature; others differ."""
    import pyarrow as pa

    from pavelake.llm import tokens

    f = lambda text: toxicity.token_features(next(tokens.slices(pa.array([text]))))
    a = f("Idiot idiot, (IDIOT!) idiots idle réeuxpa réeuxan *** ***")
    assert (a[0] == a[1]).all() and (a[0] == a[2]).all() and a[0, 0] != a[3, 0]
    assert (a[0, 1:3] == a[3, 1:3]).all() and a[0, 1] != a[4, 1]
    assert (a[5, 1:4] == a[6, 1:4]).all() and a[5, 0] != a[6, 0] and (a[7] == a[8]).all()


def test_toxic_features_by_hand():
    """Only what parts the classes beyond chance is marked: a word of toxic documents, and a stem that rare words share."""
    rng = np.random.default_rng(5)
    docs, y = [], []
    for i in range(300):
        toxic = i % 8 == 0
        words = rng.integers(10, 60, 30)
        rows = [[w, w % 7 + 1000, w % 11 + 2000, w % 13 + 3000, w % 17 + 4000] for w in words]
        if toxic:
            rows += [[5, 5001, 5002, 5003, 5004]] if i % 16 else [[6000 + int(rng.integers(400)), 7001, 7002, 7003, 7004] for _ in range(3)]
        docs.append(np.array(rows, np.int32))
        y.append(int(toxic))
    marked = set(np.flatnonzero(toxicity.toxic_features(toxicity.Sample(docs), np.arange(300), np.array(y))).tolist())
    assert {5, 5001, 7001, 7004} <= marked and not {m for m in marked if m < 5 or 10 <= m < 5000}


def test_commoner_language_is_no_evidence(spark):
    """Half of the sample is toxic, so in it most documents of a language that is commoner among toxic ones are toxic. Among all labelled
    rows most are clean, and stay."""
    rng = random.Random(8)
    texts, toxic = [], []
    for i in range(3000):
        bad = i % 12 == 0
        stem = "nordwort" if rng.random() < (0.5 if bad else 0.15) else "sudvocab"
        words = [f"{stem}{rng.randrange(10**6)}" for _ in range(40)]
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), f"nasty{rng.randrange(300)}")
        texts.append((i, " ".join(words)))
        toxic.append(int(bad))
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(4)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").coalesce(1), most_rows=400)
    kept = {r.doc_id for r in toxicity.clean_documents(docs, model).collect()}
    left_alone = np.mean([i in kept for i, y in enumerate(toxic) if not y])
    caught = np.mean([i not in kept for i, y in enumerate(toxic) if y])
    assert caught > 0.97 and left_alone > 0.98
    whole = dict(texts)
    spans = [whole[r.doc_id][s.begin : s.end] for r in toxicity.score(docs, model).collect() for s in r.spans]
    assert spans and all("nasty" in s for s in spans)


@pytest.mark.parametrize("n", [2, 3, 7, 8, 40])
def test_quality_by_one_rule_at_every_size(spark, n):
    """From two rows of a class on: the model of all rows, calibrated on rows that a model has not seen."""
    rng = random.Random(n)
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2][: 2 * n]
    texts = {i: " ".join(rng.choices(["the river runs by the old mill", "stone bridges last for ages", "she wrote a letter home"] if k % 2 else ["BUY!!! now $$$", "free %%% click", "win 000 cash"], k=8)) for k, i in enumerate(ids)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int"))
    x = [np.frombuffer(bytes(r.buckets), dtype=np.int32) for r in quality.labelled(docs, spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int"), "quality", 100, 10**6)[0].mapInArrow(quality.features, "label int, key long, buckets binary").orderBy("key", "buckets").collect()]
    y = np.array([r.label for r in quality.labelled(docs, spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int"), "quality", 100, 10**6)[0].mapInArrow(quality.features, "label int, key long, buckets binary").orderBy("key", "buckets").collect()])
    w, ratio = quality.train(x, y)
    assert np.allclose(model["weights"], w[:-1], atol=1e-6) and np.allclose(model["ratio"], ratio, atol=1e-5)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    if n >= 7:
        assert all((scores[i] > 0.5) == bool(k % 2) for k, i in enumerate(ids))
    assert all(0 <= s <= 1 for s in scores.values())
