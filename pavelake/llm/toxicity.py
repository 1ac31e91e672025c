"""Toxic spans by a linear-chain conditional random field.

Tokens are words without marks at their ends, lower-cased in A-Z; a token's features are the word and its
beginnings of four to seven bytes. Labels are given for documents, so the labelled tokens the field
is trained on are derived from them: a feature counts as toxic if it occurs in toxic documents far more
often than chance explains and 0.4 of the labelled rows it occurs in are toxic, as their number is estimated from the sample, and a token of a toxic document is labelled toxic if it has such a feature; all
tokens of other documents are clean. The two-state field is fitted by gradient ascent on the likelihood of
those sequences. Forward-backward marginals of all tokens of a text give its toxic spans
and, through their sum and their maximum, its score. A sequence is a whole document.

Fitted on at most `most_rows` labelled rows of at most `most_bytes` bytes of text, label 1 first up to half of either (documented
bounds of the sample, which alone passes through the driver); every text is scored in whole. Labels, language, source and id
are never inputs of a score.

Defined results: null and blank texts have no tokens and score like a text whose tokens are all clean; repeated rows get equal
scores and are learnt from once; a very long text is one chain, and passed over in the fit where it exceeds what is left of the
bound; of several labels of an id the largest counts; without labels of both classes every score is the share of label 1 (0.05 without
any label); an empty table gives an empty result; columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import released, table
from .learn import held_out, labelled, logistic, sigmoid

BUCKETS = 1 << 20
MOST_ROWS = 4000
MOST_BYTES = 3 << 20
FOLDS = 4
THRESHOLD = 0.3
RUN = 16
BEGINNINGS = (4, 5, 6, 7)
EPOCHS = 30
SPAN_AT = 0.5
EVIDENCE = 1.0
KINDS = 1 + len(BEGINNINGS)


def token_features(s: tokens.Slice) -> np.ndarray:
    """words x KINDS buckets."""
    data, n = s.data, len(s.data)
    letter = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    place = np.arange(n)
    after = np.minimum.accumulate(np.where(letter, place, n)[::-1])[::-1] if n else place
    before = np.maximum.accumulate(np.where(letter, place, -1)) if n else place
    a, z = after[s.starts], before[s.ends - 1] + 1
    bare = (a >= s.ends) | (z <= a)
    a, z = np.where(bare, s.starts, a), np.where(bare, s.ends, z)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(tokens._TABLE_LOWER[data] * tokens.powers(tokens._R, n), out=sums[1:])
    back = tokens.powers(tokens._R_INV, n + 1)[a]
    out = np.empty((len(a), KINDS), np.int32)
    for kind, size in enumerate((0, *BEGINNINGS)):
        end = z if not size else np.minimum(a + size, z)
        h = tokens.mix((sums[end] - sums[a]) * back + np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % 2**64))
        out[:, kind] = (h % np.uint64(BUCKETS)).astype(np.int32)
    return out


#: Text whose tokens are worked on together; a token takes some 300 bytes in between.
SLICE_BYTES = 256 << 10


def features(batches):
    """mapInArrow over label, text, key: the token buckets of each row as bytes."""
    for batch in batches:
        out = []
        for s in tokens.slices(batch.column(1)):
            f = token_features(s)
            out += [f[x:y].tobytes() for x, y in zip(s.ptr, s.ptr[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["label", "key", "buckets"])


class Chains:
    """Tokens of documents side by side: document r has tokens ptr[r]..ptr[r+1], one chain from first to last.

    Chains are laid out in runs of RUN tokens only to be worked on side by side. What passes over a run is a 2x2 matrix; these
    matrices carry the forward and backward scores across the runs of a document, so marginals are those of the whole chain.
    """

    def __init__(self, ptr: np.ndarray):
        n = np.diff(ptr)
        per = -(-n // RUN)
        self.k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first = np.repeat(ptr[:-1], per) + self.k * RUN
        size = np.minimum(RUN, np.repeat(ptr[1:], per) - first)
        # a column for each run, so that what is worked on together lies together
        self.there = np.arange(RUN)[:, None] < size[None, :]
        self.at = np.where(self.there, first[None, :] + np.arange(RUN)[:, None], 0)
        self.size = size
        self.place = np.arange(RUN)[None, :] < size[:, None]
        by_k = np.argsort(self.k, kind="stable")
        ends = np.cumsum(np.bincount(self.k)) if len(self.k) else np.zeros(0, int)
        self.steps = [by_k[a:z] for a, z in zip(ends[:-1], ends[1:])]  # the second runs of documents, the third, ...
        self.follows = np.ones(int(ptr[-1] - ptr[0]), bool)
        self.follows[ptr[:-1][n > 0] - ptr[0]] = False

    def marginals(self, e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For log-odds e of the tokens: posterior of state 1, forward odds, and backward odds with the token's own."""
        m = np.exp(moves)
        x = np.exp(np.clip(e, -30, 30))[self.at]
        starts, long = self.k == 0, np.flatnonzero(self.k[1:] > 0) if len(self.k) else []
        before, after = np.ones(x.shape[1]), np.ones(x.shape[1])  # odds that enter a run from either side
        if len(long):
            p = self._passed(x, m, starts)
            for r in self.steps:
                o = before[r - 1]
                before[r] = (p[0, 1, r - 1] + o * p[1, 1, r - 1]) / (p[0, 0, r - 1] + o * p[1, 0, r - 1])
            for r in reversed(self.steps):
                o = after[r]
                after[r - 1] = (p[1, 0, r] + o * p[1, 1, r]) / (p[0, 0, r] + o * p[0, 1, r])
        ahead, behind = np.empty_like(x), np.empty_like(x)
        ahead[0] = x[0] * np.where(starts, 1.0, (m[0, 1] + before * m[1, 1]) / (m[0, 0] + before * m[1, 0]))
        for i in range(1, RUN):
            o = ahead[i - 1]
            ahead[i] = x[i] * (m[0, 1] + o * m[1, 1]) / (m[0, 0] + o * m[1, 0])
        behind[-1] = after
        for i in range(RUN - 2, -1, -1):
            o = x[i + 1] * behind[i + 1]
            behind[i] = np.where(self.size == i + 1, after, (m[1, 0] + o * m[1, 1]) / (m[0, 0] + o * m[0, 1]))
        ahead, behind, x = (v.T[self.place] for v in (ahead, behind, x))
        o = ahead * behind
        return o / (1.0 + o), ahead, x * behind

    def _passed(self, x: np.ndarray, m: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What passes over each run: scores of its last token's states from either state before the run."""
        p = np.empty((2, 2, x.shape[1]))
        for i in (0, 1):
            p[i, 0] = np.where(starts, i == 0, m[i, 0])
            p[i, 1] = np.where(starts, i == 1, m[i, 1]) * x[0]
        for i in range(1, RUN):
            on = self.there[i]
            new = np.empty_like(p)
            new[:, 0] = p[:, 0] * m[0, 0] + p[:, 1] * m[1, 0]
            new[:, 1] = (p[:, 0] * m[0, 1] + p[:, 1] * m[1, 1]) * x[i]
            new /= new.sum(axis=(0, 1))
            p = np.where(on, new, p)
        return p


class Sample:
    """The documents of a fit: their tokens as numbers of kinds (equal tokens have equal features), and how many different
    words of each document have a feature."""

    def __init__(self, docs: list[np.ndarray]):
        self.size = np.array([len(d) for d in docs])
        f = np.concatenate(docs)
        mark = np.zeros(len(f), np.uint64)
        for k, turn in enumerate(tokens.mix(np.arange(1, KINDS + 1, dtype=np.uint64))):
            mark += tokens.mix(f[:, k].astype(np.uint64) * turn)
        _, one, self.kind = np.unique(mark, return_index=True, return_inverse=True)
        self.kinds = f[one]
        doc = np.repeat(np.arange(len(docs)), self.size)
        words = np.unique(doc * len(one) + self.kind)
        pairs, self.many = np.unique(np.repeat(words // len(one), KINDS) * BUCKETS + self.kinds[words % len(one)].ravel(), return_counts=True)
        self.doc = (pairs // BUCKETS).astype(np.int32)
        # buckets that occur, and for each pair which of them
        self.buckets, self.feature = np.unique(pairs % BUCKETS, return_inverse=True)
        self.ptr = np.concatenate([[0], np.cumsum(self.size)])

    def tokens_of(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of the tokens of some documents, and where these begin."""
        return np.concatenate([self.kind[self.ptr[i] : self.ptr[i + 1]] for i in use]), np.concatenate([[0], np.cumsum(self.size[use])])


def toxic_features(sample: Sample, use: np.ndarray, y: np.ndarray, clean_per_toxic: float = 1.0) -> np.ndarray:
    """Buckets (as flags) that mark toxic ones among these documents beyond chance, strong ones first, then those that explain the rest.

    What is counted are the different words of a document that have a feature, so a stem that several words of a few
    toxic documents share is found where each of these words is too rare by itself. Chance is judged by the documents at hand,
    but 0.4 of a feature's words and documents must be toxic among all labelled rows: a clean document stands for
    `clean_per_toxic` times as many of these as a toxic one. In a sample that takes label 1 first half of the documents are toxic, and a
    language or a genre that is a little commoner in that half would otherwise pass.
    """
    kind = np.full(len(y), -1)
    kind[use] = y[use]
    n = len(sample.buckets)
    marked = np.zeros(n, bool)
    left = kind == 1

    def counted(which):
        on = which[sample.doc]
        at, many = sample.feature[on], sample.many[on]
        return np.bincount(at, minlength=n), np.bincount(at, weights=many, minlength=n)

    clean_df, clean = counted(kind == 0)
    for _ in range(2):
        if not left.any():
            break
        df, toxic = counted(left)
        base = np.clip(toxic.sum() / (toxic.sum() + clean.sum()), 1e-9, 1 - 1e-9)
        total = np.maximum(toxic + clean, 1)
        rate = np.clip(toxic / total, 1e-9, 1 - 1e-9)
        # evidence of a binomial tail, in nats. Of features looked at, so many are taken that few of those taken are chance
        nats = total * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
        ok = (df >= 0.4 * (df + clean_per_toxic * clean_df)) & (df >= 3) & (toxic >= 0.4 * (toxic + clean_per_toxic * clean)) & (rate > base)
        ranked = np.sort(nats[ok])[::-1]
        enough = ranked > np.log(max((total >= 3).sum(), 2) / (np.arange(len(ranked)) + 1.0)) + EVIDENCE
        marked |= ok & (nats >= (ranked[np.flatnonzero(enough)[-1]] if enough.any() else np.inf))
        left = left & (np.bincount(sample.doc, weights=marked[sample.feature], minlength=len(y)) == 0)
    out = np.zeros(BUCKETS, bool)
    out[sample.buckets[marked]] = True
    return out


def without_near_copies(found: list[np.ndarray]) -> np.ndarray:
    """Which documents to learn from: near copies would make a document's every word look typical, so one of those
    that share a minimum hash of three words is kept."""
    seen: set = set()
    single = np.ones(len(found), bool)
    for i, d in enumerate(found):
        if len(d):
            h = tokens.mix(d[:, 0].astype(np.uint64) + np.uint64(1))
            h = tokens.gram_hashes(h, min(3, len(h)))
            keys = {(0, int(h.min())), (1, int(tokens.mix(h).min()))}
            single[i] = not keys & seen
            seen |= keys
    return np.flatnonzero(single)


def train(sample: Sample, use: np.ndarray, y: np.ndarray, clean_per_toxic: float = 1.0) -> dict:
    """The field fitted to these documents: weights of features, bias and moves, by gradient ascent."""
    marked = toxic_features(sample, use, y, clean_per_toxic)
    kind, ptr = sample.tokens_of(use)
    chains = Chains(ptr)
    there, kind = np.unique(kind, return_inverse=True)
    kinds = sample.kinds[there]
    flat, inverse = np.unique(kinds, return_inverse=True)
    inverse = inverse.reshape(kinds.shape)
    z = (marked[kinds].any(axis=1)[kind] & (np.repeat(y[use], np.diff(ptr)) == 1)).astype(float)
    w, bias, moves = np.zeros(len(flat)), -4.0, np.zeros((2, 2))
    power, power_b, power_m = np.full(len(flat), 1e-2), 1e-2, np.full((2, 2), 1e-2)
    follows = np.flatnonzero(chains.follows)
    seen = np.bincount(2 * z[follows - 1].astype(int) + z[follows].astype(int), minlength=4).reshape(2, 2)
    for _ in range(EPOCHS):
        p, ahead, behind = chains.marginals((w[inverse].sum(axis=1) + bias)[kind], moves)
        miss = np.bincount(kind, weights=z - p, minlength=len(kinds))
        g = np.bincount(inverse.ravel(), weights=np.repeat(miss, KINDS), minlength=len(flat)) - 1e-2 * w
        m, a, b = np.exp(moves), ahead[follows - 1], behind[follows]
        joint = np.stack([np.full_like(a, m[0, 0]), m[0, 1] * b, m[1, 0] * a, m[1, 1] * a * b])
        gm = seen - (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) - 1e-2 * moves
        power += g * g
        w += 0.7 * g / np.sqrt(power)
        power_b += miss.sum() ** 2
        bias += 0.3 * miss.sum() / np.sqrt(power_b)
        power_m += gm * gm
        moves = moves + 0.2 * gm / np.sqrt(power_m)
    weights = np.zeros(BUCKETS, np.float32)
    weights[flat] = w
    return {"weights": weights, "bias": float(bias), "moves": moves}


def signals_of(sample: Sample, use: np.ndarray, model: dict) -> np.ndarray:
    kind, ptr = sample.tokens_of(use)
    p = token_marginals(sample.kinds[kind], ptr, model)
    return doc_signals(p, np.repeat(np.arange(len(use)), np.diff(ptr)), len(use))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, folds: int = FOLDS, near_copies: bool = False) -> dict:
    """The field and the line that turns its signals into scores.

    The line is fitted to signals of documents by fields that have not seen them (`folds` parts, at every size), with
    rows weighed by how many labelled rows they stand for. Of labelled rows that share a minimum hash of three words one is learnt from,
    unless `near_copies`; near copies of a toxic document make all its words look typical of toxic ones.
    """
    chosen, stands_for = labelled(docs, labels, column, most_rows, most_bytes, rare_first=True)
    rows = chosen.mapInArrow(features, "label int, key long, buckets binary").collect()
    rows.sort(key=lambda r: (r["key"], bytes(r["buckets"])))
    found = [np.frombuffer(bytes(r["buckets"]), dtype=np.int32).reshape(-1, KINDS) for r in rows]
    y = np.array([r["label"] for r in rows], dtype=np.int64)
    del rows
    counts = {k: n * stands_for[k] for k, n in enumerate(np.bincount(y, minlength=2)) if n}
    share = counts.get(1, 0.0) / sum(counts.values()) if counts else 0.05
    none = {"weights": np.zeros(BUCKETS, np.float32), "bias": -8.0, "moves": np.zeros((2, 2)), "line": np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0.0, 0.0, 0.0])}
    use = np.arange(len(found)) if near_copies else without_near_copies(found)
    found, y = [found[i] for i in use], y[use]
    if len(set(y.tolist())) < 2 or not sum(map(len, found)):
        return none
    part = np.zeros(len(y), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        part[own] = np.arange(len(own)) % folds
    sample, signals, odds = Sample(found), np.zeros((len(y), 4)), stands_for[0] / stands_for[1]
    for k in range(folds):
        seen, new = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(new):
            signals[new] = signals_of(sample, new, train(sample, seen, y, odds) if sample.size[seen].sum() else none)
    line = logistic(signals, y, ridge=0.05, weight=np.array([stands_for[int(t)] for t in y]))
    return train(sample, np.arange(len(y)), y, odds) | {"line": line}


def doc_signals(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per document: log-odds of the most toxic token, logarithms of the expected number of toxic tokens
    beside the most toxic one and of the number of tokens."""
    total = np.bincount(row, weights=p, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, row, p)
    count = np.bincount(row, minlength=rows)
    top = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(rows), np.log(top / (1 - top)), np.log(np.clip(total - most, 1e-2, 1e3)), np.log1p(count)], axis=1)


def token_marginals(f: np.ndarray, ptr: np.ndarray, model: dict) -> np.ndarray:
    if not len(f):
        return np.zeros(0)
    return Chains(ptr).marginals(model["weights"][f].sum(axis=1) + model["bias"], model["moves"])[0]


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (byte offsets in the UTF-8 text, end exclusive), uid."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches):
        m = spread.value
        for batch in batches:
            scores, spans = [], []
            for s in tokens.slices(batch.column(2), slice_bytes=SLICE_BYTES):
                p = token_marginals(token_features(s), s.ptr, m)
                scores.append(sigmoid(doc_signals(p, s.row_of_word(), s.rows) @ m["line"]))
                own = [[] for _ in range(s.rows)]
                base = row_begins(batch.column(2), s)
                hot = np.flatnonzero(p >= SPAN_AT)
                for i, r in zip(hot.tolist(), s.row_of_word()[hot].tolist()):
                    begin, end = int(s.starts[i]) - base[r], int(s.ends[i]) - base[r]
                    if own[r] and own[r][-1]["last"] == i - 1:
                        own[r][-1] |= {"end": end, "p": max(own[r][-1]["p"], float(p[i])), "last": i}
                    else:
                        own[r].append({"begin": begin, "end": end, "p": float(p[i]), "last": i})
                spans += [[{k: x[k] for k in ("begin", "end", "p")} for x in r] for r in own]
            q = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q, pa.float64()), pa.array((q >= threshold).astype(np.int32)), pa.array(spans, pa.list_(span)), batch.column(3)], ["doc_id", "held_out", "score", "predicted", "spans", "uid"])

    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.xxhash64("doc_id", "text").alias("uid"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<begin:int,end:int,p:double>>, uid long")


def clean_documents(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not scored as toxic, with all their columns; no text is shuffled."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = spread.value
        for batch in batches:
            at = batch.schema.names.index("text")
            for s in tokens.slices(batch.column(at), slice_bytes=SLICE_BYTES):
                scores = sigmoid(doc_signals(token_marginals(token_features(s), s.ptr, m), s.row_of_word(), s.rows) @ m["line"])
                yield batch.slice(s.first, s.rows).filter(pa.array(scores < threshold))

    return docs.mapInArrow(released(run), docs.schema)


def row_begins(texts, s: tokens.Slice) -> list[int]:
    lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in texts.slice(s.first, s.rows)]
    return [0, *np.cumsum(lengths).tolist()]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("uid")
