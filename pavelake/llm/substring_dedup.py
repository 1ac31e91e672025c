"""Substring deduplication by compaction of a De Bruijn graph of word windows.

The graph's edges are the windows of `window` consecutive words. Windows are cut into super-windows:
maximal runs that share their minimizer (the leftmost smallest hash among their 12-word grams), so equal
windows always meet at equal minimizers and about one word in thirteen sends a row. A minimizer all of
whose occurrences carry the same super-window is a nonbranching path: it compacts to one span and each
of its windows is repeated, with no need to look at them one by one. Only where super-windows
differ (the graph branches: a repeat begins or ends) single windows are compared, in joins on
their hashes. Source coordinates (document, word) carry the spans back to the texts.

Hot passages are summed map-side and split in the joins that lead back to the texts; each document's spans
are a set of its own words at most. Windows are compared as 64-bit hashes of all their words.

Defined results: null, blank and short texts lose nothing; every occurrence of a repeated window goes,
the first one too; rows equal in doc_id and text repeat each other; a very long text is windowed in whole; an empty table gives an empty
result; columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import cut, join_counted, table

WINDOW = 35
GRAM = 12


def leftmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the position of the leftmost smallest of x[i:i+width]."""
    value, place, have = x, np.arange(len(x)), 1
    kept = None
    parts = []
    rest = width
    # powers of two, then the binary digits of width put side by side
    while True:
        if rest & have:
            parts.append((have, value, place))
        if 2 * have > width:
            break
        right = value[have:] < value[:-have]
        value, place = np.where(right, value[have:], value[:-have]), np.where(right, place[have:], place[:-have])
        have *= 2
    done = 0
    for size, v, p in reversed(parts):
        if kept is None:
            kept = (v, p)
        else:
            n = len(v) - done
            left_v, left_p = kept[0][:n], kept[1][:n]
            right = v[done : done + n] < left_v
            kept = (np.where(right, v[done:], left_v), np.where(right, p[done:], left_p))
        done += size
    return kept[1][: len(x) - width + 1]


def super_windows(window: int, gram: int):
    """mapInArrow: node (minimizer), span (hash of the super-window), uid, at (first word), n (windows)."""

    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for s in tokens.slices(batch.column(1)):
                words = s.word_hashes()
                if len(words) < window:
                    continue
                grams = tokens.gram_hashes(words, gram)
                least = leftmost_minima(grams, window - gram + 1)
                row = s.row_of_word()[: len(least)]
                valid = np.flatnonzero(np.arange(len(least)) + window <= s.ptr[1:][row])
                if not len(valid):
                    continue
                m, r = least[valid], row[valid]
                head = np.ones(len(valid), bool)
                head[1:] = (m[1:] != m[:-1]) | (r[1:] != r[:-1])
                first = np.flatnonzero(head)
                n = np.diff(np.append(first, len(valid)))
                a = valid[first]
                z = a + n - 1 + window
                sums = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(words * tokens.powers(tokens._Q, len(words)), out=sums[1:])
                span = tokens.mix((sums[z] - sums[a]) * tokens.powers(tokens._Q_INV, len(words) + 1)[a] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[m[first]].view(np.int64)), pa.array(span.view(np.int64)), pa.array(uid[s.first + r[first]]), pa.array((a - s.ptr[r[first]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["node", "span", "uid", "at", "n"],
                )

    return run


def probe_windows(window: int):
    """mapInArrow: the single windows of super-windows at branches."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                uid, spans = part.column(0).to_pylist(), part.column(3).to_pylist()
                for s in tokens.slices(part.column(2)):
                    grams = tokens.gram_hashes(s.word_hashes(), window)
                    found = [(uid[s.first + r], s.ptr[r], x) for r in range(s.rows) for x in spans[s.first + r] if x["probe"]]
                    if not found:
                        continue
                    n = np.array([x["n"] for _, _, x in found])
                    word = np.repeat([x["at"] for _, _, x in found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    begin = np.repeat([p for _, p, _ in found], n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams[begin + word].view(np.int64)), pa.array(np.repeat([x["span"] for _, _, x in found], n)), pa.array(np.repeat([u for u, _, _ in found], n)), pa.array(word.astype(np.int32)), pa.array(np.repeat([x["sure"] for _, _, x in found], n))],
                        ["w", "span", "uid", "word", "sure"],
                    )

    return run


def keep_words(window: int):
    """mapInArrow: counts, digest and the text without the repeated words."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = zip(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist())
                words_n, gone_n, digest, kept_text = [], [], [], []
                for text, spans, more in rows:
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    words_n.append(len(words))
                    kept = words
                    if spans or more:
                        change = np.zeros(len(words) + 1, np.int64)
                        for x in spans or ():
                            if x["sure"]:
                                change[x["at"]] += 1
                                change[x["at"] + x["n"] - 1 + window] -= 1
                        for p in more or ():
                            change[p] += 1
                            change[p + window] -= 1
                        kept = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                    gone_n.append(len(words) - len(kept))
                    joined = b" ".join(kept)
                    digest.append(hashlib.sha256(joined).hexdigest())
                    kept_text.append(joined.decode())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row."""
    source = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")
    found = source.select("uid", "text").mapInArrow(super_windows(window, gram), "node long, span long, uid long, at int, n int")
    nodes = cut(found.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("span").alias("s0"), F.max("span").alias("s1")).filter("c > 1").select("node", "c", (F.col("s0") != F.col("s1")).alias("branching")))
    repeated = cut(join_counted(found, nodes, ["node"], "c", F.xxhash64("uid", "at")))
    paths = repeated.filter("not branching").select("uid", "at", "n", "span", F.lit(True).alias("sure"), F.lit(False).alias("probe"))
    open_ = repeated.filter("branching")
    kinds = cut(open_.groupBy("node", "span").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("one")).withColumn("sure", F.col("c") > 1))
    ends = join_counted(open_, kinds, ["node", "span"], "c", F.xxhash64("uid", "at")).select("uid", "at", "n", "span", "sure", (~F.col("sure") | (F.col("uid") == F.col("one"))).alias("probe"))
    spans = paths.unionByName(ends).groupBy("uid").agg(F.collect_set(F.struct("at", "n", "span", "sure", "probe")).alias("spans"))
    # texts are shuffled once: both joins name the same columns, so the plan reuses their exchange; the spans
    # are the side that is hashed, so texts are not sorted
    probed = source.join(spans.filter(F.exists("spans", lambda x: x["probe"])).hint("shuffle_hash"), "uid").select("uid", "doc_id", "text", "spans")
    windows = probed.mapInArrow(probe_windows(window), "w long, span long, uid long, word int, sure boolean")
    twice = windows.groupBy("w").agg(F.min("span").alias("s0"), F.max("span").alias("s1")).filter("s0 <> s1").select("w")
    verified = windows.filter("not sure").join(twice, "w").groupBy("uid").agg(F.collect_set("word").alias("words"))
    marked = source.join(spans.hint("shuffle_hash"), "uid", "left").join(verified.hint("shuffle_hash"), "uid", "left").select("uid", "doc_id", "text", "spans", "words")
    return marked.mapInArrow(keep_words(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d WHERE len(words) > 0
), g AS (
  SELECT doc_id, i, words[i] AS word, CASE WHEN i + 34 <= len(words) THEN md5(array_to_string(words[i:i+34], ' ')) END AS h FROM w
), r AS (
  SELECT *, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS rep FROM g
), c AS (
  SELECT *, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r
), k AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
