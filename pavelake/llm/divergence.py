"""Audit of how sources differ: exact divergences between the sources of a language and the terms that mark a source.

Terms are counted in Arrow batches (a row per group and term of a slice), summed map-side and shuffled as counts. A language keeps the terms
of at least `least_docs` of its documents. Shares are whole billionths by long division, so all arithmetic is exact in 64 bits.

Ranking is a radix select: a histogram of 16 bits of the value for each group, from the top, finds the digit in which the k-th row
falls, until the k-th value is known; where more rows have that value than are wanted, histograms over the first character that tells them
apart refine by UTF-8 order (which is code point order). Only what is selected is sorted, a bounded number of rows for each group.

Divergence sums are sparse: a pair's sum over all kept terms is that of two sources without any count, corrected for the terms
of the one (by a histogram of its counts), of the other, and of both (found from each term's list of sources and summed in the
task, so pairs of a term are never shuffled).

Defined results: null text, lang or source count as empty; every row is a document, repeated ones too; groups without terms are
there with counts of 0; a language without kept terms has divergences of 0 and no marking terms; very long texts are counted in whole;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import FEW, cut, join_counted, small, table

BILLION = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
SLICE_BYTES = 8 << 20
PAIRS_AT_ONCE = 1 << 20
SUMS_HELD = 500_000
#: Ties of a group that are ordered at once; beyond that they are refined by characters first.
TIES = 1000

_NO_TERM = np.zeros(256, dtype=bool)
_NO_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs for every slice of rows; input lang, source, text without nulls."""
    for batch in batches:
        names = pa.StructArray.from_arrays(batch.columns[:2], ["lang", "source"])
        keys: dict[tuple, int] = {}
        group = np.array([keys.setdefault((x["lang"], x["source"]), len(keys)) for x in names.to_pylist()], dtype=np.int64)
        langs, sources = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
        for s in tokens.slices(batch.column(2), _NO_TERM, SLICE_BYTES):
            if not len(s.starts):
                continue
            coded = s.words(lower=True).dictionary_encode()
            size = len(coded.dictionary)
            seen, n = np.unique(s.row_of_word() * size + coded.indices.to_numpy(), return_counts=True)
            at, inverse, docs = np.unique(group[s.first + seen // size] * size + seen % size, return_inverse=True, return_counts=True)
            total = np.zeros(len(at), dtype=np.int64)
            np.add.at(total, inverse, n)
            of, term = pa.array(at // size), pa.array(at % size)
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), coded.dictionary.take(term), pa.array(total), pa.array(docs)], schema=_COUNTS)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / total): long division in two steps, exact up to totals of 9e14."""
    high, low = 100_000, 10_000
    scaled = ((count + 1) * high).alias("scaled")
    q = F.call_function("div", scaled, total)
    return 1 + q * low + F.call_function("div", (scaled % total) * low, total)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def counted(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, n_lang, first (marks one row for each lang and term) of the kept terms."""
    text = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    raw = text.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    posts = raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    kept = posts.select("lang", "source", "term", "n", F.sum("n").over(w).alias("n_lang"), F.sum("docs").over(w).alias("df"), (F.min("source").over(w) == F.col("source")).cast("long").alias("first"))
    return cut(kept.filter(F.col("df") >= least_docs).drop("df"))


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """gid, lang, source, terms (rows of kept), total, lang_total, v, base (share of a term that is not there): a row for each group."""
    names = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"), F.sum("first").alias("first"))
    all_of = Window.partitionBy("lang")
    g = names.join(own, ["lang", "source"], "left").fillna(0, ["n", "terms", "first"])
    g = g.withColumn("v", F.sum("first").over(all_of))
    g = g.withColumn("total", F.col("n") + F.col("v")).withColumn("lang_total", F.sum("n").over(all_of) + F.col("v"))
    g = g.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "terms", "v", "total", "lang_total", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"))).otherwise(1).alias("base"))
    return cut(g)


def with_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Rows of lang, source with their group's figures; a few groups are broadcast, more are joined with hot ones split."""
    if few:
        return rows.join(F.broadcast(groups.drop("terms")), ["lang", "source"])
    return join_counted(rows, groups, ["lang", "source"], "terms", F.xxhash64("term"))


# ---- radix select


def kth_value(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, edge (the k-th largest value, or -1 where there are at most k rows), need (rows of that value that are wanted), ties (how many there are)."""
    top = rows.agg(F.max("value")).first()[0] or 0
    state = rows.select(keys).distinct().select(*keys, F.lit(0).cast("long").alias("edge"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("ties"))
    shifts = [s for s in (48, 32, 16, 0) if top >> s or not s]
    for shift in shifts:
        digit = F.shiftright("value", shift)
        inside = rows.join(small(state), keys)
        if shift != shifts[0]:  # above the first digit all values are alike
            inside = inside.filter(F.shiftright("value", shift + 16) == F.col("edge"))
        hist = inside.groupBy(*keys, digit.alias("digit"), "need").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.desc("digit")))
        hist = hist.withColumn("upto", upto)
        found = hist.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need"))).select(*keys, F.col("digit").alias("d"), (F.col("need") - F.col("upto") + F.col("c")).alias("left"), "c")
        state = state.join(found, keys, "left").select(*keys, F.coalesce("d", F.lit(-1)).alias("edge"), F.coalesce("left", F.lit(0)).alias("need"), F.coalesce("c", F.lit(0)).alias("ties"))
        state = cut(state)
    return state


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first character in which two different strings differ, from 1."""
    most = F.least(F.char_length(a), F.char_length(b)) + 1
    return F.array_min(F.filter(F.sequence(F.lit(1), most), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def ended(item: Column) -> Column:
    return F.concat(item, F.lit("\0"))


def refine_ties(tied: DataFrame, keys: list[str], ties: int) -> DataFrame:
    """keys, upto: a group's tied items that are below upto or begin with it are those needed and at most `ties` more.

    tied: keys, item, need. Items end with a sign below all others; each round takes the character after what a group's items still share.
    """
    rows, done = cut(tied.withColumn("item", ended(F.col("item"))).withColumn("upto", F.lit(""))), None
    while True:
        sizes = rows.groupBy(*keys, "need", "upto").agg(F.count(F.lit(1)).alias("c"), F.min("item").alias("low"), F.max("item").alias("high"))
        sizes = cut(sizes)
        settled = (F.col("c") <= F.col("need") + ties) | (F.col("low") == F.col("high"))
        ready = sizes.filter(settled).select(*keys, "upto")
        done = ready if done is None else done.unionByName(ready)
        more = sizes.filter(~settled).select(*keys, first_difference(F.col("low"), F.col("high")).alias("at"))
        if more.isEmpty():
            return done
        dealt = rows.join(small(more), keys).withColumn("digit", F.substring(F.col("item"), F.lit(1), F.col("at")))
        hist = dealt.groupBy(*keys, "need", "digit").agg(F.count(F.lit(1)).alias("c")).withColumn("sum", F.sum("c").over(Window.partitionBy(*keys).orderBy("digit")))
        edge = hist.filter((F.col("sum") >= F.col("need")) & (F.col("sum") - F.col("c") < F.col("need"))).select(*keys, F.col("digit").alias("upto"), (F.col("need") - F.col("sum") + F.col("c")).alias("need"))
        edge = cut(edge)
        rows = cut(rows.drop("need", "upto").join(small(edge), keys).filter(F.expr("startswith(item, upto)")))


def top_rows(rows: DataFrame, keys: list[str], k: int = TOP, ties: int = TIES) -> DataFrame:
    """The k first rows of each group by value descending, item ascending, with rank. rows: keys, item, value (not negative)."""
    state = kth_value(rows, keys, k)
    over = state.filter(F.col("ties") > F.col("need") + ties)
    known = rows.join(small(state), keys)
    upto = None
    if not over.isEmpty():
        tied = known.filter((F.col("value") == F.col("edge")) & (F.col("ties") > F.col("need") + ties))
        upto = refine_ties(tied.select(*keys, "item", "need"), keys, ties)
    chosen = known.filter(F.col("value") >= F.col("edge"))
    if upto is not None:
        chosen = chosen.join(small(upto), keys, "left")
        chosen = chosen.filter(F.col("upto").isNull() | (F.col("value") > F.col("edge")) | (F.col("item") < F.col("upto")) | F.startswith(ended(F.col("item")), F.col("upto")))
    by = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    return chosen.select(*keys, "item", "value", F.row_number().over(by).alias("rank")).filter(F.col("rank") <= k)


# ---- divergences


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, value: what terms that two groups share add to their divergence; input a list of gid, p, base for each term."""
    def div(p, q):
        return (p - q) * (p - q) // q

    sums: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = [pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(out, ["a", "b", "value"])

    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        gid, p, base = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("gid", "p", "base"))
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.repeat(np.cumsum(size) - size, size)
        with_ = np.repeat(size, size)
        names, code = np.unique(gid, return_inverse=True)
        upto = np.cumsum(with_)
        e = 0
        while e < len(gid):
            stop = max(e + 1, int(np.searchsorted(upto, (upto[e - 1] if e else 0) + PAIRS_AT_ONCE, side="right")))
            own = np.repeat(np.arange(e, stop), with_[e:stop])
            other = begins[own] + np.arange(len(own)) - np.repeat(upto[e:stop] - with_[e:stop] - (upto[e - 1] if e else 0), with_[e:stop])
            apart_ = own != other
            own, other = own[apart_], other[apart_]
            values = div(p[own], p[other]) - div(p[own], base[other]) - div(base[own], p[other]) + div(base[own], base[other])
            pairs, inverse = np.unique(code[own] * len(names) + code[other], return_inverse=True)
            total = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(total, inverse, values)
            for a, b, v in zip(names[pairs // len(names)].tolist(), names[pairs % len(names)].tolist(), total.tolist()):
                sums[a, b] += v
            if len(sums) > SUMS_HELD:
                yield flush()
            e = stop
    yield flush()


def divergences(kept: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """lang, source, item (each other source of the lang), value."""
    g = groups.select("gid", "lang", "source", "v", "total", "base")
    one, two = (g.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("gid", "source", "v", "total", "base"))) for x in "ab")
    broad = F.broadcast if few else (lambda d: d)
    base = one.join(broad(two), "lang").filter("gid_a <> gid_b").select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b"), (F.col("v_a") * apart(F.col("base_a"), F.col("base_b"))).alias("value"))
    # terms of one group: a row for each of its counts, against the groups where such a term is missing
    hist = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    hist = hist.join(broad(one.withColumnRenamed("source_a", "source")), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total_a")))
    missing = hist.join(broad(two), "lang").filter("gid_a <> gid_b")
    here = F.col("m") * (apart(F.col("p"), F.col("base_b")) - apart(F.col("base_a"), F.col("base_b")))
    there = F.col("m") * (apart(F.col("base_b"), F.col("p")) - apart(F.col("base_b"), F.col("base_a")))
    sums = missing.groupBy("gid_a", "gid_b").agg(F.sum(here).alias("here"), F.sum(there).alias("there"))
    ways = F.explode(F.array(F.struct(F.col("gid_a").alias("a"), F.col("gid_b").alias("b"), F.col("here").alias("value")), F.struct(F.col("gid_b").alias("a"), F.col("gid_a").alias("b"), F.col("there").alias("value"))))
    sums = sums.select(ways.alias("w")).select("w.*")
    posts = with_groups(kept.select("lang", "source", "term", "n"), groups, few).select("lang", "term", F.struct("gid", share(F.col("n"), F.col("total")).alias("p"), "base").alias("s"))
    both = posts.groupBy("lang", "term").agg(F.collect_list("s").alias("s")).filter(F.size("s") > 1).select("s").mapInArrow(shared_terms, "a long, b long, value long")
    total = base.unionByName(sums).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = total.join(broad(g.select(F.col("gid").alias("a"), "lang", "source")), "a").join(broad(g.select(F.col("gid").alias("b"), F.col("source").alias("item"))), "b")
    return named.select("lang", "source", "item", "value")


def marking_terms(kept: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """lang, source, item, value of the terms that a group uses more than its language."""
    rows = with_groups(kept, groups, few)
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("n_lang"), F.col("lang_total")).alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP, ties: int = TIES) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = counted(docs, least_docs)
    groups = groups_of(docs, kept)
    few = groups.limit(FEW + 1).count() <= FEW
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = divergences(kept, groups, few).withColumn("rank", F.row_number().over(by))
    terms = top_rows(cut(marking_terms(kept, groups, few)), ["lang", "source"], k, ties)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.select(columns("pair")).unionByName(terms.select(columns("term")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), w AS (SELECT uid, lang, source, unnest(ws) AS term FROM d
), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT uid) >= 3
), c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), t AS (
  SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) + coalesce(v.v, 0) AS total,
         coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang), 0) + coalesce(v.v, 0) AS lang_total
  FROM g LEFT JOIN v USING (lang)
), p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // t.total::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (l.n + 1)) // t.lang_total::HUGEINT AS q
  FROM t JOIN kept USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term
  JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) l ON l.lang = t.lang AND l.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM t a JOIN t b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value,
           row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank
    FROM p WHERE n > 0 AND p > q
  ) WHERE rank <= 200
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""
