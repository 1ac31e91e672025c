"""MinHash near-deduplication with tensored banding.

Two collections of `tables` keys each are made from three minhashes per key; a table of the index is
a pair (one key of either collection). So tables**2 tables of six minhashes need 6*tables minhashes
instead of 6*tables**2. The number of tables follows from the threshold, so that a pair at it fails to
meet in any table with a chance of at most 1.5e-4: 10 for 0.85 (4e-6 at 0.9), 14 for 0.8.

Steps: equal shingle sets become one class; classes that meet in a table are joined by chains (a
chain has one link fewer than the bucket has classes, so no pairs are listed); the components
of those chains are candidate clusters; inside a cluster, links are confirmed on the full shingle
sets by a breadth-first search that asks each class once for its unvisited neighbours. A cluster above `block` (shingles, and
ROW_WEIGHT for each class) is first compared with a few pivots, and only what does not hang together through these is searched, in
blocks; a second pass of components joins what the tasks found. So no task holds an unbounded cluster, and nothing is capped.

Defined results: null or blank texts have an empty set, link with nothing and are their own
component; rows with equal doc_id share a component if their texts link; repeated rows share theirs; a null doc_id takes part and its
component is the smallest doc_id that is not null, or null; a very long text is shingled in whole; an empty table gives an empty result; columns
other than doc_id and text are left alone. Shingles are compared as 64-bit hashes, sets and rows as 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, join_counted, packed, partitions_for, row_mark, small, table
from ..operators.graph import components

SHINGLE = 5
PER_KEY = 3
MISS = 1.5e-4
BLOCK = 30_000
ROW_WEIGHT = 100
PIVOTS = 8
PAIRED = 4096
_OTHER = np.uint64(0xA5A5A5A55A5A5A5A)


def shingle_sets(texts, k: int = SHINGLE):
    """Yield the sorted distinct shingle hashes of each row, in order."""
    for s in tokens.slices(texts):
        words = s.word_hashes(lower=True)
        grams = tokens.gram_hashes(words, k)
        for r in range(s.rows):
            a, b = s.ptr[r], s.ptr[r + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield tokens.mix(tokens.gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = tokens.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n] | np.uint64(1), base[n:]


def tables_for(threshold: int) -> int:
    """Keys of a collection, so that a pair at the threshold (in hundredths) is missed with a chance of MISS at most."""
    if not 0 < threshold <= 100:
        raise ValueError(f"threshold {threshold} is not in 1 to 100")
    apart, tables = 1 - (threshold / 100) ** PER_KEY, 1
    while 1 - (1 - apart**tables) ** 2 > MISS:
        tables += 1
    return tables


def sketch(tables: int):
    """mapInArrow: one narrow row per document with its class and the keys of both collections."""

    def run(batches):
        mul, add = seeds(2 * tables * PER_KEY)
        for batch in batches:
            sizes, classes, keys = [], [], []
            for x in shingle_sets(batch.column(2)):
                sizes.append(len(x))
                if not len(x):
                    classes.append(None)
                    keys.append(None)
                    continue
                sums = np.array([np.add.reduce(tokens.mix(x)) + np.uint64(len(x)), np.add.reduce(tokens.mix(x ^ _OTHER))])
                classes.append(dict(zip("ab", tokens.signed(tokens.mix(sums)).tolist())))
                low = np.full(len(mul), np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    h = part[None, :] * mul[:, None] + add[:, None]
                    h ^= h >> np.uint64(32)
                    np.minimum(low, h.min(axis=1), out=low)
                folded = tokens.gram_hashes(low, PER_KEY)[::PER_KEY]
                keys.append(tokens.signed(folded))
            offsets = np.cumsum([0, *(len(k) if k is not None else 0 for k in keys)]).astype(np.int32)
            filled = [k for k in keys if k is not None]
            flat = np.concatenate(filled) if filled else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                ["doc_id", "uid", "n_shingles", "equal", "keys"],
            )

    return run


def pair_keys(tables: int):
    """mapInArrow over classes: a row per table and class, but of classes that meet within PAIRED of them
    only the first (the others get a link to it here), so a hot bucket sends one row for so many classes."""
    place = tokens.mix(np.arange(1, tables * tables + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRED):
                yield from pairs_of(batch.slice(at, PAIRED))

    def pairs_of(batch):
        n = batch.num_rows
        ids = batch.column(0).to_numpy()
        both = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, 2, tables)
        keys = tokens.mix(both[:, 0, :, None] * np.uint64(0xD1342543DE82EF95) + both[:, 1, None, :]).reshape(n, -1) ^ place[None, :]
        flat, owner = keys.ravel(), np.repeat(np.arange(n), tables * tables)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        head = np.ones(len(flat), bool)
        head[1:] = flat[1:] != flat[:-1]
        first = owner[np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))]
        yield pa.RecordBatch.from_arrays([pa.array(flat[head].view(np.int64)), pa.array(ids[owner[head]]), pa.nulls(int(head.sum()), pa.int64())], ["key", "a", "b"])
        links = np.unique(np.stack([owner[~head], first[~head]]), axis=1)
        if links.shape[1]:
            a, b = ids[links[0]], ids[links[1]]
            own = tokens.mix(a.view(np.uint64) * np.uint64(3) + b.view(np.uint64))  # spreads them over the tasks
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(a), pa.array(b)], ["key", "a", "b"])

    return run


def full_sets(batches):
    """mapInArrow: columns unchanged but for the last, text, replaced by the bytes of its shingle set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [x.tobytes() for x in shingle_sets(part.column(part.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], [*part.schema.names[:-1], "grams"])


def search(ids: list[int], sets: list[np.ndarray], threshold: int, settled: np.ndarray | None = None):
    """Spanning links of the graph: 100*intersection >= threshold*union.

    Those of `settled` are known to be of one component: links among them are not looked for.
    """
    n = len(ids)
    settled = np.zeros(n, bool) if settled is None else settled
    size = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(n), size)
    posting = doc[np.argsort(token, kind="stable")]
    count = np.bincount(token)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.concatenate([[0], np.cumsum(size)])
    new = ~settled
    for root in np.flatnonzero(~settled).tolist():
        if not new[root]:
            continue
        new[root] = False
        queue, met = [root], False
        while queue:
            x = queue.pop()
            mine = token[at[x] : at[x + 1]]
            mine = mine[count[mine] > 1]
            shared = np.zeros(n, np.int64)
            for part in range(0, len(mine), 1024):
                t = mine[part : part + 1024]
                c = count[t]
                idx = np.arange(c.sum()) + np.repeat(begin[t] - np.concatenate([[0], np.cumsum(c)[:-1]]), c)
                shared += np.bincount(posting[idx], minlength=n)
            close = shared * (100 + threshold) >= threshold * (size[x] + size)
            if not met and (known := np.flatnonzero(settled & close)).size:
                met = True
                yield ids[known[0]], ids[root]
            near = np.flatnonzero(new & close)
            new[near] = False
            for y in near.tolist():
                yield ids[y], ids[root]
            queue += near.tolist()


def confirm(threshold: int):
    """mapInArrow over rows sorted by task and class: the spanning links that each task finds."""

    def run(batches):
        task, ids, sets, settled = None, [], [], []

        def done():
            links = list(search(ids, sets, threshold, np.array(settled))) if len(ids) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for t, i, known, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if t != task:
                    yield from done()
                    task, ids, sets, settled = t, [], [], []
                if not ids or ids[-1] != i:
                    ids.append(i)
                    sets.append(np.frombuffer(g.as_buffer(), dtype=np.uint64))
                    settled.append(known)
        yield from done()

    return run


def compare(threshold: int):
    """mapInArrow over rows sorted by cluster and part, pivots first: which pivots each class is linked with, as bits and by name."""

    def run(batches):
        group, pivots = None, []
        for batch in batches:
            out = []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for cluster, part, pivot, name, grams in zip(*columns, batch.column(4)):
                if (cluster, part) != group:
                    group, pivots = (cluster, part), []
                x = np.frombuffer(grams.as_buffer(), dtype=np.uint64)
                if pivot:
                    pivots.append((name, x))
                    continue
                shared = [len(np.intersect1d(x, y, assume_unique=True)) for _, y in pivots]
                near = [k for k, (n, (_, y)) in enumerate(zip(shared, pivots)) if n * (100 + threshold) >= threshold * (len(x) + len(y))]
                out.append((cluster, name, sum(1 << k for k in near), [pivots[k][0] for k in near]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], ["cluster", "class", "mask", "near"])

    return run


def main_star(batches):
    """mapInArrow over cluster, masks with their counts (2**PIVOTS at most): the bits of the pivots of its largest component."""
    for batch in batches:
        bits = []
        for masks in batch.column(1).to_pylist():
            groups: list[int] = []
            for x in (m["mask"] for m in masks if m["mask"]):
                apart = [g for g in groups if not g & x]
                for g in groups:
                    x |= g if g & x else 0
                groups = [*apart, x]
            size = lambda g: sum(m["count"] for m in masks if m["mask"] & g)
            bits.append(max(groups, key=lambda g: (size(g), g), default=0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int32()), batch.column(2)], ["cluster", "main", "c"])


def links_of(sets: DataFrame, threshold: int, block: int, parts: int) -> DataFrame:
    """a, b: confirmed links that span each cluster's components. sets: cluster, total, class, weight, grams.

    Clusters up to `block` are searched in a task each. In a larger one all classes are first compared with PIVOTS of them; those
    found to hang together are settled, and what is left open is compared with blocks of all the cluster's classes. Classes of a
    large group of near copies are nearly all settled, so rows are copied in proportion to the few that are not.
    """
    own = F.xxhash64("class")
    small = sets.filter(F.col("total") <= block).select(F.xxhash64("cluster").alias("task"), "class", F.lit(False).alias("settled"), "grams")
    large = sets.filter(F.col("total") > block)
    searched = lambda rows: rows.repartition(parts, "task").sortWithinPartitions("task", "class").mapInArrow(confirm(threshold), "a long, b long")
    if large.isEmpty():
        return searched(small)
    # the least of a cluster's classes in PIVOTS orders: a class number with some bits turned orders anew and can be turned back
    turns = tokens.signed(tokens.mix(np.arange(1, PIVOTS + 1, dtype=np.uint64)) >> np.uint64(2)).tolist()
    firsts = large.groupBy("cluster").agg(*[F.min(F.col("class").bitwiseXOR(F.lit(t))).alias(f"p{k}") for k, t in enumerate(turns)])
    chosen = firsts.select(F.explode(F.array_distinct(F.array(*[F.col(f"p{k}").bitwiseXOR(F.lit(t)) for k, t in enumerate(turns)]))).alias("class"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    blocked = large.withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    block_of = F.pmod(own, F.col("blocks")).cast("int")
    pivots = blocked.join(chosen, "class").select("cluster", F.explode(upto("blocks")).alias("block"), F.lit(True).alias("pivot"), "class", "grams")
    both = pivots.unionByName(blocked.select("cluster", block_of.alias("block"), F.lit(False).alias("pivot"), "class", "grams"))
    beside = both.repartition(parts, "cluster", "block").sortWithinPartitions("cluster", "block", F.desc("pivot"), "class").select("cluster", "block", "pivot", "class", "grams")
    masks = cut(beside.mapInArrow(compare(threshold), "cluster long, class long, mask int, near array<long>"))
    to_pivots = masks.select(F.col("class").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    counts = masks.groupBy("cluster", "mask").count().groupBy("cluster").agg(F.collect_list(F.struct("mask", "count")).alias("masks"), F.sum("count").alias("c"))
    stars = cut(counts.mapInArrow(main_star, "cluster long, main int, c long"))
    known = join_counted(masks.drop("near"), stars, ["cluster"], "c", own).select("class", F.expr("(mask & main) > 0").alias("settled"))
    state = blocked.join(known, "class")
    sums = state.groupBy("cluster").agg(F.sum(F.when(~F.col("settled"), F.col("weight"))).alias("open"), F.count(F.lit(1)).alias("c")).filter("open is not null")
    sums = cut(sums.select("cluster", F.ceil(F.col("open") / block).cast("int").alias("rounds"), "c"))
    state = join_counted(state, sums, ["cluster"], "c", own)
    round_of = F.pmod(F.xxhash64("class", F.lit(1)), F.col("rounds")).cast("int")
    as_member = state.select("cluster", block_of.alias("block"), F.explode(upto("rounds")).alias("round"), "class", "settled", "grams")
    as_guest = state.filter("not settled").select("cluster", F.explode(upto("blocks")).alias("block"), round_of.alias("round"), "class", "settled", "grams")
    split = as_member.unionByName(as_guest).select(F.xxhash64("cluster", "block", "round").alias("task"), "class", "settled", "grams")
    return searched(small.unionByName(split)).unionByName(to_pivots)


def near_groups(docs: DataFrame, threshold: int = 80, tables: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, uid, n_shingles, component_id, kept for every row."""
    tables = tables or tables_for(threshold)
    source = docs.select("doc_id", row_mark().alias("uid"), "text")
    mark = "struct<a:long,b:long>"
    rows = cut(source.mapInArrow(sketch(tables), f"doc_id long, uid {mark}, n_shingles long, equal {mark}, keys array<long>"))
    # sets are compared by 128 bits; a class of equal ones gets a number that no other has
    classes = rows.filter("equal is not null").groupBy("equal").agg(F.min("doc_id").alias("least_id"), F.min("uid").alias("uid"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("c"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    keyed = classes.select("class", "keys").mapInArrow(pair_keys(tables), "key long, a long, b long")
    # chains through each bucket: its classes in order, each linked with the one before
    chained = F.coalesce("b", F.lag("a").over(Window.partitionBy("key").orderBy("a")))
    met = keyed.select("a", chained.alias("b")).filter("b is not null")
    members = components(met).withColumnsRenamed({"node": "class", "root": "cluster"})
    weight = F.col("n") + ROW_WEIGHT
    found = cut(members.join(classes.select("class", "uid", weight.alias("weight")), "class"))
    totals = cut(found.groupBy("cluster").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("c")))
    wanted = join_counted(found, totals, ["cluster"], "c", F.xxhash64("class")).select("uid", F.struct("cluster", "total", "class", "weight").alias("of"))
    texts = source.select("uid", "text").join(wanted, "uid").select("of.*", "text")
    sets = cut(texts.mapInArrow(full_sets, "cluster long, total long, class long, weight long, grams binary").dropDuplicates(["class"]))
    joined = components(links_of(sets, threshold, block, partitions_for(docs)))
    roots = cut(joined.join(classes.select(F.col("class").alias("node"), "least_id"), "node"))
    least = cut(roots.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("c")))
    named = join_counted(roots, least, ["root"], "c", F.xxhash64("node")).select(F.col("node").alias("class"), "component_id")
    own = cut(classes.join(named, "class", "left").select("equal", "c", F.coalesce("component_id", "least_id").alias("component_id")))
    narrow = rows.select("doc_id", "uid", "n_shingles", "equal")
    shared = join_counted(narrow.filter("equal is not null"), own, ["equal"], "c", F.col("uid.a"))
    blank = narrow.filter("equal is null").withColumn("component_id", F.col("doc_id"))
    out = shared.select("doc_id", "uid", "n_shingles", "component_id").unionByName(blank.drop("equal"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of near copies. Rows equal in doc_id and text stay or go together."""
    gone = small(cut(near_groups(docs, threshold).filter("not kept").select("uid").distinct()))
    marked = packed(docs).withColumn("uid", row_mark("d."))
    return marked.join(gone, "uid", "left_anti").select("d.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), 85).drop("uid")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS grams
  FROM w
), c AS (
  SELECT min(doc_id) AS rep, list_sort(grams) AS grams, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY list_sort(grams), len(grams)
), g AS (SELECT rep, n, unnest(grams) AS gram FROM c
), p AS (
  SELECT a.rep AS x, b.rep AS y FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
), k AS (SELECT x AS rep, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, len(s.grams) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.grams) = c.grams LEFT JOIN k ON k.rep = c.rep
"""
