"""Prefix trie of conversations by an LCP-aware mergesort.

A turn is a digest of 128 bits and the length of its text, so a conversation is a string over digests. These strings are
range-partitioned by (string, conv_id). In a task every Arrow batch is sorted to a run that carries LCPs, the number of turns that each
string shares with the one before it; a loser tree merges the runs and compares LCPs first, so turns that two strings are
known to share are not looked at again. The merged stream drives a stack with the nodes of the open path: a string closes
the nodes deeper than its LCP, which are then finished, and opens its own.

Nodes on the first and the last path of a task may go on in its neighbours. They leave the task as parts, are combined by their
prefix digest, and what lies below them is summed along those paths (a node counts on the first path that holds it), so no task or driver
gathers the paths of all tasks. Members that end at such a node are hashed in order from chunks of ids; that is one stream
for a node, since the digest of all ids is.

Defined results: rows without conv_id are left out; null role and text count as empty; null turns come first; rows of one conversation with equal
turns are ordered by the digest of role and text, so repeated rows are turns of their own; very long texts are hashed in whole;
an empty table gives no nodes, not even a root; other columns are not read. A conversation is one record of 20 bytes for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, partitions_for, table

#: Conversations are rebuilt on the head of the first one of their block of so many ids; a head has fewer turns than HEADS.
BLOCK = 100
HEADS = 6
DIGEST = 16
IDS_PER_CHUNK = 100_000
ROWS_OUT = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest() -> Column:
    """128 bits of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)


def head_size(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (digest, n) in order, n the code points of the text."""
    length = F.char_length(F.coalesce("text", F.lit(""))).cast("int")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), turn_digest().alias("digest"), length.alias("n")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return turns.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["n"].alias("n"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, turns: the head of the block's first conversation, then the conversation's own turns after its head."""
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    joined = own.withColumn("base", base).join(heads, "base", "left")
    h = head_size(F.col("conv_id"))
    none = F.array().cast(own.schema["turns"].dataType)
    head = F.slice(F.coalesce("head", none), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


# ---- inside a task: runs, loser tree, open path


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two strings share, of which `known` are known."""
    most = min(len(a), len(b)) // DIGEST
    step, i = 8, known
    while i < most:  # blocks first, growing
        j = min(i + step, most)
        if a[i * DIGEST : j * DIGEST] != b[i * DIGEST : j * DIGEST]:
            break
        i, step = j, step * 2
    else:
        return most
    while a[i * DIGEST : (i + 1) * DIGEST] == b[i * DIGEST : (i + 1) * DIGEST]:
        i += 1
    return i


@dataclass
class Run:
    """A sorted run: string, conv_id and LCP with the string before it (0 for the first)."""

    strings: list[bytes]
    ids: list[int]
    lengths: list[np.ndarray]
    lcps: list[int]
    at: int = 0


def sorted_run(strings: list[bytes], ids: list[int], lengths: list[np.ndarray]) -> Run:
    order = sorted(range(len(ids)), key=lambda i: (strings[i], ids[i]))
    s = [strings[i] for i in order]
    return Run(s, [ids[i] for i in order], [lengths[i] for i in order], [0, *(common(a, b) for a, b in zip(s, s[1:]))])


class LoserTree:
    """Merges runs. lcp[r] is what run r's next string shares with the string given out last."""

    def __init__(self, runs: list[Run]):
        self.runs = [r for r in runs if r.ids]
        self.k = len(self.runs)
        self.lcp = [0] * self.k
        self.loser = [0] * self.k
        self.top = self.play(1) if self.k else -1

    def play(self, node: int) -> int:
        """The winner below a node; run r is the leaf k + r."""
        if node >= self.k:
            return node - self.k
        a, b = self.play(2 * node), self.play(2 * node + 1)
        first, self.loser[node] = (a, b) if self.less(a, b) else (b, a)
        return first

    def less(self, a: int, b: int) -> bool:
        """Does run a's string come first? The loser keeps what it shares with the winner."""
        if self.done(a) or self.done(b):
            return self.done(b)
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        ra, rb = self.runs[a], self.runs[b]
        x, y = ra.strings[ra.at], rb.strings[rb.at]
        shared = common(x, y, self.lcp[a])
        p, q = x[shared * DIGEST : (shared + 1) * DIGEST], y[shared * DIGEST : (shared + 1) * DIGEST]
        first = p < q if p != q else ra.ids[ra.at] < rb.ids[rb.at]
        self.lcp[b if first else a] = shared
        return first

    def done(self, r: int) -> bool:
        return self.runs[r].at >= len(self.runs[r].ids)

    def replay(self, r: int) -> int:
        """The winner after run r has moved on: only its way to the root is played again."""
        node = (r + self.k) // 2
        while node:
            if self.less(self.loser[node], r):
                self.loser[node], r = r, self.loser[node]
            node //= 2
        return r

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray, int]]:
        """string, conv_id, text lengths, LCP with the string before it."""
        while self.runs and not self.done(self.top):
            r, run = self.top, self.runs[self.top]
            i = run.at
            yield run.strings[i], run.ids[i], run.lengths[i], self.lcp[r]
            run.at += 1
            if not self.done(r):
                self.lcp[r] = run.lcps[run.at]
            self.top = self.replay(r)


@dataclass
class Node:
    depth: int
    length: int
    left: bool
    least: int = 1 << 63
    members: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: object = None
    ids: list[int] = field(default_factory=list)
    below: list[tuple] = field(default_factory=list)  # finished children, which wait for their parent's conv_id


NODE_FIELDS = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
PART_FIELDS = [("kind", pa.int32()), ("parent_key", pa.binary()), ("key", pa.binary()), ("length", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("paths", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))]
OUT = pa.schema(NODE_FIELDS + PART_FIELDS)
OUT_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, kind int, parent_key binary, key binary, length long, part long, chunk long, paths array<bigint>, ids array<bigint>"
CLOSED, OPEN, ENDS = 0, 1, 2


def prefix_keys(string: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of 0 to `depth` turns."""
    h, out = hashlib.sha256(b"root"), []
    for d in range(depth + 1):
        out.append(h.copy().digest()[:DIGEST])
        h.update(string[d * DIGEST : (d + 1) * DIGEST])
    return out


def nodes_of(stream: Iterator[tuple[bytes, int, np.ndarray, int]], part: int) -> Iterator[tuple]:
    """Rows of OUT: finished nodes as soon as their parent is finished, then the parts of the first and the last path."""
    path: list[Node] = []
    first = last = None
    left: list[Node] = []

    def close(node: Node) -> tuple:
        leaves = node.leaves or 1
        saved = node.saved + (node.members - 1) * node.length
        ends = node.ends.hexdigest() if node.ends else NOTHING
        return leaves, saved, (node.least, node.depth, node.members, node.children, leaves, saved, ends)

    def pop() -> Iterator[tuple]:
        node = path.pop()
        parent = path[-1] if path else None
        if parent:
            parent.members += node.members
            parent.least = min(parent.least, node.least)
        if node.left:
            return
        leaves, saved, row = close(node)
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        parent.below.append(row)
        for r in node.below:
            yield (*r[:2], node.least, *r[2:], CLOSED, None, None, None, part, None, None, None)

    for string, conv_id, lengths, shared in stream:
        if first is None:
            first, shared = string, 0
            path = [Node(0, 0, True)]
            left.append(path[0])
        while len(path) > shared + 1:
            yield from pop()
        for d in range(len(path), len(string) // DIGEST + 1):
            path.append(Node(d, int(lengths[d - 1]), string is first))
            if string is first:
                left.append(path[-1])
        node = path[-1]
        node.members += 1
        node.least = min(node.least, conv_id)
        # a node on the first path hands its ids on; so does one that is still open at the end (its chunk is held until then)
        node.ends, more = (hashlib.sha256(), "") if node.ends is None else (node.ends, ",")
        node.ends.update(f"{more}{conv_id}".encode())
        node.ids.append(conv_id)
        last = string
    if first is None:
        return
    right = list(path)
    held = {id(n): n for n in left + right}
    keys = {id(n): k for nodes, s in ((left, first), (right, last)) for n, k in zip(nodes, prefix_keys(s, len(nodes) - 1))}
    on_right = {id(n) for n in right}
    for n in reversed(right):  # members of what is still open
        if n.depth:
            up = right[n.depth - 1]
            up.members += n.members
            up.least = min(up.least, n.least)
    parents = {id(n): nodes[i - 1] for nodes in (right, left) for i, n in enumerate(nodes) if i}
    for n in held.values():
        key, up = keys[id(n)], keys[id(parents[id(n)])] if n.depth else None
        paths = [2 * part] * n.left + [2 * part + 1] * (id(n) in on_right)
        yield (n.least, n.depth, None, n.members, n.children, n.leaves, n.saved, None, OPEN, up, key, n.length, part, None, paths, None)
        for r in n.below:
            yield (*r[:2], None, *r[2:], CLOSED, key, None, None, part, None, None, None)
        for c, at in enumerate(range(0, len(n.ids), IDS_PER_CHUNK)):
            yield (None, None, None, None, None, None, None, None, ENDS, None, key, None, part, c, None, n.ids[at : at + IDS_PER_CHUNK])


def run_of(batch: pa.RecordBatch) -> Run:
    """The run of a batch of conv_id, digests, lengths."""
    digests, sizes = batch.column("digests"), batch.column("lengths")
    at = np.concatenate([[0], np.cumsum(digests.value_lengths().to_numpy(zero_copy_only=False))]) if batch.num_rows else [0]
    data, counts = b"".join(digests.flatten().to_pylist()), sizes.flatten().to_numpy(zero_copy_only=False)
    strings = [data[a * DIGEST : b * DIGEST] for a, b in zip(at, at[1:])]
    return sorted_run(strings, batch.column("conv_id").to_pylist(), [counts[a:b] for a, b in zip(at, at[1:])])


def trie_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = [run_of(b) for b in batches if b.num_rows]
    rows, part = [], TaskContext.get().partitionId()
    for row in nodes_of(iter(LoserTree(runs)), part):
        rows.append(row)
        if len(rows) >= ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


def hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 from chunks of ids, sorted by key and place."""
    key, digest = None, None
    found: list[tuple[bytes, str]] = []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = ",".join(map(str, ids)).encode()
            if k == key:
                digest.update(b"," + text)
            else:
                if key is not None:
                    found.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(text)
    if key is not None:
        found.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([d for _, d in found], pa.string())], ["key", "ends_sha256"])


# ---- across tasks


def combined(parts: DataFrame) -> DataFrame:
    """The nodes on the tasks' first and last paths: key, parent_key and the columns of a node."""
    opened = parts.filter(F.col("kind") == OPEN)
    own = opened.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("length").alias("length"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.min(F.array_min("paths")).alias("home"),
    )
    inner = own.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("inner"))
    own = own.join(inner, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("inner", F.lit(0)))
    own = own.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("length"))
    own = cut(own.drop("closed", "inner"))
    on = opened.select("key", "depth", F.explode("paths").alias("path"))
    here = F.col("path") == F.col("home")
    below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = on.join(own.select("key", "home", "leaves", "saved"), "key").select("key", *(F.sum(F.when(here, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("leaves", "saved")))
    totals = sums.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    chunks = parts.filter(F.col("kind") == ENDS).select("key", "ids", "part", "chunk")
    ends = chunks.repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "ids").mapInArrow(hash_chunks, "key binary, ends_sha256 string")
    found = own.drop("leaves", "saved", "home", "length").join(totals, "key").join(ends, "key", "left")
    return cut(found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))


NODE = [n for n, _ in NODE_FIELDS]


def trie(strings: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each node of the trie over conv_id, turns (array of digest and n)."""
    n = partitions or partitions_for(strings)
    flat = strings.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["n"]).alias("lengths"))
    parts = cut(flat.repartitionByRange(n, "digests", "conv_id").mapInArrow(trie_task, OUT_DDL))
    border = combined(parts)
    up = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"), F.col("n_children").alias("weight"))
    closed = parts.filter(F.col("kind") == CLOSED)
    waiting = closed.filter("parent_key is not null").drop("parent_conv_id").unionByName(border.filter("parent_key is not null"), allowMissingColumns=True)
    found = join_counted(waiting, up, ["parent_key"], "weight", F.xxhash64("conv_id", "depth")).withColumnRenamed("parent", "parent_conv_id")
    root = border.filter("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return closed.filter("parent_key is null").select(NODE).unionByName(found.select(NODE)).unionByName(root.select(NODE))


OP11_SQL = """
WITH bits AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)
  )
), turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, ts, conv_id - conv_id % 100 AS base,
         xor(list_reduce([CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')], lambda c, x: xor(c >> 8, tab[CAST(xor(c & 255, x) AS BIGINT) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM turns, bits
), whole AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(b.ts, 1, o.h), []), list_slice(o.ts, o.h + 1, len(o.ts))) AS ts
  FROM heads o LEFT JOIN turns b ON b.conv_id = o.base
), steps AS (
  SELECT conv_id, len(ts) AS size, d AS depth, list_slice(ts, 1, d) AS path FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM whole)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(path[depth].text), 0) AS last,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM steps GROUP BY path, depth
), kids AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path
), up AS (
  SELECT list_slice(path, 1, d) AS path, n_children, (n_convs - 1) * last AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_nodes)
), sums AS (
  SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY path
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON f.path = s.path LEFT JOIN nodes p ON f.depth > 0 AND p.path = list_slice(f.path, 1, f.depth - 1)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(sequences(table(spark, sf_dir, "conversations")))
    return trie(cut(rebuilt(own)))
