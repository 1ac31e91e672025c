"""Byte-pair encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last two words cuts a text, at single spaces between two printable ASCII
characters, into chunks of about `CHUNK_WORDS` words; texts that share a passage share its chunks
wherever it stands. A worker encodes a chunk once and reuses the ids in all the documents it meets;
pieces of chunks (a word with its space) are reused likewise, so chunks that are new cost little. Each
join of two chunks is checked by encoding the words on both sides together; if that differs from
the ids put side by side, the chunks are merged and encoded as one, until they agree. Both caches have a fixed bound
and are emptied when they reach it: results never depend on them.

Decoding works on ids; chunks are decoded once like they are encoded once.

Defined results: null and empty texts have no ids and decode to the empty text; the string of a special
token in a text becomes its id, as in the library; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import released, table

CHUNK_WORDS = 128
MOST_PIECES = 150_000
MOST_CHUNKS = 4_000
_DOUBLE = re.compile(r"\s\s")
_LINES = re.compile(r"(\n)")


def pieces_of(chunk: str) -> list[str]:
    """Cut a chunk where the tokenizer's own splitting always cuts; the pieces join to the chunk.

    A single blank or line feed between other characters is such a place; chunks with longer white
    space stay whole.
    """
    if _DOUBLE.search(chunk):
        return [chunk]
    out = []
    for part in _LINES.split(chunk) if "\n" in chunk else (chunk,):
        words = part.split(" ")
        if words[0]:
            out.append(words[0])
        out += [" " + w for w in words[1:]]
    return out


def cut_points(s: tokens.Slice, every: int) -> np.ndarray:
    """Word indexes before which a chunk begins (content-defined), besides each row's beginning."""
    words = s.word_hashes()
    if len(words) < 3:
        return np.zeros(0, np.int64)
    i = np.arange(2, len(words))
    chosen = tokens.gram_hashes(words, 2)[:-1] % np.uint64(every) == 0
    at = s.starts[2:]
    plain = (s.data > 32) & (s.data < 127)
    safe = (s.data[at - 1] == 32) & plain[at - 2] & plain[at]
    row = s.row_of_word()
    return i[chosen & safe & (row[2:] == row[:-2])]


def chunks_of(texts, every: int):
    """The chunks of every row, in order; they join to the text."""
    for s in tokens.slices(texts):
        cuts = cut_points(s, every)
        at, row = s.starts[cuts] - 1, s.row_of_word()[cuts]
        begin = np.searchsorted(row, np.arange(s.rows + 1))
        data = s.data.tobytes()
        edge = row_edges(texts, s)
        for r in range(s.rows):
            marks = [edge[r], *at[begin[r] : begin[r + 1]].tolist(), edge[r + 1]]
            yield [data[a:b].decode() for a, b in zip(marks, marks[1:]) if b > a]


def row_edges(texts, s: tokens.Slice) -> list[int]:
    lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in texts.slice(s.first, s.rows)]
    return [0, *np.cumsum(lengths).tolist()]


class Coder:
    """A tokenizer with bounded caches of pieces and chunks; ids are kept as text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run beside each other already; its threads would each keep memory
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}  # the generation before
        self.odd: dict[str, str] = {}  # decoded text of pieces that it differs from
        self.chunks: dict[str, tuple[int, str, str, str, str]] = {}  # count, ids, decoded, first and last piece
        self.agreed: set[str] = set()

    def encode(self, texts: list[str]) -> list[str]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [",".join(map(str, x.ids)) for x in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def coded(self, texts: list[str]) -> list[str]:
        """Ids of each; where they decode to something else, that is noted."""
        out = []
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            self.odd.update((t, b) for t, b in zip(part, back) if t != b)
            out += [",".join(map(str, x)) for x in ids]
        return out

    def chunk(self, text: str, pieces: list[str], held: dict[str, str]) -> tuple[int, str, str, str, str]:
        ids = ",".join([held[p] for p in pieces])
        decoded = "".join([self.odd.get(p, p) for p in pieces]) if self.odd else text
        return (ids.count(",") + 1 if ids else 0, ids, decoded, pieces[0], pieces[-1])

    def learn(self, rows: list[list[str]]) -> None:
        """Have every chunk of the rows in the cache."""
        if len(self.odd) > MOST_PIECES:
            self.forget()
        if len(self.pieces) > MOST_PIECES:
            self.older, self.pieces = self.pieces, {}
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks.clear()
        if len(self.agreed) > MOST_PIECES:
            self.agreed.clear()
        new = dict.fromkeys(c for row in rows for c in row if c not in self.chunks)
        split = {c: pieces_of(c) for c in new}
        held = self.pieces
        missing = dict.fromkeys(p for ps in split.values() for p in ps if p not in held)
        held.update((p, self.older[p]) for p in missing if p in self.older)
        missing = [p for p in missing if p not in held]
        held.update(zip(missing, self.coded(missing)))
        self.chunks.update((c, self.chunk(c, ps, held)) for c, ps in split.items())

    def ids_of(self, pieces: list[str]) -> list[str]:
        """Ids of pieces, from the cache where they are still there."""
        missing = list(dict.fromkeys(p for p in pieces if p not in self.pieces))
        known = dict(zip(missing, self.coded(missing)))
        return [self.pieces[p] if p in self.pieces else known[p] for p in pieces]

    def repair(self, rows: list[list[str]]) -> list[list[str]]:
        """Merge chunks whose joins don't agree with encoding the pieces on both sides together, until all do."""
        while (merged := self.repaired(rows)) is not rows:
            rows = merged
        return rows

    def repaired(self, rows: list[list[str]]) -> list[list[str]]:
        """Rows with every chunk that disagrees with its neighbour merged with it; the rows themselves where none does."""
        held, side = self.chunks, {}
        for row in rows:
            for a, b in zip(row, row[1:]):
                left, right = held[a][4], held[b][3]
                if left + right not in self.agreed:
                    side[left + right] = (left, right)
        whole = self.encode(list(side))
        left, right = self.ids_of([a for a, _ in side.values()]), self.ids_of([b for _, b in side.values()])
        bad = {k for k, w, a, b in zip(side, whole, left, right) if w != f"{a},{b}"}
        self.agreed.update(k for k in side if k not in bad)
        if not bad:
            return rows
        out = []
        for row in rows:
            merged = row[:1]
            for b in row[1:]:
                if held[merged[-1]][4] + held[b][3] in bad:
                    both = merged.pop() + b
                    if both not in held:
                        held[both] = self.chunk(both, [both], dict(zip([both], self.coded([both]))))
                    merged.append(both)
                else:
                    merged.append(b)
            out.append(merged)
        return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def code(path: str, every: int, whole: bool):
    """mapInArrow over doc_id, text. whole: with the ids and the decoded text themselves."""

    def run(batches):
        held = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = list(chunks_of(part.column(1), every))
                held.learn(rows)
                rows = held.repair(rows)
                counts, digests, backs, ids_out, texts_out = [], [], [], [], []
                for row in rows:
                    got = [held.chunks[c] for c in row]
                    ids, text = ",".join([x[1] for x in got]), "".join([x[2] for x in got])
                    counts.append(sum([x[0] for x in got]))
                    digests.append(hashlib.sha256(ids.encode()).hexdigest())
                    backs.append(hashlib.sha256(text.encode()).hexdigest())
                    if whole:
                        ids_out.append([int(x) for x in ids.split(",")] if ids else [])
                        texts_out.append(text)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if whole:
                    columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts_out, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, tokenizer_path: str, chunk_words: int = CHUNK_WORDS, whole: bool = True, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if whole, ids and decoded. Unless keep, a task's caches go with it, as other stages may use the worker."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    return docs.select("doc_id", "text").mapInArrow(released(code(tokenizer_path, chunk_words, whole), None if keep else lambda: coder(tokenizer_path).forget()), schema)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches):
        held = coder(tokenizer_path)
        for batch in batches:
            back = held.tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_tokenizer(), whole=False)
