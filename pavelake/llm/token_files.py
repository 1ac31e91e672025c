"""Token ids in files of directly addressable codes, as a Spark data source ("token_codes").

A file holds whole documents. An id is cut into chunks, low bits first; level l holds the l-th chunks of the ids that have one,
bit-packed, with a bitmap that says which go on and a rank directory (ones before each 512 bits) that tells where they go on. So any
id, or any stretch of ids, is found by reading a few bytes of each level; nothing is decoded from a block's start. Widths of
levels are those that take the fewest bits for the file's ids (dynamic programming over a histogram of bit lengths).

Layout: 8 bytes of magic, the header's length (unsigned, 8 bytes, little-endian), a JSON header (documents, ids, widths, places of sections), then
the sections: document ids (signed 64 bits), nulls among them (a byte each), ids before each document (unsigned 64 bits), and for each level
chunks, bitmap, directory (unsigned 32 bits). `_index` lists the files in order and is written last, on commit, so files of
failed or repeated tasks are never read. Paths may be of any kind that pyarrow.fs opens (file, hdfs, s3, gs).

Writing takes doc_id and either ids (array<int>) or text with the option `tokenizer` (and `by_runs`, see Encoder); reading gives doc_id, start (ids of all documents
before), n_tokens, ids, ids_crc32, or those of them that .schema() names. `write_documents` deals documents to tasks by ranges of doc_id.

Defined results: null text counts as empty, and such a document has only the end id; null doc_ids come first; rows that share a doc_id are ordered by a hash of their
text and each is there; an empty table gives an index without files; other columns are not read; a document of any length is written whole.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.graph import shared_folder
from . import tokens
from .common import partitions_for, table

MAGIC = b"TOKCODE1"
END_ID = 1
FILE_IDS = 4_000_000
SLICE_BYTES = 4 << 20
MOST_WORDS = 400_000
LONG_WORD = 64
BLOCK = 512  # bits of a bitmap for each entry of its directory
IDS_AT_ONCE = 1 << 20

# ---- codes


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits, low bits first, padded with zeros to a multiple of 8 values."""
    rows = np.zeros((-(-len(values) // 8), 8), dtype=np.uint64)
    rows.reshape(-1)[: len(values)] = values
    out = np.zeros((len(rows), width), dtype=np.uint8)
    for k in range(width):
        byte = np.zeros(len(rows), dtype=np.uint64)
        for j in range(8 * k // width, (8 * k + 7) // width + 1):
            shift = j * width - 8 * k
            byte |= rows[:, j] << np.uint64(shift) if shift >= 0 else rows[:, j] >> np.uint64(-shift)
        out[:, k] = byte & np.uint64(255)
    return out.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    """All values of packed bytes, a multiple of 8 of them."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, width).astype(np.uint64)
    out = np.zeros((len(rows), 8), dtype=np.uint64)
    for j in range(8):
        for k in range(j * width // 8, ((j + 1) * width + 7) // 8):
            shift = 8 * k - j * width
            out[:, j] |= rows[:, k] << np.uint64(shift) if shift >= 0 else rows[:, k] >> np.uint64(-shift)
    return (out.reshape(-1) & np.uint64((1 << width) - 1)).astype(np.uint32)


def best_widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels that take the fewest bits, bitmaps and directories included."""
    _, exponents = np.frexp(np.maximum(ids, 1).astype(np.float64))
    of_length = np.bincount(exponents, minlength=2)
    most = len(of_length) - 1
    longer = [int(of_length[b + 1 :].sum()) for b in range(most + 1)]  # ids of more than b bits
    longer[0] = len(ids)
    best: list[tuple[float, list[int]]] = [(0.0, [])]  # for the bits from b on, from the top down
    for b in range(most - 1, -1, -1):
        options = []
        for width in range(1, most - b + 1):
            rest, widths = best[most - b - width]
            side = 0 if b + width == most else 1 + 32 / BLOCK
            options.append((longer[b] * (width + side) + rest, [width, *widths]))
        best.append(min(options))
    return best[most][1]


def encoded(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file of documents with their numbers of ids and all their ids in order."""
    sections: list[bytes] = [
        np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(),
        np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes(),
    ]
    widths, left, sizes = best_widths(ids) if len(ids) else [1], ids.astype(np.uint32), []
    for level, width in enumerate(widths):
        sizes.append(len(left))
        sections.append(pack(left & np.uint32((1 << width) - 1), width))
        if level == len(widths) - 1:
            break
        left = left >> np.uint32(width)
        on = left > 0
        bits = np.packbits(on, bitorder="little")
        per_block = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
        sections += [bits.tobytes(), (np.cumsum(per_block) - per_block).astype("<u4").tobytes()]
        left = left[on]
    places = np.concatenate([[0], np.cumsum([len(s) for s in sections])]).tolist()
    header = json.dumps({"docs": len(doc_ids), "ids": len(ids), "widths": widths, "sizes": sizes, "places": places}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *sections])


class TokenFile:
    """A file opened for reading: anything with seek and read."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a file of token codes")
        size = int.from_bytes(file.read(8), "little")
        self.header = json.loads(file.read(size))
        self.body = 16 + size

    def section(self, number: int, start: int = 0, stop: int | None = None) -> bytes:
        """Bytes start to stop of a section."""
        at, end = self.header["places"][number : number + 2]
        stop = end - at if stop is None else min(stop, end - at)
        self.file.seek(self.body + at + start)
        return self.file.read(max(0, stop - start))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids, and the ids before each document and in all."""
        names = np.frombuffer(self.section(0), dtype="<i8").tolist()
        nulls = np.frombuffer(self.section(1), dtype=np.uint8)
        return [None if n else x for x, n in zip(names, nulls)], np.frombuffer(self.section(2), dtype="<u8").astype(np.int64)

    def ids(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """Ids start to stop (of this level's numbering), by rank from level to level."""
        widths = self.header["widths"]
        width, last = widths[level], level == len(widths) - 1
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first = start // 8
        found = unpack(self.section(3 + 3 * level, first * width, -(-stop // 8) * width), width)[start - 8 * first :][: stop - start]
        if last:
            return found
        block = start // BLOCK
        bits = np.unpackbits(np.frombuffer(self.section(4 + 3 * level, block * BLOCK // 8, -(-stop // 8)), dtype=np.uint8), bitorder="little")[: stop - block * BLOCK]
        before = int.from_bytes(self.section(5 + 3 * level, 4 * block, 4 * block + 4), "little")
        skip = start - block * BLOCK
        rank, on = before + int(bits[:skip].sum()), bits[skip:].astype(bool)
        found[on] |= self.ids(rank, rank + int(on.sum()), level + 1) << np.uint32(width)
        return found

    def at(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])


# ---- encoding texts

#: Bytes of words that the splitter cuts by kind alone: Latin letters, digits one by one, other signs but ' < |, which may begin something longer.
LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 4
_KINDS = np.full(256, OTHER, dtype=np.uint8)
_KINDS[[*range(0x21, 0x7F)]] = SIGN
_KINDS[[ord(c) for c in "'<|"]] = OTHER
_KINDS[[*range(0x30, 0x3A)]] = DIGIT
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{}~]+")


def byte_signs() -> dict[int, int]:
    """The signs by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return dict(zip(printable, printable)) | {b: 256 + i for i, b in enumerate(hidden)}


_SIGNS = byte_signs()


def runs_of(s: tokens.Slice) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice cut to runs of one kind, in lower case, where they hold nothing else; and the first run of each row, and their number."""
    data, kinds = s.data, _KINDS[s.data]
    low = tokens.lowered(data)
    lead = np.flatnonzero(data == 0xC3)
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    kinds[lead[letter]] = kinds[lead[letter] + 1] = LETTER
    low[lead[letter & (second < 0x9F)] + 1] += 0x20
    upto = np.concatenate([[0], np.cumsum(kinds == OTHER)])
    odd = upto[s.ends] > upto[s.starts]
    inside, inside_odd = tokens.covered(len(data), s.starts, s.ends), tokens.covered(len(data), s.starts[odd], s.ends[odd])
    low[inside_odd] = data[inside_odd]
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)) & inside[1:] & ~inside_odd[1:]
    begins[s.starts] = True
    starts = np.flatnonzero(begins)
    word = np.searchsorted(s.starts, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), s.ends[word])
    return tokens.strings(ends - starts, low[inside]), np.searchsorted(word, s.ptr)


class Encoder:
    """Ids of texts by a tokenizer that treats words parted by white space alike wherever they stand.

    by_runs: that its splitter, as that of word_bpe_49k, also lowers letters and cuts words to runs of letters, single digits and other signs, so that a
    run stands for itself; words with signs of other kinds stay whole. Distinct pieces of a slice are encoded once and kept, up to
    MOST_WORDS; then the cache starts anew. Results never depend on it.
    """

    def __init__(self, path: str, end_id: int = END_ID, by_runs: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run beside each other already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.end_id, self.by_runs = end_id, by_runs
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.array([self.end_id], dtype=np.int32), 1
        self.upto, self.entries = np.array([0, 1], dtype=np.int64), 1  # entry 0 is the end id

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        if not self.by_runs:
            return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        plain = [p if p.isascii() else p.encode().decode("latin-1").translate(_SIGNS) for p in pieces if PLAIN.fullmatch(p)]
        tokenize = self.model.tokenize
        runs = iter([[x.id for x in tokenize(p)] for p in plain])
        others = iter(self.tokenizer.encode_batch_fast([p for p in pieces if not PLAIN.fullmatch(p)], add_special_tokens=False) if len(plain) < len(pieces) else [])
        return [next(runs) if PLAIN.fullmatch(p) else next(others).ids for p in pieces]

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Entries of distinct pieces."""
        if len(self.known) > MOST_WORDS or self.entries > 2 * MOST_WORDS:  # long pieces are not kept
            self.forget()
        out = np.array([self.known.get(p, -1) for p in pieces], dtype=np.int64)
        missing = np.flatnonzero(out < 0)
        new = [pieces[i] for i in missing.tolist()]
        found = self.ids_of(new)
        ids, sizes = np.array([x for f in found for x in f], dtype=np.int32), np.array([len(f) for f in found], dtype=np.int64)
        self.flat, self.upto = grown(self.flat, self.used, ids), grown(self.upto, self.entries + 1, self.used + np.cumsum(sizes))
        out[missing] = self.entries + np.arange(len(new))
        self.known.update((p, e) for p, e in zip(new, out[missing].tolist()) if len(p) <= LONG_WORD)
        self.used, self.entries = self.used + len(ids), self.entries + len(new)
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of rows: the first row, ids of each row with the end id (counts), all ids."""
        for s in tokens.slices(texts, slice_bytes=SLICE_BYTES):
            pieces, ptr = runs_of(s) if self.by_runs else (s.words(), s.ptr)
            coded = pieces.dictionary_encode()
            entries = self.learn(coded.dictionary.to_pylist())
            items = np.zeros(len(pieces) + s.rows, dtype=np.int64)
            rows = np.arange(s.rows)
            if len(pieces):
                items[np.arange(len(pieces)) + np.repeat(rows, np.diff(ptr))] = entries[coded.indices.to_numpy()]
            starts = self.upto[items]
            sizes = self.upto[items + 1] - starts
            upto = np.cumsum(sizes)
            at = np.repeat(starts - upto + sizes, sizes)
            at += np.arange(len(at))
            yield s.first, np.diff(upto[ptr[1:] + rows], prepend=0), self.flat[at].view(np.uint32)


def grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with more behind its first `used` values, with room to spare when it is copied."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.zeros(used + len(more), held.dtype)])
    held[used : used + len(more)] = more
    return held


_encoders: dict[tuple, Encoder] = {}


def encoder(*made_of) -> Encoder:
    if made_of not in _encoders:
        _encoders[made_of] = Encoder(*made_of)
    return _encoders[made_of]


# ---- the data source


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, int, str, int, int]]  # task, number in it, name, documents, ids


@dataclass
class Piece(InputPartition):
    name: str
    start: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict):
        self.path, self.tokenizer = path, options.get("tokenizer")
        self.end_id, self.most = int(options.get("end_id", END_ID)), int(options.get("file_ids", FILE_IDS))
        self.by_runs = str(options.get("by_runs", "true")).lower() == "true"

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        names = batch.column("doc_id").to_pylist()
        if "text" in batch.schema.names:
            for first, counts, ids in encoder(self.tokenizer, self.end_id, self.by_runs).encode(batch.column("text")):
                yield names[first : first + len(counts)], counts, ids
        else:
            lists = batch.column("ids")
            yield names, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, done = TaskContext.get().partitionId(), []
        names: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def save() -> None:
            counts, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            name = f"part-{task:06d}-{len(done):04d}-{uuid.uuid4().hex}.tok"
            system, path = place(f"{self.path}/{name}")
            with system.open_output_stream(path) as out:
                out.write(encoded(names, counts, ids))
            done.append((task, len(done), name, len(names), len(ids)))
            names.clear()
            held.clear()

        for batch in iterator:
            for found, counts, ids in self.rows(batch):
                names += found
                held.append((counts, ids))
                if sum(len(h[1]) for h in held) >= self.most:
                    save()
        if names:
            save()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        system, path = place(f"{self.path}/_index")
        with system.open_output_stream(path) as out:
            out.write("".join(json.dumps({"name": n, "docs": d, "ids": i}) + "\n" for _, _, n, d, i in files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for _, _, name, _, _ in (f for m in messages if m for f in m.files):
            system, path = place(f"{self.path}/{name}")
            system.delete_file(path)


class TokenReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[Piece]:
        system, path = place(f"{self.path}/_index")
        with system.open_input_stream(path) as f:
            lines = [json.loads(x) for x in f.read().decode().splitlines()]
        starts = np.cumsum([0] + [x["ids"] for x in lines]).tolist()
        return [Piece(x["name"], s) for x, s in zip(lines, starts)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        system, path = place(f"{self.path}/{partition.name}")
        with system.open_input_file(path) as f:
            file = TokenFile(f)
            names, before = file.documents()
            at = 0
            while at < len(names):
                stop = max(at + 1, int(np.searchsorted(before, before[at] + IDS_AT_ONCE, side="right")) - 1)
                yield self.batch(file, names[at:stop], before[at : stop + 1], partition.start)
                at = stop

    def batch(self, file: TokenFile, names: list, before: np.ndarray, start: int) -> pa.RecordBatch:
        out = {"doc_id": pa.array(names, pa.int64()), "start": pa.array(before[:-1] + start), "n_tokens": pa.array(np.diff(before))}
        if {"ids", "ids_crc32"} & {*self.columns}:
            ids, own = file.ids(int(before[0]), int(before[-1])), before - before[0]
            data = memoryview(ids.astype("<u4").tobytes())
            out["ids_crc32"] = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(own, own[1:])], pa.int64())
            out["ids"] = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(ids.view(np.int32)))
        return pa.RecordBatch.from_arrays([out[c] for c in self.columns], self.columns)


class TokenCodes(DataSource):
    """spark.dataSource.register(TokenCodes), then .format("token_codes")."""

    @classmethod
    def name(cls) -> str:
        return "token_codes"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids array<int>"

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], dict(self.options))


def open_file(path: str) -> TokenFile:
    """One file, for random access."""
    system, at = place(path)
    return TokenFile(system.open_input_file(at))


def from_bytes(data: bytes) -> TokenFile:
    return TokenFile(io.BytesIO(data))


def write_documents(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None, end_id: int = END_ID) -> None:
    """Files of all documents' ids in ascending order of doc_id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenCodes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(partitions or partitions_for(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.write.format("token_codes").mode("append").option("tokenizer", tokenizer).option("end_id", end_id).save(path)


def read_documents(spark: SparkSession, path: str, columns: str = "doc_id long, start long, n_tokens long, ids array<int>") -> DataFrame:
    spark.dataSource.register(TokenCodes)
    return spark.read.format("token_codes").schema(columns).load(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    system, at = place(path)
    system.create_dir(at, recursive=True)
    write_documents(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_documents(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long")
