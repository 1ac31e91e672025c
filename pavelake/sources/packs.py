"""ZIP packs as a data source: only the wanted members are read, by ranges.

    spark.dataSource.register(RidePacks)
    spark.read.format("ride_pack").schema("pack_id string, t_ms bigint, ax double").option("member", "samples.csv").load(folder)

A pack's central directory is read in the task that reads the pack, a wanted member by its place in the file; frames stay where they are unless they
are asked for. Large packs are read by several tasks, each taking the members that begin in its stretch of the file, when frames are wanted. Paths may be
of any kind that pyarrow.fs opens.

What is read follows the schema and the option `member`:

* a CSV member (samples.csv, events.csv, sweeps.csv, segments.csv): its columns by name; each pack's header is matched on its own, in any case, with
  the aliases of sensor files, so packs of different spellings read into one table. What a pack does not have, or what can't be read as its type, is null.
* `*.csv`: loose CSV files in place of packs, each with a header of its own; pack_id is the file's stem.
* `meta.json`: pack_id, body.
* `frames/` (any prefix), or none for all members: pack_id, name, event_id, t_ms, size, and content if the schema names it; without it nothing but
  directories is read.

Defined results: a pack without the member gives no rows; a pack that is no ZIP, is compressed, leads out of its folder or lacks a required member is an error
(option `check` = false reads what is there); an empty folder gives an empty table.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as compute
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .files import ALIASES, FRAME, REQUIRED

SPLIT_BYTES = 256 << 20
PACKS_AT_ONCE = 64
BATCH_BYTES = 16 << 20
LOOSE = "*.csv"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    packs: list[tuple[str, int, int]]  # path, first and last byte at which its members may begin


def safe(info: zipfile.ZipInfo) -> None:
    if info.filename.startswith("/") or ".." in info.filename.split("/"):
        raise ValueError(f"unsafe member {info.filename}")
    if info.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"compressed member {info.filename}")


def directory(file, check: bool = True) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]]:
    """The central directory of a pack; nothing else is read."""
    z = zipfile.ZipFile(file)
    found = z.infolist()
    if check:
        for info in found:
            safe(info)
        lost = set(REQUIRED) - {i.filename for i in found}
        if lost:
            raise ValueError(f"missing members {sorted(lost)}")
    return z, found


def canonical_header(names: list[str]) -> list[str]:
    """Header fields in lower case, trimmed, with sensor aliases; of two that mean the same the first counts."""
    out: list[str] = []
    for name in names:
        own = name.strip().lstrip("\ufeff").lower()
        meant = ALIASES.get(own, own)
        out.append(meant if meant not in out else f"{own}#{len(out)}")
    return out


def table_of(member, schema: pa.Schema, pack: str) -> Iterator[pa.RecordBatch]:
    """Batches of a CSV member with the columns of the schema."""
    header = member.readline().decode("utf-8-sig")
    if not header.strip():
        return
    names = canonical_header(next(iter(pd.read_csv(io.StringIO(header), header=None, dtype=str, nrows=1).fillna("").itertuples(index=False, name=None))))
    strings = {n: pa.string() for n in names}
    try:
        reader = pc.open_csv(member, read_options=pc.ReadOptions(column_names=names), parse_options=pc.ParseOptions(newlines_in_values=True), convert_options=pc.ConvertOptions(column_types=strings, strings_can_be_null=True, null_values=[""]))
    except pa.ArrowInvalid as e:
        if "Empty CSV" in str(e):
            return
        raise
    for batch in reader:
        yield pa.RecordBatch.from_arrays([column(batch, f, pack) for f in schema], schema=schema)


def column(batch: pa.RecordBatch, field: pa.Field, pack: str) -> pa.Array:
    if field.name == "pack_id":
        return pa.array([pack] * batch.num_rows, field.type)
    name = ALIASES.get(field.name, field.name)
    if name not in batch.schema.names:
        return pa.nulls(batch.num_rows, field.type)
    text = batch.column(name)
    if pa.types.is_string(field.type):
        return text
    return parsed(text, field.type)


NUMBER, WHOLE = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^-?[0-9]{1,18}$"


def parsed(text: pa.Array, kind: pa.DataType) -> pa.Array:
    """Numbers, read exactly; what is no number of the kind is null (7.0 is a whole number)."""
    bare = compute.replace_substring_regex(compute.utf8_trim_whitespace(text), r"^\+", "")
    if pa.types.is_integer(kind):
        bare = compute.replace_substring_regex(bare, r"\.0*$", "")
    fits = compute.match_substring_regex(bare, WHOLE if pa.types.is_integer(kind) else NUMBER)
    return compute.if_else(fits, bare, None).cast(kind)


class PackReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.member, self.check = options["path"], options.get("member", ""), str(options.get("check", "true")).lower() == "true"
        self.split, self.together = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("packs_at_once", PACKS_AT_ONCE))
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[Part]:
        """Packs by the listing alone, several small ones to a task, a large one over several where frames are read."""
        system, path = place(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        packs = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".csv" if self.member == LOOSE else ".zip"))
        wide = "content" in self.schema.names
        out: list[Part] = []
        held: list[tuple[str, int, int]] = []
        for name, size in packs:
            if wide and size > self.split:
                out += [Part([(name, a, min(a + self.split, size))]) for a in range(0, size, self.split)]
                continue
            held.append((name, 0, size))
            if len(held) == self.together:
                out, held = [*out, Part(held)], []
        return [*out, Part(held)] if held else out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.path)
        for name, first, last in partition.packs:
            stem = name.rsplit("/", 1)[-1][:-4]
            with system.open_input_file(name) as file:
                yield from table_of(io.BufferedReader(file), self.schema, stem) if self.member == LOOSE else self.read_pack(file, stem, first, last)

    def read_pack(self, file, pack: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        z, found = directory(file, self.check)
        if self.member.endswith(".csv"):
            if any(i.filename == self.member for i in found):
                with z.open(self.member) as member:
                    yield from table_of(member, self.schema, pack)
        elif self.member == "meta.json":
            body = [z.read(i).decode("utf-8-sig") for i in found if i.filename == self.member]
            yield pa.RecordBatch.from_pydict({f.name: [pack] * len(body) if f.name == "pack_id" else body for f in self.schema}, schema=self.schema)
        else:
            yield from self.members(z, [i for i in found if i.filename.startswith(self.member) and first <= i.header_offset < last], pack)

    def members(self, z: zipfile.ZipFile, found: list[zipfile.ZipInfo], pack: str) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for i in found:
            m = FRAME.match(i.filename)
            row = {"pack_id": pack, "name": i.filename, "event_id": int(m[1]) if m and m[1] else None, "t_ms": int(m[2]) if m else None, "size": i.file_size}
            if "content" in self.schema.names:
                row["content"] = z.read(i)
                size += i.file_size
            rows.append(row)
            if size > BATCH_BYTES or len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=self.schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.schema)


class RidePacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ride_pack"

    def schema(self) -> str:
        return "pack_id string, name string, event_id long, t_ms long, size long"

    def reader(self, schema: StructType) -> PackReader:
        return PackReader(dict(self.options), schema)


def read_member(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    spark.dataSource.register(RidePacks)
    return spark.read.format("ride_pack").schema(schema).option("member", member).load(path)


# ---- writing


def pack_bytes(members: dict[str, str | bytes]) -> bytes:
    """A pack as the collector exports it: members stored, CSVs with a BOM."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        for name, body in members.items():
            z.writestr(name, ("\ufeff" * name.endswith(".csv") + body).encode() if isinstance(body, str) else body)
    return buffer.getvalue()


def write_packs(samples: DataFrame, events: DataFrame, path: str) -> DataFrame:
    """pack_id, samples, events, bytes: a ZIP for each pack_id with its samples and events (all their columns) and metadata.

    A pack is one file, so one task writes it; it gets its name when it is whole, so a repeated task leaves a whole file.
    """
    key = "pack_id"

    def run(k: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s, e = s.drop(columns=key).sort_values("t_ms"), e.drop(columns=key).sort_values("t_ms")
        body = pack_bytes({"samples.csv": s.to_csv(index=False), "events.csv": e.to_csv(index=False), "meta.json": json.dumps({"sample_count": len(s), "event_count": len(e)})})
        system, folder = place(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(part := f"{folder}/{k[0]}.{uuid.uuid4().hex}.part") as out:
            out.write(body)
        system.move(part, f"{folder}/{k[0]}.zip")
        return pd.DataFrame({key: [k[0]], "samples": [len(s)], "events": [len(e)], "bytes": [len(body)]})

    return samples.groupBy(key).cogroup(events.groupBy(key)).applyInPandas(run, f"{key} {samples.schema[key].dataType.simpleString()}, samples long, events long, bytes long")


# ---- in SQL


class PackMembers:
    """SELECT * FROM pack_members('path of a pack'), also LATERAL over a table of paths: the members, without reading them."""

    def eval(self, path: str):
        if path is None:
            return
        system, at = place(path)
        with system.open_input_file(at) as file:
            for i in directory(file, check=False)[1]:
                m = FRAME.match(i.filename)
                yield i.filename, int(m[1]) if m and m[1] else None, int(m[2]) if m else None, i.file_size


def register(spark: SparkSession) -> None:
    """The data source, and the table function for SQL."""
    spark.dataSource.register(RidePacks)
    spark.udtf.register("pack_members", F.udtf(PackMembers, returnType="name string, event_id bigint, t_ms bigint, size bigint"))
