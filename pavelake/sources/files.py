"""File sources: sensor CSV with aliases, JSON lines, recording packs (ZIP), digests."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: header spellings of the public and the collector's formats
ALIASES = {
    "timestamp": "t", "time": "t", "timestep": "t", "t_ms": "t", "accx": "ax", "accy": "ay", "accz": "az",
    "accelerometer x": "ax", "accelerometer y": "ay", "accelerometer z": "az", "gyrx": "gx", "gyry": "gy", "gyrz": "gz",
    "gyroscope x": "gx", "gyroscope y": "gy", "gyroscope z": "gz", "latitude": "lat", "longitude": "lon", "lng": "lon", "speed_ms": "speed", "class - groundtruth": "label_raw", "label": "label_raw",
}
MAGNITUDES = ("mag", "magnitude", "acceleration", "hp")
FRAME = re.compile(r"^frames/(?:ev(\d+)|sweep)_t(\d+)\.jpg$")
LEAST_ROWS = 16


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in file order. Only the partitions' sizes are gathered, no row leaves its task."""
    marked = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes, starts, upto = marked.groupBy("__part").count().collect(), [], 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        starts.append((r["__part"], upto))
        upto += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return marked.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def canonical(df: DataFrame) -> DataFrame:
    """Known headers in lower case under one name each, numbers coerced, time in order.

    Without a time column rows are 10 ms apart; without axes a magnitude stands for the first axis.
    """
    seen: dict[str, str] = {}
    for c in df.columns:
        name = c.strip().lstrip("﻿").lower()
        seen.setdefault(ALIASES.get(name, name), c)
    if "ax" not in seen:
        found = next((m for m in MAGNITUDES if m in seen), None)
        if found is None:
            raise ValueError("no acceleration column")
        seen = {**seen, "ax": seen[found]}
    number = lambda name: F.col(f"`{seen[name]}`").try_cast("double") if name in seen else F.lit(None).cast("double")
    out = df if "t" in seen else numbered(df, "__row")
    t = number("t") if "t" in seen else F.col("__row") * 10.0
    axes = [F.coalesce(number(a), F.lit(0.0)).alias(a) for a in ("ax", "ay", "az")]
    rest = [number(x).alias(x) for x in ("gx", "gy", "gz", "lat", "lon", "speed") if x in seen]
    label = [F.col(f"`{seen['label_raw']}`").alias("label_raw")] if "label_raw" in seen else []
    return out.select(t.alias("t"), *axes, *rest, *label).filter("t is not null")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sensor CSV; BOM and CRLF are fine. Fails if fewer than 16 rows are usable."""
    out = canonical(spark.read.csv(path, header=True, multiLine=True, escape='"')).orderBy("t")
    if len(out.head(LEAST_ROWS)) < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} usable rows")
    return out


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted, multi-line CSV; rows that don't fit the schema are an error."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema, mode="FAILFAST", enforceSchema=False)


def load_events(raw: DataFrame) -> DataFrame:
    """Event rows with the first filled label; a row without a usable id gets its number in file order, from 0."""
    from ..functions.scalar import first_filled

    lower = {c.lower(): c for c in raw.columns}
    has = lambda *names: [F.col(f"`{lower[n]}`") for n in names if n in lower]
    raw = numbered(raw, "__row")
    one = lambda *names: F.coalesce(*(has(*names) or [F.lit(None)])).try_cast("double")
    label = first_filled(*has("final_label", "manual", "auto_label", "auto", "type", "final_type")) if has("final_label", "manual", "auto_label", "auto", "type", "final_type") else F.lit(None).cast("string")
    return raw.select(F.coalesce(one("id").cast("bigint"), F.col("__row")).alias("id"), label.alias("label"), one("duration_ms", "duration").alias("duration_ms"), one("speed_kmh", "spd").alias("speed_kmh"), one("t_ms", "t").alias("t_ms"), one("peak").alias("peak"), one("lat").alias("lat"), one("lon").alias("lon"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with line, in file order; blank lines are skipped, bad ones kept with their text."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("body")).filter("body <> ''")
    parsed = lines.withColumn("r", F.from_json("body", schema))
    return parsed.select("line", "r.*", F.when(F.col("r").isNull() | F.try_parse_json("body").isNull(), F.col("body")).alias("bad_line"))


MOST_BYTES, MOST_LINES = 10 << 20, 20_000


def import_lines(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> DataFrame:
    """Review rows of an upload of bounded size; what is wrong with a line is told with its number.

    Every row must be JSON and have a whole event_id of 0 or more.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes are more than {most_bytes}")
    lines = numbered(spark.read.text(path), "line").select((F.col("line") + 1).alias("line"), F.trim("value").alias("body")).filter("body <> ''")
    if lines.count() > most_lines:
        raise ValueError(f"more than {most_lines} lines")
    j = F.try_parse_json("body")
    event = F.try_variant_get(j, "$.event_id", "double")
    wrong = F.when(j.isNull(), "not JSON").when(event.isNull() | (event < 0) | (event != F.floor(event)), "no whole event_id")
    bad = lines.select("line", wrong.alias("why")).filter("why is not null").orderBy("line").first()
    if bad:
        raise ValueError(f"line {bad['line']}: {bad['why']}")
    return lines.select("line", F.from_json("body", schema).alias("r")).select("line", "r.*")


VISION = "struct<events:array<struct<id:string,vision_label:string,vision_conf:double,vision_why:string,vision_frames:int,source:string,lat:string,lon:string,t_ms:string>>>"


def load_vision(documents: DataFrame, body: str = "body") -> DataFrame:
    """Records of vision documents (a JSON text each): rows without a whole id are passed over, missing fields have their defaults."""
    keys = [c for c in documents.columns if c != body]
    rows = documents.select(*keys, F.explode(F.from_json(body, VISION)["events"]).alias("e"))
    number = lambda c: F.col(f"e.{c}").try_cast("double")
    whole = F.when(F.col("e.id").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("e.id").try_cast("bigint")).otherwise(F.when(F.col("e.id").rlike(r"^[+-]?\d+\.\d*$"), F.col("e.id").try_cast("double").cast("bigint")))
    return rows.select(
        *keys, whole.alias("id"), F.col("e.vision_label").alias("label"), F.col("e.vision_conf").alias("conf"), F.coalesce("e.vision_why", F.lit("")).alias("why"),
        F.coalesce("e.vision_frames", F.lit(0)).alias("frames"), F.coalesce("e.source", F.lit("event")).alias("source"), number("lat").alias("lat"), number("lon").alias("lon"), number("t_ms").alias("t_ms"),
    ).filter("id is not null")


MEMBERS = "pack_id string, name string, event_id long, t_ms long, content binary"
REQUIRED = ("samples.csv", "events.csv", "meta.json")


def unpack(content: bytes, required=REQUIRED) -> list[tuple[str, int | None, int | None, bytes]]:
    """Checked members of a pack: stored only, no way out of the folder, nothing missing."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if info.filename.startswith("/") or ".." in info.filename.split("/"):
                raise ValueError(f"unsafe member {info.filename}")
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"compressed member {info.filename}")
            m = FRAME.match(info.filename)
            out.append((info.filename, int(m[1]) if m and m[1] else None, int(m[2]) if m else None, z.read(info)))
    lost = set(required) - {x[0] for x in out}
    if lost:
        raise ValueError(f"missing members {sorted(lost)}")
    return out


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """All members of the ZIP packs at a path: one pack per row of work, frames with event and time."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("pack_id"), "content")

    def run(batches):
        for pdf in batches:
            for pack, content in pdf.itertuples(index=False):
                yield pd.DataFrame([(pack, *m) for m in unpack(content)], columns=["pack_id", "name", "event_id", "t_ms", "content"]).astype({"event_id": "Int64", "t_ms": "Int64"})

    return files.mapInPandas(run, MEMBERS)


def frames(members: DataFrame) -> DataFrame:
    """Frames per event in time order; sweeps have no event."""
    return members.filter(F.col("t_ms").isNotNull()).groupBy("pack_id", "event_id").agg(F.sort_array(F.collect_list(F.struct("t_ms", "name"))).alias("frames"))


def digest(content):
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)
