"""Sinks: single-file CSV with a BOM, GeoJSON, resumable JSON lines, Markdown reports."""

from __future__ import annotations

import csv
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report_csv(df: DataFrame, path: str) -> None:
    """One CSV for spreadsheets, put in place at once. Rows stream through the driver, a partition at a time."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())
    os.replace(temporary, path)


def write_analysis(folder: str, events: DataFrame, windows: DataFrame | None = None, importance: DataFrame | None = None) -> list[str]:
    """events.csv (id first, in order of pack and id), windows.csv and feature_importance.csv (the most important first), of what is there; the files written."""
    os.makedirs(folder, exist_ok=True)
    order = [c for c in ("pack_id", "id") if c in events.columns]
    parts = {
        "events.csv": events.select("id", *(c for c in events.columns if c != "id")).orderBy(*order), "windows.csv": windows,
        "feature_importance.csv": None if importance is None else importance.orderBy(F.desc("importance"), "feature"),
    }
    made = {name: df for name, df in parts.items() if df is not None}
    for name, df in made.items():
        write_report_csv(df, f"{folder}/{name}")
    return list(made)


def write_text(text: str, path: str, encoding: str = "utf-8") -> None:
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding=encoding, newline="") as f:
        f.write(text)
    os.replace(temporary, path)


def write_if_absent(text: str, path: str) -> bool:
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    write_text(text, path)
    return True


def append_results(new: DataFrame, path: str) -> None:
    new.write.mode("append").json(path)


def done_so_far(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier runs wrote, or nothing yet."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A table for a report; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows)])
