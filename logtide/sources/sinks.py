"""Writers: tables, sorted JSON lines, content hashes and small reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reviews import leaked


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with its top-level names in order."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))


def write_packets(df: DataFrame, path: str) -> None:
    """Packets as JSON lines; a schema that would show the label is refused before anything runs."""
    if bad := leaked(df.schema):
        raise ValueError(f"label leak: {', '.join(bad)}")
    df.select(sorted_json(df)).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def content_hash(df: DataFrame) -> Column:
    return F.sha2(sorted_json(df), 256)


def write_report(row: dict, path: str) -> None:
    """One small aggregate as indented JSON on the driver."""
    Path(path).write_text(json.dumps(row, indent=2, sort_keys=True, ensure_ascii=False, default=str))
