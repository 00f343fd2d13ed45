"""Sinks: Parquet, appended JSON lines, and small driver-side documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header, as ``read_csv`` reads it."""
    df.write.mode("overwrite").options(header=True, escape='"', quoteAll=True).csv(path)


def write_text(path: str, text: str) -> None:
    """A report of bounded size."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def write_json(path: str, payload: dict) -> None:
    write_text(path, json.dumps(payload, indent=2, default=str, ensure_ascii=False) + "\n")
