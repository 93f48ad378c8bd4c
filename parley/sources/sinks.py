"""Sinks: JSON lines, routed writes, error-tolerant conversion, report texts, hashed artifacts. None overwrites unless told to."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_routed(rows: DataFrame, path: str, bucket_col: str = "bucket", mode: str = "errorifexists") -> None:
    """A folder for each bucket."""
    rows.write.mode(mode).partitionBy(bucket_col).parquet(path)


def write_split(rows: DataFrame, condition: Column, yes_path: str, no_path: str) -> None:
    """Two tables by a condition (null: no); tables that are there stay as they are."""
    met = F.coalesce(condition, F.lit(False))
    rows.where(met).write.mode("ignore").parquet(yes_path)
    rows.where(~met).write.mode("ignore").parquet(no_path)


def convert(rows: DataFrame, record: Column, errors: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records of rows without errors, at most limit of them; a report row: seen, written, failed and ten error texts)."""
    judged = rows.select(record.alias("record"), errors.alias("errors"))
    good = judged.where(F.size("errors") == 0).select("record.*")
    failed = F.size("errors") > 0
    report = judged.agg(F.count("*").alias("seen"), F.count_if(failed).alias("failed"), F.slice(F.array_sort(F.collect_set(F.when(failed, F.element_at("errors", 1)))), 1, 10).alias("errors"))
    written = F.col("seen") - F.col("failed")
    return (good.limit(limit) if limit is not None else good), report.withColumn("written", F.least(written, F.lit(limit)) if limit is not None else written)


def report_markdown(title: str, fields: list[str]) -> Column:
    """A report row as Markdown: title and a list of fields."""
    lines = [F.lit(f"# {title}\n"), *(F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("none"))) for f in fields)]
    return F.concat_ws("\n", *lines)


def write_artifacts(folder: str, artifacts: dict[str, str]) -> dict:
    """Writes a run's few named texts and an index with their sizes and SHA-256 on the driver; returns the index."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=False)
    index = {}
    for name, content in artifacts.items():
        (base / name).write_text(content, encoding="utf-8")
        index[name] = {"bytes": len(content.encode()), "sha256": hashlib.sha256(content.encode()).hexdigest()}
    (base / "index.json").write_text(json.dumps(index, indent=2, sort_keys=True), encoding="utf-8")
    return index
