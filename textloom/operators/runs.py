"""Runs: options, guards, counters, folders and metadata."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import jsonl


def limited(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows by order, or all for none or zero."""
    return df.orderBy(*order).limit(n) if n else df


def require_rows(df: DataFrame, n: int | None) -> DataFrame:
    """df, or an error if it has fewer than n rows; only n are counted."""
    if n and (found := df.limit(n).count()) < n:
        raise ValueError(f"{n} rows wanted, {found} there")
    return df


def kept_of(df: DataFrame, condition: Column) -> DataFrame:
    """One row: kept (rows for which condition holds) and total."""
    return df.agg(F.count_if(condition).alias("kept"), F.count("*").alias("total"))


def run_folder(spark: SparkSession, base: str, stage: str, timestamp: str, revision: str | None = None) -> str:
    """Makes and returns base/stage/timestamp-revision (nosha without one)."""
    path = f"{base}/{stage}/{timestamp}-{revision or 'nosha'}"
    p, fs = jsonl._fs(spark, path)
    fs.mkdirs(p)
    return path


def write_meta(spark: SparkSession, folder: str, meta: dict) -> None:
    jsonl.write_text(spark, f"{folder}/meta.json", json.dumps(meta, indent=2, default=str) + "\n")
