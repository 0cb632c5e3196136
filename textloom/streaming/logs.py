"""Log lines as streams: stateless formats by expressions, iteration headers by keyed state."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs

LINES = "run_id long, line_no long, value string"


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines that arrive as JSON files of LINES in a folder."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def flat_metrics(lines: DataFrame, formats: dict) -> DataFrame:
    return logs.flat_metrics(lines, formats)


def grpo_metrics(lines: DataFrame) -> DataFrame:
    """As operators.logs.grpo_metrics, the current iteration of each run being kept as state. A run's lines must arrive in order of batches."""
    header, own, metrics = logs.grpo(F.col("value"))
    rows = lines.select("run_id", "line_no", header.alias("h"), own.alias("own"), F.to_json(metrics).alias("m"))

    def carry(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        out = []
        for _, line_no, h, own_, m in pd.concat(list(frames)).sort_values("line_no").itertuples(index=False):
            if not pd.isna(h):
                now = int(h)
            step = int(own_) if not pd.isna(own_) else now
            if m is not None and step is not None:
                out.append((key[0], int(line_no), step, m))
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=["run_id", "line_no", "iter", "m"])

    kept = rows.groupBy("run_id").applyInPandasWithState(carry, "run_id long, line_no long, iter int, m string", "iter int", "append", "NoTimeout")
    return logs.tall(kept, F.col("iter"), F.from_json("m", "array<struct<metric:string,value:double>>"))


def latest(metrics: DataFrame) -> DataFrame:
    """run_id, metric, line_no, iter, value of the last line that has a metric; on a stream, state of one row for each, for output mode update."""
    last = F.max(F.struct("line_no", "iter", "value")).alias("last")
    return metrics.groupBy("run_id", "metric").agg(last).select("run_id", "metric", "last.*")


def to_sink(metrics: DataFrame, write, checkpoint: str, mode: str = "append"):
    """Starts a query that hands each micro-batch, with its number, to write(rows, batch): a sink that has seen a number may skip it, so restarts write once."""
    return metrics.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_lines(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends rows as JSON lines, each exactly once, also after a restart; readers see whole batches."""
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
