"""Levels by a judge, and held-out evaluation: generate, classify, count words, sum up, report."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from . import judge, prompts


def _levels(rows: DataFrame, text: str, make, path: str, words: int | None) -> tuple[DataFrame, DataFrame]:
    excerpt = F.col(text) if words is None else T.truncate_words(F.col(text), words)
    asked = rows.withColumn("_k", F.md5(text)).withColumn("_r", prompts.filled("level", text=excerpt))
    replies = judge.ask(asked.where("_k is not null"), ["_k"], "_r", make, path)
    return asked.drop("_r"), replies.select("_k", S.verdict(F.col("raw"), "level string")["level"].alias("_l"))


def classify(rows: DataFrame, text: str, make, path: str, words: int | None = 100) -> DataFrame:
    """rows with level: one of LEVELS, or NA where the judge fails or its answer is none; each text is asked once, by its first words."""
    asked, replies = _levels(rows, text, make, path, words)
    return asked.join(replies, "_k", "left").withColumn("level", F.coalesce(S.normalize_level(F.col("_l")), F.lit("NA"))).drop("_k", "_l")


def triage(rows: DataFrame, text: str, make, path: str) -> DataFrame:
    """rows with level as the judge wrote it, of the whole text; null where there is none."""
    asked, replies = _levels(rows, text, make, path, None)
    return asked.join(replies, "_k", "left").withColumn("level", F.nullif(T.strip(F.col("_l")), F.lit(""))).drop("_k", "_l")


def generate(rows: DataFrame, text: str, make, path: str) -> DataFrame:
    """rows with output: what the teacher makes of each distinct text, null where it failed."""
    asked = rows.withColumn("_k", F.md5(text))
    replies = judge.ask(asked.where("_k is not null"), ["_k"], text, make, path)
    return asked.join(replies.select("_k", F.col("raw").alias("output")), "_k", "left").drop("_k")


def made(rows: DataFrame, output: str = "output") -> DataFrame:
    """Rows whose generation did not fail."""
    return rows.where(F.col(output).isNotNull() & (T.strip(F.col(output)) != ""))


def evaluate(records: DataFrame, generator, classifier, path: str) -> DataFrame:
    """records (complex, title, url) with output, level, source_words, output_words; a failed step gives NA and the run goes on."""
    results = classify(generate(records, "complex", generator, f"{path}/outputs"), "output", classifier, f"{path}/levels")
    return results.withColumns({"source_words": T.word_count(F.col("complex")), "output_words": F.coalesce(T.word_count(F.col("output")), F.lit(0))})


def summarize(results: DataFrame) -> dict:
    """Count, level counts, shares on target, too easy and too hard, mean length ratio; zeros without results."""
    share = lambda *levels: F.coalesce(F.avg(F.col("level").isin(*levels).cast("double")), F.lit(0.0))
    ratio = F.coalesce(F.avg(F.when(F.col("source_words") > 0, F.col("output_words") / F.nullif(F.col("source_words"), F.lit(0)))), F.lit(0.0))
    one = results.agg(F.count("*").alias("count"), share("A2").alias("pct_a2"), share("A1", "<A1").alias("pct_too_easy"), share("B1", "B2+").alias("pct_too_hard"), ratio.alias("mean_length_ratio")).first().asDict()
    return one | {"level_counts": {r["level"]: r["count"] for r in results.groupBy("level").count().collect()}}  # a row for each level


def write_report(results: DataFrame, path: str, meta: dict) -> dict:
    """One JSON file of meta, summary and results, streamed row by row and renamed when whole; the summary is returned."""
    from ..sources import jsonl

    summary = summarize(results)

    def text():
        yield '{"meta": ' + json.dumps(meta, ensure_ascii=False, default=str) + ',\n"summary": ' + json.dumps(summary, ensure_ascii=False) + ',\n"results": ['
        for k, row in enumerate(results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            yield (",\n" if k else "\n") + row["j"]
        yield "\n]}\n"

    jsonl.write_stream(results.sparkSession, path, text())
    return summary
