"""Quality rules (7): a ledger of failure bits and measurements, to which versioned policies apply.

`ledger` evaluates every rule once per text: bit k of `failed` is rule k of RULES, beside the measurements it came from. A policy
is a mask of the bits that reject; changing policies rereads the ledger, not the texts. `ablation` counts by bitwise aggregation
over the distinct masks (2^rules rows at most) what each rule of a policy rejects in all, alone, and what its removal lets back in.

Null texts have no words. Every row gives one row, repeated rows and null ids too; texts of any length are measured whole; equal texts
measure alike; other columns stay out of the ledger, and `keep` returns them as they are, whatever they are called; empty tables give
no rows.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SPACES, bounded_batches, free, id_text, text_batches

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")
#: Bit k: name, SQL condition over the measurements under which the rule fails.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 35 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("few_distinct_words", "n_words >= 50 and 100 * n_distinct_words < 10 * n_words and n_distinct_words < 200"),
)
#: Versions are kept; a new policy is a new entry.
POLICIES = {"base": 0b000011, "v1": 0b111111}


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words in windows found twice or more, the first included; distinct words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n = len(ids) - width + 1
    if n < 2 or len(known) == len(words):
        return 0, len(known)
    key = ids[:n]
    for k in range(1, width):
        if k > 1 and len(known) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[k : n + k]
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    twice, covered = times[where] > 1, np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum()), len(known)


def measure(b: bytes) -> tuple[int, ...]:
    text, words = b.decode(), b.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats, distinct = repeated_words(words)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), distinct


def failure_bits(of: str = "") -> Column:
    """A bit per rule of RULES over the measurements, fields of the struct column `of` if given."""
    named = lambda sql: re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{of}`.\1", sql) if of else sql
    return F.expr(" + ".join(f"if({named(sql)}, {1 << k}L, 0L)" for k, (_, sql) in enumerate(RULES)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES (long), failed (long: a bit per rule of RULES)."""

    def run(batches):
        for ids, texts in text_batches(batches):
            columns = list(zip(*map(measure, texts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), *(pa.array(c, type=pa.int64()) for c in columns)], names=["doc_id", *MEASURES])

    measured = id_text(docs).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *MEASURES)))
    return measured.withColumn("failed", failure_bits())


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs, all columns, whose ledger entry a policy does not reject; one pass without a shuffle."""
    bounded_batches(docs.sparkSession)
    name = free(docs, "ledger")
    kind = pa.struct([(c, pa.int64()) for c in MEASURES])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = pa.array([dict(zip(MEASURES, measure((t or "").encode()))) for t in texts], type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    measured = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StructType([StructField(c, LongType()) for c in MEASURES]))]))
    return measured.where(failure_bits(name).bitwiseAND(F.lit(POLICIES[policy])) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def rejects(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only (rejected by this rule alone, so kept without it), n_rejected, n_rows of a policy over a ledger."""
    mask = POLICIES[policy]
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = [(k, name) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    pair = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for k, name in rules])).alias("r")
    one = masks.select("failed", "n", pair).select("failed", "n", "r.*")
    return one.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("failed") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum("n").alias("n_rows"),
    )
