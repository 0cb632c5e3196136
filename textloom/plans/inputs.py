"""Adapters from the driver's tables to the shapes that the operators take."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PAIR_STEP = 20  # a document is paired with the next one of its source
COMMON_WORDS = 3000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def pairs(spark, d):
    """id, lang, src (source name), source, output: each document with the one PAIR_STEP further; an equi-join that shuffles both, so that work spreads however few files there are."""
    docs = documents(spark, d)
    after = docs.select((F.col("doc_id") - PAIR_STEP).alias("doc_id"), F.col("text").alias("output"))
    return docs.join(after.hint("merge"), "doc_id").select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("src"), F.col("text").alias("source"), "output")


def pair_counts(spark, d, count, *later: str):
    """id, n, m (count of either text, taken before the join, so that counts are shuffled and not texts), and columns `later` of the second document."""
    docs = documents(spark, d).withColumn("count", count(F.col("text")))
    after = docs.select((F.col("doc_id") - PAIR_STEP).alias("doc_id"), F.col("count").alias("m"), *later)
    return docs.select("doc_id", F.col("count").alias("n")).join(after.hint("merge"), "doc_id").withColumnRenamed("doc_id", "id")


PAIRS = f"pairs as (select d.doc_id as id, d.lang, d.source as src, d.text as source, e.text as output from documents d join documents e on e.doc_id = d.doc_id + {PAIR_STEP})"


def verdicts(spark, d):
    """id, f, h, lvl (strings): labels of a pair's output as a judge's answers."""
    labels = table(spark, d, "labels")
    level = F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1", "B2+", "<A1", "junk"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return labels.select((F.col("doc_id") - PAIR_STEP).alias("id"), (1 + 4 * F.col("quality")).cast("string").alias("f"), (5 - 4 * F.col("toxic")).cast("string").alias("h"), level.alias("lvl"))


VERDICTS = f"verdicts as (select doc_id - {PAIR_STEP} as id, cast(1 + 4 * quality as varchar) as f, cast(5 - 4 * toxic as varchar) as h, ['A1','A2','B1','B2+','<A1','junk'][doc_id % 6 + 1] as lvl from labels)"


def common_words(spark, d, n: int = COMMON_WORDS):
    tokens = documents(spark, d).where("lang = 'en'").select(F.explode(T.letter_tokens(F.lower("text"))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(n).select("word")


COMMON = f"common as (select word from (select unnest(regexp_extract_all(lower(text), '[A-Za-z'']+')) as word from documents where lang = 'en') group by word order by count(*) desc, word limit {COMMON_WORDS})"


def benchmark_keys(spark, d):
    return table(spark, d, "benchmark").select("text").distinct()


def decimals(c):
    """An integer of thousandths as text with three digits after the point."""
    return F.concat((c / 1000).cast("long").cast("string"), F.lit("."), F.lpad((c % 1000).cast("string"), 3, "0"))


def log_lines(spark, d, kind: str):
    """run_id, line_no, value: events as lines of a trainer's log."""
    e, i = table(spark, d, "events"), F.col("event_id")
    x = lambda m, k=0: decimals((i * m + k) % 9000)
    step = (i % 1000).cast("string")
    if kind == "sft":
        value = F.when(i % 5 == 0, F.concat(F.lit("Iter "), step, F.lit(": Val loss "), x(7), F.lit(", Val took "), x(3), F.lit("s"))).when(i % 5 == 1, F.lit("loading weights")).otherwise(
            F.concat(F.lit("Iter "), step, F.lit(": Train loss "), x(1), F.lit(", Learning Rate "), x(11), F.lit("e-05, It/sec "), x(2), F.lit(", Tokens/sec "), x(13), F.lit(", Trained Tokens "), (i * 17).cast("string"), F.lit(", Peak mem "), x(5), F.lit(" GB"))
        )
    elif kind == "dpo":
        value = F.when(i % 5 == 0, F.concat(F.lit("Iter "), step, F.lit(": Val loss "), x(7), F.lit(", Val chosen reward "), x(3), F.lit(", Val rejected reward -"), x(9), F.lit(", Val accuracy "), x(2), F.lit(", Val margin "), x(4), F.lit(", Val took 0.7s"))).when(i % 5 == 1, F.lit("Iter 3: loss nan")).otherwise(
            F.concat(F.lit("Iter "), step, F.lit(": loss "), x(1), F.lit(", chosen_r "), x(2), F.lit(", rejected_r -"), x(3), F.lit(", acc "), x(4), F.lit(", margin "), x(5), F.lit(", lr "), x(6), F.lit("e-06, it/s "), x(7), F.lit(", tok/s "), x(8), F.lit(", peak_mem "), x(9), F.lit("GB"))
        )
    else:
        k = i % 10
        value = (
            F.when(k == 0, F.concat(F.lit("Iter "), step, F.lit(":")))
            .when(k == 1, F.concat(F.lit("Loss: "), x(1)))
            .when(k == 2, F.concat(F.lit("Total Rewards:  μ="), x(2), F.lit(", σ="), x(3)))
            .when(k == 3, F.concat(F.lit("Group Rewards:  μ="), x(4), F.lit(", σ="), x(5)))
            .when(k == 4, F.concat(F.lit("KL Divergence: "), x(6)))
            .when(k == 5, F.concat(F.lit("  • Avg tokens: "), x(7)))
            .when(k == 6, F.concat(F.lit("Speed: "), x(8), F.lit(" it/s, "), x(9), F.lit(" tok/s")))
            .when(k == 7, F.concat(F.lit("Memory: "), x(10), F.lit("GB")))
            .when(k == 8, F.concat(F.lit("  • vocab_reward_func: μ="), x(11), F.lit(", σ="), x(12), F.lit(", cov=1.0")))
            .otherwise(F.concat(F.lit("Iter "), step, F.lit(": Val loss "), x(13), F.lit(", Val took 1s")))
        )
    return e.select(F.col("user_id").alias("run_id"), i.alias("line_no"), value.alias("value"))
