"""Hold-out selection, hash splits, quotas, seeded samples, curriculum order."""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed: rejected-answer strategies and their shares.
STRATEGIES = (("weak-distill", 0.60), ("summarize", 0.15), ("eli5", 0.15), ("clarify", 0.10))
SYSTEM = "Rewrite the text in plain English for a learner at level A2."


def bucket(key: Column, seed: int = 0) -> Column:
    """In [0, 1): the first 8 hex digits of sha256("seed:key") over 2**32."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split(key: Column, share: float, seed: int = 0) -> Column:
    return F.when(bucket(key, seed) < share, "valid").otherwise("train")


def eval_hash(key: Column, seed: int = 0) -> Column:
    return F.sha2(F.concat(F.lit(f"eval:{seed}:"), key), 256)


def bottom(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Distinct keys of the n rows with the smallest hashes; rows that tie share a key, so duplicates use up places."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).withColumn("_h", eval_hash(F.col(key), seed))
    top = counted.orderBy("_h").limit(n)  # n keys at most reach n rows
    before = F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))
    return top.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n).select(key)


def without(df: DataFrame, keys: DataFrame, key: str, eval_key: str, small: bool = False) -> DataFrame:
    """Rows whose key is not among keys; small: keys come from a limit, so they may be broadcast."""
    k = keys.select(F.col(eval_key).alias("_k")).where("_k is not null")
    return df.join(F.broadcast(k) if small else k, df[key] == F.col("_k"), "left_anti")


def only(df: DataFrame, keys: DataFrame, key: str, eval_key: str, small: bool = False) -> DataFrame:
    k = keys.select(F.col(eval_key).alias("_k"))
    return df.join(F.broadcast(k) if small else k, df[key] == F.col("_k"), "left_semi")


def quota_bounds(n: int, strategies=STRATEGIES) -> list[tuple[str, int, int]]:
    """(name, from, to): consecutive stretches of half-even shares of n, clipped to n; the last takes what is left."""
    bounds = list(accumulate((round(share * n) for _, share in strategies[:-1]), lambda end, size: min(n, end + size), initial=0)) + [n]
    return [(name, low, high) for (name, _), low, high in zip(strategies, bounds, bounds[1:])]


def ranked(df: DataFrame, key: Column, order: str) -> DataFrame:
    """df with rank_, the place (from 1) in the order of sha256(key), order: a global rank by range partitions, counts and offsets, in no single task."""
    hashed = df.withColumn("_h", F.sha2(key, 256)).withColumn("_cell", F.substring("_h", 1, 3))  # 4096 cells of equal hash ranges
    cells = hashed.groupBy("_cell").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", order))
    return hashed.withColumn("_r", place).join(F.broadcast(cells.drop("_n")), "_cell").withColumn("rank_", F.col("_base") + F.col("_r")).drop("_cell", "_h", "_r", "_base")


def curriculum(df: DataFrame, length: str, order: str, cell: int = 4096) -> DataFrame:
    """df with place (from 1): shortest first, then by order (a whole number); counts of cells of one length and a range of order, in no single task."""
    cells = df.withColumn("_cell", F.floor(F.col(order) / cell))
    counts = cells.groupBy(length, "_cell").agg(F.count("*").alias("_n"))
    before = lambda *by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by[:-1]).orderBy(F.col(by[-1]).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = counts.groupBy(length).agg(F.sum("_n").alias("_n")).select(F.col(length).alias("_length"), before(length).alias("_base"))  # a row for each length
    inside = counts.select(F.col(length).alias("_length"), "_cell", before(length, "_cell").alias("_inside"))
    bases = inside.alias("i").join(lengths.alias("l"), F.col("i._length").eqNullSafe(F.col("l._length"))).select("i._length", F.col("_cell").alias("_of"), (F.col("_base") + F.col("_inside")).alias("_start"))
    numbered = cells.withColumn("_r", F.row_number().over(Window.partitionBy(length, "_cell").orderBy(order)))
    placed = numbered.join(bases, numbered[length].eqNullSafe(bases["_length"]) & numbered["_cell"].eqNullSafe(bases["_of"]))
    return placed.withColumn("place", (F.col("_start") + F.col("_r")).cast("long")).select(*df.columns, "place")


def assign(df: DataFrame, key: Column, order: str, strategies=STRATEGIES) -> DataFrame:
    """df with strategy: exact quotas in seeded hash order."""
    n = df.count()
    c = F.lit(strategies[-1][0])
    for name, low, high in reversed(quota_bounds(n, strategies)):
        c = F.when((F.col("rank_") > low) & (F.col("rank_") <= high), name).otherwise(c)
    return ranked(df, key, order).withColumn("strategy", c).drop("rank_")


def shuffle_split(df: DataFrame, key: Column, order: str, share: float) -> DataFrame:
    """df with split: max(1, int(n * share)) rows are valid."""
    n_valid = max(1, int(df.count() * share))
    return ranked(df, key, order).withColumn("split", F.when(F.col("rank_") <= n_valid, "valid").otherwise("train")).drop("rank_")


def sample(df: DataFrame, key: Column, order: str, n: int) -> DataFrame:
    return df.withColumn("_h", F.sha2(key, 256)).orderBy("_h", order).limit(n).drop("_h")


def sft_record(source: Column, output: Column, system: str = SYSTEM) -> Column:
    roles = (("system", F.lit(system)), ("user", T.strip(source)), ("assistant", T.strip(output)))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in roles])
