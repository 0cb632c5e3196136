"""Connected components by alternating large and small stars; edges never leave the executors."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Step


def _large_star(edges: DataFrame, lows: list[Step]) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    lows.append(Step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows"))
    return both.where("v > u").join(lows[-1].df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, lows: list[Step]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows.append(Step(down.groupBy("u").agg(F.min("v").alias("m")), "lows"))
    low = lows[-1].df
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v: long) reaches; nodes without an edge are absent.

    Null ends and loops are left out. Each round is a written step, so lineage stays short and lost executors cost one round. Minima
    are written too: both sides of the join are then plain exchanges, and adaptive execution can split a hub's partition.
    """
    step = Step(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _digest(step.df)
    while before[0]:
        lows: list[Step] = []
        large = Step(_large_star(step.df, lows).distinct(), "large-star")
        after = Step(_small_star(large.df, lows).distinct(), "small-star")
        for done in (large, step, *lows):
            done.drop()
        step, now = after, _digest(after.df)
        if now == before:
            break
        before = now
    return step.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(step.df.select(F.col("v"), F.col("v"))).distinct()
