"""Scoring pipelines over pairs (id, source, output, ...), with verdicts (id, f, h, lvl) or without."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

#: Registered components: name -> function of (source, output) columns.
COMPONENTS: dict[str, Callable[[Column, Column], Column]] = {}


def component(name: str):
    """Registers a reward component; any function of columns fits, pandas UDFs too."""

    def add(f):
        COMPONENTS[name] = f
        return f

    return add


component("length")(S.length_reward)
component("length_ratio")(S.length_ratio)
component("pacing")(lambda source, output: S.pacing_variety(output))
component("repetition")(lambda source, output: S.repetition(output))
component("markdown")(lambda source, output: S.markdown(output))


def mean_of(tests: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in tests:
        total = total + t
    return total / len(tests) if tests else total


def vocab(pairs: DataFrame, common: DataFrame, allowed: int = 1, severity: float = 0.5) -> DataFrame:
    """id, vocab: one minus the mean sentence penalty for uncommon words; 1 without sentences. common (word) is a bounded list."""
    sentences = pairs.select("id", F.posexplode_outer(T.sentences(F.col("output"))).alias("k", "s"))
    tokens = sentences.select("id", "k", F.posexplode_outer(T.letter_tokens(F.col("s"))).alias("p", "t"))
    proper = (F.col("p") > 0) & F.col("t").rlike("^[A-Z][a-z]+$")
    rare = tokens.join(F.broadcast(common.select(F.col("word"), F.lit(1).alias("known"))), F.lower("t") == F.col("word"), "left")
    uncommon = F.sum(F.when(F.col("t").isNotNull() & F.col("known").isNull() & ~proper, 1).otherwise(0))
    each = rare.groupBy("id", "k").agg(uncommon.alias("u"))
    penalty = F.least(F.lit(1.0), F.lit(severity) * F.greatest(F.lit(0), F.col("u") - allowed))
    return each.groupBy("id").agg(F.greatest(F.lit(0.0), 1.0 - F.avg(F.when(F.col("k").isNull(), 0.0).otherwise(penalty))).alias("vocab"))


def score(pairs: DataFrame, common: DataFrame, verdicts: DataFrame | None = None, gate: float = S.MEANING_GATE) -> DataFrame:
    """pairs' columns but the output, the six scores, ungated and combined; without verdicts meaning and difficulty are 0.5."""
    rest = [c for c in pairs.columns if c != "output"]
    own = pairs.select(*rest, *[COMPONENTS[c](F.col("source"), F.col("output")).alias(c) for c in ("length", "repetition", "markdown")])
    rows = own.join(vocab(pairs, common), "id")
    if verdicts is None:
        rows = rows.withColumns({"meaning": F.lit(0.5), "difficulty": F.lit(0.5)})
    else:
        rows = rows.join(verdicts.select("id", "f", "h", "lvl"), "id", "left").withColumns({"meaning": S.meaning(F.col("f"), F.col("h")), "difficulty": S.difficulty(F.col("lvl"))})
    columns = {c: F.col(c) for c in S.WEIGHTS}
    return rows.withColumns({"ungated": S.combined(columns, None), "combined": S.combined(columns, gate)})


def variety(rows: DataFrame, group: str, value: str = "combined") -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def variety_summary(groups: DataFrame, flat_below: float = 0.05) -> DataFrame:
    mean, low, high = (F.coalesce(f("std"), F.lit(0.0)) for f in (F.avg, F.min, F.max))
    return groups.agg(mean.alias("mean_std"), low.alias("min_std"), high.alias("max_std"), (mean < flat_below).alias("flat"))


def audit(pairs: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """id, length_ratio, pacing, lvl, flags."""
    rows = pairs.select("id", COMPONENTS["length_ratio"](F.col("source"), F.col("output")).alias("length_ratio"), COMPONENTS["pacing"](F.col("source"), F.col("output")).alias("pacing"))
    rows = rows.join(verdicts.select("id", "lvl"), "id", "left") if verdicts is not None else rows.withColumn("lvl", F.lit(None).cast("string"))
    return rows.withColumn("flags", S.audit_flags(F.col("length_ratio"), F.col("pacing"), F.col("lvl")))


#: Batch reward functions by name, as trainers call them.
REWARD_FUNCTIONS: dict[str, Callable] = {}


def register(name: str, outer: Callable | None = None):
    """Registers a batch reward function here and, if a trainer's own decorator is given, there; the function itself is returned."""

    def add(f):
        REWARD_FUNCTIONS[name] = f
        if outer is not None:
            outer(name)(f)
        return f

    return add


def batch_reward(spark, name: str) -> Callable[[list[str], list[str], list[str]], list[float]]:
    """(prompts, completions, answers) -> scores of a component, in order; lists of unequal length are an error."""

    def scores(prompts, completions, answer, types=None):
        rows = [(k, p, c) for k, (p, c, _) in enumerate(zip(prompts, completions, answer, strict=True))]
        if not rows:
            return []
        df = spark.createDataFrame(rows, "k long, source string, output string")
        return [r["x"] for r in df.select("k", COMPONENTS[name](F.col("source"), F.col("output")).alias("x")).orderBy("k").collect()]  # a trainer's batch

    return register(name)(scores)
