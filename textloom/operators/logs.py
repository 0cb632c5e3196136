"""Training-log lines to metric rows, batch form; streaming/logs.py runs the same parsers on streams."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The number pattern and line formats of three trainers.
NUM = r"-?[\d.]+(?:e[+-]?\d+)?"
SFT = {
    "train": (rf"Iter (\d+): Train loss ({NUM}), Learning Rate ({NUM}), It/sec ({NUM}), Tokens/sec ({NUM}), Trained Tokens (\d+), Peak mem ({NUM}) GB", ("loss", "lr", "it_per_sec", "tok_per_sec", "trained_tokens", "peak_mem_gb")),
    "valid": (rf"Iter (\d+): Val loss ({NUM}), Val took", ("loss",)),
}
DPO = {
    "train": (rf"Iter (\d+): loss ({NUM}), chosen_r ({NUM}), rejected_r ({NUM}), acc ({NUM}), margin ({NUM}), lr ({NUM}), it/s ({NUM}), tok/s ({NUM}), peak_mem ({NUM})GB", ("loss", "chosen_reward", "rejected_reward", "accuracy", "margin", "lr", "it_per_sec", "tok_per_sec", "peak_mem_gb")),
    "valid": (rf"Iter (\d+): Val loss ({NUM}), Val chosen reward ({NUM}), Val rejected reward ({NUM}), Val accuracy ({NUM}), Val margin ({NUM})", ("loss", "chosen_reward", "rejected_reward", "accuracy", "margin")),
}
GRPO_HEADER = r"^Iter (\d+):\s*$"
GRPO_VALID = rf"^Iter (\d+): Val loss ({NUM}),"
GRPO = (
    (rf"^Loss:\s*({NUM})", ("loss",)),
    (rf"^Total Rewards:\s*μ=({NUM}),\s*σ=({NUM})", ("reward_mean", "reward_std")),
    (rf"^Group Rewards:\s*μ=({NUM}),\s*σ=({NUM})", ("group_reward_mean", "group_reward_std")),
    (rf"^KL Divergence:\s*({NUM})", ("kl",)),
    (rf"^\s*•\s*Avg tokens:\s*({NUM})", ("avg_tokens",)),
    (rf"^Learning Rate:\s*({NUM})", ("lr",)),
    (rf"^Speed:\s*({NUM})\s*it/s,\s*({NUM})\s*tok/s", ("it_per_sec", "tok_per_sec")),
    (rf"^Memory:\s*({NUM})GB", ("peak_mem_gb",)),
)
GRPO_REWARD = rf"^\s*•\s*([a-zA-Z_][a-zA-Z0-9_]*):\s*μ=({NUM}),\s*σ=({NUM}),\s*cov="


def _groups(line: Column, pattern: str, n: int) -> Column:
    """The n groups of the pattern's first match, after an empty string; a line without a match is one part. One run of the pattern."""
    before = "" if pattern.startswith("^") else "^.*?"
    return F.split(F.regexp_replace(line, f"(?s){before}{pattern}.*$", "".join(f"\u0001${k}" for k in range(1, n + 1))), "\u0001")


def _match(line: Column, pattern: str, n: int, then) -> Column:
    """then(groups) of the n groups where the line matches, else null."""
    return T.let(_groups(line, pattern, n), lambda g: F.when(F.size(g) == n + 1, then(g)))


def _metrics(g: Column, names, prefix: str, first: int) -> Column:
    return F.array(*[F.struct(F.lit(f"{prefix}/{name}").alias("metric"), F.get(g, F.lit(k + first)).try_cast("double").alias("value")) for k, name in enumerate(names)])


def flat(line: Column, formats: dict) -> Column:
    """Struct of iter and m (array of metric and value) of a stateless format; null for other lines."""
    each = [
        _match(line, p, len(names) + 1, lambda g, kind=kind, names=names: F.struct(F.get(g, F.lit(1)).cast("int").alias("iter"), _metrics(g, names, kind, 2).alias("m")))
        for kind, (p, names) in formats.items()
    ]
    return F.coalesce(*each)


def grpo(line: Column) -> tuple[Column, Column, Column]:
    """(iteration a header starts, iteration of a line that names its own, metrics) of one stripped line."""
    s = T.strip(line)
    header = _match(s, GRPO_HEADER, 1, lambda g: F.get(g, F.lit(1)).cast("int"))
    own = _match(s, GRPO_VALID, 2, lambda g: F.get(g, F.lit(1)).cast("int"))

    def reward(g: Column) -> Column:
        name = F.replace(F.replace(F.get(g, F.lit(1)), F.lit("_reward_func"), F.lit("")), F.lit("_reward"), F.lit(""))
        return F.array(*[F.struct(F.concat(F.lit("train/reward_"), name, F.lit(end)).alias("metric"), F.get(g, F.lit(k)).try_cast("double").alias("value")) for k, end in ((2, "_mean"), (3, "_std"))])

    plain = [_match(s, p, len(names), lambda g, names=names: _metrics(g, names, "train", 1)) for p, names in GRPO]
    return header, own, F.coalesce(_match(s, GRPO_VALID, 2, lambda g: _metrics(g, ("loss",), "valid", 2)), *plain, _match(s, GRPO_REWARD, 3, reward))


def tall(df: DataFrame, step: Column, metrics: Column) -> DataFrame:
    rows = df.select("run_id", "line_no", step.alias("iter"), metrics.alias("m")).where("m is not null and iter is not null")
    return rows.select("run_id", "line_no", "iter", F.explode("m").alias("m")).select("run_id", "line_no", "iter", "m.metric", "m.value")


def flat_metrics(lines: DataFrame, formats: dict) -> DataFrame:
    """run_id, line_no, iter, metric, value from lines (run_id, line_no, value)."""
    rows = lines.select("run_id", "line_no", flat(F.col("value"), formats).alias("f"))
    return tall(rows, F.col("f.iter"), F.col("f.m"))


def grpo_metrics(lines: DataFrame) -> DataFrame:
    """The same for blocks under iteration headers: lines take the last header of their run, and are dropped before the first."""
    header, own, metrics = grpo(F.col("value"))
    rows = lines.select("run_id", "line_no", header.alias("h"), own.alias("own"), metrics.alias("m"))
    last = F.last("h", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("iter", F.coalesce("own", last))
    return tall(rows, F.col("iter"), F.col("m"))


def last_metrics(metrics: DataFrame) -> DataFrame:
    """run_id, kind and the metrics of its last line of each kind (train or valid)."""
    kinds = metrics.withColumn("kind", F.substring_index("metric", "/", 1)).groupBy("run_id", "kind", "line_no", "iter").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    return kinds.groupBy("run_id", "kind").agg(F.max("line_no").alias("line_no"), F.max_by("iter", "line_no").alias("iter"), F.max_by("metrics", "line_no").alias("metrics"))
