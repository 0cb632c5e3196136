"""Training logs, fingerprints and tolerant scans."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs
from ..sources import jsonl
from . import inputs as I
from .registry import query

C = F.col


def X(m: int, k: int = 0) -> str:
    """Thousandths of (event_id * m + k) % 9000, as log text reads back."""
    return f"((event_id * {m} + {k}) % 9000) / 1000.0::double"


def _tall(parts: list[tuple[str, list[tuple[str, str]]]]) -> str:
    """SQL rows run_id, line_no, iter, metric, value from (condition, [(metric, value)])."""
    return " union all ".join(f"select user_id as run_id, event_id as line_no, cast(event_id % 1000 as int) as iter, '{m}' as metric, round({v}, 12)::double as value from events where {c}" for c, entries in parts for m, v in entries)


def rounded(rows):
    return rows.select("run_id", "line_no", "iter", "metric", F.round("value", 12).alias("value"))


@query(_tall([("event_id % 5 = 0", [("valid/loss", X(7))]), ("event_id % 5 > 1", [("train/loss", X(1)), ("train/lr", X(11) + " / 100000"), ("train/it_per_sec", X(2)), ("train/tok_per_sec", X(13)), ("train/trained_tokens", "(event_id * 17)::double"), ("train/peak_mem_gb", X(5))])]))
def sft_log_metrics(spark, d):
    return rounded(logs.flat_metrics(I.log_lines(spark, d, "sft"), logs.SFT))


@query(_tall([("event_id % 5 = 0", [("valid/loss", X(7)), ("valid/chosen_reward", X(3)), ("valid/rejected_reward", "-" + X(9)), ("valid/accuracy", X(2)), ("valid/margin", X(4))]),
              ("event_id % 5 > 1", [("train/loss", X(1)), ("train/chosen_reward", X(2)), ("train/rejected_reward", "-" + X(3)), ("train/accuracy", X(4)), ("train/margin", X(5)), ("train/lr", X(6) + " / 1000000"), ("train/it_per_sec", X(7)), ("train/tok_per_sec", X(8)), ("train/peak_mem_gb", X(9))])]))
def dpo_log_metrics(spark, d):
    return rounded(logs.flat_metrics(I.log_lines(spark, d, "dpo"), logs.DPO))


GRPO = [(1, "train/loss", X(1)), (2, "train/reward_mean", X(2)), (2, "train/reward_std", X(3)), (3, "train/group_reward_mean", X(4)), (3, "train/group_reward_std", X(5)), (4, "train/kl", X(6)), (5, "train/avg_tokens", X(7)), (6, "train/it_per_sec", X(8)), (6, "train/tok_per_sec", X(9)), (7, "train/peak_mem_gb", X(10)), (8, "train/reward_vocab_mean", X(11)), (8, "train/reward_vocab_std", X(12)), (9, "valid/loss", X(13))]


@query("with e as (select *, case when event_id % 10 = 9 then event_id % 1000 else last_value(case when event_id % 10 = 0 then event_id % 1000 end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) end as it from events) select run_id, line_no, cast(it as int) as iter, metric, value from (" + " union all ".join(f"select user_id as run_id, event_id as line_no, it, '{m}' as metric, round({v}, 12)::double as value from e where event_id % 10 = {k}" for k, m, v in GRPO) + ") where it is not null")
def grpo_log_metrics(spark, d):
    return rounded(logs.grpo_metrics(I.log_lines(spark, d, "grpo")))


@query("select user_id as run_id, kind, cast(arg_max(event_id % 1000, event_id) as int) as iter, cast(any_value(n) as int) as n_metrics from (select *, case when event_id % 5 = 0 then 'valid' else 'train' end as kind, case when event_id % 5 = 0 then 1 else 6 end as n from events where event_id % 5 <> 1) group by user_id, kind")
def log_last_metrics(spark, d):
    return logs.last_metrics(sft_log_metrics(spark, d)).select("run_id", "kind", "iter", F.size("metrics").alias("n_metrics"))


@query("select distinct md5(text) as prompt from documents where doc_id % 5 <> 0 and doc_id % 4 <> 0 and text is not null")
def scan_tolerant(spark, d):
    """Distinct prompts of JSON lines some of which are broken or lack the key."""
    docs = I.documents(spark, d)
    good = F.to_json(F.struct(F.when(C("doc_id") % 4 == 0, F.lit(None)).otherwise(C("text")).alias("prompt"), C("lang")))
    lines = docs.select(F.when(C("doc_id") % 5 == 0, F.concat(F.lit("{broken "), C("lang"))).otherwise(good).alias("value"))
    return jsonl.tolerant_keys(lines, "prompt").select(F.md5("prompt").alias("prompt"))


@query()
def dataset_fingerprint(spark, d):
    """Fingerprint of the two smallest tables as train and valid files."""
    return spark.createDataFrame([(jsonl.fingerprint(spark, [f"{d}/region.parquet", f"{d}/nation.parquet"]),)], "fingerprint string")
