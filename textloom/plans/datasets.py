"""Hold-outs, splits, records and dataset assembly."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import splits
from . import inputs as I
from .registry import query
from .scalars import STRIP, WORDS

C = F.col
N_EVAL = 30
BUCKET = "('0x' || substr(sha256('0:' || {0}), 1, 8))::bigint / 4294967296.0::double"
KEYS = f"ranked as (select text, rank() over (order by sha256('eval:0:' || text)) as r from documents), eval_keys as (select distinct text from ranked where r <= {N_EVAL})"


def keys(spark, d, n: int = N_EVAL, docs=None):
    return splits.bottom(docs if docs is not None else I.documents(spark, d), "text", n)


@query(f"with {KEYS} select text as key from eval_keys")
def select_eval_keys(spark, d):
    return keys(spark, d).select(C("text").alias("key"))


@query("select distinct coalesce(complex, prompt) as key from (select case when doc_id % 2 = 0 then text end as complex, case when doc_id % 3 > 0 then text || '!' end as prompt from documents) where coalesce(complex, prompt) is not null")
def eval_keys(spark, d):
    rows = I.documents(spark, d).select(F.when(C("doc_id") % 2 == 0, C("text")).alias("complex"), F.when(C("doc_id") % 3 > 0, F.concat("text", F.lit("!"))).alias("prompt"))
    return rows.select(F.coalesce("complex", "prompt").alias("key")).where("key is not null").distinct()


@query(f"with {KEYS} select doc_id, lang from documents semi join eval_keys using (text)")
def carve_eval(spark, d):
    return splits.only(I.documents(spark, d), keys(spark, d), "text", "text", small=True).select("doc_id", "lang")


@query(f"with {I.PAIRS}, {KEYS} select id, case when {BUCKET.format('source')} < 0.1 then 'valid' else 'train' end as split from pairs anti join eval_keys on source = text")
def sft_exclude_eval(spark, d):
    rows = splits.without(I.pairs(spark, d), keys(spark, d), "source", "text", small=True)
    return rows.select("id", splits.split(C("source"), 0.1).alias("split"))


@query(f"with {I.PAIRS}, t as (select id, source as prompt from pairs) select id, case when {BUCKET.format('prompt')} < 0.1 then 'valid' else 'train' end as split from t anti join benchmark on prompt = text")
def dpo_exclude_eval(spark, d):
    rows = splits.without(I.pairs(spark, d).select("id", C("source").alias("prompt")), I.benchmark_keys(spark, d), "prompt", "text")
    return rows.select("id", splits.split(C("prompt"), 0.1).alias("split"))


@query(f"with {KEYS} select doc_id from documents anti join eval_keys using (text)")
def grpo_exclude_eval(spark, d):
    return splits.without(I.documents(spark, d), keys(spark, d), "text", "text", small=True).select("doc_id")


@query(f"with {KEYS}, rest as (select * from documents anti join eval_keys using (text)), v as (select text, rank() over (order by sha256('eval:0:' || text)) as r from rest), k as (select distinct text from v where r <= 20) select doc_id, case when k.text is null then 'train' else 'valid' end as split from rest left join k using (text)")
def grpo_split(spark, d):
    rest = splits.without(I.documents(spark, d), keys(spark, d), "text", "text", small=True)
    valid = keys(spark, d, 20, rest).select(C("text").alias("k"))
    return rest.join(F.broadcast(valid), C("text") == C("k"), "left").select("doc_id", F.when(C("k").isNull(), "train").otherwise("valid").alias("split"))


SIDES = f"with {I.PAIRS}, s as (select source as key, case when {BUCKET.format('source')} < 0.1 then 'valid' else 'train' end as sft from pairs group by source), p as (select source as key, case when {BUCKET.format('source')} < 0.1 then 'valid' else 'train' end as dpo from pairs where id % 2 = 0 group by source)"


@query(f"{SIDES} select sft, dpo, count(*) as n from s full join p using (key) group by sft, dpo")
def split_consistency(spark, d):
    rows = I.pairs(spark, d)
    sft = rows.select(C("source").alias("key")).distinct().select("key", splits.split(C("key"), 0.1).alias("sft"))
    dpo = rows.where("id % 2 = 0").select(C("source").alias("key")).distinct().select("key", splits.split(C("key"), 0.1).alias("dpo"))
    return sft.join(dpo, "key", "full_outer").groupBy("sft", "dpo").agg(F.count("*").alias("n"))


def _halves(spark, d):
    rows = I.documents(spark, d).select(C("text").alias("key"), splits.split(C("text"), 0.1).alias("split"))
    return (rows.where(C("split") == s).select("key") for s in ("train", "valid"))


@query("select 0::bigint as n_shared")
def split_disjoint(spark, d):
    train, valid = _halves(spark, d)
    return train.intersect(valid).agg(F.count("*").alias("n_shared"))


@query("select count(*) as n_rows, 0::bigint as n_missing from documents")
def split_cover(spark, d):
    train, valid = _halves(spark, d)
    whole, both = I.documents(spark, d).select(C("text").alias("key")), train.unionByName(valid)
    missing = whole.exceptAll(both).agg(F.count("*").alias("n_missing"))
    return both.agg(F.count("*").alias("n_rows")).join(missing, F.lit(True))


RECORDS = f"{STRIP.format('source')} as source, {STRIP.format('output')} as output"


@query(f"with {I.PAIRS}, t as (select id, {RECORDS} from pairs) select id, unnest(['system', 'user', 'assistant']) as role, unnest(['{splits.SYSTEM}', source, output]) as content from t")
def sft_records(spark, d):
    rows = I.pairs(spark, d).select("id", F.explode(splits.sft_record(C("source"), C("output"))).alias("m"))
    return rows.select("id", "m.role", "m.content")


@query(f"with {I.PAIRS}, t as (select id, {RECORDS} from pairs) select id, '{splits.SYSTEM}' as system, source as prompt, output as chosen, lower(output) as rejected from t")
def dpo_records(spark, d):
    rows = I.pairs(spark, d)
    return rows.select("id", F.lit(splits.SYSTEM).alias("system"), T.strip(C("source")).alias("prompt"), T.strip(C("output")).alias("chosen"), F.lower(T.strip(C("output"))).alias("rejected"))


@query(f"with {I.PAIRS}, t as (select id, {RECORDS} from pairs) select id, source as prompt, output as answer, '{splits.SYSTEM}' as system from t")
def grpo_records(spark, d):
    return I.pairs(spark, d).select("id", T.strip(C("source")).alias("prompt"), T.strip(C("output")).alias("answer"), F.lit(splits.SYSTEM).alias("system"))


@query(f"with {I.PAIRS} select id, source as prompt, output as chosen, left(output, 100) as rejected, src as title, 'strong' as chosen_model, 'weak' as rejected_model, 'weak-distill' as rejected_strategy from pairs")
def dpo_triples(spark, d):
    return I.pairs(spark, d).selectExpr("id", "source as prompt", "output as chosen", "left(output, 100) as rejected", "src as title", "'strong' as chosen_model", "'weak' as rejected_model", "'weak-distill' as rejected_strategy")


@query(f"with {I.PAIRS} select id, output as old_simple, left(output, 200) as simple from pairs where length(output) > 200")
def ab_side_by_side(spark, d):
    return I.pairs(spark, d).where(F.length("output") > 200).select("id", C("output").alias("old_simple"), F.substring("output", 1, 200).alias("simple"))


@query(f"select doc_id, cast(len({WORDS.format('text')}) as bigint) as n_words, row_number() over (order by len({WORDS.format('text')}), doc_id) as place from documents")
def curriculum_order(spark, d):
    """The place of every document: shortest first, input order among equals."""
    return splits.curriculum(I.documents(spark, d).select("doc_id", T.word_count(C("text")).cast("long").alias("n_words")), "n_words", "doc_id")


@query("select doc_id from documents order by sha256('sample:0:' || doc_id), doc_id limit 50")
def seeded_sample(spark, d):
    return splits.sample(I.documents(spark, d), F.concat(F.lit("sample:0:"), C("doc_id").cast("string")), "doc_id", 50).select("doc_id")


@query("with r as (select doc_id, row_number() over (order by sha256('split:0:' || doc_id), doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= greatest(1, floor(n * 0.1)) then 'valid' else 'train' end as split from r")
def shuffle_split(spark, d):
    return splits.shuffle_split(I.documents(spark, d), F.concat(F.lit("split:0:"), C("doc_id").cast("string")), "doc_id", 0.1).select("doc_id", "split")


BOUNDS = "n as (select count(*) as n from documents), q as (select n, round_even(0.60 * n, 0) as a, round_even(0.15 * n, 0) as b from n)"
MIX = f"with {BOUNDS}, r as (select doc_id, row_number() over (order by sha256('mix:0:' || doc_id), doc_id) as r from documents), mix as (select doc_id, case when r <= a then 'weak-distill' when r <= a + b then 'summarize' when r <= a + 2 * b then 'eli5' else 'clarify' end as strategy from r, q)"


def mixed(spark, d):
    return splits.assign(I.documents(spark, d), F.concat(F.lit("mix:0:"), C("doc_id").cast("string")), "doc_id")


@query(f"{MIX} select doc_id, strategy, case when strategy = 'weak-distill' then 'weak' else 'strong' end as model from mix")
def dpo_strategy_mix(spark, d):
    models = spark.createDataFrame([(n, "weak" if n == "weak-distill" else "strong") for n, _ in splits.STRATEGIES], "strategy string, model string")
    return mixed(spark, d).join(F.broadcast(models), "strategy").select("doc_id", "strategy", "model")


@query(f"{MIX} select s.strategy, count(mix.doc_id) as n from (select unnest(['weak-distill', 'summarize', 'eli5', 'clarify', 'never']) as strategy) s left join mix using (strategy) group by s.strategy")
def strategy_histogram(spark, d):
    names = spark.createDataFrame([(n,) for n, _ in splits.STRATEGIES] + [("never",)], "strategy string")
    counts = mixed(spark, d).groupBy("strategy").agg(F.count("*").alias("n"))
    return names.join(counts, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id from documents anti join (select text from documents where doc_id % 2 = 0) k using (text) order by doc_id limit 25")
def resume_pending(spark, d):
    docs = I.documents(spark, d)
    done = docs.where("doc_id % 2 = 0").select(C("text").alias("done"))
    return splits.without(docs, done, "text", "done").orderBy("doc_id").limit(25).select("doc_id")


@query("select doc_id, coalesce(nullif(case when doc_id % 2 = 0 then '' else lang end, ''), text) as prompt from documents order by doc_id limit 40")
def first_prompts(spark, d):
    prompt = F.when(C("doc_id") % 2 == 0, "").otherwise(C("lang"))
    return I.documents(spark, d).orderBy("doc_id").limit(40).select("doc_id", F.coalesce(F.nullif(prompt, F.lit("")), C("text")).alias("prompt"))


@query("select doc_id, lang as title, text from documents where length(text) > 0 and not regexp_matches(lang, '(?i)\\b(disambiguation|list of)\\b') and len(regexp_extract_all(text, '\\S+')) between 80 and 220")
def paragraph_source(spark, d):
    docs = I.documents(spark, d).where(~C("lang").rlike(r"(?i)\b(disambiguation|list of)\b"))
    return docs.where(T.word_count(C("text")).between(80, 220)).select("doc_id", C("lang").alias("title"), "text")
