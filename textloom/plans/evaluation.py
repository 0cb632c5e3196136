"""Few-shot samples and held-out evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import inputs as I
from .registry import query
from .scalars import WORDS

C = F.col
LEVEL = "['A1','A2','B1','B2+','<A1','NA'][doc_id % 6 + 1]"


def levelled(spark, d):
    level = F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1", "B2+", "<A1", "NA"))), (C("doc_id") % 6 + 1).cast("int"))
    return I.documents(spark, d).withColumn("level", level)


@query(f"with l as (select doc_id, text, {LEVEL} as level from documents) select level, doc_id, text from l where level in ('A1','A2','B1')")
def samples_by_level(spark, d):
    """Few-shot samples of all documents, whole texts: a row for each, so that no level's list is held at once; file order is that of doc_id."""
    return levelled(spark, d).where("level in ('A1', 'A2', 'B1')").select("level", "doc_id", "text")


@query(f"with l as (select doc_id, text, {LEVEL} as level from documents) select level, arg_min(left(text, 60), doc_id) as anchor from l where level in ('A1','A2','B1') group by level")
def anchor_per_level(spark, d):
    return levelled(spark, d).where("level in ('A1', 'A2', 'B1')").groupBy("level").agg(F.min_by(F.substring("text", 1, 60), "doc_id").alias("anchor"))


EVAL = f"with {I.PAIRS}, e as (select id, ['A1','A2','B1','B2+','<A1','NA'][id % 6 + 1] as level, len({WORDS.format('source')})::double as a, len({WORDS.format('output')})::double as b, output from pairs)"


def evaluated(spark, d):
    level = F.get(F.array(*map(F.lit, ("A1", "A2", "B1", "B2+", "<A1", "NA"))), F.pmod("id", F.lit(6)).cast("int"))
    return I.pair_counts(spark, d, T.word_count, "text").select("id", level.alias("level"), C("n").alias("a"), C("m").alias("b"), C("text").alias("output"))


@query(f"{EVAL} select count(*) as n, round(avg((level = 'A2')::int), 6)::double as pct_a2, round(avg((level in ('A1','<A1'))::int), 6)::double as pct_too_easy, round(avg((level in ('B1','B2+'))::int), 6)::double as pct_too_hard, round(avg(case when a > 0 then b / a end), 6)::double as mean_length_ratio from e")
def eval_summary(spark, d):
    share = lambda *levels: F.round(F.coalesce(F.avg(F.when(C("level").isin(*levels), 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    ratio = F.round(F.coalesce(F.avg(F.when(C("a") > 0, C("b") / F.nullif(C("a"), F.lit(0)))), F.lit(0.0)), 6)
    return evaluated(spark, d).drop("output").agg(F.count("*").alias("n"), share("A2").alias("pct_a2"), share("A1", "<A1").alias("pct_too_easy"), share("B1", "B2+").alias("pct_too_hard"), ratio.alias("mean_length_ratio"))


@query(f"{EVAL}, c as (select id, output, case when level = 'A2' then 'on_target' when level in ('A1','<A1') then 'too_easy' when level in ('B1','B2+') then 'too_hard' end as category from e) select category, min(id) as id, left(arg_min(output, id), 300) as excerpt from c where category is not null group by category")
def eval_samples(spark, d):
    category = F.when(C("level") == "A2", "on_target").when(C("level").isin("A1", "<A1"), "too_easy").when(C("level").isin("B1", "B2+"), "too_hard")
    rows = evaluated(spark, d).withColumn("category", category).where("category is not null")
    return rows.groupBy("category").agg(F.min("id").alias("id"), F.substring(F.min_by("output", "id"), 1, 300).alias("excerpt"))
