"""Rewards, judge verdicts and audits over document pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import text as T
from ..operators import rewards
from . import inputs as I
from .registry import query
from .scalars import CLEAN, SENTENCES, STRIP, WORDS

C = F.col
LENGTH = f"""length_ as (select id, case when n = 0 or m / n <= 0.3 or m / n >= 2.5 then 0.0 when m / n < 0.8 then (m / n - 0.3) / 0.5 when m / n > 1.3 then (2.5 - m / n) / 1.2 else 1.0 end as length
from (select id, len({WORDS.format('source')})::double as n, len({WORDS.format('output')})::double as m from pairs))"""
RATIO = f"""ratio_ as (select id, case when n = 0 then 0.0 when m / n <= 1.3 then 1.0 when m / n >= 2.0 then 0.0 else 1 - (m / n - 1.3) / 0.7 end as ratio
from (select id, len({WORDS.format(CLEAN.format('source'))})::double as n, len({WORDS.format(CLEAN.format('output'))})::double as m from pairs))"""
PACING = f"""pacing_ as (select id, case when n < 2 then 1.0 else 1.0 - squares / (n * n) end as pacing from (select id, any_value(n) as n, sum(c * c) as squares from
(select id, n, o, count(*)::double as c from (select id, len(s)::double as n, unnest(list_transform(s, lambda x: array_to_string(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')[1:2], chr(1)))) as o
from (select id, {SENTENCES.format('output')} as s from pairs)) group by all) group by id)
union all select id, 1.0 from pairs where len({SENTENCES.format('output')}) = 0)"""
REPETITION = f"""w_ as (select id, {WORDS.format('output')} as w, list_transform({SENTENCES.format('output')}, lambda x: lower({STRIP.format('x')})) as s from pairs),
most_ as (select id, max(c) as most from (select id, x, count(*) as c from (select id, unnest(s) as x from w_) group by all) group by id),
grams_ as (select id, count(distinct g) / count(*)::double as share from (select id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], chr(1)))) as g from w_ where len(w) >= 8) group by id),
repetition_ as (select w_.id, case when len(w) < 8 then 1.0 else least(greatest(0.0, least(1.0, (share - 0.55) / (0.95 - 0.55))), case when most > 1 then 1.0 / most else 1.0 end) end as repetition
from w_ left join most_ using (id) left join grams_ using (id))"""
VOCAB = f"""sentence_ as (select id, generate_subscripts(s, 1) as k, unnest(s) as x from (select id, {SENTENCES.format('output')} as s from pairs)),
token_ as (select id, k, generate_subscripts(t, 1) as p, unnest(t) as t from (select id, k, regexp_extract_all(x, '[A-Za-z'']+') as t from sentence_)),
rare_ as (select id, k, count(*) as u from token_ left join common on lower(t) = word where word is null and not (p > 1 and regexp_full_match(t, '[A-Z][a-z]+')) group by id, k),
penalty_ as (select s.id, least(1.0, 0.5 * greatest(0, coalesce(u, 0) - 1)) as x from sentence_ s left join rare_ r on r.id = s.id and r.k = s.k),
vocab_ as (select pairs.id, coalesce(greatest(0.0, 1.0 - v.x), 1.0) as vocab from pairs left join (select id, avg(x) as x from penalty_ group by id) v using (id))"""
MARKDOWN = r"""markdown_ as (select id, case when regexp_matches(output, '\*\*[^*\n]+\*\*|__[^_\n]+__|`[^`\n]+`|\[[^\]\n]+\]\([^)\n]+\)') or regexp_matches(output, '(?m)^#{1,6}\s|^\s*[-*+]\s|^\s*\d+\.\s\S|^>\s') then 0.0 else 1.0 end as markdown from pairs)"""
JUDGED = """judged_ as (select pairs.id, case when f is null or try_cast(f as double) is null or try_cast(h as double) is null or f::double = 0 or h::double = 0 then 0.5
else greatest(0.0, least(1.0, ((f::double - 1) / 4 + (h::double - 1) / 4) / 2)) end as meaning, case lvl when 'A2' then 1.0 when 'A1' then 0.6 when '<A1' then 0.2 when 'B1' then 0.4 when 'B2+' then 0.0 else 0.5 end as difficulty
from pairs left join verdicts using (id))"""
TOTAL = "greatest(0.0, least(1.0, 0.40 * meaning + 0.25 * difficulty + 0.15 * repetition + 0.10 * vocab + 0.05 * length + 0.05 * markdown))"
SCORES = f"""scores as (select *, case when meaning < 0.3 then 0.0 else total end as combined from (select pairs.id, pairs.lang, pairs.src, pairs.source, length, vocab, repetition, markdown, meaning, difficulty, {TOTAL} as total
from pairs join length_ using (id) join vocab_ using (id) join repetition_ using (id) join markdown_ using (id) join judged_ using (id)))"""
ALL = "with " + ",\n".join((I.PAIRS, I.VERDICTS, I.COMMON, LENGTH, REPETITION, VOCAB, MARKDOWN, JUDGED, SCORES))
BLIND = ALL.replace(JUDGED, "judged_ as (select id, 0.5 as meaning, 0.5 as difficulty from pairs)").replace(I.VERDICTS + ",\n", "")
r6 = lambda c: F.round(c, 6)


def scored(spark, d, judged: bool = True) -> DataFrame:
    return rewards.score(I.pairs(spark, d), I.common_words(spark, d), I.verdicts(spark, d) if judged else None)


@query(f"with {I.PAIRS}, {LENGTH} select id, round(length, 6)::double as score from length_")
def length_reward(spark, d):
    return I.pair_counts(spark, d, T.word_count).select("id", r6(S.band_score(C("n"), C("m"))).alias("score"))


@query(f"with {I.PAIRS}, {RATIO} select id, round(ratio, 6)::double as score from ratio_")
def length_ratio_score(spark, d):
    return I.pair_counts(spark, d, lambda text: T.word_count(T.clean(text))).select("id", r6(S.ratio_score(C("n"), C("m"))).alias("score"))


@query(f"with {I.PAIRS}, {PACING} select id, round(pacing, 6)::double as score from pacing_")
def pacing_variety(spark, d):
    return I.pairs(spark, d).select("id", r6(S.pacing_variety(C("output"))).alias("score"))


@query(f"with {I.PAIRS}, {REPETITION} select id, round(repetition, 6)::double as score from repetition_")
def repetition_score(spark, d):
    return I.pairs(spark, d).select("id", r6(S.repetition(C("output"))).alias("score"))


@query(f"with {I.PAIRS}, {I.COMMON}, {VOCAB} select id, round(vocab, 6)::double as score from vocab_")
def vocab_score(spark, d):
    return rewards.vocab(I.pairs(spark, d), I.common_words(spark, d)).select("id", r6(C("vocab")).alias("score"))


@query(f"with {I.PAIRS}, {I.VERDICTS}, {JUDGED} select id, round(meaning, 6)::double as score from judged_")
def meaning_score(spark, d):
    return I.pairs(spark, d).select("id").join(I.verdicts(spark, d), "id", "left").select("id", r6(S.meaning(C("f"), C("h"))).alias("score"))


@query(f"with {I.PAIRS}, {I.VERDICTS}, {JUDGED} select id, difficulty::double as score from judged_")
def difficulty_score(spark, d):
    return I.pairs(spark, d).select("id").join(I.verdicts(spark, d), "id", "left").select("id", S.difficulty(C("lvl")).alias("score"))


@query(f"with {I.PAIRS}, {I.VERDICTS} select md5(source || chr(1) || output) as pair, min(f) as f, min(h) as h, min(lvl) as lvl, count(*) as n from pairs join verdicts using (id) group by all")
def judge_bundle(spark, d):
    """One verdict for each distinct pair, joined back to all rows that share it."""
    key = F.md5(F.concat(C("source"), F.lit("\u0001"), C("output"))).alias("pair")  # 128 bits stand for both texts
    rows = I.pairs(spark, d).select("id", key).join(I.verdicts(spark, d), "id")
    once = rows.groupBy("pair").agg(F.min("f").alias("f"), F.min("h").alias("h"), F.min("lvl").alias("lvl"))
    back = rows.select("id", "pair").join(once, "pair", "left")
    return back.groupBy("pair").agg(F.min("f").alias("f"), F.min("h").alias("h"), F.min("lvl").alias("lvl"), F.count("*").alias("n"))


COLUMNS = ("length", "vocab", "repetition", "markdown", "meaning", "difficulty", "combined")


@query(f"{ALL} select id, round(total, 6)::double as ungated, round(combined, 6)::double as gated from scores")
def reward_combined(spark, d):
    return scored(spark, d).select("id", r6(C("ungated")).alias("ungated"), r6(C("combined")).alias("gated"))


@query(f"{BLIND} select id, {', '.join(f'round({c}, 6)::double as {c}' for c in COLUMNS)} from scores")
def reward_batch(spark, d):
    return scored(spark, d, judged=False).select("id", *[r6(C(c)).alias(c) for c in COLUMNS])


@query(f"{BLIND} select lang, count(*) as n, {', '.join(f'round(avg({c}), 6)::double as {c}' for c in COLUMNS)} from scores group by lang")
def reward_means(spark, d):
    return scored(spark, d, judged=False).groupBy("lang").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in COLUMNS])


@query(f"{ALL} select id, round(combined, 6)::double as combined from scores order by combined, id limit 10")
def reward_worst(spark, d):
    return scored(spark, d).orderBy("combined", "id").limit(10).select("id", r6(C("combined")).alias("combined"))


@query(f"{ALL} select src, count(*) as n, round(avg(combined), 6)::double as mean, round(stddev_pop(combined), 6)::double as std from scores group by src")
def reward_variety(spark, d):
    return rewards.variety(scored(spark, d), "src").select("src", "n", r6(C("mean")).alias("mean"), r6(C("std")).alias("std"))


@query(f"{ALL}, g as (select stddev_pop(combined) as std from scores group by src) select round(avg(std), 6)::double as mean_std, round(min(std), 6)::double as min_std, round(max(std), 6)::double as max_std, avg(std) < 0.05 as flat from g")
def reward_variety_summary(spark, d):
    return rewards.variety_summary(rewards.variety(scored(spark, d), "src")).select(r6(C("mean_std")).alias("mean_std"), r6(C("min_std")).alias("min_std"), r6(C("max_std")).alias("max_std"), "flat")


@query(f"{ALL} select id, round(coalesce((combined - avg(combined) over w) / nullif(stddev_pop(combined) over w, 0), 0), 5)::double as advantage from scores window w as (partition by src)")
def group_advantage(spark, d):
    """Rewards less their group's mean, over its spread: group statistics joined back, so that no group is sorted in one task."""
    rows = scored(spark, d).select("id", "src", "combined")
    stats = rewards.variety(rows, "src").select("src", "mean", "std")
    return rows.join(stats, "src").select("id", F.round(F.coalesce((C("combined") - C("mean")) / F.nullif(C("std"), F.lit(0.0)), F.lit(0.0)), 5).alias("advantage"))


@query(f"with {I.PAIRS}, {RATIO}, {PACING} select id, round((ratio + pacing) / 2, 6)::double as score from ratio_ join pacing_ using (id)")
def verifier_mean(spark, d):
    tests = [S.length_ratio(C("source"), C("output")), S.pacing_variety(C("output"))]
    return I.pairs(spark, d).select("id", r6(rewards.mean_of(tests)).alias("score"))


AUDIT = f"with {I.PAIRS}, {I.VERDICTS}, {RATIO}, {PACING}, audit as (select id, ratio, pacing, lvl, list_filter([case when ratio < 1 then 'length_inflated' end, case when pacing < 0.4 then 'monotonous' end, case when lvl in ('A1','<A1') then 'too_easy' when lvl in ('B1','B2+') then 'too_hard' end], lambda x: x is not null) as flags from pairs join ratio_ using (id) join pacing_ using (id) left join verdicts using (id))"


def audited(spark, d):
    return rewards.audit(I.pairs(spark, d), I.verdicts(spark, d))


@query(f"{AUDIT} select id, round(ratio, 6)::double as length_ratio, round(pacing, 6)::double as pacing, array_to_string(flags, ',') as flags from audit")
def audit_flags(spark, d):
    return audited(spark, d).select("id", r6(C("length_ratio")).alias("length_ratio"), r6(C("pacing")).alias("pacing"), F.array_join("flags", ",").alias("flags"))


@query(f"{AUDIT} select flag, count(*) as n from (select unnest(flags) as flag from audit) group by flag")
def audit_flag_counts(spark, d):
    return audited(spark, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"{AUDIT} select count(*) as n, round(avg(ratio), 6)::double as mean_length_ratio, round(avg(pacing), 6)::double as mean_pacing, count(lvl) as n_judged from audit")
def audit_totals(spark, d):
    return audited(spark, d).agg(F.count("*").alias("n"), r6(F.coalesce(F.avg("length_ratio"), F.lit(0.0))).alias("mean_length_ratio"), r6(F.coalesce(F.avg("pacing"), F.lit(0.0))).alias("mean_pacing"), F.count("lvl").alias("n_judged"))


@query(f"{AUDIT} select id, cast(len(flags) as bigint) as n_flags, round(pacing, 6)::double as pacing from audit order by len(flags) desc, round(pacing, 6), id limit 10")
def audit_worst(spark, d):
    return audited(spark, d).select("id", F.size("flags").cast("long").alias("n_flags"), r6(C("pacing")).alias("pacing")).orderBy(C("n_flags").desc(), "pacing", "id").limit(10)


@query(f"with {I.PAIRS}, {I.VERDICTS} select lvl as level, count(*) as n from pairs join verdicts using (id) where lvl <> '' group by lvl")
def level_counts(spark, d):
    return audited(spark, d).where("lvl <> ''").groupBy(C("lvl").alias("level")).agg(F.count("*").alias("n"))
