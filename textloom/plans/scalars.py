"""Scalar text functions over documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from . import inputs as I
from .registry import query

C = F.col
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SENTENCES = r"list_filter(string_split(regexp_replace(" + STRIP + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
CLEAN = STRIP.format(r"regexp_replace(regexp_replace({}, 'https?://\S+', '', 'g'), '\[\d+\]', '', 'g')")
WORDS = r"regexp_extract_all({}, '\S+')"
#: A text with addresses, references, end marks and blank lines in some rows.
NOTED = "doc_id, case when doc_id % 3 = 0 then 'see https://a.example/x?y=1 now [12] ' || text || ' [3]' when doc_id % 3 = 1 then text || '<eos>' || text || '<|im_end|>' else text end as text"


def noted(spark, d):
    t, k = C("text"), C("doc_id") % 3
    extra = F.when(k == 0, F.concat(F.lit("see https://a.example/x?y=1 now [12] "), t, F.lit(" [3]"))).when(k == 1, F.concat(t, F.lit("<eos>"), t, F.lit("<|im_end|>"))).otherwise(t)
    return I.documents(spark, d).select("doc_id", extra.alias("text"))


@query(f"select doc_id, cast(len({WORDS.format('text')}) as bigint) as n_words from documents")
def word_count(spark, d):
    return I.documents(spark, d).select("doc_id", T.word_count(C("text")).cast("long").alias("n_words"))


@query(f"select doc_id, cast(len({SENTENCES.format('text')}) as bigint) as n_sentences from documents")
def sentence_count(spark, d):
    return I.documents(spark, d).select("doc_id", F.size(T.sentences(C("text"))).cast("long").alias("n_sentences"))


@query(f"with t as (select {NOTED} from documents) select doc_id, md5({CLEAN.format('text')}) as cleaned from t")
def clean_text(spark, d):
    return noted(spark, d).select("doc_id", F.md5(T.clean(C("text"))).alias("cleaned"))


@query(f"with t as (select {NOTED} from documents) select doc_id, array_to_string({WORDS.format(CLEAN.format('text'))}[1:100], ' ') as head from t")
def truncate_words(spark, d):
    return noted(spark, d).select("doc_id", T.truncate_words(C("text"), 100).alias("head"))


@query(f"""with t as (select {NOTED} from documents), w as (select doc_id, {WORDS.format(CLEAN.format('text'))} as w from t),
s as (select doc_id, w, unnest(case when len(w) <= 100 then [0] else list_distinct([0, cast(round_even((len(w) - 100) / 2.0, 0) as int), len(w) - 100]) end) as s from w)
select doc_id, cast(s as bigint) as start, array_to_string(w[s + 1 : s + 100], ' ') as excerpt from s""")
def windowed_excerpts(spark, d):
    t = noted(spark, d)
    w = T.words(T.clean(C("text")))
    rows = t.select("doc_id", F.size(w).alias("n"), F.posexplode(T.windowed_excerpts(C("text"), 100, 3)).alias("k", "excerpt"))
    last = C("n") - 100
    starts = F.array_distinct(F.array(*[F.bround(F.lit(i) * last / 2.0).cast("int") for i in range(3)]))
    return rows.select("doc_id", F.when(last <= 0, 0).otherwise(F.get(starts, C("k"))).cast("long").alias("start"), "excerpt")


@query(r"""with p as (select source, string_agg(text || case when doc_id % 2 = 0 then chr(10) || '  ' || chr(10) else chr(10) || chr(10) end, '' order by doc_id) as t from documents group by source),
q as (select source, unnest(string_split(regexp_replace(t, '\n\s*\n', chr(1), 'g'), chr(1))) as p from p)
select source, regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as paragraph, count(*) as n from q where regexp_replace(p, '\s+', '', 'g') <> '' group by all""")
def paragraph_split(spark, d):
    """Each document's gap holds a blank line, so no paragraph runs on into the next document: each text is split by itself."""
    parts = I.documents(spark, d).select("source", F.explode(T.paragraphs(C("text"))).alias("paragraph"))
    return parts.groupBy("source", "paragraph").agg(F.count("*").alias("n"))


@query("select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z'']+')) as bigint) as n_tokens, md5(array_to_string(regexp_extract_all(text, '[A-Za-z'']+'), ' ')) as tokens from documents")
def letter_tokens(spark, d):
    t = T.letter_tokens(C("text"))
    return I.documents(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query(f"with t as (select {NOTED} from documents) select doc_id, md5({STRIP.format(chr(39).join(['regexp_replace(text, ', '(?s)(<end_of_turn>|<eos>|<[|]im_end[|]>|<[|]endoftext[|]>).*', ', ', '', ')']))}) as cleaned from t")
def clean_generation(spark, d):
    return noted(spark, d).select("doc_id", F.md5(T.clean_generation(C("text"))).alias("cleaned"))


MODELS = ["org/gemma-3-1b-it-bf16", "plain", "a/b/qwen-350m", "x/llama-70b", "7b-chat", "acme/model-3.5-mini", "org/m-12b4-it"]


@query(r"""with m as (select doc_id, ['org/gemma-3-1b-it-bf16','plain','a/b/qwen-350m','x/llama-70b','7b-chat','acme/model-3.5-mini','org/m-12b4-it'][doc_id % 7 + 1] as model from documents),
l as (select doc_id, regexp_extract(model, '[^/]*$') as leaf from m)
select doc_id, case when regexp_extract(leaf, '^(([^-]*-)*?[0-9]+[bm])(-|$)', 1) = '' then leaf else regexp_extract(leaf, '^(([^-]*-)*?[0-9]+[bm])(-|$)', 1) end as short from l""")
def short_model(spark, d):
    model = F.element_at(F.array(*map(F.lit, MODELS)), (C("doc_id") % len(MODELS) + 1).cast("int"))
    return I.documents(spark, d).select("doc_id", T.short_model(model).alias("short"))


@query("select doc_id, case when regexp_matches(text, '(?i)\\b(the|list of)\\b') then true else false end as bad from documents where not regexp_matches(text, '(?i)\\b(disambiguation|list of|nothing)\\b')")
def filter_bad_title(spark, d):
    docs = I.documents(spark, d).where(~C("text").rlike(r"(?i)\b(disambiguation|list of|nothing)\b"))
    return docs.select("doc_id", C("text").rlike(r"(?i)\b(the|list of)\b").alias("bad"))


@query(f"select doc_id, cast(len({WORDS.format('text')}) as bigint) as n_words from documents where len({WORDS.format('text')}) between 60 and 220")
def filter_word_band(spark, d):
    return word_count(spark, d).where("n_words between 60 and 220")


@query(rf"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as p from documents),
g as (select doc_id, k, {STRIP.format('p')} as p from l) select doc_id, arg_min(regexp_replace(p, '\s+', ' ', 'g'), k) as paragraph from g where len({WORDS.format('p')}) between 20 and 220 group by doc_id""")
def first_paragraph(spark, d):
    """The first qualifying paragraph; single line breaks are made blank lines, as documents have none."""
    parts = T.paragraphs(F.replace(C("text"), F.lit("\n"), F.lit("\n\n")))
    first = F.get(F.filter(parts, lambda p: T.word_count(p).between(20, 220)), F.lit(0))
    return I.documents(spark, d).select("doc_id", first.alias("paragraph")).where("paragraph is not null")


@query("select doc_id, coalesce(nullif(case doc_id % 3 when 0 then '' when 1 then 'https://x.example/' || source end, ''), 'https://en.wikipedia.org/wiki/' || replace(left(text, 30), ' ', '_')) as url from documents")
def url_fallback(spark, d):
    given = F.when(C("doc_id") % 3 == 0, "").when(C("doc_id") % 3 == 1, F.concat(F.lit("https://x.example/"), C("source")))
    made = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.substring("text", 1, 30), F.lit(" "), F.lit("_")))
    return I.documents(spark, d).select("doc_id", F.coalesce(F.nullif(given, F.lit("")), made).alias("url"))


@query("select doc_id, coalesce(nullif(case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then null else source end, ''), nullif(case when doc_id % 2 = 0 then lang else '' end, ''), case when doc_id % 3 = 0 then left(text, 5) end, '') as output from documents")
def output_coalesce(spark, d):
    k = C("doc_id")
    a = F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).otherwise(C("source"))
    return I.documents(spark, d).select("doc_id", T.falsy(a, F.when(k % 2 == 0, C("lang")).otherwise(""), F.when(k % 3 == 0, F.substring("text", 1, 5))).alias("output"))


@query(r"""with p as (select id, output from (select doc_id as id, text as output from documents)), w as (select id, regexp_extract_all(output, '\S+') as w from p)
select doc_id, case when regexp_matches(t, '\*\*[^*\n]+\*\*|__[^_\n]+__|`[^`\n]+`|\[[^\]\n]+\]\([^)\n]+\)') or regexp_matches(t, '(?m)^#{1,6}\s|^\s*[-*+]\s|^\s*\d+\.\s\S|^>\s') then 0.0::double else 1.0::double end as score
from (select doc_id, ['# ', '- ', '1. ', '> ', '`x` ', '[a](b) ', '', '', '', '']  [doc_id % 10 + 1] || text as t from documents)""")
def markdown_score(spark, d):
    lead = F.element_at(F.array(*map(F.lit, ("# ", "- ", "1. ", "> ", "`x` ", "[a](b) ", "", "", "", ""))), (C("doc_id") % 10 + 1).cast("int"))
    return I.documents(spark, d).select("doc_id", S.markdown(F.concat(lead, C("text"))).alias("score"))


RAW_LEVELS = ("a1", " A2 ", "B1", "B2", "B2+", "C1", "c2+", "below a1", "PRE-A1", "<A1", "junk", "")


@query("""with l as (select doc_id, upper(trim(['a1',' A2 ','B1','B2','B2+','C1','c2+','below a1','PRE-A1','<A1','junk',''][doc_id % 12 + 1])) as l from documents),
n as (select doc_id, case when l in ('BELOW A1','PRE-A1','<<A1') then '<A1' when l in ('B2','B2+','C1','C2','C1+','C2+') then 'B2+' when l in ('<A1','A1','A2','B1') then l else 'NA' end as level, l from l)
select doc_id, level, case when l = 'B2+' then 'NA' else level end as strict_level from n""")
def normalize_level(spark, d):
    raw = F.element_at(F.array(*map(F.lit, RAW_LEVELS)), (C("doc_id") % len(RAW_LEVELS) + 1).cast("int"))
    return I.documents(spark, d).select("doc_id", S.normalize_level(raw).alias("level"), S.normalize_level(raw, strict=True).alias("strict_level"))


@query("select doc_id, case when doc_id % 6 = 1 then 1.0::double else 0.0::double end as score from documents")
def a2_score(spark, d):
    level = F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1", "B2+", "<A1", "junk"))), (C("doc_id") % 6 + 1).cast("int"))
    return I.documents(spark, d).select("doc_id", S.a2(level).alias("score"))


@query("select doc_id, case doc_id % 5 when 4 then null else cast(doc_id % 7 as varchar) end as f, case doc_id % 5 when 4 then null else ['A1','A2','B1'][doc_id % 3 + 1] end as lvl from documents")
def parse_verdict(spark, d):
    f, lvl = (C("doc_id") % 7).cast("string"), F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1"))), (C("doc_id") % 3 + 1).cast("int"))
    body = F.concat(F.lit('{"f": '), f, F.lit(', "lvl": "'), lvl, F.lit('"}'))
    k = C("doc_id") % 5
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nbye"))).when(k == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(k == 3, F.concat(F.lit("I think "), body, F.lit(" fits"))).otherwise("no verdict")
    v = S.verdict(raw)
    return I.documents(spark, d).select("doc_id", v["f"].alias("f"), v["lvl"].alias("lvl"))


@query("select doc_id, ('0x' || substr(sha256('0:' || text), 1, 8))::bigint / 4294967296.0::double as bucket, case when ('0x' || substr(sha256('0:' || text), 1, 8))::bigint / 4294967296.0::double < 0.1 then 'valid' else 'train' end as split from documents")
def hash_split(spark, d):
    from ..operators import splits

    return I.documents(spark, d).select("doc_id", splits.bucket(C("text")).alias("bucket"), splits.split(C("text"), 0.1).alias("split"))
