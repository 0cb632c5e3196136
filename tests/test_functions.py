"""Functions on hand-made rows."""
import pytest
from pyspark.sql import functions as F

from textloom.functions import scores as S
from textloom.functions import text as T
from textloom.operators import splits


def value(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(column.alias("x")).first()["x"]


def t(spark, f, text, *args):
    return value(spark, f(F.col("t"), *args), t=text)


@pytest.mark.parametrize("text", ["", "  ", "a b", "a  b c\u001cd\u0085e", "﻿a​b c d", "x\n\ty "])
def test_words_and_strip_are_pythons(spark, text):
    assert t(spark, T.words, text) == text.split() and t(spark, T.strip, text) == text.strip()


def test_sentences(spark):
    assert t(spark, T.sentences, " One. Two!  Three?\nFour.5 six ") == ["One.", "Two!", "Three?", "Four.5 six"]
    assert t(spark, T.sentences, "  ") == []


def test_clean_and_truncate(spark):
    assert t(spark, T.clean, " see https://a.b/c?d [12] the  end [x] ") == "see   the  end [x]"
    assert t(spark, T.truncate_words, "a [1] b  c d", 3) == "a b c"


def test_windows(spark):
    words = [f"w{i}" for i in range(12)]
    assert t(spark, T.windowed_excerpts, " ".join(words), 5, 3) == [" ".join(words[s : s + 5]) for s in (0, 4, 7)]
    assert t(spark, T.windowed_excerpts, "a b", 5, 3) == ["a b"]
    assert t(spark, T.windowed_excerpts, " ".join(words), 5, 1) == [" ".join(words[:5])]
    assert t(spark, T.windowed_excerpts, " ".join(words[:6]), 5, 3) == [" ".join(words[:5]), " ".join(words[1:6])]


def test_paragraphs(spark):
    assert t(spark, T.paragraphs, " a\nb \n \n\n c  d\n\n ") == ["a b", "c d"]


def test_generation_and_models(spark):
    assert t(spark, T.clean_generation, " fine <|im_end|>x<eos>") == "fine"
    assert t(spark, T.clean_generation, "<eos>x") == "" and t(spark, T.clean_generation, " x ") == "x"
    for model, short in (("org/gemma-3-1b-it-bf16", "gemma-3-1b"), ("plain", "plain"), ("a/m-12b4-it", "m-12b4-it"), ("7b-chat", "7b")):
        assert t(spark, T.short_model, model) == short


@pytest.mark.parametrize("n,ratio,reward", [(0, 1.0, 0.0), (3, 1.0, 0.0), (5, 1.0, 0.4), (8, 1.0, 1.0), (13, 1.0, 1.0), (19, 1 / 7, 0.5), (20, 0.0, 5 / 12), (25, 0.0, 0.0)])
def test_lengths(spark, n, ratio, reward):
    source, output = "w " * 10, "w " * n
    assert value(spark, S.length_ratio(F.col("a"), F.col("b")), a=source, b=output) == pytest.approx(ratio)
    assert value(spark, S.length_reward(F.col("a"), F.col("b")), a=source, b=output) == pytest.approx(reward)
    assert value(spark, S.length_reward(F.col("a"), F.col("b")), a=" ", b=output) == 0


@pytest.mark.parametrize("text,want", [("One only.", 1.0), ("It is a. It is b.", 0.0), ("It is a. He is b.", 0.5), ("A b. A b. A b. C d.", 0.375), ("... ! ?", 0.0)])
def test_pacing(spark, text, want):
    assert t(spark, S.pacing_variety, text) == pytest.approx(want)


def test_repetition(spark):
    assert t(spark, S.repetition, "a b c") == 1.0
    assert t(spark, S.repetition, "x " * 40) == 0.0
    assert t(spark, S.repetition, "This is one fine line here. Another thing happens now then. This is one fine line here.") <= 0.5
    assert t(spark, S.repetition, "every word in this one plain sentence differs from others") == 1.0


@pytest.mark.parametrize("text,want", [("plain - text 1. x", 1.0), ("", 1.0), ("a\n- b", 0.0), ("**b**", 0.0), ("__b__", 0.0), ("x\n## h", 0.0), ("1. a", 0.0), ("`c`", 0.0), ("> q", 0.0), ("[a](b)", 0.0), ("In 1985. The", 1.0), ("a\r- b", 1.0)])
def test_markdown(spark, text, want):
    assert t(spark, S.markdown, text) == want


@pytest.mark.parametrize("raw,want", [('{"f": 4, "h": "5"}', ("4", "5")), ('x\n```json\n{"f": 1}\n```', ("1", None)), ('```\n{"h": 2}\n```', (None, "2")), ('so {"f": 3} then', ("3", None)), ("none", None)])
def test_verdicts(spark, raw, want):
    got = t(spark, S.verdict, raw)
    assert (got and (got["f"], got["h"])) == want


@pytest.mark.parametrize("raw,want,strict", [("b2+", "B2+", "NA"), ("B2", "B2+", "B2+"), (" a2 ", "A2", "A2"), ("pre-a1", "<A1", "<A1"), ("C2", "B2+", "B2+"), ("", "NA", "NA"), ("x", "NA", "NA")])
def test_levels(spark, raw, want, strict):
    assert t(spark, S.normalize_level, raw) == want and t(spark, S.normalize_level, raw, True) == strict


@pytest.mark.parametrize("f,h,want", [("5", "5", 1.0), ("1", "1", 0.0), ("3", "4.0", 0.625), ("0", "5", 0.5), ("x", "5", 0.5), ("NaN", "5", 0.5), (None, "5", 0.5), ("9", "9", 1.0)])
def test_meaning(spark, f, h, want):
    column = S.meaning(F.col("f").cast("string"), F.col("h"))
    assert value(spark, column, f=f, h=h) == want


def test_combined_and_gate(spark):
    half = {k: F.lit(0.5) for k in S.WEIGHTS}
    assert value(spark, S.combined(half), a=1) == pytest.approx(0.5)
    low = half | {"meaning": F.lit(0.2)}
    assert value(spark, S.combined(low), a=1) == 0 and value(spark, S.combined(low, None), a=1) == pytest.approx(0.38)


def test_flags_keep_their_order(spark):
    flags = S.audit_flags(F.lit(0.5), F.lit(0.1), F.lit("B1"))
    assert value(spark, flags, a=1) == ["length_inflated", "monotonous", "too_hard"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 15, 100, 200, 1000])
def test_quotas(n):
    bounds = splits.quota_bounds(n)
    assert bounds[0][1] == 0 and bounds[-1][2] == n and all(a[2] == b[1] for a, b in zip(bounds, bounds[1:]))
    if n == 15:
        assert [b - a for _, a, b in bounds] == [9, 2, 2, 2]


def test_splits(spark):
    rows = spark.range(2000).select(F.col("id"), F.concat(F.lit("key "), F.col("id").cast("string")).alias("k"))
    got = {r["k"]: r["s"] for r in rows.select("k", splits.split(F.col("k"), 0.1).alias("s")).collect()}
    assert abs(sum(s == "valid" for s in got.values()) / 2000 - 0.1) < 0.02
    more = {r["k"]: r["s"] for r in rows.where("id < 500").select("k", splits.split(F.col("k"), 0.1).alias("s")).collect()}
    assert all(got[k] == s for k, s in more.items())
    ranks = sorted(r["rank_"] for r in splits.ranked(rows, F.col("k"), "id").collect())
    assert ranks == list(range(1, 2001))


def test_tied_keys_use_up_places(spark):
    rows = spark.createDataFrame([(k,) for k in ["a"] * 3 + ["b", "c", "d", None]], "k string")
    import hashlib

    order = sorted("abcd", key=lambda k: hashlib.sha256(f"eval:0:{k}".encode()).hexdigest())
    want, n = set(), 0
    for k in order:
        if n < 3:
            want.add(k)
        n += 3 if k == "a" else 1
    assert {r["k"] for r in splits.bottom(rows, "k", 3).collect()} == want
