"""Text columns: words, sentences, cleaning, excerpts. White space is what Python's str.split() cuts at."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: white space of Unicode strings, and all else.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_WS = WS.replace("[", "[^", 1)
#: Fixed: chat end marks that generations may run past.
STOP_MARKERS = ("<end_of_turn>", "<eos>", "<|im_end|>", "<|endoftext|>")


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside a higher-order function a plain column would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Parts between white space, less the empty ones at an edge; several times as fast as building every match."""
    def count(x: Column) -> Column:
        edges = sum((F.when(F.substring(x, at, 1).rlike(WS), 1).otherwise(0) for at in (1, -1)), F.lit(0))
        return F.when(x == "", 0).otherwise(F.size(F.split(x, f"{WS}+")) - edges)

    return let(c, lambda x: F.when(x.isNotNull(), count(x)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), f"(?<=[.!?]){WS}+"), lambda s: s != "")


def clean(c: Column) -> Column:
    """Without web addresses and [12]-like references, stripped; inner spaces stay."""
    return strip(F.regexp_replace(F.regexp_replace(c, f"https?://{NOT_WS}+", ""), r"\[\p{Nd}+\]", ""))


def truncate_words(c: Column, n: int = 100) -> Column:
    return F.array_join(F.slice(words(clean(c)), 1, n), " ")


def windowed_excerpts(c: Column, n: int = 100, windows: int = 3) -> Column:
    """Evenly spaced windows of n words; equal starts once; one window where n words or fewer, or where windows is 1."""
    def cut(w: Column) -> Column:
        last = F.size(w) - n
        starts = F.array_distinct(F.array(*[F.bround(F.lit(i) * last / F.lit(max(windows - 1, 1))).cast("int") for i in range(max(windows, 1))]))
        many = F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, n), " "))
        return F.when((last <= 0) | F.lit(windows <= 1), F.array(F.array_join(F.slice(w, 1, n), " "))).otherwise(many)

    return let(words(clean(c)), cut)


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, inner white space as one space; stripped after that, so that long white space costs its length once."""
    parts = F.transform(F.split(c, f"\n{WS}*\n"), lambda p: F.trim(F.regexp_replace(p, f"{WS}+", " ")))
    return F.filter(parts, lambda p: p != "")


def letter_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([A-Za-z']+)"), F.lit(1))


def clean_generation(c: Column) -> Column:
    marks = "|".join("\\Q" + m + "\\E" for m in STOP_MARKERS)
    return strip(F.get(F.split(c, marks, 2), F.lit(0)))


def short_model(c: Column) -> Column:
    """The last path part through its first size token such as 1b or 350m, or all of it."""
    leaf = F.substring_index(c, "/", -1)
    cut = F.regexp_extract(leaf, r"^((?:[^-]*-)*?[0-9]+[bm])(?:-|$)", 1)
    return F.when(cut == "", leaf).otherwise(cut)


def falsy(*columns: Column) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))
