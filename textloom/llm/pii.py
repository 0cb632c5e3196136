"""PII (4): high-recall generators, boosted trees over format and context, calibrated thresholds.

The base spans of each kind (leftmost, non-overlapping, filtered by form) always stay. Wider generators propose further spans,
overlapping ones too: obfuscated addresses ("x (at) y (dot) com", "x at y dot com"), defanged and version 6 internet addresses, card
numbers with other separators, telephone numbers without a plus. Boosted trees of each kind score every proposal by its format and
context; of those above the kind's threshold the best are taken first, and none that touches a base span or a better one.

The trees learn from plants, so their labels are known without the base's tests: in each text of a bounded sample (`sample` ids, the
smallest by hash) personal data in wide forms and decoys of like shape (numbers that fail their checks, versions, dates, digits inside
identifiers) are set between words. Base spans of the sample count as positives, its own proposals that fail their kind's validity as
negatives; plausible ones are left out. Half the examples set the threshold: the lowest score at which `precision` of what passes is
right and `specificity` of the sample's own negatives stay out, but 0.5 at least. Offsets are code points, ends exclusive.

Null texts are empty and give a row without spans; every row gives one row, repeated ones too; equal texts give equal spans; texts of
any length are searched whole in linear time; other columns stay out; without any id nothing is learned and base spans stand alone;
empty tables give no rows.
"""
from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bounded_batches, id_text, text_batches

KINDS = ("email", "ip", "card", "phone")
#: The base forms. Searches are anchored (see find_base) so that long runs cost linear time.
EMAIL_LOCAL, EMAIL_DOMAIN = "[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider forms; every repetition is bounded. Addresses are sought around AT.
AT = r"\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?|\x20at\x20"
DOT = r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\.)"
LOCAL_END, DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})$"), re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}")
WIDE = {
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3,7}(?![0-9])", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,2}(?![0-9A-Za-z:])"),
    "card": (r"(?<![0-9])[0-9](?:[\x20._/-]{0,3}[0-9]){11,18}(?![0-9])",),
    "phone": (r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20./-]{0,2}[0-9]{3,4}[\x20./-]{0,2}[0-9]{3,5}(?![0-9])", r"(?<![0-9+])(?:\+|00)?[0-9]{1,3}[\x20./-]?\(?[0-9]{2,4}\)?(?:[\x20./-]{0,2}[0-9]{2,4}){2,4}(?![0-9])"),
}
CUES = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile", "dial")}


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind and start."""
    found = []
    if "@" in text:
        local, domain, end, at = re.compile(EMAIL_LOCAL), re.compile(EMAIL_DOMAIN), 0, text.find("@")
        while at >= 0:
            start = at
            while start > end and local.match(text, start - 1):
                start -= 1
            if start < at and (m := domain.match(text, at + 1)):
                found.append((0, start, end := m.end()))
            at = text.find("@", max(at + 1, end))
    if re.search("[0-9]", text):
        if "." in text:
            found += [(1, *m.span()) for m in re.finditer(IP, text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in re.finditer(CARD, text):
            if 13 <= m.end() - m.start() and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in re.finditer(PHONE, text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def plain(span: str) -> str:
    """An address without its disguise."""
    return re.sub(r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20|\x20?@\x20?", "@", re.sub(r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\))\x20?|\x20dot\x20|\x20?\.\x20?", ".", span))


def valid(kind: int, span: str) -> bool:
    """Whether the span, its disguise aside, can be what its kind says."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}", plain(span)) is not None
    if kind == 1:
        return ":" in span or len(parts := plain(span).split(".")) == 4 and all(x == "0" or x[:1] != "0" and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def features(kind: int, text: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span, before = text[start:end], text[max(0, start - 24) : start].lower()
    groups, seps = re.findall("[0-9]+", span), re.findall("[^0-9A-Za-z]+", span)
    sizes, prior, after = [len(g) for g in groups] or [0], text[start - 1 : start], text[end : end + 1]
    own, shape = plain(span) if kind < 2 else span, [seps.count(x) for x in dict.fromkeys(seps)]
    return [
        float(sum(sizes)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(len(shape)), float(max(shape, default=0)), float(max(map(len, seps), default=0)),
        float(sum(c.isalpha() for c in span)), float(len(own)), float("(" in span), float("." in span), float(" " in span), float("-" in span), float(own != span),
        float(prior.isalnum()), float(after.isalnum()), float(prior in ("#", "$", "=", '"', "/", "-", "_")), float(any(c in before for c in CUES[KINDS[kind]])),
        float(valid(kind, span)), float(len(own.rsplit(".", 1)[-1])), float(span.startswith(("00", "(", "1"))), float("@" in span), float(span.count("(") == span.count(")")),
    ]


def propose(text: str) -> list[tuple[int, int, int]]:
    """Spans of the wider forms, of all kinds and overlapping."""
    found = set()
    for m in re.finditer(AT, text):  # around each sign, so that long runs without one cost nothing
        local, domain = LOCAL_END.search(text[max(0, m.start() - 64) : m.start()]), DOMAIN.match(text, m.end())
        if local and domain and (m[0] != " at " or not domain[0].replace(".", "").isalnum()):
            found.add((0, m.start() - len(local[0]), domain.end()))
    if re.search("[0-9]", text):
        found |= {(kind, *m.span()) for kind in (1, 2, 3) for form in WIDE[KINDS[kind]] for m in re.finditer(form, text)}
    return sorted(found)


def touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(a < end and start < z for a, z in spans)


def _letters(rng, low: int, high: int) -> str:
    return "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(low, high)))


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _checked(rng, right: bool) -> str:
    number = str(rng.integers(3, 7)) + _digits(rng, 14)
    return number + next(d for d in rng.permutation(list("0123456789")) if luhn(number + str(d)) == right)


def plant(rng, kind: int, right: bool) -> str:
    """Personal data of a kind in a wide form, or a decoy of like shape."""
    pick = lambda *some: some[rng.integers(len(some))]
    if kind == 0:
        local, domain, top = _letters(rng, 2, 9) + pick("", "." + _letters(rng, 2, 8), _digits(rng, 2)), _letters(rng, 3, 11), pick("com", "org", "net", "io", "de", "fr", "es", "co.uk", "info")
        at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" at ", " dot "), (" @ ", "."), ("(at)", "."))
        if right:
            return f"{local}{at}{domain}{dot}{top.replace('.', dot)}"
        return pick(f"{domain} @ {_digits(rng, 2)}.{_digits(rng, 2)}", f"{domain}{at}{domain}{dot}{_digits(rng, 2)}", f"{domain}{at}-{domain}{dot}{top}-", f"{domain}{at}{_digits(rng, 1)}{dot}{_digits(rng, 1)}")
    if kind == 1:
        if right and rng.random() < 0.2:
            return ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8))
        n, high = (4, 256) if right else pick((4, 999), (5, 99), (6, 20), (7, 256))
        parts = [str(x) for x in rng.integers(0, high, n)]
        if not right and n == 4:
            parts[rng.integers(4)] = str(rng.integers(256, 1000))
        return (pick("", "v") if not right else "") + pick("[.]", "(.)", "[dot]", "(dot)", " . ").join(parts)
    if kind == 2:
        number, sep = _checked(rng, right or rng.random() < 0.3), pick(".", "/", "_", "  ", " - ")
        if right:
            return sep.join(number[k : k + 4] for k in range(0, 16, 4))
        wrong = _checked(rng, False)
        return pick(_letters(rng, 1, 4) + number + _letters(rng, 1, 4), sep.join(wrong[k : k + 4] for k in range(0, 16, 4)), wrong, wrong, f'"{_letters(rng, 3, 6)}{number}{_letters(rng, 3, 6)}"')
    a, b, c, d = (_digits(rng, n) for n in (3, 3, 4, 2))
    if right:
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{d} {a} {b} {c}", f"00{d}-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"00{d} {d} {d} {d} {d} {d}")
    year = str(rng.integers(1900, 2100))
    return pick(f"{year}-{d}-{d} {d}:{d}", f"{d}.{d}.{year}", f"978-{d[0]}-{d}-{a}{b}-{d[1]}", _letters(rng, 1, 4) + a + b + c + _letters(rng, 1, 4), f"{_letters(rng, 2, 5)}-{a}-{b}-{c}-{d}{a}", a + b + c, f"{c}/{a}{d}/{c}{d}", f"${a} {b} {c}", f"{a}{_letters(rng, 1, 2)}{b}{c}", f"={a}{b}{c}{a}{_letters(rng, 2, 3)}")


def examples(text: str, plants: int = 8) -> list[tuple[int, float, bool, list[float]]]:
    """(kind, label, whether a plant, features) of a text's own spans and of plants set between its words; the text alone seeds them."""
    rng, out, base = np.random.default_rng(zlib.crc32(text.encode())), [], find_base(text)
    out += [(k, 1.0, False, features(k, text, s, e)) for k, s, e in base[:plants]]
    own = [(k, s, e) for k, s, e in propose(text) if not touches([x[1:] for x in base], s, e) and not valid(k, text[s:e])]
    out += [(k, 0.0, False, features(k, text, s, e)) for k, s, e in own[:plants]]
    for n in range(4 * plants):
        kind, right = n % 4, n // 4 % 2 == 0
        at = text.find(" ", int(rng.integers(0, len(text) + 1)))
        left, rest = text[max(0, at - 60) : max(at, 0)], text[max(at, 0) : max(at, 0) + 60]
        cue = rng.random() < (0.7 if kind == 3 and right else 0.4 if right else 0.15)
        left += (" " + CUES[KINDS[kind]][rng.integers(len(CUES[KINDS[kind]]))] + (":" if rng.random() < 0.5 else "") if cue else "") + " "
        span = plant(rng, kind, right)
        some = left + span + (rest if rest.startswith(" ") else " " + rest)
        low, high = len(left), len(left) + len(span)
        taken = [x[1:] for x in find_base(some)]
        for k, s, e in propose(some):
            if s < high and low < e and not touches(taken, s, e):
                out.append((k, float(right and k == kind and (s, e) == (low, high)), True, features(k, some, s, e)))
    return out


def text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


SPAN = "array<struct<kind:int,start:int,end:int>>"


def fit(docs: DataFrame, sample: int = 2_000, precision: float = 0.98, specificity: float = 0.999, least: int = 40) -> dict[int, tuple[BoostedTrees, float]]:
    """kind -> trees and threshold, from examples in at most `sample` texts of docs (doc_id, text); a kind with too few of either label has none."""
    some = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most `sample` ids

    def run(batches):
        names = ["kind", "label", "plant", "held", "x"]
        for ids, batch in text_batches(batches):
            rows = [(k, y, p, zlib.crc32(str(i).encode()) % 2 == 1, x) for i, b in zip(ids, batch) for k, y, p, x in examples(b.decode())]
            if rows:
                types = (pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    found = texts.select("doc_id", "text").mapInArrow(run, "kind int, label double, plant boolean, held boolean, x array<double>").toArrow()
    kinds, y, planted, held = (found.column(c).to_numpy() for c in ("kind", "label", "plant", "held"))
    x, models = np.array(found.column("x").to_pylist()), {}
    for kind in range(len(KINDS)):
        own, calm = kinds == kind, (kinds == kind) & held & ~planted & (y == 0)
        fitted, rest = own & ~held, own & held
        if min((y[part] == label).sum() for part in (fitted, rest) for label in (0, 1)) < least / 2:
            continue
        order = np.lexsort((*x[fitted].T, y[fitted]))  # whatever order rows come in
        trees = BoostedTrees().fit(x[fitted][order], y[fitted][order])
        p, truth = trees.probability(x[rest]), y[rest]
        rank = np.argsort(-p, kind="stable")
        right, wrong = np.cumsum(truth[rank]), np.cumsum(1 - truth[rank])
        quiet = np.sort(trees.probability(x[calm])) if calm.any() else np.zeros(1)
        fine = (right / (right + wrong) >= precision) & (p[rank] > quiet[int(np.ceil(specificity * len(quiet))) - 1]) & np.r_[p[rank][1:] < p[rank][:-1], True]
        if fine.any():
            models[kind] = (trees, max(0.5, float(p[rank][np.flatnonzero(fine)[-1]])))
    return models


def spans_of(text: str, models) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, accepted others): proposals over their kind's threshold, best margin first, none that touches a span taken before."""
    base, scored, more = find_base(text), [], []
    taken, proposed = [x[1:] for x in base], propose(text)
    for kind, (trees, least) in models.items():
        own = [x for x in proposed if x[0] == kind and not touches(taken, *x[1:])]
        if own:
            p = trees.probability(np.array([features(kind, text, s, e) for _, s, e in own]))
            scored += [((1 - q) / (1 - least + 1e-9), s - e, k, s, e) for q, (k, s, e) in zip(p.tolist(), own) if q >= least]
    for _, _, k, s, e in sorted(scored):
        if not touches(taken, s, e):
            more.append((k, s, e))
            taken.append((s, e))
    return base, more


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; spans: base and accepted proposals)."""
    docs = id_text(docs)
    models = fit(docs, **options)  # a few trees

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        named = lambda spans: [dict(zip(("kind", "start", "end"), x)) for x in spans]
        for ids, texts in text_batches(batches):
            found = [spans_of(b.decode(), models) for b in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array([named(base) for base, _ in found], type=span), pa.array([named(sorted(base + more)) for base, more in found], type=span)], names=["doc_id", "base", "spans"])

    return docs.mapInArrow(run, f"doc_id long, base {SPAN}, spans {SPAN}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans as text, n_added, n_spans (all)."""

    def run(batches):
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
        for batch in batches:
            bases, every = ([[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(c).to_pylist()] for c in ("base", "spans"))
            counts = [pa.array([sum(s[0] == k for s in row) for row in bases], type=pa.int64()) for k in range(len(KINDS))]
            sha = [hashlib.sha256(text_of(row).encode()).hexdigest() for row in bases]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(sha, type=pa.string()), pa.array([text_of(row) for row in every], type=pa.string()), pa.array([len(b) - len(a) for a, b in zip(bases, every)], type=pa.int64()), pa.array(list(map(len, every)), type=pa.int64())], names=names)

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long")


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of text replaced by [KIND], found in one pass, so texts are not shuffled. Null texts stay null."""
    bounded_batches(docs.sparkSession)
    models = fit(id_text(docs), **options)

    def clean(text):
        if not text:
            return text
        parts, at = [], 0
        for s, e, k in sorted((s, e, k) for spans in spans_of(text, models) for k, s, e in spans):
            if s >= at:
                parts += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join(parts) + text[at:]

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array([clean(t) for t in batch.column(k).to_pylist()], type=pa.string()))

    return docs.mapInArrow(run, docs.schema)
