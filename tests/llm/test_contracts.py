"""Whole queries at sf0.01 against plain brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from textloom.llm import queries

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def docs():
    d = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return {i: t or "" for i, t in zip(d["doc_id"], d["text"])}


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def test_packing(spark, docs):
    tokenizer, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows(spark, "op1_best_fit_packing")
    want = {}
    for i, t in docs.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, (a, z) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)])):
            want[i, k] = (a, z - a, zlib.crc32(np.array(ids[a:z], dtype="<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) + 3


def test_lm_score_base(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op3_lm_score")}
    split = {i: t.encode().lower().split() + [b""] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for i, ws in split.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)


def test_lm_score_beats_unigrams_on_held_out_texts(spark):
    got = [r for r in queries.QUERIES["op3_lm_score"](spark, "/root/testdata/sf0.1").where("held_out").collect()]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert np.mean([r["score"] > r["base_score"] for r in got]) > 0.9


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        yield "email", m.start(), m.end()
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            yield "phone", m.start(), m.end()


def test_pii_base(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op4_pii")}
    assert len(got) == len(docs)
    for i, t in docs.items():
        spans = list(base_spans(t))
        n = Counter(k for k, *_ in spans)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        r = got[i]
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_warc(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    got, most = {r["page_id"]: r for r in rows(spark, "op5_warc")}, {}
    for i, h in zip(pages["page_id"], pages["html"]):
        most[h] = max(most.get(h, i), i)
    assert len(got) == len(pages["page_id"])
    for i, h in zip(pages["page_id"], pages["html"]):
        b, response = (h or "").encode(), most[h] == i or len((h or "").encode()) < 1000
        assert got[i] == {"page_id": i, "payload_bytes": len(b), "payload_digest": hashlib.sha1(b).hexdigest(), "record_type": "response" if response else "revisit", "refers_to": None if response else most[h]}


def test_toxicity_held_out(spark):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    truth, got = dict(zip(labels["doc_id"], labels["toxic"])), {r["doc_id"]: r for r in rows(spark, "op6_toxicity")}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) >= 0.9


def test_toxicity_ranks_and_flags_held_out_texts(spark):
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels["toxic"]))
    got = [(r["score"], truth[r["doc_id"]]) for r in queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").collect() if r["doc_id"] in truth]
    toxic, calm = (np.array([s for s, y in got if y == k]) for k in (1, 0))
    auc = np.mean((toxic[:, None] > calm) + 0.5 * (toxic[:, None] == calm))
    assert auc >= 0.95 and np.mean(toxic >= 0.5) >= 0.9 and np.mean(calm < 0.5) >= 0.98


def test_quality_rules(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op7_quality_rules")}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams, covered = Counter(zip(words, words[1:], words[2:])), set()
        for k, g in enumerate(zip(words, words[1:], words[2:])):
            if grams[g] > 1:
                covered |= {k, k + 1, k + 2}
        want = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_token_counts(spark, docs):
    tokenizer, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r["doc_id"]: r for r in rows(spark, "op8_token_counts")}
    for i, t in docs.items():
        n = len(tokenizer.encode(t, add_special_tokens=False))
        assert got[i] == {"doc_id": i, "n_bytes": len(t.encode()), "n_tokens": n, "over_limit": n > 2048}


def brute_fingerprint(t):
    words = t.encode().lower().split()
    s = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = Counter(b for h in (xxhash.xxh64_intdigest(x, 42) for x in s) for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s))


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op9_simhash")}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, f = sorted(docs), np.array([prints[i] for i in sorted(docs)], dtype=np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(f ^ f[n]) <= 2):
            a, b = sorted((find(i), find(ids[m])))
            parent[b] = a
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in ids}


def test_decontamination(spark, docs):
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op10_decontamination")}
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want, all_docs = set(), {i: grams(words(t)) for i, t in docs.items()}
    for item, t in zip(bench["item_id"], bench["text"]):
        g = grams(words(t))
        want |= {(i, item) for i, d in all_docs.items() if len(g & d) >= 0.8 * len(g)}
    assert got >= want and want
    assert {i for i, _ in got} == {i for i, _ in want}


def test_repeated_passages(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op2_substring_dedup")}
    owners = {}
    for i, t in docs.items():
        w = t.lower().split()
        for k in range(len(w) - 49):
            owners.setdefault(" ".join(w[k : k + 50]), set()).add(i)
    want = {i for s in owners.values() if len(s) > 1 for i in s}
    assert set(got) >= want  # every exact passage; near ones may add documents
    for s in owners.values():
        assert len({got[i]["class_id"] for i in s if len(s) > 1}) <= 1
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, docs[i].lower().split()) for i in docs)}
    for i in set(got) - want:
        others = [len(shingles[i] & shingles[j]) for j in docs if j != i]
        assert max(others) >= 36


def test_pipeline_dedup_against_jaccard(spark, docs):
    """Every text that goes is a near copy of one that came before; every close pair keeps one of its two."""
    from textloom.llm import simhash

    kept = {r["doc_id"] for r in simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    close = {i: [j for j in docs if j != i and len(sets[i]) * 0.8 <= len(sets[j]) <= len(sets[i]) / 0.8 and alike(i, j)] for i in docs}
    assert all(close[i] for i in docs if i not in kept)
    assert all(i in kept or min(close[i]) < i or not close[i] for i in docs)
    pairs = [(i, j) for i in docs for j in close[i] if i < j]
    assert np.mean([not (i in kept and j in kept) for i, j in pairs]) >= 0.95


def test_pipeline_against_its_parts(spark, docs, tmp_path):
    """Rules and decontamination by brute force on what the stage before them kept."""
    import corpus_pipeline

    ran, some = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, some, SF).write.parquet(f"{tmp_path}/{k}")
        some = spark.read.parquet(f"{tmp_path}/{k}")
        ran.append({r["doc_id"]: r["text"] for r in some.collect()})
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    bench = [grams(words(t)) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    leaks = {i for i, t in ran[1].items() for g in bench if len(g & grams(words(t))) >= 0.8 * len(g)}
    assert set(ran[1]) - set(ran[2]) == leaks and leaks
    assert set(ran[2]) == set(ran[3]) and not any(list(base_spans(t)) for t in ran[3].values())
    for i, t in ran[0].items():
        assert len(t.split()) >= 50 and t == docs[i]
    packed = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, some, SF).collect()}
    assert packed == set(ran[3])
