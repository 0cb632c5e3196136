"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import ctw, decontaminate, lm_score, packing, pii, queries, rules, simhash, substring, token_counts, toxicity, warc
from textloom.llm.graph import components
from textloom.llm.packing import best_fit, solve

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long, part string, row int, n_words string, component_id long, spans string, n long"
PROSE = " ".join(f"word{i % 97}x{i * i % 89}" for i in range(300))
LONG = " ".join(f"tok{i * 7919 % 50021}" for i in range(60_000))


def row(doc_id, text):
    return (doc_id, text, None, None, None, "x", None, "y", 1, "z", None, "s", None)


ROWS = [row(1, PROSE), row(2, PROSE), row(2, PROSE), row(3, None), row(4, ""), row(None, PROSE), row(None, None), row(5, LONG), row(6, " \n\t "), row(7, "a" * 100_000), row(8, "short text"), row(9, "𝔘nicode ﬁ   é <|endoftext|> x <|startoftext|>")]
TEXTS = [r[1] or "" for r in ROWS]
VOCABULARY = {n: queries.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
BENCH = "item_id long, text string, doc_id long, score double"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


ALL = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY["word_bpe_49k.json"])
    got = token_counts.token_counts(docs, VOCABULARY["word_bpe_49k.json"], batch_bytes=4096).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(none, VOCABULARY["word_bpe_49k.json"]).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY["byte_bpe_50k.json"])
    got = packing.pack(docs, VOCABULARY["byte_bpe_50k.json"], capacity=64).collect()
    want = sum(len(tokenizer.encode(t, add_special_tokens=False)) + 1 for t in TEXTS)
    assert sum(r["length"] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 64 and [o for o, _ in sorted(b)] == [0, *np.cumsum([n for _, n in sorted(b)])[:-1]] for b in bins.values())
    assert packing.pack(none, VOCABULARY["byte_bpe_50k.json"]).count() == 0


def test_packing_of_very_long_white_space():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(VOCABULARY["byte_bpe_50k.json"]), packing.encoder(VOCABULARY["byte_bpe_50k.json"])
    for text in (" " * 1_000_001 + "x", "x" + " \n" * 300_000, "a <|endoftext|>" + " " * 150_000 + "b"):
        assert [i for part in packing.stretches(text) for i in encode(part).tolist()] == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts_refuse_a_file_that_is_not_word_wise():
    assert token_counts.word_wise(VOCABULARY["word_bpe_49k.json"])
    with pytest.raises(ValueError):
        token_counts.word_wise(VOCABULARY["byte_bpe_50k.json"])


def test_configuration_program_holds_every_piece():
    rng = np.random.default_rng(7)
    demand = np.bincount(np.clip(rng.lognormal(4.5, 1, 20_000).astype(int), 1, 1024), minlength=1025)
    bins = solve(demand, 1024)
    held = np.zeros(1025, dtype=int)
    for items, copies in bins:
        assert sum(k * v for k, v in items.items()) <= 1024 and copies > 0
        for k, v in items.items():
            held[k] += v * copies
    assert (held == demand).all()
    least = -(-int((demand * np.arange(1025)).sum()) // 1024)
    assert sum(c for _, c in bins) <= least + 2
    assert sum(c for _, c in best_fit(np.bincount([600, 600, 400, 424], minlength=1025), 1024)) == 2


def test_rules(docs, none):
    got = rules.ledger(docs)
    assert ids(got.collect()) == ALL
    assert rules.ledger(none).count() == 0
    clashing = docs.withColumns({"ledger": F.lit("x"), "n_lines": F.lit(None).cast("string"), "failed": F.lit(3)})
    kept = rules.keep(clashing)
    assert kept.schema == clashing.schema and {r["ledger"] for r in kept.collect()} == {"x"}
    kept = rules.keep(docs)
    assert kept.schema == docs.schema and ids(kept.collect()) == ids(got.where(~rules.rejects("v1")).collect())
    table = {r["rule"]: r for r in rules.ablation(got, "v1").collect()}
    failed = [r["failed"] for r in got.collect()]
    for k, (name, _) in enumerate(rules.RULES):
        assert table[name]["n_failed"] == sum(f >> k & 1 for f in failed) and table[name]["n_only"] == sum(f == 1 << k for f in failed)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert ids(got) == ALL
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[6] == 3
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 1 << 64, 40, dtype=np.uint64)]
    prints += [prints[0] ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(8) for b in range(8, 16) for c in range(16, 24)]
    prints += [prints[1] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a + 1, 64, 5)]
    signed = np.sort(np.array(list(set(prints)), dtype=np.uint64).view(np.int64))  # half of them negative
    nodes = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    a = signed.view(np.uint64)
    parent = list(range(len(a)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            x, y = sorted((find(i), find(int(j))))
            parent[y] = x
    want = {int(signed[i]): int(signed[find(i)]) for i in range(len(a)) if sum(find(k) == find(i) for k in range(len(a))) > 1}
    for bucket in (1, 8, 64):  # words one flip away, blocks, Golay keys
        assert {r["node"]: r["component"] for r in components(simhash.links(nodes, bucket)).collect()} == want


def test_golay_keys_meet_within_two_bits():
    tables, rng = simhash.golay_tables(), np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 20_000)
    for flips in (1, 2):
        w = v.copy()
        for k in range(flips):
            w ^= 1 << (rng.integers(0, 11, len(v)) + 11 * k)
        x, y = simhash.golay_keys(v, tables), simhash.golay_keys(w, tables)
        assert ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any((1, 2)).all()


def test_keep_one(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert got == [1, 3, 5, 7, 8, 9] or got == [1, 3, 5, 6, 7, 8, 9]  # white space alone may or may not equal an empty text
    assert kept.where("doc_id is null").count() == 2
    assert simhash.keep_one(none).count() == 0


def test_pii(docs, none, spark):
    assert ids(pii.digest(pii.personal_data(docs)).collect()) == ALL
    assert pii.digest(pii.personal_data(none)).count() == 0
    few = spark.createDataFrame([row(1, "mail a.b@c.example.org now +1 (743) 555-3824, 10.0.0.1 or 999.1.1.1 card 4111 1111 1111 1111"), row(2, None)], DOCS)
    got = {r["doc_id"]: r["text"] for r in pii.redact(few).collect()}
    assert got == {1: "mail [EMAIL] now [PHONE], [IP] or 999.1.1.1 card [CARD]", 2: None}
    for long in ("1" * 200_000 + "." + "2" * 200_000, "x" * 200_000, "1 " * 100_000, "a at " * 50_000, "a@" * 100_000, "1.1.1" * 50_000, "f:" * 100_000):
        base, more = pii.spans_of(long, {})
        assert more == [] and (base == [] or long.startswith("1"))


def test_boosted_trees_learn_what_a_line_cannot():
    from textloom.llm.boosting import BoostedTrees

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:3000], y[:3000])
    p = trees.probability(x[3000:])
    assert np.mean((p >= 0.5) == y[3000:]) > 0.97 and ((p > 0) & (p < 1)).all()
    assert abs(p.mean() - y[3000:].mean()) < 0.03  # probabilities, not just ranks
    same = BoostedTrees().fit(np.zeros((50, 2)), np.r_[np.ones(10), np.zeros(40)])
    assert same.probability(np.zeros((1, 2)))[0] == pytest.approx(0.2, abs=0.02)


def test_wide_forms_are_found_and_decoys_left(spark):
    """Held-out plants: whole spans found, decoys of like shape and clean texts left alone."""
    rng = np.random.default_rng(31)
    prose = lambda n: " ".join(pii._letters(rng, 2, 9) for _ in range(n))
    rows, truth = [], {}
    for i in range(1200):
        kind, right = i % 4, i // 4 % 2 == 0
        left, span = prose(20) + (f" {pii.CUES[pii.KINDS[kind]][0]}: " if right else " "), pii.plant(rng, kind, right)
        rows.append((i, left + span + " " + prose(15)))
        truth[i] = (f"{pii.KINDS[kind]}:{len(left)}:{len(left) + len(span)}", right)
    rows += [(i, prose(60)) for i in range(1200, 2000)]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for kind in pii.KINDS:
        mine = [i for i, (s, right) in truth.items() if right and s.startswith(kind)]
        assert np.mean([truth[i][0] in got[i]["spans"].split(",") for i in mine]) >= 0.8, kind
    added = [i for i, r in got.items() if r["n_added"]]
    assert np.mean([truth.get(i, ("", False))[1] for i in added]) >= 0.95
    assert not any(got[i]["n_spans"] for i in range(1200, 2000))


def test_best_of_overlapping_spans_is_taken():
    class Fixed:
        def __init__(self, p):
            self.p = p

        def probability(self, x):
            return np.full(len(x), self.p)

    text = "call 394-555-4006 or x (at) y (dot) com, mail a@b.org"
    base, more = pii.spans_of(text, {0: (Fixed(0.9), 0.5), 3: (Fixed(0.8), 0.5)})
    assert [text[s:e] for _, s, e in base] == ["a@b.org"]
    assert {(k, text[s:e]) for k, s, e in more} == {(0, "x (at) y (dot) com"), (3, "394-555-4006")}
    card = "4111/1111/1111/1111"  # a card and, within it, telephone numbers
    assert [(k, card[s:e]) for k, s, e in pii.spans_of(card, {2: (Fixed(0.99), 0.5), 3: (Fixed(0.6), 0.5)})[1]] == [(2, card)]
    assert pii.spans_of(card, {})[1] == []


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 1, "t"), (1, 1, 0, None), (None, 1, 1, None), (5, 0, 0, None), (8, None, None, None)], LABELS)
    for known in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, known).collect()
        assert ids(got) == ALL and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(none, labels).count() == 0


def test_segments_are_all_the_maximal_ones():
    rng = np.random.default_rng(5)

    def best_first(scores, at=0):
        """By definition: the best segment, then those on its left and on its right."""
        total = np.concatenate([[0.0], np.cumsum(scores)])
        spans = [(total[z] - total[a], a, z) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)]
        if not spans or max(spans)[0] <= 0:
            return []
        s, a, z = max(spans)
        return [*best_first(scores[:a], at), (at + a, at + z - 1, s), *best_first(scores[z:], at + z)]

    for _ in range(200):
        scores = rng.normal(-0.2, 1, rng.integers(0, 40))
        got, want = toxicity.segments(scores), best_first(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_log_odds_fall_back_on_beginnings():
    n1, n0 = 1000, 9000
    toxic, other = {}, {}
    for word, y1, y0 in ((b"abcdefgh", 40, 0), (b"abcdefij", 30, 1), (b"zzzzzz", 0, 300), (b"the", 100, 900)):
        for key in toxicity.terms(word):
            toxic[key], other[key] = toxic.get(key, 0) + y1, other.get(key, 0) + y0
    odds = toxicity.Scores(toxicity.log_odds(toxic, other, n1, n0))
    assert odds[b"abcdefgh"] > odds[b"abcdefij"] > 2 and odds[b"abcdefxyz"] > 2 and odds[b"abcdxy"] > 2  # unseen words score by what they begin with
    assert odds[b"zzzzzz"] < -2 and odds[b"never"] == 0 and abs(odds[b"the"]) < 0.01


def test_extreme_values_expect_few_segments_by_chance():
    """Of texts whose tokens are drawn by chance, about `significant` hold a passage."""
    rng, shares, scores = np.random.default_rng(6), np.array([0.9, 0.08, 0.02]), np.array([-1.0, 1.5, 3.0])
    lam = toxicity.karlin_lambda(scores, shares)
    assert (shares * np.exp(lam * scores)).sum() == pytest.approx(1)
    draw = lambda n: scores[rng.choice(3, n, p=shares)]
    best = np.array([max((s for *_, s in toxicity.segments(draw(400))), default=0) for _ in range(1000)])
    level = np.median(best)
    tail = toxicity.Tail(0.0, lam, float(-np.log(np.mean(best < level)) / (400 * np.exp(-lam * level))), significant=0.05)
    flagged = np.mean([bool(tail.features(toxicity.segments(draw(400)), 400)[1]) for _ in range(1000)])
    assert 0.005 < flagged < 0.15


def test_lm_score(docs, none):
    got = lm_score.score(docs, depth=3).collect()
    assert ids(got) == ALL and all(r["score"] < 0 for r in got)
    empty = {round(r["score"], 9) for r in got if r["doc_id"] in (3, 4)}
    assert len(empty) == 1
    assert lm_score.score(none).count() == 0


def test_ctw_is_a_distribution():
    texts = [PROSE.encode(), LONG.encode()[:20_000]]
    for least in (1, 2, 40):
        grams, counts = ctw.count(texts, [True, True], 4)
        model = ctw.whole_model(grams, counts, 4, least)
        contexts = np.unique(np.r_[grams[::50] >> 8, 123456789])
        every = np.sort(np.repeat(contexts << 8, 256) | np.tile(np.arange(256), len(contexts)))
        assert np.add.reduceat(10 ** model.scores(every), np.arange(0, len(every), 256)) == pytest.approx(np.ones(len(contexts)))
        scores = model.scores(grams)
        whole = ctw.score_texts(texts, grams, scores, 4)
        assert whole == pytest.approx([ctw.score_texts([t], grams, scores, 4)[0] for t in texts])


def brute_ctw(training, text, depth, least):
    """log10 probability of a text's bytes and end by CTW's recursion, node by node, on plain dictionaries."""
    import math

    counts = {}
    for t in training:
        t = bytes([ctw.START]) * depth + t.lower() + bytes([ctw.END])
        for i in range(depth, len(t)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts.setdefault((t[i - d : i], t[i] >> (8 - bit), bit), [0, 0])[t[i] >> (7 - bit) & 1] += 1
    children = {}
    for context, prefix, bit in counts:
        if context and sum(counts[context, prefix, bit]) >= least:
            children.setdefault((context[1:], prefix, bit), []).append((context, prefix, bit))
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    known = {}

    def weigh(node):
        """(log of the weighted probability, share of the node's own estimate, pooled counts of the rarer children)."""
        if node not in known:
            own, kept = counts.get(node, [0, 0]), children.get(node, [])
            rest = [own[k] - sum(counts[c][k] for c in kept) for k in (0, 1)]
            alone = log_kt(*own)
            if kept:
                split = sum(weigh(c)[0] for c in kept) + log_kt(*rest)
                both = max(alone, split) + math.log((math.exp(alone - max(alone, split)) + math.exp(split - max(alone, split))) / 2)
                known[node] = both, math.exp(alone - both) / 2, rest
            else:
                known[node] = alone, 1.0, rest
        return known[node]

    def one(context, prefix, bit, d):
        node = context[len(context) - d :], prefix, bit
        (zeros, ones), (_, own, rest) = counts.get(node, [0, 0]), weigh(node)
        deeper = context[len(context) - d - 1 :], prefix, bit
        if d < depth and deeper in children.get(node, []):
            below = one(context, prefix, bit, d + 1)
        else:
            below = (rest[1] + 0.5) / (sum(rest) + 1)
        return own * (ones + 0.5) / (zeros + ones + 1) + (1 - own) * below

    t, score = bytes([ctw.START]) * depth + text.lower() + bytes([ctw.END]), 0.0
    for i in range(depth, len(t)):
        for bit in range(8):
            p = one(t[i - depth : i], t[i] >> (8 - bit), bit, 0)
            score += math.log10(p if t[i] >> (7 - bit) & 1 else 1 - p)
    return score


def test_lm_score_is_that_of_ctw_by_brute_force(spark):
    texts = [PROSE[:400], "The cat sat on the mat. THE CAT sat on the hat.", "das ß und die Katze", "", "the mat sat on the cat " * 4, "zzz unseen", PROSE[200:500], "the hat", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    training = [(t or "").encode() for i, t in enumerate(texts) if lm_score.learned_from(i)]
    assert 3 < len(training) < len(texts)
    for least in (1, 3):
        for size in (50, 1 << 20):  # many batches, or one
            got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, depth=4, least=least, batch_bytes=size).collect()}
            assert got == pytest.approx({i: brute_ctw(training, (t or "").encode(), 4, least) for i, t in enumerate(texts)}, rel=1e-5)


def test_grams_of_cut_texts_are_those_of_whole_texts():
    texts = [LONG.encode()[:5000], b"", b"x"]
    whole = np.sort(np.concatenate([k for k, *_ in ctw.grams_of(texts, 3)]))
    cut = np.sort(np.concatenate([k for k, *_ in ctw.grams_of(texts, 3, limit=700)]))
    assert (whole == cut).all() and len(whole) == 5000 + 1 + 3


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(1, " ".join(PROSE.split()[40:80]), None, None), (2, None, None, None), (3, "", None, None), (None, "x", None, None), (4, "short text", 1, None), (4, "short text", 1, None)], BENCH)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (8, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, block_words=1).collect()} == got
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).where("doc_id is not null").collect()) == [3, 4, 5, 6, 7, 9]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_results_do_not_depend_on_how_the_index_is_cut(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    cut = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench, block_words=1500).collect())
    assert whole and [x[:2] + x[3:] for x in whole] == [x[:2] + x[3:] for x in cut] and [x[2] for x in whole] == pytest.approx([x[2] for x in cut])


def test_index_memory_follows_its_words():
    rng = np.random.default_rng(9)
    size = lambda n: sum(x.nbytes for x in vars(decontaminate.Index([(k, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 5))) for k in range(n)], 0.6)).values() if isinstance(x, np.ndarray))
    assert size(8000) < 9 * size(1000) and size(8000) < 8000 * 5 * 64


def test_passages_at_every_place_are_found():
    item = " ".join(f"i{k}" for k in range(30))
    index = decontaminate.Index([(7, item), (8, " ".join(f"j{k}" for k in range(37)))], 0.6)
    for before in range(0, 160, 7):
        for after in (0, 1, 50):
            words = [b"x"] * before + item.encode().split() + [b"y"] * after
            assert 7 in {index.items[k][0] for k, *_ in decontaminate.search(index, words)}, (before, after)


def test_wand_finds_what_exhaustive_scoring_finds():
    rng = np.random.default_rng(2)
    items = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 400)) for k in range(60)]
    index = decontaminate.Index(items, 0.6)
    for _ in range(100):
        terms = sorted({index.terms[w] for w in (f"w{x}".encode() for x in rng.zipf(1.3, 200) % 400) if w in index.terms})
        scores = np.zeros(len(index.items))
        for t in terms:
            scores[index.postings(t)[0]] += index.postings(t)[1]
        assert dict(index.wand(terms)) == pytest.approx({k: s for k, s in enumerate(scores) if s >= 1 - 1e-9})


def test_substring(docs, none, spark):
    got = {r["doc_id"]: r for r in substring.repeated_passages(docs).collect()}
    assert set(got) == {1, 2} and got[1]["class_id"] == got[2]["class_id"] == 1
    assert substring.repeated_passages(none).count() == 0
    w = LONG.split()
    near = w[1000:1100]
    near[50] = "changed"
    rows = [row(10, " ".join(w[:400])), row(11, " ".join(w[5000:5200] + w[100:160] + w[7000:7300])), row(12, " ".join(w[9000:9300])), row(13, " ".join(w[900:1300])), row(14, " ".join(w[20_000:20_100] + near + w[30_000:30_100]))]
    found = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(found) == {10, 11, 13, 14} and found[11]["spans"] == "200:260" and found[10]["spans"] == "100:160"


def brute_passages(texts, n=50):
    """Components of documents that share n words in a row, and the words inside such passages."""
    owners = {}
    for i, t in texts.items():
        w = t.lower().split()
        for k in range(len(w) - n + 1):
            owners.setdefault(tuple(w[k : k + n]), []).append((i, k))
    parent, covered = {i: i for i in texts}, {i: set() for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for found in owners.values():
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                covered[i] |= set(range(k, k + n))
                a, b = sorted((find(i), find(found[0][0])))
                parent[b] = a
    return {i: find(i) for i in texts if covered[i]}, covered


def words_of_spans(spans):
    return {k for x in spans.split(",") for k in range(*map(int, x.split(":")))}


def test_a_centre_without_the_passage_loses_no_link(spark):
    """Triples: the smallest document has just the two signature shingles of a passage that the others hold whole."""
    import xxhash

    rng, texts = np.random.default_rng(21), {}
    for k in range(60):
        passage = [f"p{x}" for x in rng.integers(0, 10**6, 50)]
        shingles, low = substring.shingle_hashes(substring.word_hashes(" ".join(passage).encode(), xxhash.xxh64_intdigest), 5), {}
        for h in range(3):  # the places of the minima of all hashes, with their partners
            p = int(np.argmin(substring.mix(shingles ^ np.uint64((h + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))))
            for side in (22, -22):
                if 0 <= p + side < 46:
                    low |= {q: passage[q] for a in (p, p + side) for q in range(a, a + 5)}
        noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
        texts[3 * k] = " ".join(noise(40) + [low.get(q, f"x{rng.integers(10**9)}") for q in range(50)] + noise(40))
        for i in (1, 2):
            texts[3 * k + i] = " ".join(noise(30 * i) + passage + noise(40))
    want, _ = brute_passages(texts)
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    lost = [i for i, c in want.items() if i not in got or any(want[j] == c and got.get(j, {"class_id": None})["class_id"] != got[i]["class_id"] for j in want)]
    assert len(want) == 120 and not lost


def test_a_common_line_hides_no_passage_and_spans_are_those_of_brute_force(spark):
    rng = np.random.default_rng(22)
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
    line, texts = [f"l{k}" for k in range(45)], {}
    for i in range(40):  # documents with just the line, some twice
        texts[i] = " ".join(noise(20) + line + noise(30) + (line if i % 5 == 0 else []) + noise(20))
    for i in range(40, 80, 2):  # pairs with the line and a tail, the second with another line before it
        both = line + noise(6 + i % 3) if i % 4 else noise(7) + line
        texts[i], texts[i + 1] = (" ".join(noise(25) + (line + noise(10) if j and i % 8 == 0 else []) + both + noise(25)) for j in (0, 1))
    want, covered = brute_passages(texts)
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want and len(want) >= 40
    for i, r in got.items():
        assert words_of_spans(r["spans"]) == covered[i] and r["n_words"] == len(covered[i]) and r["n_links"] >= 1


def brute_stretches(texts, passage=50, shingle=5):
    """Pairs of texts with a stretch of `passage` words on one diagonal, from an agreeing shingle to another, in which eight of nine agree."""
    grams, owners = {i: [tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] for i, w in ((i, t.split()) for i, t in texts.items())}, {}
    for i, g in grams.items():
        for k, x in enumerate(g):
            owners.setdefault(x, []).append((i, k))
    diagonals, links, least = {(i, j, a - b) for found in owners.values() for i, a in found for j, b in found if i < j}, set(), passage - shingle + 1
    for i, j, shift in diagonals:
        g, h, low = grams[i], grams[j], max(0, shift)
        same = np.array([g[k] == h[k - shift] for k in range(low, min(len(g), len(h) + shift))])
        total, at = np.r_[0, np.cumsum(np.where(same, 1, -8))], np.flatnonzero(same)
        long = at[None, :] - at[:, None] + 1 >= least
        if (long & (total[at + 1][None, :] - total[at][:, None] >= 0)).any():
            links.add((i, j))
    return links


def test_passages_with_changed_words_lose_no_link(spark):
    """Blocks of one to seven changed words at any place, where the centre of each signature is a text with just a line, and in large groups."""
    rng, texts = np.random.default_rng(23), {}
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
    lines = [noise(38) for _ in range(3)]
    for i in range(12):
        texts[i] = " ".join(noise(15) + lines[i % 3] + noise(15))
    for k in range(150):
        changed = k % 7 + 1
        need = max(8 * (changed + 4), 46 - changed - 4)
        r1 = int(rng.integers(max(1, need - 45), min(45, need - 1) + 1))
        r2 = min(45, max(1, need - r1 + k // 7 % 3 - 1))  # one too few, enough, one more
        one, two = noise(r1 + 4), noise(r2 + 4)
        if k % 3 == 0 and r1 >= 20:
            one[: min(38, r1)] = lines[k % 9 // 3][: min(38, r1)]
        elif k % 3 == 0:
            two[-min(38, r2) :] = lines[k % 9 // 3][-min(38, r2) :]
        for j in range(2):
            block = noise(changed)
            texts[100 + 2 * k + j] = " ".join(noise(int(rng.integers(0, 30))) + one + block + two + noise(int(rng.integers(0, 30))))
    template = noise(52)
    for k in range(60):  # one word changed, at places that differ: neighbours in place meet, others by them
        words = list(template)
        words[k % 48 + 2] = f"c{k}"
        texts[1000 + k] = " ".join(noise(3) + words + noise(3))
    links = brute_stretches(texts)
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {i: find(i) for pair in links for i in pair}
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want and len(links) > 80 and len(want) < len(texts) - 80
    found = substring.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    words = {i: t.split() for i, t in texts.items()}
    for r in found:
        a, b = (words[i][s : s + r["n_words"]] for i, s in ((r["doc_id"], r["start"]), (r["rep"], r["rep_start"])))
        same = [a[k : k + 5] == b[k : k + 5] for k in range(len(a) - 4)]
        assert len(a) == len(b) == r["n_words"] >= 50 and 9 * sum(same) >= 8 * len(same) and same[0] and same[-1] and r["rep"] < r["doc_id"]


def test_copies_and_like_surroundings_add_no_rows_to_steps(spark, monkeypatch):
    """Thirty copies of a text, and a class of thirty texts alike around the end of a line that other classes have: one of each stands for all."""
    rng, rows = np.random.default_rng(29), {}
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
    line, before, tail, copied = noise(30), noise(120), noise(120), noise(200)
    texts = {i: noise(20) + before + line + tail + noise(20) for i in range(30)}
    texts |= {i: copied for i in range(30, 60)} | {i: noise(70) + line + noise(70) for i in range(60, 63)}
    init = substring.Step.__init__

    def counted(self, df, name):
        init(self, df, name)
        rows[name] = rows.get(name, 0) + self.df.count()

    monkeypatch.setattr(substring.Step, "__init__", counted)
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {i: i // 30 * 30 for i in range(60)}
    assert all(got[i]["spans"] == "0:200" for i in range(30, 60)) and all(got[i]["spans"] == "20:290" for i in range(30))
    assert rows["runs"] <= 2 * 20 * 4  # places around the line, either way, for one of the class and for each of three others


def test_compact_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(4)
    for _ in range(50):
        g = np.concatenate([[0], rng.permutation(120) + 1, [0], rng.permutation(60) + 1, [0]]).astype(np.uint64)
        want = set()
        for p in np.flatnonzero(g):
            left, right = p - 1, p + 1
            while g[left] > g[p]:
                left -= 1
            while g[right] > g[p]:
                right += 1
            if right - left - 1 >= 20:
                want.add((int(p), int(left), int(right)))
        assert set(zip(*(x.tolist() for x in substring.compact_windows(g, 20)))) == want


def test_warc(spark):
    schema, big = "page_id long, url string, html string, digest string, part int, rep long", "<p>" + "é" * 2000
    rows = [(1, "u", big, None, 5, 9), (2, None, big, "x", None, None), (2, None, big, "x", None, None), (3, "v w\r\nX: y", None, None, None, None), (4, "", "", None, None, None), (None, None, big, None, None, None), (None, None, "s", None, None, None), (5, "z", "small", None, None, None), (6, "z", "small", None, None, None)]
    got = warc.round_trip(spark.createDataFrame(rows, schema), roll_bytes=200).collect()
    assert len(got) == len(rows)
    kinds = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got))
    assert kinds == [(0, "response", 0), (0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "response", 0)]
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").where("u is not null")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 260)}, 7: 7}


def test_pipeline_stages(spark, docs, none, tmp_path):
    d = str(tmp_path)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "x y z", None, None)], BENCH).write.parquet(f"{d}/benchmark.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    for some in (plain, plain.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, d)
            assert some.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).where("doc_id is not null").collect()} == {1, 5}


def edited(rng, words, low, high):
    """A copy of words with single words replaced until the Jaccard similarity of five-word shingles lies in [low, high)."""
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    copy, near = list(words), 1.0
    while near >= high:
        copy[rng.integers(len(copy))] = f"new{rng.integers(1 << 40)}"
        near = len(grams(copy) & grams(words)) / len(grams(copy) | grams(words))
    return copy if near >= low else edited(rng, words, low, high)


def test_keep_one_meets_near_copies_that_are_not_equal(spark):
    rng, rows = np.random.default_rng(11), []
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)):
        for _ in range(25):
            words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(200, 400))]
            rows += [(2 * len(rows), " ".join(words)), (2 * len(rows) + 1, " ".join(edited(rng, words, low, high)))]
    far = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows += [(10_000, " ".join(far)), (10_001, " ".join(edited(rng, far, 0.6, 0.75)))]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {r[0] for r in rows[:-2:2]} | {10_000, 10_001}


def test_keep_one_judges_texts_that_share_an_id_on_their_own(spark):
    rng = np.random.default_rng(13)
    base, rows = [f"w{x}" for x in rng.integers(0, 5000, 300)], [(0, "")]
    for i in range(40):  # each id has a near copy of one text and a text of its own
        rows += [(i, " ".join(edited(rng, base, 0.85, 0.95))), (i, " ".join(f"u{i}x{x}" for x in rng.integers(0, 10**6, 200)))]
    frame = spark.createDataFrame([(*r, 7, "a", None, 1, "b") for r in rows + rows[5:9]], "doc_id long, text string, h1 int, _h1 string, H2 long, textloom_id int, `a.b` string")
    kept = simhash.keep_one(frame)
    got = sorted(tuple(r) for r in kept.collect())
    assert kept.columns == frame.columns and all(r[2:] == (7, "a", None, 1, "b") for r in got)
    unique = {r for r in rows if r[1].startswith("u") or not r[1]}
    assert {r[:2] for r in got} >= unique and len(got) == len(unique) + 1  # and one of the near copies
    assert min(i for i, *_ in rows if i == [r for r in got if r[1].startswith("w") or r[1].startswith("new")][0][0]) == 0


def test_keep_one_tests_every_pair_of_a_large_bucket(spark):
    """Copies of one text, some similar only to another copy: components as by brute force over all pairs, whatever the bucket size."""
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    copies = [edited(rng, words, *((0.86, 0.93) if k % 3 else (0.6, 0.72))) for k in range(60)]
    copies += [edited(rng, copies[k], 0.8, 0.86) for k in range(0, 60, 3)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in copies]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(copies)], "doc_id long, text string")
    want = {k for k in range(len(sets)) if find(k) == k}
    assert 1 < len(want) < 40
    for bucket, block in ((1, 7), (8, 256)):
        assert {r["doc_id"] for r in simhash.keep_one(docs, bucket=bucket, block=block).collect()} == want


def test_item_of_one_sentence_is_found_by_its_shingles_only(spark):
    words = [f"q{k}" for k in range(24)]
    items = [(1, " ".join(words) + "."), (2, " ".join(f"a{k}" for k in range(20)) + "?\n" + " ".join(f"b{k}" for k in range(12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    scattered = " filler ".join(reversed(words))  # every word, no shingle
    bag = " ".join(f"a{k}" for k in range(20)) + " . " + " filler ".join(f"b{k}" for k in reversed(range(12)))  # the question, and the answer's words in another order
    whole = "before " + " ".join(words) + " after"
    docs = spark.createDataFrame([(1, scattered), (2, bag), (3, whole), (4, items[1][1])], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(3, 1), (4, 2)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {1, 2}
