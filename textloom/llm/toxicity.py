"""Toxicity (6): maximal scoring segments of token log-odds, calibrated by extreme values.

A bounded sample of labelled training rows (`sample`, the smallest by hash; equal texts count once) gives every token its log-odds
between toxic and other texts under a chain of Dirichlet priors: the prior of a word, of total mass `prior`, is what its first six
letters say, theirs is what the first four say, and theirs the share of all tokens. So unseen words score by their beginning, and
words without evidence about zero. Each token scores its log-odds less `drift`; nothing is cut by significance. The Ruzzo-Tompa scan
finds all maximal scoring segments of each whole text in linear time. Their scores follow Karlin-Altschul statistics: with lambda
solved from the token scores of other texts and K from the best segments found there, a segment's E-value counts how many as good one
expects by chance in a text as long; those below `significant` are toxic passages. A logistic curve over the best normalised score
and the mass of significant passages turns them into the probability of the label. K, the curve and the drift are fitted on the
sample by cross-fitting: each of `FOLDS` parts is scored with the log-odds of the others.

Labels, lang, source and ids never enter a score. Null and empty texts have no token and score like any text without a segment; texts
of any length are scanned whole; equal ids take the larger label, equal texts score alike, extra columns stay out; without labelled
rows of both kinds all texts get the share of label 1 (0.5 without labels) at most 0.499; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Step, fold, fold_col, id_text, text_batches

#: Tokens are runs of ASCII letters (A-Z lower-cased) and bytes of other scripts.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Letters of the beginnings that words fall back on, shortest first; 0: the whole word.
LEVELS = (4, 6, 0)
DRIFTS = (0.3, 1.0, 2.0, 3.0)
FOLDS = 4


def tokens(b: bytes) -> list[bytes]:
    return b.translate(LETTERS).split()


def terms(word: bytes) -> list[bytes]:
    """The word's key at each level."""
    text = word.decode("utf-8", "replace")
    return [bytes([n]) + (text[:n].encode() if n else word) for n in LEVELS]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last position, score) of a text's token scores, by Ruzzo and Tompa's scan over runs of positive scores."""
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, positive, False]))
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # first, end, total before it, total with it
    links: list[int] = []
    for first, end, low, high in zip(starts.tolist(), ends.tolist(), total[starts].tolist(), total[ends].tolist()):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = links[j]
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:], links[j:]
        stack.append((first, end, low, high))
        links.append(j)
    return [(a, z - 1, high - low) for a, z, low, high in stack]


def log_odds(toxic: dict[bytes, int], other: dict[bytes, int], n1: int, n0: int, prior: float = 20.0) -> dict[bytes, float]:
    """Key -> log-odds under the chain of priors; n1, n0: all tokens of either kind. Keys of words need the keys of their beginnings."""
    root = n1 / (n1 + n0)
    base, share, found = np.log(root / (1 - root)), {}, {}
    for level, above in zip(LEVELS, (None, *LEVELS)):
        for key in toxic.keys() | other.keys():
            if key[0] != level:
                continue
            y1, y0 = toxic.get(key, 0), other.get(key, 0)
            p = root if above is None else share.get(bytes([above]) + key[1:].decode("utf-8", "replace")[:above].encode(), root)
            share[key] = q = (y1 + prior * p) / (y1 + y0 + prior)
            found[key] = float(np.log(q / (1 - q)) - base)
    return found


class Scores(dict):
    """token -> log-odds by its longest known key; a bounded cache over the model's keys."""

    def __init__(self, odds: dict[bytes, float], most: int = 300_000):
        super().__init__()
        self.odds, self.most = odds, most

    def __missing__(self, word: bytes) -> float:
        score = next((self.odds[k] for k in reversed(terms(word)) if k in self.odds), 0.0)
        if len(self) >= self.most:
            self.clear()
        self[word] = score
        return score

    def of(self, b: bytes) -> np.ndarray:
        words = tokens(b)
        return np.fromiter(map(self.__getitem__, words), dtype=float, count=len(words))


def karlin_lambda(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(lambda * scores)) = 1."""
    scores, shares = scores[shares > 0], shares[shares > 0]
    moment = lambda x: (shares * np.exp(np.minimum(x * scores, 500))).sum()
    low, high = 0.0, 1.0
    while moment(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if moment(mid) < 1:
            low = mid
        else:
            high = mid
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


class Tail:
    """Extreme-value statistics of segments (lambda, K) and the curve to a probability, for one drift."""

    def __init__(self, drift: float, lam: float = 1.0, k: float = 1.0, significant: float = 0.05):
        self.drift, self.lam, self.k, self.significant, self.curve = drift, lam, k, significant, 0.0

    def surprise(self, score, n: int):
        """Minus the log of the E-value: how many segments as good a text of n tokens holds by chance."""
        return self.lam * score - float(np.log(self.k * n))

    def features(self, found: list[tuple[int, int, float]], n: int) -> tuple[list[float], list[tuple[int, int, float]]]:
        least, n = -np.log(self.significant), max(n, 1)
        good = [s for s in found if self.surprise(s[2], n) >= least]
        normal = min(max(self.surprise(max(s[2] for s in found), n), -10.0), 50.0) if found else -10.0
        mass = sum(min(self.surprise(s[2], n), 50.0) for s in good)
        return [1.0, normal / 10, max(normal - least, 0.0) / 10, np.log1p(mass), float(bool(good))], good

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not isinstance(self.curve, np.ndarray):
            return np.full(len(x), self.curve)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, prior: float = 20.0, least: int = 3, share: float = 2.0**-18, significant: float = 0.05) -> tuple[dict[bytes, float], Tail]:
    """(log-odds of keys, Tail) of docs (doc_id, text) from at most `sample` labelled rows outside fold 0.

    Keys seen less than `least` times, or by less than `share` of the sample's tokens, fall back on shorter ones, which bounds the model.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold_col(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(known), "doc_id")  # at most `sample` rows of 12 bytes
    rows = rows.groupBy(F.xxhash64("text").alias("h"), F.col("toxic")).agg(F.first("text").alias("text"))  # equal texts count once
    step = Step(rows.select("text", "toxic", F.pmod(F.xxhash64("h"), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    rows = step.df

    cells = [(y, f) for y in (0, 1) for f in range(FOLDS)]

    def count(batches):
        from collections import Counter

        names = ["key", "toxic", "fold", "n"]
        for batch in batches:
            total = {c: Counter() for c in cells}
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                total[int(toxic > 0), fold].update(tokens(text.encode()))
            for (y, fold), words in total.items():
                keys: Counter = Counter()
                for w, n in words.items():
                    for key in terms(w):
                        keys[key] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(keys), type=pa.binary()), pa.array([y] * len(keys), type=pa.int32()), pa.array([fold] * len(keys), type=pa.int32()), pa.array(list(keys.values()), type=pa.int64())], names=names)

    counts = rows.mapInArrow(count, "key binary, toxic int, fold int, n long").groupBy("key").agg(*(F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{y}{f}") for y, f in cells))
    counts = Step(counts, "toxicity-counts")
    of_words = counts.df.where(F.substring("key", 1, 1) == F.lit(bytes([0])))
    n = {c: int(x or 0) for c, x in zip(cells, of_words.agg(*(F.sum(f"n{y}{f}") for y, f in cells)).first())}
    n0, n1 = (sum(n[y, f] for f in range(FOLDS)) for y in (0, 1))
    if not n0 or not n1:
        y, tail = known.agg(F.avg("toxic")).first()[0], Tail(DRIFTS[0], significant=significant)
        tail.curve = min(0.499, 0.5 if y is None else float(y))
        return {}, tail
    seen = sum((F.col(f"n{y}{f}") for y, f in cells), F.lit(0))
    kept = counts.df.where(seen >= max(least, share * (n0 + n1))).toArrow()  # 1 / share keys of a level at most
    keys = kept.column("key").to_pylist()
    column = {c: kept.column(f"n{c[0]}{c[1]}").to_numpy() for c in cells}

    def odds_of(folds):
        toxic, other = (sum(column[y, f] for f in folds) for y in (1, 0))
        return log_odds(dict(zip(keys, toxic.tolist())), dict(zip(keys, other.tolist())), *(sum(n[y, f] for f in folds) for y in (1, 0)), prior)

    odds, other = odds_of(range(FOLDS)), dict(zip(keys, sum(column[0, f] for f in range(FOLDS)).tolist()))
    rest = [[f for f in range(FOLDS) if f != out] for out in range(FOLDS)]
    parts = [odds_of(r) if all(sum(n[y, f] for f in r) for y in (0, 1)) else odds for r in rest]
    spark = docs.sparkSession
    cross = spark.sparkContext.broadcast(parts)
    lone = [k for k in keys if k[0] == 0]
    s0, w0 = np.array([odds[k] for k in lone]), np.array([other[k] for k in lone], dtype=float)
    s0, w0 = np.r_[s0, 0.0], np.r_[w0, max(n0 - w0.sum(), 1.0)]
    tails = []
    for drift in DRIFTS:
        tails.append(Tail(drift, karlin_lambda(s0 - drift, w0 / w0.sum()), significant=significant))
    raw = rows.mapInArrow(_best(cross, DRIFTS), "toxic int, n long, best array<double>").toArrow()
    calm, length, best = raw.column("toxic").to_numpy() == 0, raw.column("n").to_numpy(), np.array(raw.column("best").to_pylist()).reshape(-1, len(DRIFTS))
    for k, tail in enumerate(tails):
        # Gumbel location by the share of other texts whose best segment stays below the median positive one
        own = best[calm, k]
        level = float(np.median(own[own > 0])) if (own > 0).any() else 1.0
        below = np.clip(np.mean(own < level), 1e-3, 1 - 1e-3)
        tail.k = float(-np.log(below) / (np.mean(np.maximum(length[calm], 1)) * np.exp(-tail.lam * level)))
    few = rows.mapInArrow(_features(cross, tails), "toxic int, x array<array<double>>").toArrow()
    y = (few.column("toxic").to_numpy() > 0).astype(float)
    x = np.array(few.column("x").to_pylist()).reshape(len(y), len(tails), -1)
    losses = []
    for k, tail in enumerate(tails):
        tail.curve = logistic(x[:, k], y)
        p = np.clip(tail.probability(x[:, k]), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    cross.unpersist()
    step.drop()
    counts.drop()
    return odds, tails[int(np.argmin(losses))]


def _best(cross, drifts):
    def run(batches):
        scores = [Scores(odds) for odds in cross.value]
        for batch in batches:
            some = [scores[h].of(t.encode()) for t, h in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            best = [[max((s[2] for s in segments(x - d)), default=0.0) for d in drifts] for x in some]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(map(len, some)), type=pa.int64()), pa.array(best, type=pa.list_(pa.float64()))], names=["toxic", "n", "best"])

    return run


def _features(cross, tails):
    def run(batches):
        scores = [Scores(odds) for odds in cross.value]
        for batch in batches:
            some = [scores[h].of(t.encode()) for t, h in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            x = [[list(map(float, tail.features(segments(s - tail.drift), len(s))[0])) for tail in tails] for s in some]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, type=pa.list_(pa.list_(pa.float64())))], names=["toxic", "x"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages ("first:last:score" in tokens, joined) of whole texts."""
    docs = id_text(docs)
    odds, tail = fit(docs, labels, **options)
    model = docs.sparkSession.sparkContext.broadcast(odds)

    def run(batches):
        scores = Scores(model.value)
        for ids, texts in text_batches(batches):
            some = [scores.of(b) for b in texts]
            found = [tail.features(segments(s - tail.drift), len(s)) for s in some]
            score = np.clip(tail.probability(np.array([x for x, _ in found])), 0, 1)
            spans = [",".join(f"{a}:{z}:{s:.3f}" for a, z, s in good) for _, good in found]
            columns = [pa.array(ids, type=pa.int64()), pa.array([fold(i) == 0 for i in ids]), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(g) for _, g in found], type=pa.int64()), pa.array(spans, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, passages string")
