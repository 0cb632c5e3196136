"""Benchmark decontamination (10): BM25 over an inverted index of test items, searched by block-max WAND.

Every text is cut into passages of twice the longest item's words, half overlapping, so each copy of an item lies whole in some
passage. A passage is a query against the items; it retrieves every item whose BM25 score is at least `threshold` of the score that
the item's own words give. Scores are divided by that bound, so one threshold (1) serves all items and WAND's upper bounds are sums
of per-term maxima. Postings and the maxima of blocks of `block` neighbouring items are flat arrays; the block maxima of all passages
of a text are summed at once, and only passages that can reach 1 in some block run WAND. What is retrieved is verified on the words:
five-word shingles of question and answer (the item's last sentence) found in the passage. An item without a question or an answer is
decided by all its shingles alone.

Document frequencies, the mean length and the longest item are those of all items. The index is built in parts of at most
`block_words` item words, each broadcast on its own (its memory follows the part's words): a larger test set takes more passes, not
more memory, and gives the same result. Items and texts without words, and null ids or texts, match nothing; repeated rows are
reported once each; texts of any length are searched whole; other columns stay out; empty tables match nothing.
"""
from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Step, bounded_batches, id_text, text_batches

#: ASCII letters and digits (A-Z lower-cased) and bytes of other scripts make words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(b: bytes) -> list[bytes]:
    return b.translate(WORDS).split()


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words."""
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)], dtype=np.uint64))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last line or, of a single line, its last sentence."""
    parts = [p for p in text.strip().split("\n") if p.strip()]
    if len(parts) < 2:
        parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return " ".join(parts[:-1]), parts[-1] if parts else ""


class Statistics:
    """Of all items: their number, mean length in words, the longest, and document frequencies of (at least) an index's words."""

    def __init__(self, lengths: list[int], frequencies: dict[bytes, int]):
        self.n, self.average, self.longest, self.frequencies = len(lengths), sum(lengths) / max(len(lengths), 1), max(lengths, default=0), frequencies

    @staticmethod
    def of(texts: list[str]) -> "Statistics":
        split = [w for w in (words_of((t or "").encode()) for t in texts) if w]
        found: dict[bytes, int] = {}
        for words in split:
            for w in set(words):
                found[w] = found.get(w, 0) + 1
        return Statistics(list(map(len, split)), found)


class Index:
    """Postings of items, weights being BM25 over threshold times the item's own score, and their maxima over blocks of items; all in flat arrays by term."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, statistics: Statistics | None = None, k1: float = 1.2, b: float = 0.75, block: int = 4, shingle: int = 5):
        known = statistics or Statistics.of([t for _, t in items])
        self.items, self.block, self.longest, self.terms = [], block, max(known.longest, 1), {}
        terms, owners, weights = [], [], []
        for item_id, text in items:
            if text and (words := words_of(text.encode())):
                parts = [words, *(words_of(t.encode()) for t in split_item(text))]
                self.items.append((item_id, [(n, shingles(w, n)) for w in parts for n in (min(shingle, len(w)),)]))
                times: dict[bytes, int] = {}
                for w in words:
                    times[w] = times.get(w, 0) + 1
                idf = np.array([np.log(1 + (known.n - known.frequencies[w] + 0.5) / (known.frequencies[w] + 0.5)) for w in times])
                n = np.fromiter(times.values(), dtype=float)
                score = idf * n * (k1 + 1) / (n + k1 * (1 - b + b * len(words) / known.average))
                terms += [self.terms.setdefault(w, len(self.terms)) for w in times]
                owners += [len(self.items) - 1] * len(times)
                weights.append(score / (threshold * score.sum()))
        terms, self.owners, self.weights = np.array(terms, dtype=np.int64), np.array(owners, dtype=np.int32), np.concatenate([np.zeros(0), *weights])
        order = np.argsort(terms, kind="stable")
        terms, self.owners, self.weights = terms[order], self.owners[order], self.weights[order]
        self.starts = np.searchsorted(terms, np.arange(len(self.terms) + 1))
        of_block = terms * (len(self.items) // block + 1) + self.owners // block
        first = np.flatnonzero(np.r_[True, of_block[1:] != of_block[:-1]]) if len(terms) else np.zeros(0, dtype=np.int64)
        self.blocks, self.maxima = (self.owners // block)[first], np.maximum.reduceat(self.weights, first) if len(first) else self.weights
        self.block_starts, self.n_blocks, self.lists = np.searchsorted(terms[first], np.arange(len(self.terms) + 1)), len(self.items) // block + 1, {}

    def postings(self, t: int) -> tuple[list[int], list[float], float]:
        """Items, weights and the greatest weight of a term, kept as lists for a while."""
        if t not in self.lists:
            if len(self.lists) > 20_000:
                self.lists.clear()
            a, z = self.starts[t : t + 2]
            self.lists[t] = self.owners[a:z].tolist(), self.weights[a:z].tolist(), float(self.weights[a:z].max())
        return self.lists[t]

    def bounds(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """(n, blocks) sums of the block maxima of terms by row."""
        a, size = self.block_starts[terms], self.block_starts[terms + 1] - self.block_starts[terms]
        at = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
        return np.bincount(np.repeat(rows, size) * self.n_blocks + self.blocks[at], weights=self.maxima[at], minlength=n * self.n_blocks).reshape(n, self.n_blocks)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items that reach 1, by document-at-a-time WAND with block maxima; terms are distinct."""
        own = np.array(terms, dtype=np.int64)
        alive = np.flatnonzero(self.bounds(np.zeros(len(own), dtype=np.int64), own, 1)[0] >= 1 - 1e-9).tolist()  # blocks with a bound that suffices
        lists, found, target = [[0, k, 0] for k in range(len(terms))] if alive else [], [], 0
        every = [self.postings(t) for t in terms] if alive else []
        while True:
            block = bisect_left(alive, target // self.block)
            if block == len(alive):
                return found
            target = max(target, alive[block] * self.block)
            for x in lists:
                ids = every[x[1]][0]
                if x[2] < len(ids) and ids[x[2]] < target:
                    x[2] = bisect_left(ids, target, x[2])
                x[0] = ids[x[2]] if x[2] < len(ids) else -1
            lists = sorted(x for x in lists if x[0] >= 0)
            bound, pivot = 0.0, None
            for first, k, _ in lists:
                bound += every[k][2]
                if bound >= 1 - 1e-9:
                    pivot = first
                    break
            if pivot is None:
                return found
            if pivot // self.block > alive[block]:
                target = pivot
                continue
            score = sum(every[k][1][at] for first, k, at in lists if first == pivot) if lists[0][0] == pivot else -1.0
            if score >= 1 - 1e-9:
                found.append((pivot, score))
            target = pivot + 1 if score >= 0 else pivot


def search(index: Index, words: list[bytes]) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end) of every passage and item that reach the threshold."""
    if not index.items:
        return []
    get, width, found = index.terms.get, 2 * index.longest, []
    codes = np.array([get(w, -1) for w in words], dtype=np.int64)
    at = np.flatnonzero(codes >= 0)
    halves = max(-(-len(words) // index.longest), 1)  # a passage is two halves
    pairs, n = np.unique(at // index.longest * len(index.terms) + codes[at], return_counts=True)[0], max(len(index.terms), 1)
    step = max((1 << 20) // index.n_blocks, 2)  # halves at once: bounds the sums
    for first in range(0, max(halves - 1, 1), step - 1):
        some = min(step, max(halves - first, 2))
        a, z = np.searchsorted(pairs, [first * n, (first + some) * n])
        sums = index.bounds(pairs[a:z] // n - first, pairs[a:z] % n, some)
        for k in np.flatnonzero((sums[:-1] + sums[1:] >= 1 - 1e-6).any(axis=1)):
            start = int(first + k) * index.longest
            if start >= len(words) or start and start + index.longest >= len(words):
                continue
            own = np.unique(codes[start : start + width])
            found += [(item, score, start, min(start + width, len(words))) for item, score in index.wand(own[own >= 0].tolist())]
    return found


def verify(index: Index, item: int, passage: list[bytes]) -> tuple[float, float, float]:
    """Shares of the item's, the question's and the answer's shingles found in a passage; 0 of an empty question or answer."""
    here, shares = {}, []
    for n, hashes in index.items[item][1]:
        if not n:
            shares.append(0.0)
            continue
        if n not in here:
            here[n] = shingles(passage, n)
        shares.append(float(np.isin(hashes, here[n]).mean()))
    return tuple(shares)


def parts(benchmark: DataFrame, block_words: int):
    """Lists of (item_id, text) of at most block_words words (one item at least), with the statistics of all items, read in order of id from bounded ranges."""

    def split(batches):
        for batch in batches:
            words = [words_of(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(list(map(len, words)), type=pa.int64()), pa.array([sorted(set(w)) for w in words], type=pa.list_(pa.binary()))], names=["row", "n", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = Step(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    words = Step(items.df.select("row", "text").mapInArrow(split, "row long, n long, words array<binary>").where("n > 0"), "item-words")
    n, total, longest = words.df.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    each = words.df.select("row", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("df"))
    known = each.join(counts, "word").groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("known"))  # an item's own words
    some, size, frequencies = [], 0, {}

    def part():
        out = Statistics([], frequencies)
        out.n, out.average, out.longest = n, total / n, longest
        return some, out

    for item_id, text, own, found in items.df.join(words.df.drop("words"), "row").join(known, "row").select("item_id", "text", "n", "known").orderBy("item_id", "text").toLocalIterator():
        if some and size + own > block_words:
            yield part()
            some, size, frequencies = [], 0, {}
        some.append((item_id, text))
        size += own
        frequencies.update((bytes(w), k) for w, k in found)
    if some:
        yield part()
    items.drop()
    words.drop()


def matches(index: Index, b: bytes, overlap: float, answer_overlap: float) -> dict[int, tuple]:
    """item -> (item overlap, score, question overlap, answer overlap, -first word) of the best verified passage."""
    words, best = words_of(b), {}
    for item, score, start, end in search(index, words):
        part = verify(index, item, words[start:end])
        if part[0] >= overlap or part[1] >= overlap and part[2] >= answer_overlap:
            best[item] = max(best.get(item, ()), (part[0], score, part[1], part[2], -start))
    return best


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, answer_overlap: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """The rows of docs, all columns, without a verified item; a pass for each block of items, no shuffle."""

    def passes(docs, index):
        def run(batches):
            own = cloudpickle.loads(index.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not (t and matches(own, t.encode(), overlap, answer_overlap)) for t in texts], type=pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    bounded_batches(docs.sparkSession)
    for items, statistics in parts(benchmark, block_words):
        docs = passes(docs, docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Index(items, threshold, statistics))))
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, answer_overlap: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """doc_id, item_id, score, item_overlap, question_overlap, answer_overlap, start_word: the best passage of each document and verified item."""
    docs = id_text(docs).where("doc_id is not null")
    schema = "doc_id long, item_id long, score double, item_overlap double, question_overlap double, answer_overlap double, start_word long"
    names = [c.split()[0] for c in schema.split(", ")]

    def passes(index):
        def run(batches):
            own = cloudpickle.loads(index.value)
            for ids, texts in text_batches(batches):
                rows = []
                for i, b in zip(ids, texts):
                    best = matches(own, b, overlap, answer_overlap)
                    rows += [(i, own.items[item][0], score, all_, question, answer, -start) for item, (all_, score, question, answer, start) in best.items()]
                if rows:
                    types = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        return docs.mapInArrow(run, schema)

    found = None
    for items, statistics in parts(benchmark, block_words):
        one = passes(docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Index(items, threshold, statistics))))
        found = one if found is None else found.union(one)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found
