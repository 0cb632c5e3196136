"""Best-fit packing (1): a configuration linear program over the histogram of piece lengths.

1. encode: one pass over the texts gives pieces of at most `capacity` ids and their crc32; ids themselves are not kept.
2. histogram: at most `capacity` counts go to the driver, whatever the number of documents.
3. solve: multiplicative weights set prices of lengths; a bounded knapsack by dynamic programming prices the best configuration of
   each round; the fractional uses are rounded down.
4. residual: what rounding leaves (at most about one bin per configuration, plus what configurations lack) is packed best-fit
   decreasing on counts.
5. place: each piece's rank within its length, by partition offsets, names its slot in the plan. The plan has one entry per
   configuration and item, so its size follows the number of configurations, not of documents.

Null texts are empty (one end id); a null id stays null; repeated rows and equal texts are packed once each; texts of any length are
encoded whole, long ones in stretches; other columns stay out; an empty table gives no rows.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Step, id_text, per_worker, text_batches, tokenizer_of

#: Fixed: Unicode White_Space, at which byte-level pre-tokenizers cut.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed: the pre-tokenization pattern of byte-level BPE.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: str):
    """text -> numpy ids, as the tokenizers library gives for a byte-level BPE file without normalizer (special strings become their ids).

    Ids of such files follow the order of merges, so they serve as ranks of a faster encoder of the same vocabulary; a file whose
    ids don't is encoded by the library itself.
    """
    import json

    spec = json.load(open(vocabulary))
    vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"] or merged != sorted(merged):
        tokenizer = tokenizer_of(vocabulary)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import tiktoken

    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    own, tokenizer, long = tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special), tokenizer_of(vocabulary), re.compile(f"[{WHITE}]{{100000}}")

    def ids(text):
        if len(text) >= 100_000 and long.search(text):  # the faster encoder's pattern can't step back over such a run
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return own.encode_to_numpy(text, allowed_special="all").astype("<u4")

    return ids


def stretches(text: str, limit: int = 1 << 18):
    """Parts of a long text, cut before white space that follows something else: there the pre-tokenizer always cuts too."""
    cut, start = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])"), 0
    while len(text) - start > limit and (m := cut.search(text, start + limit)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, batch_bytes: int = 2 << 20) -> DataFrame:
    """PIECES: ids of whole texts and the end id, in pieces of `capacity`; only the first piece of a longer one may be shorter."""

    def cut(batches):
        encode = per_worker(f"ids {vocabulary}", lambda: encoder(vocabulary))
        end, width = np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for ids, texts in text_batches(batches, batch_bytes):
            rows = [[], [], [], [], []]
            for i, t in zip(ids, texts):
                b = b"".join(encode(part).tobytes() for part in stretches(t.decode())) + end
                first = len(b) % width or width
                for k, (a, z) in enumerate(zip([0, *range(first, len(b), width)], [*range(first, len(b), width), len(b)])):
                    for column, value in zip(rows, (i, k, a // 4, (z - a) // 4, zlib.crc32(b[a:z]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema)], schema=schema)

    return id_text(docs).mapInArrow(cut, PIECES)


def price(value: np.ndarray, demand: np.ndarray, capacity: int) -> Counter:
    """The configuration (length -> copies, at most `demand` and `capacity` in all) of greatest value. Multiplicities are split in powers of two."""
    best, taken = np.zeros(capacity + 1), []
    for length in np.nonzero((demand > 0) & (value > 0))[0]:
        left, copies = int(min(demand[length], capacity // length)), 1
        while left > 0:
            copies = min(copies, left)
            size, gain = int(length) * copies, value[length] * copies
            other = np.concatenate([np.full(size, -np.inf), best[: capacity + 1 - size] + gain])
            better = other > best + 1e-15
            taken.append((int(length), copies, size, better))
            best = np.where(better, other, best)
            left, copies = left - copies, copies * 2
    room, found = int(best.argmax()), Counter()
    for length, copies, size, better in reversed(taken):
        if better[room]:
            found[length] += copies
            room -= size
    return found


def solve(demand: np.ndarray, capacity: int, rounds: int = 300, power: float = 1.1, rate: float = 0.2) -> list[tuple[Counter, int]]:
    """Bins as (configuration, copies) that hold exactly `demand[length]` pieces of each length.

    Multiplicative weights: a length's price is its size to a power over 1 (large pieces are harder to place) times exp(-rate * share
    of its demand covered). Each round the knapsack prices the open demand and the best configuration is used 1 / rounds of the
    total, or as often as its scarcest length allows. Once no configuration is nearly full, the fractional uses are rounded down and
    the rest, at most what floors leave and what never filled a bin, is packed best-fit decreasing.
    """
    left = demand.astype(np.int64).copy()
    bins: list[tuple[Counter, int]] = []
    if left[capacity]:
        bins.append((Counter({capacity: 1}), int(left[capacity])))
        left[capacity] = 0
    sizes = np.arange(capacity + 1)
    target, covered, uses = left.astype(float), np.zeros(capacity + 1), Counter()
    base, width = (sizes / capacity) ** power, (left * sizes).sum() / capacity / rounds
    for _ in range(4 * rounds):
        open_ = np.floor(target - covered + 1e-9)
        found = price(base * np.exp(-rate * covered / np.maximum(target, 1)), open_, capacity)
        if not found or sum(k * v for k, v in found.items()) < 0.995 * capacity:
            break
        times = max(1.0, min(width, *((target[k] - covered[k]) / v for k, v in found.items())))
        uses[tuple(sorted(found.items()))] += times
        for k, v in found.items():
            covered[k] += times * v
    for items, x in sorted(uses.items(), key=lambda u: -u[1]):
        copies = int(min(np.floor(x + 1e-9), *(left[k] // v for k, v in items)))
        if copies > 0:
            bins.append((Counter(dict(items)), copies))
            for k, v in items:
                left[k] -= copies * v
    return bins + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on counts: open bins with equal room are one entry, so work follows distinct rooms and lengths."""
    rooms: dict[int, Counter] = {}  # room -> contents -> copies
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        while n:
            if fits := [r for r in rooms if r >= length]:
                room = min(fits)
                contents, copies = next(iter(rooms[room].items()))
                each = room // length
                if n >= each:
                    use, put = min(copies, n // each), each
                else:
                    use, put = 1, n
                rooms[room][contents] -= use
                if not rooms[room][contents]:
                    del rooms[room][contents]
                if not rooms[room]:
                    del rooms[room]
                rooms.setdefault(room - put * length, Counter())[(*contents, (length, put))] += use
                n -= use * put
            else:
                each = capacity // length
                use, put = (n // each, each) if n >= each else (1, n)
                rooms.setdefault(capacity - put * length, Counter())[((length, put),)] += use
                n -= use * put
    return [(Counter(dict(c)), k) for room in rooms.values() for c, k in room.items()]


def slots(bins: list[tuple[Counter, int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, sequence of that rank, offset) of each run of ranks; successive ranks of a run go to successive sequences."""
    plan: dict[int, list] = {}
    nth, sequence = Counter(), 0
    for items, copies in bins:
        offset = 0
        for length in sorted(items, reverse=True):
            for _ in range(items[length]):
                plan.setdefault(length, []).append((nth[length], sequence, offset))
                nth[length] += copies
                offset += length
        sequence += copies
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in plan.items()}


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """PIECES with sequence_id and offset: the fewest sequences of at most `capacity` ids that the rounded program finds."""
    spark = docs.sparkSession
    step = Step(pieces(docs, vocabulary, end_id, capacity).withColumn("part", F.spark_partition_id()), "pieces")
    counts = step.df.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = Step(counts, "lengths")
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.df.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        demand[length] = n
    plan = spark.sparkContext.broadcast(slots(solve(demand, capacity), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task at most
    offsets = counts.df.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    offsets = offsets.select("part", "length", "base")

    def place(key, batch):
        length = batch.column("length").to_numpy()
        base, order = batch.column("base").to_numpy(), np.argsort(length, kind="stable")
        runs = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True])
        sequence, offset = np.empty_like(length), np.empty_like(length)
        for a, z in zip(runs[:-1], runs[1:]):
            of, n = order[a:z], int(length[order[a]])
            rank = base[of[0]] + np.arange(z - a)
            first, start, at = plan.value[n]
            k = np.searchsorted(first, rank, side="right") - 1
            sequence[of], offset[of] = start[k] + rank - first[k], at[k]
        return batch.drop_columns(["part", "base"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    placed = step.df.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "part", "base")
    result = Step(placed.groupBy("part").applyInArrow(place, PIECES + ", sequence_id long, offset long"), "packed")
    step.drop()
    counts.drop()
    return result.df
