"""Substring dedup (2): compact windows over min-hashed word shingles.

Each text is its sequence of five-word shingles. For each of `hashes` hash functions the Cartesian tree of the hashed sequence groups
all subsequences that share a minimum: node p with nearest smaller neighbours L and R stands for every subsequence in (L, R) that
holds p, the compact window of p. Only windows of `passage` words or more are kept (about 2 in `passage` positions). A window's
signatures are its minimum together with the shingle half a passage to its right, and to its left: a common passage of full length
holds one of the two beside the minimum, while short common lines, however frequent, do not.

Windows with a signature seen in two documents meet the window of the smallest document that has it (a star, never all pairs), the
intervals are intersected on their common diagonal, and the words of both are compared: maximal stretches of at least `passage` words
in which eight of nine aligned shingles agree (similarity 0.8) are verified.

A star's centre may have the signature without the passage that its other members share. So the members of every signature with a
document that its centre did not verify, at all their places, are grouped once more, by each whole passage of the window: documents
with an equal one meet the smallest of them. Thus two documents that share `passage` words exactly are always linked, at a cost
that follows the length of their windows and never the pairs of a group.

Passages with changed words that no centre verified are found by the same means. Every stretch in which eight of nine shingles agree,
from an agreeing shingle to another, has either a whole passage or one block of changed words with enough agreeing shingles on its
two sides (`blocks`), nearly half of these in one run. Texts of different classes with such a run, and unlike words after it, are keyed by
the words around the block, at each division of the shingles between the sides: documents with an equal key are linked whatever the
block holds, so the smallest of them stands for all, and no pair is left to chance. This is complete for passages of at most ten
shingle lengths, as by default; of longer ones those with several blocks may be lost. Documents linked by passages form classes.

Null and short texts, null ids and repeats inside one document give no link; equal ids count as one document (the smallest text);
equal texts are one class; texts of any length are taken whole; other columns stay out; empty tables give no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Step, id_text, partitions, per_worker, text_batches
from .graph import components

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed multipliers of the SplitMix64 finaliser


ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed: 2^64 over the golden ratio
BACK = np.uint64(pow(int(ODD), -1, 1 << 64))
HIGH = np.uint64(0xFFFFFFFF << 32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Digests(dict):
    """Hashes of words as eight bytes; short words are remembered, 2^19 at a time."""

    def __init__(self, xxh64):
        super().__init__()
        self.xxh64 = xxh64

    def __missing__(self, word: bytes) -> bytes:
        digest = self.xxh64(word).to_bytes(8, "little")
        if len(word) <= 64:
            if len(self) >> 19:
                self.clear()
            self[word] = digest
        return digest


def word_hashes(b: bytes, xxh64) -> np.ndarray:
    return np.frombuffer(b"".join(map(per_worker("word-digests", lambda: Digests(xxh64)).__getitem__, b.lower().split())), dtype="<u8")


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    n = len(words) - shingle + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(shingle):
        h = h * ODD + words[k : n + k]
    return mix(h)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, by differences of one sum: as long as the text, however long the runs."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    total, back = prefixes(words)
    return mix((total[size:] - total[:-size]) * back[: len(words) - size + 1])


def prefixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words times powers of ODD before each place, and the powers' inverses: (total[b] - total[a]) * back[a] is the same wherever the words stand."""
    power, back = (np.cumprod(np.r_[np.ones(1, dtype=np.uint64), np.full(len(words), x)], dtype=np.uint64) for x in (ODD, BACK))
    return np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)], back


def compact_windows(g: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, L, R): minima of g whose nearest smaller positions are L < p < R with R - L > least; a zero at each end and between texts bounds them."""
    if least > len(g):
        return (np.zeros(0, dtype=np.int64),) * 3
    window, width = g, 1
    while width < least:  # window[i] = min(g[i : i + width])
        step = min(width, least - width)
        window, width = np.minimum(window[:-step], window[step:]), width + step
    best = np.zeros(len(g) + least - 1, dtype=np.uint64)  # the greatest minimum of the windows that hold each position
    best[least - 1 : len(g)] = window
    width = 1
    while width < least:
        step = min(width, least - width)
        best, width = np.maximum(best[:-step], best[step:]), width + step
    # the nearest smaller positions of a wide window have wide windows themselves, or are borders
    place = np.flatnonzero(best == g)
    few = g[place]
    minima = [few]  # minima[j][i] = min(few[i : i + 2**j])
    while 2 ** len(minima) <= len(few):
        last, half = minima[-1], 2 ** (len(minima) - 1)
        longer = np.minimum(last[:-half], last[half:])
        if not longer.any():
            break
        minima.append(longer)
    p = np.flatnonzero(few)
    right, left, own = p + 1, p - 1, few[p]
    for j in range(len(minima) - 1, -1, -1):
        size, low = 2**j, minima[j]
        ok = (right + size <= len(few)) & (low[np.minimum(right, len(low) - 1)] >= own)
        right = np.where(ok, right + size, right)
        ok = (left - size + 1 >= 0) & (low[np.clip(left - size + 1, 0, len(low) - 1)] >= own)
        left = np.where(ok, left - size, left)
    p, left, right = place[p], place[left], place[right]
    wide = right - left > least
    return p[wide], left[wide], right[wide]


def signatures(h: np.ndarray, passage: int, shingle: int, hashes: int):
    """(key, whole, p, L, R, side) arrays for each hash and side: the compact windows of shingle hashes h (zero: a border) whose partner, side away from the minimum, lies inside; whole differs from key by 32 bits of all shingles from one to the other."""
    least, half = passage - shingle + 1, (passage - shingle) // 2
    total = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(h, dtype=np.uint64)]
    for k in range(hashes):
        seed = np.uint64((k + 1) * int(ODD) & (1 << 64) - 1)
        g = np.maximum(mix(h ^ seed), np.uint64(1))
        g[h == 0] = 0
        p, left, right = compact_windows(g, least)
        for side, ok in ((half, p + half < right), (-half, p - half > left)):
            at = p[ok]
            key, low = mix(g[at] + (seed if side > 0 else ~seed)) ^ h[at + side], np.minimum(at, at + side)
            yield key, key ^ (mix(total[low + half + 1] - total[low]) & HIGH), at, left[ok], right[ok], side


ROW = (("key", "<i8"), ("doc_id", "<i8"), ("run", "<i4"), ("pos", "<i4"), ("before", "<i4"), ("after", "<i4"), ("size", "<i4"))
HELD = 1 << 20  # rows of a bucket that are looked at together


def packed_windows(docs: DataFrame, kinds: list[tuple[int, int]], shingle: int, buckets: int) -> DataFrame:
    """(bucket, n, rows): signatures of compact windows for each kind (size: words of a passage, hashes), at the first place in each document, n rows of ROW by columns.

    pos is the minimum's word, before and after the shingles around it, run the 32 bits of `whole`. Of all but the greatest size the key is
    `whole`. Most signatures occur once: they are dealt out by bucket, not by row.
    """
    least, greatest = min(size for size, _ in kinds) - shingle + 1, max(size for size, _ in kinds)

    def run(batches):
        import xxhash

        for ids, texts in text_batches(batches, 2 << 20):
            lengths, parts = [], [np.zeros(1, dtype=np.uint64)]
            for i, b in zip(ids, texts):
                s = shingle_hashes(word_hashes(b, xxhash.xxh64_intdigest), shingle)
                if len(s) >= least:
                    lengths.append((i, len(s)))
                    parts += [s, np.zeros(1, dtype=np.uint64)]
            if not lengths:
                continue
            start = np.cumsum([1] + [n + 1 for _, n in lengths])[:-1]
            owners, out = np.array([i for i, _ in lengths], dtype=np.int64), []
            joined = np.concatenate(parts)
            place = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(joined)]))
            for size, hashes in kinds:
                for key, whole, at, left, right, _ in signatures(joined, size, shingle, hashes):
                    doc, high = place[at - 1], ((key ^ whole) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    out.append((key if size == greatest else whole, owners[doc], high, at - start[doc], at - left - 1, right - at - 1, np.full(len(at), size)))
            columns = [np.concatenate(c) for c in zip(*out)]
            order = np.lexsort((columns[1], columns[0]))  # stable: places of a signature in a text keep their order
            columns = [c[order] for c in columns]
            once = np.r_[True, np.any([c[1:] != c[:-1] for c in (columns[0], columns[1], columns[2], columns[6])], axis=0)][: len(order)]
            columns = [c[once] for c in columns]
            bucket = ((columns[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else np.zeros(1, dtype=np.int64)
            columns = [c.astype(kind, copy=False) for c, (_, kind) in zip([columns[0].view(np.int64), *columns[1:]], ROW)]
            rows = [b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], type=pa.int32()), pa.array(np.diff(cut), type=pa.int32()), pa.array(rows, type=pa.binary())], names=["bucket", "n", "rows"])

    return docs.mapInArrow(run, "bucket int, n int, rows binary")


def met_windows(docs: DataFrame, kinds: list[tuple[int, int]], shingle: int) -> DataFrame:
    """The columns of ROW: windows whose signature two documents have, few of all."""
    n = partitions(docs.sparkSession)
    packed = packed_windows(docs, kinds, shingle, 8 * n).repartition(n, "bucket").sortWithinPartitions("bucket")

    def shared(held, told):
        """Rows of keys that two documents have, without those told before; what is kept for the bucket's next rows: of such keys one row."""
        order = np.argsort(held[0], kind="stable")
        held, told = [c[order] for c in held], told[order]
        first = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
        several = np.minimum.reduceat(held[1], first) != np.maximum.reduceat(held[1], first)
        group = np.repeat(several, np.diff(np.r_[first, len(told)]))
        out, keep = group & ~told, ~group
        keep[first] = True
        return [c[out] for c in held], [c[keep] for c in held], group[keep]

    def run(batches):
        now, held, told, rows = None, None, None, []

        def flush():
            parts = [[np.concatenate(c) for c in zip(*rows)]] + ([held] if held else [])
            return shared([np.concatenate(c) for c in zip(*parts)], np.r_[np.zeros(len(parts[0][0]), dtype=bool), told if held else np.zeros(0, dtype=bool)])

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[name for name, _ in ROW])

        size = 0
        for batch in batches:
            for bucket, n, blob in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("rows")):
                if rows and (bucket != now or size >= HELD):
                    out, held, told = flush()
                    rows, size = [], 0
                    yield batch_of(out)
                if bucket != now:
                    now, held, told = bucket, None, None
                blob, at, columns = blob.as_buffer(), 0, []
                for _, kind in ROW:
                    columns.append(np.frombuffer(blob, kind, n, at))
                    at += n * np.dtype(kind).itemsize
                rows.append(columns)
                size += n
        if rows:
            yield batch_of(flush()[0])

    return packed.mapInArrow(run, "key long, doc_id long, run int, pos int, before int, after int, size int")


def stretches(same: np.ndarray, least: int, penalty: int = 8) -> list[tuple[int, int]]:
    """Disjoint stretches (start, end) of `least` or more whose share of true values is at least penalty / (penalty + 1), best first within each part."""
    found, parts = [], [(0, len(same))]
    while parts:
        a, z = parts.pop()
        if z - a < least:
            continue
        total = np.concatenate([[0], np.cumsum(np.where(same[a:z], 1, -penalty))])
        low = np.minimum.accumulate(total)
        end = int((total - low).argmax())
        start = int(total[: end + 1].argmin()) if end else 0
        if end - start < least:
            if end > start and total[end] > total[start]:
                parts += [(a, a + start), (a + end, z)]
            continue
        found.append((a + start, a + end))
        parts += [(a, a + start), (a + end, z)]
    return sorted(found)


def around_blocks(same: np.ndarray, least: int, penalty: int = 8) -> list[tuple[int, int]]:
    """Every block of false values, with the runs of true ones on its two sides, that makes `least` or more with a share of at least penalty / (penalty + 1); runs of `least` by themselves."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    agree, spoiled = (end - start)[:-1] + (end - start)[1:], start[1:] - end[:-1]
    ok = (agree >= penalty * spoiled) & (agree + spoiled >= least)
    long = end - start >= least
    return [*zip(start[:-1][ok].tolist(), end[1:][ok].tolist()), *zip(start[long].tolist(), end[long].tolist())]


GRID = 64  # words; intervals to cut out are widened to it, so that a document's are few however many ask


def each_text(docs: DataFrame, asks: DataFrame, work, schema: str) -> DataFrame:
    """What work(hashed words, asks) yields, columns after doc_id and any others of asks, for each document of asks (doc_id, ..., asks: an array); each text is read once.

    A document's asks are distinct intervals of its own grid, or its own signatures: few however many documents they come from.
    """
    def run(batches):
        import xxhash

        held, size = [], 0
        for batch in batches:
            for text, wanted, *own in zip(*(batch.column(c) for c in ("text", "asks", *kept))):
                for columns in work(word_hashes(text.as_py().encode(), xxhash.xxh64_intdigest), wanted.values):
                    held.append([*(pa.array(np.full(len(columns[0]), x.as_py())) for x in own), *map(pa.array, columns)])
                    size += sum(c.nbytes for c in held[-1])
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)

    kept = [c for c in asks.columns if c != "asks"]
    names = [*kept, *(c.split()[0] for c in schema.split(", "))]
    return docs.join(asks, "doc_id").select("text", "asks", *kept).mapInArrow(run, ", ".join([*(f"{c} long" for c in kept), schema]))


def verified(docs: DataFrame, pairs: DataFrame, least: int, shingle: int, parts=stretches) -> DataFrame:
    """PASSAGES of pairs (doc_id, rep, shift, start, end) of shingle intervals on one diagonal."""
    n = shingle - 1
    low, high = (lambda c: F.floor(c / GRID).cast("int") * GRID), (lambda c: F.ceil((c + n) / GRID).cast("int") * GRID)
    mine, other = (F.col("start"), F.col("end")), (F.col("start") - F.col("shift"), F.col("end") - F.col("shift"))
    asks = pairs.select("doc_id", low(mine[0]).alias("start"), high(mine[1]).alias("end")).union(pairs.select("rep", low(other[0]), high(other[1])))

    def words(hashed, wanted):
        few, size, some = (hashed >> np.uint64(32)).astype("<u4"), 0, []
        wanted = list(zip(*(c.to_pylist() for c in wanted.flatten())))
        for k, (s, e) in enumerate(wanted):
            some.append((s, e, few[s:e].tobytes()))
            size += 4 * (e - s)
            if size > 2 << 20 or k == len(wanted) - 1:
                yield [pa.array(c, type=t) for c, t in zip(zip(*some), (pa.int32(), pa.int32(), pa.binary()))]
                size, some = 0, []

    asks = asks.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("asks"))
    cut = Step(each_text(docs, asks, words, "start int, end int, words binary"), "passage-words")
    side = lambda name, at: cut.df.select(F.col("doc_id").alias(name), F.col("start").alias(f"{at}_low"), F.col("end").alias(f"{at}_high"), F.col("words").alias(at))
    both = pairs.select("doc_id", "rep", "shift", "start", "end", low(mine[0]).alias("a_low"), high(mine[1]).alias("a_high"), low(other[0]).alias("b_low"), high(other[1]).alias("b_high"))
    both = both.join(side("doc_id", "a"), ["doc_id", "a_low", "a_high"]).join(side("rep", "b"), ["rep", "b_low", "b_high"])

    def verify(batches):
        for batch in batches:
            rows = []
            for doc, rep, shift, start, end, a_low, b_low, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rep", "shift", "start", "end", "a_low", "b_low")), batch.column("a"), batch.column("b")):
                a, b = np.frombuffer(a.as_buffer(), "<u4")[start - a_low : end + n - a_low], np.frombuffer(b.as_buffer(), "<u4")[start - shift - b_low : end + n - shift - b_low]
                m = min(len(a), len(b))
                equal = np.concatenate([[0], np.cumsum(a[:m] == b[:m])])
                same = equal[shingle:] - equal[:-shingle] == shingle
                for s, e in parts(same, least):
                    share = same[s:e].mean()
                    rows.append((doc, rep, start + s, start + s - shift, e - s + n, share / (2 - share)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("start", pa.int32()), ("rep_start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())])
    found = Step(both.mapInArrow(verify, PASSAGES), "passages")
    cut.drop()
    return found


PASSAGES = "doc_id long, rep long, start int, rep_start int, n_words int, similarity double"


def places(hashed: np.ndarray, wanted, passage: int, shingle: int, hashes: int) -> np.ndarray:
    """Starts of all whole passages inside the windows, at all places, whose signatures (`whole`) are wanted."""
    least, border, wanted, starts = passage - shingle + 1, np.zeros(1, dtype=np.uint64), np.sort(wanted.to_numpy()), []
    for _, key, at, left, right, side in signatures(np.r_[border, shingle_hashes(hashed, shingle), border], passage, shingle, hashes):
        own = wanted[np.minimum(np.searchsorted(wanted, key.view(np.int64)), len(wanted) - 1)] == key.view(np.int64)
        at, left, right = at[own], left[own], right[own]
        # a passage holds the minimum and its partner and stays in the window
        low, high = np.maximum(left + 1, np.maximum(at, at + side) - (least - 1)), np.minimum(np.minimum(at, at + side), right - least)
        some = low[:, None] + np.arange(least)
        starts.append(np.unique(some[some <= high[:, None]]) - 1)
    return np.unique(np.concatenate(starts))


def equal_passages(docs: DataFrame, members: DataFrame, passage: int, shingle: int, hashes: int) -> DataFrame:
    """PASSAGES of equal whole passages inside the windows of members (key, doc_id), at all places; each document meets the smallest that has its passage."""
    asks = members.groupBy("doc_id").agg(F.collect_set("key").alias("asks"))

    def whole(hashed, wanted):
        at = places(hashed, wanted, passage, shingle, hashes)
        if len(at):
            yield [at.astype(np.int32), *(run_hashes(w, passage)[at].view(np.int64) for w in (hashed, mix(hashed)))]

    found = Step(each_text(docs, asks, whole, "start int, h1 long, h2 long"), "whole-passages")
    reps = found.df.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("rep"), F.max("doc_id").alias("last")).where("last <> rep.doc_id")
    reps = Step(reps.select("h1", "h2", "rep"), "passage-centres")
    met = found.df.join(reps.df, ["h1", "h2"]).where("doc_id <> rep.doc_id").select("doc_id", F.col("rep.doc_id").alias("rep"), "start", (F.col("start") - F.col("rep.start")).alias("shift"))
    diagonal = Window.partitionBy("doc_id", "rep", "shift")  # a document's own places
    runs = met.withColumn("run", F.col("start") - F.row_number().over(diagonal.orderBy("start"))).groupBy("doc_id", "rep", "shift", "run").agg(F.min("start").alias("start"), F.max("start").alias("end"))
    runs = Step(runs.selectExpr("doc_id", "rep", "start", "start - shift as rep_start", f"end - start + {passage} as n_words", "1.0D as similarity"), "equal-passages")
    found.drop()
    reps.drop()
    return runs


def blocks(least: int, shingle: int, penalty: int = 8) -> list[tuple[int, int]]:
    """(words, need): lengths of a block of changed words and the agreeing shingles needed on its two sides, fewer than `least` on each.

    A block of w words spoils m = w + shingle - 1 shingles, so penalty * m must agree, and least - m to be long enough. Of a stretch with
    several blocks and runs r0, r1, ... between them, some block has more than penalty * m beside it: if none had, the sum over all
    blocks would leave nothing for the inner runs.
    """
    spoiled = range(shingle, 2 * (least - 1) // penalty + 1)
    return [(m - shingle + 1, max(penalty * m, least - m)) for m in spoiled]


def owners(members: DataFrame, classes: DataFrame) -> Step:
    """The members (key, doc_id, ...) of signatures that documents of different classes (node, component) have, with their component."""
    owned = Step(members.join(classes, F.col("doc_id") == F.col("node"), "left").select(*members.columns, F.coalesce("component", "doc_id").alias("component")), "run-owners")
    live = owned.df.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    kept = Step(owned.df.join(live, "key"), "run-members")
    owned.drop()
    return kept


def run_pairs(members: DataFrame, least: int, shingle: int) -> DataFrame:
    """(doc_id, rep, shift, start, end): documents beside the centre of a run's signature, of another class, with room for a block and a run on both sides.

    A star that joins most classes of a large group at the cost of its members; what it leaves open is keyed by `changed_passages`.
    """
    room = least + blocks(least, shingle)[-1][0] + shingle
    centres = members.groupBy("key").agg(F.min(F.struct("doc_id", "pos", "before", "after", "component")).alias("rep"))
    stars = members.join(centres, "key").where("component <> rep.component").withColumn("shift", F.col("pos") - F.col("rep.pos")).select(
        "doc_id", F.col("rep.doc_id").alias("rep"), "shift",
        F.greatest(F.col("pos") - F.least("before", "rep.before") - room, "shift", F.lit(0)).alias("start"), (F.col("pos") + F.least("after", "rep.after") + 1 + room).alias("end"),
    )
    # intervals apart on one diagonal stay apart: texts are long
    apart = Window.partitionBy("doc_id", "rep", "shift").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a document's own
    stars = stars.distinct().withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(apart), F.lit(-1))).cast("int"))
    stars = stars.withColumn("part", F.sum("new").over(apart.rowsBetween(Window.unboundedPreceding, 0)))
    return stars.groupBy("doc_id", "rep", "shift", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def changed_passages(docs: DataFrame, members: Step, passage: int, shingle: int) -> DataFrame:
    """PASSAGES around a block of changed words, between documents of different classes; members (key, doc_id, component): signatures of runs. Drops members."""
    n, least, kinds = shingle - 1, passage - shingle + 1, blocks(passage - shingle + 1, shingle)
    run, side, widest = run_words(passage, shingle), least - 1 + shingle - 1, kinds[-1][0]
    differ = lambda c: F.min(c) != F.max(c)
    asks = members.df.groupBy("doc_id", "component").agg(F.collect_set("key").alias("asks"))

    def sides(hashed, at):
        """(reverse, start, key, hash, neighbour) of the runs at `at`: with the word after each, then with the word before it."""
        h, around = run_hashes(hashed, run)[at], np.r_[np.zeros(1, dtype=np.uint64), hashed, np.zeros(1, dtype=np.uint64)]
        for reverse, next_ in ((False, around[at + run + 1]), (True, around[at])):
            yield reverse, mix(h * ODD + mix(next_) + np.uint64(reverse)).view(np.int64), h.view(np.int64), next_.view(np.int64)

    def runs(hashed, wanted):
        at = places(hashed, wanted, run, shingle, 1)
        if not len(at):
            return
        total, back = prefixes(mix(hashed))
        for reverse, key, h, next_ in sides(hashed, at):
            begin = at if reverse else at + run  # the run's end beside the change
            low, high = (widest + side, side) if reverse else (side, widest + side)
            around = mix((total[np.minimum(begin + high, len(hashed))] - total[np.maximum(begin - low, 0)]) * back[begin])
            first = np.unique(mix(key.view(np.uint64)) + around, return_index=True)[1]
            column = len(hashed) - begin if reverse else begin
            yield np.full(len(first), reverse), key[first], h[first], next_[first], around[first].view(np.int64), column[first].astype(np.int32)

    # of a class, one text stands for all with the same words around a run's end
    found = each_text(docs, asks, runs, "reverse boolean, key long, h long, next long, around long, at int")
    found = found.groupBy("component", "reverse", "key", "h", "next", "around").agg(F.min(F.struct("doc_id", "at")).alias("one"))
    found = Step(found.select("component", "reverse", "key", "h", "next", "one.*"), "runs")
    # a run matters if another class has it beside another word: of the distinct classes and words, those with the own class or word are not all
    seen, by = found.df.select("reverse", "h", "component", "next", "key").distinct(), lambda *c: F.count("*").over(Window.partitionBy("h", "reverse", *c))
    ends = seen.where("next <> 0").select("component", "key", (by() - by("component") - by("next") + 1).alias("others")).where("others > 0")
    ends = found.df.join(ends.select("component", "key"), ["component", "key"]).groupBy("doc_id", "component").agg(F.collect_set(F.struct("reverse", "at", F.array(F.lit(0)).alias("some"))).alias("asks"))

    def contexts(hashed, wanted):
        """(reverse, columns, length, their places in wanted, words): words before a change, whose block begins at column `side`, and after it (zero: none); a change before its run is read backwards."""
        few = np.maximum(hashed >> np.uint64(32), np.uint64(1)).astype("<u4")
        backwards, column = (c.to_numpy(zero_copy_only=False) for c in wanted.flatten()[:2])
        for reverse, text in ((False, few), (True, few[::-1])):
            own = np.flatnonzero(backwards == reverse)
            for k in range(0, len(own), 4096):
                part = own[k : k + 4096]
                cut = column[part][:, None] + np.arange(-side, widest + side)
                yield reverse, column[part], len(text), part, np.where((cut >= 0) & (cut < len(text)), text[np.clip(cut, 0, len(text) - 1)], np.uint32(0))

    def keys(words, reverse, at, length, divisions, chosen):
        """(division, rows, low and high key, words of the block's ends, start, end, change) for each division (part, within, words of the block, shingles of the run before it, shingles after it) of the rows that have chosen its `within`."""
        words = words.astype(np.uint64)
        total = [np.concatenate([np.zeros((len(words), 1), dtype=np.uint64), np.cumsum(mix(words + ODD * (np.arange(words.shape[1], dtype=np.uint64) + np.uint64(c))), axis=1, dtype=np.uint64)], axis=1) for c in (1, 1000)]
        for part, within, w, r1, r2 in divisions:
            low, high = side - r1 - n, side + w + r2 + n
            ok = np.flatnonzero(chosen[within] & (at >= r1 + n) & (at + w + r2 + n <= length))
            if len(ok):
                seed = np.where(reverse[ok], np.uint64((w << 20 | r1) + (1 << 40)), np.uint64(w << 20 | r1))
                h = [mix(mix(t[ok, side] - t[ok, low]) * ODD + mix(t[ok, high] - t[ok, side + w]) + seed).view(np.int64) for t in total]
                start = np.where(reverse[ok], length[ok] - at[ok] - (w + r2 + n), at[ok] - r1 - n)
                change = np.where(reverse[ok], length[ok] - at[ok] - w, at[ok])
                first, last = words[ok, side].view(np.int64), words[ok, side + w - 1].view(np.int64)
                yield ok, *h, np.full(len(ok), w, dtype=np.int32), np.full(len(ok), part, dtype=np.int32), first, last, *(c.astype(np.int32) for c in (start, start + (r1 + n + w + r2 + n), change))

    def keyed(rows: DataFrame, divisions: list[tuple[int, int, int, int, int]]) -> DataFrame:
        """The rows with their key for each division whose `within` is one of `some`."""

        def work(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                doc, component, reverse, at, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component", "reverse", "at", "length"))
                words = np.frombuffer(b"".join(batch.column("words").to_pylist()), "<u4").reshape(batch.num_rows, -1)
                some = [frozenset(x) for x in batch.column("some").to_pylist()]
                chosen = {within: np.array([within in x for x in some]) for within in {d[1] for d in divisions}}
                for ok, *columns in keys(words, reverse, at, length, divisions, chosen):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[ok], component[ok], reverse[ok], at[ok], *columns)], names=names)

        schema = "doc_id long, component long, reverse boolean, at int, h1 long, h2 long, w int, part int, first long, last long, start int, end int, change int"
        names = [c.split()[0] for c in schema.split(", ")]
        return rows.mapInArrow(work, schema)

    def shared(rows, *by):
        """Keys that unlike blocks of different classes have."""
        some = rows.groupBy(*by).agg(differ("component").alias("live"), (differ("first") & differ("last")).alias("unlike"), *([F.min(F.struct("doc_id", "start", "change")).alias("rep")] if "start" in rows.columns else []))
        return some.where("live and unlike").drop("live", "unlike")

    def parts_of(once: Step, *by) -> DataFrame:
        return once.df.join(shared(once.df, *by), [*by]).groupBy("doc_id", "component", "reverse", "at").agg(F.collect_set("part").alias("some"))

    # first what each block needs at least in its run and beyond it, then what few divisions need at least, then each division
    least_of, few, every = [], [], []
    for w, need in kinds:
        low, high = (need + 1) // 2, min(need, least) - 1
        least_of.append((w, 0, w, low, max(1, need - high)))
        for r in range(low, high + 1, DIVISIONS):
            part, last = w << 10 | r, min(high, r + DIVISIONS - 1)
            few.append((part, w, w, r, need - last))
            every += [(part, part, w, x, need - x) for x in range(r, last + 1)]

    def changes(hashed, wanted):
        some = wanted.flatten()[2]
        for reverse, at, length, part, words in contexts(hashed, wanted):
            yield np.full(len(at), reverse), at, np.full(len(at), length, dtype=np.int32), some.take(pa.array(part)), pa.array([r.tobytes() for r in words], type=pa.binary())

    contexts_of = lambda asks: each_text(docs, asks, changes, "reverse boolean, at int, length int, some array<int>, words binary")
    once = Step(keyed(contexts_of(ends), least_of).select("h1", "doc_id", "component", "reverse", "at", "part", "first", "last"), "block-bounds")
    found.drop()
    members.drop()
    asks = parts_of(once, "h1").groupBy("doc_id", "component").agg(F.collect_list(F.struct("reverse", "at", "some")).alias("asks"))
    around = Step(contexts_of(asks), "changes")
    once.drop()
    once = Step(keyed(around.df, few).select("h1", "h2", "doc_id", "component", "reverse", "at", "part", "first", "last"), "division-bounds")
    some = Step(around.df.drop("some").join(parts_of(once, "h1", "h2").drop("component"), ["doc_id", "reverse", "at"]), "some-changes")
    once.drop()
    around.drop()
    split = Step(keyed(some.df, every), "block-keys")
    some.drop()
    reps = Step(shared(split.df, "h1", "h2"), "block-centres")
    met = split.df.join(reps.df, ["h1", "h2"]).where("doc_id <> rep.doc_id").withColumn("shift", F.col("start") - F.col("rep.start"))
    met = met.groupBy("doc_id", F.col("rep.doc_id").alias("rep"), "shift", "change", "w").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    share = 1 - (F.col("w") + n) / (F.col("end") - F.col("start") - n)
    linked = Step(met.select("doc_id", "rep", "start", (F.col("start") - F.col("shift")).alias("rep_start"), (F.col("end") - F.col("start")).alias("n_words"), (share / (2 - share)).alias("similarity")), "changed-passages")
    split.drop()
    reps.drop()
    return linked


DIVISIONS = 4  # of a block, tried as one before each by itself


def run_words(passage: int, shingle: int) -> int:
    """Words that agree in a row on one side of a block of changed words at least; 0 if whole passages hold every stretch."""
    needs = [need for _, need in blocks(passage - shingle + 1, shingle)]
    return (min(needs) + 1) // 2 + shingle - 1 if needs else 0


def distinct_texts(docs: DataFrame, passage: int) -> tuple[DataFrame, DataFrame, Step]:
    """Texts by distinct ids; of equal texts the one with the smallest id; the others' PASSAGES, whole texts of `passage` words or more."""
    name = lambda df: Step(df.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")), "names")
    docs = docs.where("doc_id is not null")
    names = name(docs)
    if not names.df.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        names.drop()
        docs = Step(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "smallest-texts").df
        names = name(docs)
    reps = Step(names.df.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("h1", "h2", "rep"), "copied")
    copies = Step(names.df.join(reps.df, ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")

    def count(hashed, _):
        if len(hashed) >= passage:
            yield [np.array([len(hashed)], dtype=np.int32)]

    sizes = Step(each_text(docs, reps.df.select(F.col("rep").alias("doc_id"), F.array(F.lit(0)).alias("asks")), count, "n_words int"), "copied-words")
    same = Step(copies.df.join(sizes.df.withColumnRenamed("doc_id", "rep"), "rep").selectExpr("doc_id", "rep", "0 as start", "0 as rep_start", "n_words", "1.0D as similarity"), "copied-passages")
    for step in (names, reps, sizes):
        step.drop()
    return docs, docs.join(copies.df.select("doc_id"), "doc_id", "left_anti"), same


def passages(docs: DataFrame, passage: int = 50, shingle: int = 5, hashes: int = 3) -> DataFrame:
    """(doc_id, rep, start, rep_start, n_words, similarity): verified passages that doc_id shares with a smaller document rep; offsets in words. Of equal texts the smallest document stands for all, which meet it alone."""
    least, run = passage - shingle + 1, run_words(passage, shingle)
    docs, distinct, same = distinct_texts(id_text(docs), passage)
    found = Step(met_windows(distinct, [(passage, hashes), (run, 1)] if run else [(passage, hashes)], shingle), "met-windows")
    met, short = found.df.where(F.col("size") == passage), found.df.where(F.col("size") == run)
    whole = F.col("key").bitwiseXOR(F.shiftleft(F.col("run").cast("long"), 32)).alias("whole")
    centres = Step(met.groupBy("key").agg(F.min(F.struct("doc_id", "pos", "before", "after")).alias("rep")), "centres")
    stars = met.join(centres.df, "key").where("doc_id <> rep.doc_id").select(
        whole, "doc_id", F.col("rep.doc_id").alias("rep"), "pos", (F.col("pos") - F.col("rep.pos")).alias("shift"),
        (F.col("pos") - F.least("before", "rep.before")).alias("start"), (F.col("pos") + F.least("after", "rep.after") + 1).alias("end"),
    )
    pairs = Step(stars.where(F.col("end") - F.col("start") >= least).groupBy("doc_id", "rep", "shift").agg(F.min("start").alias("start"), F.max("end").alias("end")), "passage-pairs")
    near = verified(docs, pairs.df, least, shingle)
    pairs.drop()
    right = near.df.select("doc_id", "rep", (F.col("start") - F.col("rep_start")).alias("shift"), F.col("start").alias("low"), (F.col("start") + F.col("n_words")).alias("high"))
    each = stars.select("whole", "doc_id", "rep", "shift", "pos")
    held = (each["doc_id"] == right["doc_id"]) & (each["rep"] == right["rep"]) & (each["shift"] == right["shift"]) & (F.col("low") <= F.col("pos")) & (F.col("pos") + shingle <= F.col("high"))
    several = met.groupBy(whole).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("whole")
    open_ = Step(each.join(right, held, "left_anti").select("whole").distinct().join(several, "whole"), "open-keys")
    exact = equal_passages(docs, met.select(whole, "doc_id").join(open_.df, "whole").select(F.col("whole").alias("key"), "doc_id"), passage, shingle, hashes)
    every = Step(near.df.union(exact.df), "every-passage")
    for step in (centres, open_, near, exact):
        step.drop()
    if run:
        edges = lambda df: df.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        owned = owners(short.select("key", "doc_id", "pos", "before", "after"), components(edges(every.df)))
        beside = verified(docs, run_pairs(owned.df, least, shingle), least, shingle, around_blocks)
        classes = components(edges(every.df.union(beside.df)))
        members = owners(owned.df.select("key", "doc_id"), classes)
        owned.drop()
        changed = changed_passages(docs, members, passage, shingle)
        every.df = every.df.union(beside.df).union(changed.df)
    found.drop()
    return every.df.union(same.df)


def repeated_passages(docs: DataFrame, passage: int = 50, shingle: int = 5, hashes: int = 3) -> DataFrame:
    """One row per document with a verified passage: doc_id, class_id (smallest document of its class), n_links, n_words (words within such passages), spans ("start:end" in words, joined)."""
    found = passages(docs, passage, shingle, hashes)
    classes = components(found.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    both = found.select("doc_id", F.col("rep").alias("other"), "start", "n_words").union(found.select("rep", "doc_id", "rep_start", "n_words"))
    spans = both.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("n_words")).alias("end"), F.count("*").alias("n"))  # at most one span a word
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a document's own spans
    spans = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    merged = islands.groupBy("doc_id").agg(F.sum("n").alias("n_links"), F.sum(F.col("end") - F.col("start")).alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    return merged.join(classes, F.col("doc_id") == F.col("node")).select(
        "doc_id", F.col("component").alias("class_id"), "n_links", "n_words", F.expr("array_join(transform(s, x -> concat(x.start, ':', x.end)), ',')").alias("spans"),
    )
