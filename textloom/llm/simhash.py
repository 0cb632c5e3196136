"""SimHash near-dedup (9): fuzzy hashing of fingerprints with the binary Golay code.

Fingerprints are cut into three segments (23, 23, 18 bits). The perfect [23,12,7] code decodes each to nearby codewords: one key
if the nearest is at distance 2 or less, else six (the nearest and the five at distance 4), so that segments one bit apart
always share a key. With 2 errors over 3 segments one segment has none and the next (cyclically) at most one, or none if the first
is followed by another clean one; so (exact segment, codeword key of the next) finds every pair. Pairs that meet are verified by
counting bits. Buckets over `bucket` members are not paired: their members get longer keys, of which each finds every pair again:
four of six blocks (15 keys of 42 to 44 bits), then, for buckets still too large, the words one flip away, which two fingerprints
share just if they differ in 2 bits at most. So nothing is lost and no bucket is expanded into all pairs.

Equal fingerprints are one node. Null texts are empty: fingerprint zero, linked like any other; every row gives one row, repeated
and null ids too (a null id is no smallest one); texts of any length are taken whole; other columns stay out; empty tables give no
rows.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Step, bounded_batches, free, id_text, text_batches
from .graph import components
from .substring import mix

SEGMENTS = ((0, 23), (23, 23), (46, 18))
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fixed: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo GENERATOR."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of the nearest codeword; index offsets (12 bits) of the nearest and, at distance 3, the five codewords at distance 4; -1: none."""
    one = 1 << np.arange(23)
    errors = np.concatenate([[0], one, *[[one[i] | one[j] for i in range(j)] for j in range(23)], *[[one[i] | one[j] | one[k] for j in range(k) for i in range(j)] for k in range(23)]]).astype(np.int64)
    pattern = np.zeros(2048, dtype=np.int64)
    pattern[syndromes(errors)] = errors
    words = np.arange(4096, dtype=np.int64) << 11
    words ^= syndromes(words)
    sevens = words[np.bitwise_count(words) == 7]
    offsets = np.full((2048, 6), -1, dtype=np.int64)
    offsets[:, 0] = 0
    for s in np.flatnonzero(np.bitwise_count(pattern) == 3):
        offsets[s, 1:] = sevens[sevens & pattern[s] == pattern[s]] >> 11
    return pattern, offsets


def golay_keys(v: np.ndarray, tables) -> np.ndarray:
    """(n, 6) indices of codewords near 23-bit words; -1: no key."""
    pattern, offsets = tables
    s = syndromes(v)
    nearest = (v ^ pattern[s]) >> 11
    return np.where(offsets[s] < 0, -1, nearest[:, None] ^ np.maximum(offsets[s], 0))


def fingerprint(b: bytes, shingle: int, xxh64) -> int:
    """Majority of the shingles' XXH64 bits; repeats count; fewer words: the whole sequence; none: zero."""
    words = b.lower().split()
    if not words:
        return 0
    ones, n = np.zeros(64, dtype=np.int64), max(len(words) - shingle + 1, 1)
    for at in range(0, n, 32768):
        some = words[at : at + 32768 + shingle - 1]
        line, ends = b" ".join(some), np.cumsum([len(w) + 1 for w in some])
        width = min(shingle, len(some))
        starts, ends = [0, *ends[: len(some) - width].tolist()], (ends[width - 1 :] - 1).tolist()
        ones += ones_of(np.array([xxh64(line[a:z], 42) for a, z in zip(starts, ends)], dtype=np.uint64))
    return majority(ones, n)


def ones_of(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit."""
    ones = np.zeros(64, dtype=np.int64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for row in range(0, len(bits), 255):  # sums of up to 255 bits fit in a byte
        ones += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of whole texts, A-Z lower-cased, words cut at ASCII white space."""

    def run(batches):
        import xxhash

        for ids, texts in text_batches(batches):
            fps = [fingerprint(b, shingle, xxhash.xxh64_intdigest) for b in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(fps, type=pa.int64())], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): at most 18 keys for each fp of nodes."""

    def run(batches):
        tables = golay_tables()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for i in range(3):
                near = golay_keys(part[(i + 1) % 3], tables)
                key = np.int64(i) << 40 | part[i][:, None] << 12 | near
                use = near >= 0
                yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(np.broadcast_to(fp[:, None], near.shape)[use].view(np.int64))], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def block_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): 15 keys for each fp of nodes, without two of the BLOCKS each; 2 errors spoil two blocks at most."""
    masks = [sum(((1 << n) - 1) << at for at, n in four) for four in combinations(BLOCKS, 4)]
    keys = [F.struct(F.lit(i).alias("four"), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("bits")) for i, mask in enumerate(masks)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def flips(nodes: DataFrame) -> DataFrame:
    """(near, fp): the 65 words at one differing bit or none of each fp of nodes."""

    def run(batches):
        masks = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 10_000):
                some = fp[at : at + 10_000, None]
                near = some ^ masks
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().view(np.int64)), pa.array(np.broadcast_to(some, near.shape).ravel().view(np.int64))], names=["near", "fp"])

    return nodes.select("fp").mapInArrow(run, "near long, fp long")


def links(nodes: DataFrame, bucket: int = 8) -> DataFrame:
    """(u, v) over distinct fp of nodes: every two at 2 or fewer differing bits are linked, or joined through links."""
    found, left = [], nodes
    for name, keys_of in (("golay", bucket_keys), ("block", block_keys)):
        keys = Step(keys_of(left), f"{name}-keys")
        sizes = keys.df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        met = Step(keys.df.join(sizes, "key"), f"{name}-buckets")
        keys.drop()
        small = met.df.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))  # `bucket` at most
        small = small.select("fps", F.explode("fps").alias("u")).select("u", F.explode("fps").alias("v")).where("u > v")
        found.append(small.where(F.bit_count(F.expr("u ^ v")) <= 2))
        left = met.df.where(F.col("n") > bucket).select("fp").distinct()
    large = flips(left).groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    large = large.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v")
    return reduce(DataFrame.union, found, large).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = 8) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of fingerprints at 2 or fewer differing bits."""
    prints = Step(fingerprints(docs, shingle), "fingerprints")
    nodes = Step(prints.df.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    joined = components(links(nodes.df, bucket))
    rep = nodes.df.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = rep.groupBy("component").agg(F.min("low").alias("component_id"))
    found = Step(rep.join(lowest, "component").select("fp", "component_id"), "fp-components")  # a plain exchange for the join below
    result = Step(prints.df.join(found.df, "fp"), "near-duplicates")
    for step in (prints, nodes, found):
        step.drop()
    return result.df


def shingle_hashes(b: bytes, shingle: int, xxh64) -> np.ndarray:
    """XXH64 of the shingles of A-Z lower-cased words, repeats included; fewer words: the whole sequence."""
    words = b.lower().split()
    return np.array([xxh64(b" ".join(words[i : i + shingle]), 42) for i in range(max(len(words) - shingle + 1, 1))], dtype=np.uint64)


def text_keys(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """h1, h2, doc_id, fp (the majority fingerprint), size (distinct shingles), keys (of each band, the hash of `rows` minima of the shingles' hashes under as many odd factors) of docs (h1, h2, doc_id, text)."""

    def run(batches):
        import xxhash

        factors = np.random.default_rng(9).integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            low, prints, sizes = np.full((batch.num_rows, bands * rows), ~np.uint64(0)), [], []
            for k, text in enumerate(batch.column("text")):
                hashes = shingle_hashes((text.as_py() or "").encode(), shingle, xxhash.xxh64_intdigest)
                prints.append(majority(ones_of(hashes), len(hashes)))
                hashes = np.unique(hashes, return_counts=True)[0]
                sizes.append(len(hashes))
                for at in range(0, len(hashes), 2048):
                    np.minimum(low[k], (hashes[at : at + 2048, None] * factors).min(axis=0), out=low[k])
            keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (batch.num_rows, bands))
            for row in range(rows):
                keys = mix(keys ^ mix(low[:, row::rows]))
            every = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.select(["h1", "h2", "doc_id"]).columns, pa.array(prints, type=pa.int64()), pa.array(sizes, type=pa.int64()), every], names=["h1", "h2", "doc_id", "fp", "size", "keys"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, fp long, size long, keys array<long>")


def unlike_pairs(met: DataFrame, joined: DataFrame, sets: DataFrame, similarity: float, block: int, block_bytes: int = 8 << 20) -> Step:
    """Step of (u, v): links that join the components (node, component) of the texts of each key of met (key, node), tested on sets (node, shingles).

    Texts outside the key's largest component are dealt to blocks and tested against blocks of all its texts. Blocks leave out pairs
    that their own links have joined already.
    """
    named = met.select("key", "node").join(joined, "node", "left").join(sets.select("node", F.octet_length("shingles").alias("size")), "node")
    large = Step(named.select("key", "node", F.coalesce("component", "node").alias("component"), "size"), "large-buckets")
    parts = large.df.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "size", "component"))
    whole = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), most.alias("most")).where("parts > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / block, size / block_bytes, F.lit(1))).cast("int")
    dealt = whole.select("key", F.col("most.component").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("outs"), blocks(F.col("n"), F.col("size")).alias("alls"))
    outside = Step(large.df.drop("size").join(dealt, "key").withColumn("out", F.col("component") != F.col("main")), "outside")
    large.drop()
    rows = outside.df
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = rows.where("out").select("key", at(F.col("outs")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), "node", "component", "out", F.lit(True).alias("one"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"), at(F.col("alls")).alias("j"), "node", "component", "out", F.lit(False).alias("one"))
    sides = Step(left.union(right).join(sets, "node"), "block-sides")
    outside.drop()

    def test(rows: pa.Table) -> pa.Table:
        ids, parent, found = rows["node"].to_pylist(), {}, []
        component, out, one = (rows[c].to_pylist() for c in ("component", "out", "one"))
        hashes = [np.frombuffer(b, "<u8") for b in rows["shingles"].to_pylist()]

        def find(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        others = [k for k in range(len(ids)) if not one[k]]
        for x in (k for k in range(len(ids)) if one[k]):
            n, mine = len(hashes[x]), find(component[x])
            near = [y for y in others if find(component[y]) != mine and (ids[x] < ids[y] or not out[y]) and similarity * n <= len(hashes[y]) <= n / similarity]
            if not near:
                continue
            every = np.concatenate([hashes[y] for y in near])
            hits = hashes[x][np.minimum(np.searchsorted(hashes[x], every), n - 1)] == every
            sizes = np.array([len(hashes[y]) for y in near])
            both = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in np.flatnonzero(both >= similarity * (n + sizes - both)):
                a, b = find(component[x]), find(component[near[k]])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((ids[x], ids[near[k]]))
        return pa.table({"u": pa.array([u for u, _ in found], type=pa.int64()), "v": pa.array([v for _, v in found], type=pa.int64())})

    found = Step(sides.df.groupBy("key", "i", "j").applyInArrow(test, "u long, v long"), "unlike-links")
    sides.drop()
    return found


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bucket: int = 8, bands: int = 24, rows: int = 5, block: int = 256) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: the one with the smallest doc_id (of equal ids, the smallest hash).

    Groups: equal texts, and texts joined by pairs whose sets of `shingle` words have a Jaccard similarity of at least `similarity`.
    Candidates are of two kinds, and both are verified. Fingerprints within 2 bits, found by their Golay keys as above: equal ones meet
    one of their texts, others one of each. Since few pairs of that similarity have such fingerprints, texts also meet that share one
    of `bands` keys of `rows` MinHash values: a pair at 0.8 is missed but for (1 - 0.8^5)^24 = 7e-5, closer ones more rarely. Buckets
    of up to `bucket` texts are paired, larger ones with one of their texts, one of three over all keys; then each pair of a larger bucket
    that these links have not joined is tested in blocks of about `block` texts, so no pair that shares a key is left out.

    Null texts are empty; ids may be shared by different texts, each of which is judged on its own; repeated rows count once; rows
    without an id stay; texts of any length are taken whole; columns may have any names; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    name = {c: free(docs, f"textloom_{c}") for c in ("id", "h1", "h2")}
    hashes = {name["id"]: F.col("doc_id").cast("long"), name["h1"]: F.xxhash64(F.coalesce("text", F.lit(""))), name["h2"]: F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))}
    with_id = docs.where("doc_id is not null").withColumns(hashes)
    own = with_id.select(F.col(name["h1"]).alias("h1"), F.col(name["h2"]).alias("h2"), F.col(name["id"]).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = Step(text_keys(own, shingle, bands, rows), "text-keys")
    once = keyed.df.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    twins = Step(once.withColumn("node", F.monotonically_increasing_id()), "twins")  # a node for each different text
    keyed.drop()
    text = F.struct("node", "size")
    hubs = Step(twins.df.groupBy("fp").agg(F.min(text).alias("hub")), "hubs")
    near = Step(links(hubs.df.select("fp"), bucket), "links")
    hub = lambda c: hubs.df.select(F.col("fp").alias(c), F.col("hub").alias("a" if c == "u" else "b"))
    across = near.df.join(hub("u"), "u").join(hub("v"), "v").select("a", "b")
    within = twins.df.select("fp", text.alias("b")).join(hubs.df, "fp").select(F.col("hub").alias("a"), "b")
    every = Step(twins.df.select(text.alias("t"), F.explode("keys").alias("key")), "band-keys")
    sizes = every.df.groupBy("key").agg(F.count("*").alias("n"), F.min_by("t", F.xxhash64(F.pmod("key", F.lit(3)), "t.node")).alias("hub")).where("n > 1")
    met = Step(every.df.join(sizes, "key"), "band-buckets")
    every.drop()
    small = met.df.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("t").alias("texts"))
    small = small.select("texts", F.explode("texts").alias("a")).select("a", F.explode("texts").alias("b"))
    stars = met.df.where(F.col("n") > bucket).select(F.col("hub").alias("a"), F.col("t").alias("b"))
    large = met.df.where(F.col("n") > bucket).select("key", F.col("t.node").alias("node"))
    can = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size")  # the similarity is at most the quotient of the sizes
    pairs = small.union(stars).union(within).union(across).where(can & (F.col("a.node") != F.col("b.node")))
    pairs = Step(pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "near-pairs")
    hubs.drop()
    near.drop()
    ends = Step(twins.df.select("node", "h1", "h2", "low").join(pairs.df.select(F.col("a").alias("node")).union(pairs.df.select("b")).union(large.select("node")).distinct(), "node"), "ends")

    def sets(batches):
        import xxhash

        for batch in batches:
            blobs = [np.unique(shingle_hashes(text.as_py().encode(), shingle, xxhash.xxh64_intdigest), return_counts=True)[0].tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, type=pa.binary())], names=["node", "shingles"])

    chosen = own.withColumnRenamed("doc_id", "low").join(ends.df, ["low", "h1", "h2"]).select("node", "text")
    chosen = Step(chosen.mapInArrow(sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    ends.drop()

    def alike(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, type=pa.bool_()))

    one, two = chosen.df.select(F.col("node").alias("a"), F.col("shingles").alias("x")), chosen.df.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    edges = pairs.df.join(one, "a").join(two, "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y").mapInArrow(alike, "u long, v long")
    joined = Step(components(edges), "near-components")
    pairs.drop()
    others = unlike_pairs(large, joined.df, chosen.df, similarity, block)
    met.drop()
    chosen.drop()
    groups = Step(components(joined.df.select(F.col("node").alias("u"), F.col("component").alias("v")).union(others.df)), "near-groups")
    joined.drop()
    others.drop()
    named = groups.df.join(twins.df.select("node", "low", "h1", "h2"), "node")
    best = named.groupBy("component").agg(F.min(F.struct("low", "h1", "h2", "node")).alias("best"))
    gone = named.join(best, "component").where("node <> best.node").select("node")
    kept = Step(twins.df.join(gone, "node", "left_anti").select(F.col("low").alias(name["id"]), F.col("h1").alias(name["h1"]), F.col("h2").alias(name["h2"])), "kept")
    twins.drop()
    groups.drop()
    rest = with_id.join(kept.df, [*name.values()], "left_semi").dropDuplicates([*name.values()])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*columns).unionByName(docs.where("doc_id is null"))
