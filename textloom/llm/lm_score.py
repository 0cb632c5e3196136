"""LM scores of documents (3): the CTW score beside an exact unigram base.

1. words: counts of the training words; those with a share `hot` of the training tokens or more (1 / hot at most) are broadcast.
2. batches: one pass cuts the texts into batches of about `batch_bytes` and writes each with its sorted distinct grams, by part, and
   their training counts, in a table bucketed by batch. A batch asks for each of its grams once, however often it has it.
3. parts: one shuffle of packed grams adds up each part's counts and weights its subtrees; sums of weights go up to the shared nodes.
4. answers: parts meet the asks of all batches, a batch's grams of a part in one row, and return a score for each.
5. texts: answers meet their batch again by its bucket, so texts are read from the table but never shuffled; each text adds up the
   scores of its grams, and its words' logs; words that are not hot meet their counts in a join.

What is learned (step 3) is every gram of the training texts, so it grows with the input; a task holds one part or one batch. Null
texts are empty (the end alone is scored); ids may repeat or be null (a row each); texts of any length are scored whole, long ones in
stretches; equal texts score alike; other columns stay out; an empty table gives no rows.
"""
from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ctw
from .common import Step, bounded_batches, drop, fold, fold_col, id_text, partitions, scratch, text_batches
from .substring import mix

HOT = 2.0**-18
BATCHES = "batch long, part int, grams binary, counts binary, nth int, doc_id long, text binary"
SCORED = "batch long, nth int, doc_id long, held_out boolean, n_tokens long, n_hot long, hot double, score double, n_bytes long, rare array<struct<word:binary,times:int>>"


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word binary, n) of lower-cased words and of the end of each text, which is the empty word."""

    def count(batches):
        total: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.binary()), pa.array(list(total.values()), type=pa.int64())], names=["word", "n"])
        for _, texts in text_batches(batches):
            for b in texts:
                total.update(b.lower().split())
                total[b""] += 1
            if len(total) > most:
                yield flush()
                total.clear()
        if total:
            yield flush()

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learned_from(doc_id: int | None) -> bool:
    return fold(doc_id) != 1


def by_part(grams: np.ndarray, parts: int, depth: int):
    """(part, places of its grams): contexts that share their nearest three bytes go to one part."""
    part = (mix((grams >> 8 * (depth - ctw.TOP)).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[a:z]) for p, (a, z) in enumerate(zip(ends[:-1], ends[1:])) if z > a]


def packed(grams: np.ndarray, counts: np.ndarray, parts: int, depth: int) -> tuple[list[int], list[bytes], list[bytes]]:
    rows = by_part(grams, parts, depth)
    return [p for p, _ in rows], [ctw.squeeze(np.diff(grams[o], prepend=0)) for _, o in rows], [ctw.squeeze(counts[o]) for _, o in rows]


def arrow(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def in_batches(docs: DataFrame, parts: int, depth: int, batch_bytes: int) -> DataFrame:
    """BATCHES: rows of packed grams (part, grams, counts) and rows of texts (nth, doc_id, text) of each batch."""

    def run(batches):
        from pyspark import TaskContext

        schema = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("text", pa.binary())])
        batch = TaskContext.get().partitionId() << 32
        for ids, texts in text_batches(batches, batch_bytes):
            part, grams, counts = packed(*ctw.count(texts, list(map(learned_from, ids)), depth), parts, depth)
            yield arrow(schema, len(part), batch=[batch] * len(part), part=part, grams=grams, counts=counts)
            del part, grams, counts
            start, size = 0, 0
            for k, b in enumerate(texts):
                size += len(b)
                if size >= 2 << 20 or k == len(texts) - 1:
                    yield arrow(schema, k + 1 - start, batch=[batch] * (k + 1 - start), nth=range(start, k + 1), doc_id=ids[start : k + 1], text=texts[start : k + 1])
                    start, size = k + 1, 0
            batch += 1

    return docs.mapInArrow(run, BATCHES)


def parts_of(grams: DataFrame, parts: int, depth: int, least: float) -> DataFrame:
    """Of packed grams (part, grams, counts): rows (part, grams, counts) added up; below zero, keys of (two bytes, byte) with counts; keys of upper nodes with their children's sums."""

    def run(batches):
        # Spark may deal several parts to one task; their contexts stay apart, so they can be weighted together
        schema = pa.schema([("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("key", pa.int64()), ("weighted", pa.float64()), ("zeros", pa.float64()), ("ones", pa.float64())])
        found = ctw.Sum()
        for batch in batches:
            for g, c in zip(batch.column("grams"), batch.column("counts")):
                keys, counts = np.cumsum(ctw.unsqueeze(g.as_py())), ctw.unsqueeze(c.as_py())
                found.add(keys[counts > 0], counts[counts > 0])
        keys, counts = found.get()
        if len(keys):
            part, blobs, totals = packed(keys, counts, parts, depth)
            yield arrow(schema, len(part), part=part, grams=blobs, counts=totals)
            rows, n = ctw.low_rows(keys, counts, depth)
            yield arrow(schema, len(rows), key=rows - (1 << 62), weighted=np.zeros(len(n)), zeros=n.astype(float), ones=np.zeros(len(n)))
            key, weighted, zeros, ones = ctw.going_up(ctw.subtree(keys, counts, depth, least))
            yield arrow(schema, len(key), key=key, weighted=weighted, zeros=zeros, ones=ones)

    return grams.repartition(parts, "part").mapInArrow(run, "part int, grams binary, counts binary, key long, weighted double, zeros double, ones double")


def answers(asks: DataFrame, learned: DataFrame, top, parts: int, depth: int, least: float, together: int = 1 << 18) -> DataFrame:
    """(batch, part, scores): a float for each gram of asks (batch, part, grams), from the parts learned (part, grams, counts) and the broadcast upper nodes."""
    both = learned.select(F.lit(None).cast("long").alias("batch"), "part", "grams", "counts").unionByName(asks.select("batch", "part", "grams", F.lit(None).cast("binary").alias("counts")))

    def run(batches):
        schema = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("scores", pa.binary())])
        found, model, waiting, size = ctw.Sum(), None, [], 0

        def score():
            grams = np.concatenate([g for _, _, g in waiting])
            distinct, inverse = np.unique(grams, return_inverse=True)
            values = np.split(model.scores(distinct)[inverse].astype("<f4"), np.cumsum([len(g) for _, _, g in waiting])[:-1])
            return arrow(schema, len(waiting), batch=[b for b, _, _ in waiting], part=[p for _, p, _ in waiting], scores=[v.tobytes() for v in values])

        for some in batches:
            for batch, part, grams, counts in zip(*(some.column(c) for c in ("batch", "part", "grams", "counts"))):
                keys = np.cumsum(ctw.unsqueeze(grams.as_py()))
                if not batch.is_valid:  # what was learned comes first
                    found.add(keys, ctw.unsqueeze(counts.as_py()))
                    continue
                if model is None:
                    model = ctw.Model(ctw.subtree(*found.get(), depth, least), top.value, depth)
                    del found
                waiting.append((batch.as_py(), part.as_py(), keys))
                size += len(keys)
                if size >= together:
                    yield score()
                    waiting, size = [], 0
        if waiting:
            yield score()

    return both.repartition(parts, "part").sortWithinPartitions(F.col("batch").asc_nulls_first()).mapInArrow(run, "batch long, part int, scores binary")


def score(docs: DataFrame, depth: int = ctw.DEPTH, least: float = ctw.LEAST, hot: float = HOT, batch_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark, docs, parts = docs.sparkSession, id_text(docs), partitions(docs.sparkSession)
    words = Step(word_counts(docs.where(fold_col(F.col("doc_id")) != 1)), "words")
    n_train, n_words = words.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = float(n_train + 0.5 * (n_words + 1))
    often = words.df.where(F.col("n") >= max(1, hot * n_train)).toArrow()
    logs = np.log10((often.column("n").to_numpy() + 0.5) / below).tolist()
    common = spark.sparkContext.broadcast(dict(zip(often.column("word").to_pylist(), logs)))

    bounded_batches(spark)
    name, path = f"textloom_{uuid.uuid4().hex}", scratch(spark, "lm-batches")
    in_batches(docs, parts, depth, batch_bytes).write.bucketBy(parts, "batch").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    grams = table.where("part is not null").select("batch", "part", "grams", "counts")
    learned = Step(parts_of(grams.select("part", "grams", "counts"), parts, depth, least), "lm-parts")
    sums = learned.df.where("key is not null").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("weighted", "zeros", "ones"))).toArrow()  # upper nodes only
    key, weighted, zeros, ones = (sums.column(c).to_numpy() for c in ("key", "weighted", "zeros", "ones"))
    low = key < 0
    rows, n = ctw.add_up(key[low] + (1 << 62), zeros[low].astype(np.int64))
    top = spark.sparkContext.broadcast(ctw.upper(rows, n, (key[~low], weighted[~low], zeros[~low], ones[~low]), least))
    replies = answers(grams.drop("counts"), learned.df.where("part is not null").select("part", "grams", "counts"), top, parts, depth, least)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.filter(pa.compute.is_valid(left["part"]))
        grams = dict(zip(asked["part"].to_pylist(), asked["grams"].to_pylist()))
        reply = dict(zip(right["part"].to_pylist(), right["scores"].to_pylist()))
        keys, scores = (np.concatenate([np.zeros(0, dtype=t), *x]) for t, x in ((np.int64, [np.cumsum(ctw.unsqueeze(g)) for g in grams.values()]), (np.float32, [np.frombuffer(reply[p], "<f4") for p in grams])))
        order = np.argsort(keys)
        keys, scores = keys[order], scores[order].astype(float)
        rows = left.filter(pa.compute.is_valid(left["nth"])).select(["batch", "nth", "doc_id", "text"])
        del left, right, asked, grams, reply, order
        some = [pa.Table.from_arrays([pa.array([], type=f.type) for f in schema], schema=schema)]
        for a in range(0, rows.num_rows, 500):  # words as Python objects for a few texts at a time
            part = rows.slice(a, 500)
            ids, texts, known = part["doc_id"].to_pylist(), part["text"].to_pylist(), common.value
            n_tokens, n_known, base, rare, pairs = [], [], [], [0], [[], []]
            for b in texts:
                tokens = b.lower().split()
                tokens.append(b"")
                values = list(map(known.get, tokens))
                if None in values:
                    others = Counter([w for w, v in zip(tokens, values) if v is None])
                    values = [v for v in values if v is not None]
                    pairs[0] += others.keys()
                    pairs[1] += others.values()
                n_tokens.append(len(tokens))
                n_known.append(len(values))
                base.append(float(np.sum(values)))
                rare.append(len(pairs[0]))
            lists = pa.ListArray.from_arrays(pa.array(rare, type=pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[0], type=pa.binary()), pa.array(pairs[1], type=pa.int32())], fields=list(pair)))
            columns = [part["batch"].combine_chunks(), part["nth"].combine_chunks(), pa.array(ids, type=pa.int64()), [not learned_from(i) for i in ids], n_tokens, n_known, base, ctw.score_texts(texts, keys, scores, depth), list(map(len, texts))]
            some.append(pa.Table.from_arrays([*(pa.array(c, type=f.type) for c, f in zip(columns, schema)), lists], schema=schema))
        return pa.concat_tables(some)

    pair = pa.struct([("word", pa.binary()), ("times", pa.int32())])
    types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pair)]
    schema = pa.schema(list(zip(["batch", "nth", "doc_id", "held_out", "n_tokens", "n_hot", "hot", "score", "n_bytes", "rare"], types)))
    asked = table.select("batch", "part", "grams", "nth", "doc_id", "text").groupBy("batch")
    scored = Step(asked.cogroup(replies.groupBy("batch")).applyInArrow(run, SCORED), "lm-scores")
    spark.sql(f"drop table {name}")
    drop(spark, path)
    learned.drop()
    rare = scored.df.select("batch", "nth", F.explode("rare").alias("r")).select("batch", "nth", "r.word", "r.times").join(words.df, "word", "left")
    rest = rare.groupBy("batch", "nth").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rest"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(below))).alias("rest"),
    )
    result = scored.df.drop("rare").join(rest, ["batch", "nth"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("hot") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
    result = Step(result, "lm-result")
    words.drop()
    scored.drop()
    return result.df
