"""Token counts (8): Arrow functions that return lengths only.

Texts are dealt to the encoder in batches balanced by bytes; long ones are cut at safe boundaries (before white space that
follows a word), which no token of the vocabulary crosses, so that lengths add up. Words met before come from a bounded cache.
Null texts count as empty; a null id stays null; each row gives one row, repeated rows and equal texts too; texts of any length are
counted whole; other columns stay out; an empty table gives no rows; a vocabulary file that is not word-wise is an error.
"""
from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_text, per_worker, segments, text_batches, tokenizer_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


#: Texts whose tokens a word-wise file gives word by word.
PROBES = ("the cat  sat\n on", " \t a\x0bb\x0c c ", "Don't stop; 12.5% of it!", "l'été où", "x")


def word_wise(vocabulary: str):
    """The tokenizer of a file whose tokens never cross ASCII white space and do not show it; an error for other files."""
    tokenizer = tokenizer_of(vocabulary)
    for text in PROBES:
        apart = [i for w in text.encode().split() for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids]
        if tokenizer.encode(text, add_special_tokens=False).ids != apart:
            raise ValueError(f"{vocabulary} does not drop white space between words")
    return tokenizer


def token_counts(docs: DataFrame, vocabulary: str, batch_bytes: int = 2 << 20, cache_words: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of whole texts for a word-wise tokenizer file that drops white space."""

    def count(batches):
        tokenizer, known = per_worker(f"lengths {vocabulary}", lambda: (word_wise(vocabulary), {}))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

        def lengths(parts):
            new = set(chain.from_iterable(parts)).difference(known)
            if len(known) + len(new) > cache_words:
                known.clear()
                new = set(chain.from_iterable(parts))
            new = list(new)
            known.update(zip(new, map(len, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False))))
            return [sum(map(known.__getitem__, p)) for p in parts]

        for ids, texts in text_batches(batches, batch_bytes):
            total, owners, parts, size = [0] * len(ids), [], [], 0
            for k, b in enumerate(texts):
                for piece in segments(b, batch_bytes):
                    owners.append(k)
                    parts.append(piece.split())
                    size += len(piece)
                    if size >= batch_bytes:
                        for o, n in zip(owners, lengths(parts)):
                            total[o] += n
                        owners, parts, size = [], [], 0
            for o, n in zip(owners, lengths(parts)):
                total[o] += n
            yield arrow_rows(schema, [ids, list(map(len, texts)), total])

    return id_text(docs).mapInArrow(count, SCHEMA)


def over_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
