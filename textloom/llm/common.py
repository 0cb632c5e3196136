"""Shared plumbing: table access, materialised steps in the shared folder, Arrow helpers."""
from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed ASCII white space that separates words.
SPACES = " \t\n\r\x0b\x0c"


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches where Spark's defaults hold; what a user has set stays."""
    for key, usual, own in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key).rstrip("bB") == str(usual):
            spark.conf.set(key, str(own))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete steps that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Shuffle files of a query go when it ends, not when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Step:
    """A written intermediate: .df rereads it, .drop() deletes it. Shuffle files of its write are removed with the write's end."""

    def __init__(self, df: DataFrame, name: str):
        bounded_batches(df.sparkSession)
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns that an operator needs, null texts as empty; other columns, clashing names too, stay out."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, mod 5; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def fold_col(col) -> "F.Column":
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def text_batches(batches, limit: int = 4 << 20):
    """Lists of (doc_id, utf-8 bytes) of about `limit` bytes each, from Arrow batches of (doc_id, text)."""
    ids, texts, size = [], [], 0
    for batch in batches:
        column = batch.column(1)
        for i, t in zip(batch.column(0).to_pylist(), column.cast(pa.large_binary()) if batch.num_rows else ()):
            b = t.as_py()
            ids.append(i)
            texts.append(b)
            size += len(b)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def segments(b: bytes, limit: int = 1 << 20):
    """Pieces of at most about `limit` bytes of one text, cut before ASCII white space that follows a non-space: never inside a word."""
    start = 0
    while len(b) - start > limit:
        cut = start + limit
        while cut < len(b) and not (b[cut] in b" \t\n\r\x0b\x0c" and b[cut - 1] not in b" \t\n\r\x0b\x0c"):
            cut += 1
        yield b[start:cut]
        start = cut
    if start < len(b) or not start:
        yield b[start:]


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def per_worker(key: str, make):
    """make()'s value, kept for the life of the Python worker: the next tasks use it again."""
    store = sys.modules.setdefault("_textloom_worker", types.ModuleType("_textloom_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def tokenizer_of(path: str):
    """The tokenizer of a file, whole texts, one thread: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
