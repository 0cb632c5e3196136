"""JSON-lines scans and sinks."""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def strict(spark: SparkSession, path: str, schema: str | T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a declared schema: a malformed line or a required key that is missing or null fails the job. Blank lines are skipped."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for key in required:
        df = df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"missing key {key}")).cast(df.schema[key].dataType)).otherwise(F.col(key)))
    return df


def tolerant_keys(lines: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values of a key in lines (value); broken lines and lines without it are skipped."""
    # Spark's parser stops after the first value; no rest of a line can close both an array and an object around it
    whole, inside = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), "value", F.lit("}")))
    return lines.where(whole.isNotNull()).select(F.try_variant_get(inside, f"$.x.{key}", "string").alias(key)).where(F.col(key).isNotNull()).distinct()


def tolerant(spark: SparkSession, path: str, key: str) -> DataFrame:
    """tolerant_keys of a file; none if it is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return tolerant_keys(spark.read.text(path), key)


def holdout_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct key: complex where a line has it, else prompt; none if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string")
    rows = spark.read.schema("complex string, prompt string").option("mode", "FAILFAST").json(path)
    return rows.select(F.coalesce("complex", "prompt").alias("key")).where("key is not null").distinct()


def write_split(df: DataFrame, folder: str, name: str) -> None:
    """Overwrite folder/name.jsonl with one object a line, nulls kept: a folder of part files that readers take as one file."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}.jsonl")


def write_holdout(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", "false").json(path)


def append_pending(df: DataFrame, path: str, key: str = "prompt", resume: bool = True) -> None:
    """Append rows whose key the sink lacks; without resume, or a sink, write it anew."""
    spark = df.sparkSession
    if resume and exists(spark, path):
        df = df.join(tolerant(spark, path, key), key, "left_anti")
        df.write.mode("append").option("ignoreNullFields", "false").json(path)
    else:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """First 16 hex digits of the SHA-256 of the files' bytes in order, streamed; absent files add nothing; "missing" if none exists."""
    digest, found = hashlib.sha256(), False
    for path in paths:
        if exists(spark, path):
            found = True
            for row in spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").toLocalIterator():
                digest.update(row["content"])
    return digest.hexdigest()[:16] if found else "missing"


def _replace(spark: SparkSession, aside: str, path: str) -> None:
    """Rename a file over another in one step."""
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    to = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else jvm.java.net.URI("file:///"), spark._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(aside), to, how)


def write_stream(spark: SparkSession, path: str, parts) -> None:
    """One file of the strings of parts, written aside and renamed over what was there: readers see the old or the new, never neither."""
    aside = f"{path}.{uuid.uuid4().hex}"
    p, fs = _fs(spark, aside)
    out = fs.create(p, True)
    for part in parts:
        out.write(bytearray(part.encode()))
    out.close()
    _replace(spark, aside, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_stream(spark, path, [text])


def write_split_file(df: DataFrame, folder: str, name: str) -> None:
    """Exactly folder/name.jsonl, one object a line, nulls kept, in the order of df's partitions: parts are written in parallel, then joined as streams."""
    spark, aside, whole = df.sparkSession, f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/.{name}-{uuid.uuid4().hex}.jsonl"
    df.write.option("ignoreNullFields", "false").json(aside)
    p, fs = _fs(spark, aside)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(whole), True)
    for part in sorted(x.getPath().toString() for x in fs.listStatus(p)):
        if "/part-" in part:
            source = fs.open(spark._jvm.org.apache.hadoop.fs.Path(part))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, spark._jsc.hadoopConfiguration(), False)
            source.close()
    out.close()
    _replace(spark, whole, f"{folder}/{name}.jsonl")
    fs.delete(p, True)


def write_pointer(spark: SparkSession, folder: str, target: str) -> None:
    """folder/latest.json names the latest run."""
    write_text(spark, f"{folder}/latest.json", json.dumps({"target": target}) + "\n")
