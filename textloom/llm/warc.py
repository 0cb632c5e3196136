"""WARC (5): a deterministic sharded writer and its reader.

Records are range-sorted by (page_id, digest, url) and written one gzip member each. A task rolls to a new file once `roll_bytes`
compressed bytes are written; headers, digests and lengths are made anew from the payload. A file is written under a temporary name
of its own and renamed when it is whole, so a lost or repeated task leaves nothing half done. A record's bytes depend on the record
alone; which file holds it follows from the order, the number of shuffle partitions and the range bounds that Spark samples from the
input's splits, so the same input under the same settings gives the same files. The manifest (file, records, bytes, SHA-1) is written last, and readers open what it lists.

Among records with equal payloads of at least `least` bytes the one with the largest page_id (of repeated rows, the first) is the
response; others become revisits of it. Smaller payloads, and groups without any id, stay responses. Null html is an empty payload;
a null id is written as "null"; payloads of any length are one record; other columns stay out; an empty table gives an empty manifest
and no rows.
"""
from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Step, bounded_batches, partitions, scratch

MANIFEST = "path string, records long, bytes long, sha1 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ID = "urn:x-page:"


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; refers_to None: a response."""
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{ID}{'null' if page_id is None else page_id}>", "WARC-Date": date}
    if url:
        head["WARC-Target-URI"] = "".join(url.split())
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": str(size), "Content-Type": "application/http; msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{ID}{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        payload = b""
    block = http + payload
    head |= {"WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """RECORDS' values of one record; lengths and digests are computed again and must match its headers."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    if len(rest) != len(block) + 4 or "sha1:" + hashlib.sha1(block).hexdigest() != head["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    number = lambda x: None if x == f"<{ID}null>" else int(x[len(ID) + 1 : -1])
    page_id, kind = number(head["WARC-Record-ID"]), head["WARC-Type"]
    if kind == "revisit":
        return page_id, int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"][5:], kind, number(head["WARC-Refers-To"])
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha1(payload).hexdigest()
    if "sha1:" + digest != head["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
    return page_id, len(payload), digest, kind, None


def write(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives of pages (page_id, url, html) below folder and commit their manifest, which is returned."""
    bounded_batches(pages.sparkSession)
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= least).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("rep"), F.count("*").alias("n")).where("n > 1 and rep is not null").drop("n")
    first = Step(first, "first-pages").df  # written: a payload that many pages share can then be split in the join
    revisits = large.join(first, "digest").where("page_id is null or page_id <> rep").groupBy("page_id", "digest").agg(F.min("rep").alias("rep"))
    both = rows.select("page_id", "digest", F.lit(1).alias("part"), "url", "payload", F.lit(None).cast("long").alias("rep")).unionByName(
        revisits.select("page_id", "digest", F.lit(0).alias("part"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "rep")
    )
    both = both.repartitionByRange(partitions(spark), "page_id", "digest").sortWithinPartitions("page_id", "digest", "part", "url")

    def put(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, base = FileSystem.from_uri(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
        out, nth, last, rep = None, 0, None, None

        def close():
            out[0].close()
            name = f"part-{shard:06d}-{nth:05d}.warc.gz"
            fs.move(f"{base}/{out[1]}", f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": out[2], "bytes": out[3], "sha1": out[4].hexdigest()}], schema=schema)

        for batch in batches:
            for page_id, digest, part, url, payload, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "part", "url", "payload", "rep"))):
                if part == 0:
                    last, rep = (page_id, digest), to
                    continue
                if last != (page_id, digest):
                    last, rep = (page_id, digest), None
                data = gzip.compress(record(page_id, url, payload, digest, len(payload), rep, date), 6, mtime=0)
                if rep is None and page_id is not None and len(payload) >= least:
                    rep = page_id  # a repeated row revisits the first
                if out is None:
                    name = f".tmp-{shard:06d}-{nth:05d}-{attempt}"
                    out = [fs.open_output_stream(f"{base}/{name}", compression=None), name, 0, 0, hashlib.sha1()]
                out[0].write(data)
                out[2] += 1
                out[3] += len(data)
                out[4].update(data)
                if out[3] >= roll_bytes:
                    yield close()
                    out, nth = None, nth + 1
        if out is not None:
            yield close()

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    both.mapInArrow(put, MANIFEST).write.parquet(f"{folder}/manifest.tmp")
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.tmp"), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")):
        raise RuntimeError(f"{folder} has a manifest already")
    return manifest(spark, folder)


def manifest(spark, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark, folder: str) -> DataFrame:
    """RECORDS of the archives that the folder's manifest lists; a file that differs from the manifest is an error."""

    def get(batches):
        from pyarrow.fs import FileSystem

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def records(path, sha1):
            fs, at = FileSystem.from_uri(path)
            seen, member, parts = hashlib.sha1(), zlib.decompressobj(31), []
            with fs.open_input_stream(at, compression=None) as f:
                while data := f.read(1 << 20):
                    seen.update(data)
                    while data:
                        parts.append(member.decompress(data))
                        data = member.unused_data
                        if member.eof:
                            yield parse(b"".join(parts))
                            member, parts = zlib.decompressobj(31), []
            if parts or seen.hexdigest() != sha1:
                raise ValueError(f"{path} differs from its manifest")

        for batch in batches:
            for path, sha1 in zip(batch.column("path").to_pylist(), batch.column("sha1").to_pylist()):
                rows = []
                for row in records(path, sha1):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return manifest(spark, folder).repartition(partitions(spark)).mapInArrow(get, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """RECORDS read back from archives just written to the shared folder."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write(pages, folder, **options)
    return read(spark, folder)
