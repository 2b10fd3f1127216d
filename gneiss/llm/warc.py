"""WARC archives: written per partition with an index, read back through coalesced byte ranges.

Writing first finds, on a thin table of digests, which records revisit an earlier equal payload;
then each task writes one gzip-member-per-record archive into the shared folder and returns its
index rows (file, offset, length, url, digest). A file name carries the task attempt, and only the
index rows of the attempt that Spark commits are kept, so repeated or lost tasks leave at most an
unreferenced file. Reading starts from the index: selected records are sorted by offset, runs with
small gaps become one range, every range is read once and its members parsed.

The folder may be on any store that pyarrow's file systems open (file, hdfs, s3, gs).

Defined results: null html is an empty payload; a null url leaves the target header out; rows that
share both page_id and payload with the response are responses too; rows without page_id are
responses without a record id; rows that share a page_id but not the payload are records of their own,
with one record id; an empty table gives an empty index. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_back, scratch, stored

INDEX = "page_id bigint, url string, payload_digest string, record_type string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than GAP are read as one; a range begins anew at each multiple of BLOCK.
GAP, BLOCK = 1 << 16, 1 << 23


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of every record whose payload an earlier page_id has too."""
    thin = pages.where(F.octet_length(_payload()) >= least_bytes).select("page_id", F.sha1(_payload()).alias("digest"))
    thin = stored(thin, "digests")
    groups = thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups, total = stored(groups, "copies"), thin.count()
    return join_back(thin, groups, ["digest"], "n", total).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str, str]:
    """The record's bytes, its type and its payload digest."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", kind, digest


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, level: int = 1) -> DataFrame:
    """Writes the archives under ``folder`` (by default in the shared folder) and returns the stored index."""
    folder = folder or f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", "html", F.sha1(_payload()).alias("digest")).join(revisits(pages, least_bytes), ["page_id", "digest"], "left")
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]

    def run(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name, out, offset = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, 0
        for batch in batches:
            index = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, kind, digest = record(page_id, url, (html or "").encode(), refers_to)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = pack.compress(raw) + pack.flush()
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(raw)
                index.append((page_id, url, digest, kind, f"{folder}/{name}", offset, len(raw)))
                offset += len(raw)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names)
        if out:
            out.close()

    return stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "warc-index")


def parse(raw: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload_bytes, digest, payload) of one record; a response's digest is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x else None
    url = fields.get("WARC-Target-URI")
    return number(fields.get("WARC-Record-ID")), unquote(url) if url is not None else None, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), size, digest, payload


def read(selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the index rows ``selected`` point to."""
    per_file = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.struct((F.col("offset") + F.col("length")).alias("end"), F.floor(F.col("offset") / BLOCK).alias("block"))).over(per_file)
    rows = selected.select("file", "offset", "length").distinct().withColumn("_p", before)
    new = (F.col("offset") - F.col("_p.end") > GAP) | (F.floor(F.col("offset") / BLOCK) != F.col("_p.block"))
    rows = rows.withColumn("_r", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(per_file))
    ranges = rows.groupBy("file", "_r").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at")).select("file", "at")
    total = selected.agg(F.sum("length")).first()[0] or 0
    ranges = ranges.repartition(1 + total // BLOCK)  # the ranges are few bytes for Spark, what they stand for isn't
    schema = RECORD + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    width = len(names)

    def run(batches):
        for batch in batches:
            for file, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = _store(file)
                with store.open_input_file(path) as source:
                    first = at[0]["offset"]
                    source.seek(first)
                    got = source.read(at[-1]["offset"] + at[-1]["length"] - first)
                rows = [parse(zlib.decompress(got[x["offset"] - first : x["offset"] - first + x["length"]], 31))[:width] for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    return ranges.mapInArrow(run, schema)
