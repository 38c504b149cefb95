"""WARC archives as a PySpark data source, and writing pages with revisit records.

``spark.read.format("warc").load(folder)`` plans one partition for each run of archive files of about ``partitionBytes``
(option, 64 MB), takes record-type and header predicates (equality and IN on record_type, url, payload_digest,
refers_to, record_id) into the scan, inflates headers first, and leaves the payload of a record that it does not want
compressed where the member says how long it is. ``columns`` (option) names the columns wanted; without ``payload`` no
payload is decoded. The source writes one gzip member a record; a task's file becomes visible only when the job's
manifest names it, so lost and repeated tasks leave nothing behind. Paths go through Arrow's file systems (local, HDFS,
S3, GCS).

Defined results: a null html has an empty payload; of equal payloads the smallest page_id is the response (every row
with that page_id, if it repeats) and the others revisit it; a row without page_id revisits the smallest other, or is a
response if there is none; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import ensure_checkpoint_dir

SCHEMA = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"
MANIFEST = "_manifest.json"
_HEADERS = {"record_id": b"WARC-Record-ID", "record_type": b"WARC-Type", "url": b"WARC-Target-URI", "payload_digest": b"WARC-Payload-Digest", "refers_to": b"WARC-Refers-To"}


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> bytes:
    """A header value: line breaks would end the header."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A").encode()


def record(row: dict) -> bytes:
    """A gzip member: the WARC and HTTP headers, and the payload of a response. The extra field SL holds the member's length and that of its headers."""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    payload = b"" if revisit else row["payload"]
    head = [b"WARC/1.1", b"WARC-Type: " + row["record_type"].encode(), b"WARC-Record-ID: <" + _clean(row["record_id"]) + b">", b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + _clean(row["url"]), b"WARC-Payload-Digest: sha1:" + row["payload_digest"].encode()]
    if revisit:
        head += [b"WARC-Refers-To: <" + _clean(row["refers_to"]) + b">", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % (len(http) + len(payload))]
    top = b"\r\n".join(head) + b"\r\n\r\n" + http
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(top) + deflate.flush(zlib.Z_FULL_FLUSH) + deflate.compress(payload + b"\r\n\r\n") + deflate.flush()
    whole = top + payload + b"\r\n\r\n"
    size = 10 + 2 + 4 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, size, len(top)) + body + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        name, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    member = record(row)
                    out.write(member)
                    size += len(member)
        return _Written(name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        files = [] if self.overwrite else _manifest(self.path, fs, root)
        files += [[m.path, m.size] for m in messages if m is not None]
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.path}")


def _manifest(path: str, fs: pafs.FileSystem, root: str) -> list[list]:
    """[name, bytes] of the archive's files: what the manifest names, or any .warc.gz where there is none."""
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            return json.loads(f.read())
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return [[x.path[len(root) :].lstrip("/"), x.size] for x in found if x.path.endswith(".warc.gz")]


@dataclass
class _Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.wanted = set(options.get("columns", "record_id,record_type,url,payload_digest,payload_bytes,refers_to,payload").split(","))
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.must: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                own = self.must.get(f.attribute[0])
                self.must[f.attribute[0]] = values if own is None else own & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _file_system(self.path)
        plan, size = [[]], 0
        for name, n in sorted(_manifest(self.path, fs, root)):
            if plan[-1] and size + n > self.bytes:
                plan.append([])
                size = 0
            plan[-1].append(name)
            size += n
        return [_Files(names) for names in plan]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(self.path)
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as f:
                for row in _records(f, self.must, "payload" in self.wanted):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _parsed(top: bytes) -> tuple[dict, int]:
    """The fields of the WARC and HTTP headers, and the length of the record's block."""
    lines = dict(x.split(b": ", 1) for x in top.split(b"\r\n") if b": " in x and not x.startswith(b"Content-Length"))
    lengths = [int(x[15:]) for x in top.split(b"\r\n") if x.startswith(b"Content-Length:")]
    row = {k: lines.get(h, b"").decode().strip("<>") if h in lines else None for k, h in _HEADERS.items()}
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:")
    return row | {"payload_bytes": lengths[-1] if len(lengths) > 1 else lengths[0], "payload": None}, lengths[0]


def _records(f: pa.NativeFile, must: dict[str, set], payloads: bool) -> Iterator[dict]:
    """The records of an archive whose headers fit; a member that names its length is left as soon as its payload isn't wanted."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        data = f.read(1 << 14)
        extra = 12 + struct.unpack_from("<H", data, 10)[0] if data[3] & 4 else 10
        size, length = struct.unpack_from("<II", data, 16) if data[3] & 4 and data[12:14] == b"SL" else (None, None)
        inflate = zlib.decompressobj(-15)
        data = data[extra:] if size is None else data[extra : size - 8]
        whole = b""
        done = lambda b: (length is not None and len(b) >= length) or (length is None and b"\r\n\r\n" in b and b"\r\n\r\n" in b[b.index(b"\r\n\r\n") + 4 :])
        left = None if size is None else size - 8 - extra - len(data)
        while data and not done(whole):
            whole += inflate.decompress(data, 1 << 14)
            data = inflate.unconsumed_tail
            if not data and not inflate.eof and not done(whole):
                data = f.read(1 << 14 if left is None else min(1 << 14, left))
                left = None if left is None else left - len(data)
        cut_at = length or whole.index(b"\r\n\r\n", whole.index(b"\r\n\r\n") + 4) + 4
        row, block = _parsed(whole[:cut_at])
        want = all(row.get(k) in v for k, v in must.items())
        if size is None or (want and payloads and row["record_type"] == "response"):
            parts = [whole[cut_at:]]
            while not inflate.eof:
                if not data:
                    data = f.read(1 << 20 if left is None else min(1 << 20, left))
                    left = None if left is None else left - len(data)
                    if not data:
                        break
                parts.append(inflate.decompress(data))
                data = inflate.unconsumed_tail
            if size is None:
                at = f.tell() - len(inflate.unused_data) + 8
            if want and payloads and row["record_type"] == "response":
                row["payload"] = b"".join(parts)[: row["payload_bytes"]]
        if size is not None:
            at += size
        if want:
            yield row


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """The records of ``pages``: equal payloads of at least ``least_bytes`` bytes are written once, as the response of the smallest page_id."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    first = p.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    by_id = p.select("page_id", "url", "payload", "sha").join(first.withColumnRenamed("sha", "_sha"), F.col("sha") == F.col("_sha"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return by_id.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "url",
        base32(F.col("sha")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def _base32(shas: pd.Series) -> pd.Series:
    return shas.map(lambda x: None if x is None else base64.b32encode(x).decode())


def base32(sha: Column) -> Column:
    """Upper-case base32 of a SHA-1."""
    return F.pandas_udf(_base32, "string")(sha)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages`` to the folder ``path``."""
    register(pages.sparkSession)
    with_revisits(pages, least_bytes=least_bytes).write.format("warc").mode("overwrite").save(path)


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    register(spark)
    r = spark.read.format("warc").option("partitionBytes", str(partition_bytes))
    df = (r.option("columns", ",".join(columns)) if columns else r).load(path)
    return df.select(*columns) if columns else df


def archive_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an archive in the cluster's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
