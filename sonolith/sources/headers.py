"""Creation times from the headers of MP4 and QuickTime files, read by ranges: payloads are skipped, never loaded."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1904, 1, 1)
Read = Callable[[int, int], bytes]


def _boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of contents, end) of the boxes between two places; a box that runs beyond the end, or no box, ends them."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", read(at, 8))
        head = 8
        if size == 1:
            (size,), head = struct.unpack(">Q", read(at + 8, 8)), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def creation_time(read: Read, length: int) -> datetime | None:
    """The UTC time in the movie header of a file of ``length`` bytes; None where there is none or it is zero."""
    for kind, start, end in _boxes(read, 0, length):
        if kind != b"moov":
            continue
        for inner, a, b in _boxes(read, start, end):
            if inner == b"mvhd" and b - a >= 12:
                version = read(a, 1)[0]
                seconds = struct.unpack(">Q", read(a + 4, 8))[0] if version == 1 else struct.unpack(">I", read(a + 4, 4))[0]
                return EPOCH + timedelta(seconds=seconds) if 0 < seconds < 1 << 38 else None
    return None


def created(files: DataFrame, zone: str | None = None) -> DataFrame:
    """``files`` (path and others) with created_utc, and created, the wall time in ``zone`` (the session's if none); null where a file says nothing or can't be read by ranges."""
    zone = zone or files.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                    with store.open_input_file(inner) as f:
                        out.append(creation_time(lambda at, n, f=f: f.read_at(n, at), f.size()))
                except (OSError, ValueError, struct.error, IndexError):
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "created_utc": pd.Series(out, dtype="datetime64[us]")})

    found = files.select("path").distinct().mapInPandas(run, "path string, created_utc timestamp_ntz")
    return files.join(found, "path", "left").withColumn("created", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("created_utc")))


def with_start_times(recordings: DataFrame, zone: str | None = None) -> DataFrame:
    """``recordings`` with started from the file's name, else from its header."""
    known = created(recordings, zone)
    return known.withColumn("started", F.coalesce("started", F.col("created").cast(recordings.schema["started"].dataType))).drop("created", "created_utc")
