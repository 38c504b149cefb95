"""Folders of recordings as DataFrames: listing, decoding in chunks, and a generated collection."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from os.path import commonprefix
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.naming import AUDIO_EXTS, VIDEO_EXTS, extension, start_time, stem

CHUNKS = "path string, album string, track string, chunk int, start_s double, sr int, duration_s double, heard_s double, before int, own int, extent array<double>, samples array<float>, capped_s double, error string"
_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
#: Samples a second that tracks are analysed at.
RATE = 22050


def scan_collection(spark: SparkSession, root: str, exclude: list[str] = (), suffixes: list[str] = AUDIO_EXTS) -> DataFrame:
    """(path, album, track, length): the audio files below ``root``; an album is the folder's path below it, "." for the root itself. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)  # a folder that doesn't exist is an error here
    base = root.rstrip("/")
    below = F.regexp_replace(F.col("path"), "^(file:)?/*", "/")
    inner = F.substring(below, len("/" + base.split(":", 1)[-1].lstrip("/")) + 2, 1 << 20)
    df = files.select(F.col("path"), inner.alias("_below"), "length", "modificationTime").filter(extension(F.col("path")).isin(suffixes))
    for folder in exclude:
        df = df.filter(~F.col("_below").startswith(folder.strip("/") + "/"))
    album = F.regexp_extract("_below", r"^(.*)/[^/]*$", 1)
    return df.select("path", F.when(album == "", ".").otherwise(album).alias("album"), stem(F.col("_below")).alias("track"), "length", "modificationTime")


def scan_recordings(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """The collection's files and videos in playing order (by path within an album) with their start times."""
    df = scan_collection(spark, root, exclude, AUDIO_EXTS + VIDEO_EXTS)
    return df.withColumn("file_idx", F.row_number().over(Window.partitionBy("album").orderBy("path")) - 1).withColumn("started", start_time(F.regexp_extract("path", r"([^/]*)$", 1)))


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(channels x samples in [-1, 1], sample rate)."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, sr = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels).T, sr


def samples_of(content: bytes) -> tuple[np.ndarray, int]:
    """(mono samples, sample rate) of a file's contents."""
    x, sr = read_wav(content)
    return x.mean(axis=0), sr


def write_wav(samples: np.ndarray, sr: int) -> bytes:
    """16-bit PCM of a mono or (channels, n) signal."""
    out = io.BytesIO()
    x = np.atleast_2d(samples)
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(x.T, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chunks_of(path: str, album: str, track: str, content: bytes, chunk_s: float = 60.0, offset: float = 0.0, duration: float | None = None, trim_db: float | None = None, capped: bool = False, rate: int | None = RATE, up: bool = True) -> Iterator[pd.DataFrame]:
    """The chunks of one file at ``rate`` (its own if None, or if it is lower and not ``up``): whole frames each, with the frames and the extent of the track that theirs depend on."""
    y, sr = samples_of(content)
    y = y[int(offset * sr) :]
    y = y if duration is None else y[: int(duration * sr)]
    if rate is not None and (up or sr > rate):
        y, sr = dsp.resampled(y, sr, rate), rate
    heard = y if trim_db is None else y[dsp.audible(y, trim_db)]
    whole, n, step = dsp.extent(heard, sr), dsp.n_frames(len(heard)), max(1, int(chunk_s * sr) // dsp.HOP)
    for i, a in enumerate(range(0, n, step)):
        b = min(a + step, n)
        before, after = min(dsp.CONTEXT, a), min(dsp.CONTEXT, n - b)
        samples = dsp.around(heard, a - before, b + after).astype(np.float32)
        yield pd.DataFrame([(path, album, track, i, a * dsp.HOP / sr, sr, len(y) / sr, len(heard) / sr, before, b - a, [whole.power, whole.mel, whole.low, whole.high], samples, duration if capped else None, None)], columns=_COLUMNS)


def with_contents(files: DataFrame) -> DataFrame:
    """``files`` (path, album, track) with their contents, read by one scan of the folder that they share."""
    # of each store, the folder that all its files lie in: what the least and the greatest path have in common
    store = F.regexp_extract("path", r"^([^/]*:(?://[^/]+)?)?/", 1)
    ends = files.groupBy(store).agg(F.min("path").alias("a"), F.max("path").alias("b")).collect()
    roots = [commonprefix([r["a"], r["b"]]).rpartition("/")[0] + "/" for r in ends]
    content = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true")
    loaded = content.load(roots) if roots else files.withColumn("content", F.lit(b""))
    if roots and "length" in files.columns:  # longer files, of other folders, aren't read
        loaded = loaded.filter(F.col("length") <= files.agg(F.max("length")).first()[0])
    return files.select("path", "album", "track").join(loaded.select(F.col("path"), F.col("content")), "path")


def decode(files: DataFrame, chunk_s: float = 60.0, offset: float = 0.0, duration: float | None = None, trim_db: float | None = None, rate: int | None = RATE, up: bool = True) -> DataFrame:
    """The mono samples of ``files`` (path, album, track), at ``rate`` (their own if None, or if it is lower and not ``up``), a row a chunk, silence at both ends trimmed below ``trim_db`` if given. A file that can't be read is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, album, track, content in zip(pdf["path"], pdf["album"], pdf["track"], pdf["content"], strict=True):
                try:
                    yield from chunks_of(path, album, track, content, chunk_s, offset, duration, trim_db, rate=rate, up=up)
                except Exception as e:  # noqa: BLE001 - any file may be broken in any way
                    yield pd.DataFrame([(path, album, track, 0, 0.0, 0, None, None, 0, 0, None, None, None, f"{type(e).__name__}: {e}")], columns=_COLUMNS)

    return with_contents(files).mapInPandas(run, CHUNKS)


def plucks(seconds: float, spacing: float, freq: float, seed: int = 0, sr: int = 22050) -> np.ndarray:
    """Decaying tones at even spacing over a little noise."""
    t = np.arange(int(seconds * sr)) / sr
    since = t % spacing
    return (0.6 * np.exp(-8 * since) * np.sin(2 * math.pi * freq * since) + 1e-4 * np.random.default_rng(seed).standard_normal(len(t))).astype(np.float32)


def drone(seconds: float, freq: float, am: float = 0.2, seed: int = 0, sr: int = 22050) -> np.ndarray:
    """A tone whose level swells slowly, over a little noise."""
    t = np.arange(int(seconds * sr)) / sr
    return (0.3 * (1 + 0.5 * np.sin(2 * math.pi * am * t)) * np.sin(2 * math.pi * freq * t) + 1e-4 * np.random.default_rng(seed).standard_normal(len(t))).astype(np.float32)


def demo_collection(folder: str | Path, seconds: float = 10.0, sr: int = 22050) -> Path:
    """Two albums of three tracks each: plucked strings and drones."""
    root = Path(folder)
    for album, make, tones in (("harp", lambda f, i: plucks(seconds, 0.3, f, i, sr), (196, 262, 330)), ("organ", lambda f, i: drone(seconds, f, 0.2, 20 + i, sr), (98, 131, 165))):
        (root / album).mkdir(parents=True, exist_ok=True)
        for i, f in enumerate(tones):
            (root / album / f"{i + 1:02d} {f} Hz.wav").write_bytes(write_wav(make(f, i), sr))
    return root
