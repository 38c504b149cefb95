"""The segment verb: from decoded recordings to seconds, songs, regions and the pieces to cut, all as tables.

A session is a folder; its files follow one another in the order of their paths, butted together on one clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import clip_name
from ..operators import segments
from ..operators.features import frames
from ..sources.audio import decode, read_wav, scan_recordings, write_wav
from ..sources.headers import with_start_times


def seconds(f: DataFrame, hop_s: float = 1.0) -> DataFrame:
    """A row each whole stretch of ``hop_s`` of a file's frames: level in dB, log10 of the mean flatness, mean and spread of log10 flatness, centroid.

    A frame belongs to the stretch its time falls in, so stretches don't drift from the clock; a last one that isn't whole is dropped.
    """
    flat = F.log10(F.col("flatness") + 1e-12)
    level = 20 * F.log10(F.greatest(F.avg("rms"), F.lit(1e-5)))
    stretch = F.floor(F.round(F.col("t") / hop_s, 9)).cast("long")
    rows = f.groupBy(F.concat_ws("/", "album", "track").alias("recording"), stretch.alias("frame")).agg(F.max("duration_s").alias("duration_s"), level.alias("level"), F.log10(F.avg("flatness") + 1e-12).alias("log_mean"), F.avg(flat).alias("flatness"), F.stddev_pop(flat).alias("variability"), F.avg("centroid").alias("centroid"))
    return rows.filter(F.col("frame") < F.floor(F.col("duration_s") / hop_s))


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`seconds` with is_music and label."""
    return segments.classify(segments.music_mask(rows, "level", "log_mean"), "level", "flatness", "variability")


def session_files(recordings: DataFrame, rows: DataFrame) -> DataFrame:
    """(session, file, file_idx, path, duration, started) of scanned recordings; one without any whole stretch lasts 0 seconds here."""
    length = rows.groupBy(F.col("recording").alias("file")).agg(F.max("duration_s").alias("duration"))
    files = recordings.select(F.col("album").alias("session"), F.concat_ws("/", "album", "track").alias("file"), "file_idx", "path", "started")
    return files.join(length, "file", "left").withColumn("duration", F.coalesce("duration", F.lit(0.0)))


def find_songs(labels: DataFrame, files: DataFrame, hop_s: float = 1.0, min_song_s: float = 60.0, min_gap_s: float = 12.0, tolerance: float = 5.0) -> DataFrame:
    """(session, index, start, end, duration, parts, clip) in seconds on the session's clock; parts are offsets in their files."""
    spans = segments.segments(labels, min_gap_s / hop_s, 0.0)
    own = spans.select(F.col("recording").alias("file"), (F.col("start") * hop_s).alias("start"), (F.col("end") * hop_s).alias("end"))
    songs = segments.join_across(own, files, tolerance, min_song_s)
    return songs.withColumn("clip", clip_name(F.col("index"), F.element_at("parts", 1)["file"], F.col("start")))


def map_regions(labels: DataFrame, files: DataFrame, songs: DataFrame | None = None, hop_s: float = 1.0, min_s: float = 5.0) -> DataFrame:
    """(session, label, start, end) in seconds over whole sessions without flickers; where ``songs`` are given, they decide where music is."""
    n = F.floor(F.col("duration") / hop_s).cast("long")
    before = F.sum(n).over(Window.partitionBy("session").orderBy("file_idx")) - n
    at = files.select("session", F.col("file").alias("recording"), before.alias("_at"))
    clock = labels.join(at, "recording").select(F.col("session").alias("recording"), (F.col("frame") + F.col("_at")).alias("frame"), "label")
    if songs is not None:
        stretch = lambda c: F.bround(F.col(c) / hop_s).cast("long").alias(c)
        clock = segments.paint(clock, songs.select(F.col("session").alias("recording"), stretch("start"), stretch("end")).filter("start < end"))
    spans = segments.regions(clock, min_s / hop_s)
    return spans.select(F.col("recording").alias("session"), "label", (F.col("start") * hop_s).alias("start"), (F.col("end") * hop_s).alias("end"))


def span_name(label: Column, start: Column, end: Column, started: Column) -> Column:
    """The wall clock and label where the start of the session is known, else the minutes of both ends and the label."""
    clock = lambda s: F.format_string("%02d%02d", F.floor(s / 60).cast("int"), F.pmod(F.floor(s).cast("int"), F.lit(60)))
    when = F.date_format(F.timestamp_add("SECOND", F.floor(start).cast("int"), started), "yyyyMMdd_HHmmss")
    return F.concat(F.coalesce(when, F.concat(clock(start), F.lit("-"), clock(end))), F.lit(" "), label, F.lit(".wav"))


def region_pieces(spans: DataFrame, files: DataFrame, exclude: list[str] = ("music",), width: float = 600.0) -> DataFrame:
    """(session, name, part, path, start, end): what to cut from which file for each span whose label isn't excluded."""
    order = Window.partitionBy("session").orderBy("file_idx")
    bounds = files.withColumn("end", F.sum("duration").over(order)).withColumn("start", F.col("end") - F.col("duration"))
    first = files.filter("file_idx = 0").select("session", "started")
    s = spans.filter(~F.col("label").isin(list(exclude))).join(first, "session", "left")
    s = s.select(F.col("session").alias("recording"), F.struct("start", "label", span_name(F.col("label"), F.col("start"), F.col("end"), F.col("started")).alias("name")).alias("span_id"), "start", "end")
    b = bounds.filter("duration > 0").select(F.col("session").alias("recording"), F.struct("file_idx", "path", F.col("start").alias("at")).alias("part_id"), "start", "end")
    o = segments.overlap(s, b, width, 0.05)
    at = F.col("part_id.at")
    return o.select(F.col("recording").alias("session"), "span_id.name", F.col("part_id.file_idx").alias("part"), "part_id.path", (F.col("start") - at).alias("start"), (F.col("end") - at).alias("end"))


def song_pieces(songs: DataFrame, files: DataFrame) -> DataFrame:
    """(session, name, part, path, start, end): what to cut from which file for each song."""
    p = songs.select("session", F.col("clip").alias("name"), F.explode("parts").alias("p")).select("session", "name", F.col("p.file").alias("file"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    return p.join(files.select("session", "file", "file_idx", "path"), ["session", "file"]).select("session", "name", F.col("file_idx").alias("part"), "path", "start", "end")


def cut_pieces(pieces: DataFrame, root: str) -> DataFrame:
    """(session, name, part, sr, wav) of each piece; a file is read once for all its pieces, its channels kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for session, content, own in zip(pdf["session"], pdf["content"], pdf["own"], strict=True):
                x, sr = read_wav(content)
                for p in own:
                    yield pd.DataFrame([(session, p["name"], p["part"], sr, write_wav(x[:, int(p["start"] * sr) : int(p["end"] * sr)], sr))], columns=["session", "name", "part", "sr", "wav"])

    by_file = pieces.groupBy("session", "path").agg(F.collect_list(F.struct("name", "part", "start", "end")).alias("own"))
    content = pieces.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return content.join(by_file, "path").select("session", "content", "own").mapInPandas(run, "session string, name string, part int, sr int, wav binary")


def segment(spark: SparkSession, root: str, out: str, hop_s: float = 1.0, min_song_s: float = 60.0, min_gap_s: float = 12.0, chunk_s: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(songs, regions) of the sessions below ``root``, also written as JSON lines to ``out``/songs and ``out``/regions; audio is decoded once, for ``out``/seconds."""
    recordings = with_start_times(scan_recordings(spark, root))
    seconds(frames(decode(recordings, chunk_s=chunk_s, up=False)), hop_s).write.mode("overwrite").parquet(f"{out}/seconds")
    rows = spark.read.parquet(f"{out}/seconds")
    labels, files = labelled(rows), session_files(recordings, rows)
    songs = find_songs(labels, files, hop_s, min_song_s, min_gap_s)
    songs.write.mode("overwrite").json(f"{out}/songs")
    map_regions(labels, files, songs, hop_s).write.mode("overwrite").json(f"{out}/regions")
    return tuple(spark.read.schema(s).json(f"{out}/{n}") for n, s in (("songs", songs.schema), ("regions", "session string, label string, start double, end double")))
