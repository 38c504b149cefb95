"""Names, stamps and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the files that are read.
AUDIO_EXTS = ["mp3", "wav", "flac", "ogg", "m4a", "aiff", "aif"]
VIDEO_EXTS = ["mp4", "mov", "mkv", "m4v", "avi", "mts", "m2ts"]
STAMP = r"(?:^|[^0-9])((?:\d{4}|\d{2})\d{4})[_-](\d{6})"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    """The last part of a path, less its suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def album_stem(album: Column) -> Column:
    """A file name for an album: slashes as underscores, no leading dots, never empty."""
    return F.coalesce(F.nullif(F.regexp_replace(F.replace(album, F.lit("/"), F.lit("_")), r"^\.+", ""), F.lit("")), F.lit("collection"))


def start_time(name: Column) -> Column:
    """The wall-clock stamp in a file name, years of two digits after 2000; null without a valid one."""
    day = F.regexp_extract(name, STAMP, 1)
    full = F.when(F.length(day) == 6, F.concat(F.lit("20"), day)).otherwise(day)
    return F.try_to_timestamp(F.concat(full, F.regexp_extract(name, STAMP, 2)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def minutes(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def clip_name(index: Column, file: Column, start: Column) -> Column:
    s = F.floor(start).cast("int")
    return F.format_string("%02d-%s-%02d%02d.wav", index.cast("int"), stem(file), F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def confidence(agreement: Column) -> Column:
    """Band of an agreement: none, strong from 0.75, fair from 0.5, else weak."""
    return F.when(agreement.isNull(), "—").when(agreement >= 0.75, "strong").when(agreement >= 0.5, "fair").otherwise("weak")


def falsy(first: Column, second: Column) -> Column:
    """``first`` unless it is null or zero."""
    return F.coalesce(F.nullif(first, F.lit(0.0)), second)


def note(key: Column, tempo: Column, pulse_bpm: Column, pulse_r: Column) -> Column:
    """"key · ~bpm bpm", the tilde where the pulse is loose."""
    bpm = falsy(tempo, F.nullif(pulse_bpm, F.lit(0.0)))
    text = F.when(bpm.isNotNull(), F.concat(F.when(F.coalesce(pulse_r, F.lit(0.0)) < 0.1, "~").otherwise(""), F.format_string("%.0f bpm", bpm)))
    return F.concat_ws(" · ", F.nullif(key, F.lit("")), text)
