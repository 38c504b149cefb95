"""The verbs over a folder of recordings: probe, extract, report; results as tables, JSON, Markdown and SVG."""

from __future__ import annotations

from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, structure, timbre
from ..operators.clustering import pca
from ..operators.features import FEATURES, LOG_FEATURES, guarded_frames, track_features, windowed
from ..sources.audio import scan_collection

# Colours by order of first appearance.
PALETTE = ["#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5"]


def tracks_of(spark: SparkSession, root: str) -> DataFrame:
    """The tracks of ``root``; a folder without any is an error."""
    tracks = scan_collection(spark, root)
    if tracks.isEmpty():
        raise FileNotFoundError(f"no audio files under {root}")
    return tracks


def probe(spark: SparkSession, root: str, shown: int = 8) -> DataFrame:
    """Tracks and bytes of each album, and its first ``shown`` tracks by name; nothing is decoded."""
    tracks = tracks_of(spark, root)
    first = structure.first_of_each(tracks.select("album", "track"), "album", "track", shown).groupBy("album").agg(F.array_sort(F.collect_list("track")).alias("tracks"))
    return tracks.groupBy("album").agg(F.count("*").alias("n_tracks"), F.sum("length").alias("bytes")).join(first, "album")


def extract(spark: SparkSession, root: str, out: str | None = None, duration: float | None = None, force: bool = False, retry_cap_s: float | None = 600.0, memory_mb: int | None = 4096) -> DataFrame:
    """The features of every track of ``root``, and error where a track has none; kept as Parquet in ``out`` if given, and read from there if it was written before, unless ``force``."""
    if out and not force and written(spark, out):
        return spark.read.parquet(out)
    tracks = tracks_of(spark, root)
    own = guarded_frames(tracks, duration, retry_cap_s, memory_mb).persist(StorageLevel.DISK_ONLY)
    heard = own.filter("error is null")
    f = track_features(heard).join(windowed(heard), ["album", "track"], "left").join(timbre.profile_maps(timbre.sound_objects(heard)), ["album", "track"], "left")
    f = f.unionByName(own.filter("error is not null").select("album", "track", "error"), allowMissingColumns=True)
    if out:
        f.write.mode("overwrite").parquet(out)
        own.unpersist()
        f = spark.read.parquet(out)
    return f


def written(spark: SparkSession, folder: str) -> bool:
    """Whether ``folder`` holds a table that was written to its end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def landscape_svg(coords: DataFrame, album: str, size: int = 480, cells: int = 120) -> str:
    """A scatter of pc1 and pc2 coloured by album: one dot for each colour and cell of a grid, larger where it holds more tracks."""
    e = coords.agg(*[f(c).alias(f"{n}_{c}") for c in ("pc1", "pc2") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    place = lambda c: F.floor((F.col(c) - e[f"lo_{c}"]) / max(e[f"hi_{c}"] - e[f"lo_{c}"], 1e-9) * (cells - 1) + 0.5)
    names = corpus.numbered_names(coords, album, "_place")
    tone = (F.col("_place") - 1) % len(PALETTE)
    rows = coords.join(names, album).groupBy(tone.alias("tone"), place("pc1").alias("x"), place("pc2").alias("y")).agg(F.count("*").alias("n")).orderBy("tone", "x", "y").collect() if e["lo_pc1"] is not None else []
    at = lambda v: 20 + v / (cells - 1) * (size - 40)
    dots = "".join(f'<circle cx="{at(r["x"]):.1f}" cy="{size - at(r["y"]):.1f}" r="{min(12.0, 4 + r["n"] ** 0.5):.1f}" fill="{PALETTE[r["tone"]]}"/>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{dots}</svg>'


def report(features: DataFrame, out: str | Path, title: str) -> Path:
    """README.md, album_stats.json and landscape.svg of a table of features; album-level rows and a catalogue's points reach the driver."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    f = (features.filter("error is null") if "error" in features.columns else features).cache()
    stats = corpus.album_stats(f, "album", FEATURES).join(corpus.conditional_share(f, "album", F.col("key").contains("minor"), "minor_share"), "album").orderBy("album")
    rows = stats.collect()
    z = corpus.zscore(f, FEATURES, LOG_FEATURES).withColumn("_v", F.array(*[f"z_{c}" for c in FEATURES]))
    own = {r["album_a"]: r["affinity"] for r in corpus.album_affinity(z, "album", "_v").filter("album_a = album_b").collect()}
    coords, explained, _ = pca(f, FEATURES, keep=["album", "track"])
    (folder / "landscape.svg").write_text(landscape_svg(coords, "album"))
    (folder / "album_stats.json").write_text("[" + ",\n".join(r[0] for r in stats.select(F.to_json(F.struct("*"))).collect()) + "]")
    lines = [f"# {title}", "", f"{sum(r['n_tracks'] for r in rows)} tracks in {len(rows)} albums.", "", "| album | tracks | notes/s | centroid Hz | dynamics dB | minor keys | consistency |", "|---|---|---|---|---|---|---|"]
    lines += [f"| {r['album']} | {r['n_tracks']} | {r['onset_rate_mean']:.2f} | {r['centroid_hz_mean']:.0f} | {r['dyn_range_db_mean']:.1f} | {r['minor_share']:.0%} | {own[r['album']]:+.2f} |" for r in rows]
    lines += ["", f"Two components hold {explained[0]:.0%} and {explained[1]:.0%} of the variance.", "", "## Extremes", ""]
    ext = corpus.extremes(f.withColumn("_o", F.xxhash64("album", "track")), ["onset_rate", "centroid_hz", "pulse_R", "dyn_range_db"], "_o", F.concat_ws(" / ", "album", "track"))
    lines += [f"- {r['feature']}: largest {r['largest']}, smallest {r['smallest']}" for r in ext.collect()]
    (folder / "README.md").write_text("\n".join(lines) + "\n")
    return folder / "README.md"
