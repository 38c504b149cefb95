"""Tonal space, stereo fields and file headers."""

import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import harmony, space
from sonolith.sources.audio import plucks, scan_collection, scan_recordings, write_wav
from sonolith.sources.headers import created, creation_time, with_start_times

SR = 22050


def test_circle_of_fifths_closes(spark):
    rows = [(k, [1.0 if i == 7 * k % 12 else 0.0 for i in range(12)]) for k in range(13)] + [(13, [1.0] * 12), (14, [0.0] * 12)]
    df = spark.createDataFrame(rows, "k int, c array<double>")
    out = {r.k: np.array(r.t) for r in df.select("k", F.array(*harmony.tonnetz([F.element_at("c", i + 1) for i in range(12)])).alias("t")).collect()}
    assert np.allclose(out[0], out[12]) and np.allclose(out[13], 0) and not out[14].any()
    steps = [np.linalg.norm(out[k + 1][:2] - out[k][:2]) for k in range(12)]
    assert np.allclose(steps, 2 * np.sin(np.pi / 12)) and np.allclose([np.linalg.norm(out[k][:2]) for k in range(12)], 1)
    assert all(np.isclose(np.hypot(*out[k][4:]), 0.5) for k in range(12))


def test_tonnetz_path(spark):
    c = [[1.0 if i == 7 * (f // 100) % 12 else 0.0 for i in range(12)] for f in range(1200)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(c)], "recording string, frame long, c array<double>")
    path = harmony.tonnetz_path(df, ["recording"], [F.element_at("c", i + 1) for i in range(12)]).orderBy("point").toPandas()
    assert len(path) == 400 and (path["frame"] == 3 * path["point"]).all() and np.hypot(path["x"], path["y"]).max() < 1 + 1e-9
    raw = np.array([(np.sin(np.pi * 7 / 6 * (7 * (f // 100) % 12)), np.cos(np.pi * 7 / 6 * (7 * (f // 100) % 12))) for f in range(0, 1200, 3)])
    assert np.allclose(path[["x", "y"]], [raw[max(0, i - 3) : i + 4].mean(axis=0) for i in range(400)])


@pytest.mark.parametrize("chunk_s", [2.0, 60.0])
def test_a_tone_lands_in_its_bin(spark, tmp_path, chunk_s):
    t = np.arange(SR * 6) / SR
    tones = {f"{k}": 65.40639132514966 * 2 ** (k / 36) for k in (0, 36, 72, 79, 108, 144, 170)}
    for name, hz in tones.items():
        (tmp_path / f"{name}.wav").write_bytes(write_wav(0.4 * np.sin(2 * np.pi * hz * t), SR))
    out = harmony.helix(scan_collection(spark, str(tmp_path)), chunk_s=chunk_s).toPandas()
    assert len(out) == 180 * len(tones)
    for name, g in out.groupby("track"):
        top = g.loc[g["energy"].idxmax()]
        assert top["bin"] == int(name) and abs(top["energy"] - 1) < 1e-6 and abs(top["hz"] / tones[name] - 1) < 1e-9
        assert np.isclose(top["angle"], 2 * np.pi * (int(name) % 36) / 36) and np.isclose(top["radius"], 0.3 + int(name) / 180)
        assert (g[(g["bin"] - int(name)).abs() > 4]["energy"] < 0.05).all()


def test_stereo_of_a_panned_track(spark, tmp_path):
    y = plucks(12.0, 0.25, 330.0)
    pan = np.linspace(0.1, 0.9, len(y))
    made = {"panned": np.stack([y * (1 - pan), y * pan]), "mono": y, "right": np.stack([0 * y, y]), "apart": np.stack([y, -y]), "three": np.stack([y, y, -y])}
    for name, x in made.items():
        (tmp_path / f"{name}.wav").write_bytes(write_wav(x, SR))
    tracks = scan_collection(spark, str(tmp_path))
    rows = space.stereo_frames(tracks, chunk_s=5.0).cache()
    whole = space.stereo_frames(tracks, chunk_s=100.0).toPandas().sort_values(["track", "frame"], ignore_index=True)
    cut = rows.toPandas().sort_values(["track", "frame"], ignore_index=True)
    assert np.allclose(cut[["width", "correlation"]], whole[["width", "correlation"]]) and np.allclose(np.stack(cut["pan"]), np.stack(whole["pan"]), atol=1e-4)
    mean = cut.groupby("track")[["width", "correlation"]].mean()
    assert mean.loc["mono", "width"] < 1e-6 and mean.loc["mono", "correlation"] > 0.99 and mean.loc["apart", "width"] > 0.99 and mean.loc["apart", "correlation"] < -0.99
    assert cut.groupby("track")["mono"].first().to_dict() == {"panned": False, "mono": True, "right": False, "apart": False, "three": True}
    loud = np.array([np.average(p, weights=e) for p, e in zip(cut["pan"], cut["energy"], strict=True)])[cut["track"] == "panned"]
    assert loud[20] < -0.6 and loud[-20] > 0.6
    bands = space.pan_bands(rows).toPandas()
    assert set(bands["track"]) == {"panned", "right", "apart"} and len(bands) == 3 * 64
    assert (bands[bands["track"] == "right"]["pan"] > 0.99).all()
    smooth = space.smoothed(rows).filter("track = 'panned'").orderBy("frame").toPandas()["width"].to_numpy()
    raw = cut[cut["track"] == "panned"]["width"].to_numpy()
    assert np.allclose(smooth, [raw[max(0, i - 12) : i + 13].mean() for i in range(len(raw))])
    assert space.bands(SR)[0][0] == 6 and len(space.bands(SR)) == 64


def box(kind, body, large=False):
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if large else struct.pack(">I4s", 8 + len(body), kind) + body


WHEN = datetime(2024, 7, 1, 20, 15, 30)
SECONDS = int((WHEN - datetime(1904, 1, 1)) / timedelta(seconds=1))
HEADS = {0: struct.pack(">IIIII", 0, SECONDS, SECONDS, 600, 0) + b"\0" * 80, 1: struct.pack(">IQQIQ", 1 << 24, SECONDS, SECONDS, 600, 0) + b"\0" * 80}


def test_creation_time_without_the_payload():
    for version, head in HEADS.items():
        data = box(b"ftyp", b"isom") + box(b"mdat", b"\1" * 500_000, large=version == 1) + box(b"moov", box(b"free", b"12") + box(b"mvhd", head) + box(b"trak", b"x" * 1000))
        reads = []
        read = lambda at, n, data=data, reads=reads: reads.append(n) or data[at : at + n]
        assert creation_time(read, len(data)) == WHEN and sum(reads) < 200
    for bad in (b"", b"abc", b"\0" * 64, box(b"ftyp", b"isom"), box(b"moov", b""), box(b"moov", box(b"mvhd", b"\0" * 100)), box(b"moov", box(b"mvhd", HEADS[0]))[:40]):
        assert creation_time(lambda at, n, bad=bad: bad[at : at + n], len(bad)) is None


def test_created_in_a_zone(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 1000) + box(b"moov", box(b"mvhd", HEADS[1])))
    (tmp_path / "b.mov").write_bytes(b"not a movie at all")
    (tmp_path / "20240102_030405.mp4").write_bytes(box(b"moov", box(b"mvhd", HEADS[0])))
    out = {r.track: r for r in created(scan_recordings(spark, str(tmp_path)), "Europe/Oslo").collect()}
    assert out["a"].created_utc == WHEN and out["a"].created == WHEN + timedelta(hours=2)
    assert out["b"].created_utc is None and out["b"].created is None
    assert str(out["20240102_030405"].started) == "2024-01-02 03:04:05" and len(out) == 3
    began = {r.track: r.started for r in with_start_times(scan_recordings(spark, str(tmp_path)), "Europe/Oslo").collect()}
    assert str(began["a"]) == str(WHEN + timedelta(hours=2)) and began["b"] is None and str(began["20240102_030405"]) == "2024-01-02 03:04:05"
