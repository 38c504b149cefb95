import json

import numpy as np
from pyspark.sql import functions as F

from sonolith.operators.corpus import album_affinity, zscore
from sonolith.operators.features import FEATURES, LOG_FEATURES, frames, object_profile, sound_objects, track_features, windowed
from sonolith.plans import report as plan
from sonolith.sources.audio import decode, demo_collection, plucks, read_wav, scan_collection, scan_recordings, write_wav


def test_wav_round_trip():
    x = np.stack([np.linspace(-1, 1, 1000), np.zeros(1000)])
    y, sr = read_wav(write_wav(x, 8000))
    assert sr == 8000 and y.shape == (2, 1000) and np.abs(x - y).max() < 1e-4


def test_collection(spark, tmp_path):
    root = demo_collection(tmp_path / "demo", seconds=6)
    (root / "broken.wav").write_bytes(b"not a wave")
    (root / "out").mkdir()
    (root / "out" / "20240102_030405.wav").write_bytes(write_wav(plucks(1, 0.5, 220), 22050))
    tracks = scan_collection(spark, str(root), exclude=["out"])
    assert {(r.album, r.n) for r in tracks.groupBy("album").agg(F.count("*").alias("n")).collect()} == {("harp", 3), ("organ", 3), (".", 1)}
    when = scan_recordings(spark, str(root)).filter("album = 'out'").first()
    assert str(when.started) == "2024-01-02 03:04:05" and when.file_idx == 0
    chunks = decode(tracks, chunk_s=2.0)
    assert [r.track for r in chunks.filter("error is not null").collect()] == ["broken"]
    f = frames(chunks).cache()
    feats = track_features(f).cache()
    assert feats.count() == 6
    rate = {r.album: r.x for r in feats.groupBy("album").agg(F.avg("onset_rate").alias("x")).collect()}
    assert rate["harp"] > 2 * rate["organ"]
    z = zscore(feats, FEATURES, LOG_FEATURES).withColumn("v", F.array(*[f"z_{c}" for c in FEATURES]))
    a = {(r.album_a, r.album_b): r.affinity for r in album_affinity(z, "album", "v").collect()}
    assert a["harp", "harp"] > a["harp", "organ"]
    profile = object_profile(sound_objects(f)).groupBy("album", "track").agg(F.sum("share").alias("s")).collect()
    assert profile and all(abs(r.s - 1) < 1e-3 for r in profile)
    feats.write.parquet(str(tmp_path / "features"))
    page = plan.report(spark.read.parquet(str(tmp_path / "features")), tmp_path / "report", "demo")
    assert "harp" in page.read_text() and len(json.loads((tmp_path / "report" / "album_stats.json").read_text())) == 2


def test_metronome(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.wav").write_bytes(write_wav(plucks(20, 0.5, 330), 22050))
    r = track_features(frames(decode(scan_collection(spark, str(tmp_path)))).cache()).first()
    assert r.pulse_R > 0.6 and min(abs(r.pulse_bpm / b - 1) for b in (60, 120, 240)) < 0.08


def test_windows(spark, tmp_path):
    """A ragged last window doesn't vote; a short track has one window and no agreement."""
    (tmp_path / "a").mkdir()
    for name, seconds in (("long", 47), ("short", 9)):
        (tmp_path / "a" / f"{name}.wav").write_bytes(write_wav(plucks(seconds, 0.5, 440, sr=11025), 11025))
    f = frames(decode(scan_collection(spark, str(tmp_path)))).cache()
    out = {r.track: r for r in windowed(f).collect()}
    assert (out["long"].key_windows, out["long"].key_agreement, out["long"].tempo_agreement) == (2, 1.0, 1.0)
    assert (out["short"].key_windows, out["short"].key_agreement, out["short"].tempo_agreement) == (1, None, None)
    assert min(abs(out["long"].tempo_windowed_bpm / b - 1) for b in (60, 120)) < 0.05
    assert plan.extract(spark, str(tmp_path)).count() == 2


def test_no_folder_left_out(spark, tmp_path, monkeypatch):
    """Tracks of all folders are decoded, however few rows a limit leaves (10,000 folders are too many for a test)."""
    for i in range(4):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "t.wav").write_bytes(write_wav(np.zeros(8), 8000))
    tracks = scan_collection(spark, str(tmp_path))
    monkeypatch.setattr(type(tracks), "limit", lambda self, n, f=type(tracks).limit: f(self, min(n, 2)))
    assert sorted(r.album for r in decode(tracks).filter("error is null").collect()) == ["0", "1", "2", "3"]
