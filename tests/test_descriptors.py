"""Frames that don't depend on the cut, tempo, separation and cepstra, from decoded audio."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import dsp
from sonolith.operators import rhythm
from sonolith.operators.features import frames, pulse, track_features
from sonolith.sources.audio import decode, drone, scan_collection, write_wav

SR = 22050


def clicks(seconds, spacing, freq=330.0, decay=0.05, sr=SR):
    since = (np.arange(int(seconds * sr)) / sr) % spacing
    return (0.5 * np.exp(-since / decay) * np.sin(2 * math.pi * freq * since) + 1e-4 * np.random.default_rng(1).standard_normal(len(since))).astype(np.float32)


@pytest.fixture(scope="module")
def tracks(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("beats")
    (root / "a").mkdir()
    for name, y in (("120", clicks(30, 0.5)), ("90", clicks(31.3, 60 / 90)), ("drone", drone(25, 196)), ("silence", np.zeros(SR * 3, np.float32))):
        (root / "a" / f"{name}.wav").write_bytes(write_wav(y, SR))
    return scan_collection(spark, str(root)).cache()


@pytest.fixture(scope="module")
def whole(tracks):
    return frames(decode(tracks, chunk_s=1000.0)).cache()


@pytest.mark.parametrize("chunk_s", [10.0, 17.3, 60.0])
def test_frames_do_not_depend_on_the_chunk(tracks, whole, chunk_s):
    cut = frames(decode(tracks, chunk_s=chunk_s)).toPandas().sort_values(["track", "frame"], ignore_index=True)
    one = whole.toPandas().sort_values(["track", "frame"], ignore_index=True)
    assert len(cut) == len(one) and (cut["is_onset"] == one["is_onset"]).all()
    for c in ("t", "rms", "centroid", "flatness", "zcr", "onset", "harmonic", "percussive", "chroma", "mfcc", "fine"):
        a, b = (np.stack(x[c].to_numpy()) if one[c].dtype == object else x[c].to_numpy() for x in (cut, one))
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3), c
    assert one.groupby("track").size().to_dict() == {"120": 1 + 30 * SR // 512, "90": 1 + int(31.3 * SR) // 512, "drone": 1 + 25 * SR // 512, "silence": 1 + 3 * SR // 512}


def test_tempo_of_clicks(whole):
    got = {r.track: r for r in pulse(whole).collect()}
    assert abs(got["120"].tempo_bpm / 120 - 1) < 0.02 and abs(got["90"].tempo_bpm / 90 - 1) < 0.02
    assert got["120"].pulse_R > 0.6 and got["90"].pulse_R > 0.6 and got["silence"].pulse_R == 0


@pytest.mark.parametrize("block", [256, 300, 4096])
def test_tempogram_against_plain_windows(whole, block):
    """The long table equals autocorrelations of windows of the whole envelope, however it is dealt."""
    window, step = 344, 43
    env = np.array([r.onset for r in whole.filter("track = '90'").orderBy("frame").collect()])
    rows = rhythm.tempogram(whole.filter("track = '90'"), ["album", "track"], "frame", "onset", window, step, block).toPandas()
    assert len(rows) == window * len(range(0, len(env), step))
    padded, weights = np.pad(env, window), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    for t in (0, 43 * 7, 43 * (len(env) // 43)):
        x = padded[t + window - window // 2 :][:window] * weights
        r = np.array([(x[: window - k] * x[k:]).sum() for k in range(window)])
        own = rows[rows["frame"] == t].sort_values("lag")["value"].to_numpy()
        assert np.allclose(own, r / r.max(), atol=1e-9)
    middle = rows[(rows["frame"] == 43 * 15) & rows["lag"].between(60 * SR / 512 / 200, 60 * SR / 512 / 50)]
    best = middle.loc[middle["value"].idxmax(), "lag"]
    assert abs(60 * SR / 512 / best / 90 - 1) < 0.02
    means = rhythm.lag_means(whole, ["track"], "frame", "onset", window, block).filter("track = '90'").orderBy("lag").toPandas()["value"]
    every = rhythm.tempogram(whole.filter("track = '90'"), ["track"], "frame", "onset", window, 1, block).groupBy("lag").agg(F.avg("value").alias("v")).orderBy("lag").toPandas()["v"]
    assert np.allclose(means, every, atol=1e-9)
    assert rhythm.tempogram(whole.filter("false"), ["track"], "frame", "onset", window).count() == 0


def test_dominant_lag_against_the_whole_envelope(spark, whole):
    env = np.array([r.onset for r in whole.filter("track = '120'").orderBy("frame").collect()])
    rates = spark.createDataFrame([("120", SR / 512)], "track string, rate double")
    own = rhythm.dominant_lag(whole.filter("track = '120'"), ["track"], "frame", "onset", rates, (40.0, 200.0), block=500).first()
    low, high = int(60 / 200 * SR / 512), int(60 / 40 * SR / 512)
    r = [(env[: len(env) - k] * env[k:]).sum() for k in range(low, high)]
    assert own.lag == low + int(np.argmax(r))


def test_separation(whole):
    feats = {r.track: r for r in track_features(whole).collect()}
    assert feats["120"].perc_ratio > 0.5 and feats["drone"].perc_ratio < 0.1 and feats["silence"].perc_ratio is not None


def test_medians_and_masks_against_plain_ones():
    s = np.random.default_rng(3).random((40, 50)).astype(np.float32)
    pad = np.pad(s, dsp.MEDIAN, mode="symmetric")
    k = 2 * dsp.MEDIAN + 1
    steady = np.array([[np.median(pad[i : i + k, j + dsp.MEDIAN]) for j in range(50)] for i in range(40)])
    sudden = np.array([[np.median(pad[i + dsp.MEDIAN, j : j + k]) for j in range(50)] for i in range(40)])
    assert np.allclose(dsp.medians(s, dsp.MEDIAN, 0), steady) and np.allclose(dsp.medians(s, dsp.MEDIAN, 1), sudden)
    h, p = dsp.shares(s, 5, 20)
    assert np.allclose(h + p, s[5:25]) and np.allclose(h, (s * steady**2 / (steady**2 + sudden**2))[5:25], atol=1e-5)
    zero = dsp.shares(np.zeros((4, 50), np.float32), 0, 4)
    assert not zero[0].any() and not zero[1].any()


def test_cepstra_against_the_formula(whole):
    """The mel bands and the cosine transform written out for one frame."""
    y = np.round(np.clip(clicks(30, 0.5), -1, 1) * 32767) / 32768
    at = 700
    part = y[at * 512 - 1024 : at * 512 + 1024]
    power = np.abs(np.fft.rfft(part * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048)))) ** 2
    mel = lambda hz: hz * 3 / 200 if hz < 1000 else 15 + 27 * math.log(hz / 1000) / math.log(6.4)
    hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)
    edges = [hz(mel(SR / 2) * i / 129) for i in range(130)]
    bands = []
    for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
        bands.append(sum(power[k] * max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a) for k, f in enumerate(np.arange(1025) * SR / 2048)))
    loudest = dsp.extent(y.astype(np.float32), SR).mel
    db = [max(10 * math.log10(max(b, 1e-10)), 10 * math.log10(loudest) - 80) for b in bands]
    cepstrum = [math.sqrt((1 if k == 0 else 2) / 128) * sum(d * math.cos(math.pi * k * (2 * i + 1) / 256) for i, d in enumerate(db)) for k in range(13)]
    row = whole.filter(f"track = '120' and frame = {at}").first()
    assert np.allclose(row.mfcc, cepstrum, atol=0.05)


def test_trim(spark, tmp_path):
    y = np.concatenate([np.zeros(SR), clicks(6, 0.5), np.zeros(2 * SR)]).astype(np.float32)
    (tmp_path / "t.wav").write_bytes(write_wav(y, SR))
    f = frames(decode(scan_collection(spark, str(tmp_path)), trim_db=40.0)).agg(F.max("heard_s").alias("heard"), F.max("duration_s").alias("all")).first()
    assert abs(f["all"] - 9) < 0.01 and 5.3 < f.heard < 6.3
    assert dsp.audible(np.zeros(100), 40.0) == slice(0, 0) and dsp.audible(np.zeros(0), 40.0) == slice(0, 0)


@pytest.mark.parametrize("sr", [8000, 11025, 44100, 48000, 22050])
def test_resampling(spark, tmp_path, sr):
    """A tone below both limits keeps its shape at any rate, one above the lower limit goes."""
    t, to = np.arange(int(1.7 * sr)) / sr, 22050
    out = dsp.resampled(np.sin(2 * np.pi * 997 * t), sr, to)
    at = np.arange(len(out)) / to
    assert abs(len(out) - 1.7 * to) <= 1 and np.abs(out - np.sin(2 * np.pi * 997 * at))[1000:-1000].max() < 2e-3
    if sr > to:
        assert np.abs(dsp.resampled(np.sin(2 * np.pi * 15_000 * t), sr, to))[1000:-1000].max() < 2e-3
    (tmp_path / "a.wav").write_bytes(write_wav(0.5 * np.sin(2 * np.pi * 997 * t), sr))
    r = frames(decode(scan_collection(spark, str(tmp_path)))).agg(F.max("frame").alias("f"), F.max("duration_s").alias("d")).first()
    assert r.f == int(1.7 * to) // 512 and abs(r.d - 1.7) < 1e-3


def test_probe_and_landscape(spark, tmp_path, tracks):
    from sonolith.plans import report as plan

    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "notes.txt").write_text("no sound")
    with pytest.raises(FileNotFoundError):
        plan.probe(spark, str(tmp_path / "empty"))
    root = tracks.first().path.removeprefix("file:").rsplit("/", 2)[0]
    (row,) = plan.probe(spark, root, shown=3).collect()
    assert (row.album, row.n_tracks, row.tracks) == ("a", 4, ["120", "90", "drone"])
    points = spark.createDataFrame([(f"album {i % 11}", float(i % 7), float(i % 3)) for i in range(500)], "album string, pc1 double, pc2 double")
    svg = plan.landscape_svg(points, "album")
    assert svg.count("<circle") == 8 * 21 and all(c in svg for c in plan.PALETTE)
    assert plan.landscape_svg(points.filter("false"), "album").count("<circle") == 0
