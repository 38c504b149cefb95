"""Sound objects, modulation and criteria of made tracks, against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import dsp
from sonolith.operators import timbre
from sonolith.operators.features import frames
from sonolith.sources.audio import decode, scan_collection, write_wav

SR = 22050
T = np.arange(int(20 * SR)) / SR


def pluck(spacing):
    since = T % spacing
    return 0.5 * np.exp(-since / 0.1) * np.sin(2 * np.pi * 330 * since) * (since < 0.25) + 1e-4 * np.random.default_rng(0).standard_normal(len(T))


TRACKS = {
    "plucks": pluck(0.25),
    "sparse": pluck(1.0),
    "drone": 0.3 * np.sin(2 * np.pi * 220 * T),
    "rolled": 0.3 * (1 + 0.9 * np.sin(2 * np.pi * 9 * T)) * np.sin(2 * np.pi * 220 * T),
    "rough": 0.3 * (1 + 0.9 * np.sin(2 * np.pi * 40 * T)) * np.sin(2 * np.pi * 220 * T),
    "noise": 0.2 * np.random.default_rng(1).standard_normal(len(T)),
    "scale": np.concatenate([0.3 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * T[: SR * 2]) for k in range(10)]),
    "swell": 0.3 * (1 + 0.5 * np.sin(2 * np.pi * 2 * T)) * np.sin(2 * np.pi * 220 * T),
}


@pytest.fixture(scope="module")
def f(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("objects")
    for name, y in TRACKS.items():
        (root / f"{name}.wav").write_bytes(write_wav(y, SR))
    return frames(decode(scan_collection(spark, str(root)))).cache()


def test_profiles(f):
    objects = timbre.sound_objects(f).cache()
    dist = {r.track: r.tartyp for r in timbre.profile_maps(objects).collect()}
    assert objects.filter("track = 'plucks'").count() > 20
    assert sum(v for k, v in dist["plucks"].items() if k[0] == "N") > 0.7 and dist["plucks"]["N'"] > 0.3
    assert sum(v for k, v in dist["drone"].items() if k in ("N", "X", "Y")) > 0.8
    assert sum(v for k, v in dist["rolled"].items() if k.endswith("''")) > 0.8
    assert sum(v for k, v in dist["noise"].items() if k[0] == "X") > 0.8
    assert all(abs(sum(v.values()) - 1) < 1e-3 for v in dist.values())
    spans = objects.orderBy("track", "t0").toPandas()
    for _, g in spans.groupby("track"):
        assert (g["t0"].to_numpy()[1:] >= g["t1"].to_numpy()[:-1] - 1e-6).all()


def test_onsets_go_back_to_a_valley(f):
    rows = timbre.bounded(f.filter("track = 'plucks'")).orderBy("frame").toPandas()
    onset, strength = rows["is_onset"].to_numpy(), rows["onset"].to_numpy()
    valley = [0] + [i for i in range(1, len(strength) - 1) if strength[i] <= strength[i - 1] and strength[i] < strength[i + 1]]
    starts = sorted({max(v for v in valley if v <= i) for i in np.flatnonzero(onset)} - {0})
    assert np.flatnonzero(np.diff(rows["object"])).tolist() == [s - 1 for s in starts]


def test_modulation_against_one_spectrum(f):
    own = f.join(timbre.rates(f), timbre.TRACK)
    got = {r.track: r for r in timbre.modulation_shares(own, timbre.TRACK, F.col("fine"), True, 8.0, 20.0, 100.0).collect()}
    swell = {r.track: r for r in timbre.modulation_shares(own, timbre.TRACK, F.col("rms"), False, 1.0, 0.5, 8.0).collect()}
    for track in TRACKS:
        fine = np.concatenate([r.fine for r in f.filter(F.col("track") == track).orderBy("frame").collect()])
        share, peak = dsp.modulation(fine, SR / 64, 20.0, 100.0)
        assert abs(got[track].share - share) < 1e-6 and (share < 1e-6 or abs(got[track].peak_hz - peak) < 1e-6)
    assert got["rough"].share > 0.9 and abs(got["rough"].peak_hz - 40) < 0.2
    assert abs(swell["swell"].peak_hz - 2) < 0.1


def test_windows_of_long_envelopes(f, monkeypatch):
    """Powers of several windows add up; a last window that isn't whole is left out."""
    monkeypatch.setattr(timbre, "WINDOW", 200)
    own = f.filter("track = 'rough'").join(timbre.rates(f), timbre.TRACK)
    fine = np.concatenate([r.fine for r in own.orderBy("frame").collect()])
    parts = [fine[i * 1600 : (i + 1) * 1600] for i in range(len(fine) // 1600)]
    band = total = 0.0
    for x in parts:
        p, fq = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2, np.fft.rfftfreq(len(x), 64 / SR)
        band, total = band + p[(fq >= 20) & (fq < 100)].sum(), total + p[fq > 0.2].sum()
    got = timbre.modulation_shares(own, timbre.TRACK, F.col("fine"), True, 8.0, 20.0, 100.0).first()
    assert abs(got.share - band / total) < 1e-6


def test_criteria(f):
    c = {r.track: r for r in timbre.criteria(f).collect()}
    assert set(c) == set(TRACKS)
    assert c["drone"].masse < 0.004 < c["noise"].masse and c["drone"].timbre < c["noise"].timbre
    assert c["rough"].grain > 0.8 and abs(c["swell"].allure - 2) < 0.1
    assert c["sparse"].dynamique < 0.1 and c["drone"].profil_mel < 0.2 and 0.4 <= c["scale"].profil_mel <= 0.6
    pc = np.array([int(np.argmax(r.chroma)) for r in f.filter("track = 'scale'").orderBy("frame").collect()])
    padded = np.pad(pc, 4, mode="edge")
    median = np.array([np.median(padded[i : i + 9]) for i in range(len(pc))])
    assert abs(c["scale"].profil_mel - (np.diff(median) != 0).sum() / 20) < 1e-6
