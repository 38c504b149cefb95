import numpy as np
import pytest

from sonolith.plans import segment as seg
from sonolith.sources.audio import read_wav, scan_recordings, write_wav

SR = 11025


def music(s, seed, root=220.0):
    t = np.arange(int(s * SR)) / SR
    return sum(0.2 / k * np.sin(2 * np.pi * root * k * t) for k in (1, 2, 3)) + 1e-3 * np.random.default_rng(seed).standard_normal(len(t))


def applause(s, seed):
    return 0.1 * np.random.default_rng(seed).standard_normal(int(s * SR))


def write(path, *parts):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(write_wav(np.concatenate(parts), SR))


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    write(root / "clock" / "a.wav", applause(10, 1), music(40, 2), applause(10, 3))
    write(root / "clock" / "b.wav", applause(10, 4), music(40, 5), applause(10.5, 6))
    write(root / "split" / "20240229_235950.wav", applause(10, 1), music(40, 2))
    write(root / "split" / "20240301_000040.wav", music(40, 3), applause(10, 4))
    write(root / "apart" / "a.wav", music(40, 1), applause(15, 2))
    write(root / "apart" / "b.wav", applause(15, 3), music(40, 4))
    write(root / "short" / "a.wav", applause(15, 1), music(10, 2), applause(20, 3), music(40, 4), applause(15, 5))
    (root / "short" / "b.wav").write_bytes(b"not a wave")
    songs, regions = seg.segment(spark, str(root), str(out), min_song_s=20.0, chunk_s=15.0)
    return root, out, songs, regions


def test_songs(found):
    _, _, songs, _ = found
    own = {}
    for r in songs.orderBy("session", "index").collect():
        own.setdefault(r.session, []).append(r)
    assert {k: len(v) for k, v in own.items()} == {"clock": 2, "split": 1, "apart": 2, "short": 1}
    assert own["clock"][1].start == pytest.approx(70, abs=3) and own["clock"][1].parts[0].start == pytest.approx(10, abs=3)
    assert len(own["split"][0].parts) == 2 and own["split"][0].duration == pytest.approx(80, abs=4)
    assert own["short"][0].start == pytest.approx(45, abs=3)
    assert own["clock"][0].clip == "01-a-0010.wav"


def test_regions_and_pieces(found, spark):
    root, out, songs, regions = found
    clock = [(r.label, r.start, r.end) for r in regions.filter("session = 'clock'").orderBy("start").collect()]
    assert [x[0] for x in clock] == ["applause", "music", "applause", "music", "applause"]
    assert clock[0][1] == 0 and clock[-1][2] == 120 and all(a[2] == b[1] for a, b in zip(clock, clock[1:]))
    rows = spark.read.parquet(f"{out}/seconds")
    files = seg.session_files(scan_recordings(spark, str(root)), rows)
    pieces = seg.region_pieces(regions, files)
    middle = pieces.filter("session = 'clock' and name like '%050-%'").collect()
    named = {r.name for r in pieces.filter("session = 'split'").collect()}
    assert "20240229_235950 applause.wav" in named and len(named) == 2
    crossing = pieces.filter("session = 'clock'").groupBy("name").count().filter("count = 2").count()
    assert crossing == 1 and len(middle) in (0, 2)
    cut = seg.cut_pieces(seg.song_pieces(songs, files).filter("session = 'split'"), str(root)).collect()
    assert len(cut) == 2 and sum(read_wav(r.wav)[0].shape[1] / SR for r in cut) == pytest.approx(80, abs=4)
