"""Jobs that kill their process, run too long or claim too much cost only themselves."""

import os
import signal
import time

import numpy as np

from sonolith.operators.features import frames_of_file, guarded_frames
from sonolith.plans import report as plan
from sonolith.sources.audio import plucks, scan_collection, write_wav
from sonolith.sources.guard import apart, guarded


def work(job, capped=False):
    if "poison" in job and not capped:
        os.kill(os.getpid(), signal.SIGKILL)
    if job == "broken":
        raise ValueError("no sound in it")
    if job == "slow":
        time.sleep(60)
    if job == "large":
        np.ones(1 << 28)
    yield (job, capped)
    yield len(job)


def test_survivors_of_a_killed_process():
    done = list(apart(["a", "poison", "b"], work))
    assert done == [(0, [("a", False), 1], None)]


def test_guarded_takes_every_job():
    jobs = ["a", "poison", "b", "broken", "c", "poison 2"]
    got = {i: (r, e) for i, r, e in guarded(jobs, work, lambda j: work(j, capped=j == "poison"))}
    assert {i: r for i, (r, e) in got.items() if e is None} == {0: [("a", False), 1], 1: [("poison", True), 6], 2: [("b", False), 1], 4: [("c", False), 1]}
    assert got[3] == (None, "ValueError: no sound in it") and got[5] == (None, "the process was killed or took too long")
    assert list(guarded([], work, work)) == []


def test_limits_of_the_second_try():
    again = lambda j: work(j)
    ((_, r, e),) = guarded(["large"], lambda j: iter(os.kill(os.getpid(), 9) or ()), again, memory_mb=512)
    assert r is None and "MemoryError" in e
    start = time.monotonic()
    ((_, r, e),) = guarded(["slow"], lambda j: iter(os.kill(os.getpid(), 9) or ()), again, seconds=0.5)
    assert r is None and "too long" in e and time.monotonic() - start < 10


def test_a_file_that_kills_its_process(spark, tmp_path):
    """One file kills its process unless capped, one always; one can't be read: all others are whole."""
    (tmp_path / "a").mkdir()
    for name, seconds in (("fine", 6), ("poison capped", 9), ("poison always", 5), ("other", 4)):
        (tmp_path / "a" / f"{name}.wav").write_bytes(write_wav(plucks(seconds, 0.5, 330), 22050))
    (tmp_path / "broken.wav").write_bytes(b"no wave")

    def deadly(job, capped=False, **how):
        if "always" in job[0] or ("poison" in job[0] and not capped):
            os.kill(os.getpid(), signal.SIGKILL)
        yield from frames_of_file(job, capped=capped, **how)

    out = guarded_frames(scan_collection(spark, str(tmp_path)), retry_cap_s=3.0, work=deadly).toPandas()
    last = out.groupby("track").agg(n=("frame", "count"), heard=("duration_s", "max"), cap=("capped_s", "max"), error=("error", "first"))
    assert last.loc["fine", "heard"] == 6 and np.isnan(last.loc["fine", "cap"]) and last.loc["other", "heard"] == 4
    assert last.loc["poison capped", "heard"] == 3 and last.loc["poison capped", "cap"] == 3.0
    assert "killed" in last.loc["poison always", "error"] and last.loc["poison always", "n"] == 0
    assert last.loc["broken", "error"].startswith("EOFError")


def test_extract_is_kept_and_reread(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "a").mkdir(parents=True)
    (root / "a" / "one.wav").write_bytes(write_wav(plucks(4, 0.5, 330), 22050))
    (root / "a" / "bad.wav").write_bytes(b"no wave")
    first = {r.track: r for r in plan.extract(spark, str(root), out).collect()}
    assert first["one"].error is None and first["one"].tempo_bpm and first["bad"].error and first["bad"].onset_rate is None
    (root / "a" / "two.wav").write_bytes(write_wav(plucks(4, 0.5, 330), 22050))
    assert plan.extract(spark, str(root), out).count() == 2
    assert plan.extract(spark, str(root), out, force=True).count() == 3
    os.remove(f"{out}/_SUCCESS")  # a table whose writing broke off isn't read
    assert plan.extract(spark, str(root), out).count() == 3
