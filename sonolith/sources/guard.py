"""Jobs in processes of their own, so that one that kills its process costs nothing but itself.

A first process takes all jobs of a batch and hands back each one's results; those left when it dies, and those that
failed, are tried once more, each in its own process under a limit of memory and time.
"""

from __future__ import annotations

import os
import pickle
import resource
import select
import signal
import struct
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

_HEAD = struct.Struct("<Q")


def _write(fd: int, message: Any) -> None:
    data = pickle.dumps(message, protocol=5)
    data = _HEAD.pack(len(data)) + data
    while data:
        data = data[os.write(fd, data[: 1 << 20]) :]


def _read(fd: int, n: int, until: float | None) -> bytes:
    parts = []
    while n:
        if until is not None and not select.select([fd], [], [], max(0.0, until - time.monotonic()))[0]:
            raise TimeoutError
        part = os.read(fd, min(n, 1 << 20))
        if not part:
            raise EOFError
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def apart(jobs: Sequence[Any], work: Callable[[Any], Iterator[Any]], memory_mb: int | None = None, seconds: float | None = None) -> Iterator[tuple[int, list[Any] | None, str | None]]:
    """(index, results, error) of the jobs that one process gets done, in order; a job it dies on, and those after it, are left out.

    ``memory_mb`` is what the process may claim beyond what it starts with; ``seconds`` hold for each job.
    """
    out, into = os.pipe()
    pid = os.fork()
    if not pid:
        try:
            os.close(out)
            if memory_mb is not None:
                with open("/proc/self/statm") as f:
                    own = int(f.read().split()[0]) * resource.getpagesize()
                resource.setrlimit(resource.RLIMIT_AS, (own + (memory_mb << 20), resource.RLIM_INFINITY))
            for i, job in enumerate(jobs):
                try:
                    for part in work(job):
                        _write(into, (i, "part", part))
                    _write(into, (i, "done", None))
                except Exception as e:  # noqa: BLE001 - a job may fail in any way
                    _write(into, (i, "error", f"{type(e).__name__}: {e}"))
        finally:
            os._exit(0)
    os.close(into)
    parts: list[Any] = []
    try:
        until = None if seconds is None else time.monotonic() + seconds
        while True:
            i, what, value = pickle.loads(_read(out, _HEAD.unpack(_read(out, _HEAD.size, until))[0], until))
            if what == "part":
                parts.append(value)
                continue
            yield i, None if what == "error" else parts, value
            parts, until = [], None if seconds is None else time.monotonic() + seconds
    except (EOFError, TimeoutError):
        pass
    finally:
        os.close(out)
        try:
            os.kill(pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        os.waitpid(pid, 0)


def guarded(jobs: Sequence[Any], work: Callable[[Any], Iterator[Any]], again: Callable[[Any], Iterator[Any]], memory_mb: int | None = None, seconds: float | None = None) -> Iterator[tuple[int, list[Any] | None, str | None]]:
    """(index, results, error) of every job: by ``work`` in a process shared by all, else by ``again`` in one of its own; an error if that fails too."""
    left = set(range(len(jobs)))
    at = 0
    while at < len(jobs):  # beyond a job that killed the shared process the next one takes over
        reached = at
        for i, results, error in apart(jobs[at:], work, None, seconds):
            reached = at + i + 1
            if error is None:
                left.discard(at + i)
                yield at + i, results, None
        at = reached + 1 if reached < len(jobs) else reached
    for i in sorted(left):
        _, results, error = next(apart([jobs[i]], again, memory_mb, seconds), (0, None, "the process was killed or took too long"))
        yield i, results, error
