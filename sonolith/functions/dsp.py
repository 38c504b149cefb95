"""Frame descriptors of signals; run inside tasks, a chunk of a track at a time.

Frames are centred: frame k covers the N_FFT samples around sample k * HOP, with silence before and after a track. A chunk
brings frames of its neighbours along, and what depends on a whole track (Extent) comes with it, so a frame's row doesn't
depend on where a track is cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

N_FFT, HOP = 2048, 512
#: Frames to each side of a median over time or over bins.
MEDIAN = 15
#: Frames a chunk brings along on each side.
CONTEXT = MEDIAN + 1
FINE = 64
N_MELS, N_MFCC = 128, 13
TOP_DB = 80.0


def n_frames(samples: int) -> int:
    return 1 + samples // HOP


def around(y: np.ndarray, first: int, last: int) -> np.ndarray:
    """The samples that frames ``first`` to ``last`` - 1 of ``y`` cover, with silence outside."""
    a, b = first * HOP - N_FFT // 2, (last - 1) * HOP + N_FFT // 2
    return np.pad(y[max(a, 0) : max(b, 0)], (max(0, -a), max(0, b - max(len(y), a, 0))))


def spectra(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of Hann-windowed frames, frames x bins."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, N_FFT)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(N_FFT + 1)[:-1], axis=1)).astype(np.float32)


@functools.cache
def mel_filters(sr: int, n: int = N_MELS) -> np.ndarray:
    """Triangles evenly spaced in mel (linear to 1 kHz, logarithmic above), each of the same area: bands x bins."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, 3 * f / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, 200 * m / 3, 1000 * np.exp((m - 15) * step))
    edge = to_hz(np.linspace(0, to_mel(np.float64(sr / 2)), n + 2))[:, None]
    bins = np.fft.rfftfreq(N_FFT, 1 / sr)[None, :]
    rise, fall = (bins - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - bins) / (edge[2:] - edge[1:-1])
    return (np.maximum(0, np.minimum(rise, fall)) * 2 / (edge[2:] - edge[:-2])).astype(np.float32)


@functools.cache
def cosines(n: int = N_MELS, kept: int = N_MFCC) -> np.ndarray:
    """The first rows of the orthonormal cosine transform of the second kind."""
    k, i = np.arange(kept)[:, None], np.arange(n)[None, :]
    return np.sqrt(2 / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.where(k == 0, np.sqrt(0.5), 1)


def in_db(power: np.ndarray, loudest: float, least: float = 1e-10) -> np.ndarray:
    """10 log10 of ``power``, TOP_DB below ``loudest`` at least."""
    return np.maximum(10 * np.log10(np.maximum(power, least)), 10 * np.log10(max(loudest, least)) - TOP_DB)


def rises(db: np.ndarray) -> np.ndarray:
    """Mean rise over the bins from each frame to the next."""
    return np.maximum(np.diff(db, axis=0), 0).mean(axis=1)


@dataclass
class Extent:
    """Of a whole track: its loudest bin and mel band (powers), and the range of its onset strengths."""

    power: float = 0.0
    mel: float = 0.0
    low: float = 0.0
    high: float = 0.0


def _blocks(y: np.ndarray, size: int = 512) -> Iterator[np.ndarray]:
    """Powers of all frames of ``y``, block by block; each begins with the last frame of the one before."""
    n = n_frames(len(y))
    for a in range(0, n, size):
        yield spectra(around(y, max(a - 1, 0), min(a + size, n))) ** 2


def extent(y: np.ndarray, sr: int) -> Extent:
    out, mel = Extent(), mel_filters(sr).T
    for power in _blocks(y):
        out.power, out.mel = max(out.power, float(power.max())), max(out.mel, float((power @ mel).max()))
    for power in _blocks(y):
        out.high = max(out.high, float(rises(in_db(power, out.power)).max(initial=0)))
    return out  # the first frame's strength is 0, and so is the least


def medians(x: np.ndarray, reach: int, axis: int, block: int = 64) -> np.ndarray:
    """Medians over ``reach`` places to each side along ``axis``, mirrored at the ends."""
    padded = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
    out = np.empty_like(x)
    for a in range(0, len(x), block):
        rows = padded[a : a + block + (2 * reach if axis == 0 else 0)]
        out[a : a + block] = np.partition(np.lib.stride_tricks.sliding_window_view(rows, 2 * reach + 1, axis=axis), reach, axis=-1)[..., reach]
    return out


def shares(s: np.ndarray, first: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive magnitudes of ``own`` frames from ``first`` on: soft masks from medians over time and over bins."""
    steady = medians(s, MEDIAN, 0)[first : first + own] ** 2
    mine = s[first : first + own]
    sudden = medians(mine, MEDIAN, 1) ** 2
    both = steady + sudden
    mask = np.where(both > 1e-30, steady / np.maximum(both, 1e-30), 0.5)
    return mine * mask, mine * (1 - mask)


@functools.cache
def _pitch_classes(sr: int) -> tuple[np.ndarray, np.ndarray]:
    freq = np.fft.rfftfreq(N_FFT, 1 / sr)
    heard = (freq > 60) & (freq < 5000)
    pitch = np.round(12 * np.log2(freq[heard] / 440.0)).astype(int) + 9
    return heard, (np.arange(12)[None, :] == (pitch % 12)[:, None]).astype(np.float32)


def frame_rows(samples: np.ndarray, sr: int, first: int, own: int, whole: Extent) -> dict[str, np.ndarray]:
    """Per frame of ``own`` ones from ``first`` on in ``samples``: level, spectrum, onset strength, harmonic and percussive energy, pitch classes, cepstrum and fine envelope."""
    s = spectra(samples)
    mine = slice(first, first + own)
    frames = np.lib.stride_tricks.sliding_window_view(samples, N_FFT)[::HOP][mine]
    power = s * s
    strength = np.r_[0.0, rises(in_db(power, whole.power))]
    if first:  # the first frame is a neighbour's, whose own strength isn't known
        strength[0] = np.nan
    harmonic, percussive = shares(s, first, own)
    heard, classes = _pitch_classes(sr)
    chroma = (harmonic[:, heard] ** 2) @ classes
    freq = np.fft.rfftfreq(N_FFT, 1 / sr)
    m, p = s[mine], np.maximum(power[mine], 1e-10)
    cepstrum = in_db(power[mine] @ mel_filters(sr).T, whole.mel) @ cosines().T
    at = np.arange(own)[:, None] * HOP + np.arange(0, HOP, FINE)[None, :] + first * HOP + N_FFT // 2 - 2 * FINE
    squares = np.r_[0.0, np.cumsum(np.asarray(samples, np.float64) ** 2)]
    fine = np.sqrt(np.maximum(squares[np.minimum(at + 4 * FINE, len(samples))] - squares[at], 0) / (4 * FINE))
    return {
        "rms": np.sqrt((frames**2).mean(axis=1)),
        "centroid": (m * freq).sum(axis=1) / (m.sum(axis=1) + 1e-12),
        "flatness": np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1),
        "zcr": (np.diff(np.signbit(frames), axis=1)).mean(axis=1),
        "onset": strength[mine],
        "is_onset": tops(strength, whole)[mine],
        "harmonic": (harmonic**2).sum(axis=1),
        "percussive": (percussive**2).sum(axis=1),
        "chroma": chroma / (chroma.max(axis=1, keepdims=True) + 1e-12),
        "mfcc": cepstrum,
        "fine": fine,
    }


def tops(strength: np.ndarray, whole: Extent, floor: float = 0.5, wait: int = 3, reach: int = 8) -> np.ndarray:
    """Frames that top their neighbours (the first of equal ones) and rise over the local mean by a tenth of the track's range."""
    known = np.nan_to_num(strength, nan=-np.inf)
    best = lambda a, b: np.lib.stride_tricks.sliding_window_view(np.pad(known, (a, b), constant_values=-np.inf), a + b + 1).max(axis=1)
    views = np.lib.stride_tricks.sliding_window_view(np.pad(strength, reach, constant_values=np.nan), 2 * reach + 1)
    count = np.isfinite(views).sum(axis=1)
    mean = np.nansum(views, axis=1) / np.maximum(count, 1)
    earlier = np.r_[-np.inf, best(wait - 1, 0)[:-1]]
    return (known > earlier) & (known >= best(0, wait)) & (known >= mean + 0.1 * (whole.high - whole.low)) & (known >= floor)


def dominant_period(envelope: np.ndarray, rate: float, bpm: tuple[float, float] = (40.0, 200.0)) -> float:
    """Seconds of the lag, within the tempo range, at which the envelope agrees most with itself."""
    x = envelope - envelope.mean()
    lags = np.arange(int(rate * 60 / bpm[1]), min(len(x) - 1, int(rate * 60 / bpm[0])) + 1)
    if len(lags) < 1:
        return 60.0 / 120
    spectrum = np.fft.rfft(x, 2 * len(x))
    agree = np.fft.irfft(spectrum * spectrum.conj())[lags]
    return float(lags[int(agree.argmax())] / rate)


def lag_strengths(windows: np.ndarray) -> np.ndarray:
    """Autocorrelation of each Hann-weighted row at all lags, its largest value 1; rows of silence stay 0."""
    n = windows.shape[1]
    spectrum = np.fft.rfft(windows * np.hanning(n + 1)[:-1], 2 * n, axis=1)
    r = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :n]
    top = np.abs(r).max(axis=1, keepdims=True)
    return np.where(top > 1e-20, r / np.maximum(top, 1e-20), 0.0)


def modulation(envelope: np.ndarray, rate: float, low: float, high: float) -> tuple[float, float]:
    """Share of an envelope's modulation (above 0.2 Hz) between ``low`` and ``high`` Hz, and the strongest frequency there; 0 for short or constant ones."""
    x = np.asarray(envelope, float)
    x = x - x.mean() if len(x) else x
    if len(x) < 16 or not np.any(x):
        return 0.0, 0.0
    power, f = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    band = (f >= low) & (f < high)
    total = power[f > 0.2].sum()
    return (float(power[band].sum() / total) if total > 0 else 0.0), (float(f[band][power[band].argmax()]) if band.any() else 0.0)


def audible(y: np.ndarray, top_db: float) -> slice:
    """From the first to the last frame whose level is within ``top_db`` of the loudest frame's."""
    squares = np.r_[0.0, np.cumsum(np.asarray(y, np.float64) ** 2)]
    at = np.arange(n_frames(len(y))) * HOP
    level = squares[np.minimum(at + N_FFT // 2, len(y))] - squares[np.maximum(at - N_FFT // 2, 0)]
    loud = np.flatnonzero(level > level.max() * 10 ** (-top_db / 10)) if len(y) and level.max() > 0 else []
    return slice(int(loud[0]) * HOP, min(len(y), int(loud[-1] + 1) * HOP)) if len(loud) else slice(0, 0)


@functools.cache
def _low_pass(up: int, down: int, reach: int = 32) -> np.ndarray:
    """Taps of a Kaiser-windowed sinc for a change of rate by ``up`` / ``down``, ``up`` phases in rows."""
    widest = max(up, down)
    n = 2 * reach * widest + 1
    t = np.arange(n) - reach * widest
    taps = np.sinc(t * 0.96 / widest) * 0.96 / widest * np.kaiser(n, 9.0) * up
    return np.pad(taps, (0, -n % up)).reshape(-1, up).T


def resampled(y: np.ndarray, sr: int, to: int, block: int = 1 << 15) -> np.ndarray:
    """``y`` at another rate: each phase of the filter over blocks of samples, silence beyond the ends."""
    if sr == to or not len(y):
        return y
    common = int(np.gcd(sr, to))
    up, down = to // common, sr // common
    taps = _low_pass(up, down)
    half = 32 * max(up, down)
    n = -(-len(y) * up // down)
    width = taps.shape[1]
    padded = np.pad(np.asarray(y, np.float32), width)
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        at = np.arange(first, n, up, dtype=np.int64) * down + half  # places on the finer grid, the filter's delay added
        phase, last = int(at[0] % up), at // up
        h = taps[phase][::-1].astype(np.float32)
        own = np.empty(len(at), np.float32)
        for a in range(0, len(at), block):  # the window that ends at sample ``last``
            own[a : a + block] = views[np.minimum(last[a : a + block] + 1, len(views) - 1)] @ h
        out[first::up] = own
    return out
