"""Signal processing of decoded samples with numpy: loudness, true peak, dynamics, and the mastering chain."""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources import wavcodec

SILENT = -120.0


def _response(b: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """The first n values of a biquad's impulse response."""
    out = np.zeros(n)
    x = np.zeros(n)
    x[0] = 1.0
    for i in range(n):
        out[i] = b[0] * x[i] + (b[1] * x[i - 1] + b[2] * x[i - 2] if i > 1 else b[1] * x[i - 1] if i else 0.0)
        out[i] -= a[1] * out[i - 1] + a[2] * out[i - 2] if i > 1 else a[1] * out[i - 1] if i else 0.0
    return out


def _fft_filter(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = 1 << int(np.ceil(np.log2(max(2, len(x) + len(h)))))
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def _shelf(rate: int, gain_db: float, f0: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    k, v = np.tan(np.pi * f0 / rate), 10 ** (gain_db / 20)
    vb = v**0.4996667741545416
    a0 = 1 + k / q + k * k
    return np.array([v + vb * k / q + k * k, 2 * (k * k - v), v - vb * k / q + k * k]) / a0, np.array([1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


def _high_pass(rate: int, f0: float, q: float, unity: bool) -> tuple[np.ndarray, np.ndarray]:
    k = np.tan(np.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    b = np.array([1.0, -2.0, 1.0]) / (a0 if unity else 1.0)
    return b, np.array([1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


@lru_cache(maxsize=16)
def _weighting(rate: int) -> np.ndarray:
    """Impulse response of the K weighting of ITU-R BS.1770, for any rate."""
    n = int(rate * 0.35)
    first = _response(*_shelf(rate, 3.999843853973347, 1681.974450955533, 0.7071752369554196), n)
    second = _response(*_high_pass(rate, 38.13547087602444, 0.5003270373238773, False), n)
    return _fft_filter(first, second)


@lru_cache(maxsize=16)
def _low_cut(rate: int, f0: float) -> np.ndarray:
    return _response(*_high_pass(rate, f0, 0.7071067811865476, True), int(rate * 0.2))


def integrated_loudness(x: np.ndarray, rate: int) -> float | None:
    """LUFS of (channels, frames): 400 ms blocks at 100 ms steps, gated at -70 LUFS and 10 LU below the mean. None if
    there is no whole block above the gate."""
    meter = Meter(rate, len(x), peaks=False)
    meter.feed(x)
    return meter.loudness()


class Meter:
    """Loudness and peaks of a recording that comes in blocks of frames.

    What a filter and a 400 ms block need of earlier frames is kept, a second at most, so memory doesn't grow with the
    recording, and blocks of any size give the same result as all frames at once.
    """

    def __init__(self, rate: int, channels: int, peaks: bool = True):
        self.rate, self.size, self.step, self.peaks = rate, int(0.4 * rate), int(0.1 * rate), peaks
        self.weights = [1.41 if channels == 5 and c >= 3 else 1.0 for c in range(channels)]
        self.before = [np.zeros(0)] * channels  # for the weighting
        self.near = [np.zeros(0)] * channels  # for the oversampling
        self.squares = [np.zeros(0)] * channels
        self.power: list[np.ndarray] = []
        self.top = self.highest = 0.0

    def feed(self, x: np.ndarray) -> None:
        """Takes (channels, frames)."""
        if not x.shape[1]:
            return
        h = _weighting(self.rate)
        made = []
        for c, channel in enumerate(x):
            joined = np.r_[self.before[c], channel]
            y = _fft_filter(joined, h)[len(self.before[c]) :]
            self.before[c] = joined[max(0, len(joined) - len(h) + 1) :]
            self.squares[c] = np.r_[self.squares[c], y**2]
            if self.step and len(self.squares[c]) >= self.size:
                at = np.arange((len(self.squares[c]) - self.size) // self.step + 1) * self.step
                total = np.r_[0.0, np.cumsum(self.squares[c])]
                made.append(self.weights[c] * np.maximum(total[at + self.size] - total[at], 0.0) / self.size)
                self.squares[c] = self.squares[c][len(at) * self.step :]
            if self.peaks:
                self.highest = max(self.highest, float(np.abs(channel).max()))
                self._between(c, channel, last=False)
        if made:
            self.power.append(np.sum(made, axis=0))

    def _between(self, c: int, channel: np.ndarray, last: bool, half: int = 16, factor: int = 4) -> None:
        """Peaks between the samples; those near the end wait for what follows."""
        joined = np.r_[self.near[c], channel]
        known = len(joined) if last else max(0, len(joined) - half)
        done = min(half, len(self.near[c]) // 2) if len(self.near[c]) == 2 * half else 0
        if known > done:
            up = oversampled(joined, factor)[done * factor : known * factor]
            self.top = max(self.top, float(np.abs(up).max(initial=0.0)))
        self.near[c] = joined[max(0, len(joined) - 2 * half) :]

    def loudness(self) -> float | None:
        if not self.power:
            return None
        power = np.concatenate(self.power)
        with np.errstate(divide="ignore"):
            level = -0.691 + 10 * np.log10(power)
        kept = level > -70
        if not kept.any():
            return None
        gate = -0.691 + 10 * np.log10(power[kept].mean()) - 10
        kept &= level > gate
        return float(-0.691 + 10 * np.log10(power[kept].mean())) if kept.any() else None

    def true_peak(self) -> float:
        for c in range(len(self.near)):
            self._between(c, np.zeros(0), last=True)
        return db(self.top)

    def sample_peak(self) -> float:
        return db(self.highest)


@lru_cache(maxsize=4)
def _interpolator(factor: int, half: int = 16) -> np.ndarray:
    n = np.arange(-half * factor, half * factor + 1)
    return np.sinc(n / factor) * np.kaiser(len(n), 7.0)


def oversampled(x: np.ndarray, factor: int = 4) -> np.ndarray:
    up = np.zeros(len(x) * factor)
    up[::factor] = x
    h = _interpolator(factor)
    return _fft_filter(np.r_[up, np.zeros(len(h))], h)[len(h) // 2 : len(h) // 2 + len(up)]


def db(v: float) -> float:
    return max(20 * float(np.log10(v)), SILENT) if v > 0 else SILENT


def true_peak(x: np.ndarray) -> float:
    """dBTP of (channels, frames), four times oversampled."""
    return db(max((float(np.abs(oversampled(c)).max(initial=0.0)) for c in x), default=0.0))


def sample_peak(x: np.ndarray) -> float:
    return db(float(np.abs(x).max(initial=0.0)))


def _follow(level: np.ndarray, attack: float, release: float, step: float) -> np.ndarray:
    """A level smoothed with different times for rising and falling."""
    up, down = np.exp(-step / max(attack, 1e-6)), np.exp(-step / max(release, 1e-6))
    out, now = np.empty(len(level)), level[0] if len(level) else 0.0
    for i, v in enumerate(level.tolist()):
        k = up if v > now else down
        now = k * now + (1 - k) * v
        out[i] = now
    return out


def _gain(x: np.ndarray, rate: int, curve, attack: float, release: float) -> np.ndarray:
    """x times a gain that follows its level in steps of a millisecond."""
    width = max(1, rate // 1000)
    n = -(-len(x) // width)
    peaks = np.abs(np.r_[x, np.zeros(n * width - len(x))]).reshape(n, width).max(1)
    level = _follow(peaks, attack, release, width / rate)
    gain = curve(20 * np.log10(np.maximum(level, 1e-6)))
    return x * np.interp(np.arange(len(x)), np.arange(n) * width + width / 2, gain)


def noise_gate(x: np.ndarray, rate: int, threshold: float = -60.0, attack: float = 0.005, release: float = 0.05) -> np.ndarray:
    return _gain(x, rate, lambda l: np.where(l < threshold, 10 ** (np.maximum((l - threshold) * 1.0, -24.0) / 20), 1.0), attack, release)


def low_cut(x: np.ndarray, rate: int, f0: float = 80.0) -> np.ndarray:
    return _fft_filter(x, _low_cut(rate, f0))


def compress(x: np.ndarray, rate: int, threshold: float = -20.0, ratio: float = 2.0, attack: float = 0.01, release: float = 0.05) -> np.ndarray:
    """Compression with 40 % of the peak reduction made up, if that is more than half a decibel."""
    before = sample_peak(x)
    y = _gain(x, rate, lambda l: 10 ** (-np.maximum(l - threshold, 0.0) * (1 - 1 / ratio) / 20), attack, release)
    lost = before - sample_peak(y)
    return y * 10 ** (0.4 * lost / 20) if lost > 0.5 else y


def limit(x: np.ndarray, rate: int, ceiling: float = -1.0, margin: float = 0.1) -> np.ndarray:
    """Keeps the true peak below the ceiling: gain falls ahead of peaks, found at four times the rate, and recovers slowly."""
    top = 10 ** ((ceiling - margin) / 20)
    width = max(1, rate // 1000)
    high = np.abs(oversampled(x))
    n = -(-len(x) // width)
    peaks = np.r_[high, np.zeros(n * width * 4 - len(high))].reshape(n, width * 4).max(1) if n else np.zeros(0)
    need = np.minimum(1.0, top / np.maximum(peaks, 1e-9))
    for shift in (1, 2, 3):  # look ahead and behind, so that no neighbour is steeper than the gain can follow
        need = np.minimum(need, np.minimum(np.r_[need[shift:], np.ones(min(shift, n))][:n], np.r_[np.ones(min(shift, n)), need[:-shift]][:n]))
    slow = np.exp(-1.0 / 50)
    out, now = np.empty(n), 1.0
    for i, v in enumerate(need.tolist()):
        now = min(v, 1 - (1 - now) * slow)
        out[i] = now
    y = x * np.interp(np.arange(len(x)), np.arange(n) * width + width / 2, out) if n else x
    return np.clip(y, -top, top)


def resample(x: np.ndarray, old: int, new: int) -> np.ndarray:
    """Band-limited by cutting or padding the spectrum."""
    if old == new or not len(x):
        return x
    n = max(1, round(len(x) * new / old))
    f = np.fft.rfft(x)
    g = np.zeros(n // 2 + 1, complex)
    k = min(len(f), len(g))
    g[:k] = f[:k]
    return np.fft.irfft(g, n) * (n / len(x))


def edges(x: np.ndarray, threshold_dbfs: float = -60.0) -> tuple[int, int]:
    """Quiet samples at the start and at the end; all of them for a quiet signal."""
    loud = np.flatnonzero(np.abs(x) > 10 ** (threshold_dbfs / 20))
    return (int(loud[0]), int(len(x) - 1 - loud[-1])) if len(loud) else (len(x), len(x))


def fix_silence(x: np.ndarray, rate: int, seconds: float = 2.0, threshold_dbfs: float = -60.0) -> np.ndarray:
    """Exactly `seconds` of silence at either edge; a quiet signal is kept whole between."""
    head, tail = edges(x, threshold_dbfs)
    body = x if head == len(x) else x[head : len(x) - tail]
    pad = np.zeros(int(round(seconds * rate)))
    return np.r_[pad, body, pad]


@dataclass(frozen=True)
class Mastering:
    target_lufs: float = -18.0
    true_peak_max: float = -1.0
    sample_rate: int = 48000
    bits: int = 24
    silence_seconds: float = 2.0
    silence_dbfs: float = -60.0
    gate: bool = True
    low_cut_hz: float = 80.0
    compressor: bool = True


def master(x: np.ndarray, rate: int, s: Mastering = Mastering()) -> np.ndarray:
    """The chain on (channels, frames), mono out: offset, level, gate, low cut, compression, loudness, limit, trim, edges, rate."""
    y = x.mean(0)
    y = y - y.mean() if len(y) and abs(y.mean()) > 1e-6 else y
    loud = integrated_loudness(y[None], rate)
    if loud is not None:
        y = y * 10 ** ((-28.0 - loud) / 20)
    if s.gate:
        y = noise_gate(y, rate)
    if s.low_cut_hz:
        y = low_cut(y, rate, s.low_cut_hz)
    if s.compressor:
        y = compress(y, rate)
    loud = integrated_loudness(y[None], rate)
    if loud is not None and s.target_lufs - loud > 0.5:  # half of what is missing before the limiter, the rest behind it
        y = y * 10 ** (0.5 * (s.target_lufs - loud) / 20)
    y = limit(y, rate, s.true_peak_max)
    loud = integrated_loudness(y[None], rate)
    if loud is not None and abs(s.target_lufs - loud) > 0.3:
        y = y * 10 ** ((s.target_lufs - loud) / 20)
        if loud < s.target_lufs:  # only more gain can lift peaks over the limit again
            y = limit(y, rate, s.true_peak_max)
    return resample(fix_silence(y, rate, s.silence_seconds, s.silence_dbfs), rate, s.sample_rate)


def measured(stream: BinaryIO, size: int, block: int = 480_000) -> tuple[float | None, float, float]:
    """(LUFS, true peak, sample peak) of a container, read block by block."""
    h = wavcodec.read_header(stream, size)
    meter = Meter(h.sample_rate, h.channels)
    for start in range(0, h.n_frames, block):
        meter.feed(wavcodec.to_float(wavcodec.read_frames(stream, h, start, block), h))
    return meter.loudness(), meter.true_peak(), meter.sample_peak()


def measure_files(files: DataFrame, *, path: str = "path") -> DataFrame:
    """(path, lufs, true_peak, sample_peak, error) of the containers at the paths, which are never held as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf[path]:
                try:
                    with open(p, "rb") as stream:
                        rows.append((p, *measured(stream, os.path.getsize(p)), None))
                except (OSError, ValueError, TypeError, struct.error) as e:
                    rows.append((p, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "lufs", "true_peak", "sample_peak", "error"])

    return files.select(path).mapInPandas(run, "path string, lufs double, true_peak double, sample_peak double, error string")


def master_files(files: DataFrame, settings: Mastering = Mastering(), *, content: str = "content", path: str = "path") -> DataFrame:
    """(path, mastered binary, error): each container through the chain, with its markers at their places in the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf[path], pdf[content]):
                try:
                    h, cues = wavcodec.parse(bytes(raw))
                    x = wavcodec.to_float(wavcodec.read_frames(io.BytesIO(raw), h), h)
                    y = master(x, h.sample_rate, settings)
                    shift = settings.silence_seconds - edges(x.mean(0), settings.silence_dbfs)[0] / h.sample_rate
                    kept = [(int((c.sample_offset / h.sample_rate + shift) * settings.sample_rate), c.label) for c in cues]
                    kept = [(o, label) for o, label in kept if 0 <= o < len(y)]
                    rows.append((p, wavcodec.write(wavcodec.from_float(y, settings.bits), channels=1, sample_rate=settings.sample_rate, bits=settings.bits, cues=kept), None))
                except (wavcodec.WavError, TypeError) as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "mastered", "error"])

    return files.select(path, content).mapInPandas(run, "path string, mastered binary, error string")
