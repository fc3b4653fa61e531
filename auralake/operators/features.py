"""What a block of samples sounds like: power in bands, and the features that tell speech from other sound."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.operators.signal import Biquad, high_pass, shelf

#: Highest frequency of the bands.
TOP_HZ = 20_000.0
# Bands of speech and of all that is heard, of a voice's pitch, the rate of syllables and its Q, lowest
# level, and the range below a spectrum's peak that counts in a cepstrum of that many bins up to that frequency.
SPEECH_HZ, FULL_HZ, PITCH_HZ = (300.0, 3400.0), (60.0, 8000.0), (60.0, 400.0)
SYLLABLES, SYLLABLES_Q, LOWEST_DB, SPECTRUM_RANGE_DB, CEPSTRUM_BINS, CEPSTRUM_TOP_HZ = 4.0, 1.5, -80.0, 120.0, 512, 5000.0


def response(rate: float, hz: np.ndarray) -> np.ndarray:
    """Magnitude of the K weighting at frequencies."""
    z = np.exp(-2j * np.pi * hz / rate)
    out = np.ones(len(hz))
    for b, a in (shelf(rate), high_pass(rate)):
        out = out * np.abs((b[0] + b[1] * z + b[2] * z**2) / (a[0] + a[1] * z + a[2] * z**2))
    return out


class Bands:
    """Power of a block in bands of equal width on the scale of critical bands; together the bands have the K-weighted
    mean square of a steady sound."""

    def __init__(self, rate: float, frames: int, bands: int) -> None:
        self.frames, self.bands = frames, max(1, bands)
        self.size = 1 << max(1, math.ceil(math.log2(max(2, frames))))
        self.window = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(frames) + 0.5) / max(1, frames))
        top = min(TOP_HZ, rate / 2)
        hz = np.arange(self.size // 2 + 1) * rate / self.size
        scale = 21.4 * np.log10(1 + 0.00437 * hz)
        width = 21.4 * math.log10(1 + 0.00437 * top) / self.bands
        self.band = np.where(hz <= top, np.minimum(np.floor(scale / width), self.bands - 1), self.bands).astype(int)
        halves = np.full(len(hz), 2.0)
        halves[[0, -1]] = 1.0
        power = float((self.window**2).sum())
        self.weight = halves * response(rate, hz) ** 2 / (self.size * power) if power > 0 else np.zeros(len(hz))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x[: self.frames], (0, max(0, self.frames - len(x)))) * self.window
        power = np.abs(np.fft.rfft(x, self.size)) ** 2 * self.weight
        return np.bincount(self.band, power, self.bands + 1)[: self.bands]


def band_power(blocks: DataFrame, frames: int, bands: int, scale: float = 1 / (1 << 23)) -> DataFrame:
    """file, channel, block, power (array by band). blocks: file, rate, channel, block, samples; a shorter block is filled
    up with silence, a null one is silent. Blocks don't depend on each other: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Bands] = {}
        for b in batches:
            out = []
            for rate, samples in zip(b.column("rate").to_pylist(), b.column("samples").to_pylist()):
                if rate not in made:
                    made[rate] = Bands(rate, frames, bands)
                out.append(made[rate](np.array(samples or [], float) * scale).tolist())
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("file", "channel", "block")} | {"power": pa.array(out, pa.list_(pa.float64()))})

    return blocks.select("file", "rate", "channel", "block", "samples").mapInArrow(run, "file string, channel int, block long, power array<double>")


def spectral_flux(frames: DataFrame, keys: list[str], order: list[str], magnitudes: str) -> Column:
    """How much magnitudes (an array) grew since the frame before, over their sum; infinite for a first or silent frame."""
    before = F.lag(magnitudes).over(Window.partitionBy(*keys).orderBy(*order))
    grown = F.aggregate(F.zip_with(magnitudes, before, lambda m, p: F.greatest(m - p, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate(magnitudes, F.lit(0.0), lambda s, v: s + v)
    return F.when(before.isNull() | (total <= 0), float("inf")).otherwise(grown / F.when(total > 0, total))


@dataclass(frozen=True)
class Thresholds:
    """What a frame must reach to sound like a voice."""

    snr_db: float
    speech_band_ratio: float
    cpp_db: float
    flux: float
    modulation_db: float


def voice_like(level: Column, floor: Column, ratio: Column, cpp: Column, flux: Column, modulation: Column, seen: Column, span: int, t: Thresholds) -> Column:
    """Over the lowest level and the floor, in the band of speech, with a pitch, changing, and with the rate of
    syllables; the last test abstains until half a span of frames was seen."""
    return (
        (level > LOWEST_DB) & (level > floor + t.snr_db) & (ratio >= t.speech_band_ratio) & (cpp >= t.cpp_db) & (flux >= t.flux)
        & ((seen < span // 2) | (modulation >= t.modulation_db))
    )


def prominence(power: np.ndarray, rate: float) -> float:
    """Height of the cepstrum's peak in the range of a voice's pitch over the line through that range, in decibels."""
    peak = float(power.max(initial=0))
    if peak <= 0:
        return 0.0
    db = 10 * np.log10(np.maximum(power, peak * 10 ** (-SPECTRUM_RANGE_DB / 10)))
    hz = np.linspace(0, rate / 2, len(power))
    top = min(CEPSTRUM_TOP_HZ, rate / 2)
    even = np.interp(np.linspace(0, top, CEPSTRUM_BINS + 1), hz, db)
    cepstrum = np.fft.irfft(even)
    per = 2 * top  # quefrency bins a second
    low, high = math.ceil(per / PITCH_HZ[1]), min(math.floor(per / PITCH_HZ[0]), CEPSTRUM_BINS)
    if low >= high:
        return 0.0
    q, c = np.arange(low, high + 1), cepstrum[low : high + 1]
    slope, at = np.polyfit(q, c, 1)
    best = int(c.argmax())
    return float(c[best] - (slope * q[best] + at))


class Tracker:
    """Noise floor and modulation of a stream of levels, frame by frame."""

    def __init__(self, rate: float, span: int) -> None:
        self.span, self.floor, self.held = span, LOWEST_DB, []
        self.alpha = 1 - math.exp(-1 / span)
        self.mean = self.power = 0.0
        self.seen = 0
        w = 2 * math.pi * SYLLABLES / rate
        a = math.sin(w) / (2 * SYLLABLES_Q)
        self.filter = Biquad(np.array([a, 0.0, -a]) / (1 + a), np.array([1, -2 * math.cos(w) / (1 + a), (1 - a) / (1 + a)]))

    def __call__(self, level: float) -> tuple[float, float, int]:
        """(floor, modulation, frames seen) with this frame."""
        self.held.append(min(120, max(0, math.floor(level + 120 + 0.5))))
        if len(self.held) == self.span:
            low = sorted(self.held)[max(1, int(self.span * 0.1)) - 1]
            self.floor, self.held = max(LOWEST_DB, low - 120.0), []
        level = max(level, self.floor - 10)
        self.mean = level if not self.seen else self.mean + (level - self.mean) * self.alpha
        self.seen += 1
        y = float(self.filter(np.array([min(30.0, max(-30.0, level - self.mean))]))[0])
        self.power += (y * y - self.power) * self.alpha
        return self.floor, math.sqrt(max(0.0, self.power)), self.seen


_FEATURES = "file string, channel int, frame long, level double, floor double, ratio double, flatness double, cpp double, flux double, modulation double, seen long"


def features(frames: DataFrame, hop_rate: float, span: int, scale: float = 1 / (1 << 23)) -> DataFrame:
    """Features of each frame: file, channel, frame, level, floor, ratio, flatness, cpp, flux, modulation and seen.

    frames: file, rate, channel, frame, samples (a window of samples, hop_rate windows a second). A channel's frames are
    streamed in order through one task, which carries a spectrum and two trackers; null samples are silence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, track = None, None, None
        names = [c.split()[0] for c in _FEATURES.split(", ")][3:]
        for b in batches:
            rows: list[tuple] = []
            for file, rate, channel, samples in zip(*(b.column(c).to_pylist() for c in ("file", "rate", "channel", "samples"))):
                if (file, channel) != current:
                    current, before, track = (file, channel), None, Tracker(hop_rate, span)
                x = np.array(samples or [0.0], float) * scale
                taper = np.hanning(len(x) + 2)[1:-1]
                power = np.abs(np.fft.rfft(x * taper)) ** 2
                hz = np.fft.rfftfreq(len(x), 1 / rate)
                level = 10 * math.log10(float(((x * taper) ** 2).sum() / (taper**2).sum()) + 1e-30)
                band = (hz >= SPEECH_HZ[0]) & (hz <= SPEECH_HZ[1])
                speech, full = float(power[band].sum()), float(power[(hz >= FULL_HZ[0]) & (hz <= FULL_HZ[1])].sum())
                flat = min(1.0, float(np.exp(np.log(power[band] + 1e-30).mean()) / power[band].mean())) if speech > 0 else 1.0
                now = np.sqrt(power[band])
                flux = math.inf
                if before is not None and len(before) == len(now) and now.sum() > 0:
                    flux = float(np.maximum(now - before, 0).sum() / now.sum())
                before = now
                rows.append((level, speech / full if full > 0 else 0.0, flat, prominence(power, rate), flux, *track(level)))
            level, ratio, flat, cpp, flux, floor, modulation, seen = zip(*rows) if rows else [()] * 8
            got = dict(zip(names, (level, floor, ratio, flat, cpp, flux, modulation, seen)))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("file", "channel", "frame")} | {c: pa.array(v, pa.int64() if c == "seen" else pa.float64()) for c, v in got.items()})

    dealt = frames.select("file", "rate", "channel", "frame", "samples").repartition("file", "channel").sortWithinPartitions("file", "channel", "frame")
    return dealt.mapInArrow(run, _FEATURES)
