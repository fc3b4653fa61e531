"""Recurrences on PCM blocks: K-weighted sub-block energy and oversampled peaks.

Blocks of one channel are streamed in order through one task, which carries the filters' state; only a block is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the loudness standard's filters as analogue prototypes: frequency, Q, and gain in dB of the shelf.
SHELF = (1681.974450955533, 0.7071752369554196, 3.999843853973347)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
STRIDE = 64
TAPS, OVERSAMPLING = 12, 4


def shelf(rate: float) -> tuple[np.ndarray, np.ndarray]:
    f, q, gain = SHELF
    k, vh = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    return np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


def high_pass(rate: float) -> tuple[np.ndarray, np.ndarray]:
    f, q = HIGH_PASS
    k = np.tan(np.pi * f / rate)
    a0 = 1 + k / q + k * k
    return np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


class Biquad:
    """A second-order filter, run a stride of samples at a time: a stride's output is linear in its input and in the
    state before it, so that only states are carried one by one."""

    def __init__(self, b: np.ndarray, a: np.ndarray) -> None:
        self.b, self.a = b, a
        self.state = np.zeros(2)
        step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        drive = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        powers = [np.eye(2)]
        for _ in range(STRIDE):
            powers.append(step @ powers[-1])
        self.out_state = np.array([p[0] for p in powers[:STRIDE]])
        pulse = np.array([b[0], *[(powers[i] @ drive)[0] for i in range(STRIDE - 1)]])
        self.out_input = np.array([[pulse[i - j] if i >= j else 0.0 for j in range(STRIDE)] for i in range(STRIDE)])
        self.next_state = powers[STRIDE]
        self.next_input = np.array([powers[STRIDE - 1 - j] @ drive for j in range(STRIDE)]).T

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = len(x) // STRIDE
        rows = x[: n * STRIDE].reshape(n, STRIDE)
        fed = rows @ self.next_input.T
        before = np.empty((n, 2))
        for i in range(n):
            before[i] = self.state
            self.state = self.next_state @ self.state + fed[i]
        y = [(rows @ self.out_input.T + before @ self.out_state.T).ravel()]
        for v in x[n * STRIDE :]:
            o = self.b[0] * v + self.state[0]
            self.state = np.array([self.b[1] * v - self.a[1] * o + self.state[1], self.b[2] * v - self.a[2] * o])
            y.append([o])
        return np.concatenate(y)


class Peak:
    """Largest magnitude between and at samples, by a windowed sinc at four times the rate."""

    def __init__(self) -> None:
        t = np.arange(-TAPS * OVERSAMPLING // 2, TAPS * OVERSAMPLING // 2 + 1) / OVERSAMPLING
        self.filter = np.sinc(t) * np.hanning(len(t) + 2)[1:-1]
        self.tail = np.zeros(TAPS)

    def __call__(self, x: np.ndarray) -> float:
        x = np.concatenate([self.tail, x])
        self.tail = x[-TAPS:]
        up = np.zeros(len(x) * OVERSAMPLING)
        up[::OVERSAMPLING] = x
        return float(max(np.abs(x).max(initial=0), np.abs(np.convolve(up, self.filter, "valid")).max(initial=0)))


def k_weighted(blocks: DataFrame, scale: float = 1 / (1 << 23)) -> DataFrame:
    """Energy and peak of every PCM block: file, channel, block, ms (K-weighted mean square), peak.

    blocks: file, rate, channel, block, samples, as the pcm_wav source gives them. Blocks of a channel are taken in
    order; a null or empty block has no energy and leaves the filters as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, ()
        for b in batches:
            ms, peaks = [], []
            for file, rate, channel, samples in zip(*(b.column(c).to_pylist() for c in ("file", "rate", "channel", "samples"))):
                if (file, channel) != current:
                    current, chain = (file, channel), (Biquad(*shelf(rate)), Biquad(*high_pass(rate)), Peak())
                x = np.array(samples or [], float) * scale
                y = chain[1](chain[0](x)) if len(x) else x
                ms.append(float(np.mean(y * y)) if len(y) else 0.0)
                peaks.append(chain[2](x) if len(x) else 0.0)
            keep = {c: b.column(c) for c in ("file", "channel", "block")}
            yield pa.RecordBatch.from_pydict(keep | {"ms": pa.array(ms, pa.float64()), "peak": pa.array(peaks, pa.float64())})

    dealt = blocks.select("file", "rate", "channel", "block", "samples").repartition("file", "channel").sortWithinPartitions("file", "channel", "block")
    return dealt.mapInArrow(run, "file string, channel int, block long, ms double, peak double")
