"""Lossless frames of PCM blocks in the published FLAC format. Frames don't depend on each other, so a block of a file
is encoded wherever it lies: no shuffle, no order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of quantised predictor coefficients, highest order and highest Rice partition order that are tried.
PRECISION, MAX_ORDER, MAX_PARTITION = 14, 12, 6


class Bits:
    """Bits in writing order, most significant first."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = 0

    def put(self, value: int, width: int) -> None:
        self.many(np.array([value], dtype=np.int64), width)

    def many(self, values: np.ndarray, width: int) -> None:
        """The low bits of each value."""
        if width and len(values):
            shifts = np.arange(width - 1, -1, -1, dtype=np.int64)
            self._add(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel())

    def rice(self, unsigned: np.ndarray, k: int) -> None:
        """Quotients as zeros ended by a one, each followed by the k low bits."""
        quotients = unsigned >> k
        ends = np.cumsum(quotients + 1 + k)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        at = ends - k - 1
        out[at] = 1
        for b in range(k):
            out[at + 1 + b] = (unsigned >> (k - 1 - b)) & 1
        self._add(out)

    def _add(self, bits: np.ndarray) -> None:
        self.parts.append(bits)
        self.size += len(bits)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes() if self.parts else b""


@lru_cache
class Reader:
    """Reads bits in the order in which Bits writes them; reading beyond the end is an error."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def get(self, width: int) -> int:
        if self.at + width > len(self.bits):
            raise ValueError(f"{width} bits wanted at {self.at} of {len(self.bits)}")
        out = 0
        for b in self.bits[self.at : self.at + width].tolist():
            out = out << 1 | b
        self.at += width
        return out

    def signed(self, width: int) -> int:
        v = self.get(width)
        return v - (1 << width) if width and v >> (width - 1) else v

    def rice(self, k: int) -> int:
        """An unsigned value as Bits.rice() writes it."""
        ones = np.flatnonzero(self.bits[self.at :])
        if not len(ones):
            raise ValueError("a quotient without an end")
        q = int(ones[0])
        self.at += q + 1
        return q << k | self.get(k)

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _table(width: int, polynomial: int) -> list[int]:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        table.append(c)
    return table


def _crc(data: bytes, width: int, polynomial: int) -> int:
    """Checksum from zero, a byte at a time through a table made from the polynomial."""
    table, mask = _table(width, polynomial), (1 << width) - 1
    crc = 0
    for b in data:
        crc = (crc << 8 & mask) ^ table[(crc >> (width - 8)) ^ b]
    return crc


def fold(residual: np.ndarray) -> np.ndarray:
    """Signed to unsigned, small magnitudes first."""
    return (residual << 1) ^ (residual >> 63)


def rice_plan(residual: np.ndarray, order: int, block: int) -> tuple[int, int, list[int]]:
    """(bits, partition order, parameter of each partition) of the cheapest plan. Sums of the finest partitions are
    added in pairs for the coarser ones; a partition's bits are those of n (k + 1) + (sum >> k), an upper bound."""
    u = fold(residual)
    finest = 0
    while finest < MAX_PARTITION and block % (2 << finest) == 0 and block >> (finest + 1) > order:
        finest += 1
    padded = np.concatenate([np.zeros(order, dtype=np.int64), u])
    sums = padded.reshape(1 << finest, -1).sum(axis=1)
    best: tuple[int, int, list[int]] | None = None
    ks = np.arange(31)
    for p in range(finest, -1, -1):
        n = np.full(1 << p, block >> p, dtype=np.int64)
        n[0] -= order
        costs = n[:, None] * (ks + 1) + (sums[:, None] >> ks)
        k = costs.argmin(axis=1)
        bits = int(costs.min(axis=1).sum()) + 5 * len(n)
        if best is None or bits <= best[0]:
            best = bits, p, k.tolist()
        sums = sums.reshape(-1, 2).sum(axis=1) if p else sums
    return best


def predictor(x: np.ndarray, order: int) -> tuple[np.ndarray, int] | None:
    """Integer coefficients and shift of a linear predictor: autocorrelation of the windowed block, Levinson's
    recursion, rounding with the error carried on. None where it can't be had."""
    w = x * np.hanning(len(x) + 2)[1:-1]
    r = np.array([w[: len(w) - k] @ w[k:] for k in range(order + 1)])
    if r[0] <= 0:
        return None
    a, error = np.zeros(0), r[0]
    for m in range(order):
        k = (r[m + 1] - a @ r[m:0:-1]) / error
        a = np.concatenate([a - k * a[::-1], [k]])
        error *= 1 - k * k
        if error <= 0:
            return None
    top = np.abs(a).max()
    if not np.isfinite(top) or top == 0:
        return None
    shift = min(15, PRECISION - 1 - int(np.floor(np.log2(top))) - 1)
    if shift < 0:
        return None
    q, carry = np.empty(order, dtype=np.int64), 0.0
    limit = (1 << (PRECISION - 1)) - 1
    for i, c in enumerate(a):
        wanted = c * (1 << shift) + carry
        q[i] = max(-limit - 1, min(limit, round(wanted)))
        carry = wanted - q[i]
    return q, shift


def subframe(out: Bits, x: np.ndarray, depth: int) -> None:
    """One channel: constant, verbatim, fixed or linear prediction, by which takes the fewest bits."""
    n = len(x)
    if n and (x == x[0]).all():
        out.put(0, 8)
        out.put(int(x[0]), depth)
        return
    best: tuple = (n * depth, None)
    d = x
    for order in range(5):
        if order >= n:
            break
        if order:
            d = np.diff(d)
        plan = rice_plan(d, order, n)
        bits = 6 + order * depth + plan[0]
        if bits < best[0]:
            best = bits, 8 | order, order, d, plan, None
    for order in (4, 8, MAX_ORDER):
        p = predictor(x.astype(float), order) if n > 2 * order else None
        if p is not None:
            q, shift = p
            guess = np.zeros(n - order, dtype=np.int64)
            for i, c in enumerate(q):
                guess += c * x[order - 1 - i : n - 1 - i]
            residual = x[order:] - (guess >> shift)
            plan = rice_plan(residual, order, n)
            bits = 6 + 9 + order * (depth + PRECISION) + plan[0]
            if bits < best[0] and np.abs(residual).max(initial=0) < 1 << 31:
                best = bits, 31 + order, order, residual, plan, p
    if best[1] is None:
        out.put(1 << 1, 8)
        out.many(x, depth)
        return
    _, kind, order, residual, (_, partitions, ks), p = best
    out.put(kind << 1, 8)
    out.many(x[:order], depth)
    if p is not None:
        out.put(PRECISION - 1, 4)
        out.put(p[1], 5)
        out.many(p[0], PRECISION)
    out.put(1, 2)  # parameters of five bits
    out.put(partitions, 4)
    u, at = fold(residual), 0
    for i, k in enumerate(ks):
        size = (n >> partitions) - (order if i == 0 else 0)
        out.put(k, 5)
        out.rice(u[at : at + size], k)
        at += size


# Codes of sample depths in a frame's header.
DEPTHS = {16: 4, 24: 6, 32: 7}


def frame(number: int, channels: np.ndarray, depth: int) -> bytes:
    """A frame of samples (channels, n): 1 to 8 channels coded on their own, 1 to 65,536 samples of 16 or 24 bits."""
    count, n = channels.shape
    if not 1 <= count <= 8 or not 1 <= n <= 65536 or depth not in (16, 24):
        raise ValueError(f"{count} channels of {n} samples with {depth} bits")
    out = Bits()
    out.put(0b11111111111110, 14)
    out.put(0, 2)
    out.put(7, 4)  # 16 bits of block size follow
    out.put(0, 4)  # the rate is the stream's
    out.put(count - 1, 4)
    out.put(DEPTHS[depth], 3)
    out.put(0, 1)
    for b in _coded(number):
        out.put(b, 8)
    out.put(n - 1, 16)
    out.put(_crc(out.bytes(), 8, 0x07), 8)
    for x in channels:
        subframe(out, x.astype(np.int64), depth)
    out.put(0, -out.size % 8)
    body = out.bytes()
    return body + _crc(body, 16, 0x8005).to_bytes(2, "big")


def _coded(number: int) -> list[int]:
    """A frame number in one to seven bytes, in the manner of UTF-8."""
    if number < 0x80:
        return [number]
    size = next(s for s in range(2, 8) if number < 1 << (5 * s + 1))
    lead = (0xFF00 >> size) & 0xFF | number >> 6 * (size - 1)
    return [lead] + [0x80 | number >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]


def encode_blocks(blocks: DataFrame, depth: int) -> DataFrame:
    """blocks (file, block, channels: array of one array of samples per channel) as (file, block, frame, n_bytes). Rows
    with a null part are errors of the source and give a null frame."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frames = [None if b is None or b != b or c is None else frame(int(b), np.stack([np.asarray(x) for x in c]), depth) for b, c in zip(batch["block"], batch["channels"])]
            yield pd.DataFrame({"file": batch["file"], "block": batch["block"], "frame": frames})

    out = blocks.select("file", "block", "channels").mapInPandas(encode, "file string, block long, frame binary")
    return out.withColumn("n_bytes", F.length("frame").cast("long"))
