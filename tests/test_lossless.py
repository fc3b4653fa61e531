"""Lossless frames, read back by a plain decoder."""

import numpy as np
import pytest

from auralake.operators import lossless as X


class Reader:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def get(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.get(n)
        return v - (1 << n) if v >> (n - 1) else v

    def rice(self, k):
        end = self.bits.index("1", self.at)
        q, self.at = end - self.at, end + 1
        u = q << k | self.get(k)
        return u >> 1 if u % 2 == 0 else -(u >> 1) - 1


def decode(data):
    r = Reader(data)
    assert r.get(14) == 0x3FFE and r.get(2) == 0 and r.get(4) == 7 and r.get(4) == 0
    count, depth = r.get(4) + 1, {4: 16, 6: 24}[r.get(3)]
    r.get(1)
    lead = r.get(8)
    ones = f"{lead:08b}".index("0") if lead != 0xFF else 8
    number = lead if not ones else lead & (0x7F >> ones)
    for _ in range(max(0, ones - 1)):
        number = number << 6 | r.get(8) & 0x3F
    n = r.get(16) + 1
    r.get(8)
    out = []
    for _ in range(count):
        kind = r.get(8) >> 1
        if kind == 0:
            x = [r.signed(depth)] * n
        elif kind == 1:
            x = [r.signed(depth) for _ in range(n)]
        else:
            order = kind & 7 if kind < 32 else kind - 31
            x = [r.signed(depth) for _ in range(order)]
            if kind < 32:
                c, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            else:
                precision, shift = r.get(4) + 1, r.get(5)
                c = [r.signed(precision) for _ in range(order)]
            assert r.get(2) == 1
            parts = r.get(4)
            for p in range(1 << parts):
                k = r.get(5)
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    x.append(r.rice(k) + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        out.append(x)
    return number, np.array(out)


def signals():
    t = np.arange(960)
    rng = np.random.default_rng(5)
    yield "silence", np.zeros((2, 960), dtype=np.int64), 16
    yield "tone", np.stack([20000 * np.sin(t / 9), 900 * np.cos(t / 50) + rng.normal(size=960) * 3]).astype(np.int64), 16
    yield "noise", rng.integers(-(1 << 23), 1 << 23, (1, 960)), 24
    yield "extremes", np.where(rng.random((3, 333)) < 0.5, -(1 << 23), (1 << 23) - 1), 24
    yield "one sample", np.array([[-5], [7]]), 16
    yield "ramp", np.arange(-500, 500)[None] * 30, 16


@pytest.mark.parametrize("name, x, depth", list(signals()))
@pytest.mark.parametrize("number", [0, 127, 128, 70_000, 2**31])
def test_round_trip(name, x, depth, number):
    data = X.frame(number, x, depth)
    got, y = decode(data)
    assert got == number and (y == x).all()
    assert X._crc(data, 16, 0x8005) == 0
    if name in ("silence", "tone", "ramp"):
        assert len(data) < x.size * depth / 8 * 0.8


def test_refuses():
    for shape, depth in (((0, 5), 16), ((9, 5), 16), ((1, 0), 16), ((1, 5), 32)):
        with pytest.raises(ValueError):
            X.frame(0, np.zeros(shape, dtype=np.int64), depth)


def test_blocks(spark):
    df = spark.createDataFrame([("a", 0, [[1, 2, 3], [4, 4, 4]]), ("a", 1, None), ("a", 2, [[0], [9]])], "file string, block long, channels array<array<int>>")
    got = {r.block: r.frame for r in X.encode_blocks(df, 16).collect()}
    assert got[1] is None and decode(got[0])[1].tolist() == [[1, 2, 3], [4, 4, 4]] and decode(got[2])[0] == 2
    assert X.encode_blocks(df.where("block > 9"), 16).count() == 0
