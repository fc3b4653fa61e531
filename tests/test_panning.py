"""Hulls, fits, seeds, bands and features by their properties and by brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auralake.functions import codes as C
from auralake.operators import clustering as K
from auralake.operators import features as Y
from auralake.operators import panning as N
from auralake.operators import scene as S
from auralake.operators.lossless import Bits, Reader

BEDS = ["L", "R", "C", "Lss", "Rss", "Lrs", "Rrs", "Lfh", "Rfh"]


def test_hull_gains_have_constant_power(spark):
    r = np.random.default_rng(1)
    d = r.normal(size=(500, 3))
    hull = N.Hull(N.speaker_directions(BEDS))
    for spread in (None, r.random(500)):
        g = hull.gains(d, spread)
        assert (g >= 0).all() and np.allclose((g**2).sum(1), 1)
    assert np.allclose(hull.gains(N.speaker_directions(BEDS)), np.eye(len(BEDS)), atol=1e-6)
    df = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0])], "i int, p array<double>")
    got = {x.i: x.gains for x in N.hull_gains(df, "p", BEDS).collect()}
    assert got[2] is None and got[1] == got[3] and round(got[1][2], 6) == 1
    with pytest.raises(ValueError):
        N.Hull(np.array([[1.0, 0, 0], [0, 1, 0]]))


def test_point_gains(spark):
    pts = [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 0.0]]
    df = spark.createDataFrame([(1, 1, pts[0], pts), (1, 2, [1.0, 1.0, 0.0], pts), (2, 1, pts[0], pts[:2])], "g int, i int, p array<double>, pts array<array<double>>")
    got = {(r.g, r.i): r.gains for r in N.point_gains(df, ["g"], "i", "p", "pts").collect()}
    assert np.allclose(got[(1, 1)], [1, 0, 0, 0]) and np.allclose(got[(1, 2)], [0.5**0.5, 0, 0.5**0.5, 0]) and got[(2, 1)] is None


def test_presentation_matrix():
    assert N.presentation_matrix("5.1", "same_side")[("Lrs", "Rs")] == 0 and N.presentation_matrix("7.1")[("LFE", "LFE")] == 1
    assert sum(g * g for (s, _), g in N.presentation_matrix("5.1").items() if s == "Lrs") == pytest.approx(1)
    with pytest.raises(ValueError):
        N.presentation_matrix("22.2")


def test_capped_fit_is_no_worse_than_the_strongest():
    r = np.random.default_rng(2)
    worse, ours, theirs = 0, 0.0, 0.0
    for _ in range(60):
        a, b = r.random((8, 7)), r.random(8)
        x = K.capped(a, b, 3)
        every = min(np.linalg.norm(a[:, c] @ K.nnls(a[:, c], b) - b) for c in map(list, itertools.combinations(range(7), 3)))
        free = K.nnls(a, b)
        strongest = np.sort(np.argsort(-free * np.linalg.norm(a, axis=0))[:3])
        assert np.count_nonzero(x) <= 3 and (x >= 0).all()
        worse += np.linalg.norm(a @ x - b) > 1.02 * every
        ours += np.linalg.norm(a @ x - b)
        theirs += np.linalg.norm(a[:, strongest] @ K.nnls(a[:, strongest], b) - b)
    assert worse <= 6 and ours <= theirs


def test_a_set_is_held_when_it_costs_little():
    a = np.array([[1.0, 0.95, 0.0], [0.0, 0.3, 1.0]])
    near = np.array([0.97, 0.15])  # beside the second column, a little off the first
    assert np.flatnonzero(K.sparse_fit(a, near, 1)).tolist() == [0] or np.flatnonzero(K.sparse_fit(a, near, 1)).tolist() == [1]
    for before in (0, 1):
        held = np.eye(3)[before]
        costs = [np.linalg.norm(a[:, [c]] @ K.nnls(a[:, [c]], near) - near) for c in (0, 1)]
        kept = np.flatnonzero(K.sparse_fit(a, near, 1, held=held)).tolist()
        assert kept == [before if costs[before] <= K.HELD * min(costs) else int(np.argmin(costs))]
    b = np.array([1.0, 1.0])
    assert K.sparse_fit(a, b, 2, held=np.array([1.0, 0.0, 0.0]))[2] > 0  # far too costly to keep
    allowed = np.array([True, False, False])
    assert np.flatnonzero(K.sparse_fit(a, b, 2, allowed=allowed)).tolist() == [0]
    x = K.sparse_fit(a, b, 3, bounds=np.array([0.4, 0.4, 0.4]))
    assert (x <= 0.4 + 1e-9).all()


def test_capture_is_greedy(spark):
    r = np.random.default_rng(3)
    e, t = r.random(9), r.random((9, 4))
    got = K.capture(e, t, 3)
    u = t / np.linalg.norm(t, axis=1, keepdims=True)
    kernel, served, want = np.clip(u @ u.T, 0, 1), np.zeros(9), []
    for _ in range(3):
        gains = [(-1.0 if c in want else sum(e[o] * max(0, kernel[c, o] - served[o]) for o in range(9))) for c in range(9)]
        want.append(int(np.argmax(gains)))
        served = np.maximum(served, kernel[want[-1]])
    assert got == want
    df = spark.createDataFrame(pd.DataFrame({"b": [1] * 9, "i": range(9), "t": t.tolist(), "e": e}))
    assert [x.i for x in K.capture_blocks(df, "b", "i", "t", "e", 3).orderBy("place").collect()] == want


def test_allocation():
    curves = [np.array([9.0, 4, 2, 1.5]), np.array([8.0, 7, 1, 0.5]), np.array([5.0, 0])]
    assert K.allocate(curves, [True, True, False], 4) == [2, 2, 0]
    assert K.allocate(curves, [True, True, True], 2) is None and K.allocate(curves, [False] * 3, 5) == [5, 0, 0]
    assert K.allocate(curves, [True, True, True], 4, previous=[2, 1, 1]) == [1, 2, 1]  # six is worth more than two
    assert K.allocate([np.array([9.0, 4, 2]), np.array([9.0, 4, 2.01])], [True, True], 3, previous=[1, 2]) == [1, 2]
    assert K.allocate([np.array([1.0, 0.0])], [True], 4) == [4]


def test_renumber_follows_the_elements():
    r = np.random.default_rng(5)
    w, d = r.random((6, 4)), N.directions_of(r.normal(size=(4, 3)))
    order = np.array([2, 0, 3, 1])
    assert K.renumber(w, w[:, order], d, d[order]).tolist() == order.tolist()


def test_bands_hold_the_weighted_power():
    rate, n = 48000, 1280
    t = np.arange(n) / rate
    for hz in (200.0, 1000.0, 5000.0):
        x = 0.5 * np.sin(2 * np.pi * hz * t)
        p = Y.Bands(rate, n, 20)(x)
        want = 0.125 * Y.response(rate, np.array([hz]))[0] ** 2
        assert p.sum() == pytest.approx(want, rel=0.03) and p.argmax() == int(21.4 * np.log10(1 + 0.00437 * hz) / (21.4 * np.log10(1 + 0.00437 * 20000) / 20))
    assert Y.Bands(rate, n, 20)(np.zeros(n)).sum() == 0


def test_features_tell_a_voice_from_a_tone(spark):
    rate, n = 16000, 1280
    t = np.arange(n * 8) / rate
    voice = sum(np.sin(2 * np.pi * 150 * k * t) / k for k in range(1, 30)) * (0.6 + 0.4 * np.sin(2 * np.pi * 4 * t)) * 1e6
    noise = np.random.default_rng(1).normal(0, 5e5, len(t))
    rows = [(f, rate, 0, i, x[i * n : (i + 1) * n].astype(int).tolist()) for f, x in (("voice", voice), ("noise", noise)) for i in range(8)] + [("silent", rate, 0, 0, None)]
    got = Y.features(spark.createDataFrame(rows, "file string, rate int, channel int, frame long, samples array<int>"), 100.0, 150).collect()
    by = {f: [g for g in got if g.file == f] for f in ("voice", "noise", "silent")}
    assert len(by["voice"]) == 8 and min(g.cpp for g in by["voice"]) > max(g.cpp for g in by["noise"]) and by["voice"][0].flux == float("inf")
    assert np.mean([g.flatness for g in by["noise"]]) > np.mean([g.flatness for g in by["voice"]]) and by["silent"][0].level < -200
    power = Y.band_power(spark.createDataFrame(rows, "file string, rate int, channel int, block long, samples array<int>"), n, 8).collect()
    assert len(power) == 17 and all(len(p.power) == 8 for p in power)


def test_tracker_floor():
    track = Y.Tracker(100.0, 10)
    floors = [track(-60.0 + (i % 10))[0] for i in range(25)]
    assert floors[:9] == [-80.0] * 9 and floors[9:] == [-60.0] * 16


def test_bits_read_back():
    out = Bits()
    out.put(5, 3)
    out.put(-3, 7)
    out.rice(np.array([0, 9, 77]), 3)
    data = out.bytes() if hasattr(out, "bytes") else np.packbits(np.concatenate(out.parts)).tobytes()
    r = Reader(data)
    assert (r.get(3), r.signed(7), [r.rice(3) for _ in range(3)]) == (5, -3, [0, 9, 77])
    with pytest.raises(ValueError):
        r.get(100)


def test_digests_and_crcs(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(),), (None,)], "b binary")
    for key in (b"k", b"long" * 40):
        got = [r.m for r in df.select(C.hmac_sha256(F.col("b"), key).alias("m")).collect()]
        assert got == [hmac.new(key, b"123456789", hashlib.sha256).hexdigest(), hmac.new(key, b"", hashlib.sha256).hexdigest(), None]
    check = df.limit(1).select(C.crc(16, 0x1021, 0xFFFF)("b").alias("a"), C.crc(8, 0x07)("b").alias("c"), C.crc(32, 0x04C11DB7, 0xFFFFFFFF, 0xFFFFFFFF)("b").alias("d"), C.parity("b").alias("p")).collect()[0]
    assert tuple(check) == (0x29B1, 0xF4, 0xFC891918, 0x31)


def test_perceptual_weights(spark):
    r = np.random.default_rng(7)
    rows = [(1, i, (r.random(3) * 1e-6).tolist(), r.random(4).tolist(), 1.0) for i in range(5)] + [(2, 9, [1e-6] * 3, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "s int, object int, powers array<double>, radiated array<double>, importance double")

    def loud(x):
        return (x + 4.72) ** 0.2 - 4.72**0.2

    for local in (True, False):
        got = {x.object: x.energy for x in S.perceptual_weights(df, ["s"], local).collect()}
        for s, i, p, g, _ in rows:
            total = 0.0
            for b in range(3):
                m = sum(q[b] * (max(0, np.dot(g, h) / np.linalg.norm(g) / np.linalg.norm(h)) if local else 1) for t, j, q, h, _ in rows if t == s and j != i)
                total += loud((m + p[b]) * S.FULL_SCALE_EXCITATION) - loud(m * S.FULL_SCALE_EXCITATION)
            assert got[i] == pytest.approx(total)
