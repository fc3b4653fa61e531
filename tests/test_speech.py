"""Speech gate, dialogue blocks, paths and followers against frame-by-frame versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import speech as S


def gate(voiced, attack, hangover):
    opened = [False] * (len(voiced) + hangover)
    run, is_open, quiet = 0, False, 0
    pending = None
    for i in range(len(opened)):
        v = i < len(voiced) and voiced[i]
        run = run + 1 if v else 0
        quiet = 0 if v else quiet + 1
        if not is_open and run >= attack:
            is_open = True
            for b in range(i - attack + 1, i):
                opened[b] = True
        if is_open and quiet > hangover:
            is_open = False
        opened[i] = opened[i] or is_open
    return opened


def test_gate(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(60):
        v = rng.random(40) < rng.choice([0.1, 0.3, 0.7])
        rows += [(k, i, bool(x)) for i, x in enumerate(v)]
        want[k] = [i for i, o in enumerate(gate(v.tolist(), 3, 5)) if o]
    df = spark.createDataFrame(rows + rows[:50] + [(1, 90, None)], "k int, i int, v boolean")
    got = {k: [] for k in want}
    for r in S.speech_gate(df, ["k"], "i", F.col("v"), 3, 5).collect():
        got[r.k] += range(r.opened, r.closed + 1)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_dialogue_blocks(spark):
    rng = np.random.default_rng(7)
    v, o = rng.random((2, 403)) < np.array([[0.3], [0.8]])
    v[100:160] = False
    df = spark.createDataFrame([(1, i, bool(a), bool(b)) for i, (a, b) in enumerate(zip(v, o)) if i != 205], "k int, i int, v boolean, o boolean")
    full = [b for b in range(40) if b != 20]
    want = []
    for b in range(37):
        subs = range(b, b + 4)
        ok = all(s in full and o[s * 10 : s * 10 + 10].mean() >= 0.5 for s in subs)
        if ok and v[b * 10 : b * 10 + 10].any() and v[b * 10 + 30 : b * 10 + 40].any() and v[b * 10 : b * 10 + 40].sum() >= 10:
            want.append(b)
    assert sorted(r.block for r in S.dialogue_blocks(df, ["k"], "i", "v", "o").collect()) == want and want


def test_path():
    a, b, c = (0.0,), (10.0,), (0.0,)
    assert S.path([(5, a, 0), (10, b, 10), (15, c, 0), (20, c, 4)]) == [(0, 5, a, a), (5, 10, a, a), (10, 15, a, (5.0,)), (15, 20, c, c), (20, 24, c, c), (24, None, c, c)]
    assert S.path([]) == [] and S.path([(0, a, 0), (0, b, 0)]) == [(0, None, b, b)]


def test_path_segments(spark):
    df = spark.createDataFrame([("o", 0, 1.0, 0.0, 0), ("o", 8, 3.0, 0.0, 4), ("p", 2, None, 0.0, 1)], "id string, at long, x double, y double, ramp int")
    got = [tuple(r) for r in S.path_segments(df, "id", "at", ["x", "y"], "ramp").orderBy("start").collect()]
    assert got == [("o", 0, 8, 1.0, 1.0, 0.0, 0.0), ("o", 8, 12, 1.0, 3.0, 0.0, 0.0), ("o", 12, None, 3.0, 3.0, 0.0, 0.0)]


@pytest.mark.parametrize("alpha", [0.02, 0.5, 1.0])
def test_follow(spark, alpha):
    x = np.random.default_rng(8).random((2, 300))
    df = spark.createDataFrame([(k, i, float(v)) for k in range(2) for i, v in enumerate(x[k])], "k int, i int, x double")
    got = {(r.k, r.i): r.y for r in S.follow(df.repartition(5), "k", "i", "x", alpha, 16).collect()}
    for k in range(2):
        y = 0.0
        for i, v in enumerate(x[k]):
            y += alpha * (v - y)
            assert got[k, i] == pytest.approx(y, rel=1e-9)
