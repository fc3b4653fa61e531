"""Geometry, codes, scene and clustering operators by example and against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auralake.functions import codes as C
from auralake.functions import geometry as G
from auralake.operators import clustering as K
from auralake.operators import scene as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "polar, cube",
    [((0, 0, 1), (0, 1, 0)), ((-30, 0, 1), (1, 1, 0)), ((110, 0, 1), (-1, -1, 0)), ((-110, 30, 1), (1, -1, 1)), ((180, 0, 1), (0, -1, 0)), ((0, 90, 1), (0, 0, 1)), ((30, -30, 0.5), (-0.5, 0.5, -0.5))],
)
def test_polar_to_cube(spark, polar, cube):
    p = one(spark, G.polar_to_cube(*[F.lit(float(v)) for v in polar]).alias("p"))[0]
    assert tuple(p) == pytest.approx(cube, abs=1e-9)


def test_polar_round_trip(spark):
    df = spark.createDataFrame([(float(a), float(e), 0.7) for a in range(-175, 180, 7) for e in (-80, -30, -3, 0, 20, 30, 55, 85)], "a double, e double, d double")
    back = df.withColumn("c", G.polar_to_cube(F.col("a"), F.col("e"), F.col("d"))).withColumn("p", G.cube_to_polar(F.col("c.x"), F.col("c.y"), F.col("c.z")))
    for r in back.collect():
        assert (r.p.azimuth, r.p.elevation, r.p.distance) == pytest.approx((r.a, r.e, r.d), abs=1e-7)


def test_poles_and_centre(spark):
    z, o = F.lit(0.0), F.lit(-1.0)
    assert tuple(one(spark, G.cube_to_polar(z, z, z))[0]) == (0, 0, 0)
    assert tuple(one(spark, G.cube_to_polar(z, z, o))[0]) == (0, -90, 1)


def test_room_gains_keep_power(spark):
    speakers = {"a": (-1.0, 1.0, 0.0), "b": (1.0, 1.0, 0.0), "c": (0.0, -1.0, 0.0), "d": (0.0, 0.0, 1.0)}
    g = G.room_gains(F.lit(0.3), F.lit(-0.2), F.lit(0.4), speakers)
    assert sum(v * v for v in one(spark, *g.values())) == pytest.approx(1)
    assert one(spark, *G.room_gains(F.lit(5.0), F.lit(1.0), F.lit(-1.0), speakers).values()) == pytest.approx((0, 1, 0, 0))


def test_gain_words(spark):
    words = spark.range(256).withColumn("g", C.gain_of_word(F.col("id"), 3, 5))
    assert words.where(C.gain_word(F.col("g"), 3, 5) != F.col("id")).count() == 0
    got = one(spark, *[C.gain_word(F.lit(v), 3, 5) for v in (0.0, -1.0, float("nan"), 1e9, 1e-9, 1.0)])
    assert got == (128, 128, 128, 127, 128, 0)


def test_codes(spark):
    n = [0, 1, 127, 128, 300, 2**40, 2**62]
    df = spark.createDataFrame([(v,) for v in n], "v long").select("v", C.leb128(F.col("v")).alias("h"))

    def plain(v):
        out = []
        while True:
            out.append(v % 128 + (128 if v >= 128 else 0))
            v //= 128
            if not v:
                return bytes(out).hex()

    assert {r.v: r.h for r in df.collect()} == {v: plain(v) for v in n}
    r = spark.createDataFrame([(v,) for v in (0, -1, 1, -(2**63), 2**63 - 1)], "v long").withColumn("u", C.zigzag(F.col("v")))
    assert [x.b for x in r.select(C.unzigzag(F.col("u")).alias("b")).collect()] == [0, -1, 1, -(2**63), 2**63 - 1]
    assert one(spark, C.clock(F.lit(3661.26)), C.clock(F.lit(-1.0))) == ("1:01:01.3", "0:00:00.0")
    assert one(spark, *[C.whole_db_code(F.lit(v)) for v in (0.0, 1.0, 1e-3, 100.0)]) == (None, 0, None, 15)
    with pytest.raises(Exception, match="a gain of"):
        one(spark, C.whole_db_code(F.lit(-1.0)))


def test_checksums(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b"a"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(C.crc16("b")).collect()][0] == 0x29B1
    assert [r[0] for r in df.select(C.fnv1a("b")).collect()] == ["06d5573923c6cdfc", "af63dc4c8601ec8c", "cbf29ce484222325", None]


@pytest.mark.parametrize(
    "text, samples",
    [("00:00:01.5", 72000), ("01:00:00", 172800000), ("00:00:00.000010416", 0), ("00:00:00.000010417", 1), ("00:00:02.24000S48000", 120000), ("00:00:00.1S0", 0), ("00:00:00.999999999999999999S1", 2**63 - 1), ("1 s", None), (None, None)],
)
def test_times(spark, text, samples):
    assert one(spark, C.time_to_samples(F.lit(text).cast("string"), 48000)) == (samples,)


def test_object_blocks(spark):
    rows = [(1, 0, 0.5, None), (1, 10, None, False), (1, 20, 0.7, None), (1, 30, None, True), (2, 50, None, None)]
    df = spark.createDataFrame(rows, "id int, at int, gain double, active boolean")
    got = S.object_blocks(df, ["id"], ["at"], "at", "gain", "active", F.lit(40)).orderBy("id", "start").collect()
    assert [tuple(r) for r in got] == [(1, 0, 10, 0.5), (1, 10, 20, 0.0), (1, 20, 30, 0.0), (1, 30, 40, 0.7), (2, 50, 50, 1.0)]


def test_weight_flips(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (2, "a", 0.0), (2, "b", None), (3, "b", 1.0)], "b int, k string, w double")
    got = {(r.b, r.k, r.was, r.now) for r in S.weight_flips(df, "b", ["k"], "w").collect()}
    assert got == {(0, "a", 0.0, 1.0), (2, "a", 2.0, 0.0), (3, "b", 0.0, 1.0), (4, "b", 1.0, 0.0)}


def test_beds(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 0, 2), (2, 0, 2), (2, 1, 2), (3, 7, 7)], "e int, x int, y int")
    assert [r.e for r in S.beds(df, "e", [F.col("x"), F.col("y")], [(0, 2), (1, 2)]).collect()] == [1]


def test_verdicts(spark):
    got = one(spark, *[S.verdict(F.lit(s), F.lit(r), 0.5, 2.0) for s, r in ((0.6, 0.0), (0.3, 0.0), (0.1, 1.5), (0.1, 0.1), (None, None))])
    assert got == ("refuse", "remark", "remark", "pass", "pass")


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.normal(size=(6, 5)), rng.normal(size=6)
        x = K.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-8).all() and abs(x @ slope) < 1e-8


def test_sparse_fit():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.random((8, 6)), rng.random(8)
        x = K.sparse_fit(a, b, 3)
        assert np.count_nonzero(x) <= 3 and np.linalg.norm(a @ x) == pytest.approx(np.linalg.norm(b))


def test_assign_is_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(1, 6))
        c = rng.integers(-5, 6, size=(n, n)).astype(float)
        got = K.assign(c)
        assert sorted(got) == list(range(n))
        assert c[np.arange(n), got].sum() == min(c[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n)))


def test_seeds_and_kmeans():
    d = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0]])
    assert K.seed(d, np.array([3.0, 1, 2, 3]), 5).tolist() == [3, 2, 1]
    owner, centres = K.spherical_kmeans(d, np.ones(4), d[[0, 1, 2]])
    assert owner.tolist() == [0, 1, 2, 0] and np.allclose(centres, d[:3])
    near = np.array([[math.cos(math.radians(t)), math.sin(math.radians(t)), 0.0] for t in (0, 10, 6)])
    kept, _ = K.spherical_kmeans(near[[2]], np.ones(1), near[:2], previous=np.array([0]), passes=1)
    assert kept.tolist() == [0]


def test_limiter():
    p = np.ones(500)
    p[300] = 2.0
    g = K.limiter(p, 1.0)
    assert (g * p <= 1 + 1e-12).all() and g[204] == 0.5 and g[203] == 1.0 and g[301] == pytest.approx(0.5 + 1 / 2400)
    assert (K.limiter(np.ones(3), 1.0) == 1).all() and len(K.limiter(np.empty(0), 1.0)) == 0


def test_seed_blocks(spark):
    df = spark.createDataFrame(pd.DataFrame({"b": [1, 1, 1, 2], "i": [1, 2, 3, 9], "d": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], "e": [2.0, 1.0, 1.0, 1.0]}))
    got = sorted(tuple(r) for r in K.seed_blocks(df, "b", "i", "d", "e", 2).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (2, 0, 9)]
    assert K.seed_blocks(df.where("b > 5"), "b", "i", "d", "e", 2).count() == 0
