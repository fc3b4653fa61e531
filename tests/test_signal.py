import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.functions import levels
from auralake.operators import signal
from auralake.sources import wav


def test_biquad_is_the_recurrence():
    b, a = signal.shelf(48_000)
    x = np.random.default_rng(1).normal(size=1000)
    f = signal.Biquad(b, a)
    got = np.concatenate([f(x[:333]), f(x[333:400]), f(x[400:])])
    y, s = [], [0.0, 0.0]
    for v in x:
        o = b[0] * v + s[0]
        s = [b[1] * v - a[1] * o + s[1], b[2] * v - a[2] * o]
        y.append(o)
    assert np.allclose(got, y)


def test_full_scale_sine(spark, tmp_path):
    """A 997 Hz sine at full scale has -3.01 LUFS in one channel, and a peak of 1 that its samples needn't reach."""
    rate = 48_000
    t = np.arange(rate * 2) / rate
    x = np.stack([np.sin(2 * np.pi * 997 * t), np.sin(2 * np.pi * rate / 4 * t + np.pi / 4)], 1)
    (tmp_path / "a.wav").write_bytes(wav.encode(np.round(x * ((1 << 23) - 1)).astype(int), rate))
    spark.dataSource.register(wav.WavSource)
    got = signal.k_weighted(spark.read.format("pcm_wav").option("blockSize", 4800).load(str(tmp_path)))
    by = got.where("block >= 4").groupBy("channel").agg(levels.loudness(F.avg("ms")).alias("l"), F.max("peak").alias("p")).orderBy("channel").collect()
    assert by[0].l == pytest.approx(-3.01, abs=0.02)
    assert by[1].p == pytest.approx(1.0, abs=0.03) and np.abs(x[:, 1]).max() < 0.71
