"""Measures: gated loudness, nearest-rank percentiles, histograms with slopes, lag search, best codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions import levels
from auralake.functions.codes import zigzag
from auralake.operators.report import nearest_ranks


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value at rank round((n - 1) * fraction) of a sorted array; null for an empty one."""
    at = F.round((F.size(values) - 1) * fraction).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(values, at))


def sub_blocks(samples: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Weighted energy of each sub-block on a grid without holes, up to each programme's last.

    samples: keys, channel, sub, x. weight: of a channel, an expression on it; 0 or null excludes a channel.
    """
    each = samples.groupBy(*keys, "channel", "sub").agg((F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("ms"))
    e = each.groupBy(*keys, "sub").agg(F.sum(weight * F.col("ms")).alias("e"))
    ends = samples.groupBy(*keys).agg(F.min("sub").alias("lo"), F.max("sub").alias("hi"))
    grid = ends.select(*keys, F.explode(F.sequence("lo", "hi")).alias("sub"))
    return grid.join(e, [*keys, "sub"], "left").fillna(0.0, ["e"])


def sliding(blocks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean energy of the last n sub-blocks, where there are as many."""
    w = Window.partitionBy(*keys).orderBy("sub")
    full = blocks.withColumns({"mean": F.avg("e").over(w.rowsBetween(1 - n, 0)), "_n": F.row_number().over(w)})
    return full.where(F.col("_n") >= n).drop("_n")


def gated(blocks: DataFrame, keys: list[str], gate: float) -> DataFrame:
    """Blocks over the absolute gate that are also over the programme's mean of such blocks plus `gate`."""
    loud = blocks.where(levels.loudness(F.col("mean")) > levels.ABSOLUTE_GATE)
    mean = loud.groupBy(*keys).agg(F.avg("mean").alias("_m"))
    return loud.join(mean, keys).where(levels.loudness(F.col("mean")) > levels.loudness(F.col("_m")) + gate).drop("_m")


def integrated(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """By programme the number of blocks over both gates and their loudness; minus infinity where there is none."""
    kept = gated(blocks, keys, levels.RELATIVE_GATE).groupBy(*keys).agg(F.count("*").alias("blocks"), levels.loudness(F.avg("mean")).alias("lufs"))
    every = blocks.select(*keys).distinct()
    return every.join(kept, keys, "left").select(*keys, F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("lufs", F.lit(float("-inf"))).alias("lufs"))


def dialogue_loudness(blocks: DataFrame, speech: DataFrame, keys: list[str], block: str = "sub") -> DataFrame:
    """integrated() over the blocks that speech (keys, block) names, gated against each other alone; minus infinity for
    a programme without any. With the share of blocks that are speech."""
    said = blocks.join(speech.select(*keys, F.col(block), F.lit(True).alias("_said")).distinct(), [*keys, block], "left")
    share = said.groupBy(*keys).agg(F.avg(F.coalesce("_said", F.lit(False)).cast("double")).alias("share"))
    kept = integrated(said.where("_said").drop("_said"), keys)
    return share.join(kept, keys, "left").select(*keys, F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("lufs", F.lit(float("-inf"))).alias("lufs"), "share")


def loudness_range(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of the short-term loudness of gated blocks: nearest-rank 95 % less 10 %, never under 0."""
    r = nearest_ranks(kept.withColumn("_l", levels.loudness(F.col("mean"))), keys, "_l", {"high": 0.95, "low": 0.1})
    return r.select(*keys, F.greatest(F.lit(0.0), F.col("high") - F.col("low")).alias("lra"))


# Labels that take no part in loudness, labels behind or beside the listener, and their weight.
EXCLUDED = ["LFE", "LFE1", "LFE2", "LFEL", "LFER"]
SURROUND = ["M+090", "M-090", "M+110", "M-110", "M+135", "M-135"]
SURROUND_WEIGHT = 1.41


def channel_weight(label: Column) -> Column:
    """Weight of a speaker label in loudness; labels that aren't known weigh 1."""
    return F.when(label.isin(*EXCLUDED), 0.0).when(label.isin(*SURROUND), SURROUND_WEIGHT).otherwise(1.0)


def histogram_slope(df: DataFrame, level: Column, gain: Column, width: float, least: int, keys: list[str]) -> DataFrame:
    """Mean gain by bins of level with `least` rows or more, and the slope from the kept bin before."""
    bins = df.groupBy(*keys, (F.floor(level / width) * width).alias("bin")).agg(F.count("*").alias("n"), F.avg(gain).alias("gain")).where(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy("bin")
    return bins.withColumn("slope", (F.col("gain") - F.lag("gain").over(w)) / (F.col("bin") - F.lag("bin").over(w)))


def lag_search(a: DataFrame, b: DataFrame, keys: list[str], unit: str, lags: range) -> DataFrame:
    """The offset at which b follows a with the least root mean square difference; the first of equal ones.

    Each row of a is met by one row of b for each of a fixed list of offsets, by an equi-join; no cross join.
    """
    shifted = a.select(*keys, F.col("value").alias("_a"), F.col(unit), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    met = shifted.withColumn(unit, F.col(unit) + F.col("lag")).join(b.select(*keys, unit, F.col("value").alias("_b")), [*keys, unit])
    rms = met.groupBy(*keys, "lag").agg(F.round(F.sqrt(F.avg(F.pow(F.col("_a") - F.col("_b"), 2))), 6).alias("rms"))
    return rms.groupBy(*keys).agg(F.min(F.struct("rms", "lag")).alias("m")).select(*keys, "m.lag", "m.rms")


def rice_parameter(df: DataFrame, keys: list[str], residual: Column, most: int = 14) -> DataFrame:
    """The first parameter k with the fewest bits n (k + 1) + (sum of zig-zagged residuals >> k)."""
    s = df.groupBy(*keys).agg(F.sum(zigzag(residual)).alias("s"), F.count("*").alias("n"))
    bits = [F.struct((F.col("n") * (k + 1) + F.shiftright("s", k)).alias("bits"), F.lit(k).alias("k")) for k in range(most + 1)]
    return s.select(*keys, F.array_min(F.array(*bits)).alias("b")).select(*keys, "b.k", "b.bits")


def fixed_predictors(df: DataFrame, keys: list[str], order: list[str], sample: str) -> DataFrame:
    """Sum of absolute residuals of the fixed polynomial predictors of order 0 to 4, and the first best order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = [F.col(sample), *[F.coalesce(F.lag(sample, k).over(w), F.lit(0)) for k in range(1, 5)]]
    rows = df.select(*keys, x[0].alias("r0"), (x[0] - x[1]).alias("r1"), (x[0] - 2 * x[1] + x[2]).alias("r2"), (x[0] - 3 * x[1] + 3 * x[2] - x[3]).alias("r3"), (x[0] - 4 * x[1] + 6 * x[2] - 4 * x[3] + x[4]).alias("r4"))
    sums = rows.groupBy(*keys).agg(*[F.sum(F.abs(f"r{i}")).alias(f"s{i}") for i in range(5)])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(i).alias("o")) for i in range(5)]))
    return sums.withColumn("best_order", best["o"])


def peaks_since(samples: DataFrame, keys: list[str], index: str, x: str, every: int) -> DataFrame:
    """keys, take, peak: the largest magnitude in each interval of `every` samples, as a meter that is read and reset."""
    return samples.groupBy(*keys, F.floor(F.col(index) / every).alias("take")).agg(F.max(F.abs(x)).alias("peak"))


def autocorrelation(samples: DataFrame, keys: list[str], index: str, x: str, lags: int) -> DataFrame:
    """keys, lag, r: sum of x[n] x[n + lag] for lags from 0 on, over samples without gaps."""
    w = Window.partitionBy(*keys).orderBy(index)
    terms = [F.sum(F.col(f"_x{k}")).alias(f"_r{k}") for k in range(lags + 1)]
    rows = samples.select(*keys, *[(F.col(x) * F.lead(x, k).over(w)).alias(f"_x{k}") for k in range(lags + 1)])
    sums = rows.groupBy(*keys).agg(*terms)
    return sums.select(*keys, F.posexplode(F.array(*[F.coalesce(f"_r{k}", F.lit(0.0)) for k in range(lags + 1)])).alias("lag", "r"))


def least_squares(samples: DataFrame, keys: list[str], target: str, sources: list[str], bits: int) -> DataFrame:
    """keys, weights: the weights of sources that come nearest to the target, in steps of 2 ** -bits; null where the
    sources don't determine them. The products are added up where the samples are; a key's sums are one small row."""
    pairs = [(a, b) for i, a in enumerate(sources) for b in [*sources[i:], target]]
    sums = samples.groupBy(*keys).agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, out = len(sources), []
        for r in rows[[f"_{i}" for i in range(len(pairs))]].to_numpy(float):
            gram, right = np.zeros((n, n)), np.zeros(n)
            for (a, b), v in zip(pairs, r):
                if b == target:
                    right[sources.index(a)] = v
                else:
                    gram[sources.index(a), sources.index(b)] = gram[sources.index(b), sources.index(a)] = v
            good = np.isfinite(gram).all() and np.linalg.matrix_rank(gram) == n
            out.append(np.floor(np.linalg.solve(gram, right) * 2**bits + 0.5).astype(np.int64).tolist() if good else None)
        return pd.DataFrame({**{k: rows[k] for k in keys}, "weights": out})

    types = dict(samples.dtypes)
    return sums.mapInPandas(lambda batches: map(solve, batches), ", ".join([*[f"{k} {types[k]}" for k in keys], "weights array<long>"]))
