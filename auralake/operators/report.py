"""Reports over corpora and streams: profiles, tallies, histograms, regressions, ranks and presence."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def word_profile(words: DataFrame, keys: list[str], order: list[str], gain: str, unit: str | None = None) -> DataFrame:
    """By key the number of words, lowest and highest gain, distinct gains, changes between neighbours, and the smallest
    gap of units between them (null for a single word or without a unit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = (F.col(unit) - F.lag(unit).over(w)) if unit else F.lit(None).cast("long")
    x = words.select(*keys, F.col(gain).alias("_g"), F.lag(gain).over(w).alias("_was"), gap.alias("_gap"))
    g = F.col("_g")
    return x.groupBy(*keys).agg(
        F.count("*").alias("words"), F.min(g).alias("low"), F.max(g).alias("high"), F.count_distinct(g).alias("gains"),
        F.count_if(F.col("_was") != g).alias("changes"), F.min("_gap").alias("cadence"),
    )


def regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r and the slope of y over x."""
    return df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"))


def bias_rms(df: DataFrame, keys: list[str], error: Column) -> DataFrame:
    """Mean error and root mean square."""
    return df.groupBy(*keys).agg(F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rms"))


def snr(df: DataFrame, keys: list[str], signal: Column, error: Column) -> DataFrame:
    """Ratio of a signal's energy to its error's in decibels; infinite without an error, minus infinity without a signal."""
    g = df.groupBy(*keys).agg(F.coalesce(F.sum(signal * signal), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(error * error), F.lit(0.0)).alias("_e"))
    ratio = F.when(F.col("_e") <= 0, float("inf")).when(F.col("_s") <= 0, float("-inf")).otherwise(10 * F.log10(F.col("_s") / F.when(F.col("_e") > 0, F.col("_e"))))
    return g.select(*keys, ratio.alias("snr"))


def histograms(df: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """Counts by each set of columns in one pass, with the level of the set (bits of the columns that are left out)."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id(*columns).alias("level"), F.count("*").alias("n"), *measures)


def conditional_counts(df: DataFrame, keys: list[str], conditions: Mapping[str, Column]) -> DataFrame:
    """By key how many rows meet each condition; null counts as not met."""
    return df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def absent(declared: DataFrame, found: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Declared rows without a row of found; on names the columns of both. A null key is never found."""
    f = found.select(*[F.col(b).alias(f"_{i}") for i, b in enumerate(on.values())])
    met = None
    for i, a in enumerate(on):
        c = F.col(a) == F.col(f"_{i}")
        met = c if met is None else met & c
    return declared.join(f, met, "left_anti")


def round_trip_status(readable: Column, identical: Column, equivalent: Column) -> Column:
    """failed where it can't be read, identical by bytes, else equivalent once read again, else mismatched."""
    return F.when(~F.coalesce(readable, F.lit(False)), "failed").when(identical, "identical").when(equivalent, "equivalent").otherwise("mismatched")


def tally(df: DataFrame, status: Column) -> DataFrame:
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def flag_rate(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Share of rows whose flag is true; null is false."""
    return df.groupBy(*keys).agg(F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias("rate"))


def ranked(sheet: DataFrame, key: DataFrame, on: str, by: list[str], score: str, order: list[str]) -> DataFrame:
    """The rows of a sheet with the key's columns, and their place by falling score within `by`; ties go by `order`.
    A row of the sheet that the key does not name has place 0, which an error report can be made of."""
    known = sheet.join(key.withColumn("_known", F.lit(True)), on, "left")
    place = F.row_number().over(Window.partitionBy("_known", *by).orderBy(F.col(score).desc(), *order))
    return known.withColumn("place", F.when(F.col("_known"), place).otherwise(0)).drop("_known")


def modes(objects: DataFrame, scene: list[str], mode: list[str], index: str) -> DataFrame:
    """Distinct modes of each scene, numbered (class, from 0) in the order in which they first appear."""
    m = objects.groupBy(*scene, *mode).agg(F.min(index).alias("first_seen"), F.count("*").alias("n"))
    w = Window.partitionBy(*scene).orderBy("first_seen")
    return m.withColumn("class", F.row_number().over(w) - 1)


def class_masks(objects: DataFrame, elements: DataFrame, scene: list[str], mode: list[str]) -> DataFrame:
    """scene, object, element: the elements an object may be spread over, those of its own mode; null is equal to null."""
    e = elements.select(*[F.col(c).alias(f"_{c}") for c in (*scene, *mode)], "element")
    met = None
    for c in (*scene, *mode):
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        met = same if met is None else met & same
    return objects.join(e, met).select(*scene, "object", "element")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """By key the values at ranks round((n - 1) * fraction). Values are ranked by a window, never gathered in a row."""
    w = Window.partitionBy(*keys)
    r = df.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("_rank"), F.count("*").over(w).alias("_n"))
    return r.groupBy(*keys).agg(*[F.max(F.when(F.col("_rank") - 1 == F.round((F.col("_n") - 1) * f), F.col(value))).alias(c) for c, f in fractions.items()])


def quantile_spread(frames: DataFrame, keys: list[str], value: str, level: Column, floor: Column, over: float = 8.0) -> DataFrame:
    """Nearest-rank quartiles of a feature over the frames whose level is `over` decibels or more above the floor."""
    return nearest_ranks(frames.where(level >= floor + over), keys, value, {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99})


def scene_energy(samples: DataFrame, keys: list[str], sample: str, gain: Column, importance: Column | None = None) -> DataFrame:
    """By block and object the mean square times gain squared times importance, and the peak times the gain."""
    x = F.col(sample)
    g = samples.groupBy(*keys).agg(F.avg(x * x).alias("_ms"), F.max(F.abs(x)).alias("_peak"), F.max(gain).alias("_gain"), F.max(importance if importance is not None else F.lit(1.0)).alias("_imp"))
    return g.select(*keys, (F.col("_ms") * F.pow("_gain", F.lit(2)) * F.col("_imp")).alias("energy"), (F.col("_peak") * F.abs("_gain")).alias("peak"))


#: Classes of a set of components, the best first.
USEFULNESS = ("complete", "metadata_only", "unusable")


def usefulness(presentations: DataFrame, keys: list[str], has_metadata: Column, has_audio: Column) -> DataFrame:
    """By set the best class over its presentations: both components, the metadata alone, or neither."""
    rank = F.when(has_metadata & has_audio, 0).when(has_metadata, 1).otherwise(2)
    names = F.array(*[F.lit(n) for n in USEFULNESS])
    return presentations.groupBy(*keys).agg(F.min(rank).alias("_r")).select(*keys, names[F.col("_r")].alias("class"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a full order: the limit of a survey."""
    return df.orderBy(*order).limit(n)


def totals(df: DataFrame, keys: list[str], part: Column, whole: Column, rate: Column) -> DataFrame:
    """By stream the share of a part in a whole (0 for an empty whole) and the largest rate."""
    p, w = F.sum(part), F.sum(whole)
    return df.groupBy(*keys).agg(F.when(w > 0, p / w).otherwise(0.0).alias("share"), F.max(rate).alias("peak_rate"))


def unmodelled(elements: DataFrame, names: str, known: list[str]) -> DataFrame:
    """Names that occur but that the model does not have, with how often they do."""
    return elements.where(~F.col(names).isin(*known)).groupBy(names).agg(F.count("*").alias("n"))


def longest_first(tasks: DataFrame, keys: list[str], cost: str, workers: int, ties: list[str]) -> DataFrame:
    """Order in which tasks are handed out, the most costly first, and the worker of a serpentine deal of that order,
    whose loads differ by one task's cost at most."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(cost).desc(), *ties)) - 1
    lap, at = F.floor(F.col("turn") / workers), F.col("turn") % workers
    return tasks.withColumn("turn", n).withColumn("worker", F.when(lap % 2 == 0, at).otherwise(workers - 1 - at).cast("int"))


def first_difference(a: DataFrame, b: DataFrame, keys: list[str], block: str, data: str, size: int) -> DataFrame:
    """By file the first offset at which two block-wise files differ, null where they are equal; a missing block differs
    at its start. Only the first unequal block of a file is looked into."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, block, F.col(data).alias(name))

    both = side(a, "_a").join(side(b, "_b"), [*keys, block], "full_outer")
    both = both.withColumns({c: F.coalesce(c, F.lit(b"")) for c in ("_a", "_b")})
    unequal = both.where("_a <> _b")  # by bytes, which is no dearer than a digest of both
    first = unequal.groupBy(*keys).agg(F.min_by(F.struct("_a", "_b", F.col(block).alias("k")), block).alias("m"))
    found = first.select(*keys, (F.col("m.k") * size + _unequal("m._a", "m._b")).alias("offset"))
    return both.select(*keys).distinct().join(found, keys, "left")


@F.pandas_udf(LongType())
def _unequal(a: pd.Series, b: pd.Series) -> pd.Series:
    """The first place at which two binary values differ; the shorter one's length where it is the other's beginning."""
    def one(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y))
        at = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)) if n else ()
        return int(at[0]) if len(at) else n

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")
