"""Operators on streams of updates: state in force, segments, changes, islands, runs, holds.

Every window is partitioned by the stream's keys, so that streams are handled in parallel; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls take the last known value of their stream: an omitted field keeps its state."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def asof_join(probes: DataFrame, states: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The latest state of each probe's stream at its time or before; null where there is none yet.

    One shuffle of the union of both sides by key and a running last value: linear, where a range join isn't.
    """
    have = F.struct(*[F.col(c) for c in columns])
    s = states.select(*keys, F.col(at), F.lit(0).alias("_probe"), have.alias("_state"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_row"))
    p = probes.select(*keys, F.col(at), F.lit(1).alias("_probe"), F.lit(None).cast(states.select(have).schema[0].dataType).alias("_state"), F.struct("*").alias("_row"))
    w = Window.partitionBy(*keys).orderBy(at, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    got = s.unionByName(p).withColumn("_state", F.last("_state", ignorenulls=True).over(w)).where("_probe = 1")
    return got.select("_row.*", *[F.col("_state")[c].alias(c) for c in columns])


def segments(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Half-open spans [at, until) between a stream's updates; the last is open-ended (null)."""
    return df.withColumn("until", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def segment_lookup(probes: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, until: str) -> DataFrame:
    """Each probe with the span that holds it (start <= at < until); a stream's spans don't overlap. The latest span that
    starts by then, by asof_join(), and a look at its end: linear in both, whatever a stream's length."""
    rest = [c for c in spans.columns if c not in (*keys, start)]
    s = spans.select(*keys, F.col(start).alias(at), F.col(start).alias("_start"), *[F.col(c).alias(f"_{c}") for c in rest])
    got = asof_join(probes, s, keys, at, ["_start", *[f"_{c}" for c in rest]])
    got = got.where(F.col("_start").isNotNull() & (F.col(f"_{until}").isNull() | (F.col(at) < F.col(f"_{until}"))))
    return got.select(*probes.columns, F.col("_start").alias(start), *[F.col(f"_{c}").alias(c) for c in rest])


def changed(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows whose state differs from the one before in their stream; the first always counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*columns)
    return df.withColumns({"_first": F.row_number().over(w) == 1, "_same": now.eqNullSafe(F.lag(now).over(w))}).where("_first or not _same").drop("_first", "_same")


def islands(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Number the sessions of each stream: a row starts one when it is more than `gap` after the row before."""
    w = Window.partitionBy(*keys).orderBy(at)
    start = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_start", start).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def runs(df: DataFrame, keys: list[str], order: list[str], over: Column, masked: Column) -> DataFrame:
    """Lengths of the runs of `over` in each stream; masked rows neither extend nor break one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.where(~masked).withColumn("_over", over).withColumn("_run", F.sum(F.when(F.col("_over"), 0).otherwise(1)).over(w))
    return marked.where("_over").groupBy(*keys, "_run").agg(F.count("*").alias("run_length")).drop("_run")


def held(df: DataFrame, keys: list[str], order: list[str], value: str, behind: int, ahead: int) -> Column:
    """Look-ahead hold: the largest of a value, those behind, and those ahead that are twice as large or more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = F.col(value)
    later = [F.when(F.lead(value, k).over(w) >= 2 * own, F.lead(value, k).over(w)) for k in range(1, ahead + 1)]
    return F.greatest(own, F.max(value).over(w.rowsBetween(-behind, -1)), *later)
