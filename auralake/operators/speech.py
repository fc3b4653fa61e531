"""Speech gate and dialogue blocks over numbered frames, path segments and one-pole followers over ordered updates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def speech_gate(frames: DataFrame, keys: list[str], index: str, voiced: Column, attack: int = 3, hangover: int = 25) -> DataFrame:
    """(keys, opened, closed): closed intervals in which the gate is open. Voiced frames with at most hangover others
    between them are a session; it opens, back-dated, at the first frame of its first run of attack voiced frames, and
    stays open for hangover frames after its last one. A session without such a run never opens. Repeated frames count
    once; null is unvoiced."""
    v = frames.where(voiced).select(*keys, F.col(index).cast("long").alias("i")).distinct()
    w = Window.partitionBy(*keys).orderBy("i")
    gap = F.col("i") - F.lag("i").over(w)
    v = v.withColumns({"_run": F.coalesce((gap > 1).cast("int"), F.lit(1)), "_session": F.coalesce((gap > hangover + 1).cast("int"), F.lit(1))})
    v = v.withColumns({"_run": F.sum("_run").over(w), "_session": F.sum("_session").over(w)})
    runs = v.groupBy(*keys, "_session", "_run").agg(F.min("i").alias("start"), F.max("i").alias("stop"))
    first = F.min(F.when(F.col("stop") - F.col("start") + 1 >= attack, F.col("start")))
    s = runs.groupBy(*keys, "_session").agg(first.alias("opened"), (F.max("stop") + hangover).alias("closed"))
    return s.where("opened is not null").select(*keys, "opened", "closed")


def dialogue_blocks(frames: DataFrame, keys: list[str], index: str, voiced: str, opened: str, size: int = 10, blocks: int = 4, share: float = 0.25) -> DataFrame:
    """(keys, block): blocks of that many sub-blocks of size frames, hop one, whose sub-blocks are all open, with a
    voiced frame in the first and the last one and at least a share of voiced frames. Sub-blocks that aren't full end
    the stretch they lie in. A sub-block is open where at least half of its frames are."""
    v, o = F.coalesce(F.col(voiced), F.lit(False)), F.coalesce(F.col(opened), F.lit(False))
    sub = frames.groupBy(*keys, F.floor(F.col(index) / size).alias("block")).agg(
        F.count("*").alias("n"), F.count_if(v).alias("v"), (F.avg(o.cast("double")) >= 0.5).alias("o")
    )
    w = Window.partitionBy(*keys).orderBy("block").rowsBetween(0, blocks - 1)
    all_of = sub.withColumns({
        "_n": F.count("*").over(w), "_last": F.last("block").over(w), "_open": F.bool_and("o").over(w), "_full": F.min("n").over(w), "_v": F.sum("v").over(w), "_end": F.last("v").over(w),
    })
    whole = (F.col("_n") == blocks) & (F.col("_last") == F.col("block") + blocks - 1) & (F.col("_full") == size)
    heard = F.col("_open") & (F.col("v") > 0) & (F.col("_end") > 0) & (F.col("_v") >= share * size * blocks)
    return all_of.where(whole & heard).select(*keys, "block")


def path(updates: list[tuple[int, tuple[float, ...], int]]) -> list[tuple[int, int | None, tuple[float, ...], tuple[float, ...]]]:
    """Half-open segments (start, end, from, to) of updates (at, state, ramp). An update interrupts a running ramp at
    its value there; a ramp of 0 is a jump; before the first update the state is that update's. Segments without
    length are left out, the last one has no end. Of updates at one place the last one counts."""
    out: list = []
    state: tuple[float, ...] | None = None
    kept = list({at: (at, target, ramp) for at, target, ramp in updates}.values())
    for n, (at, target, ramp) in enumerate(kept):
        until = kept[n + 1][0] if n + 1 < len(kept) else None
        if state is None:
            state = target
            if at > 0:
                out.append((0, at, target, target))
        stop = at + max(0, ramp)
        if until is not None and until < stop:
            t = (until - at) / (stop - at)
            reached = tuple(a + (b - a) * t for a, b in zip(state, target))
            out.append((at, until, state, reached))
            state = reached
            continue
        if stop > at:
            out.append((at, stop, state, target))
        if until is None or until > stop:
            out.append((stop, until, target, target))
        state = target
    return out


def path_segments(updates: DataFrame, key: str, at: str, state: list[str], ramp: str) -> DataFrame:
    """path() of each key: (key, start, end, and of each state column c: c_from, c_to). An ordered fold, as an
    interrupted ramp depends on all before it; a key is one object of one programme. Rows come sorted by key, and one
    key's updates are held at a time. Rows with nulls are left out."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = None, []

        def segments() -> list[tuple]:
            return [(held, a, b, *[x for pair in zip(p, q) for x in pair]) for a, b, p, q in path(rows)]

        for batch in batches:
            out: list[tuple] = []
            for k, a, r, *s in zip(batch[key], batch[at], batch[ramp], *[batch[c] for c in state]):
                if k != held:
                    out += segments()
                    held, rows = k, []
                rows.append((int(a), tuple(map(float, s)), int(r)))
            yield table(out)
        yield table(segments())

    def table(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({"end": "Int64"})

    names = [key, "start", "end", *[f"{c}_{e}" for c in state for e in ("from", "to")]]
    schema = ", ".join([f"{key} {dict(updates.dtypes)[key]}", "start long", "end long", *[f"{n} double" for n in names[3:]]])
    u = updates.select(key, at, *state, ramp).dropna()
    return u.repartition(key).sortWithinPartitions(key, at, ramp, *state).mapInPandas(solve, schema)


def follow(samples: DataFrame, key: str, index: str, x: str, alpha: float, chunk: int = 4096) -> DataFrame:
    """(key, index, y) of y += alpha (x - y) from 0 over numbered samples without gaps. Rows are cut into chunks of the
    index: what a chunk adds, and by how much it fades what came before, is one row each; these rows, one in a chunk, are
    folded in order, and each chunk then runs from the state it is handed. So a long key is shared by many tasks."""
    decay = 1.0 - alpha
    rows = samples.select(key, F.col(index).cast("long").alias(index), F.col(x).cast("double").alias(x)).withColumn("_c", F.floor(F.col(index) / chunk))
    last = (F.col("_c") + 1) * chunk - 1
    part = rows.groupBy(key, "_c").agg(F.sum(F.col(x) * alpha * F.pow(F.lit(decay), last - F.col(index))).alias("add"))
    # Chunks further back than this fade below a double's precision.
    reach = 1 if decay <= 0 else max(1, math.ceil(math.log(1e-18) / math.log(decay) / chunk) + 1)
    w = Window.partitionBy(key).orderBy("_c").rangeBetween(-reach, -1)
    before = F.collect_list(F.struct("_c", "add")).over(w)
    state = F.aggregate(before, F.lit(0.0), lambda s, e: s + e["add"] * F.pow(F.lit(decay), (F.col("_c") - 1 - e["_c"]) * chunk))
    handed = part.select(key, "_c", state.alias("_state"))
    schema = f"{key} {dict(rows.dtypes)[key]}, {index} long, y double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(index)
        y, out = float(g["_state"].iloc[0]), np.empty(len(g))
        for i, v in enumerate(g[x].to_numpy()):
            y += alpha * (v - y)
            out[i] = y
        return pd.DataFrame({key: g[key], index: g[index], "y": out})

    return rows.join(handed, [key, "_c"]).groupBy(key, "_c").applyInPandas(run, schema)
