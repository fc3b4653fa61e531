"""From positions to channels: hull panning, folds by matrices, mixes with ramps, and where energy comes out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.functions import geometry as G
from auralake.functions.speakers import SPEAKERS
from auralake.operators.timelines import asof_join

#: Cosine from which a speaker stands for a pole; steps of a spread's ring; share of an object's level that is a path.
POLE, RING, REACHED = math.cos(math.radians(10)), 8, 0.1
# The channels of a rendered 7.1 in order, and of the presentations it is folded to.
RENDERED = ["L", "R", "C", "LFE", "Lss", "Rss", "Lrs", "Rrs"]
FOLDED = {"5.1": ["L", "R", "C", "LFE", "Ls", "Rs"], "2.0": ["L", "R"]}
# Share of a rear channel that stays on its side and that crosses, level of surrounds and of all in stereo.
MODES = {"spread": (math.sqrt(3) / 2, 0.5, 0.909, 0.52), "same_side": (1.0, 0.0, 1.0, 0.5)}


def presentation_matrix(layout: str, mode: str = "spread") -> dict[tuple[str, str], float]:
    """Gains from the channels of a rendered 7.1 to those of a presentation: 7.1 (the same), 5.1 or 2.0."""
    if layout == "7.1":
        return {(c, c): 1.0 for c in RENDERED}
    if layout not in FOLDED:
        raise ValueError(f"no fold from 7.1 to {layout}")
    near, far, surround, scale = MODES[mode]
    if layout == "5.1":
        out = {(c, c): 1.0 for c in RENDERED[:4]} | {("Lss", "Ls"): 1.0, ("Rss", "Rs"): 1.0}
        left, right = "Ls", "Rs"
    else:
        out = {("L", "L"): scale, ("R", "R"): scale, ("C", "L"): scale * math.sqrt(0.5), ("C", "R"): scale * math.sqrt(0.5)}
        out |= {("Lss", "L"): surround * scale, ("Rss", "R"): surround * scale}
        left, right, near, far = "L", "R", near * surround * scale, far * surround * scale
    return out | {("Lrs", left): near, ("Lrs", right): far, ("Rrs", right): near, ("Rrs", left): far}


def matrix_fold(gains: Column, layout: str, mode: str = "spread") -> Column:
    """A map of gains of the rendered channels (missing ones are 0) taken to a presentation's channels."""
    matrix = presentation_matrix(layout, mode)

    def out(channel: str) -> Column:
        parts = [F.coalesce(F.try_element_at(gains, F.lit(s)), F.lit(0.0)) * g for (s, t), g in matrix.items() if t == channel and g]
        return sum(parts[1:], parts[0])

    return F.create_map(*[x for c in (FOLDED.get(layout) or RENDERED) for x in (F.lit(c), out(c))])


def directions_of(positions: np.ndarray) -> np.ndarray:
    """Unit vectors; a position without length looks to the front."""
    n = np.linalg.norm(positions, axis=-1, keepdims=True)
    return np.where(n < 1e-12, np.array([0.0, 1.0, 0.0]), positions / np.maximum(n, 1e-300))


def speaker_directions(names: list[str]) -> np.ndarray:
    """Unit vectors of the named bed channels."""
    at = {s[0]: s[3:] for s in SPEAKERS}
    a, e = (np.radians([at[n][i] for n in names]) for i in (0, 1))
    return np.stack([np.sin(-a) * np.cos(e), np.cos(a) * np.cos(e), np.sin(e)], 1)


class Hull:
    """Triangles of the convex hull of directions. A pole without a speaker near it is a direction of its own, whose
    power goes in equal parts to the speakers that it shares a triangle with."""

    def __init__(self, real: np.ndarray) -> None:
        real = directions_of(np.asarray(real, float))
        if not 3 <= len(real) <= 62:
            raise ValueError(f"panning over {len(real)} directions; from 3 to 62 are possible")
        poles = [p for p in np.array([[0.0, 0.0, 1.0], [0.0, 0.0, -1.0]]) if (real @ p).max() < POLE]
        every = np.vstack([real, *poles]) if poles else real
        corners = []
        for c in combinations(range(len(every)), 3):
            a, b, d = every[list(c)]
            normal = np.cross(b - a, d - a)
            size = np.linalg.norm(normal)
            if size < 1e-9 or abs(np.linalg.det(every[list(c)])) < 1e-9:
                continue
            side = (every - a) @ (normal / size)
            if side.max() < 1e-6 or side.min() > -1e-6:
                corners.append(c)
        if not corners:
            raise ValueError("the directions span no hull")
        self.real, self.corners = len(real), np.array(corners)
        self.inverse = np.linalg.inv(np.transpose(every[self.corners], (0, 2, 1)))
        self.spread_to = np.zeros((len(every), len(real)))
        self.spread_to[: len(real)] = np.eye(len(real))
        for p in range(len(real), len(every)):
            by = np.unique(self.corners[(self.corners == p).any(1)])
            by = by[by < len(real)]
            self.spread_to[p, by] = 1 / max(1, len(by))

    def power(self, directions: np.ndarray) -> np.ndarray:
        """Power of each real direction for rows of unit vectors: that of the triangle whose gains are least negative, of
        flat faces' the first; each row adds up to 1."""
        g = np.einsum("tij,nj->nti", self.inverse, directions)
        low = np.round(g.min(2), 9)
        best = low.argmax(1)
        rows = np.arange(len(directions))
        gains = np.maximum(g[rows, best], 0.0) ** 2
        total = gains.sum(1, keepdims=True)
        gains = np.where(total > 0, gains / np.where(total > 0, total, 1), 0.0)
        out = np.zeros((len(directions), len(self.spread_to)))
        np.put_along_axis(out, self.corners[best], gains, 1)
        return out @ self.spread_to

    def gains(self, positions: np.ndarray, spread: np.ndarray | None = None) -> np.ndarray:
        """Gains of constant power. A spread (0 to 1, of a quarter turn) takes the mean power with a ring of directions
        around the object's."""
        d = directions_of(np.asarray(positions, float))
        power = self.power(d)
        wide = np.zeros(len(d)) if spread is None else np.clip(np.nan_to_num(spread), 0, 1)
        some = np.flatnonzero(wide > 0)
        if len(some):
            up = np.where(np.abs(d[some, 2:]) < 0.9, np.array([0.0, 0.0, 1.0]), np.array([1.0, 0.0, 0.0]))
            u = directions_of(np.cross(d[some], up))
            v = np.cross(d[some], u)
            angle = wide[some, None] * math.pi / 2
            total = power[some]
            for k in range(RING):
                t = 2 * math.pi * k / RING
                total = total + self.power(np.cos(angle) * d[some] + np.sin(angle) * (math.cos(t) * u + math.sin(t) * v))
            power[some] = total / (RING + 1)
        return np.sqrt(power)


def hull_gains(df: DataFrame, position: str, speakers: list[str], spread: str | None = None) -> DataFrame:
    """df with gains, an array in the order of speakers (names of bed channels). The triangles are worked out once, on
    the driver; there are at most 64 directions. Rows without a position have null gains."""
    hull = Hull(speaker_directions(speakers))
    rows = df.select(F.struct("*").alias("_row"), F.col(position).alias("_p"), (F.col(spread) if spread else F.lit(0.0)).cast("double").alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, wide = b.column("_p").to_pylist(), np.array(b.column("_s").to_pylist(), float)
            known = [i for i, p in enumerate(places) if p is not None and len(p) == 3 and None not in p]
            out: list = [None] * len(places)
            if known:
                for i, g in zip(known, hull.gains(np.array([places[i] for i in known], float), wide[known]).tolist()):
                    out[i] = g
            yield pa.RecordBatch.from_pydict({"_row": b.column("_row"), "gains": pa.array(out, pa.list_(pa.float64()))})

    out = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("gains", T.ArrayType(T.DoubleType()))]))
    return out.select("_row.*", "gains")


def point_gains(df: DataFrame, keys: list[str], index: str, position: str, points: str) -> DataFrame:
    """keys, index, gains: panning over points that differ by group: points is an array of positions, the same in all
    rows of a group, which is one moment of a scene. A group whose points span no hull has null gains."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        try:
            made = [list(map(float, x)) for x in Hull(np.stack([np.asarray(p, float) for p in g[points].iloc[0]])).gains(np.stack([np.asarray(p, float) for p in g[position]]))]
        except ValueError:
            made = [None] * len(g)
        return pd.DataFrame({**{k: g[k] for k in keys}, index: g[index], "gains": made})

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*keys, index)], "gains array<double>"])
    return df.select(*keys, index, position, points).groupBy(*keys).applyInPandas(solve, schema)


def energy_vector(carriers: DataFrame, keys: list[str], direction: str, weight: str) -> DataFrame:
    """keys, vector, paths, strongest: direction in which the energy w^2 comes out (null where there is none or it
    cancels), the number of weights over REACHED of their common level, and the largest share."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    sums = [F.sum(w * w * F.col(direction)[i]).alias(f"_{i}") for i in range(3)]
    c = carriers.withColumn("_level", F.sqrt(F.sum(w * w).over(Window.partitionBy(*keys))))
    share = F.when(F.col("_level") > 1e-12, F.abs(w) / F.col("_level")).otherwise(0.0)
    g = c.groupBy(*keys).agg(*sums, F.count_if(share > REACHED).alias("paths"), F.max(share).alias("strongest"))
    n = F.sqrt(F.col("_0") * F.col("_0") + F.col("_1") * F.col("_1") + F.col("_2") * F.col("_2"))
    return g.select(*keys, F.when(n >= 1e-12, F.array(*[F.col(f"_{i}") / n for i in range(3)])).alias("vector"), "paths", "strongest")


def drift(asked: Column, vector: Column) -> Column:
    """Angle between the direction asked for and that of the energy, in degrees; null without energy."""
    return G.apart(asked, vector)


def nearest_bed(voices: DataFrame, carriers: DataFrame, keys: list[str], direction: str, carrier: str, index: str, bed: str) -> DataFrame:
    """voices with the index of the bed among the carriers of their scene that has the largest cosine, the last of equal
    ones; scenes without a bed give null. Beds of a scene are one small array first, so voices aren't multiplied."""
    b = carriers.where(F.col(bed)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(carrier).alias("d")))).alias("_beds"))
    best = F.array_max(F.transform("_beds", lambda s: F.struct(G.dot(s["d"], F.col(direction)).alias("c"), s["i"].alias("i"))))
    return voices.join(b, keys, "left").withColumn(index, best["i"]).drop("_beds")


def spare_slots(sources: DataFrame, keys: list[str], index: str, position: str, spare: int) -> DataFrame:
    """keys, index: up to `spare` sources nearest the front, ties by index; a source without a place comes last, one in
    the middle of the room before it."""
    p = F.col(position)
    n = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    ahead = F.when(p.isNull(), F.lit(-1e300)).when(n < 1e-12, -1.0).otherwise(p[1] / F.when(n >= 1e-12, n))
    w = Window.partitionBy(*keys).orderBy(ahead.desc(), index)
    return sources.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= spare).select(*keys, index)


def block_mix(signals: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, element, samples: objects mixed into elements over a block, weights ramping linearly from one value to the
    other. signals: keys, object, samples (array of a block), gain. weights: keys, object, element, w_from, w_to. An
    object without gain, or with weights of zero at both ends, takes no part; an element that nothing reaches has no row."""
    s = signals.where(F.coalesce("gain", F.lit(0.0)) != 0).join(weights.where("w_from <> 0 or w_to <> 0"), [*keys, "object"])
    step = (F.col("w_to") - F.col("w_from")) / F.size("samples")
    part = F.transform("samples", lambda x, i: x * F.col("gain") * (F.col("w_from") + step * i))
    rows = s.select(*keys, "element", "object", part.alias("part"))
    # A block holds a bounded number of objects; their parts are added up in the order of objects.
    parts = rows.groupBy(*keys, "element").agg(F.sort_array(F.collect_list(F.struct("object", "part"))).alias("p"))
    zero = F.transform(F.col("p")[0]["part"], lambda x: x * 0.0)
    return parts.select(*keys, "element", F.aggregate("p", zero, lambda acc, q: F.zip_with(acc, q["part"], lambda a, b: a + b)).alias("samples"))


def mixdown(samples: DataFrame, segments: DataFrame, keys: list[str], source: str, frame: str, x: str, channels: list[str]) -> DataFrame:
    """keys, frame and a column for each channel: the sum of sources at the gains that their segments give at a frame.
    segments: keys, source, start, end (null: open), and of each channel c_from and c_to, as path_segments() makes them
    of gains that ramp; a source sounds from its first segment on."""
    gains = [f"{c}_{e}" for c in channels for e in ("from", "to")]
    s = segments.where(F.col("end").isNull() | (F.col("end") > F.col("start")))
    s = s.select(*keys, source, F.col("start").alias(frame), F.col("start").alias("_start"), "end", *gains)
    met = asof_join(samples.select(*keys, source, frame, x), s, [*keys, source], frame, ["_start", "end", *gains]).where("_start is not null")
    t = F.when(F.col("end").isNull(), 0.0).otherwise((F.col(frame) - F.col("_start")) / (F.col("end") - F.col("_start")))
    parts = [F.sum(F.col(x) * (F.col(f"{c}_from") + (F.col(f"{c}_to") - F.col(f"{c}_from")) * t)).alias(c) for c in channels]
    return met.groupBy(*keys, frame).agg(*parts)


def peak_bounds(weights: DataFrame, objects: DataFrame, keys: list[str], ceiling: float = 1.0) -> DataFrame:
    """keys, object, element, weight, bound: for elements whose coherent peak (the sum of |weight| times the objects'
    peaks) is over the ceiling, the weight at which each object would keep it under; null for the others."""
    w = weights.join(objects.select(*keys, "object", F.greatest(F.lit(0.0), F.coalesce("peak", F.lit(0.0))).alias("_peak")), [*keys, "object"])
    total = F.sum(F.abs("weight") * F.col("_peak")).over(Window.partitionBy(*keys, "element"))
    w = w.withColumn("_total", total)
    return w.select(*keys, "object", "element", "weight", F.when((F.col("_total") > ceiling) & (F.col("weight") > 0), F.col("weight") * ceiling / F.col("_total")).alias("bound"))


def compare_samples(wanted: DataFrame, got: DataFrame, on: list[str], kind: str, step: float) -> DataFrame:
    """kind, compared, exact, most: by kind of element the samples compared, those that are equal, and the largest
    difference in rounding steps. Rows are kept apart from blocks that a limiter changed by leaving those out before."""
    both = wanted.select(*on, kind, F.col("sample").alias("_want")).join(got.select(*on, F.col("sample").alias("_got")), on)
    apart = F.abs(F.col("_got") - F.col("_want")) / step
    return both.groupBy(kind).agg(F.count("*").alias("compared"), F.count_if(F.col("_got") == F.col("_want")).alias("exact"), F.max(apart).alias("most"))


def compare_positions(probes: DataFrame, master: DataFrame, decoded: DataFrame, keys: list[str], at: str, position: str, bound: float) -> DataFrame:
    """keys, compared, over, most, unmatched: at each probe's time the positions in force in a master and in what was
    decoded: how many are compared, differ by more than bound on an axis, the largest difference, and how many are in
    force on one side alone."""
    a = asof_join(probes.select(*keys, at), master.select(*keys, at, F.col(position).alias("_a")), keys, at, ["_a"])
    b = asof_join(a, decoded.select(*keys, at, F.col(position).alias("_b")), keys, at, ["_b"])
    apart = F.array_max(F.zip_with("_a", "_b", lambda p, q: F.abs(p - q)))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return b.groupBy(*keys).agg(F.count_if(both).alias("compared"), F.count_if(F.coalesce(apart > bound, F.lit(False))).alias("over"), F.max(apart).alias("most"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("unmatched"))
