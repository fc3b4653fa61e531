"""Positions in a room: polar and Cartesian forms, angles, panning gains. All are Column expressions without joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of ITU-R BS.2127: corner azimuths, clockwise from the left surround, and their places on the square.
AZIMUTHS = [110.0, 30.0, 0.0, -30.0, -110.0, -250.0]
CORNERS = [(-1.0, -1.0), (-1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)]
#: Azimuths at which the same corners are seen in the square.
SQUARE_AZIMUTHS = [135.0, 45.0, 0.0, -45.0, -135.0, -225.0]
TILT, TILTED = 30.0, 45.0

# Smallest audible angle ahead, aside and behind, in degrees.
BLUR = (3.6, 10.0, 5.5)


def _signum(c: Column) -> Column:
    return F.when(c < 0, -1.0).otherwise(1.0)


def _by_sector(unwrapped: Column, edges: list[float], of) -> Column:
    """of(i) for the sector i, from edges[i] down to edges[i + 1], that holds the angle."""
    out = of(len(edges) - 2)
    for i in reversed(range(len(edges) - 2)):
        out = F.when(unwrapped >= edges[i + 1], of(i)).otherwise(out)
    return out


def _unwrap(angle: Column, top: float) -> Column:
    """The same angle in (top - 360, top]."""
    return F.lit(top) - F.pmod(F.lit(top) - angle, F.lit(360.0))


def polar_to_cube(azimuth: Column, elevation: Column, distance: Column) -> Column:
    """struct(x, y, z) of a polar position; null where a part is null."""
    over = F.abs(elevation) > TILT
    steep = TILTED + (90.0 - TILTED) * (F.abs(elevation) - TILT) / (90.0 - TILT)
    z = F.when(over, distance * _signum(elevation)).otherwise(F.tan(F.radians(elevation * (TILTED / TILT))) * distance)
    r = F.when(over, distance * F.tan(F.radians(90.0 - steep))).otherwise(distance)
    a = _unwrap(azimuth, AZIMUTHS[0])

    def along(i: int) -> Column:
        middle = (AZIMUTHS[i] + AZIMUTHS[i + 1]) / 2
        g = 0.5 + 0.5 * F.tan(F.radians(a - middle)) / math.tan(math.radians(AZIMUTHS[i + 1] - middle))
        return F.atan2(g, 1 - g) * (2 / math.pi)

    def axis(n: int) -> Column:
        return r * _by_sector(a, AZIMUTHS, lambda i: CORNERS[i][n] + (CORNERS[i + 1][n] - CORNERS[i][n]) * along(i))

    return F.struct(axis(0).alias("x"), axis(1).alias("y"), z.alias("z"))


def cube_to_polar(x: Column, y: Column, z: Column) -> Column:
    """struct(azimuth, elevation, distance): the inverse. Straight up and down have azimuth 0, the centre is all zero."""
    tiny = 1e-10
    a = _unwrap(F.degrees(F.atan2(-x, y)), SQUARE_AZIMUTHS[0])

    def shares(i: int) -> tuple[Column, Column]:
        (lx, ly), (rx, ry) = CORNERS[i], CORNERS[i + 1]
        det = lx * ry - ly * rx
        return (x * ry - y * rx) / det, (y * lx - x * ly) / det

    r = _by_sector(a, SQUARE_AZIMUTHS, lambda i: shares(i)[0] + shares(i)[1])

    def turned(i: int) -> Column:
        middle = (AZIMUTHS[i] + AZIMUTHS[i + 1]) / 2
        half = math.tan(math.radians(AZIMUTHS[i + 1] - middle))
        left, right = shares(i)
        t = right / (left + right) * (math.pi / 2)
        g = F.sin(t) / (F.cos(t) + F.sin(t))
        return middle + F.degrees(F.atan(2 * (g - 0.5) * half))

    azimuth = F.pmod(_by_sector(a, SQUARE_AZIMUTHS, turned) + 180.0, F.lit(360.0)) - 180.0
    tilt = F.degrees(F.atan(z / r))
    over = F.abs(tilt) > TILTED
    steep = _signum(tilt) * (TILT + (90.0 - TILT) * (F.abs(tilt) - TILTED) / (90.0 - TILTED))
    pole = (F.abs(x) < tiny) & (F.abs(y) < tiny)
    flat = F.when(F.abs(z) < tiny, 0.0)
    return F.struct(
        F.when(pole, 0.0).otherwise(azimuth).alias("azimuth"),
        F.when(pole, F.coalesce(flat, _signum(z) * 90.0)).when(over, steep).otherwise(tilt * (TILT / TILTED)).alias("elevation"),
        F.when(pole, F.coalesce(flat, F.abs(z))).when(over, F.abs(z)).otherwise(r).alias("distance"),
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def unit(x: Column, y: Column, z: Column) -> Column:
    """Direction as an array of three; a vector without length looks to the front."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.when(n < 1e-12, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(x / n, y / n, z / n))


def apart(a: Column, b: Column) -> Column:
    """Angle between two directions in degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def blur(x: Column, y: Column) -> Column:
    """Smallest change of place heard in a direction, linear in the azimuth over each quarter turn."""
    ahead, aside, behind = BLUR
    a = F.degrees(F.abs(F.atan2(x, y)))
    return F.when(a <= 90, ahead + (aside - ahead) * a / 90).otherwise(aside + (behind - aside) * (a - 90) / 90)


def bracket(value: Column, places: list[float]) -> list[Column]:
    """Equal-power weight of each of the ascending places: the two neighbours of value share it, outside one has all."""
    out = []
    for i, p in enumerate(places):
        w = F.when(value == p, 1.0)
        if i:
            w = w.when((value > places[i - 1]) & (value < p), F.sin((value - places[i - 1]) * (math.pi / 2 / (p - places[i - 1]))))
        else:
            w = w.when(value < p, 1.0)
        if i + 1 < len(places):
            w = w.when((value > p) & (value < places[i + 1]), F.cos((value - p) * (math.pi / 2 / (places[i + 1] - p))))
        else:
            w = w.when(value > p, 1.0)
        out.append(w.otherwise(0.0))
    return out


def room_gains(x: Column, y: Column, z: Column, speakers: dict[str, tuple[float, float, float]]) -> dict[str, Column]:
    """Gain of each speaker: layers share by height, rows of a layer by depth, speakers of a row by width."""
    gains = {}
    layers = sorted({p[2] for p in speakers.values()})
    for high, layer in zip(layers, bracket(z, layers)):
        rows = sorted({p[1] for p in speakers.values() if p[2] == high})
        for deep, row in zip(rows, bracket(y, rows)):
            here = sorted((p[0], s) for s, p in speakers.items() if p[1:] == (deep, high))
            for (_, speaker), width in zip(here, bracket(x, [h[0] for h in here])):
                gains[speaker] = layer * row * width
    return {s: gains[s] for s in speakers}


def fold_gains(df: DataFrame, x: str, y: str, rows: list[tuple[float, float, dict[str, float]]], scale: Column) -> DataFrame:
    """df with a map gains of the speakers in rows (depth, spacing, {speaker: x}): cosine fades over depth and width,
    each normed to equal power, all together normed to scale. Projections follow each other, as every norm is used
    by several gains."""

    def fade(d: Column) -> Column:
        return F.cos(F.least(F.lit(1.0), F.abs(d)) * (math.pi / 2))

    def normed(parts: Column, to: Column) -> Column:
        n = norm(parts)
        return F.when(n > 0, to / n).otherwise(to)

    def times(values: str, by: str, n: int) -> Column:
        # Not a lambda over by: the optimiser would inline it there and work it out for each element.
        return F.zip_with(values, F.array_repeat(by, n), lambda v, b: v * b)

    scaled = {"_deep": F.array(*[fade(F.col(y) - depth) for depth, _, _ in rows])}
    scaled |= {f"_wide{i}": F.array(*[fade((F.col(x) - at) / spacing) for at in speakers.values()]) for i, (_, spacing, speakers) in enumerate(rows)}
    out = df.withColumns(scaled)
    out = out.withColumns({f"_by{i}": F.col("_deep")[i] * normed(F.col("_deep"), F.lit(1.0)) * normed(F.col(f"_wide{i}"), F.lit(1.0)) for i in range(len(rows))})
    raw = F.concat(*[times(f"_wide{i}", f"_by{i}", len(speakers)) for i, (_, _, speakers) in enumerate(rows)])
    out = out.withColumn("_raw", raw).withColumn("_to", normed(F.col("_raw"), scale))
    names = F.array(*[F.lit(s) for _, _, speakers in rows for s in speakers])
    gains = F.map_from_arrays(names, times("_raw", "_to", sum(len(s) for _, _, s in rows)))
    return out.withColumn("gains", gains).drop("_raw", "_to", *scaled, *[f"_by{i}" for i in range(len(rows))])
