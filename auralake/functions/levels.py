"""Scalar functions on levels, angles and codes, as Column expressions (all stay in whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the loudness standard: offset of a level in LUFS, absolute gate, relative gates.
OFFSET, ABSOLUTE_GATE, RELATIVE_GATE, RANGE_GATE = -0.691, -70.0, -10.0, -20.0


def loudness(energy: Column) -> Column:
    """Level of a mean square; minus infinity at zero or less, where Spark's log10 is null."""
    return F.when(energy <= 0, F.lit(float("-inf"))).otherwise(OFFSET + 10 * F.log10(energy))


def energy(level: Column) -> Column:
    """Mean square of a level."""
    return F.pow(F.lit(10.0), (level - OFFSET) / 10)


def dialnorm_code(level: Column) -> Column:
    """1 to 31; 31 where the level isn't finite."""
    finite = level.isNotNull() & ~F.isnan(level) & (F.abs(level) < float("inf"))
    return F.when(finite, F.greatest(F.lit(1.0), F.least(F.lit(31.0), F.round(-level)))).otherwise(F.lit(31.0)).cast("int")


# Threshold of hearing, level of full scale, and the dialogue level it is meant for, in decibels.
THRESHOLD, FULL_SCALE, REFERENCE = 2.4, 105.0, -31.0


def audibility_floor(dialnorm: Column) -> Column:
    """Energy below which an object isn't heard at a dialogue level from -31 to -1."""
    played = FULL_SCALE + (REFERENCE - F.greatest(F.lit(-31.0), F.least(F.lit(-1.0), dialnorm)))
    return F.pow(F.lit(10.0), (THRESHOLD - played) / 10)


def azimuth(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(-x, y))


def relative_angle(x: Column, y: Column) -> Column:
    """The smallest y + 360 k that is x or more."""
    return x + F.pmod(y - x, F.lit(360.0))


def inside_angles(angle: Column, start: Column, end: Column, tolerance: float = 0.0) -> Column:
    """Whether an angle lies in the range that turns from start to end."""
    return F.pmod(angle - start + tolerance, F.lit(360.0)) <= F.pmod(end - start, F.lit(360.0)) + 2 * tolerance


def erb_rate(hz: Column) -> Column:
    return 21.4 * F.log10(1 + 0.00437 * hz)


def erb_frequency(rate: Column) -> Column:
    """The inverse of erb_rate()."""
    return (F.pow(F.lit(10.0), rate / 21.4) - 1) / 0.00437


def erb_width(hz: Column) -> Column:
    return 24.7 * (1 + 0.00437 * hz)


# Offset and exponent of the law of loudness.
QUIET, EXPONENT = 4.72, 0.2


def specific_loudness(excitation: Column) -> Column:
    """Loudness of an excitation in a band; 0 for none or less."""
    return F.pow(F.greatest(F.lit(0.0), excitation) + QUIET, F.lit(EXPONENT)) - QUIET**EXPONENT


def added_loudness(own: Column, others: Column) -> Column:
    """Specific loudness that `own` adds to `others`; less than nothing counts as nothing."""
    under = F.greatest(F.lit(0.0), others) + QUIET
    return F.pow(F.greatest(F.lit(0.0), own) + under, F.lit(EXPONENT)) - F.pow(under, F.lit(EXPONENT))


def q7_8(db: Column) -> Column:
    """Signed fixed point with eight fraction bits; clamped before the cast, which would fail on overflow."""
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.round(db * 256))).cast("int")


def grid_code(position: Column, steps: int) -> Column:
    """A coordinate, clamped to 1 either side, in steps of the room."""
    return F.round((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), position)) + 1) / 2 * steps).cast("int")


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear curve, clamped at its ends; knots by rising x."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))
