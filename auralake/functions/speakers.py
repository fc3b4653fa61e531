"""Speakers of beds, hints of objects and levels of a master set, as Column expressions without joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bed channels of a master: name, label, id, azimuth, elevation; then labels that also mean one.
SPEAKERS = [
    ("L", "M+030", 0, 30.0, 0.0), ("R", "M-030", 1, -30.0, 0.0), ("C", "M+000", 2, 0.0, 0.0), ("LFE", "LFE1", 3, 0.0, -30.0),
    ("Lss", "M+090", 4, 90.0, 0.0), ("Rss", "M-090", 5, -90.0, 0.0), ("Lrs", "M+135", 6, 135.0, 0.0), ("Rrs", "M-135", 7, -135.0, 0.0),
    ("Lfh", "U+030", 8, 30.0, 30.0), ("Rfh", "U-030", 9, -30.0, 30.0), ("Lts", "U+090", 10, 90.0, 30.0), ("Rts", "U-090", 11, -90.0, 30.0),
    ("Lrh", "U+135", 12, 135.0, 30.0), ("Rrh", "U-135", 13, -135.0, 30.0), ("Lw", "M+060", 14, 60.0, 0.0), ("Rw", "M-060", 15, -60.0, 0.0),
    ("LFE2", "LFE2", 16, 45.0, -30.0),
]
ALIASES = [("M+110", "Lss", 110.0, 0.0), ("M-110", "Rss", -110.0, 0.0), ("U+110", "Lrh", 110.0, 30.0), ("U-110", "Rrh", -110.0, 30.0)]
# Codes of the zones an object is kept to.
ZONES = {"all": 0, "no back": 1, "no sides": 2, "center back": 3, "screen only": 4, "surround only": 5}


def _lookup(key: Column, table: dict) -> Column:
    """A literal map's value; null for a key that it does not have."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.when(key.isNotNull(), F.try_element_at(F.create_map(*pairs), key))


def master_of_label(label: Column) -> Column:
    """Name of the bed channel that a speaker label stands for, aliases included."""
    return _lookup(label, {s[1]: s[0] for s in SPEAKERS} | {a[0]: a[1] for a in ALIASES})


def label_of_master(name: Column) -> Column:
    return _lookup(name, {s[0]: s[1] for s in SPEAKERS})


def id_of_master(name: Column) -> Column:
    return _lookup(name, {s[0]: s[2] for s in SPEAKERS})


def azimuth_of_label(label: Column) -> Column:
    return _lookup(label, {s[1]: s[3] for s in SPEAKERS} | {a[0]: a[2] for a in ALIASES})


def elevation_of_label(label: Column) -> Column:
    return _lookup(label, {s[1]: s[4] for s in SPEAKERS} | {a[0]: a[3] for a in ALIASES})


def is_lfe(label: Column) -> Column:
    return F.coalesce(master_of_label(label), label).startswith("LFE")


def zone_code(zones: Column) -> Column:
    """Code of a zone's name; null where it isn't known."""
    return _lookup(zones, ZONES)


def half_away(x: Column) -> Column:
    """Rounded to a whole number, halves away from zero."""
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))


def screen_codes(screen: Column, depth: Column) -> Column:
    """struct(screen, depth): 3 and 2 bits for the factors of a screen; null where the first is not over zero or not
    finite."""
    a = F.greatest(F.lit(0), F.least(F.lit(7), half_away(screen * 8) - 1)).cast("int")
    b = F.greatest(F.lit(0), F.least(F.lit(3), half_away(depth / 0.25) - 1)).cast("int")
    finite = screen.isNotNull() & ~F.isnan(screen) & (screen < float("inf")) & (screen > 0)
    return F.when(finite, F.struct(a.alias("screen"), b.alias("depth")))


def decibels_to_linear(db: Column) -> Column:
    return F.when(db == float("-inf"), 0.0).otherwise(F.pow(F.lit(10.0), db / 20))


def linear_to_decibels(linear: Column) -> Column:
    """Minus infinity at zero or less, where Spark's logarithm is null."""
    return F.when(linear <= 0, float("-inf")).otherwise(20 * F.log10(F.when(linear > 0, linear)))


def position_codes(x: Column, y: Column, z: Column, full: int) -> Column:
    """array of three: a Cartesian position in steps of 1 / full, clamped to the room; full is 127 or 32767."""
    return F.array(*[half_away(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) * full).cast("int") for c in (x, y, z)])


def polar_codes(azimuth: Column, elevation: Column, distance: Column) -> Column:
    """array of three: whole degrees, and the distance in 1 / 127."""
    a = F.greatest(F.lit(-180), F.least(F.lit(180), half_away(azimuth)))
    e = F.greatest(F.lit(-90), F.least(F.lit(90), half_away(elevation)))
    return F.array(a.cast("int"), e.cast("int"), half_away(F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance)) * 127).cast("int"))


def quantised(value: Column, full_scale: float, step: float) -> Column:
    """struct(code, level, clipped): a sample at full scale 1 rounded to a step and clamped to the domain; how high it
    reached, and whether it lay beyond the domain before."""
    raw = half_away(value * full_scale)
    top = (full_scale - 1) // step * step
    code = F.greatest(F.lit(-full_scale), F.least(F.lit(top), half_away(raw / step) * step)).cast("long")
    return F.struct(code.alias("code"), (F.abs(raw) / full_scale).alias("level"), ((raw < -full_scale) | (raw > full_scale - 1)).alias("clipped"))
