"""What a corpus of masters has and where it comes from: scans of folders, mounts, sidecars, accounts and fixtures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.functions import geometry as G

#: Type of a mount point that is only a trigger until something else is mounted over it.
TRIGGER = "autofs"


def corpus(spark: SparkSession, root: str, pattern: str = "*.atmos", depth: int = 3) -> DataFrame:
    """path, folder, name and length of the files of a pattern in a folder and up to `depth` levels under it. Listing is
    Spark's own, so any file system serves; no file is opened, as only the listing's columns are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    base = re.sub(r"^[a-z0-9]+:/+", "/", root.rstrip("/")) + "/"
    below = F.substring_index("path", base, -1)
    return files.where(F.size(F.split(below, "/")) - 1 <= depth).select("path", F.regexp_replace("path", r"/[^/]+$", "").alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def unescape(field: Column) -> Column:
    """A mount table's octal escapes of space, tab, line feed and backslash as what they stand for."""
    for octal, char in (("040", " "), ("011", "\t"), ("012", "\n")):
        field = F.replace(field, F.lit("\\" + octal), F.lit(char))
    return F.replace(field, F.lit("\\134"), F.lit("\\"))


def mounts(lines: DataFrame, text: str = "value") -> DataFrame:
    """point, real: mount points of a mount table's lines, and whether anything but a trigger is mounted there."""
    w = F.split(F.trim(F.col(text)), r"\s+")
    return lines.where(F.size(w) >= 3).select(unescape(w[1]).alias("point"), (w[2] != TRIGGER).alias("real")).groupBy("point").agg(F.bool_or("real").alias("real"))


def behind_trigger(paths: DataFrame, mounts: DataFrame, path: str = "path") -> DataFrame:
    """paths with behind: whether the longest mount point over a path is but a trigger, or there is none. Points become
    one row (a machine has some dozens), so no path is joined with several."""
    table = mounts.agg(F.collect_list(F.struct(F.length("point").alias("n"), "point", "real")).alias("_points"))
    over = F.filter("_points", lambda m: (m["point"] == "/") | (F.col(path) == m["point"]) | F.startswith(F.col(path), F.concat(m["point"], F.lit("/"))))
    best = F.array_max(over)
    return paths.join(F.broadcast(table)).withColumn("behind", F.coalesce(~best["real"], F.lit(True))).drop("_points")


def source_kind(local: Column, present: Column, online: Column) -> Column:
    """reachable where a recorded local path is there, recorded where one or an online one is named, else unrecorded."""
    return F.when(local.isNotNull() & F.coalesce(present, F.lit(False)), "reachable").when(local.isNotNull() | online.isNotNull(), "recorded").otherwise("unrecorded")


def accounts(lines: DataFrame, keys: list[str], order: str, text: str = "value") -> DataFrame:
    """keys, kind, block, at, frames, limited, element, source, w_from, w_to and error of each line of an account of
    blocks. Lines that belong to a block get its number by a running count; a line that can't be read, or that needs a
    block and stands before any, has an error. Kinds: element, block, copy, mix, w and g; blank lines are left out."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    sizes = {"element": 3, "block": 5, "copy": 3, "mix": 2, "w": 5, "g": 3}
    known = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))]), F.get(words, F.lit(0))), F.lit(0))
    x = lines.where(F.trim(F.col(text)) != "").select(*keys, order, words.alias("w"), known.alias("_size"))
    numbers = F.transform(F.slice("w", 2, 4), lambda v: v.try_cast("double"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"v": numbers, "kind": F.col("w")[0], "block": F.sum((F.col("w")[0] == "block").cast("int")).over(w) - 1})
    bad = (F.col("_size") != F.size("w")) | F.exists(F.slice("v", 1, F.greatest(F.lit(0), F.size("w") - 1)), lambda v: v.isNull())
    error = F.when(bad, "can't be read").when((F.col("block") < 0) & ~F.col("kind").isin("element"), "before any block")

    def at(kinds: list[str], i: int, kind: str = "long") -> Column:
        return F.when(F.col("kind").isin(*kinds), F.get("v", F.lit(i)).cast(kind))

    return x.select(
        *keys, order, "kind", F.when(F.col("block") >= 0, F.col("block")).alias("block"), at(["block"], 1).alias("at"), at(["block"], 2).alias("frames"), (at(["block"], 3) != 0).alias("limited"),
        F.coalesce(at(["element", "copy", "mix"], 0), at(["w"], 1)).alias("element"), F.coalesce(at(["element", "copy"], 1), at(["w", "g"], 0)).alias("source"),
        F.coalesce(at(["w"], 2, "double"), at(["g"], 1, "double")).alias("w_from"), at(["w"], 3, "double").alias("w_to"), error.alias("error"),
    )


def gain_samples(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """x, y, z and a gain for each channel of a file of measured samples: no header, lines after # are comments. A line
    that has not as many numbers is an error when it is read."""
    schema = ", ".join(f"`{c}` double" for c in ("x", "y", "z", *channels))
    return spark.read.option("comment", "#").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", "true").schema(schema).csv(path)


def coordinate_grid(spark: SparkSession, step: int = 5) -> DataFrame:
    """azimuth, elevation, x, y, z and back (azimuth, elevation and distance that the place reads back as) over a grid of
    directions at distance 1, for a table of conversions."""
    a = spark.range(-180, 181, step).select(F.col("id").cast("double").alias("azimuth"))
    grid = a.select("azimuth", F.explode(F.sequence(F.lit(-90), F.lit(90), F.lit(step))).alias("_e")).select("azimuth", F.col("_e").cast("double").alias("elevation"))
    placed = grid.withColumn("c", G.polar_to_cube(F.col("azimuth"), F.col("elevation"), F.lit(1.0))).select("azimuth", "elevation", "c.x", "c.y", "c.z")
    return placed.withColumn("back", G.cube_to_polar(F.col("x"), F.col("y"), F.col("z")))


def survey_json(sets: DataFrame, key: str) -> DataFrame:
    """key, json: one line of JSON for each set with all its columns, nested as they are; nulls are left out."""
    return sets.select(key, F.to_json(F.struct("*")).alias("json"))
