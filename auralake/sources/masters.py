"""Master sets: the configuration and the delta stream of object updates, both in a block-style YAML dialect.

Scalars stay text until a column's type is applied, so that `off` is a word and `-inf` a number. A file that can't be
read, or has a key that isn't known, gives one row with an error and no others from there on.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Keys of an update in the order of the format, with the type of each.
EVENT_KEYS = {
    "ID": "long", "samplePos": "long", "active": "boolean", "pos": "array<double>", "snap": "boolean", "elevation": "boolean", "zones": "string",
    "size": "double", "size3D": "array<double>", "decorr": "long", "importance": "double", "gain": "double", "rampLength": "long",
    "trimBypass": "boolean", "dialog": "long", "music": "long", "distance": "double", "screenFactor": "double", "depthFactor": "double",
    "headTrackMode": "string", "binauralRenderMode": "string",
}
EVENT_SCHEMA = "file string, sample_rate long, ix long, " + ", ".join(f"`{k}` {t}" for k, t in EVENT_KEYS.items()) + ", error string"
ZONES = {"all", "no back", "no sides", "center back", "screen only", "surround only"}


def scalar(text: str, kind: str):
    text = text.strip()
    if kind.startswith("array"):
        if not (text.startswith("[") and text.endswith("]")):
            raise ValueError(f"{text!r} is not a list")
        return [scalar(t, "double") for t in text[1:-1].split(",") if t.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1]
    if kind == "boolean":
        return {"true": True, "false": False}[text]
    if kind == "long":
        return int(text)
    return float(text.replace(".inf", "inf")) if kind == "double" else text


def events(lines: Iterator[str]) -> Iterator[tuple]:
    """(sample rate, number, values in the order of EVENT_KEYS) of each update, line by line."""
    rate, ix, current, inside = None, 0, None, False

    def row() -> tuple:
        return (rate, ix, *[current.get(k) for k in EVENT_KEYS])

    for number, line in enumerate(lines, 1):
        text = line.rstrip()
        if not text.strip() or text.lstrip().startswith("#") or text.strip() in ("---", "..."):
            continue
        head, starts = text.lstrip(), False
        if head.startswith("- ") or head == "-":
            head, starts = head[1:].lstrip(), True
        key, colon, value = head.partition(":")
        try:
            if not text.startswith((" ", "-")):
                if key not in ("sampleRate", "events") or not colon:
                    raise KeyError(key)
                inside = key == "events"
                if not inside:
                    rate = scalar(value, "long")
                continue
            if not inside or (current is None and not starts):
                raise ValueError("an update outside of the list")
            if starts:
                if current is not None:
                    yield row()
                    ix += 1
                current = {}
            if head:
                if key in current:
                    raise ValueError(f"{key} is repeated")
                current[key] = scalar(value, EVENT_KEYS[key])
                if key == "zones" and current[key] not in ZONES:
                    raise ValueError(f"zones {current[key]!r}")
        except (KeyError, ValueError) as e:
            raise ValueError(f"line {number}: {e}") from e
    if current is not None:
        yield row()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class EventReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(p) for p in sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.endswith(".metadata"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        try:
            with open(partition.path, encoding="utf-8") as f:
                for r in events(f):
                    yield (name, *r, None)
        except ValueError as e:
            yield (name, None, None, *[None] * len(EVENT_KEYS), str(e))


class EventSource(DataSource):
    """One partition a file, read as a stream of lines: an update depends on its own lines only, memory on none."""

    @classmethod
    def name(cls) -> str:
        return "master_events"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def reader(self, schema) -> EventReader:
        return EventReader(self.options)


def _number(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(c == float("-inf"), "-inf").when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def event_text(updates: DataFrame) -> DataFrame:
    """(file, ix, text): the lines of each update, keys that are null left out; the inverse of the source. Writing the
    texts of a file in the order of ix under its two heading lines gives a stream that reads back the same."""
    parts = []
    for k, t in EVENT_KEYS.items():
        c = F.col(f"`{k}`")
        if t.startswith("array"):
            text = F.concat(F.lit("["), F.array_join(F.transform(c, _number), ", "), F.lit("]"))
        else:
            text = _number(c) if t == "double" else c.cast("string")
        parts.append(F.concat(F.lit(f"{k}: "), text))
    body = F.array_join(F.array_compact(F.array(*parts)), "\n    ")
    return updates.select("file", "ix", F.concat(F.lit("  - "), body).alias("text"))


def resolve(declared: DataFrame, files: DataFrame) -> DataFrame:
    """declared (set, stem, suffix, referenced) with path and match: exact where the named file exists, by_convention
    where stem + suffix does, else missing. files: (set, name), repeated rows count once."""
    have = files.select("set", "name").distinct()
    exact = have.select("set", F.col("name").alias("referenced"), F.col("name").alias("_exact"))
    usual = have.select("set", F.col("name").alias("_usual"))
    d = declared.withColumn("_name", F.concat("stem", "suffix")).join(exact, ["set", "referenced"], "left")
    d = d.join(usual.withColumn("_name", F.col("_usual")), ["set", "_name"], "left")
    match = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_usual").isNotNull(), "by_convention").otherwise("missing")
    return d.select("set", "stem", "suffix", "referenced", F.coalesce("_exact", "_usual").alias("path"), match.alias("match"))
