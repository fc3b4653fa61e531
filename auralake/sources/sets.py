"""Whole master sets: their configuration files, the components they name, and sets of mono files.

A configuration is a small document, so that each is read in one task from its text; sets are found by listing with
Spark's own binary reader, which any file system that the cluster knows can serve.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.sources.masters import resolve

# Keys of a configuration, of a presentation, of a bed, a bed channel and an object, in writing order.
TOP = ["language", "version", "presentations"]
PRESENTATION = [
    "type", "simplified", "metadata", "audio", "offset", "ffoa", "fps", "scNumberOfElements", "scBedConfiguration", "creationTool", "creationToolVersion",
    "sourceCodec", "downmixType_5to2", "51-to-20_LsRs90degPhaseShift", "warpMode", "trimMode", "bedInstances", "objects",
]
BED, CHANNEL, OBJECT = ["description", "groupName", "channels"], ["channel", "ID"], ["description", "groupName", "ID"]
#: Endings of a set's files: the configuration, and its components under the same stem.
CONFIG, METADATA, AUDIO = ".atmos", ".atmos.metadata", ".atmos.audio"
_ROW = (
    "ix:int,type:string,simplified:string,metadata:string,audio:string,offset:string,fps:string,warpMode:string,trimMode:string,creationTool:string,creationToolVersion:string,"
    "sc_bed:array<bigint>,beds:array<struct<ix:int,id:bigint,channel:string>>,objects:array<struct<ix:int,id:bigint,description:string,group_name:string>>"
)
_PARSED = f"struct<language:string,version:string,presentations:array<struct<{_ROW}>>,error:string>"


def _plain(text: str):
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    if text.startswith("[") and text.endswith("]"):
        return [_plain(t) for t in text[1:-1].split(",") if t.strip()]
    if text == "{}":
        return {}
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return text


def block_yaml(text: str):
    """A document of nested mappings and lists in block style, with lists of scalars in flow style. Scalars stay text. A
    key that a mapping has already, or a line that fits nowhere, is an error."""
    lines = []
    for n, raw in enumerate(text.splitlines(), 1):
        body = raw.rstrip()
        if body.strip() and not body.lstrip().startswith("#") and body.strip() not in ("---", "..."):
            indent = len(body) - len(body.lstrip())
            rest = body.lstrip()
            while rest.startswith("- "):  # a list's item is a line of its own
                lines.append((n, indent, "-"))
                inner = rest[1:].lstrip()
                indent += len(rest) - len(inner)
                rest = inner
            lines.append((n, indent, rest))
    at = 0

    def read(indent: int):
        nonlocal at
        if lines[at][2] == "-":
            out: list = []
            while at < len(lines) and lines[at][1] == indent and lines[at][2] == "-":
                at += 1
                if at < len(lines) and lines[at][1] > indent:
                    out.append(read(lines[at][1]))
                else:
                    out.append(None)
            return out
        if ":" not in lines[at][2] or re.match(r"\[.*\]$|[\"'].*[\"']$", lines[at][2]):
            at += 1
            return _plain(lines[at - 1][2])
        made: dict = {}
        while at < len(lines) and lines[at][1] == indent and lines[at][2] != "-":
            n, _, body = lines[at]
            key, colon, value = body.partition(":")
            key = key.strip().strip("\"'")
            if not colon or key in made:
                raise ValueError(f"line {n}: {body!r}")
            at += 1
            nested = at < len(lines) and (lines[at][1] > indent or (lines[at][1] == indent and lines[at][2] == "-"))
            made[key] = read(lines[at][1]) if not value.strip() and nested else _plain(value)
        return made

    if not lines:
        return None
    out = read(lines[0][1])
    if at < len(lines):
        raise ValueError(f"line {lines[at][0]}: {lines[at][2]!r}")
    return out


def _known(d: dict, keys: list[str], what: str) -> dict:
    if not isinstance(d, dict):
        raise ValueError(f"{what} is no mapping")
    odd = [k for k in d if k not in keys]
    if odd:
        raise ValueError(f"{what} has {odd[0]!r}")
    return d


def parse(text: str | None) -> dict:
    """A configuration as a row of language, version, presentations and error."""
    try:
        top = _known(block_yaml(text or "") or {}, TOP, "the configuration")
        if top.get("version") is None:
            raise ValueError("no version")
        rows = []
        for ix, p in enumerate(top.get("presentations") or []):
            _known(p, PRESENTATION, f"presentation {ix}")
            channels = [_known(c, CHANNEL, "a channel") for b in p.get("bedInstances") or [] for c in _known(b, BED, "a bed").get("channels") or []]
            objects = [_known(o, OBJECT, "an object") for o in p.get("objects") or []]
            rows.append({
                **{k: None if p.get(k) is None else str(p[k]) for k in ("type", "simplified", "metadata", "audio", "offset", "fps", "warpMode", "trimMode", "creationTool", "creationToolVersion")}, "ix": ix,
                "sc_bed": None if p.get("scBedConfiguration") is None else [int(v) for v in p["scBedConfiguration"]],
                "beds": [{"ix": i, "id": int(c["ID"]), "channel": c["channel"]} for i, c in enumerate(channels)],
                "objects": [{"ix": i, "id": int(o["ID"]), "description": o.get("description"), "group_name": o.get("groupName")} for i, o in enumerate(objects)],
            })
        return {"language": top.get("language"), "version": str(top["version"]), "presentations": rows, "error": None}
    except (ValueError, TypeError, KeyError) as e:
        return {"language": None, "version": None, "presentations": None, "error": str(e) or "malformed"}


def configs(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, language, version, presentations and error of each configuration; a faulty or null one gives an error."""
    read = F.udf(lambda t: parse(t), _PARSED, useArrow=False)  # one small document a row: there is nothing to vectorise
    return texts.select(F.col(path).alias("path"), read(F.col(text)).alias("c")).select("path", "c.*")


def presentations(configs: DataFrame) -> DataFrame:
    """A row for each presentation: path, language, version and its fields."""
    return configs.where("error is null").select("path", "language", "version", F.explode("presentations").alias("p")).select("path", "language", "version", "p.*")


def open_sets(spark: SparkSession, root: str) -> DataFrame:
    """Presentations of all sets under a folder, with the files of their components: columns of presentations(), stem,
    and metadata_path, metadata_match, audio_path, audio_match as resolve() gives them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_replace("path", r"[^/]+$", "")
    listed = files.select(folder.alias("set"), name.alias("name"))
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{CONFIG}").text(root, wholetext=True)
    p = presentations(configs(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))))
    p = p.withColumns({"set": folder, "stem": F.regexp_replace(name, re.escape(CONFIG) + "$", "")})
    for what, suffix in (("metadata", METADATA), ("audio", AUDIO)):
        declared = p.select("set", "stem", F.lit(suffix).alias("suffix"), F.col(what).alias("referenced")).distinct()
        found = resolve(declared, listed).select("set", "stem", F.col("referenced").alias(what), F.col("path").alias(f"{what}_path"), F.col("match").alias(f"{what}_match"))
        p = p.join(found, ["set", "stem", what], "left")
    return p


def read_events(sets: DataFrame, events: DataFrame, presentation: int) -> DataFrame:
    """Updates of one presentation of each set, by the file that its metadata component is; a set whose component is
    missing gives one row with an error."""
    s = sets.where(F.col("ix") == presentation).select("set", "stem", "metadata", "metadata_path", "metadata_match")
    got = s.where("metadata_path is not null").join(events, F.col("file") == F.col("metadata_path")).select("set", "stem", *events.columns)
    lost = s.where("metadata_path is null").select("set", "stem", F.concat(F.lit("missing: "), F.coalesce("metadata", F.lit(""))).alias("error"))
    return got.unionByName(lost, allowMissingColumns=True)


def _pair(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}: "), value)


def config_text(p: DataFrame) -> DataFrame:
    """path, text: configurations written from their presentations; they read back the same. Keys that are null are left
    out; a set's presentations follow each other in order."""
    def items(c: Column, fields: list[tuple[str, str]], indent: str) -> Column:
        def one(x: Column) -> Column:
            return F.concat(F.lit(indent + "- "), F.array_join(F.array_compact(F.array(*[_pair(k, x[f].cast("string")) for k, f in fields])), "\n" + indent + "  "))

        return F.array_join(F.transform(F.coalesce(c, F.array()), one), "\n")

    beds = F.when(F.size("beds") > 0, F.concat(F.lit("bedInstances:\n      - channels:\n"), items(F.col("beds"), [("channel", "channel"), ("ID", "id")], " " * 10)))
    objects = F.when(F.size("objects") > 0, F.concat(F.lit("objects:\n"), items(F.col("objects"), [("description", "description"), ("groupName", "group_name"), ("ID", "id")], " " * 6)))
    sc = F.concat(F.lit("scBedConfiguration: ["), F.array_join(F.transform("sc_bed", lambda v: v.cast("string")), ", "), F.lit("]"))
    keys = ["type", "simplified", "metadata", "audio", "offset", "fps", "warpMode", "creationTool", "creationToolVersion"]
    body = F.array_join(F.array_compact(F.array(*[_pair(k, F.col(f"`{k}`")) for k in keys], sc, beds, objects)), "\n    ")
    rows = p.select("path", "language", "version", "ix", F.concat(F.lit("  - "), body).alias("t"))
    g = rows.groupBy("path").agg(F.first("language").alias("l"), F.first("version").alias("v"), F.sort_array(F.collect_list(F.struct("ix", "t"))).alias("ts"))
    head = F.concat(F.coalesce(F.concat(F.lit("language: "), "l", F.lit("\n")), F.lit("")), F.lit("version: "), "v", F.lit("\npresentations:\n"))
    return g.select("path", F.concat(head, F.array_join(F.col("ts.t"), "\n"), F.lit("\n")).alias("text"))


def mono_sets(headers: DataFrame) -> DataFrame:
    """prefix, channels, rate, depth, frames and error of sets of files prefix_0.wav, prefix_1.wav and so on. headers:
    path, channels, rate, depth, frames, is_float. A set with a gap, or whose files aren't mono integers that agree in
    rate, depth and length, has an error."""
    name = r"^(.*)_(\d+)\.wav$"
    h = headers.select(F.regexp_extract("path", name, 1).alias("prefix"), F.regexp_extract("path", name, 2).try_cast("int").alias("n"), "channels", "rate", "depth", "frames", "is_float").where("n is not null")
    g = h.groupBy("prefix").agg(
        F.count_distinct("n").alias("files"), F.max("n").alias("_last"), F.max("channels").alias("_wide"), F.bool_or("is_float").alias("_float"),
        *[F.min(c).alias(c) for c in ("rate", "depth", "frames")], *[(F.min(c) != F.max(c)).alias(f"_{c}") for c in ("rate", "depth", "frames")],
    )
    error = (
        F.when(F.col("_last") + 1 != F.col("files"), "a file is missing").when(F.col("_wide") != 1, "more channels than one").when(F.col("_float"), "float samples")
        .when(F.col("_rate"), "rates differ").when(F.col("_depth"), "depths differ").when(F.col("_frames"), "lengths differ")
    )
    return g.select("prefix", F.col("files").alias("channels"), "rate", "depth", "frames", error.alias("error"))


def same_place(output: str, inputs: list[str]) -> bool:
    """Whether an output path is one of the inputs, or a folder that holds one: such a write would destroy its source."""
    def clean(p: str) -> str:
        scheme, sep, rest = p.partition("://") if "://" in p else ("file", "://", p)
        parts: list[str] = []
        for part in rest.split("/"):
            if part == "..":
                parts = parts[:-1]
            elif part not in ("", "."):
                parts.append(part)
        return f"{scheme}{sep}/{'/'.join(parts)}"

    out = clean(output)
    return any(clean(i) == out or clean(i).startswith(out + "/") for i in inputs)
