"""ADM descriptions of BW64 files: the track table and the XML document, as rows."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.sources.wav import chunks

KINDS = ["audioProgramme", "audioContent", "audioObject", "audioPackFormat", "audioChannelFormat", "audioStreamFormat", "audioTrackFormat", "audioTrackUID"]
BLOCK = "id string, rtime string, duration string, cartesian boolean, position array<double>, gain double, width double, height double, depth double, diffuse double, importance int, jump boolean, interpolation string, speaker_label string"
SCHEMA = f"path string, kind string, id string, name string, attributes map<string,string>, refs map<string,array<string>>, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, ignored map<string,int>, error string"
NUMBERS = ["gain", "width", "height", "depth", "diffuse"]
#: Places in a position of its coordinates, Cartesian or polar.
AXES = {"X": 0, "Y": 1, "Z": 2, "azimuth": 0, "elevation": 1, "distance": 2}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _block(e: ET.Element, ignored: dict[str, int]) -> dict:
    b: dict = {"id": e.get("audioBlockFormatID"), "rtime": e.get("rtime"), "duration": e.get("duration")}
    b |= dict.fromkeys(["cartesian", "position", *NUMBERS, "importance", "jump", "interpolation", "speaker_label"])
    place: dict[int, float] = {}
    for c in e:
        name, text = _local(c.tag), (c.text or "").strip()
        if name == "cartesian":
            b["cartesian"] = text in ("1", "true")
        elif name == "position" and c.get("coordinate") in AXES:
            if (v := _number(text)) is not None:
                place[AXES[c.get("coordinate")]] = v
        elif name in NUMBERS:
            b[name] = _number(text)
        elif name == "importance":
            v = _number(text)
            b["importance"] = None if v is None or v != v or abs(v) > 2**31 - 1 else int(v)
        elif name == "jumpPosition":
            b["jump"], b["interpolation"] = text in ("1", "true"), c.get("interpolationLength")
        elif name == "speakerLabel":
            b["speaker_label"] = text
        else:
            ignored[name] = ignored.get(name, 0) + 1
    if place:
        b["position"] = [place.get(0, 0.0), place.get(1, 0.0), place.get(2, 1.0 if not b["cartesian"] else 0.0)]
    return b


def elements(text: str) -> Iterator[tuple]:
    """(kind, id, name, attributes, refs, blocks, ignored) of each element of a document; its root may lie at any depth
    and under any namespace. An element is let go of as soon as it is read."""
    found, depth = False, 0
    for event, e in ET.iterparse(io.StringIO(text), events=("start", "end")):
        name = _local(e.tag)
        if name == "audioFormatExtended":
            found, depth = True, depth + (1 if event == "start" else -1)
        elif event == "end" and depth and name in KINDS:
            refs: dict[str, list[str]] = {}
            blocks, ignored = [], {}
            for c in e:
                child = _local(c.tag)
                if child.endswith(("IDRef", "UIDRef")):
                    refs.setdefault(child, []).append((c.text or "").strip())
                elif child == "audioBlockFormat":
                    blocks.append(_block(c, ignored))
                else:
                    ignored[child] = ignored.get(child, 0) + 1
            known = {_local(k): v for k, v in e.attrib.items()}
            key = "UID" if name == "audioTrackUID" else f"{name}ID"
            yield name, known.get(key), known.get(f"{name}Name"), known, refs, blocks, ignored
            e.clear()
    if not found:
        raise ValueError("no audioFormatExtended")


def parse_axml(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A row for each element of each document; one that can't be read gives what came before the fault and a row with
    its error. Null texts are errors. Documents are small (a chunk of a file), so each is read in one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "kind", "id", "name", "attributes", "refs", "blocks", "ignored", "error"]
        for batch in batches:
            for p, t in zip(batch["path"], batch["text"]):
                rows, error = [], None
                try:
                    if t is None:
                        raise ValueError("no document")
                    rows.extend((p, *e, None) for e in elements(t))
                except (ET.ParseError, ValueError) as e:
                    error = str(e)
                if error is not None:
                    rows.append((p, *[None] * 7, error))
                yield pd.DataFrame(rows, columns=columns)

    return documents.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(parse, SCHEMA)


def parse_chna(body: bytes) -> list[tuple[int, str, str, str]]:
    """(track, uid, track format, pack format) of the rows of a track table, padding removed."""
    if len(body) < 4:
        raise ValueError("short chna chunk")
    rows = struct.unpack_from("<H", body, 2)[0]
    if rows > (len(body) - 4) // 40:
        raise ValueError(f"chna declares {rows} entries but holds {(len(body) - 4) // 40}")
    out = []
    for track, *ids in struct.iter_unpack("<H12s14s11sx", body[4 : 4 + 40 * rows]):
        out.append((track, *[i.rstrip(b"\0 ").decode("latin-1") for i in ids]))
    return out


def description(path: str) -> tuple[list[tuple[int, str, str, str]], str] | None:
    """Track table and document of a file; None without either, an error with one of them only."""
    with open(path, "rb") as f:
        c = chunks(f)
    if ("chna" in c) != ("axml" in c):
        raise ValueError("a description needs both chna and axml")
    return (parse_chna(c["chna"]), c["axml"].decode("utf-8")) if "chna" in c else None


def channel_of_track(elements: DataFrame) -> DataFrame:
    """(path, uid, channel_format): of each track its channel format, named directly or through its track format's
    stream format; null where the chain is broken. Repeated ids keep the first one."""

    def ref(name: str):
        return F.col("refs")[name][0]

    def table(kind: str, key: str, value: str, to: str) -> DataFrame:
        return elements.where(F.col("kind") == kind).groupBy("path", F.col("id").alias(key)).agg(F.first(ref(value), ignorenulls=True).alias(to))

    tracks = elements.where("kind = 'audioTrackUID'").select("path", F.col("id").alias("uid"), ref("audioChannelFormatIDRef").alias("direct"), ref("audioTrackFormatIDRef").alias("track"))
    chained = tracks.join(table("audioTrackFormat", "track", "audioStreamFormatIDRef", "stream"), ["path", "track"], "left")
    chained = chained.join(table("audioStreamFormat", "stream", "audioChannelFormatIDRef", "through"), ["path", "stream"], "left")
    return chained.select("path", "uid", F.coalesce("direct", "through").alias("channel_format"))


# Names of the parts that an element's references stand for, in writing order, and the space of names.
REFS = ["audioContentIDRef", "audioObjectIDRef", "audioPackFormatIDRef", "audioChannelFormatIDRef", "audioStreamFormatIDRef", "audioTrackFormatIDRef", "audioTrackUIDRef"]
SPACE = "urn:ebu:metadata-schema:ebuCore_2015"


def _said(v: float) -> str:
    return repr(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))


def _write_block(parent: ET.Element, b: dict) -> None:
    def leaf(name: str, text, **attributes: str) -> None:
        if text is not None:
            ET.SubElement(e, name, attributes).text = text if isinstance(text, str) else _said(text)

    e = ET.SubElement(parent, "audioBlockFormat", {k: v for k, v in (("audioBlockFormatID", b.get("id")), ("rtime", b.get("rtime")), ("duration", b.get("duration"))) if v is not None})
    leaf("speakerLabel", b.get("speaker_label"))
    if b.get("cartesian") is not None:
        leaf("cartesian", "1" if b["cartesian"] else "0")
    for axis, v in zip(("X", "Y", "Z") if b.get("cartesian") else ("azimuth", "elevation", "distance"), b.get("position") if b.get("position") is not None else ()):
        leaf("position", float(v), coordinate=axis)
    for name in NUMBERS:
        leaf(name, b.get(name))
    leaf("importance", None if b.get("importance") is None else str(int(b["importance"])))
    if b.get("jump") is not None:
        leaf("jumpPosition", "1" if b["jump"] else "0", **({"interpolationLength": b["interpolation"]} if b.get("interpolation") else {}))


def document(rows: list[dict]) -> str:
    """The XML of a description from its elements' rows (kind, id, name, attributes, refs, blocks), kinds in order."""
    root = ET.Element("ebuCoreMain", {"xmlns": SPACE})
    top = ET.SubElement(ET.SubElement(ET.SubElement(root, "coreMetadata"), "format"), "audioFormatExtended")
    for r in sorted((r for r in rows if r["kind"] in KINDS), key=lambda r: (KINDS.index(r["kind"]), r["id"] or "")):
        key = "UID" if r["kind"] == "audioTrackUID" else f"{r['kind']}ID"
        own = {k: v for k, v in ((key, r["id"]), (f"{r['kind']}Name", r["name"])) if v is not None}
        e = ET.SubElement(top, r["kind"], own | {k: v for k, v in sorted((r["attributes"] or {}).items()) if k not in own and v is not None})
        for b in r["blocks"] if r["blocks"] is not None else ():
            _write_block(e, b)
        refs = dict(r["refs"] or {})
        for name in [n for n in REFS if n in refs] + sorted(n for n in refs if n not in REFS):
            for to in refs[name]:
                ET.SubElement(e, name).text = to
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def write_axml(elements: DataFrame) -> DataFrame:
    """path, text: the document of each path from rows as parse_axml() gives them; it reads back the same. Rows with an
    error are left out. A document is one row, as a chunk of a file is."""
    rows = elements.where("kind is not null").select("path", F.struct("kind", "id", "name", "attributes", "refs", "blocks").alias("e"))
    write = F.udf(lambda es: document([e.asDict(recursive=True) for e in es]), "string", useArrow=False)
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(F.to_json("e"))).alias("n"), F.collect_list("e").alias("es")).select("path", write("es").alias("text"))


def encode_chna(rows: list[tuple[int, str, str, str]]) -> bytes:
    """The body of a track table: (track, uid, track format, pack format), ids padded to their fields with zeros."""
    tracks = len({r[0] for r in rows})
    return struct.pack("<HH", tracks, len(rows)) + b"".join(struct.pack("<H12s14s11sx", t, *(v.encode("latin-1") for v in ids)) for t, *ids in rows)


def description_chunks(rows: list[tuple[int, str, str, str]], text: str) -> list[tuple[str, bytes]]:
    """Names and bodies of the two chunks of a description, in writing order."""
    return [("chna", encode_chna(rows)), ("axml", text.encode())]
