"""Blocks of Matroska files as a Spark data source, and a writer of one track.

spark.dataSource.register(MatroskaSource); spark.read.format("matroska_blocks").load(folder) gives file, track, ticks, key,
payload. A partition is a range of clusters of one file; only element heads are read to find them.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, track int, ticks long, key boolean, payload binary"
# Ids of the format's elements, and the size that means "until the parent ends".
EBML, SEGMENT, INFO, TRACKS, TRACK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
TOP = {CLUSTER, TRACKS, INFO, 0x1C53BB6B, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}
OPEN = -1


def head(f) -> tuple[int, int, int] | None:
    """(id, size, place of the content) of the element at hand; None at the end."""
    first = f.read(1)
    if not first:
        return None
    more = 8 - first[0].bit_length()
    if more > 3:
        raise ValueError(f"no element at {f.tell() - 1}")
    ident = int.from_bytes(first + f.read(more), "big")
    lead = f.read(1)
    if not lead or not lead[0]:
        raise ValueError(f"no size at {f.tell()}")
    more = 8 - lead[0].bit_length()
    size = int.from_bytes(bytes([lead[0] & (0x7F >> more)]) + f.read(more), "big")
    return ident, OPEN if size == (1 << 7 * (more + 1)) - 1 else size, f.tell()


def clusters(f, size: int) -> list[tuple[int, int]]:
    """(place, end) of the contents of the clusters of a file. A cluster of open size ends where the next one begins."""
    h = head(f)
    if h is None or h[0] != EBML or h[1] < 0:
        raise ValueError("not a Matroska file")
    f.seek(h[2] + h[1])
    out: list[tuple[int, int]] = []
    end = size
    while f.tell() < end and (h := head(f)):
        ident, length, at = h
        if ident == SEGMENT:
            end = size if length < 0 else min(size, at + length)
            continue
        if ident == CLUSTER and length < 0:
            while (stop := f.tell()) < end and (inner := head(f)) and inner[0] not in TOP:
                f.seek(inner[2] + inner[1])
            f.seek(stop)
            out.append((at, stop))
            continue
        if length < 0:
            raise ValueError(f"element {ident:x} has no size")
        if ident == CLUSTER:
            out.append((at, min(end, at + length)))
        f.seek(at + length)
    return out


def _id(ident: int) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big")


class _Range(InputPartition):
    def __init__(self, path: str, parts: list[tuple[int, int]]) -> None:
        self.path, self.parts = path, parts


def blocks(f, at: int, end: int) -> Iterator[tuple[int, int, bool, bytes]]:
    """(track, ticks, key, payload) of the blocks of a cluster. Laced blocks aren't supported."""
    base = 0
    f.seek(at)
    while f.tell() < end and (h := head(f)):
        ident, size, place = h
        if ident == TIMESTAMP:
            base = int.from_bytes(f.read(size), "big")
        elif ident == GROUP:
            continue  # its children follow
        elif ident in (SIMPLE, BLOCK):
            body = f.read(size)
            more = 8 - body[0].bit_length()
            track = int.from_bytes(bytes([body[0] & (0x7F >> more)]) + body[1 : 1 + more], "big")
            offset, flags = struct.unpack_from(">hB", body, 1 + more)
            if flags & 6:
                raise ValueError("laced blocks are not supported")
            yield track, base + offset, ident == SIMPLE and bool(flags & 0x80), body[4 + more :]
        f.seek(place + size)


class MatroskaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.each = int(options.get("clustersperpartition", 64))

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.lower().endswith((".mka", ".mkv")))
        out: list[InputPartition] = []
        for p in files:
            with open(p, "rb") as f:
                parts = clusters(f, os.path.getsize(p))
            out += [_Range(p, parts[i : i + self.each]) for i in range(0, len(parts), self.each)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for at, end in partition.parts:
                for b in blocks(f, at, end):
                    yield (os.path.basename(partition.path), *b)


class MatroskaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matroska_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatroskaReader:
        return MatroskaReader(self.options)


def _element(ident: int, body: bytes, open_ended: bool = False) -> bytes:
    if open_ended:
        return _id(ident) + b"\x01" + b"\xff" * 7 + body
    n = next(n for n in range(1, 9) if len(body) < (1 << 7 * n) - 1)
    return _id(ident) + (len(body) | 1 << 7 * n).to_bytes(n, "big") + body


def encode(frames: Iterable[tuple[int, bytes]], codec: str, span: int = 5000, open_ended: bool = False) -> bytes:
    """A file of one track of (ticks, payload) in order, a block for each, in clusters of span ticks (at most 32,767)."""

    def number(ident: int, value: int) -> bytes:
        return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))

    parts: dict[int, list[tuple[int, bytes]]] = {}
    for ticks, payload in frames:
        parts.setdefault(ticks // span, []).append((ticks, payload))
    body = _element(INFO, number(0x2AD7B1, 1_000_000))
    body += _element(TRACKS, _element(TRACK, number(0xD7, 1) + number(0x73C5, 1) + number(0x83, 2) + _element(0x86, codec.encode())))
    for c, rows in parts.items():
        inner = number(TIMESTAMP, c * span) + b"".join(_element(SIMPLE, b"\x81" + struct.pack(">hB", t - c * span, 0x80) + p) for t, p in rows)
        body += _element(CLUSTER, inner, open_ended)
    return _element(EBML, _element(0x4282, b"matroska")) + _element(SEGMENT, body, open_ended)
