"""Linear PCM in CAF files as a Spark data source, in the shape of the WAVE source.

spark.dataSource.register(CafSource); spark.read.format("pcm_caf").load(folder) gives file, channel, block, start, samples.
"""

from __future__ import annotations

import os
import struct

from pyspark.sql.datasource import DataSource

from auralake.sources.wav import LARGEST_CHUNK, SCHEMA, WavReader


def header(f) -> dict:
    """Format and place of the samples. The sample chunk begins with an edit count; a size of -1 lasts to the end."""
    magic, version, _ = struct.unpack(">4sHH", f.read(8))
    if magic != b"caff" or version != 1:
        raise ValueError("not a CAF file")
    out: dict = {}
    while len(head := f.read(12)) == 12:
        name, size = struct.unpack(">4sq", head)
        at = f.tell()
        if name == b"desc":
            rate, form, flags, packet, frames, channels, bits = struct.unpack(">d4sIIIII", f.read(32))
            kind = "f" if flags & 1 else "i"
            if form != b"lpcm" or frames != 1 or not channels or (kind, bits) not in (("i", 16), ("i", 24), ("i", 32), ("f", 32)):
                raise ValueError(f"format {form!r} with {bits} bits is not supported")
            out = {"channels": channels, "rate": int(rate), "align": packet, "bits": bits, "kind": kind, "order": "<" if flags & 2 else ">"}
        elif name == b"data":
            if not out:
                raise ValueError("samples before their format")
            if size < 0:
                size = f.seek(0, os.SEEK_END) - at
            return out | {"data": at + 4, "frames": max(0, size - 4) // out["align"]}
        elif size < 0 or size > LARGEST_CHUNK:
            raise ValueError(f"chunk {name!r} has {size} bytes")
        f.seek(at + size)
    raise ValueError("no samples")


class CafReader(WavReader):
    suffixes = (".caf", ".audio")
    header = staticmethod(header)


class CafSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_caf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CafReader:
        return CafReader(self.options)


def encode(raw: bytes, rate: float, channels: int, bits: int, flags: int = 0, open_ended: bool = False) -> bytes:
    """A CAF file of samples that are encoded already (flags: 1 float, 2 little-endian)."""
    desc = struct.pack(">d4sIIIII", rate, b"lpcm", flags, channels * bits // 8, 1, channels, bits)
    size = -1 if open_ended else len(raw) + 4
    return struct.pack(">4sHH4sq", b"caff", 1, 0, b"desc", 32) + desc + struct.pack(">4sqI", b"data", size, 0) + raw
