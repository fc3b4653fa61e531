"""PCM in RIFF/WAVE files as a Spark data source, and a writer of the same.

spark.dataSource.register(WavSource); spark.read.format("pcm_wav").load(folder) gives file, channel, block, start,
samples: each partition is a range of blocks of one file, so a long file is read by many tasks.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LARGEST_CHUNK = 1 << 20
SCHEMA = "file string, rate int, channel int, block long, start long, samples array<int>"


def header(f) -> dict:
    """Format and place of the samples; chunks that aren't known are skipped, as are odd sizes' padding bytes."""
    riff, _, wave = struct.unpack("<4sI4s", f.read(12))
    if riff not in (b"RIFF", b"RF64", b"BW64") or wave != b"WAVE":
        raise ValueError("not a WAVE file")
    out: dict = {}
    long_size = None
    while len(head := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        at = f.tell()
        if name == b"ds64":
            long_size = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", f.read(16))
            if kind == 0xFFFE:  # the real format leads the GUID
                kind = struct.unpack("<8xH", f.read(10))[0]
            if not channels or (kind, bits) not in ((1, 16), (1, 24), (1, 32), (3, 32)):
                raise ValueError(f"format {kind} with {bits} bits is not supported")
            out |= {"channels": channels, "rate": rate, "align": align, "bits": bits, "kind": "f" if kind == 3 else "i", "order": "<"}
        elif name == b"data":
            if size == 0xFFFFFFFF and long_size is not None:
                size = long_size
            there = f.seek(0, 2) - at  # a file that was cut off has fewer samples than its header says
            return out | {"data": at, "frames": min(size, there) // out["align"]}
        f.seek(at + size + size % 2)
    raise ValueError("no samples")


def chunks(f) -> dict[str, bytes]:
    """The first chunk of each name, but for the samples and the size table; a chunk over a megabyte is refused."""
    out: dict[str, bytes] = {}
    f.seek(12)
    long_size = None
    while len(head := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        at = f.tell()
        if name == b"ds64":
            long_size = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"data":
            size = long_size if size == 0xFFFFFFFF and long_size is not None else size
        elif size > LARGEST_CHUNK and name != b"axml":
            raise ValueError(f"chunk {name!r} has {size} bytes")
        else:
            out.setdefault(name.decode("latin-1"), f.read(size))
        f.seek(at + size + size % 2)
    return out


def decode(raw: bytes, bits: int, kind: str = "i", order: str = "<") -> np.ndarray:
    """Signed samples of PCM in either byte order; floats are scaled to 24 bits, rounded and clamped."""
    if kind == "f":
        x = np.nan_to_num(np.frombuffer(raw, f"{order}f4").astype(np.float64) * (1 << 23))
        return np.clip(np.trunc(x + np.copysign(0.5, x)), -(1 << 23), (1 << 23) - 1).astype(np.int32)
    if bits != 24:
        return np.frombuffer(raw, f"{order}i{bits // 8}").astype(np.int32)
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    low, high = (0, 2) if order == "<" else (2, 0)
    return (b[:, low] | b[:, 1] << 8 | b[:, high] << 16) << 8 >> 8


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class WavReader(DataSourceReader):
    suffixes: tuple[str, ...] = (".wav", ".bw64")
    header = staticmethod(header)

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.block = int(options.get("blocksize", 4800))
        self.each = int(options.get("blocksperpartition", 1000))

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.lower().endswith(self.suffixes))
        out: list[InputPartition] = []
        for p in files:
            with open(p, "rb") as f:
                blocks = -(-self.header(f)["frames"] // self.block)
            out += [_Range(p, a, min(blocks, a + self.each)) for a in range(0, blocks, self.each)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            h = self.header(f)
            for b in range(partition.first, partition.last):
                start = b * self.block
                n = min(self.block, h["frames"] - start)
                f.seek(h["data"] + start * h["align"])
                x = decode(f.read(n * h["align"]), h["bits"], h["kind"], h["order"]).reshape(n, h["channels"])
                for c in range(h["channels"]):
                    yield os.path.basename(partition.path), h["rate"], c, b, start, x[:, c].tolist()


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def encode(samples: np.ndarray, rate: int, bits: int = 24) -> bytes:
    """A WAVE file of samples (frames, channels)."""
    n, channels = samples.shape
    align = channels * bits // 8
    if bits == 24:
        body = samples.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    else:
        body = samples.astype(f"<i{bits // 8}").tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * align, align, bits)
    return struct.pack("<4sI4s4sI", b"RIFF", 36 + len(body) + len(body) % 2, b"WAVE", b"fmt ", 16) + fmt + struct.pack("<4sI", b"data", len(body)) + body + bytes(len(body) % 2)
