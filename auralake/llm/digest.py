"""Document fingerprints: a quartile digest of hashed byte triplets, and a bounded difference score."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tune, wide

BUCKETS = 256
#: Distances of a triplet's second and third byte from its first. Wide triplets tell texts of one language apart.
SPREAD = ((3, 7), (5, 11), (2, 9))
REACH = 11
#: Cost of a difference of 0 to 3 quartiles, and its mean between unrelated digests.
COST = np.array([0, 1, 2, 6])
UNRELATED = 1.625 * BUCKETS
LENGTH_COST = 48
STEP = 1 << 22


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of hashed triplets; the text is followed by zero bytes, so that short ones count too."""
    a = np.frombuffer(data + bytes(REACH), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), STEP):  # bounded memory for long texts
        n = min(STEP, len(data) - at)
        first = a[at : at + n] * np.uint32(0x9E3779B1)
        for k, (i, j) in enumerate(SPREAD):
            x = first + a[at + i : at + i + n] * np.uint32(0x85EBCA77) + a[at + j : at + j + n] * np.uint32(0xC2B2AE3D)
            x += np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA77)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE3D)
            counts += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Three hex digits of logarithmic length, then two bits a bucket: above how many quartiles its count lies."""
    c = bucket_counts(data)
    s = np.partition(c, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])
    q = (c > s[BUCKETS // 4 - 1]).view(np.uint8) + (c > s[BUCKETS // 2 - 1]) + (c > s[3 * BUCKETS // 4 - 1])
    packed = q[0::4] << 6 | q[1::4] << 4 | q[2::4] << 2 | q[3::4]
    return f"{min(4095, round(32 * math.log2(1 + len(data)))):03x}" + packed.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, down to 0 at the difference that unrelated texts have."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[3:]), np.uint8) for s in (a, b))
    score = sum(int(COST[np.abs((x >> k & 3).astype(np.int8) - (y >> k & 3).astype(np.int8))].sum()) for k in (0, 2, 4, 6))
    score += min(LENGTH_COST, abs(int(a[:3], 16) - int(b[:3], 16)))
    return max(0.0, 1.0 - score / UNRELATED)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs (doc_id, text). A null text is empty; ids may be null or repeat."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fingerprint": pa.array([fingerprint(t.encode()) for t in texts(b)], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint every text beside its edited text and beside the next document, in descending doc_id.

    The edited text has its last third (rounded down) replaced by as many leading code points of the next
    document; after the last comes the first. Rows of one doc_id are ordered by text; null ids come last; a null
    text is empty; a single document is its own next one.

    One shuffle of the texts, into ranges of ids. The first row of each range also goes, as a copy, to the range
    before it, whose last row needs it; the ranges' bounds and first ids (one for each task) are all the driver holds.
    """
    spark = docs.sparkSession
    tune(spark)
    low = -(1 << 63)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(low)).alias("k"))
    n = wide(docs, 2)
    bounds = np.unique(np.array(docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) or [], np.float64).astype(np.int64))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k").to_numpy()
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.searchsorted(bounds, k).astype(np.int32)), "k": b.column("k")})

    firsts = {r[0]: r[1] for r in keyed.select("k").mapInArrow(parts, "part int, k long").groupBy("part").agg(F.max("k")).collect()}
    there = sorted(firsts)
    to = {firsts[p]: there[(i + 1) % len(there)] for i, p in enumerate(there)}  # the range before it, in descending order
    heads = np.array(sorted(to), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k").to_numpy()
            own = {"part": pa.array(np.searchsorted(bounds, k).astype(np.int32)), "copy": pa.array(np.zeros(len(k), bool))}
            cols = {c: b.column(c) for c in ("doc_id", "text", "k")}
            yield pa.RecordBatch.from_pydict(own | cols)
            rows = np.flatnonzero(np.isin(k, heads))
            if len(rows):
                own = {"part": pa.array([to[int(x)] for x in k[rows]], pa.int32()), "copy": pa.array(np.ones(len(rows), bool))}
                yield pa.RecordBatch.from_pydict(own | {c: v.take(pa.array(rows)) for c, v in cols.items()})

    dealt = (
        keyed.mapInArrow(deal, "part int, copy boolean, doc_id long, text string, k long")
        .repartitionById(n, "part")
        .sortWithinPartitions("part", "copy", F.col("k").desc(), "text")
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None

        def add(row: tuple, after: tuple) -> None:
            part, _, doc, text, mark = row
            cut = len(text) // 3
            edited = (text[: len(text) - cut] + after[3][:cut]).encode()
            e = fingerprint(edited)
            out.append((doc, len(text), hashlib.sha256(edited).hexdigest(), mark, e, likeness(mark, e), likeness(mark, after[4])))

        def flush() -> pa.RecordBatch:
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            b = pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, kinds))})
            out.clear()
            return b

        for b in batches:
            for part, copy, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text"))):
                if held is not None and held[0] == part and not held[1]:
                    row = (part, copy, doc, text, fingerprint(text.encode()))
                    add(held, row)
                else:
                    row = (part, copy, doc, text, "" if copy else fingerprint(text.encode()))
                held = row
            yield flush()

    return dealt.mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
