"""Exact removal of repeated byte strings by an enhanced suffix array over anchored segments.

A string of LENGTH bytes is anchored at the smallest of the hashed GRAM-byte strings in it, so equal strings have
equal anchors wherever they stand. Only segments around anchors that occur more than once are compared. In each
group of segments the suffixes from a segment's window starts are sorted, and a stack scan over their common
prefixes walks the interval tree: every interval of LENGTH or more bytes whose occurrences differ to their left is
a maximal repeat, a group of all its occurrences, and all but the first of each group are removed.

A chunk of documents is first compared within its task: of copies in one chunk only the first go on, so a group of
copies, whatever its size, has at most one segment for each chunk in the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, groups, tune

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Text of a task that is compared before the shuffle; text that is hashed at a time, in a processor's cache; text of
#: segments that are sorted at a time, about.
CHUNK, PIECE, SORTED = 48 << 20, 1 << 16, 1 << 18
#: Where a null doc_id stands in the order.
FIRST = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

ANCHOR = np.dtype([("hash", "<u8"), ("key", "<i8"), ("at", "<i4"), ("lo", "u1"), ("hi", "u1")])
SEGMENT = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<i4"), ("n", "u1")])
MARK = np.dtype([("key", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _power(e: int) -> np.uint64:
    return np.uint64(pow(BASE, e, 1 << 64))


def string_hashes(a: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of the `length` bytes from every position, by doubling."""
    n = len(a) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, width = a.astype(np.uint64) + np.uint64(1), 1
    out, have = None, 0
    while True:
        if length & width:
            tail = h[have : have + n]
            out = tail.copy() if out is None else out * _power(width) + tail
            have += width
        if width * 2 > length:
            break
        h = h[:-width] * _power(width) + h[width:]
        width *= 2
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def anchors(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of LENGTH bytes within documents: hash, position, first and last start they answer for.

    ends: where each document in buffer ends.
    """
    found: list[list[np.ndarray]] = [[], [], [], []]
    for a in range(0, len(buffer), PIECE):
        part = buffer[a : a + PIECE + LENGTH - 1]
        h = mixed(string_hashes(part, GRAM))
        n = len(part) - LENGTH + 1
        if n <= 0:
            continue
        bits = np.uint64(max(1, int(len(h)).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
        width = 1
        while width * 2 <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < SPAN:
            m = np.minimum(m[: n], m[SPAN - width : SPAN - width + n])
        at = (m[:n] & low).astype(np.int64)
        valid = np.ones(n, bool)
        for e in ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + n + LENGTH, "left") + 1].tolist():
            valid[max(0, e - LENGTH + 1 - a) : max(0, e - a)] = False
        s = np.flatnonzero(valid)
        if not len(s):
            continue
        cut = np.flatnonzero((np.diff(s) != 1) | (np.diff(at[s]) != 0)) + 1
        first, last = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])]
        p = at[first]
        for f, v in zip(found, (h[p], p + a, first + a, last + a)):
            f.append(v)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(f) if f else np.empty(0, t) for f, t in zip(found, kinds))


def repeated(h: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once, sorted by value."""
    order = np.argsort(h, kind="stable")
    v = h[order]
    same = v[1:] == v[:-1]
    keep = np.zeros(len(v), bool)
    keep[1:] |= same
    keep[:-1] |= same
    return order[keep]


def maximal_repeats(lcp: list[int], rank: list[int], left: list[int]) -> list[tuple[int, int, int, int]]:
    """Bottom-up walk over the common-prefix interval tree of sorted suffixes.

    lcp[i]: common prefix of i - 1 and i, 0 between unrelated ones. rank: order of occurrence. left: the byte to
    the left, negative where it is unknown or there is none. Returns the groups (length, lo, hi, first): the suffixes lo
    to hi are all occurrences of a string of that length, LENGTH at least, which no longer string has in common; their
    left bytes differ, or they would all be part of a longer repeat; first is the one that occurs first.
    """
    groups_: list[tuple[int, int, int, int]] = []
    # An interval: common prefix, its first suffix, first occurrence, the byte to the left of all (-1: they differ).
    stack: list[list[int]] = []
    for i, own in enumerate([*lcp[1:], 0]):
        lo, first, same = i, i, left[i]  # of what lies below the next interval
        while stack and stack[-1][0] > own:
            length, lo, best, before = stack.pop()
            first = first if rank[first] < rank[best] else best
            same = same if same == before else -1
            if same < 0:
                groups_.append((length, lo, i, first))
        if own >= LENGTH:
            if stack and stack[-1][0] == own:
                node = stack[-1]
                node[2] = first if rank[first] < rank[node[2]] else node[2]
                node[3] = same if same == node[3] else -1
            else:
                stack.append([own, lo, first, same])
    return groups_


def covers(groups_: list[tuple[int, int, int, int]], rank: np.ndarray) -> np.ndarray:
    """For each suffix the length of the longest group in which it isn't the first occurrence, 0 if there is none.

    Groups are nested, the longer ones within the shorter, so the longest that says so is met first. Suffixes that
    stand at one place (rank) are one occurrence."""
    cover = np.zeros(len(rank), np.int64)
    for length, lo, hi, first in sorted(groups_, reverse=True):
        part = cover[lo : hi + 1]
        part[(part == 0) & (rank[lo : hi + 1] > rank[first])] = length
    return cover


def segment_repeats(body: np.ndarray, offset: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among segments, whose text body[offset : offset + n + LENGTH - 1] has n window starts each.

    order: rows of sortable values that tell which segment comes first (the last row a position within its
    document). Returns segment, start in the segment and length of every occurrence to be removed.
    """
    size = n + LENGTH - 1
    seg = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    at = offset[seg] + inner
    h = string_hashes(body, LENGTH)[at]
    some = repeated(h)
    none = np.empty(0, np.int64)
    if not len(some):
        return none, none, none
    seg, inner, at, h = seg[some], inner[some], at[some], h[some]
    left = np.where(inner > 0, body[np.maximum(at - 1, 0)].astype(np.int64), -1)
    # Classes of equal strings whose occurrences all have the same byte before them, in their segments, are parts of
    # longer repeats; drop them before anything is sorted.
    starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    diverse = (np.minimum.reduceat(left, starts) != np.maximum.reduceat(left, starts)) | (np.minimum.reduceat(left, starts) < 0)
    keep = np.repeat(diverse, np.diff(np.concatenate([starts, [len(h)]])))
    seg, inner, at, left = seg[keep], inner[keep], at[keep], left[keep]
    klass = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(h)]])))[keep]
    longest = SPAN + LENGTH - 1
    hits: list[list[np.ndarray]] = [[], [], []]
    a = 0
    while a < len(seg):
        z = min(len(seg), a + 20_000)
        if z < len(seg):  # up to the end of a class
            z = int(np.searchsorted(klass, klass[z - 1], "right"))
        s, i, p, c = seg[a:z], inner[a:z], at[a:z], klass[a:z]
        room = size[s] - i
        col = np.arange(longest)
        text = body[np.minimum(p[:, None] + col, len(body) - 1)]
        text[col >= room[:, None]] = 0
        rows = np.concatenate([c.astype(">u4").view(np.uint8).reshape(-1, 4), text, room.astype(np.uint8)[:, None]], axis=1)
        sort = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        t, room = text[sort], room[sort]
        differ = t[1:] != t[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), longest)
        lcp = np.minimum(lcp, np.minimum(room[1:], room[:-1]))
        lcp[c[sort][1:] != c[sort][:-1]] = 0
        lcp[lcp < LENGTH] = 0
        keys = [row[s[sort]] for row in order[:-1]] + [order[-1][s[sort]] + i[sort]]
        by = np.lexsort(keys[::-1])
        new = np.zeros(len(by), np.int64)
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        cover = covers(maximal_repeats([0, *lcp.tolist()], rank.tolist(), left[a:z][sort].tolist()), rank)
        got = np.flatnonzero(cover)
        for x, v in zip(hits, (s[sort][got], i[sort][got], cover[got])):
            x.append(v)
        a = z
    return tuple(np.concatenate(x) for x in hits)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals; runs that touch are one."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


def _batches(h: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts sorted groups into ranges of about SORTED bytes, never within a group."""
    total = np.cumsum(sizes)
    a, n = 0, len(h)
    while a < n:
        z = int(np.searchsorted(total, (total[a - 1] if a else 0) + SORTED)) + 1
        z = n if z >= n else int(np.searchsorted(h, h[z - 1], "right"))
        yield a, min(z, n)
        a = z


def gather(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """buffer's ranges, one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return buffer[shift + np.arange(int(sizes.sum()))]


def mark_records(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    m = np.empty(len(key), MARK)
    m["key"], m["start"], m["end"] = key, start, end
    return m


def merged(marks: list[np.ndarray]) -> np.ndarray:
    """Marks sorted by key, with the runs of a document united."""
    m = np.concatenate([np.empty(0, MARK), *marks])
    m = m[np.lexsort((m["start"], m["key"]))]
    if not len(m):
        return m
    first = np.concatenate([[True], m["key"][1:] != m["key"][:-1]])
    # Shift each document beyond the one before, so that one pass unites the runs of all.
    shift = np.cumsum(first).astype(np.int64) << 33
    s, e = union(m["start"] + shift, m["end"] + shift)
    return mark_records(m["key"][first][(s >> 33) - 1], s & 0x1FFFFFFFF, e & 0x1FFFFFFFF)


_ROW = "bucket int, data binary"


def _rows(kind: bytes, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in parts], pa.int32()), "data": pa.array([kind + p[1] for p in parts], pa.binary())})


def _dealt(kind: bytes, records: np.ndarray, by: str, buckets: int) -> pa.RecordBatch:
    """Records packed into a row for each bucket of a column, so that rows don't multiply with buckets and keys."""
    b = np.ascontiguousarray(records[by]).view(np.uint64) % np.uint64(buckets)
    o = np.argsort(b, kind="stable")
    records, cuts = records[o], np.searchsorted(b[o], np.arange(buckets + 1))
    return _rows(kind, [(i, records[cuts[i] : cuts[i + 1]].tobytes()) for i in range(buckets) if cuts[i] < cuts[i + 1]])


def _packed(t: pa.Table, kind: bytes) -> list[bytes]:
    return [x[1:] for x in t["data"].to_pylist() if x[:1] == kind]


def _local(buckets: int):
    """Anchors of each chunk that may repeat elsewhere (by bucket of their hash), and the chunk's own marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        keys: list[int] = []
        data: list[bytes] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            buffer = np.frombuffer(b"".join(data), np.uint8)
            ends = np.cumsum([len(d) for d in data])
            begins = np.concatenate([[0], ends[:-1]])
            h, at, lo, hi = anchors(buffer, ends)
            doc = np.searchsorted(ends, at, "right")
            d, k = np.array(docs, np.int64), np.array(keys, np.int64)
            alive = np.ones(len(h), bool)
            marks: list[np.ndarray] = []
            some = repeated(h)
            n, first, owner = hi[some] - lo[some] + 1, lo[some], doc[some]
            for a, z in _batches(h[some], n + LENGTH - 1):
                own, size = owner[a:z], n[a:z] + LENGTH - 1
                body = gather(buffer, first[a:z], size)
                seg, inner, cover = segment_repeats(body, np.cumsum(size) - size, n[a:z], np.stack([d[own], k[own], first[a:z] - begins[own]]))
                where = first[a:z][seg] + inner - begins[own[seg]]
                marks.append(mark_records(k[own[seg]], where, where + cover))
                alive[some[a:z][seg[(inner == 0) & (cover >= size[seg])]]] = False  # an earlier one says all it says
            out = np.empty(int(alive.sum()), ANCHOR)
            out["hash"], out["key"] = h[alive], k[doc[alive]]
            out["at"] = at[alive] - begins[doc[alive]]
            out["lo"], out["hi"] = at[alive] - lo[alive], at[alive] - hi[alive]
            yield _dealt(b"A", out, "hash", buckets)
            yield _dealt(b"M", merged(marks), "key", buckets)

        for b in batches:
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist()):
                t = t.encode()
                if len(t) < LENGTH:
                    continue
                docs.append(FIRST if i is None else i)
                keys.append(k)
                data.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield from close()
                    docs, keys, data, size = [], [], [], 0
        if data:
            yield from close()

    return run


def _matching(buckets: int):
    """Anchors that occur more than once, by key; marks pass through. Input sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in groups(batches, "bucket"):
            yield _rows(b"M", [(bucket, x) for x in _packed(t, b"M")])
            blobs = _packed(t, b"A")
            if blobs:
                r = np.frombuffer(b"".join(blobs), ANCHOR)
                yield _dealt(b"A", r[repeated(np.ascontiguousarray(r["hash"]))], "key", buckets)

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key with its anchors and its marks. Input sorted by bucket of the key."""
    for _, t in groups(batches, "bucket"):
        a = np.frombuffer(b"".join(_packed(t, b"A")), ANCHOR)
        a = a[np.argsort(a["key"], kind="stable")]
        m = merged([np.frombuffer(b"".join(_packed(t, b"M")), MARK)])
        keys = np.union1d(a["key"], m["key"])
        for at in range(0, len(keys), 5000):
            k = keys[at : at + 5000]
            cut = [np.searchsorted(x["key"], k, side) for x in (a, m) for side in ("left", "right")]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(k, pa.int64()), "anchors": pa.array([a[x:y].tobytes() for x, y in zip(cut[0], cut[1])], pa.binary()),
                "marks": pa.array([m[x:y].tobytes() for x, y in zip(cut[2], cut[3])], pa.binary()),
            })


def _segments(buckets: int):
    """Text around the anchors of each document, by bucket of their hash; marks pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas: list[np.ndarray] = []
        bodies: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            m = np.concatenate(metas)
            body = np.concatenate(bodies)
            b = (m["hash"] % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            sizes = m["n"].astype(np.int64) + LENGTH - 1
            starts = (np.cumsum(sizes) - sizes)[o]
            m, sizes, cuts = m[o], sizes[o], np.searchsorted(b[o], np.arange(buckets + 1))
            data = []
            for i in range(buckets):
                lo, hi = cuts[i], cuts[i + 1]
                if lo < hi:
                    data.append((i, int(hi - lo).to_bytes(4, "little") + m[lo:hi].tobytes() + gather(body, starts[lo:hi], sizes[lo:hi]).tobytes()))
            return _rows(b"S", data)

        for b in batches:
            marks = np.frombuffer(b"".join(b.column("marks").to_pylist()), MARK)
            yield _dealt(b"M", marks, "key", buckets)
            for doc, key, text, mine in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "anchors"))):
                if not mine:
                    continue
                r = np.frombuffer(mine, ANCHOR)
                m = np.empty(len(r), SEGMENT)
                m["hash"], m["doc"], m["key"] = r["hash"], FIRST if doc is None else doc, key
                m["at"] = r["at"] - r["lo"].astype(np.int32)
                m["n"] = r["lo"] - r["hi"] + 1
                metas.append(m)
                bodies.append(gather(np.frombuffer(text.encode(), np.uint8), m["at"].astype(np.int64), m["n"].astype(np.int64) + LENGTH - 1))
                size += len(bodies[-1])
                if size >= CHUNK // 2:
                    yield close()
                    metas, bodies, size = [], [], 0
        if metas:
            yield close()

    return run


def _compared(buckets: int):
    """Marks of each bucket's segments, by key; other marks pass through. Input sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in groups(batches, "bucket"):
            yield _rows(b"M", [(bucket, x) for x in _packed(t, b"M")])
            metas, bodies = [], []
            for x in _packed(t, b"S"):
                n = int.from_bytes(x[:4], "little")
                metas.append(np.frombuffer(x, SEGMENT, n, 4))
                bodies.append(np.frombuffer(x, np.uint8, -1, 4 + n * SEGMENT.itemsize))
            if not metas:
                continue
            m, body = np.concatenate(metas), np.concatenate(bodies)
            sizes = m["n"].astype(np.int64) + LENGTH - 1
            starts = np.cumsum(sizes) - sizes
            o = np.argsort(m["hash"], kind="stable")
            m, sizes, starts = m[o], sizes[o], starts[o]
            marks: list[np.ndarray] = []
            for a, z in _batches(np.ascontiguousarray(m["hash"]), sizes):
                g = m[a:z]
                text = gather(body, starts[a:z], sizes[a:z])
                at = g["at"].astype(np.int64)
                seg, inner, cover = segment_repeats(text, np.cumsum(sizes[a:z]) - sizes[a:z], g["n"].astype(np.int64), np.stack([g["doc"], g["key"], at]))
                marks.append(mark_records(g["key"][seg], at[seg] + inner, at[seg] + inner + cover))
            yield _dealt(b"M", merged(marks), "key", buckets)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], []]
        for text, blob in zip(b.column("text").to_pylist(), b.column("marks").to_pylist()):
            data = text.encode()
            m = np.frombuffer(blob or b"", MARK)
            s, e = union(m["start"].astype(np.int64), m["end"].astype(np.int64))
            h, at = hashlib.sha256(), 0
            view = memoryview(data)
            for x, y in zip(s.tolist(), e.tolist()):
                h.update(view[at:x])
                at = y
            h.update(view[at:])
            for c, v in zip(cols, (len(data), int((e - s).sum()), len(s), h.hexdigest())):
                c.append(v)
        names, kinds = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {c: pa.array(v, t) for c, v, t in zip(names, cols, kinds)})


def removed_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, key, text) and, by key, the runs to be removed from them (marks).

    Both joins read the texts with the same columns, so the shuffle of the texts is done once and reused.
    """
    tune(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.alias("text"))
    n = buckets_for(docs)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(n, "bucket").sortWithinPartitions("bucket")

    def by_key(df: DataFrame) -> DataFrame:
        return dealt(df).mapInArrow(_by_key, "key long, anchors binary, marks binary")

    found = by_key(dealt(keyed.mapInArrow(_local(n), _ROW)).mapInArrow(_matching(n), _ROW))
    around = keyed.join(found, "key").select("doc_id", "key", "text", "anchors", "marks").mapInArrow(_segments(n), _ROW)
    return keyed, by_key(dealt(around).mapInArrow(_compared(n), _ROW)).select("key", "marks")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove each byte that a string of 100 bytes covers which also starts earlier, in the whole table.

    docs: doc_id, text; other columns are ignored. Earlier is a smaller doc_id (null first), or in one document an
    earlier start. Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row. A null text is empty;
    texts of less than 100 bytes stay whole; rows that repeat an id and text are one document, and get one result
    each; different texts of one id are ordered by a hash.
    """
    keyed, marks = removed_runs(docs)
    return keyed.join(marks, "key", "left").select("doc_id", "text", "marks").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
