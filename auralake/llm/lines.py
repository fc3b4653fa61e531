"""Fuzzy line de-duplication: MinHash bands, exact Jaccard verification and distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UnionFind, buckets_for, components, groups, stage, tune, wide
from .simhash import similar_links
from .substring import mixed, string_hashes

#: Characters of a shingle, least similarity, bands and signature values in a band. At 0.8 a pair is missed with
#: probability (1 - 0.8 ** 5) ** 12 = 0.0085, at 0.9 with 0.00002. With seven characters unrelated lines of one
#: language share few shingles, so that five values tell them apart; ROWS may grow with the logarithm of the lines.
SHINGLE, SIMILAR, BANDS, ROWS = 7, 0.8, 12, 5
BINS = BANDS * ROWS
#: Text of which one task compares exact copies before the shuffle, and code points that are hashed at a time.
CHUNK, PIECE = 32 << 20, 1 << 15
#: Members of a band that are verified together, at most.
BLOCK = 1_000

#: check: bits of a line's hash beyond h, so that 96 bits tell lines apart where there are 10 ** 12 of them.
LINE = np.dtype([("h", "<i8"), ("check", "<u4"), ("doc", "<i8"), ("key", "<i8"), ("line", "<i4")])
LOW = (1 << 64) - 1
BAND = np.dtype([("band", "<i8"), ("h", "<i8")])
_ROW = "bucket int, kind string, key long, data binary"
_FOUND = "kind string, grp long, h long, doc long, key long, line int, data binary"


def normal(line: str) -> str:
    """What of a line is compared: lower case, white space runs as one space. Blank lines take no part."""
    return " ".join(line.lower().split())


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash: each shingle's hash falls into one of BINS, which keep their smallest; an empty bin
    borrows from the next full one, marked by the distance."""
    none = np.uint32(0xFFFFFFFF)
    out = np.full((len(lines), BINS), none)
    at = 0
    while at < len(lines):  # pieces that stay in a processor's cache
        end, size = at, 0
        while end < len(lines) and (end == at or size < PIECE):
            size += max(len(lines[end]), SHINGLE) + 1
            end += 1
        padded = [x.ljust(SHINGLE, "\0") for x in lines[at:end]]
        a = np.frombuffer("\n".join(padded).encode("utf-32-le"), "<u4")
        n = np.fromiter(map(len, padded), np.int64, len(padded)) + 1  # with the line feed
        h = mixed(string_hashes(a, SHINGLE))
        cell = np.repeat(np.arange(len(n)) * BINS, n)[: len(h)] + ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        value = h.astype(np.uint32)
        across = (np.cumsum(n)[:-1, None] - np.arange(1, SHINGLE + 1)).ravel()  # shingles over the end of a line
        value[across] = none
        np.minimum.at(out[at:end].reshape(-1), cell, value)
        at = end
    empty = out == none
    fill = out.astype(np.uint64)
    for step in range(1, BINS):
        if not empty.any():
            break
        near = np.roll(out, -step, axis=1)
        ok = empty & (near != none)
        fill[ok] = near[ok] + np.uint64(step << 40)
        empty &= ~ok
    return fill


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1)) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = mixed(h ^ sig[:, i::ROWS][:, :BANDS]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h.view(np.int64)


def _rows(bucket: list[int], kind: str, key: list[int] | None, data: list[bytes]) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array([kind] * n, pa.string()), "key": pa.array(key or [None] * n, pa.int64()), "data": pa.array(data, pa.binary())})


def _dealt(records: np.ndarray, by: str, buckets: int, kind: str) -> pa.RecordBatch:
    b = np.ascontiguousarray(records[by]).view(np.uint64) % np.uint64(buckets)
    o = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[o], np.arange(buckets + 1))
    full = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
    records = records[o]
    return _rows(full, kind, None, [records[cuts[i] : cuts[i + 1]].tobytes() for i in full])


def _sign(buckets: int):
    """The distinct lines of each chunk with their bands, by bucket; copies within a chunk are marked right away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int, int]] = {}
        lines: list[str] = []
        hashes: list[int] = []
        marks: dict[int, list[int]] = {}
        size = 0

        def sign() -> Iterator[pa.RecordBatch]:
            if lines:
                h = np.array(hashes, np.uint64).view(np.int64)
                out = np.empty(len(h) * BANDS, BAND)
                out["band"], out["h"] = bands(signatures(lines)).ravel(), np.repeat(h, BANDS)
                yield _dealt(out, "band", buckets, "B")
                lines.clear()
                hashes.clear()

        def close() -> Iterator[pa.RecordBatch]:
            yield from sign()
            out = np.empty(len(seen), LINE)
            out["h"] = np.fromiter((x & LOW for x in seen), np.uint64, len(seen)).view(np.int64)
            out["check"] = np.fromiter((x >> 96 for x in seen), np.uint32, len(seen))
            for i, c in enumerate(("doc", "key", "line")):
                out[c] = np.fromiter((v[i] for v in seen.values()), np.int64, len(seen))
            yield _dealt(out, "h", buckets, "L")
            yield _rows([k % buckets for k in marks], "M", list(marks), [np.array(sorted(set(v)), "<i4").tobytes() for v in marks.values()])
            seen.clear()
            marks.clear()

        for b in batches:
            for doc, key, text in zip(b.column("doc").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist()):
                for i, line in enumerate(text.split("\n")):
                    x = normal(line)
                    if not x:
                        continue
                    h = xxhash.xxh3_128_intdigest(x)
                    here = (doc, key, i)
                    first = seen.get(h)
                    if first is None:
                        seen[h] = here
                        lines.append(x)
                        hashes.append(h & LOW)
                    elif first != here:
                        if here < first:
                            seen[h], here = here, first
                        marks.setdefault(here[1], []).append(here[2])
                size += len(text)
                if len(lines) >= 20_000:
                    yield from sign()
                if size >= CHUNK:
                    yield from close()
                    size = 0
        yield from close()

    return run


def _found(kind: str, **cols: np.ndarray | list) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    types = {"grp": pa.int64(), "h": pa.int64(), "doc": pa.int64(), "key": pa.int64(), "line": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * n, pa.string())} | {c: pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types.items()})


def _group_id(h: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64).view(np.int64)[0])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrence of each exact line (K) and marks of the others (M); lines that meet in a band (C). A large band
    is dealt in blocks that all hold its first line, and given in whole as well (G), for _remaining()."""
    for _, t in groups(batches, "bucket"):
        kind = t["kind"]
        m = t.filter(pc.equal(kind, "M"))
        for b in m.to_batches():
            yield _found("M", key=b.column("key").to_pylist(), data=b.column("data").to_pylist())
        blobs = t.filter(pc.equal(kind, "L"))["data"].to_pylist()
        if blobs:
            r = np.frombuffer(b"".join(blobs), LINE)
            r = r[np.lexsort((r["line"], r["key"], r["doc"], r["check"], r["h"]))]
            new = np.concatenate([[True], (r["h"][1:] != r["h"][:-1]) | (r["check"][1:] != r["check"][:-1])])
            k = r[new]
            yield _found("K", **{c: np.ascontiguousarray(k[c]) for c in ("h", "doc", "key", "line")})
            first = k[np.cumsum(new) - 1]
            later = r[(first["key"] != r["key"]) | (first["line"] != r["line"])]
            later = later[np.argsort(later["key"], kind="stable")]
            if len(later):
                cuts = np.concatenate([[0], np.flatnonzero(later["key"][1:] != later["key"][:-1]) + 1, [len(later)]]).tolist()
                yield _found("M", key=[int(later["key"][a]) for a in cuts[:-1]], data=[np.ascontiguousarray(later["line"][a:z]).tobytes() for a, z in zip(cuts, cuts[1:])])
        blobs = t.filter(pc.equal(kind, "B"))["data"].to_pylist()
        if not blobs:
            continue
        r = np.frombuffer(b"".join(blobs), BAND)
        r = r[np.lexsort((r["h"], r["band"]))]
        r = r[np.concatenate([[True], (r["band"][1:] != r["band"][:-1]) | (r["h"][1:] != r["h"][:-1])])]
        cuts = np.concatenate([[0], np.flatnonzero(r["band"][1:] != r["band"][:-1]) + 1, [len(r)]])
        met: set[tuple[str, int]] = set()
        out: dict[str, list[list[np.ndarray]]] = {"C": [[], []], "G": [[], []]}
        for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
            h = np.ascontiguousarray(r["h"][cuts[i] : cuts[i + 1]])
            large = len(h) > BLOCK
            sets = [np.concatenate([h[:1], h[a : a + BLOCK - 1]]) for a in range(1, len(h), BLOCK - 1)]
            for kind, s in [("C", x) for x in sets] + [("G", h)] * large:
                g = _group_id(s)
                if (kind, g) not in met:  # other bands often hold the same lines
                    met.add((kind, g))
                    out[kind][0].append(np.full(len(s), g, np.int64))
                    out[kind][1].append(s)
        for kind, (grp, hs) in out.items():
            if grp:
                yield _found(kind, grp=np.concatenate(grp), h=np.concatenate(hs))


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of large bands whose lines aren't all linked yet: the lines outside the largest component, in blocks, with every
    other line. Pairs of that component need no comparison."""
    for _, t in groups(batches, "grp"):
        h, comp = t["h"].to_numpy(), t["comp"].to_numpy()  # sorted by comp
        starts = np.concatenate([[0], np.flatnonzero(comp[1:] != comp[:-1]) + 1, [len(comp)]])
        if len(starts) == 2:
            continue
        at = int(np.argmax(np.diff(starts)))
        most = np.zeros(len(h), bool)
        most[starts[at] : starts[at + 1]] = True
        rest, whole = h[~most], np.concatenate([h[~most], h[most]])
        half = BLOCK // 2
        for a in range(0, len(rest), half):
            for z in range(a, len(whole), half):
                s = np.union1d(rest[a : a + half], whole[z : z + half])
                yield pa.RecordBatch.from_pydict({"grp": pa.array(np.full(len(s), _group_id(s), np.int64)), "h": pa.array(s)})


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h: list[int] = []
        out: list[str] = []
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
            lines = text.split("\n")
            for w in wanted:
                h.append(w["h"])
                out.append(normal(lines[w["line"]]))
        yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "text": pa.array(out, pa.string())})


def _sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted hashes of each line's distinct shingles."""
    padded = [x.ljust(SHINGLE, "\0") for x in lines]
    n = np.fromiter(map(len, padded), np.int64, len(padded)) + 1
    h = mixed(string_hashes(np.frombuffer("\n".join(padded).encode("utf-32-le"), "<u4"), SHINGLE))
    ends = np.cumsum(n)
    return [np.unique(h[e - k : e - SHINGLE]) for e, k in zip(ends.tolist(), n.tolist())]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group, by exact similarity of its lines' sets of (64-bit hashes of) shingles."""
    u: list[int] = []
    v: list[int] = []
    for _, t in groups(batches, "grp"):
        h = t["h"].to_pylist()
        uf = UnionFind()
        for i, j in similar_links(_sets(t["text"].to_pylist()), SIMILAR):
            uf.union(h[i], h[j])
        for x in uf.up:
            if (r := uf.find(x)) != x:
                u.append(x)
                v.append(r)
        if len(u) >= 10_000:
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
            u, v = [], []
    yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, gone, lines = [], [], []
        for text, blobs in zip(b.column("_text").to_pylist(), b.column("_marks").to_pylist()):
            rows = (text or "").split("\n")
            drop = set(np.frombuffer(b"".join(blobs or []), "<i4").tolist())
            texts.append("\n".join(x for i, x in enumerate(rows) if i not in drop) if drop else text)
            gone.append(sorted(drop))
            lines.append(len(rows) if text else 0)
        keep = {c: b.column(c) for c in b.schema.names if c not in ("_text", "_marks")}
        yield pa.RecordBatch.from_pydict(keep | {"_kept": pa.array(texts, pa.string()), "_removed": pa.array(gone, pa.list_(pa.int32())), "_lines": pa.array(lines, pa.int64())})


def line_classes(docs: DataFrame) -> DataFrame:
    """By row key (_key), the blobs of numbers of lines that aren't the first of their class (_marks)."""
    tune(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))
    n, buckets = wide(docs), buckets_for(docs)
    signed = rows.mapInArrow(_sign(buckets), _ROW).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    found = stage(signed.mapInArrow(_meet, _FOUND), "lines")
    firsts = found.where("kind = 'K'").select("h", "doc", "key", "line")

    def verified(met: DataFrame) -> DataFrame:
        wanted = met.select("h").distinct().join(firsts, "h").groupBy("key").agg(F.collect_list(F.struct("h", "line")).alias("wanted"))
        lines = rows.select("key", "text").join(wanted, "key").select("text", "wanted").mapInArrow(_fetch, "h long, text string")
        return met.join(lines, "h").select("grp", "h", "text").repartition(n, "grp").sortWithinPartitions("grp", "h").mapInArrow(_verify, "u long, v long")

    comp = components(verified(found.where("kind = 'C'").select("grp", "h").distinct()))
    large = found.where("kind = 'G'").select("grp", "h").distinct()
    tagged = large.join(comp.withColumnRenamed("node", "h"), "h", "left").select("grp", "h", F.coalesce("root", "h").alias("comp"))
    rest = stage(tagged.repartition(n, "grp").sortWithinPartitions("grp", "comp", "h").mapInArrow(_remaining, "grp long, h long").distinct(), "remaining")
    if not rest.isEmpty():
        comp = components(verified(rest).unionByName(comp.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    every = comp.union(comp.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "h")
    at = F.struct("doc", "key", "line")
    own = every.join(firsts, "h").select("root", at.alias("at"))
    kept = own.groupBy("root").agg(F.min("at").alias("kept"))
    near = own.join(kept, "root").where("at <> kept").select(F.col("at.key").alias("key"), F.col("at.line").alias("line"))
    packed = near.groupBy("key").agg(F.collect_list("line").alias("l")).mapInArrow(_as_blobs, "key long, data binary")
    marks = found.where("kind = 'M'").select("key", "data").unionByName(packed)
    return marks.groupBy(F.col("key").alias("_key")).agg(F.collect_list("data").alias("_marks"))


def _as_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"key": b.column("key"), "data": pa.array([np.array(x, "<i4").tobytes() for x in b.column("l").to_pylist()], pa.binary())})


def dedup_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """Keep one line of each class of similar lines: the first by doc_id (null first), then by place.

    Lines are what line feeds separate; blank ones always stay. Lines whose 7-character shingles have a Jaccard
    similarity of 0.8 or more are linked, candidates coming from MinHash bands (and equal lines always), and every
    class of linked lines keeps its first occurrence in the whole table. A row for each row of docs (doc_id, text, any
    other columns), with all its columns; only text changes, and n_chars where docs has it. A null text stays null;
    rows that repeat an id and text are one document; different texts of one id are ordered by a hash.

    report: only doc_id, n_lines, n_removed, removed (numbers of the lines from 0) and kept (the text).

    A hot line has one row for each chunk of documents in the shuffle, and equal lines are one member of a band.
    """
    rest = [c for c in docs.columns if c != "text"] if not report else ["doc_id"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")
    keyed = docs.select(row, F.col("text").alias("_text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_key"))
    joined = keyed.join(line_classes(docs), "_key", "left").select("_row", "_text", "_marks")
    added = [T.StructField("_kept", T.StringType()), T.StructField("_removed", T.ArrayType(T.IntegerType())), T.StructField("_lines", T.LongType())]
    out = joined.mapInArrow(_cut, T.StructType([joined.schema["_row"], *added]))
    if report:
        return out.select("_row.doc_id", F.col("_lines").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed"), F.col("_kept").alias("kept"))
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])
