"""SimHash near-duplicates: BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, buckets_for, components, groups, maybe_in, membership, stage, texts, tune, wide

SEED = 42
#: Members of a shard above which it is cut again by the bits that its members don't share.
LARGEST = 20_000
#: Free bits at which a shard isn't cut any more: it has 2 ** FEW members at most, as they are distinct.
FEW = 16


def hash_shingles(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of the shingles of a text's words, A-Z lower-cased; repeats included."""
    w = text.encode().lower().split()  # of bytes: ASCII letters, and ASCII white space as in [\x20\x09-\x0D]
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.array([h(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


class BKTree:
    """Children are keyed by their Hamming distance to the parent; a search follows the edges within the radius."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """Members within the radius of value, which then becomes one itself; equal values must not be added."""
        if self.root is None:
            self.root = [value, {}]
            return []
        found, todo = [], [self.root]
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                if len(children) <= 2 * radius + 1:
                    todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
                else:
                    todo += [c for k in range(d - radius, d + radius + 1) if (c := children.get(k)) is not None]
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = [value, {}]
                return found
            node = nxt


def block_masks(mask: int, blocks: int) -> list[int]:
    """mask's bits cut into so many runs of about equal numbers of bits."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shards(masks: list[int], fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and mask: the shard is the mask and the bits under it."""
    each = [F.struct(F.lit(i).cast("long").alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)]
    return fps.select("fp", "node", F.explode(F.array(*each)).alias("s")).select("fp", "node", "s.block", "s.bits")


def links(fps: DataFrame, radius: int = 2, largest: int = LARGEST) -> DataFrame:
    """Links u, v between the nodes of fps (fp long, distinct; node long) at `radius` or fewer differing bits.

    Fingerprints within the radius agree on one of radius + 1 blocks of bits, so each shard holds those that agree
    on a block. A shard over `largest` is cut again, exactly, by blocks of its remaining bits, until it is small or has
    no more than FEW of them. Each shard builds its BK-tree and returns a spanning forest of its links, from
    which components are the same: at most one row for each member, never all pairs.
    """
    masks = block_masks((1 << 64) - 1, radius + 1)
    small: list[DataFrame] = []
    shards = _shards(masks, fps)
    fixed = dict(enumerate(masks))
    while True:
        sizes = shards.groupBy("block", "bits").agg(F.count("*").alias("n"))
        hot = stage(sizes.where(F.col("n") > largest).select("block", "bits"), "hot")
        left = {b: ((1 << 64) - 1) & ~m for b, m in fixed.items()}
        if hot.isEmpty() or min(m.bit_count() for m in left.values()) <= FEW:
            small.append(shards.join(sizes.where("n > 1").select("block", "bits"), ["block", "bits"], "left_semi"))
            break
        fine = sizes.where((F.col("n") > 1) & (F.col("n") <= largest)).select("block", "bits")
        small.append(shards.join(fine, ["block", "bits"], "left_semi"))
        large = shards.join(hot, ["block", "bits"], "left_semi")
        nxt, new = [], {}
        for b, m in fixed.items():
            for k, sub in enumerate(block_masks(left[b], radius + 1)):
                key = (b + 1) * (radius + 2) + k
                new[key] = m | sub
                nxt.append(F.when(F.col("block") == b, F.struct(F.lit(key).cast("long").alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m | sub))).alias("bits"))))
        shards = stage(large.select("fp", "node", F.explode(F.filter(F.array(*nxt), lambda s: s.isNotNull())).alias("s")).select("fp", "node", "s.block", "s.bits"), "shards")
        fixed = new
    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for _, t in groups(batches, "shard"):
            tree, uf = BKTree(), UnionFind()
            node = {f & 0xFFFFFFFFFFFFFFFF: n for f, n in zip(t["fp"].to_pylist(), t["node"].to_pylist())}
            for f in node:
                for g in tree.add_and_find(f, radius):
                    uf.union(node[f], node[g])
            for n in uf.up:
                if (r := uf.find(n)) != n:
                    u.append(n)
                    v.append(r)
            if len(u) >= 10_000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    dealt = every.select(F.xxhash64("block", "bits").alias("shard"), "fp", "node").repartition(wide(fps), "shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(run, "u long, v long")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (long) of every row of docs (doc_id, text); null and empty texts have fingerprint zero."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(hash_shingles(t, words)) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(fp)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Classes of documents whose fingerprints are linked, directly or over others, at `radius` or fewer bits.

    Returns doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that is reachable) for each row
    of docs (doc_id, text; other columns are ignored). Null and empty texts share fingerprint zero; repeated rows
    give repeated rows; different texts of one doc_id are linked only if their fingerprints are; a row with a null
    doc_id makes links like any other, and component_id is null where a class has no doc_id at all.

    A fingerprint, however many rows have it, is one node.
    """
    fp = stage(fingerprints(docs, words), "fingerprints")
    nodes = stage(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comp = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    known = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = known.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fp.join(roots, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The pipeline's near-duplicates: words of a shingle and least Jaccard similarity of the sets of shingles.
STAGE_WORDS, SIMILAR = 5, 0.8
#: Differing bits up to which pairs are compared (pairs at 0.8 differ in about 10 of 64, with deviation 3), and tables
#: of sampled bits. What they don't find, the prefixes of the sets do, so their number does not follow the table.
WITHIN, TABLES = 14, 12
#: Documents that are verified together, at most.
BLOCK = 2_000
#: Buckets of shingles that are counted for the order of prefixes, as a power of two.
RARITY_BITS = 18


def tables(n: int) -> list[int]:
    """TABLES masks of sampled bits, of so many bits that a shard holds about 32 unrelated fingerprints whatever n is."""
    bits = max(6, min(40, int(np.ceil(np.log2(max(2, n)))) - 5))
    rng = np.random.default_rng(7)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(TABLES)]


def shingle_set(text: str, words: int = STAGE_WORDS) -> np.ndarray:
    return np.unique(hash_shingles(text, words))


def similar_links(sets: list[np.ndarray], least: float = SIMILAR) -> Iterator[tuple[int, int]]:
    """Links between sets from which the components are those of all pairs with a Jaccard similarity of `least` or more."""
    g = len(sets)
    if g <= 4:
        for j in range(g):
            for i in range(j):
                a, b = len(sets[i]), len(sets[j])
                if min(a, b) >= least * max(a, b):
                    both = a + b - len(np.unique(np.concatenate([sets[i], sets[j]])))
                    if both >= least * (a + b - both):
                        yield i, j
        return
    size = np.array([len(s) for s in sets])
    values, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g), size)
    col = np.cumsum(n > 1) - 1  # shingles of one document can't be shared
    shared = n[where] > 1
    owner, col = owner[shared], col[where][shared]
    both = np.zeros((g, g), np.float32)
    for a in range(0, int((n > 1).sum()), 4096):
        m = np.zeros((g, 4096), np.float32)
        part = (col >= a) & (col < a + 4096)
        m[owner[part], col[part] - a] = 1
        both += m @ m.T
    ok = np.zeros((g, g), bool)
    for i in range(g):  # by rows: few temporaries
        ok[i] = both[i] >= least * (size[i] + size - both[i].astype(np.float64))
    label = np.arange(g)  # the smallest member that is reachable
    while True:
        new = np.array([label[row].min(initial=g) for row in ok])
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(label != np.arange(g)).tolist():
        yield int(label[i]), i


class Proposals:
    """Groups of documents to be verified, each but once in a task. Large ones are dealt: in blocks that all hold the
    first member, which links copies of one text at a row each, or, where every pair counts, as pairs of blocks."""

    def __init__(self, pairs: bool) -> None:
        self.pairs = pairs
        self.grp: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.met: set[int] = set()

    def dealt(self, m: np.ndarray) -> Iterator[np.ndarray]:
        if len(m) <= BLOCK:
            yield m
        elif self.pairs:
            blocks = [m[a : a + BLOCK // 2] for a in range(0, len(m), BLOCK // 2)]
            for i, x in enumerate(blocks):
                for y in blocks[i + 1 :]:
                    yield np.union1d(x, y)
        else:
            for a in range(1, len(m), BLOCK - 1):
                yield np.concatenate([m[:1], m[a : a + BLOCK - 1]])

    def add(self, uf: UnionFind) -> None:
        members: dict[int, list[int]] = {}
        for n in uf.up:
            members.setdefault(uf.find(n), []).append(n)
        for m in members.values():
            for s in self.dealt(np.array(sorted(m), np.int64)):
                g = xxhash.xxh64_intdigest(s.tobytes())
                if g not in self.met:
                    self.met.add(g)
                    self.grp.append(np.full(len(s), np.array([g], np.uint64).view(np.int64)[0]))
                    self.nodes.append(s)

    def flush(self) -> pa.RecordBatch:
        grp, nodes = (np.concatenate(x) if x else [] for x in (self.grp, self.nodes))
        self.grp, self.nodes = [], []
        return pa.RecordBatch.from_pydict({"grp": pa.array(grp, pa.int64()), "node": pa.array(nodes, pa.int64())})


def _clusters(radius: int):
    """Members of each shard that are linked in its BK-tree, as groups to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Proposals(pairs=False)  # what that leaves is for the prefixes to find
        for _, t in groups(batches, "shard"):
            if t.num_rows < 2:
                continue
            tree, uf = BKTree(), UnionFind()
            at: dict[int, int] = {}
            for f, n in zip(t["fp"].to_pylist(), t["node"].to_pylist()):
                f &= 0xFFFFFFFFFFFFFFFF
                if f in at:  # other words, same fingerprint
                    uf.union(n, at[f])
                    continue
                at[f] = n
                for g in tree.add_and_find(f, radius):
                    uf.union(n, at[g])
            out.add(uf)
            if len(out.grp) >= 5000:
                yield out.flush()
        yield out.flush()

    return run


def rarity(docs: DataFrame, words: int = STAGE_WORDS) -> np.ndarray:
    """Levels of the buckets of shingles, by how many shingles of all documents' sets are in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            h = np.concatenate([shingle_set(t, words) for t in texts(b)] or [np.empty(0, np.uint64)])
            n += np.bincount((h & np.uint64((1 << RARITY_BITS) - 1)).astype(np.int64), minlength=1 << RARITY_BITS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(n[at])})

    got = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(1 << RARITY_BITS, np.uint8)
    level[got["bucket"].to_numpy()] = np.ceil(np.log2(got["n"].to_numpy() + 1.0))
    return level


def prefix(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set h by level, then hash: sets with a similarity of 0.8 or more share one of
    them at least, whatever the levels are, as they share 4/5 of either set."""
    n = len(h)
    first = np.argsort(level[(h & np.uint64(len(level) - 1)).astype(np.int64)], kind="stable")
    return h[first[: n - (4 * n + 4) // 5 + 1]] if n else h


def sketch(h: np.ndarray) -> bytes:
    """Parities of the numbers of a set's shingles by their low bits, in a power of two of bits: as many as shingles or
    up to twice that, 64 at least. Halves folded by XOR are the sketch of half the width."""
    width = max(64, 1 << max(0, len(h) - 1).bit_length())
    n = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").tobytes()


def maybe_similar(sizes: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs of sets that may have a similarity of 0.8 or more; all that have are among them. Two sets differ in as many
    shingles as their sketches differ in bits, at least, and similar ones in a ninth of both sizes, at most."""
    width = np.array([len(x) for x in sketches])
    order = np.lexsort((sizes, width))
    rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for w in np.unique(width).tolist():
        at = order[width[order] == w]
        rows[w] = at, sizes[at], np.frombuffer(b"".join(sketches[i] for i in at.tolist()), "<u4").reshape(len(at), -1)
    for w, (at, size, bits) in rows.items():
        own = [(at, size, bits, bits)]
        if w // 2 in rows:
            half = bits.shape[1] // 2
            own.append((*rows[w // 2], bits[:, :half] ^ bits[:, half:]))
        for others, less, theirs, mine in own:
            first = np.searchsorted(5 * less, 4 * size)
            for i, n in enumerate(size.tolist()):
                j = slice(int(first[i]), i if others is at else None)
                apart = np.bitwise_count(theirs[j] ^ mine[i]).sum(1, dtype=np.int64)
                for k in np.flatnonzero(9 * apart <= less[j] + n).tolist():
                    yield int(others[j.start + k]), int(at[i])


#: What a bucket holds of each prefix: a shingle (the bits beyond the bucket's), its node, the node's component, the
#: size of its set and the shingle's place in its order. Shingles alike in these bits are false proposals, no more.
KEY = np.dtype([("key", "<u4"), ("node", "<i8"), ("comp", "<i8"), ("size", "<u4"), ("pos", "<u4")])


def _spread(buckets: int):
    """The shingles of prefixes (node, comp, size, keys), packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        where: list[np.ndarray] = []
        n = 0

        def deal() -> pa.RecordBatch:
            r, b = np.concatenate(held), np.concatenate(where)
            o = np.argsort(b, kind="stable")
            r, cuts = r[o], np.searchsorted(b[o], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "data": pa.array([r[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())})

        for b in batches:
            blobs = b.column("keys").to_pylist()
            h = np.frombuffer(b"".join(blobs), "<u8")
            sizes = np.array([len(x) // 8 for x in blobs], np.int64)
            r = np.empty(len(h), KEY)
            r["key"] = h.astype(np.uint32)
            for c in ("node", "comp", "size"):
                r[c] = np.repeat(b.column(c).to_numpy(), sizes)
            r["pos"] = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.append(r)
            where.append(((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
            n += len(h)
            if n >= 200_000:
                yield deal()
                held, where, n = [], [], 0
        if n:
            yield deal()

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of different components that share a shingle of their prefixes and may be similar by size and by place of
    the first such shingle, as groups to be verified. Input sorted by bucket."""
    out = Proposals(pairs=True)
    for _, t in groups(batches, "bucket"):
        r = np.frombuffer(b"".join(t["data"].to_pylist()), KEY)
        r = r[np.lexsort((r["node"], r["size"], r["key"]))]
        starts = np.concatenate([[0], np.flatnonzero(r["key"][1:] != r["key"][:-1]) + 1])
        several = np.minimum.reduceat(r["comp"], starts) < np.maximum.reduceat(r["comp"], starts)
        ends = np.concatenate([starts[1:], [len(r)]])
        for a, z in zip(starts[several].tolist(), ends[several].tolist()):
            node, comp, size, pos = (r[c][a:z].astype(np.int64) for c in ("node", "comp", "size", "pos"))
            values, inverse, n = np.unique(comp, return_inverse=True, return_counts=True)
            rest = size - pos  # what can be shared from this shingle on
            uf = UnionFind()
            # Pairs within the most frequent component need no look, so that the others are compared with all.
            for i in np.flatnonzero(inverse != np.argmax(n)).tolist():
                lo, hi = np.searchsorted(5 * size, 4 * size[i]), np.searchsorted(4 * size, 5 * size[i], "right")
                j = slice(lo, hi)
                ok = (comp[j] != comp[i]) & (9 * np.minimum(rest[i], rest[j]) >= 4 * (size[i] + size[j]))
                for k in np.flatnonzero(ok).tolist():
                    uf.union(int(node[i]), int(node[lo + k]))
            out.add(uf)
            if len(out.grp) >= 5000:
                yield out.flush()
    yield out.flush()


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the members whose sketches let them be similar, as groups to be verified. Input sorted by grp."""
    out = Proposals(pairs=True)  # a group within one that was dealt is small
    for _, t in groups(batches, "grp"):
        node = t["node"].to_pylist()
        uf = UnionFind()
        for i, j in maybe_similar(t["size"].to_numpy(), t["sketch"].to_pylist()):
            uf.union(node[i], node[j])
        out.add(uf)
        if len(out.grp) >= 5000:
            yield out.flush()
    yield out.flush()


def _verified(words: int):
    """Links of each group, by exact similarity of its texts' sets of (64-bit hashes of) shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "grp"):
            node = t["node"].to_pylist()
            uf = UnionFind()
            for i, j in similar_links([shingle_set(x, words) for x in t["text"].to_pylist()]):
                uf.union(node[i], node[j])
            pairs = [(x, r) for x in uf.up if (r := uf.find(x)) != x]
            if pairs:
                yield pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def similar_documents(docs: DataFrame, words: int = STAGE_WORDS, radius: int = WITHIN) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, null as empty) and component: classes of texts whose sets of
    `words`-word shingles have a Jaccard similarity of 0.8 or more, directly or over others; one row for each row of
    docs with a doc_id. component is any number that the rows of a class have in common.

    Texts with equal sets are one node. Fingerprints of the sets meet in shards of sampled bits; a shard's BK-tree
    proposes clusters within `radius` bits, and each proposed cluster is verified exactly on the texts' sets. That
    finds most pairs. Pairs of different components that share a shingle of their prefixes, which all similar pairs
    do, are verified after that, so none is missed. Unrelated texts that are proposed, the more of them the larger the
    table, are told by their sketches, which pass every similar pair; only the texts of what passes are fetched.
    """
    spark = docs.sparkSession
    tune(spark)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    shared = spark.sparkContext.broadcast(rarity(own, words))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in batches:
            h = [shingle_set(t, words) for t in texts(b)]
            fp = np.array([fingerprint(x) for x in h], np.uint64).view(np.int64)
            sig = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in h], np.uint64).view(np.int64)
            keys = [prefix(x, level).astype("<u8").tobytes() for x in h]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "fp": pa.array(fp), "sig": pa.array(sig),
                "size": pa.array(list(map(len, h)), pa.int64()), "keys": pa.array(keys, pa.binary()), "sketch": pa.array(map(sketch, h), pa.binary()),
            })

    marked = stage(own.mapInArrow(mark, "doc_id long, text_hash long, fp long, sig long, size long, keys binary, sketch binary"), "marked")
    #: Of the rows of a node the first one stands for it: its text is fetched where the node is to be verified.
    first = F.min(F.struct("doc_id", "text_hash", "fp")).alias("m")
    nodes = stage(marked.groupBy("sig").agg(first).select(F.col("sig").alias("node"), F.col("m.fp").alias("fp"), F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash")), "nodes")
    n, buckets = wide(docs), buckets_for(docs)

    def fetched(met: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        # A bit table of fixed size picks the rows that are needed, the others stay where they are; the join is exact.
        wanted = met.join(nodes.select("node", "doc_id", "text_hash"), "node")
        some = maybe_in(table.select("doc_id", "text_hash", *columns), "doc_id", membership(wanted, "doc_id"))
        got = wanted.join(some, ["doc_id", "text_hash"]).select("grp", "node", *columns)
        return got.repartition(n, "grp").sortWithinPartitions("grp", "node")

    def verified(met: DataFrame) -> DataFrame:
        # Texts are shuffled, not sets, which are larger and hold nothing that compression could take out.
        sifted = fetched(met, marked, "size", "sketch").mapInArrow(_sifted, "grp long, node long").distinct()
        return fetched(stage(sifted, "sifted"), own, "text").mapInArrow(_verified(words), "u long, v long")

    dealt = _shards(tables(nodes.count()), nodes).select(F.xxhash64("block", "bits").alias("shard"), "fp", "node").repartition(n, "shard").sortWithinPartitions("shard", "fp", "node")
    met = stage(dealt.mapInArrow(_clusters(radius), "grp long, node long").distinct(), "clusters")
    comp = components(verified(met))

    known = nodes.join(comp, "node", "left").select("node", "doc_id", "text_hash", F.coalesce("root", "node").alias("comp"))
    firsts = marked.where("size > 0").select("doc_id", "text_hash", F.col("sig").alias("node"), "size", "keys").join(known, ["node", "doc_id", "text_hash"])
    spread = firsts.select("node", "comp", "size", "keys").mapInArrow(_spread(buckets), "bucket int, data binary")
    dealt = spread.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    met = stage(dealt.mapInArrow(_meetings, "grp long, node long").distinct(), "meetings")
    if not met.isEmpty():
        more = verified(met)
        comp = components(more.unionByName(comp.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    roots = nodes.join(comp, "node", "left").select(F.col("node").alias("sig"), F.coalesce("root", "node").alias("component"))
    return marked.join(roots, "sig").select("doc_id", "text_hash", "component")


def drop_duplicates(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """docs with one document of each class of similar_documents(): the one with the smallest doc_id.

    All columns are kept, whatever their names and types. Rows without a doc_id stay; a doc_id that occurs with
    different texts is as many documents, of which in one class the one with the smallest hash counts as the first; of
    rows that repeat doc_id and text one stays, the first by its JSON; null and empty texts are one class; an empty
    table gives no rows.
    """
    classes = stage(similar_documents(docs, words), "classes")
    stays = classes.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = classes.join(stays, "component").where("struct(doc_id, text_hash) <> first").select("doc_id", "text_hash").distinct()
    gone = stage(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    some = docs.where("doc_id is not null").select(row, F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    members = membership(gone, "_id")
    # Rows that surely stay aren't shuffled; those that a bit table of fixed size can't tell are, by an exact join.
    kept = maybe_in(some, "_id", members).join(gone, ["_id", "_hash"], "left_anti").select("_row", "_id", "_hash")
    kept = kept.unionByName(maybe_in(some, "_id", members, inside=False))
    if not classes.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        kept = kept.groupBy("_id", "_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
