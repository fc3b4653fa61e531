"""Best-fit packing of tokenised documents, after a Martello-Toth dominance reduction.

Lengths are integers from 1 to the capacity, so an instance is a histogram with at most `capacity` entries, whatever
the number of documents. The plan is made on that histogram; each piece then finds its place by its rank among
the pieces of its length, which is computed in distributed, salted groups.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo, byte_chars, latin_pieces
from .common import stage, texts, tune

CAPACITY = 4096
#: Pieces of one length that are ranked together in one task, about.
RANK_GROUP = 250_000
#: Rank bits in a slot key: length << RANK_BITS | rank.
RANK_BITS = 48


class Plan:
    """Sequences for a histogram of lengths. Bins of like content form groups of consecutive numbers."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.taken: dict[int, int] = {}
        self.bins = 0
        #: (length, first rank, first bin, items a bin, offset of the first)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.reduced = 0
        self.reduce()
        self.best_fit()

    def put(self, length: int, items: int, first_bin: int, each: int, offset: int) -> None:
        rank = self.taken.get(length, 0)
        self.slots.append((length, rank, first_bin, each, offset))
        self.taken[length] = rank + items
        if self.left[length] == items:
            del self.left[length]
        else:
            self.left[length] -= items

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """Close `times` bins that hold exactly these lengths."""
        at, offset = self.bins, 0
        for n in lengths:
            self.put(n, times, at, 1, offset)
            offset += n
        self.bins += times
        self.reduced += times

    def reduce(self) -> None:
        """Fix the sets that provably dominate every other set holding their largest document."""
        cap = self.capacity
        # A set that fills a bin with one or two documents dominates: whatever else could stand beside the larger
        # one fits in the place of the smaller.
        for n in sorted(self.left, reverse=True):
            if n not in self.left:
                continue
            if n == cap:
                self.fix((n,), self.left[n])
            elif 2 * n == cap and self.left[n] >= 2:
                self.fix((n, n), self.left[n] // 2)
            elif cap - n in self.left and 2 * n != cap:
                self.fix((n, cap - n), min(self.left[n], self.left[cap - n]))
        again = True
        while again and self.left:
            again = False
            ascending = sorted(self.left)
            for n in reversed(ascending):
                if n in self.left and not self.four(n, ascending) and (found := self.dominating(n)):
                    # A set that dominates does so again while it is there, as the alternatives only get fewer.
                    self.fix(found, min(self.left[x] // found.count(x) for x in found))
                    again = True
                    ascending = sorted(self.left)

    def four(self, n: int, ascending: list[int]) -> bool:
        """Whether three more fit beside n, the smallest there are."""
        took, room = 0, self.capacity - n
        for s in ascending:
            many = min(3 - took, self.left[s] - (s == n))
            took, room = took + many, room - many * s
            if took == 3 or room < 0:
                break
        return took == 3 and room >= 0

    def dominating(self, n: int) -> tuple[int, ...] | None:
        """A set with n that dominates all others with n, at most two of which fit beside it; or None."""
        room, have = self.capacity - n, dict(self.left)
        have[n] -= 1
        sizes = sorted(s for s, c in have.items() if c > 0)
        if not sizes or sizes[0] > room:
            return (n,)
        top = sizes[bisect.bisect_right(sizes, room) - 1]  # the largest that fits beside n
        # The best pair by sum, and the largest smaller member of any pair:
        best, second, lo, hi = 0, 0, 0, len(sizes) - 1
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            if a + b > room or (lo == hi and have[a] < 2):
                hi -= 1
            else:
                best, second = max(best, a + b), max(second, a)
                lo += 1
        if top >= best:
            return (n, top)
        have[top] -= 1
        rest = [s for s in sizes if have[s] > 0 and s <= room - top]
        if rest and rest[-1] >= second:  # it is at least as large as any pair, member by member
            return (n, top, rest[-1])
        return None

    def best_fit(self) -> None:
        """Best-fit decreasing on what is left; bins of equal content are handled together."""
        free: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
        rooms: list[int] = []

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in free:
                    free[room] = []
                    bisect.insort(rooms, room)
                free[room].append((first, n))

        for size in sorted(self.left, reverse=True):
            items = self.left[size]
            while items:
                i = bisect.bisect_left(rooms, size)
                if i == len(rooms):
                    room, each = self.capacity, self.capacity // size
                    first, n = self.bins, -(-items // each)
                    self.bins += n
                else:
                    room = rooms[i]
                    first, n = free[room].pop()
                    if not free[room]:
                        del free[room]
                        rooms.pop(i)
                    each = room // size
                full = min(n, items // each)
                if full:
                    self.put(size, full * each, first, each, self.capacity - room)
                    items -= full * each
                    keep(room - each * size, first, full)
                if full < n and items:
                    self.put(size, items, first + full, items, self.capacity - room)
                    keep(room - items * size, first + full, 1)
                    full, items = full + 1, 0
                keep(room, first + full, n - full)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots sorted by length and rank, for a binary search."""
        s = sorted(self.slots)
        keys = np.array([n << RANK_BITS | r for n, r, *_ in s], np.int64)
        return keys, np.array(s, np.int64).reshape(-1, 5)


class TokenBytes:
    """Ids by the tokenizers library, as little-endian bytes; the words of Latin-1 texts are memoised."""

    def __init__(self, text: str, cap: int = 250_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for a task
        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        chars = byte_chars()
        self.shown = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(256)}
        self.words = Memo(self.word, cap)

    def word(self, piece: str) -> bytes:
        """Ids of a piece as the pre-tokenizer hands it to the library's model: its bytes as characters."""
        return array("I", [t.id for t in self.model.tokenize(piece.translate(self.shown))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        pieces = None if any(s in text for s in self.special) else latin_pieces(text)
        return self.whole(text) if pieces is None else b"".join(map(self.words.__getitem__, pieces))


_TOKENS: dict[int, TokenBytes] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Tokenise whole texts, end each with end_id, and cut those that are longer than capacity."""
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(shared.value.encode())
        if key not in _TOKENS:
            _TOKENS.clear()
            _TOKENS[key] = TokenBytes(shared.value)
        make = _TOKENS[key].ids
        for b in batches:
            doc, no, start, length, crc = [], [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), texts(b)):
                ids = memoryview(make(text) + end)
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    doc.append(i)
                    no.append(k)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(no, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY, rank_group: int = RANK_GROUP) -> DataFrame:
    """Give every piece (length from 1 to capacity) a sequence and an offset; all columns are kept.

    The histogram (at most `capacity` rows) comes to the driver; the plan that goes back is bounded by the capacity
    alone. Pieces of one length, which may be a third of all, are split over salts, so no group has many more than
    rank_group rows.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    keys, slots = Plan(counts, capacity).arrays()
    salts = max(1, -(-max(counts.values(), default=1) // rank_group))
    cols = pieces.columns
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("length", "_salt").orderBy(*[F.col(f"`{c}`") for c in cols])
    ranked = (
        salted.withColumn("_row", F.row_number().over(within).cast("long"))
        .join(base.drop("count"), ["length", "_salt"])
        .select(*cols, (F.col("_base") + F.col("_row") - 1).alias("_rank"))
    )
    shared = spark.sparkContext.broadcast((keys, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots = shared.value
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            s = slots[np.searchsorted(keys, n << RANK_BITS | rank, "right") - 1] if len(keys) else np.empty((0, 5), np.int64)
            nth = rank - s[:, 1]
            out = {c: b.column(c) for c in cols}
            out["sequence_id"] = pa.array(s[:, 2] + nth // s[:, 3])
            out["offset"] = pa.array(s[:, 4] + nth % s[:, 3] * n)
            yield pa.RecordBatch.from_pydict(out)

    return ranked.mapInArrow(run, T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pack documents (doc_id, text; other columns are ignored) into few sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty
    text is the end id alone; repeated rows are packed as often as they occur; null ids are kept; an empty table
    gives no rows. Which of several equal rows takes which place is open and makes no difference.
    """
    return place(stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
