"""Exact top-k search by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tune

SCALE = 1024
#: Vectors in one index, and queries that are broadcast at a time.
SHARD, BLOCK = 16_384, 8_192
#: Falling shares of the largest impact at which the bounds are tried, and the share of members that is rescored as soon
#: as the others are out by proof.
ROUNDS = (0.2, 0.14, 0.1, 0.07, 0.05, 0.03, 0.0)
RESCORED = 0.5


def quantised(vectors: list[list[float]]) -> np.ndarray:
    """floor(1024 * x) in double precision; shorter vectors are filled up with zeros."""
    width = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return np.floor(SCALE * x).astype(np.int64)


class Index:
    """For each dimension the vectors in order of their component, an integer: the quantised impact. Both ends of such a
    list are segments of falling impact, whatever the sign of a query's component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.n, self.width = x.shape
        self.largest = int(np.abs(x).max(initial=0))
        self.posting = np.argsort(x, axis=0, kind="stable").T.astype(np.int32).copy()
        self.impact = np.take_along_axis(x.T, self.posting, 1).astype(float)
        self.energy = self.impact**2
        self.norm = (x.astype(float) ** 2).sum(1)
        self.float = x.astype(float)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best, ties to the smaller id. self.read and self.rescored say what it took.

        Segments are added to the members' scores in falling impact |q_d x_d|. What a member's score may still gain is
        at most the root of (squares of q not yet met) x (squares of x not yet met), by Cauchy and Schwarz. The best by
        then are scored exactly; the k-th of these is a score that the k best reach, so that a member whose score and
        possible gain are below it is out by proof. Members that may still be in are scored exactly.
        """
        width = max(self.width, len(q))
        x = self.x if width == self.width else np.pad(self.x, ((0, 0), (0, width - self.width)))
        q = q if width == len(q) else np.pad(q, (0, width - len(q)))
        large = max(1, self.largest) * max(1, int(np.abs(q).max(initial=0))) * max(1, width)
        self.read, self.rescored = 0, self.n
        if large >= 1 << 52:  # beyond exact doubles
            place = np.arange(self.n)
            if large >= 1 << 63:
                scores = np.array([sum(int(a) * int(b) for a, b in zip(v, q)) for v in x], object)
            else:
                scores = x @ q
            order = sorted(range(self.n), key=lambda i: (-scores[i], self.ids[i]))[:k]
            return np.array([max(-(1 << 63), min((1 << 63) - 1, int(scores[i]))) for i in order], np.int64), place[order]
        own = q[: self.width].astype(float)
        weight = np.abs(own)
        score, met, met_q = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        total = float((own**2).sum())
        low, high = np.zeros(self.width, np.int64), np.full(self.width, self.n)  # what lies between is still unread
        cand = np.arange(self.n)
        useful = np.flatnonzero(weight)
        for share in ROUNDS if self.n > 8 * k else ():
            least = share * float(weight.max(initial=0)) * self.largest
            rows, dims, sizes = [], [], []
            for d in useful.tolist():
                t = least / weight[d]
                a = max(low[d], int(np.searchsorted(self.impact[d], -t, "right")))
                z = max(a, min(high[d], int(np.searchsorted(self.impact[d], t, "left"))))
                for lo, hi in ((low[d], a), (z, high[d])):
                    if lo < hi:
                        rows.append(slice(lo, hi))
                        dims.append(d)
                        sizes.append(hi - lo)
                low[d], high[d] = a, z
            if rows:
                at = np.concatenate([self.posting[d, s] for d, s in zip(dims, rows)])
                score += np.bincount(at, np.concatenate([self.impact[d, s] * own[d] for d, s in zip(dims, rows)]), self.n)
                met += np.bincount(at, np.concatenate([self.energy[d, s] for d, s in zip(dims, rows)]), self.n)
                met_q += np.bincount(at, np.repeat(own[dims] ** 2, sizes), self.n)
                self.read += int(sum(sizes))
            gain = np.sqrt(np.maximum(self.norm - met, 0) * np.maximum(total - met_q, 0)) * (1 + 1e-9) + 0.5  # scores are whole
            best = np.argpartition(score, self.n - 2 * k)[self.n - 2 * k :]
            floor = np.partition(self.float[best] @ own, k)[k]
            cand = np.flatnonzero(score + gain >= floor)
            if len(cand) <= max(4 * k, RESCORED * self.n):
                break
        self.rescored = len(cand)
        scores = (self.float[cand] @ own).astype(np.int64)
        order = np.lexsort((self.ids[cand], -scores))[:k]
        return scores[order], cand[order]


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k best rows of vectors for each row of queries (both vec_id, embedding; other columns are ignored).

    Returns query_id, rank (from 1), vec_id, score. Vectors that are null or hold null, NaN or infinite components take
    no part, nor do null ids; a query skips its own row and no other; repeated candidates each have a rank; of queries
    with one id the smallest vector counts; vectors of other lengths are filled up with zeros; ties go to the
    smaller id; an empty table gives no rows.

    Queries are broadcast in blocks of about `block` rows, a fixed bound, each of which scans the vectors once; every
    task indexes its vectors in shards and returns k + 1 rows for each query, of which a window keeps the best. A block's
    result is staged before the next one starts, where there are several. The own row is taken out at the end: among the
    best it is a row with the query's id and the score of the query with itself, and rows alike in both are alike here.
    """
    spark = vectors.sparkSession
    tune(spark)
    asked = stage(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-asked.count() // block))
    parts = [_answers(vectors, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), k, blocks > 1) for i in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _answers(vectors: DataFrame, asked: DataFrame, k: int, several: bool) -> DataFrame:
    """top_k() of one block of queries."""
    rows = asked.toArrow()
    ids, qs = rows["vec_id"].to_numpy(), quantised(rows["embedding"].to_pylist())
    shared = vectors.sparkSession.sparkContext.broadcast((ids, qs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, qs = shared.value
        selves = [_self_score(q) for q in qs]
        held_ids: list[int] = []
        held: list[list[float]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            index = Index(np.array(held_ids, np.int64), quantised(held))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for qid, q, alone in zip(q_ids, qs, selves):
                score, at = index.search(q, k + 1)
                for c, v in zip(out, (np.full(len(at), qid, np.int64), index.ids[at], score, (index.ids[at] == qid) & (score == alone))):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "vec_id", "score", "own"), out)})

        for b in batches:
            held_ids += b.column("vec_id").to_pylist()
            held += b.column("embedding").to_pylist()
            if len(held) >= SHARD:
                yield from answer()
                held_ids, held = [], []
        if held:
            yield from answer()

    found = usable(vectors).mapInArrow(run, "query_id long, vec_id long, score long, own boolean")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", F.col("own").desc())
    some = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    own = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("query_id"))
    after = some.withColumn("_own", F.coalesce(own, F.lit(k + 2))).where("rank <> _own")
    after = after.withColumn("rank", F.when(F.col("rank") > F.col("_own"), F.col("rank") - 1).otherwise(F.col("rank"))).where(F.col("rank") <= k)
    after = after.select("query_id", "rank", "vec_id", "score")
    if several:
        after = stage(after, "best")
        shared.unpersist()
    return after


def _self_score(q: np.ndarray) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(a) for a in q)))
