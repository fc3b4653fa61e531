"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo
from .common import groups, maybe_in, membership, stage, texts, tune, wide

#: Hashed terms, terms that the model keeps, and its factors.
BITS, KEPT, FACTORS = 18, 4096, 8
#: Passes over the labelled rows; about how many of them a part holds, on which one task fits; parts averaged together.
EPOCHS, PART, TOGETHER = 12, 20_000, 16
#: Log-odds of every text where the labels are of one kind, or there are none.
NOTHING = -40.0
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, which inflected and compound forms share."""
    terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return tuple({zlib.crc32(t.encode()) >> (32 - BITS) for t in terms})


class Terms:
    """Hashed terms of a text; words are memoised (bounded)."""

    def __init__(self, keep: frozenset[int] | None = None) -> None:
        self.of = Memo(word_terms if keep is None else lambda w: tuple(t for t in word_terms(w) if t in keep), 200_000)

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        for t in map(self.of.__getitem__, set(WORD.findall(text.lower()))):
            if t:
                out.update(t)
        return out


class FactorizationMachine:
    """w0 + sum of w over a text's terms + sum of <v_i, v_j> over its pairs of terms, as a log-odds."""

    def __init__(self, terms: list[int], w0: float = 0.0) -> None:
        self.index = {t: i for i, t in enumerate(terms)}
        self.w0 = w0
        self.w = np.zeros(len(terms))
        self.v = np.random.default_rng(0).normal(0, 0.05, (len(terms), FACTORS))
        self.gw, self.gv, self.g0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6

    def state(self) -> np.ndarray:
        """All that fitting changes, a row for each term; the last row is w0's."""
        last = np.zeros((1, 2 + 2 * FACTORS))
        last[0, :2] = self.w0, self.g0
        return np.concatenate([np.column_stack([self.w, self.gw, self.v, self.gv]), last])

    def resume(self, state: np.ndarray) -> None:
        self.w, self.gw, self.v, self.gv = (x.copy() for x in (state[:-1, 0], state[:-1, 1], state[:-1, 2 : 2 + FACTORS], state[:-1, 2 + FACTORS :]))
        self.w0, self.g0 = state[-1, :2].tolist()

    def raw(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-odds of rows; flat holds their term indices one after the other, none of them empty."""
        v = self.v[flat]
        s = np.add.reduceat(v, starts)
        return self.w0 + np.add.reduceat(self.w[flat], starts) + 0.5 * (s**2 - np.add.reduceat(v**2, starts)).sum(1)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        z = np.full(len(rows), self.w0)
        full = [i for i, r in enumerate(rows) if len(r)]
        if full:
            sizes = np.array([len(rows[i]) for i in full])
            z[full] = self.raw(np.concatenate([np.array(rows[i], np.int64) for i in full]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, rows: list[list[int]], y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, done: int = 0) -> None:
        """Adagrad on the logistic loss, for `epochs` after the first `done` ones."""
        rng = np.random.default_rng(1)
        gw, gv = self.gw, self.gv
        for epoch in range(done + epochs):
            order = rng.permutation(len(rows))
            if epoch < done:
                continue
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                p = self.scores([rows[i] for i in ids])
                d = p - y[ids]
                g = float(d.mean())
                self.g0 += g * g
                self.w0 -= rate * g / self.g0**0.5
                full = [k for k, i in enumerate(ids) if len(rows[i])]
                if not full:
                    continue
                flat = np.concatenate([np.array(rows[ids[k]], np.int64) for k in full])
                sizes = np.array([len(rows[ids[k]]) for k in full])
                rep = np.repeat(np.arange(len(full)), sizes)
                v = self.v[flat]
                s = np.add.reduceat(v, np.cumsum(sizes) - sizes)
                e = d[full][rep] / len(ids)
                used, where = np.unique(flat, return_inverse=True)
                dw = np.bincount(where, e, len(used)) + decay * self.w[used]
                ev = e[:, None] * (s[rep] - v)
                dv = np.stack([np.bincount(where, ev[:, f], len(used)) for f in range(FACTORS)], 1) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])


def held_out_column():
    """Rows that no model is fitted on: crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


#: Frequent terms of which pairs are tried, telling terms they are tried with, and the gain a pair must bring.
PAIRED, WITH, PAIR_GAIN = 1024, 256, 40.0


def association(both: np.ndarray, one: np.ndarray, clean: float, toxic: float) -> np.ndarray:
    """Likelihood ratio (G) between the label and having a term: `both` toxic rows and `one` clean rows have it."""
    n, p = toxic + clean, toxic / (toxic + clean)
    gain = np.zeros(np.shape(both))
    for got, want in ((both, (both + one) * p), (one, (both + one) * (1 - p)), (toxic - both, (n - both - one) * p), (clean - one, (n - both - one) * (1 - p))):
        gain += 2 * got * np.log(np.maximum(got, 1e-9) / np.maximum(want, 1e-9))
    return gain


def pair_gains(picked: DataFrame, place: np.ndarray, own: np.ndarray, first: int, clean: int, toxic: int) -> np.ndarray:
    """For each term from `first` on, the most that having it together with another one tells beyond what the two tell
    alone (own); 0 for the terms before. place: each picked term's number among these, or -1.

    The counts of all pairs over all rows are products of 0/1 matrices, added up in the cluster.
    """
    width = len(own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, width, width), np.int32)
        for b in batches:
            y = b.column("toxic").to_numpy()
            blobs = b.column("terms").to_pylist()
            at = place[np.frombuffer(b"".join(blobs), ">u2")]
            row = np.repeat(np.arange(len(blobs)), [len(x) // 2 for x in blobs])
            x = np.zeros((len(blobs), width), np.float32)
            x[row[at >= 0], at[at >= 0]] = 1
            for k in (0, 1):
                if (y == k).any():
                    seen[k] += (x[y == k].T @ x[y == k]).astype(np.int32)
        if seen.any():
            for a in range(first, width, 64):
                some = range(a, min(width, a + 64))
                yield pa.RecordBatch.from_pydict({"term": pa.array(list(some), pa.int32()), "seen": pa.array([seen[:, i].tobytes() for i in some], pa.binary())})

    def gain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, t in groups(batches, "term"):
            one, both = sum(np.frombuffer(x, np.int32).reshape(2, width).astype(float) for x in t["seen"].to_pylist())
            g = association(both, one, clean, toxic) - own - own[i]
            g[i] = 0
            yield pa.RecordBatch.from_pydict({"term": pa.array([i], pa.int32()), "gain": pa.array([float(g.max(initial=0))])})

    counts = picked.mapInArrow(count, "term int, seen binary").repartition(wide(picked), "term").sortWithinPartitions("term")
    got = counts.mapInArrow(gain, "term int, gain double").toArrow()
    best = np.zeros(width)
    best[got["term"].to_numpy()] = got["gain"].to_numpy()
    return best


def mean_state(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows with each term and the mean state of models fitted on parts, a term's by its rows in each of them."""
    if len(parts) == 1:
        return parts[0]
    n, states = (np.stack(x) for x in zip(*parts))
    total = n.sum(0)
    return total, np.where((total > 0)[:, None], (n[:, :, None] * states).sum(0) / np.maximum(total, 1)[:, None], states[0])


FITTED = "part int, n binary, state binary"


def _fitted(part: int, n: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n.astype(np.int64).tobytes()], pa.binary()), "state": pa.array([state.tobytes()], pa.binary())})


def _read_fitted(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    for part, n, state in zip(*(t[c].to_pylist() for c in ("part", "n", "state"))):
        yield part, (np.frombuffer(n, np.int64), np.frombuffer(state).reshape(-1, 2 + 2 * FACTORS))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted((x for b in batches for x in _read_fitted(b)), key=lambda x: x[0])
    if got:
        yield _fitted(got[0][0] // TOGETHER, *mean_state([x for _, x in got]))


def fit_parts(fm: FactorizationMachine, parts: DataFrame, n_parts: int) -> None:
    """Fit on all rows of all parts (part, sizes, flat, toxic). Each epoch, every part goes on from the same model on its
    own rows, and the next model is the mean of theirs; at most TOGETHER of them meet in a task or in the driver."""
    spark = parts.sparkSession
    terms = list(fm.index)
    each = EPOCHS if n_parts == 1 else 1  # a single part has nobody to wait for
    for done in range(0, EPOCHS, each):
        shared = spark.sparkContext.broadcast(fm.state())

        def train(batches: Iterator[pa.RecordBatch], done: int = done, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, sizes, flat, y in zip(*(b.column(c).to_pylist() for c in ("part", "sizes", "flat", "toxic"))):
                    own = FactorizationMachine(terms)
                    own.resume(shared.value)
                    flat, sizes, y = np.frombuffer(flat, "<u2").astype(np.int64), np.frombuffer(sizes, "<i4"), np.frombuffer(y, np.uint8)
                    own.fit(np.split(flat, np.cumsum(sizes)[:-1]), y.astype(float), epochs=each, done=done)
                    yield _fitted(part, np.append(np.bincount(flat, minlength=len(terms)), len(y)), own.state())

        made, n = parts.mapInArrow(train, FITTED), n_parts
        while n > TOGETHER:
            n = -(-n // TOGETHER)
            made = made.repartitionById(n, F.expr(f"cast(part div {TOGETHER} as int)")).mapInArrow(_together, FITTED)
        fm.resume(mean_state([x for _, x in sorted(_read_fitted(made.toArrow()), key=lambda x: x[0])])[1])
        shared.unpersist()


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> FactorizationMachine:
    """Fit on all labelled rows of docs that aren't held out; a caller may ask for about `sample` of them instead.

    labels: doc_id, toxic; a document with several labels counts as toxic if one says so; labels other than 0 and 1,
    null among them, don't count; of rows with one doc_id the smallest text counts. Without labels of both kinds there
    is nothing to learn: no text is toxic then.

    The rows' terms are staged once; rows stay in the cluster. Terms' counts (at most 2 ** BITS rows), pairs' gains (one
    number a term) and models (at most TOGETHER of KEPT terms at a time) come to the driver. Kept are up to KEPT terms:
    those that tell the label alone, and of the PAIRED most frequent others those that tell it in company of another,
    which is what the pairs are for. Rows are dealt to parts of about PART by a hash of doc_id, see fit_parts().
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out_column())
    if sample is not None and (total := known.count()) > sample:  # in 2 ** 62 steps, so that no table is too large for its share
        known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 2) < int(sample / total * (1 << 62)))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    kinds = {dict(x.dtypes)["doc_id"] for x in (own, known)}
    if len(kinds) == 1 and kinds <= {"int", "bigint", "string"}:  # a bit table of fixed size: most other texts aren't shuffled
        own = maybe_in(own, "doc_id", membership(known, "doc_id"))
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text")).join(known, "doc_id").select(F.xxhash64("doc_id").alias("key"), "text", "toxic")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            found = [np.sort(np.fromiter(terms(x), "<u4")).tobytes() for x in texts(b)]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "terms": pa.array(found, pa.binary()), "toxic": b.column("toxic")})

    rows = stage(rows.mapInArrow(cut, "key long, terms binary, toxic int"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        seen = np.zeros(2, np.int64)
        for b in batches:
            blobs, y = b.column("terms").to_pylist(), b.column("toxic").to_pylist()
            for k in (0, 1):
                n[k] += np.bincount(np.frombuffer(b"".join(x for x, v in zip(blobs, y) if v == k), "<u4"), minlength=1 << BITS)
                seen[k] += y.count(k)
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *at.tolist()], pa.int32()), "clean": pa.array([int(seen[0]), *n[0, at].tolist()], pa.int64()), "toxic": pa.array([int(seen[1]), *n[1, at].tolist()], pa.int64())})

    counts = rows.select("terms", "toxic").mapInArrow(count, "term int, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where("term = -1 or clean + toxic >= 4").toPandas()
    all_ = counts[counts.term == -1]
    clean, toxic = (int(all_[c].sum()) for c in ("clean", "toxic"))
    if not clean or not toxic:
        return FactorizationMachine([], NOTHING)
    c = counts[counts.term >= 0].sort_values("term")
    terms, a, b = c.term.to_numpy(), c.toxic.to_numpy(float), c.clean.to_numpy(float)
    gain = association(a, b, clean, toxic)
    best = np.argsort(-gain, kind="stable")[:KEPT]
    best = best[gain[best] > 15]
    rest = np.setdiff1d(np.arange(len(terms)), best)
    common = rest[np.argsort(-(a + b)[rest], kind="stable")[:PAIRED]]
    tried = np.concatenate([best, common])
    index = np.full(1 << BITS, -1, np.int32)
    index[terms[tried]] = np.arange(len(tried))
    shared = spark.sparkContext.broadcast(index)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shared.value[np.frombuffer(x, "<u4")] for x in b.column("terms").to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "terms": pa.array([np.sort(t[t >= 0]).astype(">u2").tobytes() for t in at], pa.binary()), "toxic": b.column("toxic")})

    picked = stage(rows.mapInArrow(pick, "key long, terms binary, toxic int"), "picked")
    some = np.concatenate([np.arange(min(len(best), WITH)), len(best) + np.arange(len(common))])
    place = np.full(len(tried), -1, np.int32)
    place[some] = np.arange(len(some))
    more = pair_gains(picked.select("terms", "toxic"), place, gain[tried[some]], min(len(best), WITH), clean, toxic)
    found = np.flatnonzero(more > PAIR_GAIN)
    found = some[found[np.argsort(-more[found], kind="stable")]][: max(0, KEPT - len(best))]
    kept = np.concatenate([np.arange(len(best)), found])
    fm = FactorizationMachine(terms[tried[kept]].tolist(), float(np.log((toxic + 0.5) / (clean + 0.5))))
    again = np.full(len(tried), -1, np.int32)
    again[kept] = np.arange(len(kept))
    n_parts = -(-(clean + toxic) // PART)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, data = 0, []
        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()
                data += zip(b.column("terms").to_pylist(), b.column("toxic").to_pylist())
        if data:
            data.sort()  # the order of rows must not matter
            at = [again[np.frombuffer(t, ">u2")] for t, _ in data]
            at = [t[t >= 0].astype("<u2") for t in at]
            sizes, y = np.array(list(map(len, at)), "<i4"), np.array([v for _, v in data], np.uint8)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("sizes", sizes), ("flat", np.concatenate(at)), ("toxic", y))}})

    dealt = picked.select(F.pmod("key", F.lit(n_parts)).cast("int").alias("part"), "terms", "toxic").repartitionById(n_parts, "part")
    fit_parts(fm, stage(dealt.mapInArrow(pack, "part int, sizes binary, flat binary, toxic binary"), "parts"), n_parts)
    return fm


def score(docs: DataFrame, labels: DataFrame, sample: int | None = None, keep: bool = False) -> DataFrame:
    """Score every row of docs by its whole text: doc_id, held_out, score (0 to 1), predicted (1 from 0.5).

    Nothing but the text enters a score. A null or empty text has the score of a text without known terms; repeated
    rows are scored alike; a null doc_id is never held out. Without labels of both kinds every score is about 0 and
    nothing is predicted. keep: return score, predicted and the whole row as _row, of any names and types.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels, sample))
    first = "_row" if keep else "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        terms = Terms(frozenset(fm.index))
        for b in batches:
            p = fm.scores([sorted(fm.index[t] for t in terms(x)) for x in texts(b)])
            yield pa.RecordBatch.from_pydict({first: b.column(first), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row") if keep else F.col("doc_id")
    rows = docs.select(row, "text")
    out = rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return out if keep else out.select("doc_id", held_out_column().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns; all rows where nothing can be learned, as there
    are no labels or only labels of one kind."""
    return score(docs, labels, keep=True).where("predicted = 0").select(*[F.col(f"_row.`{c}`") for c in docs.columns])
