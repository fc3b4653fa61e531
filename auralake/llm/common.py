"""Helpers shared by the training-data operators: staging, Arrow streaming and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch; bounds what a Python worker holds at once, since texts can be long.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as single texts can be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, whose
    only machine is the driver's; on a cluster its executors would not share such a folder, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Folders of staged tables that are still there.
_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _STAGED:
            _STAGED.remove(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def stage_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what make() returns, and delete the tables that it staged on the way."""
    before = set(_STAGED)
    made = make()
    between = [p for p in _STAGED if p not in before]
    out = stage(made, name)
    _delete(out.sparkSession, between)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts as str, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def wide(df: DataFrame, factor: int = 1) -> int:
    """A number of partitions that follows the cluster and the session's setting."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return max(int(conf), df.sparkSession.sparkContext.defaultParallelism) * factor


#: Bytes of text for which there is a bucket, where one task holds a bucket of records of the texts at a time.
BUCKET_BYTES = 16 << 20


def buckets_for(docs: DataFrame, each: int = BUCKET_BYTES) -> int:
    """Buckets by the bytes of all texts, so that a bucket's size does not grow with the table."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(wide(docs), -(-total // each))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal keys in a stream that is sorted by key. Holds one run at a time."""
    held: list[pa.RecordBatch] = []
    current: object = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and k[lo] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = k[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


class UnionFind:
    """Smallest member as the root; memory is one entry for each linked member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uf = UnionFind()
    for b in batches:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            uf.union(x, y)
    nodes = list(uf.up)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        pairs = [(x, r) for x in part if (r := uf.find(x)) != x]
        yield pa.RecordBatch.from_pydict(
            {"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())}
        )


#: Parts into which the edges of one node are split.
SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the smallest v of each u. The edges of a hub are dealt over SALTS tasks; what meets by u alone is
    at most one row for each of them."""
    salted = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    own = salted.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = own.select("u", "part", F.min("m").over(Window.partitionBy("u")).alias("m"))
    return salted.join(least, ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find. edges (u long, v long), any order and repeats; returns (node, root), the root
    being the smallest node that is reachable; only nodes with a link to another appear.

    Each partition first contracts its own edges to stars (a spanning forest, so no link is lost), then rounds of
    large-star and small-star hook roots to smaller ones until nothing changes. Groups are never gathered: a
    round takes the minimum of each node's neighbours, which is pre-aggregated, and joins it back, a hub's in parts.
    """
    spark = edges.sparkSession
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    # u > v throughout: an edge points from the larger node to the smaller.
    e = stage(e.mapInArrow(_local_stars, "u long, v long"), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        # Large star: every neighbour larger than u hooks to the smallest of u's neighbours and u.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: u and its smaller neighbours hook to the smallest of them.
        small = _with_least(large).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")
        )
        new = stage(small.select("s.u", "s.v").where("u <> v").distinct(), "edges")
        # Done when the edges form stars: no root is itself hooked to another, no node has two roots.
        bad = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        twice = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        unstage(e)
        e = new
        if bad.isEmpty() and twice.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Bits of a membership table: 2 MB, at most MEMBER_BITS / 64 rows, whatever it is made from.
MEMBER_BITS = 1 << 24


def membership(ids: DataFrame, column: str) -> DataFrame:
    """A hashed bit table of a column's values (word, mask): of fixed size, so that it may be broadcast."""
    h = F.pmod(F.xxhash64(column), F.lit(MEMBER_BITS))
    bits = ids.select(F.shiftright(h, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), {MEMBER_BITS}) & 63 as int))").alias("bit"))
    return stage(bits.groupBy("word").agg(F.bit_or("bit").alias("mask")), "members")


def maybe_in(df: DataFrame, column: str, members: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose value may be in the table, or (inside=False) those whose value is surely not. No shuffle of df."""
    h = F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(MEMBER_BITS))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.shiftright(h, 6).alias("word"), h.bitwiseAND(63).cast("int").alias("_bit"))
    got = row.join(F.broadcast(members), "word", "inner" if inside else "left")
    is_set = F.expr("shiftright(mask, _bit) & 1 = 1")
    return got.where(is_set if inside else ~F.coalesce(is_set, F.lit(False))).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
