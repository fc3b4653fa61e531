"""What happens to a scene from block to block: motion, changing weights, speech blocks, noise floor, verdicts, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions import geometry as G

#: Share of the loudest element below which an element carries nothing.
CARRIED_FLOOR = 1e-4


def object_blocks(updates: DataFrame, keys: list[str], order: list[str], at: str, gain: str, active: str, end: Column) -> DataFrame:
    """Delta updates as absolute blocks [start, until). Gain and activity are carried on separately; an inactive object
    has gain 0 and keeps its level for later. A last block lasts to end, and no block ends before it starts. Before the
    first statement gain is 1 and the object is active."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = F.coalesce(F.last(gain, ignorenulls=True).over(kept), F.lit(1.0))
    on = F.coalesce(F.last(active, ignorenulls=True).over(kept), F.lit(True))
    until = F.greatest(F.col(at), F.coalesce(F.lead(at).over(w), end))
    return updates.select(*keys, *[c for c in order if c != at], F.col(at).alias("start"), until.alias("until"), F.when(on, said).otherwise(0.0).alias("gain"))


def weight_flips(weights: DataFrame, block: str, keys: list[str], weight: str) -> DataFrame:
    """Rows (block, keys, was, now) in which a sparse weight turned to or from zero against the block before. A block
    and the one before are brought together by one shuffle of both, in place of a full outer join. Repeated rows add
    up; null weights are zero."""
    one = weights.groupBy(block, *keys).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("w"))
    both = F.array(
        F.struct(F.col(block).alias("b"), F.lit(0.0).alias("was"), F.col("w").alias("now"), F.lit(True).alias("here")),
        F.struct((F.col(block) + 1).alias("b"), F.col("w").alias("was"), F.lit(0.0).alias("now"), F.lit(False).alias("here")),
    )
    pairs = one.select(*keys, F.inline(both)).groupBy(F.col("b").alias(block), *keys).agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    return pairs.where((F.col("was") == 0) != (F.col("now") == 0))


def motion_windows(path: DataFrame, keys: list[str], block: str, direction: str, energy: str, loudest: str, span: int) -> DataFrame:
    """Window of span + 1 blocks up to each block of an element: path, net way, wobble = path - net, blur at the mean
    direction, largest share of the loudest. Windows that aren't full, or carried no more than CARRIED_FLOOR, are left out."""
    w = Window.partitionBy(*keys).orderBy(block)
    full = w.rowsBetween(-span, 0)
    steps = w.rowsBetween(-span + 1, 0)
    step = F.coalesce(G.apart(F.lag(direction).over(w), F.col(direction)), F.lit(0.0))
    share = F.when(F.col(loudest) > 0, F.col(energy) / F.col(loudest)).otherwise(0.0)
    d = path.select(*keys, block, direction, step.alias("step"), share.alias("share"))
    mean = [F.avg(F.col(direction)[i]).over(full) for i in range(3)]
    length = F.sqrt(mean[0] * mean[0] + mean[1] * mean[1] + mean[2] * mean[2])
    where = [F.when(length > 1e-12, m).otherwise(F.col(direction)[i]) for i, m in enumerate(mean)]
    out = d.select(
        *keys,
        block,
        F.count("*").over(full).alias("n"),
        F.sum("step").over(steps).alias("path"),
        G.apart(F.first(direction).over(full), F.col(direction)).alias("net"),
        G.blur(where[0], where[1]).alias("blur"),
        F.max("share").over(full).alias("carried"),
    )
    out = out.where((F.col("n") == span + 1) & (F.col("carried") > CARRIED_FLOOR)).drop("n")
    return out.withColumn("wobble", F.greatest(F.lit(0.0), F.col("path") - F.col("net")))


def coverage(frames: DataFrame, keys: list[str], index: str, opened: Column, size: int, share: float) -> DataFrame:
    """Tumbling groups of size frames, true where at least a share of them is open; groups that aren't full are dropped."""
    g = frames.groupBy(*keys, F.floor(F.col(index) / size).alias("sub")).agg(F.count("*").alias("n"), F.avg(opened.cast("double")).alias("rate"))
    return g.where(F.col("n") == size).select(*keys, "sub", (F.col("rate") >= share).alias("open"))


def noise_floor(frames: DataFrame, keys: list[str], index: str, level: str, size: int, lowest: int = -120, fraction: float = 0.1) -> DataFrame:
    """Floor of each full span of size frames: the lowest bin of one decibel at which the count from below reaches the
    fraction. It holds from the span's last frame through the next span, so it is given with the frames from and to."""
    span = F.floor(F.col(index) / size)
    bins = F.greatest(F.lit(0), F.floor(F.col(level) - lowest)).cast("int")
    h = frames.groupBy(*keys, span.alias("span"), bins.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "span")
    c = h.select(*keys, "span", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    c = c.where((F.col("all") == size) & (F.col("upto") >= fraction * size)).groupBy(*keys, "span").agg((F.min("bin") + lowest).cast("double").alias("floor"))
    return c.select(*keys, "span", "floor", ((F.col("span") + 1) * size - 1).alias("since"), ((F.col("span") + 2) * size - 2).alias("upto"))


def verdict(share: Column, run: Column, share_bound: float, run_bound: float) -> Column:
    """refuse where a share or a run is over its bound, remark over half of it, else pass."""

    def over(k: float) -> Column:
        return F.coalesce((share > share_bound * k) | (run > run_bound * k), F.lit(False))

    return F.when(over(1), "refuse").when(over(0.5), "remark").otherwise("pass")


def nearest(objects: DataFrame, centres: DataFrame, on: list[str], direction: str, centre: str, index: str) -> DataFrame:
    """Row of objects with the index of the centre of its class that has the largest cosine, the last one on ties.
    Centres are reduced to one array for each class first, so objects aren't multiplied; a class holds as many centres
    as a clustering has elements."""
    c = centres.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(centre).alias("d")))).alias("_centres"))
    best = F.array_max(F.transform("_centres", lambda s: F.struct(G.dot(s["d"], F.col(direction)).alias("cosine"), s["i"].alias("i"))))
    out = objects.join(c, on).withColumn("_best", best)
    return out.withColumns({"cosine": F.col("_best.cosine"), index: F.col("_best.i")}).drop("_best", "_centres")


def beds(frames: DataFrame, key: str, place: list[Column], speakers: list[tuple[int, ...]]) -> DataFrame:
    """Elements that never leave one grid place, and that place is a speaker's."""
    spot = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(place)])
    g = frames.groupBy(key).agg(F.min(spot).alias("low"), F.max(spot).alias("high"))
    at = F.array(*[F.col(f"low.p{i}") for i in range(len(place))])
    known = F.array(*[F.array(*[F.lit(v) for v in s]) for s in speakers])
    return g.where(F.col("low") == F.col("high")).where(F.array_contains(known, at)).select(key, at.alias("place"))


def look_ahead_mean(value: str, keys: list[str], order: list[str], behind: int, ahead: int) -> Column:
    """Mean over a window of blocks behind and ahead, clipped to those that exist."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-behind, ahead))


def anticipating(value: str, keys: list[str], order: list[str], arriving: float = 2.0) -> Column:
    """A block's value, or the next block's where that is `arriving` times as large or more."""
    ahead = F.coalesce(F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))
    return F.when(ahead >= F.col(value) * arriving, ahead).otherwise(F.col(value))


def motion_close(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over the windows of motion_windows(): their number, of those that moved (net way over the blur) and wobbled
    (half the wobble over it), carried share in all and in wobbling ones, wobble and net way weighted by it, and by how
    much the wobble went over at worst and in all."""
    over = F.col("wobble") / 2 - F.col("blur")
    wobbled = over > 0
    return windows.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count_if(F.col("net") > F.col("blur")).alias("moved"), F.count_if(wobbled).alias("wobbled"), F.sum("carried").alias("share"),
        F.sum(F.col("carried") * F.col("wobble")).alias("weighted_wobble"), F.sum(F.col("carried") * F.col("net")).alias("weighted_net"),
        F.coalesce(F.sum(F.when(wobbled, F.col("carried"))), F.lit(0.0)).alias("wobbling_share"), F.coalesce(F.sum(F.when(wobbled, over)), F.lit(0.0)).alias("over"),
        F.coalesce(F.max(F.when(wobbled, over)), F.lit(0.0)).alias("worst"),
    )


#: Fixed value: excitation of a band's power at full scale, 105 decibels.
FULL_SCALE_EXCITATION = 3.1622776601683795e10


def perceptual_weights(objects: DataFrame, scene: list[str], local: bool = True, full_scale: float = FULL_SCALE_EXCITATION) -> DataFrame:
    """scene, object, energy: what an object adds to the loudness of its scene, band by band, over what masks it, times
    its importance. objects: scene, object, powers (array by band), radiated (gain vector, for overlap), importance.

    The masker of a band is the sum of the others' power, by how far they come from the same place where local. A scene
    holds a bounded number of objects, which become one array, so that no row is joined with another.
    """
    from auralake.functions import levels as L

    o = objects.select(*scene, "object", "powers", "radiated", F.coalesce("importance", F.lit(1.0)).alias("importance"), G.norm(F.col("radiated")).alias("_n"))
    every = o.groupBy(*scene).agg(F.collect_list(F.struct("object", "powers", "radiated", F.col("_n").alias("n"))).alias("_all"))
    met = o.join(every, scene)

    def overlap(other: Column) -> Column:
        lengths = F.col("_n") * other["n"]
        cos = F.when(lengths > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), G.dot(F.col("radiated"), other["radiated"]) / lengths))).otherwise(0.0)
        return cos if local else F.lit(1.0)

    others = F.filter("_all", lambda a: a["object"] != F.col("object"))
    parts = F.transform(others, lambda a: F.struct(overlap(a).alias("k"), a["powers"].alias("p")))
    masker = F.aggregate(parts, F.transform("powers", lambda p: p * 0.0), lambda acc, a: F.zip_with(acc, a["p"], lambda m, p: m + a["k"] * p))
    met = met.withColumn("_masker", masker)
    added = F.aggregate(F.zip_with("powers", "_masker", lambda own, m: L.added_loudness(own * full_scale, m * full_scale)), F.lit(0.0), lambda s, v: s + v)
    return met.select(*scene, "object", (added * F.col("importance")).alias("energy"))
