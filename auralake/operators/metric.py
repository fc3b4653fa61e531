"""What a clustering costs: how far the gains that objects reach through elements are from those they ask for.

Rows are sparse. wanted: scene, layout, object, channel, gain. weights: scene, object, element, weight. elements:
element, layout, channel, gain, and of the scene's columns those that its gains depend on. energies: scene, object,
energy. scene and layout are lists of key columns; nulls in a gain, weight or energy count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions import geometry as G

#: Length under which an object asks for nothing, share of the loudest that is audible, angle of a jump.
NOTHING, AUDIBLE_SHARE, JUMP = 1e-12, 1e-4, 15.0


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def own_norms(wanted: DataFrame, scene: list[str], layout: list[str]) -> DataFrame:
    """scene, layout, object, own: the length of each object's own gains."""
    return wanted.groupBy(*scene, *layout, "object").agg(F.sqrt(F.sum(_zero("gain") * _zero("gain"))).alias("own"))


def object_errors(wanted: DataFrame, weights: DataFrame, elements: DataFrame, scene: list[str], layout: list[str]) -> DataFrame:
    """scene, layout, object with difference and reference (squared lengths), error (their relative length, 0 for an
    object that asks for nothing), level (reached over asked, 1 for such an object) and own.

    Reached and wanted gains meet in a sum by channel, in place of a full outer join; weights of zero take no part.
    """
    on = [c for c in scene if c in elements.columns]
    reached = weights.where(_zero("weight") != 0).select(*scene, "object", "element", "weight").join(elements.select(*on, *layout, "element", "channel", "gain"), [*on, "element"])
    reached = reached.select(*scene, *layout, "object", "channel", F.lit(0.0).alias("want"), (F.col("weight") * _zero("gain")).alias("got"))
    asked = wanted.select(*scene, *layout, "object", "channel", _zero("gain").alias("want"), F.lit(0.0).alias("got"))
    asks = F.max(F.col("want").isNotNull() & F.col("asked"))
    both = asked.withColumn("asked", F.lit(True)).unionByName(reached.withColumn("asked", F.lit(False)))
    channel = both.groupBy(*scene, *layout, "object", "channel").agg(F.sum("want").alias("want"), F.sum("got").alias("got"), asks.alias("asked"))
    w, g = F.col("want"), F.col("got")
    each = channel.groupBy(*scene, *layout, "object").agg(F.sum((g - w) * (g - w)).alias("difference"), F.sum(w * w).alias("reference"), F.sum(g * g).alias("_reached"), F.bool_or("asked").alias("_asked"))
    r = F.col("reference")
    return each.where("_asked").select(
        *scene, *layout, "object", "difference", "reference",
        F.when(r > NOTHING, F.sqrt(F.col("difference") / r)).otherwise(0.0).alias("error"),
        F.when(F.sqrt(r) > NOTHING, F.sqrt(F.col("_reached")) / F.sqrt(r)).otherwise(1.0).alias("level"), F.sqrt(r).alias("own"),
    )


def audible(energy: Column, loudest: Column, floor: float = 0.0, share: float = AUDIBLE_SHARE) -> Column:
    """Over the absolute floor, and over a share of the loudest."""
    return (energy > floor) & (energy > loudest * share)


def heard(energy: Column, floor: Column | float) -> Column:
    """Over the absolute floor alone."""
    return energy > floor


def audible_only(rows: DataFrame, scene: list[str], energy: str, floor: float = 0.0, share: float = AUDIBLE_SHARE) -> DataFrame:
    """The rows that are audible beside the loudest of their scene."""
    loudest = F.max(F.greatest(F.lit(0.0), F.col(energy))).over(Window.partitionBy(*scene))
    return rows.withColumn("_loudest", loudest).where(audible(F.col(energy), F.col("_loudest"), floor, share)).drop("_loudest")


def layers(errors: DataFrame, energies: DataFrame, scene: list[str], layout: list[str], floor: float = 0.0, share: float = AUDIBLE_SHARE) -> DataFrame:
    """scene, layout, mean (energy-weighted relative error), worst (of audible objects), energy (weighted level), own.
    A scene without energy has mean 0, level 1 and length 0."""
    e = errors.join(energies.select(*scene, "object", F.greatest(F.lit(0.0), _zero("energy")).alias("e")), [*scene, "object"])
    e = e.withColumn("_loudest", F.max("e").over(Window.partitionBy(*scene, *layout)))
    total = F.sum("e")

    def weighted(c: str, silent: float) -> Column:
        return F.when(total > 0, F.sum(F.col("e") * F.col(c)) / total).otherwise(silent)

    worst = F.coalesce(F.max(F.when(audible(F.col("e"), F.col("_loudest"), floor, share), F.col("error"))), F.lit(0.0))
    return e.groupBy(*scene, *layout).agg(weighted("error", 0.0).alias("mean"), worst.alias("worst"), weighted("level", 1.0).alias("energy"), weighted("own", 0.0).alias("own"))


def report(layers: DataFrame, weights: DataFrame, energies: DataFrame, scene: list[str], floor: float = 0.0) -> DataFrame:
    """By scene the mean of the layouts' means and levels, the largest of their worsts, numbers of objects and of those
    that are not heard, mean and largest number of elements an object reaches."""
    top = layers.groupBy(*scene).agg(F.avg("mean").alias("mean"), F.max("worst").alias("worst"), F.avg("energy").alias("energy"))
    paths = weights.where(_zero("weight") != 0).groupBy(*scene, "object").agg(F.count("*").alias("paths"))
    o = energies.select(*scene, "object", F.greatest(F.lit(0.0), _zero("energy")).alias("e")).join(paths, [*scene, "object"], "left")
    counts = o.groupBy(*scene).agg(
        F.count("*").alias("objects"), F.count_if(~heard(F.col("e"), floor)).alias("inaudible"),
        (F.sum(F.coalesce("paths", F.lit(0))) / F.count("*")).alias("paths"), F.coalesce(F.max("paths"), F.lit(0)).alias("worst_paths"),
    )
    return top.join(counts, scene)


def accumulated(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Over all scenes of a programme: their number, unweighted sum and mean of their means, worst, inaudible objects."""
    return reports.groupBy(*keys).agg(F.count("*").alias("blocks"), F.sum("mean").alias("sum"), F.avg("mean").alias("mean"), F.max("worst").alias("worst"), F.sum("inaudible").alias("inaudible"))


def tally(layers: DataFrame, scene: list[str], layout: list[str]) -> DataFrame:
    """Over all scenes, a row for each layout (sum of means, worst) and one for all (layout null: sums of the scenes'
    means of layouts, worst, lowest and highest level)."""
    each = layers.groupBy(*layout).agg(F.sum("mean").alias("sum"), F.max("worst").alias("worst"), F.min("energy").alias("low"), F.max("energy").alias("high"))
    whole = layers.groupBy(*scene).agg(F.avg("mean").alias("mean"), F.max("worst").alias("worst"), F.avg("energy").alias("energy"))
    whole = whole.agg(F.sum("mean").alias("sum"), F.max("worst").alias("worst"), F.min("energy").alias("low"), F.max("energy").alias("high"))
    return each.unionByName(whole.withColumns({c: F.lit(None).cast(dict(layers.dtypes)[c]) for c in layout}))


def squared_cost(errors: DataFrame, energies: DataFrame, scene: list[str]) -> DataFrame:
    """scene, cost: energy times squared relative error, added up; objects that ask for nothing cost nothing."""
    e = errors.join(energies.select(*scene, "object", F.greatest(F.lit(0.0), _zero("energy")).alias("e")), [*scene, "object"])
    return e.groupBy(*scene).agg(F.coalesce(F.sum(F.when(F.col("reference") > NOTHING, F.col("e") * F.col("difference") / F.col("reference"))), F.lit(0.0)).alias("cost"))


def worst_object(errors: DataFrame, energies: DataFrame, scene: list[str], layout: list[str], least: float) -> DataFrame:
    """scene, object, error: the object over `least` energy with the largest relative error in any layout; of equal ones
    the first by layout, then object."""
    e = errors.join(energies.select(*scene, "object", "energy"), [*scene, "object"]).where(_zero("energy") > least)
    best = F.min(F.struct((-F.col("error")).alias("e"), *layout, "object"))
    return e.groupBy(*scene).agg(best.alias("b")).select(*scene, "b.object", (-F.col("b.e")).alias("error"))


def dominant_members(weights: DataFrame, energies: DataFrame, scene: list[str]) -> DataFrame:
    """scene, element, object, share: the object that gives an element most of its energy e w^2, the last of equal ones;
    elements that carry nothing are left out."""
    c = weights.select(*scene, "object", "element", "weight").join(energies.select(*scene, "object", "energy"), [*scene, "object"])
    c = c.withColumn("share", F.greatest(F.lit(0.0), _zero("energy")) * _zero("weight") * _zero("weight")).where("share > 0")
    return c.groupBy(*scene, "element").agg(F.max(F.struct("share", "object")).alias("m")).select(*scene, "element", "m.object", "m.share")


def carried(weights: DataFrame, energies: DataFrame, scene: list[str]) -> DataFrame:
    """scene, element, carried: the energy of an element, the sum of e w^2."""
    c = weights.select(*scene, "object", "element", "weight").join(energies.select(*scene, "object", "energy"), [*scene, "object"])
    return c.groupBy(*scene, "element").agg(F.sum(F.greatest(F.lit(0.0), _zero("energy")) * _zero("weight") * _zero("weight")).alias("carried"))


def travel(elements: DataFrame, keys: list[str], block: str, direction: str, carried: str) -> DataFrame:
    """By element the angle it travels between consecutive blocks in both of which it carries something, the number of
    such steps, and of those over JUMP degrees."""
    w = Window.partitionBy(*keys).orderBy(block)
    both = (F.col(carried) > 0) & (F.lag(carried).over(w) > 0) & (F.lag(block).over(w) == F.col(block) - 1)
    step = F.when(both, G.apart(F.lag(direction).over(w), F.col(direction)))
    steps = elements.select(*keys, step.alias("step"))
    return steps.groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("travel"), F.count("step").alias("steps"), F.count_if(F.col("step") > JUMP).alias("jumps"))


def flip_count(flips: DataFrame, energies: DataFrame, occupied: DataFrame, block: str) -> DataFrame:
    """block, flips: flips (block, object, element) of objects that are audible in their block, to or from elements that
    carry something in it or in the one before. occupied: block, element, of elements that carry something."""
    loud = audible_only(energies, [block], "energy").select(block, "object")
    there = occupied.select(block, "element").unionByName(occupied.select((F.col(block) + 1).alias(block), "element")).distinct()
    met = flips.join(loud, [block, "object"], "left_semi").join(there, [block, "element"], "left_semi")
    return met.groupBy(block).agg(F.count("*").alias("flips"))


def restart_worth(warm_cost: Column, cold_cost: Column, moving: Column, energy: Column, worth: float = 0.05, least: float = 1e-4, blocks: int = 8) -> Column:
    """Whether a cold solution is worth changing to: better by a share, by a part of the scene's energy, and still
    better when a part of what the change moves, 1 / blocks, is added to its cost."""
    return (cold_cost < warm_cost * (1 - worth)) & (warm_cost - cold_cost > least * energy) & (cold_cost + moving / blocks < warm_cost)


def moving(warm: DataFrame, cold: DataFrame, scene: list[str]) -> DataFrame:
    """scene, moving: what a change from warm to cold moves, over elements: what one carries times 1 - cosine of its two
    directions. warm: scene, element, direction, carried; cold: scene, element, direction."""
    both = warm.join(cold.select(*scene, "element", F.col("direction").alias("_to")), [*scene, "element"])
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), G.dot(F.col("direction"), F.col("_to"))))
    return both.groupBy(*scene).agg(F.sum(F.when(F.col("carried") > 0, F.col("carried") * (1 - cos)).otherwise(0.0)).alias("moving"))
