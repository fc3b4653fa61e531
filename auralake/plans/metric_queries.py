"""Queries on what clusterings cost, and the SQL that says the same.

A scene is an order, its objects are the order's lines, a line's supplier (of four) the element it goes to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auralake.functions import geometry as G
from auralake.operators import metric as M
from auralake.operators import scene as S
from auralake.plans.queries import _r, _table, query

_LI = "(SELECT DISTINCT l_orderkey AS block, l_linenumber AS object, l_suppkey % 4 AS element, l_discount * 10 AS weight, l_quantity AS energy, l_partkey AS part FROM lineitem)"
_SCENE = f"""li AS (SELECT block, object, min(element) AS element, max(weight) AS weight, max(energy) AS energy, min(part) AS part FROM {_LI} GROUP BY 1, 2),
    wanted AS (SELECT block, object, layout, channel, ((part * (channel + 1) + layout) % 7) / 10.0 AS want FROM li, (SELECT unnest(range(2)) AS layout), (SELECT unnest(range(3)) AS channel)),
    gains AS (SELECT element, layout, channel, ((element * 3 + channel * 2 + layout) % 5) / 10.0 AS gain FROM (SELECT unnest(range(4)) AS element), (SELECT unnest(range(2)) AS layout), (SELECT unnest(range(3)) AS channel)),
    each AS (SELECT block, object, layout, energy, sum((coalesce(weight * gain, 0) - want) ** 2) AS difference, sum(want ** 2) AS reference, sum(coalesce(weight * gain, 0) ** 2) AS reached
        FROM wanted JOIN li USING (block, object) LEFT JOIN gains USING (element, layout, channel) GROUP BY ALL),
    err AS (SELECT *, CASE WHEN reference > 1e-12 THEN sqrt(difference / reference) ELSE 0 END AS error, CASE WHEN sqrt(reference) > 1e-12 THEN sqrt(reached) / sqrt(reference) ELSE 1 END AS level, sqrt(reference) AS own FROM each),
    lay AS (SELECT block, layout, sum(energy * error) / sum(energy) AS mean, coalesce(max(CASE WHEN energy > 5 AND energy > loudest * 0.3 THEN error END), 0) AS worst, sum(energy * level) / sum(energy) AS energy, sum(energy * own) / sum(energy) AS own
        FROM (SELECT *, max(energy) OVER (PARTITION BY block, layout) AS loudest FROM err) GROUP BY 1, 2)"""
FLOOR, SHARE = 5.0, 0.3


def _lines(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("object"))
    return li.agg(F.min(F.col("l_suppkey") % 4).alias("element"), F.max(F.col("l_discount") * 10).alias("weight"), F.max("l_quantity").alias("energy"), F.min("l_partkey").alias("part"))


def _scene(spark, sf_dir):
    li = _lines(spark, sf_dir)
    layout, channel = F.explode(F.array(*[F.lit(i) for i in range(2)])), F.explode(F.array(*[F.lit(i) for i in range(3)]))
    wanted = li.select("block", "object", "part", layout.alias("layout")).select("*", channel.alias("channel"))
    wanted = wanted.select("block", "object", "layout", "channel", (((F.col("part") * (F.col("channel") + 1) + F.col("layout")) % 7) / 10).alias("gain"))
    elements = spark.range(4).select(F.col("id").alias("element"), layout.alias("layout")).select("*", channel.alias("channel"))
    elements = elements.withColumn("gain", ((F.col("element") * 3 + F.col("channel") * 2 + F.col("layout")) % 5) / 10)
    weights = li.select("block", "object", "element", "weight")
    return wanted, weights, elements, li.select("block", "object", "energy")


def _errors(spark, sf_dir):
    wanted, weights, elements, energies = _scene(spark, sf_dir)
    return M.object_errors(wanted, weights, elements, ["block"], ["layout"]), weights, energies


def _layers(spark, sf_dir):
    errors, weights, energies = _errors(spark, sf_dir)
    return M.layers(errors, energies, ["block"], ["layout"], FLOOR, SHARE), weights, energies


@query(f"WITH {_SCENE} SELECT block, object, layout, round(error, 6) AS error, round(level, 6) AS level, round(own, 6) AS own FROM err")
def object_errors(spark, sf_dir):
    e = _errors(spark, sf_dir)[0]
    return e.select("block", "object", "layout", *[_r(F.col(c), 6).alias(c) for c in ("error", "level", "own")])


@query(f"WITH {_SCENE} SELECT block, object, layout, round(sqrt(sum(want * want)), 6) AS own FROM wanted GROUP BY 1, 2, 3")
def own_norms(spark, sf_dir):
    return M.own_norms(_scene(spark, sf_dir)[0], ["block"], ["layout"]).withColumn("own", _r(F.col("own"), 6))


@query(f"WITH {_SCENE} SELECT block, layout, round(mean, 6) AS mean, round(worst, 6) AS worst, round(energy, 6) AS energy, round(own, 6) AS own FROM lay")
def clustering_layers(spark, sf_dir):
    lay = _layers(spark, sf_dir)[0]
    return lay.select("block", "layout", *[_r(F.col(c), 6).alias(c) for c in ("mean", "worst", "energy", "own")])


_REPORT = f"""{_SCENE}, top AS (SELECT block, avg(mean) AS mean, max(worst) AS worst, avg(energy) AS energy FROM lay GROUP BY 1), n AS (SELECT block, count(*) AS objects, count(*) FILTER (WHERE energy <= 5) AS inaudible,
    avg(CASE WHEN weight <> 0 THEN 1.0 ELSE 0 END) AS paths, max(CASE WHEN weight <> 0 THEN 1 ELSE 0 END) AS worst_paths FROM li GROUP BY 1), rep AS (SELECT * FROM top JOIN n USING (block))"""


def _report(spark, sf_dir):
    lay, weights, energies = _layers(spark, sf_dir)
    return M.report(lay, weights, energies, ["block"], FLOOR)


@query(f"WITH {_REPORT} SELECT block, round(mean, 6) AS mean, round(worst, 6) AS worst, round(energy, 6) AS energy, objects, inaudible, round(paths, 6) AS paths, worst_paths FROM rep")
def clustering_report(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select("block", *[_r(F.col(c), 6).alias(c) for c in ("mean", "worst", "energy", "paths")], "objects", "inaudible", "worst_paths")


@query(f"WITH {_REPORT} SELECT block % 10 AS programme, count(*) AS blocks, round(sum(mean), 4) AS sum, round(avg(mean), 6) AS mean, round(max(worst), 6) AS worst, CAST(sum(inaudible) AS BIGINT) AS inaudible FROM rep GROUP BY 1")
def cost_accumulator(spark, sf_dir):
    a = M.accumulated(_report(spark, sf_dir).withColumn("programme", F.col("block") % 10), ["programme"])
    return a.select("programme", "blocks", _r(F.col("sum"), 4).alias("sum"), _r(F.col("mean"), 6).alias("mean"), _r(F.col("worst"), 6).alias("worst"), "inaudible")


@query(f"""WITH {_SCENE}, whole AS (SELECT block, avg(mean) AS mean, max(worst) AS worst, avg(energy) AS energy FROM lay GROUP BY 1)
    SELECT layout, round(sum(mean), 3) AS sum, round(max(worst), 6) AS worst, round(min(energy), 6) AS low, round(max(energy), 6) AS high FROM lay GROUP BY 1
    UNION ALL SELECT NULL, round(sum(mean), 3), round(max(worst), 6), round(min(energy), 6), round(max(energy), 6) FROM whole""")
def ruler_tally(spark, sf_dir):
    t = M.tally(_layers(spark, sf_dir)[0], ["block"], ["layout"])
    return t.select("layout", _r(F.col("sum"), 3).alias("sum"), *[_r(F.col(c), 6).alias(c) for c in ("worst", "low", "high")])


@query(f"WITH {_SCENE} SELECT block, round(sum(CASE WHEN reference > 1e-12 THEN energy * difference / reference ELSE 0 END), 5) AS cost FROM each GROUP BY 1")
def squared_cost(spark, sf_dir):
    errors, _, energies = _errors(spark, sf_dir)
    return M.squared_cost(errors, energies, ["block"]).withColumn("cost", _r(F.col("cost")))


@query(f"WITH {_SCENE} SELECT block, object, round(error, 6) AS error FROM (SELECT *, round(error, 9) AS e9 FROM err WHERE energy > 10) QUALIFY row_number() OVER (PARTITION BY block ORDER BY e9 DESC, layout, object) = 1")
def worst_object(spark, sf_dir):
    errors, _, energies = _errors(spark, sf_dir)
    # Errors that are equal but for the order of adding must tie alike in both engines.
    return M.worst_object(errors.withColumn("error", F.round("error", 9)), energies, ["block"], ["layout"], 10.0).withColumn("error", _r(F.col("error"), 6))


@query(f"WITH {_SCENE} SELECT block, element, object, round(energy * weight * weight, 6) AS share FROM li WHERE energy * weight * weight > 0 QUALIFY row_number() OVER (PARTITION BY block, element ORDER BY energy * weight * weight DESC, object DESC) = 1")
def dominant_member(spark, sf_dir):
    _, weights, _, energies = _scene(spark, sf_dir)
    return M.dominant_members(weights, energies, ["block"]).withColumn("share", _r(F.col("share"), 6))


@query(f"WITH {_SCENE} SELECT block, element, round(sum(energy * weight * weight), 5) AS carried FROM li GROUP BY 1, 2")
def element_energy(spark, sf_dir):
    _, weights, _, energies = _scene(spark, sf_dir)
    return M.carried(weights, energies, ["block"]).withColumn("carried", _r(F.col("carried")))


@query("""WITH p AS (SELECT label AS element, vec_id AS block, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM p),
    d AS (SELECT element, row_number() OVER (PARTITION BY element ORDER BY block) AS block, x / n AS x, y / n AS y, z / n AS z, z > 0 AS on_ FROM n),
    s AS (SELECT element, CASE WHEN on_ AND lag(on_) OVER w THEN degrees(acos(greatest(-1, least(1, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w)))) END AS step FROM d WINDOW w AS (PARTITION BY element ORDER BY block))
    SELECT element, round(coalesce(sum(step), 0), 3) AS travel, count(step) AS steps, count(*) FILTER (WHERE step > 15) AS jumps FROM s GROUP BY 1""")
def element_travel(spark, sf_dir):
    from pyspark.sql import Window

    e = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    p = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("element"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("block"), G.unit(*e).alias("d"))
    p = p.withColumn("carried", F.greatest(F.lit(0.0), F.col("d")[2]))
    return M.travel(p, ["element"], "block", "d", "carried").withColumn("travel", _r(F.col("travel"), 3))


@query("""WITH w AS (SELECT l_orderkey // 4 AS block, l_linenumber AS object, l_suppkey % 4 AS element, sum(CASE WHEN l_discount > 0.04 THEN l_discount ELSE 0 END) AS weight, sum(l_quantity) AS e FROM lineitem GROUP BY 1, 2, 3),
    o AS (SELECT block, object, sum(e) AS energy FROM w GROUP BY 1, 2), loud AS (SELECT block, object FROM (SELECT *, max(energy) OVER (PARTITION BY block) AS m FROM o) WHERE energy > 0 AND energy > m * 1e-4),
    occ AS (SELECT block, element FROM w GROUP BY 1, 2 HAVING sum(weight) > 0),
    f AS (SELECT coalesce(b.block, a.block + 1) AS block, coalesce(a.object, b.object) AS object, coalesce(a.element, b.element) AS element FROM w a FULL JOIN w b ON a.block + 1 = b.block AND a.object = b.object AND a.element = b.element WHERE (coalesce(a.weight, 0) = 0) <> (coalesce(b.weight, 0) = 0))
    SELECT f.block, count(*) AS flips FROM f JOIN loud USING (block, object) WHERE EXISTS (SELECT 1 FROM occ WHERE occ.element = f.element AND (occ.block = f.block OR occ.block = f.block - 1)) GROUP BY 1""")
def flip_count(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("block"), F.col("l_linenumber").alias("object"), (F.col("l_suppkey") % 4).alias("element"), F.when(F.col("l_discount") > 0.04, F.col("l_discount")).otherwise(0.0).alias("weight"), F.col("l_quantity").alias("energy"))
    flips = S.weight_flips(li, "block", ["object", "element"], "weight")
    energies = li.groupBy("block", "object").agg(F.sum("energy").alias("energy"))
    return M.flip_count(flips, energies, li.groupBy("block", "element").agg(F.sum("weight").alias("w")).where("w > 0"), "block")


@query("""WITH c AS (SELECT l_suppkey, sum(l_quantity) AS warm, sum(l_quantity * (0.9 + l_discount)) AS cold, sum(l_tax) AS moving, sum(l_extendedprice) AS energy FROM lineitem GROUP BY 1)
    SELECT l_suppkey, cold < warm * 0.95 AND warm - cold > 1e-4 * energy AND cold + moving / 8 < warm AS worth FROM c""")
def restart_decision(spark, sf_dir):
    q = F.col("l_quantity")
    c = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(q).alias("warm"), F.sum(q * (0.9 + F.col("l_discount"))).alias("cold"), F.sum("l_tax").alias("moving"), F.sum("l_extendedprice").alias("energy"))
    return c.select("l_suppkey", M.restart_worth(F.col("warm"), F.col("cold"), F.col("moving"), F.col("energy")).alias("worth"))
