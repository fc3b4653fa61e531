"""Queries on panning, mixes and what scenes sound like, and the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from auralake.functions import geometry as G
from auralake.operators import panning as N
from auralake.operators import scene as S
from auralake.plans.queries import E, _events, _r, _table, query
from auralake.plans.scene_queries import XYZ, _xyz

_V = f"(SELECT vec_id, label, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM {XYZ}))"
_M = {layout: N.presentation_matrix(layout) for layout in ("5.1", "2.0")}


def _fold_sql(layout: str, channel: str) -> str:
    return " + ".join(f"{g!r} * g{N.RENDERED.index(s)}" for (s, t), g in _M[layout].items() if t == channel)


@query(f"""WITH g AS (SELECT vec_id, {", ".join(f"abs(CAST(embedding[{i + 1}] AS DOUBLE)) AS g{i}" for i in range(8))} FROM embeddings)
    SELECT vec_id, {", ".join(f"round({_fold_sql('5.1', c)}, 6) AS five_{c.lower()}" for c in N.FOLDED["5.1"])}, {", ".join(f"round({_fold_sql('2.0', c)}, 6) AS two_{c.lower()}" for c in N.FOLDED["2.0"])} FROM g""")
def matrix_fold(spark, sf_dir):
    gains = F.map_from_arrays(F.array(*[F.lit(c) for c in N.RENDERED]), F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))))
    e = _table(spark, sf_dir, "embeddings").select("vec_id", N.matrix_fold(gains, "5.1").alias("a"), N.matrix_fold(gains, "2.0").alias("b"))
    return e.select("vec_id", *[_r(F.col("a")[c], 6).alias(f"five_{c.lower()}") for c in N.FOLDED["5.1"]], *[_r(F.col("b")[c], 6).alias(f"two_{c.lower()}") for c in N.FOLDED["2.0"]])


BEDS = ["L", "R", "C", "Lss", "Rss", "Lrs", "Rrs", "Lfh", "Rfh", "Lrh", "Rrh"]
_HULL = N.Hull(N.speaker_directions(BEDS))
_TRI = ", ".join(f"({t}, {', '.join(str(int(c)) for c in _HULL.corners[t])}, {', '.join(repr(float(v)) for v in _HULL.inverse[t].ravel())})" for t in range(len(_HULL.corners)))
_TO = ", ".join(f"({i}, {j}, {float(v)!r})" for i, row in enumerate(_HULL.spread_to) for j, v in enumerate(row) if v)


@query(f"""WITH tri(t, c0, c1, c2, a0, a1, a2, b0, b1, b2, d0, d1, d2) AS (VALUES {_TRI}), away(c, s, share) AS (VALUES {_TO}),
    g AS (SELECT vec_id, t, c0, c1, c2, a0 * x + a1 * y + a2 * z AS g0, b0 * x + b1 * y + b2 * z AS g1, d0 * x + d1 * y + d2 * z AS g2 FROM {_V} v CROSS JOIN tri),
    b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(least(g0, g1, g2), 9) DESC, t) = 1),
    p AS (SELECT vec_id, unnest([c0, c1, c2]) AS c, unnest([greatest(0, g0) ** 2, greatest(0, g1) ** 2, greatest(0, g2) ** 2]) AS p FROM b), n AS (SELECT vec_id, c, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM p)
    SELECT vec_id, s AS speaker, round(sqrt(sum(p * share)), 5) AS gain FROM n JOIN away USING (c) GROUP BY 1, 2 HAVING sum(p * share) > 1e-8""")
def hull_panning(spark, sf_dir):
    p = _xyz(spark, sf_dir).select("vec_id", G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    g = N.hull_gains(p, "d", BEDS).select("vec_id", F.posexplode("gains").alias("speaker", "g"))
    return g.where("g * g > 1e-8").select("vec_id", "speaker", _r(F.col("g")).alias("gain"))


@query(f"""WITH c AS (SELECT label, vec_id % 5 AS g, x, y, z, abs(x) AS w FROM {_V}), s AS (SELECT label, g, sum(w * w * x) AS a, sum(w * w * y) AS b, sum(w * w * z) AS c, sqrt(sum(w * w)) AS level, max(w) AS m, list(w) AS ws FROM c GROUP BY 1, 2), v AS (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM s)
    SELECT label, g, round(a / n, 6) AS x, round(degrees(acos(greatest(-1, least(1, b / n)))), 4) AS drift, len(list_filter(ws, lambda w: w / level > 0.1)) AS paths, round(m / level, 6) AS strongest FROM v""")
def energy_vector(spark, sf_dir):
    c = _xyz(spark, sf_dir).select("label", (F.col("vec_id") % 5).alias("g"), G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    v = N.energy_vector(c.withColumn("w", F.abs(F.col("d")[0])), ["label", "g"], "d", "w")
    front = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    return v.select("label", "g", _r(F.col("vector")[0], 6).alias("x"), _r(N.drift(front, F.col("vector")), 4).alias("drift"), "paths", _r(F.col("strongest"), 6).alias("strongest"))


@query(f"""WITH v AS (SELECT * FROM {_V}), b AS (SELECT * FROM v WHERE vec_id % 7 = 0)
    SELECT v.vec_id, b.vec_id AS bed FROM v LEFT JOIN b USING (label) QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY v.x * b.x + v.y * b.y + v.z * b.z DESC, b.vec_id DESC) = 1""")
def nearest_bed(spark, sf_dir):
    v = _xyz(spark, sf_dir).select("vec_id", "label", G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    c = v.select("label", F.col("vec_id").alias("bed"), F.col("d").alias("c"), (F.col("vec_id") % 7 == 0).alias("is_bed"))
    return N.nearest_bed(v, c, ["label"], "d", "c", "bed", "is_bed").select("vec_id", "bed")


@query(f"SELECT label, vec_id FROM {_V} QUALIFY row_number() OVER (PARTITION BY label ORDER BY y DESC, vec_id) <= 5")
def spare_slots(spark, sf_dir):
    v = _xyz(spark, sf_dir).select("vec_id", "label", G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    return N.spare_slots(v, ["label"], "vec_id", "d", 5)


@query("""WITH s AS (SELECT vec_id // 8 AS block, vec_id % 8 AS object, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x, (vec_id % 3) / 2.0 AS gain FROM embeddings), w AS (SELECT block, object, e.element, (object + e.element) % 3 / 2.0 AS a, (object * e.element) % 4 / 3.0 AS b FROM (SELECT DISTINCT block, object FROM s), (SELECT unnest(range(3)) AS element) e)
    SELECT block, element, i, round(sum(x * gain * (a + (b - a) * i / 64)), 6) AS y FROM s JOIN w USING (block, object) WHERE gain <> 0 AND (a <> 0 OR b <> 0) GROUP BY 1, 2, 3""")
def block_mix(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("block"), (F.col("vec_id") % 8).alias("object"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"), ((F.col("vec_id") % 3) / 2).alias("gain"))
    o, k = F.col("object"), F.col("element")
    w = e.select("block", "object", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("element")).select("block", "object", "element", ((o + k) % 3 / 2).alias("w_from"), ((o * k) % 4 / 3).alias("w_to"))
    return N.block_mix(e, w, ["block"]).select("block", "element", F.posexplode("samples").alias("i", "y")).select("block", "element", "i", _r(F.col("y"), 6).alias("y"))


@query(f"""WITH e AS (SELECT event_id, programme, user_id, us, value FROM {E}), g AS (SELECT user_id, us, max(value) / 200 AS l FROM e WHERE event_id % 4 = 0 GROUP BY 1, 2), s AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS nxt, lag(l) OVER (PARTITION BY user_id ORDER BY us) AS was FROM g),
    seg AS (SELECT user_id, us AS start, nxt AS stop, coalesce(was, l) AS l0, l AS l1 FROM s)
    SELECT e.programme, e.us AS frame, round(sum(value * (l0 + CASE WHEN stop IS NULL THEN 0 ELSE (l1 - l0) * (e.us - start) / (stop - start) END)), 8) AS l, round(sum(value * (1 - l1)), 8) AS r
    FROM e JOIN seg ON e.user_id = seg.user_id AND e.us >= start AND (stop IS NULL OR e.us < stop) GROUP BY 1, 2""")
def mixdown(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "programme", "user_id", "us", "value")
    g = e.where("event_id % 4 = 0").groupBy("programme", "user_id", "us").agg((F.max("value") / 200).alias("l"))
    w = Window.partitionBy("programme", "user_id").orderBy("us")
    s = g.select("programme", "user_id", F.col("us").alias("start"), F.lead("us").over(w).alias("end"), F.coalesce(F.lag("l").over(w), "l").alias("l_from"), F.col("l").alias("l_to"), (1 - F.col("l")).alias("r_from"), (1 - F.col("l")).alias("r_to"))
    m = N.mixdown(e, s, ["programme"], "user_id", "us", "value", ["l", "r"])
    return m.select("programme", F.col("us").alias("frame"), _r(F.col("l"), 8).alias("l"), _r(F.col("r"), 8).alias("r"))


@query("""WITH w AS (SELECT l_orderkey AS block, l_linenumber AS object, l_suppkey % 3 AS element, max(l_discount * 10) AS weight, max(l_tax * 10) AS peak FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT block, object, max(peak) AS peak FROM w GROUP BY 1, 2),
    t AS (SELECT w.*, sum(abs(weight) * p.peak) OVER (PARTITION BY block, element) AS total FROM w JOIN p USING (block, object))
    SELECT block, object, element, CASE WHEN total > pi() / 6 AND weight > 0 THEN round(weight * pi() / 6 / total, 8) END AS bound FROM t""")
def headroom_bounds(spark, sf_dir):
    w = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("object"), (F.col("l_suppkey") % 3).alias("element")).agg(F.max(F.col("l_discount") * 10).alias("weight"), F.max(F.col("l_tax") * 10).alias("peak"))
    b = N.peak_bounds(w.select("block", "object", "element", "weight"), w.groupBy("block", "object").agg(F.max("peak").alias("peak")), ["block"], math.pi / 6)
    return b.select("block", "object", "element", _r(F.col("bound"), 8).alias("bound"))


@query("""SELECT l_returnflag, count(*) AS compared, count(*) FILTER (WHERE l_linenumber % 5 <> 0) AS exact, round(max(CASE WHEN l_linenumber % 5 = 0 THEN l_discount * 100 ELSE 0 END), 6) AS most FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, max(l_discount) + 0.01 AS l_discount, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def recorded_decoded(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), (F.max("l_discount") + 0.01).alias("d"), F.max("l_quantity").alias("sample"))
    got = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 == 0, F.col("sample") + F.col("d")).otherwise(F.col("sample")).alias("sample"))
    return N.compare_samples(li, got, ["l_orderkey", "l_linenumber"], "l_returnflag", 0.01).withColumn("most", _r(F.col("most"), 6))


@query(f"""WITH e AS (SELECT event_id, programme, us, value FROM {E}), a AS (SELECT programme, us, max(value) AS v FROM e WHERE event_id % 3 = 0 GROUP BY 1, 2), b AS (SELECT programme, us, max(value) + 5 AS v FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2),
    j AS (SELECT e.programme, a.v AS av, b.v AS bv FROM e ASOF LEFT JOIN a ON e.programme = a.programme AND e.us >= a.us ASOF LEFT JOIN b ON e.programme = b.programme AND e.us >= b.us)
    SELECT programme, count(*) FILTER (WHERE av IS NOT NULL AND bv IS NOT NULL) AS compared, count(*) FILTER (WHERE abs(av - bv) > 20) AS over, round(max(abs(av - bv)), 6) AS most, count(*) FILTER (WHERE (av IS NULL) <> (bv IS NULL)) AS unmatched FROM j GROUP BY 1""")
def metadata_compare(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "programme", "us", "value")
    a = e.where("event_id % 3 = 0").groupBy("programme", "us").agg(F.array(F.max("value"), F.lit(0.0), F.lit(1.0)).alias("p"))
    b = e.where("event_id % 2 = 0").groupBy("programme", "us").agg(F.array(F.max("value") + 5, F.lit(0.0), F.lit(1.0)).alias("p"))
    return N.compare_positions(e, a, b, ["programme"], "us", "p", 20.0).withColumn("most", _r(F.col("most"), 6))


@query(f"""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean, CASE WHEN coalesce(lead(value) OVER w, 0) >= 2 * value THEN coalesce(lead(value) OVER w, 0) ELSE value END AS placed
    FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def look_ahead(spark, sf_dir):
    e = _events(spark, sf_dir)
    k, o = ["user_id"], ["us", "event_id"]
    return e.select("event_id", _r(S.look_ahead_mean("value", k, o, 2, 2), 6).alias("mean"), S.anticipating("value", k, o).alias("placed"))


@query(f"""WITH d AS (SELECT * FROM {_V}), s AS (SELECT *, coalesce(degrees(acos(greatest(-1, least(1, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w)))), 0) AS step, max(abs(z)) OVER (PARTITION BY label) AS loud FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    m AS (SELECT label, count(*) OVER w AS n, sum(step) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS path, degrees(acos(greatest(-1, least(1, x * first_value(x) OVER w + y * first_value(y) OVER w + z * first_value(z) OVER w)))) AS net,
        degrees(abs(atan2(avg(x) OVER w, avg(y) OVER w))) AS az, max(abs(z) / loud) OVER w AS carried FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    f AS (SELECT label, net, greatest(0, path - net) AS wobble, CASE WHEN az <= 90 THEN 3.6 + 6.4 * az / 90 ELSE 10 - 4.5 * (az - 90) / 90 END AS blur, carried FROM m WHERE n = 5 AND carried > 1e-4)
    SELECT label, count(*) AS windows, count(*) FILTER (WHERE net > blur) AS moved, count(*) FILTER (WHERE wobble / 2 > blur) AS wobbled, round(sum(carried), 4) AS share, round(sum(carried * wobble), 3) AS weighted_wobble, round(max(greatest(0, wobble / 2 - blur)), 3) AS worst FROM f GROUP BY 1""")
def motion_close(spark, sf_dir):
    p = _xyz(spark, sf_dir).select("vec_id", "label", G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    p = p.withColumns({"e": F.abs(F.col("d")[2]), "loud": F.max(F.abs(F.col("d")[2])).over(Window.partitionBy("label"))})
    c = S.motion_close(S.motion_windows(p, ["label"], "vec_id", "d", "e", "loud", 4), ["label"])
    return c.select("label", "windows", "moved", "wobbled", _r(F.col("share"), 4).alias("share"), _r(F.col("weighted_wobble"), 3).alias("weighted_wobble"), _r(F.col("worst"), 3).alias("worst"))


@query("""WITH o AS (SELECT vec_id // 10 AS scene, vec_id AS object, list_transform(embedding[1:4], lambda x: abs(x::DOUBLE)) AS r, list_transform(embedding[5:8], lambda x: x::DOUBLE * x::DOUBLE * 1e-6) AS p, 0.5 + (vec_id % 3) / 4.0 AS imp FROM embeddings),
    b AS (SELECT scene, object, r, imp, i, p[i] AS own FROM o, (SELECT unnest(range(1, 5)) AS i)),
    m AS (SELECT a.scene, a.object, a.i, a.imp, a.own, coalesce(sum(b.own * greatest(0, least(1, list_dot_product(a.r, b.r) / sqrt(list_dot_product(a.r, a.r)) / sqrt(list_dot_product(b.r, b.r))))), 0) AS masker FROM b a LEFT JOIN b ON a.scene = b.scene AND a.i = b.i AND a.object <> b.object GROUP BY ALL)
    SELECT object, round(sum(pow(masker * 3.1622776601683795e10 + own * 3.1622776601683795e10 + 4.72, 0.2) - pow(masker * 3.1622776601683795e10 + 4.72, 0.2)) * imp, 5) AS energy FROM m GROUP BY object, imp""")
def perceptual_weights(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    o = e.select(F.floor(F.col("vec_id") / 10).alias("scene"), F.col("vec_id").alias("object"), F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double"))).alias("radiated"),
        F.transform(F.slice("embedding", 5, 4), lambda x: x.cast("double") * x.cast("double") * 1e-6).alias("powers"), (0.5 + (F.col("vec_id") % 3) / 4).alias("importance"))
    return S.perceptual_weights(o, ["scene"]).select("object", _r(F.col("energy")).alias("energy"))
