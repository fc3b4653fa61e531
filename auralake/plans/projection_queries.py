"""Queries on master sets as ADM, and the SQL that says the same. A programme's users are its objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auralake.functions import speakers as P
from auralake.operators import projection as J
from auralake.operators import report as R
from auralake.plans.queries import E, _events, _r, _table, query

END = 4102444800000000
ZONES = list(P.ZONES)

_U = f"""u AS (SELECT programme, user_id, event_id, us, CASE WHEN event_type = 'view' THEN value / 10 - 40 END AS gain, CASE WHEN event_type = 'error' THEN false WHEN event_type = 'click' THEN true END AS active,
        CASE WHEN event_id % 3 = 0 THEN [value / 100, 1 - value / 100, value / 200] END AS pos, CASE WHEN event_id % 5 = 0 THEN value / 150 END AS size, CASE WHEN event_id % 7 = 0 THEN event_id % 2000 END AS ramp,
        CASE WHEN event_id % 4 = 0 THEN (event_id % 11) / 10.0 END AS importance, CASE WHEN event_id % 6 = 0 THEN event_id % 12 = 0 END AS snap, CASE WHEN event_id % 9 = 0 THEN event_id % 6 END AS zones, CASE WHEN event_id % 8 = 0 THEN (event_id % 9) / 8.0 END AS screen FROM {E})"""
_B = f"""{_U}, f AS (SELECT *, last_value(gain IGNORE NULLS) OVER w AS g, coalesce(last_value(active IGNORE NULLS) OVER w, true) AS a, last_value(pos IGNORE NULLS) OVER w AS position, last_value(size IGNORE NULLS) OVER w AS width,
        coalesce(last_value(ramp IGNORE NULLS) OVER w, 0) AS ramped, last_value(importance IGNORE NULLS) OVER w AS imp, coalesce(last_value(snap IGNORE NULLS) OVER w, false) AS snapped, coalesce(last_value(zones IGNORE NULLS) OVER w, 0) AS zone,
        coalesce(last_value(screen IGNORE NULLS) OVER w, 0) AS factor, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS ix
        FROM u WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT user_id, ix, us AS start, greatest(us, coalesce(nxt, {END})) AS until, position, CASE WHEN NOT a THEN 0 ELSE pow(10, g / 20) END AS gain, width, ramped AS ramp, CAST(round(imp * 10) AS INT) AS importance, snapped AS snap, zone, factor FROM f)"""


def _updates(spark, sf_dir):
    t, i, v = F.col("event_type"), F.col("event_id"), F.col("value")
    return _events(spark, sf_dir).select(
        "user_id", i, F.col("us").alias("at"), F.when(t == "view", v / 10 - 40).alias("gain"), F.when(t == "error", False).when(t == "click", True).alias("active"),
        F.when(i % 3 == 0, F.array(v / 100, 1 - v / 100, v / 200)).alias("pos"), F.when(i % 5 == 0, v / 150).alias("size"), F.when(i % 7 == 0, i % 2000).alias("rampLength"),
        F.when(i % 4 == 0, (i % 11) / 10).alias("importance"), F.when(i % 6 == 0, i % 12 == 0).alias("snap"), F.when(i % 9 == 0, F.array(*[F.lit(z) for z in ZONES])[(i % 6).cast("int")]).alias("zones"), F.when(i % 8 == 0, (i % 9) / 8).alias("screenFactor"),
    )


def _blocks(spark, sf_dir):
    return J.absolute_blocks(_updates(spark, sf_dir), ["user_id"], ["at", "event_id"], F.lit(END))


@query(f"WITH {_B} SELECT user_id, CAST(ix AS INT) AS ix, start, until, round(position[1], 6) AS x, round(position[3], 6) AS z, round(gain, 8) AS gain, round(width, 6) AS width, ramp, importance, snap, zone, factor FROM b")
def absolute_blocks(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.select("user_id", "ix", "start", "until", _r(F.col("position")[0], 6).alias("x"), _r(F.col("position")[2], 6).alias("z"), _r(F.col("gain"), 8).alias("gain"), _r(F.col("width"), 6).alias("width"), "ramp", "importance", "snap", P.zone_code(F.col("zones")).alias("zone"), F.col("screen_factor").alias("factor"))


@query(f"""WITH {_B} SELECT user_id, start AS since, round(position[1], 6) AS x, round(coalesce(gain, 1), 8) AS gain, ramp, round(least(1, greatest(0, coalesce(width, 0))), 6) AS spread, coalesce(importance, 10) / 10.0 AS importance, zone,
    CASE WHEN factor > 0 THEN CAST(greatest(0, least(7, round(factor * 8) - 1)) AS INT) END AS screen FROM b WHERE position IS NOT NULL""")
def keyframes(spark, sf_dir):
    k = J.keyframes(_blocks(spark, sf_dir), ["user_id"])
    return k.select("user_id", F.col("at").alias("since"), _r(F.col("position")[0], 6).alias("x"), _r(F.col("gain"), 8).alias("gain"), "ramp", _r(F.col("spread"), 6).alias("spread"), "importance", F.col("mode.zones").alias("zone"), F.col("mode.screen.screen").alias("screen"))


@query(f"""WITH {_B} SELECT user_id, start AS since, round(position[2], 6) AS y, CASE WHEN gain <= 0 THEN -9999 ELSE round(20 * log10(gain), 6) END AS db, importance / 10.0 AS importance, round(width, 6) AS size, ramp FROM b""")
def block_events(spark, sf_dir):
    e = J.block_events(_blocks(spark, sf_dir).withColumn("cartesian", F.lit(True)), ["user_id"])
    db = F.when(F.col("gain") == float("-inf"), -9999.0).otherwise(_r(F.col("gain"), 6))
    return e.select("user_id", F.col("at").alias("since"), _r(F.col("pos")[1], 6).alias("y"), db.alias("db"), "importance", _r(F.col("size"), 6).alias("size"), F.col("rampLength").alias("ramp"))


_SPEAKERS = ", ".join(f"('{a}', '{b}', {c}, {d}, {e})" for a, b, c, d, e in P.SPEAKERS)
_ALIASES = ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in P.ALIASES)
LABELS = [s[1] for s in P.SPEAKERS] + [a[0] for a in P.ALIASES] + ["T+000", "L"]
_LABELS = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


@query(f"""WITH s(master, label, id, azimuth, elevation) AS (VALUES {_SPEAKERS}), al(label, master, azimuth, elevation) AS (VALUES {_ALIASES}), p AS (SELECT p_partkey, {_LABELS}[p_partkey % {len(LABELS)} + 1] AS label FROM part)
    SELECT p_partkey, p.label, coalesce(s.master, al.master) AS master, (SELECT id FROM s s2 WHERE s2.master = coalesce(s.master, al.master)) AS id, CAST(coalesce(s.azimuth, al.azimuth) AS DOUBLE) AS azimuth, CAST(coalesce(s.elevation, al.elevation) AS DOUBLE) AS elevation,
    starts_with(coalesce(s.master, al.master, p.label), 'LFE') AS lfe, CASE WHEN p.label LIKE 'LFE%' THEN 0 WHEN p.label IN ('M+090', 'M-090', 'M+110', 'M-110', 'M+135', 'M-135') THEN 1.41 ELSE 1 END::DOUBLE AS weight
    FROM p LEFT JOIN s ON p.label = s.label LEFT JOIN al ON p.label = al.label""")
def speaker_lookups(spark, sf_dir):
    from auralake.operators.measures import channel_weight

    p = _table(spark, sf_dir, "part").select("p_partkey", F.array(*[F.lit(x) for x in LABELS])[(F.col("p_partkey") % len(LABELS)).cast("int")].alias("label"))
    c = F.col("label")
    return p.select("p_partkey", "label", P.master_of_label(c).alias("master"), P.id_of_master(P.master_of_label(c)).alias("id"), P.azimuth_of_label(c).alias("azimuth"), P.elevation_of_label(c).alias("elevation"), P.is_lfe(c).alias("lfe"), channel_weight(c).alias("weight"))


@query(f"""WITH v AS (SELECT event_id, value / 100 AS v FROM events) SELECT event_id, CASE WHEN v > 0 THEN CAST(greatest(0, least(7, round(v * 8) - 1)) AS INT) END AS screen, CASE WHEN v > 0 THEN CAST(greatest(0, least(3, round(v / 0.25) - 1)) AS INT) END AS depth,
    round(pow(10, v / 20), 8) AS linear, CASE WHEN v <= 0 THEN -9999 ELSE round(20 * log10(v), 6) END AS db, CAST(round(greatest(-1, least(1, v - 2)) * 127) AS INT) AS cart8, CAST(round(greatest(-1, least(1, v - 2)) * 32767) AS INT) AS cart16,
    CAST(greatest(-8388608, least(8388592, round(round((v - 2) * 8388608) / 16) * 16)) AS BIGINT) AS code, (round((v - 2) * 8388608) < -8388608 OR round((v - 2) * 8388608) > 8388607) AS clipped FROM v""")
def hint_codes(spark, sf_dir):
    v = F.col("value") / 100
    s, p, q = P.screen_codes(v, v), P.position_codes(v - 2, v - 2, v - 2, 127), P.quantised(v - 2, 8388608.0, 16.0)
    db = P.linear_to_decibels(v)
    return _table(spark, sf_dir, "events").select("event_id", s["screen"].alias("screen"), s["depth"].alias("depth"), _r(P.decibels_to_linear(v), 8).alias("linear"), F.when(db == float("-inf"), -9999.0).otherwise(_r(db, 6)).alias("db"),
        p[0].alias("cart8"), P.position_codes(v - 2, v, v, 32767)[0].alias("cart16"), q["code"].alias("code"), q["clipped"].alias("clipped"))


@query("""SELECT programme, CAST(count(*) AS BIGINT) AS samples, round(max(abs(round((value / 100 - 2) * 32768)) / 32768), 8) AS peak, count(*) FILTER (WHERE round((value / 100 - 2) * 32768) NOT BETWEEN -32768 AND 32767) AS clipped FROM (SELECT user_id % 16 AS programme, value FROM events) GROUP BY 1""")
def quantiser_levels(spark, sf_dir):
    q = _events(spark, sf_dir).select("programme", P.quantised(F.col("value") / 100 - 2, 32768.0, 1.0).alias("q"))
    return q.groupBy("programme").agg(F.count("*").alias("samples"), _r(F.max("q.level"), 8).alias("peak"), F.count_if("q.clipped").alias("clipped"))


def _set(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("set"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3 == 0).alias("bed"), (F.col("s_suppkey") % len(LABELS)).cast("int").alias("n"))
    w = Window.partitionBy("set", "bed").orderBy("id")
    s = s.withColumn("ix", F.row_number().over(w))
    names = F.array(*[F.lit(m) for m, *_ in P.SPEAKERS], *[F.lit("X")] * (len(LABELS) - len(P.SPEAKERS)))
    return s.where("bed").select("set", "ix", "id", names[F.col("n")].alias("channel")), s.where("not bed").select("set", "ix", "id")


_NAMES = "[" + ", ".join([f"'{m}'" for m, *_ in P.SPEAKERS] + ["'X'"] * (len(LABELS) - len(P.SPEAKERS))) + "]"
_EL = f"""e AS (SELECT s_nationkey AS set_, s_suppkey AS id, s_suppkey % 3 = 0 AS bed, CASE WHEN s_suppkey % 3 = 0 THEN {_NAMES}[s_suppkey % {len(LABELS)} + 1] ELSE printf('Object %d', s_suppkey) END AS name FROM supplier),
    t AS (SELECT *, row_number() OVER (PARTITION BY set_ ORDER BY NOT bed, id) AS track FROM e)"""


@query(f"""WITH {_EL} SELECT set_ AS scene, id, bed, name, CAST(track AS INT) AS track, printf('AC_%s%04X', CASE WHEN bed THEN '0001' ELSE '0003' END, CAST(4096 + track AS BIGINT)) AS channel_format, printf('AT_%s%04X_01', CASE WHEN bed THEN '0001' ELSE '0003' END, CAST(4096 + track AS BIGINT)) AS track_format,
    printf('ATU_%08X', CAST(track AS BIGINT)) AS track_uid, printf('AO_%04X', CAST(4096 + track AS BIGINT)) AS object FROM t""")
def element_list(spark, sf_dir):
    e = J.elements(*_set(spark, sf_dir))
    ids = J.element_ids(F.col("bed"), F.col("track"))
    return e.select(F.col("set").alias("scene"), "id", "bed", "name", "track", *[ids[c].alias(c) for c in ("channel_format", "track_format", "track_uid", "object")])


def _adm(spark, sf_dir):
    beds, objects = _set(spark, sf_dir)
    n = beds.select("set").unionByName(objects.select("set")).groupBy("set").agg(F.count("*").alias("n"))
    audio = n.select("set", (F.col("n") + F.when(F.col("set") % 5 == 0, 1).otherwise(0)).alias("channels"), F.lit(END).alias("frames"), F.lit(48000).alias("rate"))
    u = _updates(spark, sf_dir).join(objects.select("set", F.col("id").alias("user_id")), "user_id").withColumnRenamed("user_id", "id")
    return J.to_adm(beds, objects, u, audio, ["at", "event_id"])


@query(f"""WITH {_EL}, {_B}, ok AS (SELECT * FROM t WHERE set_ % 5 <> 0) SELECT set_ AS scene, CAST(track AS INT) AS track, CAST(coalesce(ix, 1) AS INT) AS ix, coalesce(start, 0) AS start, coalesce(until, {END}) AS until, CASE WHEN ix IS NULL THEN 0 ELSE round(gain, 8) END AS gain, round(position[1], 6) AS x
    FROM ok LEFT JOIN b ON b.user_id = ok.id WHERE NOT bed""")
def master_to_adm(spark, sf_dir):
    b = _adm(spark, sf_dir)["object_blocks"]
    return b.select(F.col("set").alias("scene"), "track", "ix", "start", "until", _r(F.col("gain"), 8).alias("gain"), _r(F.col("position")[0], 6).alias("x"))


@query(f"""WITH {_EL}, s(master, label, id, azimuth, elevation) AS (VALUES {_SPEAKERS}) SELECT set_ AS scene, CAST(track AS INT) AS track, coalesce(s.label, name) AS label, CAST(azimuth AS DOUBLE) AS azimuth, CAST(elevation AS DOUBLE) AS elevation, CAST({END} AS BIGINT) AS until
    FROM t LEFT JOIN s ON s.master = name WHERE bed AND set_ % 5 <> 0""")
def bed_blocks(spark, sf_dir):
    return _adm(spark, sf_dir)["bed_blocks"].select(F.col("set").alias("scene"), "track", "label", "azimuth", "elevation", "until")


@query(f"""WITH {_EL}, n AS (SELECT set_, count(*) AS n FROM t GROUP BY 1) SELECT set_ AS scene, printf('%d elements declared, %d channels of audio', n, n + 1) AS error FROM n WHERE set_ % 5 = 0""")
def refused_sets(spark, sf_dir):
    return _adm(spark, sf_dir)["errors"].withColumnRenamed("set", "scene")


@query(f"""WITH {_EL}, {_B}, s(master, label, id, azimuth, elevation) AS (VALUES {_SPEAKERS}), ok AS (SELECT * FROM t WHERE set_ % 5 <> 0), ob AS (SELECT *, 9 + row_number() OVER (PARTITION BY set_ ORDER BY track) AS new_id FROM ok WHERE NOT bed),
    bd AS (SELECT *, row_number() OVER (PARTITION BY set_ ORDER BY track) - 1 AS n FROM ok WHERE bed),
    ev AS (SELECT set_, new_id AS id, coalesce(start, 0) AS at_, CASE WHEN ix IS NULL OR gain <= 0 THEN -9999 ELSE round(20 * log10(gain), 6) END AS db FROM ob LEFT JOIN b ON b.user_id = ob.id
        UNION ALL SELECT set_, coalesce(s.id, n), 0, 0 FROM bd LEFT JOIN s ON s.master = name)
    SELECT set_ AS scene, id, at_ AS since, count(*) AS events, min(db) AS db FROM ev GROUP BY 1, 2, 3""")
def adm_to_master(spark, sf_dir):
    made = _adm(spark, sf_dir)
    tracks = made["elements"].join(made["bed_blocks"].select("set", "track", "label"), ["set", "track"], "left")
    tracks = tracks.select("set", "track", F.when(F.col("bed"), "DirectSpeakers").otherwise("Objects").alias("kind"), "label", F.lit(1).alias("entries"))
    e = J.to_master(tracks, made["object_blocks"].withColumn("cartesian", F.lit(True)))["events"]
    db = F.when(F.col("gain") == float("-inf"), -9999.0).otherwise(_r(F.col("gain"), 6))
    return e.select(F.col("set").alias("scene"), "id", F.col("at").alias("since"), db.alias("db")).groupBy("scene", "id", "since").agg(F.count("*").alias("events"), F.min("db").alias("db"))


@query(f"""WITH p AS (SELECT l_orderkey AS scene, l_linenumber AS track, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2), t AS (SELECT scene, track, k % 4 <> 0 AS obj, {_LABELS}[k % {len(LABELS)} + 1] AS label FROM p),
    s(master, label, id, azimuth, elevation) AS (VALUES {_SPEAKERS}), al(label, master, azimuth, elevation) AS (VALUES {_ALIASES}),
    q AS (SELECT scene, track, CASE WHEN obj THEN 'object' WHEN starts_with(coalesce(s.master, al.master, t.label), 'LFE') THEN 'lfe' ELSE 'bed' END AS kind, coalesce(s.master, al.master, CASE WHEN t.label = 'L' THEN 'L' END) AS name FROM t LEFT JOIN s USING (label) LEFT JOIN al USING (label))
    SELECT scene, track, kind, CASE WHEN kind <> 'object' THEN name END AS name, CAST(row_number() OVER (PARTITION BY scene ORDER BY kind <> 'lfe', track) - 1 AS INT) AS place,
    CASE WHEN kind = 'lfe' AND row_number() OVER (PARTITION BY scene, kind ORDER BY track) > 1 THEN 'a second low frequency channel' WHEN kind = 'bed' AND name IS NULL THEN 'a bed channel without a place' END AS error FROM q""")
def part_classification(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("set"), F.col("l_linenumber").alias("track")).agg(F.min("l_suppkey").alias("k"))
    t = t.select("set", "track", F.when(F.col("k") % 4 != 0, "Objects").otherwise("DirectSpeakers").alias("kind"), F.array(*[F.lit(x) for x in LABELS])[(F.col("k") % len(LABELS)).cast("int")].alias("label"))
    return J.parts(t).withColumnRenamed("set", "scene")


@query("""SELECT c_nationkey, CASE min(CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 0 THEN 0 WHEN c_acctbal > 0 THEN 1 ELSE 2 END) WHEN 0 THEN 'complete' WHEN 1 THEN 'metadata_only' ELSE 'unusable' END AS class FROM customer GROUP BY 1""")
def usefulness(spark, sf_dir):
    return R.usefulness(_table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_acctbal") > 0, F.col("c_custkey") % 3 == 0)
