"""Queries on positions, codes and the course of a scene, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auralake.functions import codes as C
from auralake.functions import geometry as G
from auralake.functions import levels as L
from auralake.operators import clustering as K
from auralake.operators import lossless as X
from auralake.operators import scene as S
from auralake.operators import speech as P
from auralake.plans.queries import E, _events, _r, _table, query

SPEAKERS = {"L": (-1.0, 1.0, 0.0), "R": (1.0, 1.0, 0.0), "C": (0.0, 1.0, 0.0), "Ls": (-1.0, -1.0, 0.0), "Rs": (1.0, -1.0, 0.0), "Ltm": (-1.0, 0.0, 1.0), "Rtm": (1.0, 0.0, 1.0)}
ROWS = [(1.0, 1.0, {"L": -1.0, "C": 0.0, "R": 1.0}), (0.0, 2.0, {"Lss": -1.0, "Rss": 1.0}), (-1.0, 2.0, {"Lrs": -1.0, "Rrs": 1.0})]
# Level of a folded object by its height.
ELEVATION_SCALE = [(0.0, 0.9487), (0.2, 0.9470), (0.27, 0.9445), (0.33, 0.9295), (0.4, 0.8926), (0.47, 0.8849), (0.53, 0.8610), (0.6, 0.8514), (0.67, 0.8431), (0.73, 0.8419), (1.0, 0.8418)]

XYZ = "(SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 4 AS x, CAST(embedding[2] AS DOUBLE) * 4 AS y, CAST(embedding[3] AS DOUBLE) * 4 AS z FROM embeddings)"


def _xyz(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.element_at("embedding", i).cast("double") * 4).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])


SECTORS = """(VALUES (110, 30, 135, 45, -1, -1, -1, 1), (30, 0, 45, 0, -1, 1, 0, 1), (0, -30, 0, -45, 0, 1, 1, 1), (-30, -110, -45, -135, 1, 1, 1, -1),
    (-110, -250, -135, -225, 1, -1, -1, -1)) AS s(l, r, cl, cr, lx, ly, rx, ry)"""


@query(f"""WITH p AS (SELECT vec_id, x * 250 AS az, greatest(-90, least(90, y * 100)) AS el, abs(z) AS d FROM {XYZ}), u AS (SELECT *, 110 - ((((110 - az) % 360) + 360) % 360) AS a FROM p),
    j AS (SELECT *, 0.5 + 0.5 * tan(radians(a - (l + r) / 2.0)) / tan(radians((r - l) / 2.0)) AS g, CASE WHEN abs(el) > 30 THEN d * tan(radians(90 - (45 + 45 * (abs(el) - 30) / 60.0))) ELSE d END AS h FROM u JOIN {SECTORS} ON a <= l AND a > r),
    k AS (SELECT *, atan2(g, 1 - g) * 2 / pi() AS t FROM j)
    SELECT vec_id, round(h * (lx + (rx - lx) * t), 5) AS x, round(h * (ly + (ry - ly) * t), 5) AS y, round(CASE WHEN abs(el) > 30 THEN d * sign(el) ELSE d * tan(radians(el * 1.5)) END, 5) AS z FROM k""")
def polar_to_cube(spark, sf_dir):
    p = _xyz(spark, sf_dir)
    c = G.polar_to_cube(F.col("x") * 250, F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("y") * 100)), F.abs("z"))
    return p.select("vec_id", c.alias("c")).select("vec_id", *[_r(F.col(f"c.{a}")).alias(a) for a in "xyz"])


@query(f"""WITH u AS (SELECT *, 135 - ((((135 - degrees(atan2(-x, y))) % 360) + 360) % 360) AS a FROM {XYZ}),
    j AS (SELECT *, (x * ry - y * rx) / (lx * ry - ly * rx) AS gl, (y * lx - x * ly) / (lx * ry - ly * rx) AS gr FROM u JOIN {SECTORS} ON a <= cl AND a > cr),
    k AS (SELECT *, gr / (gl + gr) * pi() / 2 AS t, degrees(atan(z / (gl + gr))) AS e FROM j),
    m AS (SELECT *, (l + r) / 2.0 + degrees(atan(2 * (sin(t) / (cos(t) + sin(t)) - 0.5) * tan(radians((r - l) / 2.0)))) AS az FROM k)
    SELECT vec_id, round(CASE WHEN az < -180 THEN az + 360 ELSE az END, 5) AS azimuth, round(CASE WHEN abs(e) > 45 THEN sign(e) * (30 + 60 * (abs(e) - 45) / 45.0) ELSE e / 1.5 END, 5) AS elevation,
    round(CASE WHEN abs(e) > 45 THEN abs(z) ELSE gl + gr END, 5) AS distance FROM m""")
def cube_to_polar(spark, sf_dir):
    p = _xyz(spark, sf_dir)
    return p.select("vec_id", G.cube_to_polar(F.col("x"), F.col("y"), F.col("z")).alias("p")).select("vec_id", *[_r(F.col(f"p.{a}")).alias(a) for a in ("azimuth", "elevation", "distance")])


_H, _D = "(CASE WHEN z <= 0 THEN 0 WHEN z >= 1 THEN 1 ELSE z END)", "((greatest(-1, least(1, y)) + 1) / 2)"


@query(f"""WITH p AS (SELECT vec_id, z, y, {_H} * pi() / 2 AS h, {_D} * pi() / 2 AS d, (greatest(-1, least(1, x)) + 1) / 2 * pi() / 2 AS w, greatest(-1, least(1, x)) AS x FROM {XYZ})
    SELECT vec_id, round(cos(h) * sin(d) * CASE WHEN x < 0 THEN cos((x + 1) * pi() / 2) ELSE 0 END, 5) + 0 AS g_l, round(cos(h) * sin(d) * CASE WHEN x > 0 THEN sin(x * pi() / 2) ELSE 0 END, 5) + 0 AS g_r,
    round(cos(h) * sin(d) * cos(x * pi() / 2), 5) + 0 AS g_c, round(cos(h) * cos(d) * cos(w), 5) + 0 AS g_ls, round(cos(h) * cos(d) * sin(w), 5) + 0 AS g_rs, round(sin(h) * cos(w), 5) + 0 AS g_ltm, round(sin(h) * sin(w), 5) + 0 AS g_rtm FROM p""")
def room_gains(spark, sf_dir):
    g = G.room_gains(F.col("x"), F.col("y"), F.col("z"), SPEAKERS)
    return _xyz(spark, sf_dir).select("vec_id", *[(_r(c) + 0.0).alias("g_" + s.lower()) for s, c in g.items()])


def _scale_sql(z: str) -> str:
    parts = [f"WHEN {z} <= {b[0]} THEN {a[1]} + ({b[1]} - {a[1]}) * ({z} - {a[0]}) / ({b[0]} - {a[0]})" for a, b in zip(ELEVATION_SCALE, ELEVATION_SCALE[1:])]
    return f"(CASE {' '.join(parts)} END)"


@query(f"""WITH p AS (SELECT *, {_scale_sql("greatest(0, least(1, z))")} AS scale FROM {XYZ}), s(row, depth, spacing, speaker, place) AS (VALUES (0, 1, 1, 'L', -1), (0, 1, 1, 'C', 0), (0, 1, 1, 'R', 1), (1, 0, 2, 'Lss', -1), (1, 0, 2, 'Rss', 1), (2, -1, 2, 'Lrs', -1), (2, -1, 2, 'Rrs', 1)),
    f AS (SELECT *, cos(least(1, abs(y - depth)) * pi() / 2) AS deep, cos(least(1, abs((x - place) / spacing)) * pi() / 2) AS wide FROM p CROSS JOIN s),
    r AS (SELECT *, sqrt(sum(wide * wide) OVER (PARTITION BY vec_id, row)) AS wn FROM f), d AS (SELECT vec_id, sqrt(sum(deep * deep)) AS dn FROM (SELECT DISTINCT vec_id, row, deep FROM f) GROUP BY 1),
    g AS (SELECT vec_id, speaker, scale, CASE WHEN dn > 0 THEN deep / dn ELSE deep END * CASE WHEN wn > 0 THEN wide / wn ELSE wide END AS g FROM r JOIN d USING (vec_id)),
    t AS (SELECT *, sqrt(sum(g * g) OVER (PARTITION BY vec_id)) AS n FROM g)
    SELECT vec_id, speaker, round(CASE WHEN n > 0 THEN g * scale / n ELSE g * scale END, 5) + 0 AS gain FROM t""")
def fold_render(spark, sf_dir):
    scale = L.interpolate(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("z"))), ELEVATION_SCALE)
    g = G.fold_gains(_xyz(spark, sf_dir), "x", "y", ROWS, scale)
    return g.select("vec_id", F.explode("gains").alias("speaker", "gain")).select("vec_id", "speaker", (_r(F.col("gain")) + 0.0).alias("gain"))


def _word_sql(gain: str) -> str:
    e = f"floor(log2({gain}))"
    m = f"round({gain} / pow(2, {e} + 1) * 64)"
    return f"""(CASE WHEN {gain} <= 0 THEN 128 ELSE CASE WHEN {m} >= 64 THEN (CAST({e} AS INT) + 1 + 8) % 8 * 32 ELSE (CAST({e} AS INT) + 8) % 8 * 32 + CAST({m} AS INT) - 32 END END)"""


@query(f"""WITH g AS (SELECT event_id, greatest(0.07, least(7.9, value / 100)) AS g FROM events), w AS (SELECT *, CAST({_word_sql("g")} AS INT) AS word FROM g)
    SELECT event_id, word, round(pow(2, CASE WHEN word // 32 >= 4 THEN word // 32 - 8 ELSE word // 32 END + 1) * (word % 32 + 32) / 64, 6) AS gain FROM w""")
def gain_word_codec(spark, sf_dir):
    g = F.greatest(F.lit(0.07), F.least(F.lit(7.9), F.col("value") / 100))
    w = _table(spark, sf_dir, "events").select("event_id", C.gain_word(g, 3, 5).alias("word"))
    return w.select("event_id", "word", _r(C.gain_of_word(F.col("word"), 3, 5), 6).alias("gain"))


@query("""WITH v AS (SELECT event_id, value, CAST(event_id AS BIGINT) * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS n FROM events), z AS (SELECT *, CASE WHEN n < 0 THEN -2 * n - 1 ELSE 2 * n END AS u FROM v)
    SELECT event_id, u AS zigzag, CASE WHEN u < 128 THEN printf('%02x', u) WHEN u < 16384 THEN printf('%02x%02x', u % 128 + 128, u // 128) WHEN u < 2097152 THEN printf('%02x%02x%02x', u % 128 + 128, u // 128 % 128 + 128, u // 16384)
        ELSE printf('%02x%02x%02x%02x', u % 128 + 128, u // 128 % 128 + 128, u // 16384 % 128 + 128, u // 2097152) END AS leb128,
    CAST(greatest(0, least(255, round((value / 2 - 116 + 116) * 2))) AS INT) AS peak_code, CASE WHEN value <= 0 OR round(20 * log10(value / 100)) < -49 THEN NULL ELSE CAST(least(15, round(20 * log10(value / 100))) AS INT) END AS gain_code,
    CASE WHEN value > 60 THEN round(-least((value - 60) * 0.5, 20), 6) WHEN value < 40 THEN round(least((40 - value) * 0.7, 12), 6) ELSE 0 END AS compression,
    printf('%d:%02d:%02d.%d', CAST(round(value * 10) AS BIGINT) // 36000, CAST(round(value * 10) AS BIGINT) // 600 % 60, CAST(round(value * 10) AS BIGINT) // 10 % 60, CAST(round(value * 10) AS BIGINT) % 10) AS clock FROM z""")
def stream_codes(spark, sf_dir):
    v = F.col("value")
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id").cast("long") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    z = e.select("event_id", "value", C.zigzag(n).alias("zigzag"))
    return z.select("event_id", "zigzag", C.leb128(F.col("zigzag")).alias("leb128"), C.half_db_code(v / 2 - 116, -116.0).alias("peak_code"), C.whole_db_code(v / 100).alias("gain_code"),
        _r(C.compression_db(v, 60.0, 0.5, 40.0, 0.7, 20.0, 12.0), 6).alias("compression"), C.clock(v).alias("clock"))


_T = "xor(c >> 8, b)"
_CRC = f"xor({_T}, {_T} >> 4)"


@query(f"""SELECT c_custkey, CAST(list_reduce(list_prepend(65535, list_transform(string_split(c_name, ''), lambda ch: ord(ch))),
    lambda c, b: xor(xor((c << 8) & 65535, ({_CRC} << 12) & 65535), xor(({_CRC} << 5) & 65535, {_CRC}))) AS INT) AS crc FROM customer""")
def checksums(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", C.crc16(F.col("c_name").cast("binary")).alias("crc"))


@query("""SELECT event_id, CAST(value * 1000 AS BIGINT) // 3600000 * 3600 * 48000 + CAST(value * 1000 AS BIGINT) % 3600000 * 48 AS at_decimal,
    CAST(event_id % 60 AS BIGINT) * 48000 + (CAST(event_id AS BIGINT) % 44100 * 48000 * 2 + 44100) // 88200 AS at_fraction FROM (SELECT event_id, floor(greatest(0, least(86399, value)) * 1000) / 1000 AS value FROM events)""")
def adm_times(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    ms = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(86399.0), F.col("value"))) * 1000)
    part = [F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000))]
    decimal = F.format_string("%02d:%02d:%02d.%03d", *part)
    fraction = F.format_string("00:00:%02d.%dS44100", F.pmod("event_id", F.lit(60)), F.pmod("event_id", F.lit(44100)))
    texts = e.select("event_id", decimal.alias("a"), fraction.alias("b"))
    return texts.select("event_id", C.time_to_samples(F.col("a"), 48000).alias("at_decimal"), C.time_to_samples(F.col("b"), 48000).alias("at_fraction"))


@query(f"""WITH f AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 1) AS said, coalesce(last_value(CASE WHEN event_type = 'error' THEN false WHEN event_type = 'click' THEN true END IGNORE NULLS) OVER w, true) AS on_,
        greatest(us, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), 4102444800000000)) AS until FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id, us AS start, until, CASE WHEN on_ THEN said ELSE 0 END AS gain FROM f""")
def event_blocks(spark, sf_dir):
    t = F.col("event_type")
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", F.when(t == "view", F.col("value")).alias("gain"), F.when(t == "error", False).when(t == "click", True).alias("active"))
    return S.object_blocks(e, ["user_id"], ["us", "event_id"], "us", "gain", "active", F.lit(4102444800000000))


_W = f"(SELECT CAST(floor(us / 3600000000) AS BIGINT) AS block, programme, event_type, sum(value) AS w FROM {E} GROUP BY ALL)"


@query(f"""SELECT coalesce(b.block, a.block + 1) AS block, coalesce(a.programme, b.programme) AS programme, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.w, 0) <> 0 AS turned_on
    FROM {_W} a FULL JOIN {_W} b ON a.block + 1 = b.block AND a.programme = b.programme AND a.event_type = b.event_type WHERE (coalesce(a.w, 0) = 0) <> (coalesce(b.w, 0) = 0)""")
def weight_flips(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("block", F.floor(F.col("us") / 3_600_000_000))
    return S.weight_flips(e, "block", ["programme", "event_type"], "value").select("block", "programme", "event_type", (F.col("now") != 0).alias("turned_on"))


_U = f"(SELECT *, sqrt(x * x + y * y + z * z) AS n FROM {XYZ})"


@query(f"""WITH d AS (SELECT vec_id, label, x / n AS x, y / n AS y, z / n AS z FROM {_U}), s AS (SELECT *, coalesce(degrees(acos(greatest(-1, least(1, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w)))), 0) AS step,
        max(abs(z)) OVER (PARTITION BY label) AS loud FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    m AS (SELECT vec_id, label, count(*) OVER w AS n, sum(step) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS path, degrees(acos(greatest(-1, least(1, x * first_value(x) OVER w + y * first_value(y) OVER w + z * first_value(z) OVER w)))) AS net,
        degrees(abs(atan2(avg(x) OVER w, avg(y) OVER w))) AS az, max(abs(z) / loud) OVER w AS carried FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT vec_id, label, round(path, 4) AS path, round(net, 4) AS net, round(greatest(0, path - net), 4) AS wobble, round(CASE WHEN az <= 90 THEN 3.6 + 6.4 * az / 90 ELSE 10 - 4.5 * (az - 90) / 90 END, 4) AS blur, round(carried, 5) AS carried FROM m WHERE n = 5 AND carried > 1e-4""")
def motion_windows(spark, sf_dir):
    p = _xyz(spark, sf_dir).select("vec_id", "label", G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    p = p.withColumns({"e": F.abs(F.col("d")[2]), "loud": F.max(F.abs(F.col("d")[2])).over(Window.partitionBy("label"))})
    m = S.motion_windows(p, ["label"], "vec_id", "d", "e", "loud", 4)
    return m.select("vec_id", "label", *[_r(F.col(c), 4).alias(c) for c in ("path", "net", "wobble", "blur")], _r(F.col("carried")).alias("carried"))


_F = f"(SELECT programme, row_number() OVER (PARTITION BY programme ORDER BY us, event_id) - 1 AS i, value, event_type FROM {E})"


def _frames(spark, sf_dir):
    w = Window.partitionBy("programme").orderBy("us", "event_id")
    return _events(spark, sf_dir).select("programme", (F.row_number().over(w) - 1).cast("long").alias("i"), "value", "event_type")


@query(f"SELECT programme, i // 10 AS sub, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) >= 0.5 AS open FROM {_F} GROUP BY 1, 2 HAVING count(*) = 10")
def subblock_coverage(spark, sf_dir):
    return S.coverage(_frames(spark, sf_dir), ["programme"], "i", F.col("event_type") == "view", 10, 0.5)


@query(f"""WITH h AS (SELECT programme, i // 20 AS span, greatest(0, CAST(floor(value / 10) AS INT)) AS bin FROM {_F}), s AS (SELECT programme, span, list_sort(list(bin)) AS b FROM h GROUP BY 1, 2 HAVING count(*) = 20)
    SELECT programme, span, CAST(b[2] - 120 AS DOUBLE) AS floor, (span + 1) * 20 - 1 AS since, (span + 2) * 20 - 2 AS upto FROM s""")
def noise_floor(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("level", F.col("value") / 10 - 120)
    return S.noise_floor(f, ["programme"], "i", "level", 20)


@query("""WITH s AS (SELECT l_suppkey, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END) AS share, max(l_quantity) AS run FROM lineitem GROUP BY 1)
    SELECT l_suppkey, share, CASE WHEN share > 0.5 OR run > 49 THEN 'refuse' WHEN share > 0.25 OR run > 24.5 THEN 'remark' ELSE 'pass' END AS verdict FROM s""")
def guard_verdicts(spark, sf_dir):
    s = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_discount") > 0.05).cast("double")).alias("share"), F.max("l_quantity").alias("run"))
    return s.select("l_suppkey", "share", S.verdict(F.col("share"), F.col("run"), 0.5, 49).alias("verdict"))


@query(f"""WITH d AS (SELECT vec_id, label, x / n AS x, y / n AS y, z / n AS z FROM {_U}), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 4)
    SELECT d.vec_id, c.vec_id AS centre, round(d.x * c.x + d.y * c.y + d.z * c.z, 6) AS cosine FROM d JOIN c USING (label) QUALIFY row_number() OVER (PARTITION BY d.vec_id ORDER BY d.x * c.x + d.y * c.y + d.z * c.z DESC, c.vec_id DESC) = 1""")
def nearest_centre(spark, sf_dir):
    d = _xyz(spark, sf_dir).select("vec_id", "label", G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    c = d.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 4")
    c = c.select("label", F.col("vec_id").alias("centre"), F.col("d").alias("c"))
    return S.nearest(d, c, ["label"], "d", "c", "centre").select("vec_id", "centre", _r(F.col("cosine"), 6).alias("cosine"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND exact THEN 'exact' WHEN conv THEN 'by_convention' ELSE 'missing' END AS found FROM (SELECT c_custkey, c_mktsegment,
    EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus = 'F') AS exact, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey) AS conv FROM customer)""")
def component_resolution(spark, sf_dir):
    from auralake.sources.masters import resolve

    # A customer is a set that names the file F, in two segments only; orders are its files, by status; O is the usual name.
    files = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set"), F.col("o_orderstatus").alias("name"))
    usual = files.select("set", F.lit("any").alias("name"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set"), F.lit("an").alias("stem"), F.lit("y").alias("suffix"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "F").otherwise("?").alias("referenced"))
    return resolve(c, files.unionByName(usual)).select(F.col("set").alias("c_custkey"), F.col("match").alias("found"))


@query("SELECT p_partkey, printf('AC_%s%04X', CASE WHEN p_size % 2 = 0 THEN '0001' ELSE '0003' END, CAST(4096 + p_partkey % 4096 AS BIGINT)) AS channel_id FROM part")
def id_minting(spark, sf_dir):
    from auralake.operators.projection import element_ids

    return _table(spark, sf_dir, "part").select("p_partkey", element_ids(F.col("p_size") % 2 == 0, F.col("p_partkey") % 4096)["channel_format"].alias("channel_id"))


@query("""SELECT s_suppkey, round(10 * log10(sum(ps) / sum(pe)), 5) AS snr FROM (SELECT l_suppkey AS s_suppkey, l_extendedprice * l_extendedprice AS ps, (l_extendedprice * l_discount) * (l_extendedprice * l_discount) AS pe FROM lineitem)
    GROUP BY 1 HAVING sum(pe) > 0""")
def snr(spark, sf_dir):
    from auralake.operators.report import snr as ratio

    g = ratio(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount"))
    return g.where("snr < double('infinity')").select(F.col("l_suppkey").alias("s_suppkey"), _r(F.col("snr")).alias("snr"))


@query("""SELECT label, list_count(list(DISTINCT (gx, gz))) AS places, bool_and(gz = 7) AS level FROM (SELECT label, CAST(round((greatest(-1, least(1, CAST(embedding[1] AS DOUBLE))) + 1) / 2 * 6) AS INT) AS gx,
    CAST(round((greatest(-1, least(1, CAST(embedding[3] AS DOUBLE))) + 1) / 2 * 15) AS INT) AS gz FROM embeddings) GROUP BY label""")
def grid_places(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("label", *[L.grid_code(F.element_at("embedding", i).cast("double"), n).alias(c) for i, n, c in ((1, 6, "gx"), (3, 15, "gz"))])
    return e.groupBy("label").agg(F.count_distinct(F.struct("gx", "gz")).alias("places"), F.bool_and(F.col("gz") == 7).alias("level"))


@query(f"""WITH v AS (SELECT programme, i, i - row_number() OVER (PARTITION BY programme ORDER BY i) AS run, CASE WHEN i - lag(i) OVER (PARTITION BY programme ORDER BY i) <= 6 THEN 0 ELSE 1 END AS cut FROM {_F} WHERE event_type = 'view'),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY programme ORDER BY i) AS session FROM v), r AS (SELECT programme, session, run, min(i) AS a, max(i) AS b, count(*) AS n FROM s GROUP BY ALL)
    SELECT programme, min(CASE WHEN n >= 3 THEN a END) AS opened, max(b) + 5 AS closed FROM r GROUP BY programme, session HAVING min(CASE WHEN n >= 3 THEN a END) IS NOT NULL""")
def speech_gate(spark, sf_dir):
    return P.speech_gate(_frames(spark, sf_dir), ["programme"], "i", F.col("event_type") == "view", 3, 5)


@query(f"""WITH s AS (SELECT programme, i // 10 AS block, count(*) AS n, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS v, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) >= 0.5 AS o FROM {_F} GROUP BY 1, 2 HAVING count(*) = 10)
    SELECT a.programme, a.block FROM s a JOIN s b ON a.programme = b.programme AND b.block = a.block + 1 JOIN s c ON a.programme = c.programme AND c.block = a.block + 2 JOIN s d ON a.programme = d.programme AND d.block = a.block + 3
    WHERE a.o AND b.o AND c.o AND d.o AND a.v > 0 AND d.v > 0 AND a.v + b.v + c.v + d.v >= 10""")
def dialogue_blocks(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumns({"voiced": F.col("event_type") == "view", "opened": F.col("event_type") != "error"})
    return P.dialogue_blocks(f, ["programme"], "i", "voiced", "opened")


@query(f"""SELECT a.programme, a.i, round(sum(pow(20.0::DOUBLE / 21, a.i - b.i) * b.value / 21), 6) AS level FROM {_F} a JOIN {_F} b ON a.programme = b.programme AND b.i <= a.i GROUP BY 1, 2""")
def leaky_integrator(spark, sf_dir):
    # A share of 1 / 21 has no end as a decimal, so that no level is a tie.
    return P.follow(_frames(spark, sf_dir), "programme", "i", "value", 1 / 21).select("programme", "i", _r(F.col("y"), 6).alias("level"))


@query(f"""WITH RECURSIVE u AS (SELECT user_id, CAST(floor(us / 1000) AS BIGINT) AS at_, value::DOUBLE AS v, CAST(event_id % 7 * 3600000 AS BIGINT) AS ramp FROM {E}),
    l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id, at_ ORDER BY ramp DESC, v DESC) = 1),
    o AS (SELECT *, row_number() OVER w AS n, lead(at_) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY user_id ORDER BY at_)),
    f AS (SELECT user_id, n, at_, nxt, ramp, v AS state, v AS target FROM o WHERE n = 1
        UNION ALL SELECT o.user_id, o.n, o.at_, o.nxt, o.ramp, CASE WHEN f.nxt < f.at_ + f.ramp THEN f.state + (f.target - f.state) * (CAST(f.nxt - f.at_ AS DOUBLE) / f.ramp) ELSE f.target END, o.v FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT user_id, at_ AS start, CASE WHEN nxt < at_ + ramp THEN nxt ELSE at_ + ramp END AS stop, round(state, 6) AS value_from, round(CASE WHEN nxt < at_ + ramp THEN state + (target - state) * (CAST(nxt - at_ AS DOUBLE) / ramp) ELSE target END, 6) AS value_to FROM f WHERE ramp > 0
    UNION ALL SELECT user_id, at_ + ramp, nxt, round(target, 6), round(target, 6) FROM f WHERE nxt IS NULL OR nxt > at_ + ramp
    UNION ALL SELECT user_id, 0, at_, round(target, 6), round(target, 6) FROM f WHERE n = 1 AND at_ > 0""")
def path_segments(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.floor(F.col("us") / 1000).alias("at"), "value", (F.pmod("event_id", F.lit(7)) * 3_600_000).cast("long").alias("ramp"))
    s = P.path_segments(e, "user_id", "at", ["value"], "ramp").withColumnRenamed("end", "stop")
    return s.select("user_id", "start", "stop", _r(F.col("value_from"), 6).alias("value_from"), _r(F.col("value_to"), 6).alias("value_to"))


def lossless_frames(spark, sf_dir):
    """Frames of 256 quantities of each supplier: no SQL, tested by decoding."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    li = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("x"), (F.row_number().over(w) - 1).alias("i"))
    b = li.groupBy(F.col("l_suppkey").cast("string").alias("file"), F.floor(F.col("i") / 256).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return X.encode_blocks(b.select("file", "block", F.array(F.col("s.x")).alias("channels")), 16).select("file", "block", "n_bytes")


def _seed_steps(count: int) -> str:
    """One step for each seed: the member with the largest need that is none of those before."""
    out = ["c0 AS (SELECT block, vec_id, 0 AS place FROM d QUALIFY row_number() OVER (PARTITION BY block ORDER BY e DESC, vec_id DESC) = 1)"]
    for k in range(1, count):
        before = " JOIN ".join(f"(SELECT d.* FROM d JOIN c{i} USING (block, vec_id)) s{i} ON s{i}.block = d.block" for i in range(k))
        nearest = "greatest(" + ", ".join(f"d.x * s{i}.x + d.y * s{i}.y + d.z * s{i}.z" for i in range(k)) + ")"
        new = " AND ".join(f"d.vec_id <> s{i}.vec_id" for i in range(k))
        out.append(f"c{k} AS (SELECT block, vec_id, {k} AS place FROM (SELECT d.block, d.vec_id, d.e * (1 - {nearest}) AS need FROM d JOIN {before} WHERE {new}) WHERE need > 0 QUALIFY row_number() OVER (PARTITION BY block ORDER BY need DESC, vec_id DESC) = 1)")
    return ", ".join(out)


@query(f"""WITH d AS (SELECT CAST(label * 1000000 + vec_id // 64 AS BIGINT) AS block, vec_id, x / n AS x, y / n AS y, z / n AS z, abs(z) AS e FROM {_U}), {_seed_steps(4)}
    {" UNION ALL ".join(f"SELECT block, vec_id, place FROM c{k}" for k in range(4))}""")
def seed_blocks(spark, sf_dir):
    d = _xyz(spark, sf_dir).select((F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 64)).cast("long").alias("block"), "vec_id", G.unit(F.col("x"), F.col("y"), F.col("z")).alias("d"), F.abs("z").alias("e"))
    return K.seed_blocks(d, "block", "vec_id", "d", "e", 4)


#: Queries that SQL can't express.
UNSPOKEN = {f.__name__: f for f in (lossless_frames,)}
