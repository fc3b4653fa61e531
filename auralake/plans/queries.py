"""The engine's own queries over the adapters' tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.functions import levels as L
from auralake.operators import measures as M
from auralake.operators import metric as X
from auralake.operators import report as R
from auralake.operators import timelines as T

PROGRAMMES = 16
KNOTS = [(0.0, 1.0), (100.0, 0.8), (250.0, 0.5), (400.0, 0.1)]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "programme": F.pmod("user_id", F.lit(PROGRAMMES))})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 5):
    return F.round(c, n)


E = "(SELECT *, epoch_us(ts) AS us, user_id % 16 AS programme FROM events)"
BLOCKS = f"""s AS (
    SELECT programme, event_type AS channel, CAST(floor(us / 60000000) AS BIGINT) AS sub, value / 500 AS x FROM {E}
), m AS (SELECT programme, channel, sub, sum(x * x) / count(*) AS ms FROM s GROUP BY ALL
), e AS (
    SELECT programme, sub, sum(CASE channel WHEN 'error' THEN 0 WHEN 'view' THEN 1.41 ELSE 1 END * ms) AS e FROM m GROUP BY ALL
), g AS (SELECT programme, unnest(range(min(sub), max(sub) + 1)) AS sub FROM s GROUP BY programme
), b AS (SELECT g.programme, g.sub, coalesce(e.e, 0) AS e FROM g LEFT JOIN e USING (programme, sub))"""
SLIDING = """w{n} AS (SELECT * FROM (SELECT programme, sub, avg(e) OVER (PARTITION BY programme ORDER BY sub ROWS BETWEEN {p} PRECEDING AND CURRENT ROW) AS mean,
    row_number() OVER (PARTITION BY programme ORDER BY sub) AS rn FROM b) WHERE rn >= {n})"""
LOUD = "(CASE WHEN {0} <= 0 THEN -1e9 ELSE -0.691 + 10 * log10({0}) END)"
GATED = """a AS (SELECT * FROM w{n} WHERE """ + LOUD.format("mean") + """ > -70), t AS (SELECT programme, avg(mean) AS tm FROM a GROUP BY programme),
    k AS (SELECT a.* FROM a JOIN t USING (programme) WHERE """ + LOUD.format("mean") + " > " + LOUD.format("tm") + " + {gate})"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir).select("programme", F.col("event_type").alias("channel"), F.floor(F.col("us") / 60_000_000).alias("sub"), (F.col("value") / 500).alias("x"))
    weight = F.when(F.col("channel") == "error", 0.0).when(F.col("channel") == "view", 1.41).otherwise(1.0)
    return M.sub_blocks(s, ["programme"], weight)


@query(f"WITH {BLOCKS}, {SLIDING.format(n=4, p=3)}, {GATED.format(n=4, gate=-10)} SELECT p.programme, count(k.sub) AS blocks, coalesce(round({LOUD.format('avg(mean)')}, 5), '-inf'::DOUBLE) AS lufs FROM (SELECT DISTINCT programme FROM w4 UNION SELECT -1) p LEFT JOIN k USING (programme) GROUP BY 1")
def integrated_loudness(spark, sf_dir):
    b = M.sliding(_blocks(spark, sf_dir), ["programme"], 4)
    silent = b.limit(0).unionByName(spark.range(40).select(F.lit(-1).cast(dict(b.dtypes)["programme"]).alias("programme"), F.col("id").alias("sub"), F.lit(0.0).alias("e"), F.lit(0.0).alias("mean")))
    return M.integrated(b.unionByName(silent), ["programme"]).withColumn("lufs", _r(F.col("lufs")))


@query(f"""WITH {BLOCKS}, {SLIDING.format(n=4, p=3)}, {SLIDING.format(n=30, p=29)}
    SELECT w4.programme, w4.sub, round(w4.mean, 5) AS momentary, round(w30.mean, 5) AS short_term FROM w4 JOIN w30 USING (programme, sub)""")
def momentary_short_term(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    short = M.sliding(b, ["programme"], 30).select("programme", "sub", _r(F.col("mean")).alias("short_term"))
    return M.sliding(b, ["programme"], 4).select("programme", "sub", _r(F.col("mean")).alias("momentary")).join(short, ["programme", "sub"])


@query(f"""WITH {BLOCKS}, {SLIDING.format(n=30, p=29)}, {GATED.format(n=30, gate=-20)}, l AS (SELECT programme, list_sort(list({LOUD.format('mean')})) AS v FROM k GROUP BY programme)
    SELECT programme, round(v[CAST(round((len(v) - 1) * 0.95) AS INT) + 1] - v[CAST(round((len(v) - 1) * 0.1) AS INT) + 1], 5) AS lra FROM l""")
def loudness_range(spark, sf_dir):
    k = M.gated(M.sliding(_blocks(spark, sf_dir), ["programme"], 30), ["programme"], L.RANGE_GATE)
    return M.loudness_range(k, ["programme"]).withColumn("lra", _r(F.col("lra")))


@query(f"""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS gain
    FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill_state(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", F.when(F.col("event_type") == "view", F.col("value")).alias("gain"))
    return T.forward_fill(e, ["user_id"], ["us", "event_id"], ["gain"]).select("event_id", "user_id", "gain")


_STATES = "(SELECT user_id, us, max(value) AS state FROM {e} WHERE event_type = 'view' GROUP BY user_id, us)"


@query(f"""SELECT p.event_id, s.state FROM (SELECT * FROM {E} WHERE event_type <> 'view') p ASOF LEFT JOIN {_STATES.format(e=E)} s ON p.user_id = s.user_id AND p.us >= s.us""")
def asof_state(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", "event_type", "value")
    s = e.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("value").alias("state"))
    return T.asof_join(e.where("event_type <> 'view'"), s, ["user_id"], "us", ["state"]).select("event_id", "state")


@query(f"""WITH g AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS until FROM {_STATES.format(e=E)})
    SELECT p.event_id, g.state, g.us AS start, g.until FROM {E} p JOIN g ON p.user_id = g.user_id AND p.us >= g.us AND (g.until IS NULL OR p.us < g.until)""")
def segment_lookup(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = e.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("value").alias("state"))
    g = T.segments(s, ["user_id"], "us").withColumnRenamed("us", "start")
    return T.segment_lookup(e.select("event_id", "user_id", "us"), g, ["user_id"], "us", "start", "until").select("event_id", "state", "start", "until")


@query(f"""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS n FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) WHERE n = 1 OR was IS DISTINCT FROM event_type""")
def change_filter(spark, sf_dir):
    return T.changed(_events(spark, sf_dir).select("event_id", "user_id", "us", "event_type"), ["user_id"], ["us", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query(f"""WITH d AS (SELECT DISTINCT user_id, us FROM {E}), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 86400000000 THEN 0 ELSE 1 END AS st FROM d),
    i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
    SELECT user_id, CAST(island AS BIGINT) AS island, min(us) AS opened, max(us) AS closed, count(*) AS frames FROM i GROUP BY user_id, island""")
def speech_gate_sessions(spark, sf_dir):
    d = _events(spark, sf_dir).select("user_id", "us").distinct()
    return T.islands(d, ["user_id"], "us", 86_400_000_000).groupBy("user_id", "island").agg(F.min("us").alias("opened"), F.max("us").alias("closed"), F.count("*").alias("frames"))


@query("""SELECT l_suppkey, CAST(max(n) AS BIGINT) AS longest FROM (SELECT l_suppkey, g, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN over THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
    FROM (SELECT *, l_quantity > 20 AS over FROM lineitem WHERE l_returnflag <> 'N')) WHERE over GROUP BY l_suppkey, g) GROUP BY l_suppkey""")
def longest_masked_run(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    r = T.runs(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], F.col("l_quantity") > 20, F.col("l_returnflag") == "N")
    return r.groupBy("l_suppkey").agg(F.max("run_length").alias("longest"))


@query(f"""SELECT event_id, greatest(value, max(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    CASE WHEN lead(value, 1) OVER w >= 2 * value THEN lead(value, 1) OVER w END, CASE WHEN lead(value, 2) OVER w >= 2 * value THEN lead(value, 2) OVER w END) AS held
    FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def hold_smoothing(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", "value")
    return e.withColumn("held", T.held(e, ["user_id"], ["us", "event_id"], "value", 3, 2)).select("event_id", "held")


@query("""SELECT l_suppkey, count(*) AS words, min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_quantity) AS gains, CAST(sum(CASE WHEN was <> l_quantity THEN 1 ELSE 0 END) AS BIGINT) AS changes, min(l_orderkey - prev) AS cadence
    FROM (SELECT *, lag(l_quantity) OVER w AS was, lag(l_orderkey) OVER w AS prev FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)) GROUP BY l_suppkey""")
def drc_word_profile(spark, sf_dir):
    return R.word_profile(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_quantity", "l_orderkey")


@query("""WITH b AS (SELECT l_returnflag, floor(l_quantity / 3) * 3 AS bin, count(*) AS n, avg(l_discount) AS gain FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 8)
    SELECT l_returnflag, CAST(bin AS BIGINT) AS bin, n, round(gain, 6) AS gain, round((gain - lag(gain) OVER w) / (bin - lag(bin) OVER w), 6) AS slope FROM b WINDOW w AS (PARTITION BY l_returnflag ORDER BY bin)""")
def level_histogram_slope(spark, sf_dir):
    h = M.histogram_slope(_table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_discount"), 3, 8, ["l_returnflag"])
    return h.select("l_returnflag", F.col("bin").cast("long").alias("bin"), "n", _r(F.col("gain"), 6).alias("gain"), _r(F.col("slope"), 6).alias("slope"))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    round(avg(l_discount - l_tax), 6) AS bias, round(sqrt(avg((l_discount - l_tax) ** 2)), 6) AS rms, round(10 * log10(sum(l_discount ** 2) / sum((l_discount - l_tax) ** 2)), 5) AS snr FROM lineitem GROUP BY l_returnflag""")
def corr_regression(spark, sf_dir):
    li, e, k = _table(spark, sf_dir, "lineitem"), F.col("l_discount") - F.col("l_tax"), ["l_returnflag"]
    r = R.regression(li, k, "l_quantity", "l_extendedprice").join(R.bias_rms(li, k, e), k).join(R.snr(li, k, F.col("l_discount"), e), k)
    return r.select(*k, _r(F.col("r"), 6).alias("r"), _r(F.col("slope"), 4).alias("slope"), _r(F.col("bias"), 6).alias("bias"), _r(F.col("rms"), 6).alias("rms"), _r(F.col("snr")).alias("snr"))


_HOURS = "(SELECT programme, CAST(floor(us / 3600000000) AS BIGINT) AS hour, avg(value) AS value FROM {e} WHERE event_type {is_} 'view' GROUP BY ALL)"


@query(f"""WITH r AS (SELECT a.programme, CAST(l.lag AS INT) AS lag, round(sqrt(avg((a.value - b.value) ** 2)), 6) AS rms FROM {_HOURS.format(e=E, is_='=')} a CROSS JOIN (SELECT unnest(range(-8, 9)) AS lag) l
    JOIN {_HOURS.format(e=E, is_='<>')} b ON a.programme = b.programme AND b.hour = a.hour + l.lag GROUP BY ALL)
    SELECT programme, lag, rms FROM r QUALIFY row_number() OVER (PARTITION BY programme ORDER BY rms, lag) = 1""")
def lag_search(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    a, b = (e.where(c).groupBy("programme", "hour").agg(F.avg("value").alias("value")) for c in ("event_type = 'view'", "event_type <> 'view'"))
    return M.lag_search(a, b, ["programme"], "hour", range(-8, 9))


@query("""SELECT event_id, round(CASE WHEN value <= 0 THEN 1 WHEN value <= 100 THEN 1 + value * (-0.2 / 100) WHEN value <= 250 THEN 0.8 + (value - 100) * (-0.3 / 150) WHEN value <= 400 THEN 0.5 + (value - 250) * (-0.4 / 150) ELSE 0.1 END, 6) AS gain,
    CAST(CASE WHEN value <= 0 THEN 31 ELSE greatest(1, least(31, round(-(-0.691 + 10 * log10(value / 5000))))) END AS INT) AS dialnorm, CAST(greatest(-32768, least(32767, round((value - 100) * 256))) AS INT) AS q78 FROM events""")
def curve_and_codes(spark, sf_dir):
    v = F.col("value")
    return _table(spark, sf_dir, "events").select("event_id", _r(L.interpolate(v, KNOTS), 6).alias("gain"), L.dialnorm_code(L.loudness(v / 5000)).alias("dialnorm"), L.q7_8(v - 100).alias("q78"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), a AS (SELECT *, degrees(atan2(-x, y)) AS az FROM p)
    SELECT vec_id, round(az, 5) AS azimuth, round(30 + (((az - 30) % 360) + 360) % 360, 5) AS from_thirty, (((az + 110) % 360) + 360) % 360 <= 220 AS front,
    CAST(round((greatest(-1, least(1, x)) + 1) / 2 * 62) AS INT) AS gx, CAST(round((greatest(-1, least(1, z)) + 1) / 2 * 15) AS INT) AS gz,
    round(21.4 * log10(1 + 0.00437 * abs(x) * 1000), 6) AS erb, round(pow(abs(x) + abs(y) + 4.72, 0.2) - pow(abs(y) + 4.72, 0.2), 6) AS added FROM a""")
def positions(spark, sf_dir):
    x, y, z = (F.element_at("embedding", i).cast("double") for i in (1, 2, 3))
    az = L.azimuth(x, y)
    return _table(spark, sf_dir, "embeddings").select("vec_id", _r(az).alias("azimuth"), _r(L.relative_angle(F.lit(30.0), az)).alias("from_thirty"), L.inside_angles(az, F.lit(-110.0), F.lit(110.0)).alias("front"),
        L.grid_code(x, 62).alias("gx"), L.grid_code(z, 15).alias("gz"), _r(L.erb_rate(F.abs(x) * 1000), 6).alias("erb"), _r(L.added_loudness(F.abs(x), F.abs(y)), 6).alias("added"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS loudest FROM lineitem) WHERE l_quantity > 10 AND l_quantity > loudest * 0.5""")
def audibility_filter(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return X.audible_only(li, ["l_orderkey"], "l_quantity", 10.0, 0.5).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, max_by(l_linenumber, [l_extendedprice, l_linenumber]) AS worst, CAST(sum(round(l_quantity * l_discount * 100)) AS BIGINT) AS weighted, sum(l_quantity) AS weight, CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS silent FROM lineitem GROUP BY l_orderkey""")
def metric_layer_report(spark, sf_dir):
    d, q = F.col("l_discount"), F.col("l_quantity")
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("worst"), F.sum(F.round(q * d * 100)).cast("long").alias("weighted"), F.sum(q).alias("weight"), F.count_if(d == 0).alias("silent"))


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())""")
def survey_grouping_sets(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return R.histograms(o, [["status"], ["priority"], ["status", "priority"], []], [_r(F.sum("o_totalprice"), 2).alias("total")]).select("status", "priority", "level", "n", "total")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def missing_components_anti(spark, sf_dir):
    return R.absent(_table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), {"c_custkey": "o_custkey"}).select("c_custkey", "c_nationkey")


@query("""SELECT s_suppkey, n_name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def score_ranking(spark, sf_dir):
    key = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return R.ranked(_table(spark, sf_dir, "supplier"), key, "s_nationkey", ["n_name"], "s_acctbal", ["s_suppkey"]).select("s_suppkey", "n_name", "place")


@query("""SELECT CASE WHEN l.toxic IS NULL THEN 'failed' WHEN d.n_chars = length(d.text) THEN 'identical' WHEN lower(trim(d.text)) = lower(d.text) THEN 'equivalent' ELSE 'mismatched' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def roundtrip_tally(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return R.tally(d, R.round_trip_status(F.col("toxic").isNotNull(), F.col("n_chars") == F.length("text"), F.lower(F.trim("text")) == F.lower("text")))


@query("""SELECT l_orderkey, l_partkey, round(avg(l_quantity * l_quantity) * max(l_discount) ** 2, 6) AS energy, round(max(abs(l_quantity)) * max(l_discount), 6) AS peak FROM lineitem GROUP BY l_orderkey, l_partkey""")
def scene_energy(spark, sf_dir):
    e = R.scene_energy(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_quantity", F.col("l_discount"))
    return e.select("l_orderkey", "l_partkey", _r(F.col("energy"), 6).alias("energy"), _r(F.col("peak"), 6).alias("peak"))


_RES = "(SELECT l_suppkey, CAST(l_quantity AS BIGINT) - 25 AS r FROM lineitem)"


@query(f"""WITH s AS (SELECT l_suppkey, CAST(sum(CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END) AS BIGINT) AS s, count(*) AS n FROM {_RES} GROUP BY 1)
    SELECT l_suppkey, CAST(k AS INT) AS k, bits FROM (SELECT l_suppkey, k, n * (k + 1) + (s >> CAST(k AS INT)) AS bits FROM s CROSS JOIN (SELECT unnest(range(15)) AS k)) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY bits, k) = 1""")
def rice_best_parameter(spark, sf_dir):
    return M.rice_parameter(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_quantity").cast("long") - 25)


@query("""WITH x AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS a, coalesce(lag(CAST(l_quantity AS BIGINT), 1) OVER w, 0) AS b, coalesce(lag(CAST(l_quantity AS BIGINT), 2) OVER w, 0) AS c, coalesce(lag(CAST(l_quantity AS BIGINT), 3) OVER w, 0) AS d, coalesce(lag(CAST(l_quantity AS BIGINT), 4) OVER w, 0) AS e
        FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)),
    s AS (SELECT l_suppkey, CAST(sum(abs(a)) AS BIGINT) AS s0, CAST(sum(abs(a - b)) AS BIGINT) AS s1, CAST(sum(abs(a - 2 * b + c)) AS BIGINT) AS s2, CAST(sum(abs(a - 3 * b + 3 * c - d)) AS BIGINT) AS s3, CAST(sum(abs(a - 4 * b + 6 * c - 4 * d + e)) AS BIGINT) AS s4 FROM x GROUP BY 1)
    SELECT *, CAST(list_position([s0, s1, s2, s3, s4], least(s0, s1, s2, s3, s4)) - 1 AS INT) AS best_order FROM s""")
def fixed_predictor_order(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_quantity").cast("long").alias("x"))
    return M.fixed_predictors(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "x")


@query("SELECT doc_id, sha256(text) AS digest, CAST(length(text) AS INT) AS chars FROM documents")
def sha_digest(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))


@query("""WITH c AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM c GROUP BY 1, 2)
    SELECT e.vec_id, round(sum(e.x * m.m), 5) AS capture FROM (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings) e JOIN m ON e.label = m.label AND e.i = m.i GROUP BY 1""")
def nearest_centre_capture(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.join(m, ["label", "i"]).groupBy("vec_id").agg(_r(F.sum(F.col("x") * F.col("m"))).alias("capture"))


@query("""SELECT programme, mode, first_seen, n, CAST(row_number() OVER (PARTITION BY programme ORDER BY first_seen) - 1 AS INT) AS class, flag_rate
    FROM (SELECT user_id % 16 AS programme, event_type AS mode, min(event_id) AS first_seen, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS flag_rate FROM events GROUP BY 1, 2)""")
def class_counts(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("programme", F.pmod("user_id", F.lit(PROGRAMMES)))
    m = R.modes(e, ["programme"], ["event_type"], "event_id").join(R.flag_rate(e, ["programme", "event_type"], F.col("value") > 50), ["programme", "event_type"])
    return m.select("programme", F.col("event_type").alias("mode"), "first_seen", "n", "class", F.col("rate").alias("flag_rate"))