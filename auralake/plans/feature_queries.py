"""Queries on features, digests and bit costs, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from auralake.functions import codes as C
from auralake.functions import levels as L
from auralake.operators import features as Y
from auralake.operators import measures as M
from auralake.operators import report as R
from auralake.plans.queries import BLOCKS, LOUD, SLIDING, _blocks, _events, _r, _table, query
from auralake.plans.scene_queries import _F, _frames

THRESHOLDS = Y.Thresholds(6.0, 0.4, 2.0, 0.1, 1.5)


@query("""WITH m AS (SELECT label, vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS m FROM embeddings), b AS (SELECT *, lag(m) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM m)
    SELECT vec_id, CASE WHEN p IS NULL THEN -1 ELSE round(list_sum(list_transform(list_zip(m, p), lambda z: greatest(0, z[1] - z[2]))) / list_sum(m), 8) END AS flux FROM b""")
def spectral_flux(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("m"))
    flux = e.withColumn("f", Y.spectral_flux(e, ["label"], ["vec_id"], "m"))
    return flux.select("vec_id", F.when(F.col("f") == float("inf"), -1.0).otherwise(_r(F.col("f"), 8)).alias("flux"))


@query("""SELECT event_id, (value / 5 - 100 > -80 AND value / 5 - 100 > -90 + 6 AND event_id % 10 / 10.0 >= 0.4 AND event_id % 7 >= 2 AND value / 500 >= 0.1 AND (event_id % 300 < 75 OR value / 50 >= 1.5)) AS voiced FROM events""")
def voice_like(spark, sf_dir):
    v, i = F.col("value"), F.col("event_id")
    return _table(spark, sf_dir, "events").select("event_id", Y.voice_like(v / 5 - 100, F.lit(-90.0), i % 10 / 10, i % 7, v / 500, v / 50, i % 300, 150, THRESHOLDS).alias("voiced"))


@query(f"""WITH {BLOCKS}, {SLIDING.format(n=4, p=3)}, sp AS (SELECT *, programme % 3 <> 0 AND sub % 5 < 2 AS said FROM w4), a AS (SELECT * FROM sp WHERE said AND {LOUD.format('mean')} > -70), t AS (SELECT programme, avg(mean) AS tm FROM a GROUP BY 1),
    k AS (SELECT a.* FROM a JOIN t USING (programme) WHERE {LOUD.format('mean')} > {LOUD.format('tm')} - 10), l AS (SELECT programme, count(*) AS blocks, round({LOUD.format('avg(mean)')}, 5) AS lufs FROM k GROUP BY 1)
    SELECT programme, coalesce(l.blocks, 0) AS blocks, coalesce(l.lufs, '-inf'::DOUBLE) AS lufs, round(avg(said::INT), 8) AS share FROM sp LEFT JOIN l USING (programme) GROUP BY ALL""")
def dialogue_loudness(spark, sf_dir):
    b = M.sliding(_blocks(spark, sf_dir), ["programme"], 4)
    said = b.where("programme % 3 <> 0 and pmod(sub, 5) < 2").select("programme", "sub")
    return M.dialogue_loudness(b, said, ["programme"]).select("programme", "blocks", _r(F.col("lufs")).alias("lufs"), _r(F.col("share"), 8).alias("share"))


@query(f"""WITH f AS (SELECT programme, event_type, value FROM {_F} WHERE value >= 28), r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY programme, event_type) AS c FROM f WINDOW w AS (PARTITION BY programme, event_type ORDER BY value))
    SELECT programme, event_type, max(value) FILTER (WHERE n - 1 = round((c - 1) * 0.5)) AS p50, max(value) FILTER (WHERE n - 1 = round((c - 1) * 0.75)) AS p75, max(value) FILTER (WHERE n - 1 = round((c - 1) * 0.9)) AS p90, max(value) FILTER (WHERE n - 1 = round((c - 1) * 0.99)) AS p99 FROM r GROUP BY 1, 2""")
def quantile_spread(spark, sf_dir):
    return R.quantile_spread(_frames(spark, sf_dir), ["programme", "event_type"], "value", F.col("value"), F.lit(20.0))


KEY = b"a key of the session"
_PAD = ["".join(f"\\x{b ^ p:02X}" for b in KEY.ljust(64, b"\0")) for p in (0x36, 0x5C)]


@query(f"SELECT c_custkey, sha256('{_PAD[1]}'::BLOB || unhex(sha256('{_PAD[0]}'::BLOB || encode(c_name)))) AS mac FROM customer")
def keyed_digest(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", C.hmac_sha256(F.col("c_name"), KEY).alias("mac"))


@query("""WITH RECURSIVE b AS (SELECT c_custkey, c_name, 0 AS i, 0 AS c, 0 AS p FROM customer UNION ALL
    SELECT c_custkey, c_name, i + 1, CAST(list_reduce([xor(c, ord(substr(c_name, i + 1, 1))), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a >= 128 THEN xor((a * 2) % 256, 7) ELSE a * 2 END) AS INT), xor(p, ord(substr(c_name, i + 1, 1))) FROM b WHERE i < length(c_name))
    SELECT c_custkey, CAST(c AS BIGINT) AS crc, p AS parity FROM b WHERE i = length(c_name)""")
def crc_and_parity(spark, sf_dir):
    n = F.col("c_name").cast("binary")
    return _table(spark, sf_dir, "customer").select("c_custkey", C.crc(8, 0x07)(n).alias("crc"), C.parity(n).alias("parity"))


@query("""WITH v AS (SELECT event_id, value, CAST(event_id AS BIGINT) * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS n FROM events), u AS (SELECT *, CASE WHEN n < 0 THEN -2 * n - 1 ELSE 2 * n END AS z FROM v)
    SELECT event_id, (z >> 5) + 6 AS rice, CAST(greatest(1, ceil(length(bin(z)) / 7.0)) * 8 AS INT) AS leb, round((pow(10, (value / 20) / 21.4) - 1) / 0.00437, 6) AS hz, round(24.7 * (1 + 0.00437 * value), 8) AS width FROM u""")
def bit_costs(spark, sf_dir):
    i, v = F.col("event_id").cast("long"), F.col("value")
    n = i * F.when(i % 2 == 0, 1).otherwise(-1)
    return _table(spark, sf_dir, "events").select("event_id", C.rice_bits(n, 5).alias("rice"), C.leb128_bits(C.zigzag(n)).alias("leb"), _r(L.erb_frequency(v / 20), 6).alias("hz"), _r(L.erb_width(v), 8).alias("width"))


@query("""SELECT l_suppkey, round(sum(l_discount) / sum(l_quantity), 10) AS share, max(l_extendedprice) AS peak_rate FROM lineitem GROUP BY 1""")
def codec_totals(spark, sf_dir):
    return R.totals(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_discount"), F.col("l_quantity"), F.col("l_extendedprice")).withColumn("share", _r(F.col("share"), 10))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS turn FROM orders) SELECT o_orderkey, CAST(turn AS INT) AS turn, CAST(CASE WHEN (turn // 8) % 2 = 0 THEN turn % 8 ELSE 7 - turn % 8 END AS INT) AS worker FROM t""")
def longest_first(spark, sf_dir):
    return R.longest_first(_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 8, ["o_orderkey"]).select("o_orderkey", "turn", "worker")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND strlen(text) > 10 THEN 7 WHEN doc_id % 3 = 1 THEN strlen(text) END AS first_at FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def byte_compare(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("block"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    flipped = F.concat(F.substring("data", 1, 7), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("data", 8, 1)), 16, 10).cast("int").bitwiseXOR(1)), 2, "0")), F.expr("substring(data, 9)"))
    b = d.withColumn("data", F.when((F.col("doc_id") % 3 == 0) & (F.length("data") > 10), flipped).when(F.col("doc_id") % 3 == 1, F.concat("data", F.lit(b"x"))).otherwise(F.col("data")))
    return R.first_difference(d, b, ["doc_id"], "block", "data", 1 << 30).withColumnRenamed("offset", "first_at")


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1""")
def unmodelled_elements(spark, sf_dir):
    return R.unmodelled(_table(spark, sf_dir, "events"), "event_type", ["view", "click"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def survey_limit(spark, sf_dir):
    return R.first_rows(_table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey")


@query("""WITH o AS (SELECT l_orderkey AS block, l_linenumber AS object, max(l_returnflag) AS a, max(l_linestatus) AS b FROM lineitem GROUP BY 1, 2), e AS (SELECT block, object AS element, a, b FROM o WHERE object <= 3)
    SELECT o.block, o.object, e.element FROM o JOIN e ON o.block = e.block AND o.a IS NOT DISTINCT FROM e.a AND o.b IS NOT DISTINCT FROM e.b""")
def class_masks(spark, sf_dir):
    o = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("object")).agg(F.max("l_returnflag").alias("a"), F.max("l_linestatus").alias("b"))
    e = o.where("object <= 3").select("block", F.col("object").alias("element"), "a", "b")
    return R.class_masks(o, e, ["block"], ["a", "b"])
