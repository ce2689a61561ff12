"""Calibration and comparison queries."""

from pyspark.sql import functions as F

from stratalake.operators import calibration as C

from .views import SITES, read, sites


def readings(s, d):
    return read(s, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))


def points(s, d):
    return C.tie_means(readings(s, d).where("x % 7 = 0"), ["method"]).select("method", "x", F.col("y").alias("fitted"))


def asked(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), (F.col("l_quantity") + 0.5).alias("x")).agg(F.min("l_orderkey").alias("id"))


def chances(s, d):
    return read(s, d, "lineitem").select("l_linestatus", (F.col("l_quantity") / 60).alias("probability"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("outcome"))


def counts(s, d, flag):
    return read(s, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_linenumber").agg(F.count("*").alias("n"))


def records(s, d):
    e, k = read(s, d, "events"), F.col("event_id")
    return e.select(k.alias("id"), F.when(k % 5 == 0, "control").otherwise("result").alias("role"), F.when(k % 3 != 0, k).alias("support"), F.when(k % 2 == 0, "event").otherwise("interval").alias("kind"), (k % 100).cast("double").alias("from_md"), (k % 100 + k % 4 / 2).cast("double").alias("to_md"))


QUERIES = {
    "a38_tie_means": lambda s, d: C.tie_means(readings(s, d), ["method"]).withColumn("y", F.round("y", 9)),
    "t17_interpolated": lambda s, d: C.interpolated(asked(s, d), points(s, d), ["method"]).withColumn("estimate", F.round("estimate", 9)),
    "a23_brier_skill": lambda s, d: C.brier_skill(chances(s, d), ["l_linestatus"]).select("l_linestatus", "n", *(F.round(c, 9).alias(c) for c in ("brier", "reference", "skill"))),
    "a15_weights": lambda s, d: C.decluster_weights(sites(s, d), 500.0).withColumn("weight", F.round("weight", 9)),
    "a45_total_variation": lambda s, d: C.total_variation(counts(s, d, "R"), counts(s, d, "N"), "l_linenumber").select(F.round("distance", 9).alias("distance")),
    "a28_histogram": lambda s, d: C.histogram(read(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.0, 5000.0).withColumn("share", F.round("share", 9)),
    "k4_record_faults": lambda s, d: C.record_faults(records(s, d)),
}
ORACLES = {
    "a38_tie_means": "SELECT l_returnflag AS method, l_quantity AS x, round(avg(l_discount), 9) AS y, count(*) AS weight FROM lineitem GROUP BY ALL",
    "t17_interpolated": """WITH p AS (SELECT l_returnflag AS method, l_quantity AS x, avg(l_discount) AS f FROM lineitem WHERE l_quantity % 7 = 0 GROUP BY ALL), v AS (SELECT l_returnflag AS method, l_quantity + 0.5 AS x, min(l_orderkey) AS id FROM lineitem GROUP BY ALL),
b AS (SELECT v.*, (SELECT max(x) FROM p WHERE p.method = v.method AND p.x <= v.x) AS lo, (SELECT min(x) FROM p WHERE p.method = v.method AND p.x >= v.x) AS hi FROM v)
SELECT b.method, id, b.x, round(CASE WHEN lo IS NULL THEN h.f WHEN hi IS NULL OR lo = hi THEN l.f ELSE l.f + (h.f - l.f) * (b.x - lo) / (hi - lo) END, 9) AS estimate FROM b LEFT JOIN p l ON l.method = b.method AND l.x = lo LEFT JOIN p h ON h.method = b.method AND h.x = hi""",
    "a23_brier_skill": "WITH c AS (SELECT l_linestatus, count(*) AS n, avg((l_quantity / 60 - o) ** 2) AS b, avg(o) * (1 - avg(o)) AS r FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS o FROM lineitem) GROUP BY 1) SELECT l_linestatus, n, round(b, 9) AS brier, round(r, 9) AS reference, round(CASE WHEN r > 0 THEN 1 - b / r END, 9) AS skill FROM c",
    "a15_weights": f"""WITH {SITES}, k AS (SELECT id, o, floor((x + o * 125.0) / 500) AS cx, floor((y + o * 125.0) / 500) AS cy FROM sites, range(4) t(o)), c AS (SELECT o, cx, cy, count(*) AS held FROM k GROUP BY ALL), n AS (SELECT o, count(*) AS cells, sum(held) AS points FROM c GROUP BY 1)
SELECT id, round(sum(points / (held * cells)) / 4, 9) AS weight FROM k JOIN c USING (o, cx, cy) JOIN n USING (o) GROUP BY 1""",
    "a45_total_variation": "WITH a AS (SELECT l_linenumber, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_linenumber, count(*) / sum(count(*)) OVER () AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS distance FROM a FULL JOIN b USING (l_linenumber)",
    "a28_histogram": "SELECT l_returnflag, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS share FROM lineitem GROUP BY 1, 2",
    "k4_record_faults": """WITH r AS (SELECT event_id AS id, event_id % 5 = 0 AS control, event_id % 3 <> 0 AS supported, event_id % 2 = 0 AS event, event_id % 4 > 0 AS length FROM events)
SELECT id, 'control with a support' AS fault FROM r WHERE control AND supported UNION ALL SELECT id, 'result without a support' FROM r WHERE NOT control AND NOT supported
UNION ALL SELECT id, 'event with a length' FROM r WHERE event AND length UNION ALL SELECT id, 'interval without a length' FROM r WHERE NOT event AND NOT length""",
}
