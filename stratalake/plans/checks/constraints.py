"""Checks of tables in one scan each, of learned and categorical outputs and of the scenario matrix."""

from pyspark.sql import functions as F

from stratalake.operators import constraints as C

from .views import read


def predictions(s, d):
    """Three seeds an order by line number; some estimates are no numbers."""
    n = F.col("l_linenumber")
    value = F.when((n == 2) & (F.col("l_orderkey") % 50 == 0), F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return read(s, d, "lineitem").where(n <= 3).select(F.col("l_returnflag").alias("configuration"), n.alias("seed"), F.col("l_orderkey").alias("target"), value.alias("estimate"))


def ensembles(s, d):
    p = predictions(s, d).where("target % 41 <> 0").groupBy("configuration", "target").agg(F.avg("estimate").alias("mean"), F.stddev_pop("estimate").alias("spread"))
    moved = p.withColumn("mean", F.when(F.col("target") % 17 == 0, F.col("mean") + 1).otherwise(F.col("mean"))).withColumn("spread", F.when(F.col("target") % 19 == 0, F.col("spread") + 1).otherwise(F.col("spread")))
    more = read(s, d, "orders").where("o_orderkey % 500 = 0").select(F.lit("Z").alias("configuration"), F.col("o_orderkey").alias("target"), F.lit(1.0).alias("mean"), F.lit(0.0).alias("spread"))
    return moved.unionByName(more)


def reviews(s, d):
    k, v = F.col("l_partkey"), F.col("l_quantity")
    predicted = F.col("l_linenumber") * 8.0
    residual = v - predicted + F.when(k % 29 == 0, 1.0).otherwise(0.0)
    return read(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("property"), v.alias("value"), predicted.alias("predicted"), residual.alias("residual"), (((residual < -20) | (residual > 20)) != (k % 31 == 0)).alias("flagged"))


def bands(s, d):
    return read(s, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("property"), F.lit(-20.0).alias("low"), F.lit(20.0).alias("high")).distinct()


def chances(s, d):
    k = F.col("o_orderkey")
    p = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), x.alias("probability")) for c, x in (("A", k % 10 / 10), ("B", F.lit(1.0) - k % 10 / 10 - F.when(k % 13 == 0, 0.25).otherwise(0.0)), (F.lit("C"), F.when(k % 23 == 0, F.lit(None).cast("double")).otherwise(0.0)))))).alias("x")
    rows = read(s, d, "orders").select(k.alias("target"), p).select("target", F.when((F.col("target") % 37 == 0) & (F.col("x.category") == "C"), "D").otherwise(F.col("x.category")).alias("category"), "x.probability")
    return rows.where("NOT (target % 43 = 0 AND category = 'C')")


def matrix(s, d):
    n, k = read(s, d, "nation"), F.col("n_nationkey")
    state = F.when(k % 4 == 0, "verified").when(k % 4 == 1, "computed").otherwise("missing")
    return n.select(F.col("n_name").alias("scenario"), state.alias("state"), F.when((k % 4 < 2) | (k % 7 == 0), F.col("n_regionkey")).alias("artifact"), (k % 3).alias("digest"))


def rules():
    return [
        C.Check("lineitem", "l_orderkey", {"late discount": (F.col("l_discount") > 0.08) & (F.col("l_linenumber") > 5), "no quantity": F.col("l_quantity") <= 1, "dear": F.col("l_extendedprice") > 90000}, (), (("l_partkey", "part", "p_partkey"), ("l_orderkey", "orders", "o_orderkey"))),
        C.Check("orders", "o_orderkey", {"open and dear": (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400000)}, ("o_orderkey", "o_custkey"), (("o_custkey", "customer", "c_custkey"),)),
        C.Check("assays", "id"),
    ]


def checked(s, d):
    names = ("lineitem", "orders", "customer", "part")
    tables = {n: read(s, d, n) for n in names} | {"customer": read(s, d, "customer").where("c_custkey % 9 <> 0"), "part": read(s, d, "part").where("p_partkey % 50 <> 0")}
    return C.run_checks(tables, rules())


QUERIES = {
    "g24_check_summary": lambda s, d: checked(s, d)[1],
    "g24_check_findings": lambda s, d: checked(s, d)[0].groupBy("table", "rule", "id").agg(F.count("*").alias("times")),
    "k8_learned_faults": lambda s, d: C.learned_faults(predictions(s, d), ensembles(s, d), 3),
    "k8_flag_faults": lambda s, d: C.flag_faults(reviews(s, d), bands(s, d)).groupBy("property", "fault").agg(F.count("*").alias("rows")),
    "k9_stale_cells": lambda s, d: C.stale_cells(matrix(s, d), read(s, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("artifact"), (F.col("r_regionkey") % 3).alias("digest")), read(s, d, "nation").where("n_nationkey % 11 <> 5").select(F.col("n_name").alias("scenario"))),
    "k10_categorical_faults": lambda s, d: C.categorical_faults(chances(s, d), ["A", "B", "C"]),
}
BROKEN = """b AS (SELECT 'lineitem' AS "table", 'late discount' AS rule, l_orderkey::VARCHAR AS id FROM lineitem WHERE l_discount > 0.08 AND l_linenumber > 5
UNION ALL SELECT 'lineitem', 'no quantity', l_orderkey::VARCHAR FROM lineitem WHERE l_quantity <= 1 UNION ALL SELECT 'lineitem', 'dear', l_orderkey::VARCHAR FROM lineitem WHERE l_extendedprice > 90000
UNION ALL SELECT 'lineitem', 'l_partkey not in part', l_orderkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)
UNION ALL SELECT 'lineitem', 'l_orderkey not in orders', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders', 'open and dear', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000
UNION ALL SELECT 'orders', 'o_orderkey not unique', o_orderkey::VARCHAR FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'orders', 'o_custkey not unique', o_custkey::VARCHAR FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'orders', 'o_custkey not in customer', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)
UNION ALL SELECT 'assays', 'absent table', NULL)"""
ORACLES = {
    "g24_check_summary": f"""WITH {BROKEN}, r AS (SELECT * FROM (VALUES ('lineitem', 'late discount'), ('lineitem', 'no quantity'), ('lineitem', 'dear'), ('lineitem', 'l_partkey not in part'), ('lineitem', 'l_orderkey not in orders'), ('orders', 'open and dear'), ('orders', 'o_orderkey not unique'), ('orders', 'o_custkey not unique'), ('orders', 'o_custkey not in customer'), ('assays', 'absent table')) t("table", rule))
SELECT r."table", r.rule, CASE r."table" WHEN 'lineitem' THEN (SELECT count(*) FROM lineitem) WHEN 'orders' THEN (SELECT count(*) FROM orders) ELSE 0 END AS rows, count(b.rule) AS broken FROM r LEFT JOIN b ON b."table" = r."table" AND b.rule = r.rule GROUP BY ALL""",
    "g24_check_findings": f'WITH {BROKEN} SELECT "table", rule, id, count(*) AS times FROM b GROUP BY ALL',
    "k8_learned_faults": """WITH p AS (SELECT l_returnflag AS configuration, l_linenumber AS seed, l_orderkey AS target, CASE WHEN l_linenumber = 2 AND l_orderkey % 50 = 0 THEN 'NaN'::DOUBLE ELSE l_quantity END AS estimate FROM lineitem WHERE l_linenumber <= 3),
m AS (SELECT configuration, target, count(*) AS n, count(DISTINCT seed) AS seeds, count(*) FILTER (isnan(estimate)) AS odd FROM p GROUP BY ALL),
f AS (SELECT configuration, target, unnest([CASE WHEN n <> 3 OR seeds <> 3 THEN 'seeds missing or repeated' END, CASE WHEN odd > 0 THEN 'estimate not finite' END, CASE WHEN target % 41 = 0 THEN 'no ensemble' END,
CASE WHEN odd = 0 AND target % 41 <> 0 AND target % 17 = 0 THEN 'mean is another' END, CASE WHEN odd = 0 AND target % 41 <> 0 AND target % 19 = 0 THEN 'spread is another' END]) AS fault FROM m UNION ALL SELECT 'Z', o_orderkey, 'no predictions' FROM orders WHERE o_orderkey % 500 = 0)
SELECT * FROM f WHERE fault IS NOT NULL""",
    "k8_flag_faults": """WITH r AS (SELECT l_returnflag AS property, l_partkey AS k FROM lineitem),
f AS (SELECT property, unnest([CASE WHEN property = 'N' THEN 'no band' END, CASE WHEN k % 29 = 0 THEN 'residual is another' END, CASE WHEN property <> 'N' AND k % 31 = 0 THEN 'flag is another' END]) AS fault FROM r) SELECT property, fault, count(*) AS rows FROM f WHERE fault IS NOT NULL GROUP BY ALL""",
    "k9_stale_cells": """WITH c AS (SELECT n_name AS scenario, n_nationkey AS k, CASE WHEN n_nationkey % 4 < 2 OR n_nationkey % 7 = 0 THEN n_regionkey END AS a FROM nation)
SELECT scenario, CASE WHEN k % 11 = 5 THEN 'not registered' WHEN k % 4 < 2 AND a >= 4 THEN 'no artifact' WHEN k % 4 < 2 AND k % 3 <> a % 3 THEN 'stale' WHEN k % 4 >= 2 AND a IS NOT NULL THEN 'artifact without a result' END AS fault FROM c WHERE fault IS NOT NULL""",
    "k10_categorical_faults": """WITH t AS (SELECT o_orderkey AS k FROM orders),
f AS (SELECT k AS target, unnest([CASE WHEN k % 37 = 0 THEN 'unknown category' END, CASE WHEN k % 43 = 0 AND k % 37 <> 0 THEN 'categories missing or repeated' END, CASE WHEN k % 23 = 0 AND NOT (k % 43 = 0 AND k % 37 <> 0) OR (k % 13 = 0 AND k % 10 > 7) THEN 'no probability' END,
CASE WHEN NOT (k % 23 = 0 AND NOT (k % 43 = 0 AND k % 37 <> 0) OR (k % 13 = 0 AND k % 10 > 7)) AND k % 13 = 0 THEN 'not 1 in all' END]) AS fault FROM t) SELECT * FROM f WHERE fault IS NOT NULL""",
}
