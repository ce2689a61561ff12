"""Keys, conflicts, selection, counts and integrity."""

from pyspark.sql import functions as F

from stratalake.operators import quality as Q

from .views import SAMPLES, read, samples


def selection(s, d):
    r = read(s, d, "lineitem").select(F.col("l_orderkey").alias("hole"), F.col("l_returnflag").alias("analyte"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "F", "reassay").otherwise("assay").alias("role"), F.col("l_linenumber").alias("rank"))
    return Q.select_results(r, ["hole", "analyte"])


def states(s, d):
    return samples(s, d).groupBy("analyte").pivot("method", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0).select("analyte", F.col("F").alias("final"), F.col("O").alias("open"))


QUERIES = {
    "k1_duplicate_keys": lambda s, d: Q.duplicate_keys(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "j2_orphans": lambda s, d: Q.orphans(read(s, d, "orders").select("o_orderkey"), read(s, d, "lineitem"), "o_orderkey", "l_orderkey"),
    "a3_versions": lambda s, d: Q.versions(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]),
    "a5_first_of_signature": lambda s, d: Q.first_of_signature(read(s, d, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey"),
    "j4_reconcile": lambda s, d: Q.reconcile(read(s, d, "labels"), read(s, d, "documents"), "doc_id"),
    "a8_select_results": selection,
    "a1_count_by_each": lambda s, d: Q.count_by_each(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]),
    "a10_state_matrix": states,
    "a14_statistics": lambda s, d: samples(s, d).groupBy("analyte").agg(F.count("*").alias("n"), F.countDistinct("hole").alias("holes"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.var_pop("value"), 1).alias("variance"), F.min("value").alias("low"), F.max("value").alias("high")),
    "o2_highest_ten": lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(10),
    "a7_deepest": lambda s, d: samples(s, d).groupBy("hole").agg(F.max("to_md").alias("deepest")),
    "w9_hash_split": lambda s, d: read(s, d, "customer").select("c_custkey", F.when(F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6), 16, 10).cast("long") % 100 < 60, "train").when(F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6), 16, 10).cast("long") % 100 < 75, "validation").when(F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6), 16, 10).cast("long") % 100 < 85, "calibration").otherwise("test").alias("split")),
}
ORACLES = {
    "k1_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "j2_orphans": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "a3_versions": "SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT (l_partkey, l_suppkey)) AS versions, CASE WHEN count(DISTINCT (l_partkey, l_suppkey)) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'collapsed' ELSE 'single' END AS finding FROM lineitem GROUP BY 1, 2",
    "a5_first_of_signature": "SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1",
    "j4_reconcile": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left only' WHEN a.doc_id IS NULL THEN 'right only' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM labels) a FULL JOIN (SELECT DISTINCT doc_id FROM documents) b ON a.doc_id = b.doc_id",
    "a8_select_results": """WITH r AS (SELECT l_orderkey AS hole, l_returnflag AS analyte, l_partkey * 10 + l_linenumber AS id, l_linestatus = 'F' AS again, l_linenumber AS rank FROM lineitem),
g AS (SELECT *, count(*) OVER w AS candidates, count(*) FILTER (again) OVER w AS reassays, min(rank) OVER w AS best, min(id) FILTER (again) OVER w AS reassay_id FROM r WINDOW w AS (PARTITION BY hole, analyte)),
f AS (SELECT hole, analyte, candidates, reassays, reassay_id, count(*) FILTER (rank = best) AS ties, min(id) FILTER (rank = best) AS first_id FROM g GROUP BY ALL),
n AS (SELECT *, CASE WHEN candidates = 1 THEN 'single' WHEN reassays = 1 THEN 'reassay' WHEN ties = 1 THEN 'priority' ELSE 'unresolved' END AS reason FROM f)
SELECT hole, analyte, candidates, reason, CASE WHEN reason = 'reassay' THEN reassay_id WHEN reason <> 'unresolved' THEN first_id END AS selected FROM n""",
    "a1_count_by_each": "SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS rows FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2",
    "a10_state_matrix": "SELECT l_returnflag AS analyte, count(*) FILTER (l_linestatus = 'F') AS final, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1",
    "a14_statistics": f"WITH {SAMPLES} SELECT analyte, count(*) AS n, count(DISTINCT hole) AS holes, round(avg(value), 4) AS mean, round(var_pop(value), 1) AS variance, min(value) AS low, max(value) AS high FROM samples GROUP BY 1",
    "o2_highest_ten": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10",
    "a7_deepest": f"WITH {SAMPLES} SELECT hole, max(to_md) AS deepest FROM samples GROUP BY 1",
    "w9_hash_split": "SELECT c_custkey, CASE WHEN h < 60 THEN 'train' WHEN h < 75 THEN 'validation' WHEN h < 85 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 6) AS BIGINT) % 100 AS h FROM customer)",
}
