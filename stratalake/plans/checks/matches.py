"""Matching, split, scaling and category queries."""

from pyspark.sql import functions as F

from stratalake.operators import matching as M, summaries as S

from .views import LOGS, SAMPLES, SITES, STATIONS, logs, read, samples, sites, stations

RULES = [("ore", ["RF", "AF"], None), ("waste", [], "N")]


def targets(s, d):
    return read(s, d, "events").select(F.col("user_id").alias("hole"), F.col("event_id").alias("id"), (F.col("event_id") % 97 * 1.5).alias("md"))


def planes(s, d):
    return read(s, d, "events").select("event_type", (F.col("event_id") % 90).alias("dip"), (F.col("event_id") * 7 % 360).alias("dip_direction"))


QUERIES = {
    "p27_rules": lambda s, d: logs(s, d).select("hole", "sample", M.by_rules(RULES, F.col("code"), F.col("code"), "other").alias("category")),
    "p20_standardized": lambda s, d: S.standardized(samples(s, d), ["analyte"], "value").select("hole", "sample", F.round("z", 6).alias("z"), "constant"),
    "p21_robust_asinh": lambda s, d: S.robust_asinh(samples(s, d), ["analyte"], "value").select("hole", "sample", F.round("scaled", 6).alias("scaled")),
    "j7_segments": lambda s, d: M.segment_of(targets(s, d), stations(s, d)),
    "j9_nearest_other": lambda s, d: M.nearest_other(sites(s, d), 50.0).withColumn("distance", F.round("distance", 6)),
    "j13_unique_keys": lambda s, d: M.unique_key_join(read(s, d, "lineitem").select("l_orderkey", "l_quantity"), read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), ["l_orderkey"]),
    "a6_moved_samples": lambda s, d: M.moved_samples(logs(s, d).select(F.concat_ws("/", "hole", "code").alias("id"), "sample", "from_md", "to_md"), "id", ["sample"]).select("id", "sample"),
    "w5_suffixes": lambda s, d: M.numbered(logs(s, d).select("hole", "sample"), "hole", ["sample"]).select("hole", "sample", "unique_id"),
    "a18_tensor": lambda s, d: S.orientation_tensor(planes(s, d), ["event_type"]).select("event_type", "planes", *(F.round(c, 6).alias(c) for c in ("ee", "en", "eu", "nn", "nu", "uu"))),
    "a18_orientation": lambda s, d: S.principal_orientation(S.orientation_tensor(planes(s, d), ["event_type"])),
    "a32_majority": lambda s, d: S.majority(logs(s, d).select("hole", F.col("code").alias("category"), (F.col("to_md") - F.col("from_md")).alias("length")), ["hole"]).withColumn("share", F.round("share", 6)),
    "a35_probabilities": lambda s, d: S.category_probabilities(logs(s, d).select("sample", F.substring("code", 1, 1).alias("category")), ["sample"], ["A", "N", "R"]).select("sample", *(F.round(f"p_{c}", 6).alias(f"p_{c.lower()}") for c in "ANR")),
    "a40_waterfall": lambda s, d: S.waterfall(samples(s, d), [("all", F.lit(True)), ("priced", F.col("value") > 20000), ("final", F.col("method") == "F")]),
    "t17_isotonic": lambda s, d: S.isotonic(samples(s, d).select("analyte", F.col("sample").cast("double").alias("x"), F.col("value").alias("y")), ["analyte"]),
    "w7_spacing": lambda s, d: S.spacing_median(samples(s, d), ["hole"], "from_md"),
}
ORACLES = {
    "p27_rules": f"WITH {LOGS} SELECT hole, sample, CASE WHEN code IN ('RF', 'AF') THEN 'ore' WHEN code LIKE 'N%' THEN 'waste' ELSE 'other' END AS category FROM logs",
    "p20_standardized": f"WITH {SAMPLES}, m AS (SELECT *, avg(value) OVER w AS a, stddev_pop(value) OVER w AS sd FROM samples WINDOW w AS (PARTITION BY analyte)) SELECT hole, sample, round((value - a) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z, sd = 0 AS constant FROM m",
    "p21_robust_asinh": f"WITH {SAMPLES}, q AS (SELECT analyte, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM samples GROUP BY 1) SELECT hole, sample, round(asinh((value - m) / iqr), 6) AS scaled FROM samples JOIN q USING (analyte) WHERE iqr > 0",
    "j7_segments": f"WITH {STATIONS}, s AS (SELECT hole, md, lead(md) OVER (PARTITION BY hole ORDER BY md) AS nxt FROM stations), t AS (SELECT user_id AS hole, event_id AS id, CAST(event_id % 97 * 1.5 AS DOUBLE) AS md FROM events) SELECT t.hole, t.id, t.md, s.md AS md0, s.nxt AS md1 FROM t ASOF LEFT JOIN s ON t.hole = s.hole AND t.md >= s.md",
    "j9_nearest_other": f"WITH {SITES}, p AS (SELECT a.id, b.id AS nearest_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM sites a JOIN sites b ON a.id <> b.id) SELECT id, nearest_id, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, nearest_id) = 1",
    "j13_unique_keys": "SELECT l_orderkey, min(l_quantity) AS l_quantity, min(o_totalprice) AS o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) = 1",
    "a6_moved_samples": f"WITH {LOGS}, f AS (SELECT concat(hole, '/', code) AS id, sample, from_md, to_md, first_value(from_md) OVER w AS a, first_value(to_md) OVER w AS b FROM logs WINDOW w AS (PARTITION BY hole, code ORDER BY sample)) SELECT id, sample FROM f WHERE from_md <> a OR to_md <> b",
    "w5_suffixes": f"WITH {LOGS} SELECT hole, sample, CASE WHEN sample = 1 THEN CAST(hole AS VARCHAR) ELSE concat(hole, '#', sample) END AS unique_id FROM logs",
    "a18_tensor": "WITH n AS (SELECT event_type, sin(radians(event_id % 90)) * sin(radians(event_id * 7 % 360)) AS e, sin(radians(event_id % 90)) * cos(radians(event_id * 7 % 360)) AS n, cos(radians(event_id % 90)) AS u FROM events) SELECT event_type, count(*) AS planes, round(avg(e * e), 6) AS ee, round(avg(e * n), 6) AS en, round(avg(e * u), 6) AS eu, round(avg(n * n), 6) AS nn, round(avg(n * u), 6) AS nu, round(avg(u * u), 6) AS uu FROM n GROUP BY 1",
    "a32_majority": f"WITH {LOGS}, l AS (SELECT hole, code, sum(to_md - from_md) AS len FROM logs GROUP BY ALL), r AS (SELECT *, len / sum(len) OVER (PARTITION BY hole) AS share, row_number() OVER (PARTITION BY hole ORDER BY len DESC, code) AS nth FROM l) SELECT hole, CASE WHEN share > 0.5 THEN code ELSE 'conflict' END AS category, round(share, 6) AS share FROM r WHERE nth = 1",
    "a35_probabilities": f"WITH {LOGS} SELECT sample, " + ", ".join(f"round(avg(CASE WHEN code[1] = '{c}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_{c.lower()}" for c in "ANR") + " FROM logs GROUP BY 1",
    "a40_waterfall": "SELECT 0 AS step, 'all' AS name, count(*) AS rows FROM lineitem UNION ALL SELECT 1, 'priced', count(*) FROM lineitem WHERE l_extendedprice > 20000 UNION ALL SELECT 2, 'final', count(*) FROM lineitem WHERE l_extendedprice > 20000 AND l_linestatus = 'F'",
    "w7_spacing": f"WITH {SAMPLES}, n AS (SELECT hole, lead(from_md) OVER (PARTITION BY hole ORDER BY from_md) - from_md AS step FROM samples) SELECT hole, quantile_cont(step, 0.5) AS spacing FROM n WHERE step IS NOT NULL GROUP BY 1",
}
