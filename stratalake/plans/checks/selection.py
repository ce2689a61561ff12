"""Offset matches, splits, domains, findings, calibration, proportions and choices."""

from pyspark.sql import functions as F

from stratalake.operators import matching as M, summaries as S
from stratalake.operators.spatial import cell_pairs

from .views import LOGS, SAMPLES, SITES, logs, read, samples, sites

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SHARE, BUFFER, SOFT, AROUND, LEAST = 0.15, 400.0, 150.0, 600.0, 6


def typed(s, d, step):
    e = read(s, d, "events")
    return e.select(F.col("user_id").alias("hole"), F.pmod(F.col("event_id") * step, F.lit(50)).alias("depth"), F.col("event_type").alias("value"))


def near_sites(s, d):
    home = sites(s, d).select(F.col("id").alias("id_2"), F.col("hole").alias("hole_2"))
    return cell_pairs(sites(s, d), sites(s, d), AROUND).where("id <> id_2").join(home, "id_2")


def cells(s, d):
    return read(s, d, "customer").select(F.col("c_nationkey").alias("layer"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("worth"))


def image(s, d):
    rich = cells(s, d).where("worth > 0")
    return rich.groupBy("category").agg(F.count("*").alias("n")).join(rich.agg(F.count("*").alias("total")), F.lit(True)).select("category", (F.col("n") / F.col("total")).alias("share"))


def predictions(s, d):
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_returnflag").alias("method"), F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("estimate"))


def runs(s, d):
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("hole"), F.col("l_returnflag").alias("prior"), (F.col("l_extendedprice") % 1000 / 1000).alias("p"))


def length(s, d):
    return samples(s, d).withColumn("length", F.col("to_md") - F.col("from_md"))


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def log_rules():
    return {"long": F.col("to_md") - F.col("from_md") > 45, "deep": F.col("from_md") > 100, "unknown code": F.col("code") == "XX"}


QUERIES = {
    "j10_offset_match": lambda s, d: M.offset_match(typed(s, d, 1), typed(s, d, 3)),
    "o3_outermost": lambda s, d: M.outermost(sites(s, d), SHARE).select("id", F.round("distance", 6).alias("distance")),
    "t5_margin_split": lambda s, d: M.margin_split(sites(s, d), SHARE, BUFFER),
    "p29_domain_filter": lambda s, d: near_sites(s, d).where(M.in_domain(F.col("hole_2"), F.col("hole"), F.col("distance"), SOFT)).groupBy("id").agg(F.count("*").alias("informants")),
    "o6_common_targets": lambda s, d: M.common_targets(predictions(s, d), 3),
    "p31_findings": lambda s, d: M.findings(logs(s, d), "logs", log_rules()),
    "t31_scenario_states": lambda s, d: M.scenario_states(read(s, d, "nation").select("n_nationkey"), read(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_acctbal") > 5000).alias("verified")), ["n_nationkey"]),
    "p19_box_shares": lambda s, d: rounded(S.boxed(sites(s, d), sites(s, d).where("value > 0"), ["x", "y"]).select("id", "x_share", "y_share", "outside"), "x_share", "y_share"),
    "a17_cross_variogram": lambda s, d: rounded(S.cross_variogram(length(s, d).select("hole", F.col("sample").alias("id"), F.col("from_md").alias("depth"), "value", F.col("length").alias("other")), 10.0, 5), "gamma", places=3),
    "a22_variance_calibration": lambda s, d: rounded(S.variance_calibration(length(s, d).select("analyte", F.col("value").alias("truth"), (F.col("length") * 1500).alias("estimate"), (F.col("length") * 1e7).alias("variance")), ["analyte"]), "scale", "z_mean", "z_variance", "coverage"),
    "a31_vertical_proportions": lambda s, d: rounded(S.vertical_proportions(cells(s, d), SEGMENTS, 2.0, LEAST), "share"),
    "t29_soft_grid": lambda s, d: rounded(S.soft_grid(S.vertical_proportions(cells(s, d), SEGMENTS, 2.0, LEAST), image(s, d)), "probability"),
    "a36_connectivity": lambda s, d: rounded(S.connectivity(read(s, d, "customer").select(F.col("c_nationkey").alias("realization"), F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 9 + 1).alias("cells"))), "largest", "connected"),
    "a37_persistence": lambda s, d: S.persistence(runs(s, d), ["hole"], 0.6, 0.4, 0.3),
    "a42_chosen_candidates": lambda s, d: S.chosen_candidates(length(s, d).select("hole", F.col("sample").alias("candidate"), F.col("value").alias("rmse"), F.col("from_md").alias("objective"), (F.col("length") / 50).alias("coverage")), ["hole"], 0.5),
    "a45_patterns": lambda s, d: S.patterns(samples(s, d).select(F.col("hole").alias("i"), F.col("sample").alias("j"), (F.col("analyte") == "A").alias("on"))),
}

OUTER = f"""{SITES}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM sites), away AS (SELECT id, x, y, n, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 9) AS d FROM sites, c),
test AS (SELECT id, x, y, d FROM away QUALIFY row_number() OVER (ORDER BY d DESC, id) <= ceil({SHARE} * n))"""
PROPORTIONS = f"""c AS (SELECT c_nationkey AS layer, c_mktsegment AS category, c_acctbal AS worth FROM customer), n AS (SELECT layer, count(*) AS n FROM c GROUP BY 1),
g AS (SELECT category, count(*) / (SELECT count(*) FROM c) AS g FROM c GROUP BY 1),
used AS (SELECT a.layer, b.layer AS source, b.n FROM n a JOIN n b ON b.n >= {LEAST} QUALIFY row_number() OVER (PARTITION BY a.layer ORDER BY abs(a.layer - b.layer), b.layer) = 1),
shares AS (SELECT u.layer, g.category, (count(c.layer) + 2 * g.g) / (u.n + 2) AS share FROM used u CROSS JOIN g LEFT JOIN c ON c.layer = u.source AND c.category = g.category GROUP BY u.layer, g.category, g.g, u.n)"""
LENGTHS = f"{SAMPLES}, l AS (SELECT *, to_md - from_md AS len FROM samples)"

ORACLES = {
    "j10_offset_match": """WITH r AS (SELECT user_id AS hole, event_id % 50 AS depth, event_type AS value FROM events), k AS (SELECT DISTINCT user_id AS hole, event_id * 3 % 50 AS at, event_type AS value FROM events),
o AS (SELECT * FROM (VALUES (0, 0), (1, -2), (2, -1), (3, 1), (4, 2)) t(turn, step)), u AS (SELECT DISTINCT hole, depth, value FROM r),
m AS (SELECT u.hole, u.depth, u.value, arg_min(step, turn) AS step FROM u CROSS JOIN o JOIN k ON k.hole = u.hole AND k.value = u.value AND k.at = u.depth + step GROUP BY ALL)
SELECT r.hole, r.depth, r.value, m.step AS "offset" FROM r LEFT JOIN m ON m.hole = r.hole AND m.depth = r.depth AND m.value = r.value""",
    "o3_outermost": f"WITH {OUTER} SELECT id, round(d, 6) AS distance FROM test",
    "t5_margin_split": f"""WITH {OUTER}, near AS (SELECT DISTINCT s.id FROM sites s JOIN test t ON sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2) <= {BUFFER})
SELECT id, CASE WHEN id IN (SELECT id FROM test) THEN 'test' WHEN id IN (SELECT id FROM near) THEN 'buffered' ELSE 'train' END AS split FROM sites""",
    "p29_domain_filter": f"""WITH {SITES}, p AS (SELECT a.id, a.hole, b.hole AS hole_2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM sites a JOIN sites b ON a.id <> b.id)
SELECT id, count(*) AS informants FROM p WHERE d <= {AROUND} AND (hole = hole_2 OR d <= {SOFT}) GROUP BY 1""",
    "o6_common_targets": "SELECT l_orderkey AS target FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3",
    "p31_findings": f"""WITH {LOGS}, f AS (SELECT 'long' AS finding FROM logs WHERE to_md - from_md > 45 UNION ALL SELECT 'deep' FROM logs WHERE from_md > 100 UNION ALL SELECT 'unknown code' FROM logs WHERE code = 'XX')
SELECT 'logs' AS file, finding, count(*) AS rows FROM f GROUP BY ALL""",
    "t31_scenario_states": "SELECT n_nationkey, CASE WHEN bool_or(s_acctbal > 5000) THEN 'verified' WHEN count(s_acctbal) > 0 THEN 'computed' ELSE 'missing' END AS state FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "p19_box_shares": f"""WITH {SITES}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM sites WHERE value > 0)
SELECT id, round((x - x0) / (x1 - x0), 6) AS x_share, round((y - y0) / (y1 - y0), 6) AS y_share, x < x0 OR x > x1 OR y < y0 OR y > y1 AS outside FROM sites, b""",
    "a17_cross_variogram": f"""WITH {LENGTHS}, p AS (SELECT CAST(round_even(abs(a.from_md - b.from_md) / 10, 0) AS BIGINT) AS bin, (a.value - b.value) * (a.len - b.len) AS q FROM l a JOIN l b ON a.hole = b.hole AND a.sample < b.sample)
SELECT bin, count(*) AS pairs, round(avg(q) / 2, 3) AS gamma FROM p WHERE bin BETWEEN 1 AND 5 GROUP BY 1""",
    "a22_variance_calibration": f"""WITH {LENGTHS}, z AS (SELECT analyte, (value - len * 1500) / sqrt(len * 1e7) AS z FROM l WHERE len > 0)
SELECT analyte, count(*) AS n, round(avg(z * z), 6) AS scale, round(avg(z), 6) AS z_mean, round(var_pop(z), 6) AS z_variance, round(avg(CASE WHEN abs(z) <= 1.96 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM z GROUP BY 1""",
    "a31_vertical_proportions": f"WITH {PROPORTIONS} SELECT layer, category, round(share, 6) AS share FROM shares",
    "t29_soft_grid": f"""WITH {PROPORTIONS}, i AS (SELECT category, count(*) / (SELECT count(*) FROM c WHERE worth > 0) AS image FROM c WHERE worth > 0 GROUP BY 1), r AS (SELECT layer, category, share / image AS r FROM shares JOIN i USING (category))
SELECT layer, category, round(r / sum(r) OVER (PARTITION BY layer), 6) AS probability FROM r""",
    "a36_connectivity": """WITH k AS (SELECT c_nationkey AS realization, c_mktsegment AS category, CAST(c_custkey % 9 + 1 AS DOUBLE) AS cells FROM customer)
SELECT realization, category, round(max(cells) / sum(cells), 6) AS largest, round(sum(cells * cells) / (sum(cells) * sum(cells)), 6) AS connected FROM k GROUP BY ALL""",
    "a37_persistence": """WITH r AS (SELECT l_orderkey AS hole, l_returnflag AS prior, l_extendedprice % 1000 / 1000 AS p FROM lineitem), b AS (SELECT hole, prior, min(p) AS least, max(p) AS most, avg(p) AS mean FROM r GROUP BY ALL)
SELECT hole, CASE WHEN min(least) >= 0.6 THEN 'present' WHEN max(most) <= 0.4 THEN 'absent' WHEN max(mean) - min(mean) >= 0.3 THEN 'prior-dependent' ELSE 'uncertain' END AS persistence FROM b GROUP BY 1""",
    "a42_chosen_candidates": f"WITH {LENGTHS} SELECT hole, sample AS candidate, value AS rmse FROM l WHERE len / 50 >= 0.5 QUALIFY row_number() OVER (PARTITION BY hole ORDER BY value, from_md, sample) = 1",
    "a45_patterns": f"""WITH {SAMPLES}, c AS (SELECT hole AS i, sample AS j, CAST(analyte = 'A' AS INTEGER) AS v FROM samples),
h AS MATERIALIZED (SELECT a.i, a.j, a.v, s.v AS s FROM c a JOIN c s ON s.i = a.i AND s.j = a.j + 1)
SELECT a.v + 2 * e.v + 4 * a.s + 8 * e.s AS code, count(*) AS n FROM h a JOIN h e ON e.i = a.i + 1 AND e.j = a.j GROUP BY 1""",
}
