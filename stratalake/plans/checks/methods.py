"""Every method over all sites, with the rows of those that fail."""

from pyspark.sql import functions as F

from stratalake.operators import methods as M

from .views import SITES, sites


def runs(s, d):
    fitted = M.Fitted((1.0, 2000.0, 0.1), 4.0, (1.0, 2000.0, 0.1), None, {2000.0: (0.2, 2000.0, 0.02), 6000.0: (0.2, 2000.0, 0.02)}, {"ordinary-cokriging": "one variable"})
    return M.run_methods(sites(s, d), sites(s, d).where("id % 3 <> 0"), fitted, 2, 8, 1500.0, radius=1500.0, least=2)


NEAR = f"""WITH {SITES}, o AS (SELECT a.id AS target, b.id, b.hole, b.value, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS distance FROM sites a JOIN sites b ON a.id <> b.id AND b.id % 3 <> 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1500),
h AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY target, hole ORDER BY distance, id) <= 2), n AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY target ORDER BY distance, id) <= 8),
m AS (SELECT target, count(*) AS samples, count(DISTINCT hole) AS holes, arg_min(value, (distance, id)) AS nearest, coalesce(avg(value) FILTER (distance = 0), sum(value / distance ** 2) FILTER (distance > 0) / sum(1 / distance ** 2) FILTER (distance > 0)) AS blend FROM n GROUP BY 1)"""
QUERIES = {
    "t14_all_methods": lambda s, d: runs(s, d).select("method", "target", "samples", "holes", F.round("estimate", 6).alias("estimate"), F.round("variance", 6).alias("variance"), "status", "reason"),
    "t14_simple_methods": lambda s, d: runs(s, d).where("method IN ('nearest-neighbour', 'inverse-distance', 'ordinary-cokriging', 'sequential-gaussian')").select("method", "target", "samples", "holes", F.round("estimate", 6).alias("estimate"), "status", "reason"),
}
ORACLES = {
    "t14_simple_methods": f"""{NEAR}, t AS (SELECT s.id AS target, coalesce(samples, 0) AS samples, coalesce(holes, 0) AS holes, nearest, blend, coalesce(samples, 0) >= 2 AS enough FROM sites s LEFT JOIN m ON m.target = s.id)
SELECT 'nearest-neighbour' AS method, target, samples, holes, CASE WHEN enough THEN round(nearest, 6) END AS estimate, CASE WHEN enough THEN 'estimated' ELSE 'uninformed' END AS status, CASE WHEN NOT enough THEN 'too few neighbours' END AS reason FROM t
UNION ALL SELECT 'inverse-distance', target, samples, holes, CASE WHEN enough THEN round(blend, 6) END, CASE WHEN enough THEN 'estimated' ELSE 'uninformed' END, CASE WHEN NOT enough THEN 'too few neighbours' END FROM t
UNION ALL SELECT 'ordinary-cokriging', id, 0, 0, NULL, 'failed', 'one variable' FROM sites UNION ALL SELECT 'sequential-gaussian', id, 0, 0, NULL, 'failed', 'simulation is not run here' FROM sites""",
}
