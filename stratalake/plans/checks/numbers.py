"""Spatial, estimation and evaluation queries."""

from pyspark.sql import functions as F

from stratalake.operators import geometry, ranks, scores, spatial

from .views import SAMPLES, SITES, STATIONS, read, samples, sites, stations


def near(s, d, per_hole, most):
    a = sites(s, d)
    return spatial.neighbourhoods(a, a, per_hole, most, 1500.0, radius=1500.0)


def whole(s, d, estimator):
    """All sites as targets, without a radius; at least 4 samples as the reference's plan has it."""
    a = sites(s, d)
    near = spatial.neighbourhoods(a, a, 2, 8, 1500.0)
    return spatial.with_uninformed(a, estimator(near), near, 4)


PAIRS = f"WITH {SITES}, pairs AS (SELECT a.id AS target, b.hole, b.id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS distance, b.value FROM sites a JOIN sites b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1500), capped AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY target, hole ORDER BY distance, id) <= 2), near AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, id) AS nth FROM capped QUALIFY row_number() OVER (PARTITION BY target ORDER BY distance, id) <= 8)"

ALL = PAIRS.replace(" AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1500", "") + ", met AS (SELECT target, count(*) AS samples, count(DISTINCT hole) AS holes, coalesce(avg(value) FILTER (distance = 0), sum(value / distance ** 2) FILTER (distance > 0) / sum(1 / distance ** 2) FILTER (distance > 0)) AS blend, min(value) FILTER (nth = 1) AS nearest FROM near GROUP BY 1 HAVING count(*) >= 4)"
EACH = "SELECT s.id AS target, coalesce(samples, 0) AS samples, coalesce(holes, 0) AS holes, {} AS estimate, CASE WHEN samples IS NULL THEN 'uninformed' ELSE 'estimated' END AS status FROM sites s LEFT JOIN met ON met.target = s.id"


def forecasts(s, d):
    e = read(s, d, "embeddings").where(F.size("embedding") > 8)
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("truth"), F.transform(F.slice("embedding", 2, 8), lambda x: x.cast("double")).alias("members"))


def estimates(s, d):
    return read(s, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_orderkey").alias("hole"), F.col("l_quantity").alias("truth"), (F.col("l_linenumber") * 8.0).alias("estimate"))


def variogram(s, d):
    a = samples(s, d).select("hole", F.col("sample").alias("id"), ((F.col("from_md") + F.col("to_md")) / 2).alias("depth"), F.col("value"))
    return spatial.downhole_variogram(a, 25.0, 6).select("bin", "pairs", F.round(F.col("gamma") / 1e6, 4).alias("gamma"))


QUERIES = {
    "j8_only_neighbour": lambda s, d: spatial.only_neighbour(sites(s, d), sites(s, d), 120.0),
    "w4_capped_neighbours": lambda s, d: near(s, d, 2, 8).select("target", "hole", "id", F.round("distance", 6).alias("distance"), "nth"),
    "t9_inverse_distance": lambda s, d: spatial.inverse_distance(near(s, d, 2, 8)).withColumn("estimate", F.round("estimate", 4)),
    "t9_nearest": lambda s, d: near(s, d, 1, 1).select("target", F.col("value").alias("estimate")),
    "t9_inverse_distance_all": lambda s, d: whole(s, d, spatial.inverse_distance).withColumn("estimate", F.round("estimate", 4)),
    "t9_nearest_all": lambda s, d: whole(s, d, lambda near: near.where("nth = 1").select("target", F.col("value").alias("estimate"))),
    "t9_ordinary_kriging": lambda s, d: whole(s, d, lambda near: spatial.ordinary_kriging(near, 1.0, 2000.0, 0.1)),
    "a15_declustered_mean": lambda s, d: spatial.declustered_mean(sites(s, d), 500.0).select(F.round("declustered", 4).alias("declustered"), "offsets"),
    "a16_downhole_variogram": variogram,
    "a19_error_scores": lambda s, d: scores.error_scores(estimates(s, d), ["method"]).select("method", "n", "holes", *(F.round(c, 6).alias(c) for c in ("bias", "mae", "rmse", "p50", "p90"))),
    "a21_fair_crps": lambda s, d: forecasts(s, d).select("vec_id", F.round(scores.fair_crps(F.col("truth"), F.col("members")), 6).alias("crps")),
    "a23_brier": lambda s, d: read(s, d, "labels").select(scores.brier(F.lit(0.7), F.col("quality")).alias("b"), scores.log_score(F.lit(0.7), F.col("quality")).alias("l")).agg(F.round(F.avg("b"), 9).alias("brier"), F.round(F.avg("l"), 9).alias("log_score")),
    "a25_quantiles": lambda s, d: ranks.quantiles(samples(s, d), ["analyte"], "value", {f"p{round(q * 100)}": q for q in (0.1, 0.25, 0.5, 0.75, 0.9)}).select("analyte", *(F.round(f"p{q}", 4).alias(f"p{q}") for q in (10, 25, 50, 75, 90))),
    "a26_quantile_higher": lambda s, d: scores.quantile_higher(read(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9),
    "a43_weighted_deciles": lambda s, d: scores.weighted_deciles(read(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"),
    "t1_minimum_curvature": lambda s, d: geometry.minimum_curvature(stations(s, d)).select("hole", "md", *(F.round(c, 5).alias(c) for c in ("dogleg", "x", "y", "z"))),
    "t12_grid_components": lambda s, d: spatial.grid_components(read(s, d, "lineitem").select(F.lit(1).cast("long").alias("realization"), F.col("l_returnflag").alias("category"), (F.col("l_partkey") % 12).alias("i"), (F.col("l_suppkey") % 12).alias("j"), F.col("l_linenumber").cast("long").alias("k"))),
}
ORACLES = {
    "j8_only_neighbour": f"WITH {SITES} SELECT a.id, count(b.id) AS neighbours, CASE WHEN count(b.id) = 1 THEN min(b.id) END AS id_2 FROM sites a LEFT JOIN sites b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 120 GROUP BY 1",
    "w4_capped_neighbours": PAIRS + " SELECT target, hole, id, round(distance, 6) AS distance, CAST(nth AS INTEGER) AS nth FROM near",
    "t9_inverse_distance": PAIRS + " SELECT target, count(*) AS samples, count(DISTINCT hole) AS holes, round(coalesce(avg(value) FILTER (distance = 0), sum(value / distance ** 2) FILTER (distance > 0) / sum(1 / distance ** 2) FILTER (distance > 0)), 4) AS estimate FROM near GROUP BY 1",
    "t9_nearest": PAIRS + " SELECT target, value AS estimate FROM near WHERE nth = 1",
    "t9_inverse_distance_all": f"{ALL} {EACH.format('round(blend, 4)')}",
    "t9_nearest_all": f"{ALL} {EACH.format('nearest')}",
    "a15_declustered_mean": f"WITH {SITES}, cells AS (SELECT o, floor((x + o * 125.0) / 500) AS cx, floor((y + o * 125.0) / 500) AS cy, avg(value) AS m FROM sites, range(4) t(o) GROUP BY ALL) SELECT round(avg(m), 4) AS declustered, count(*) AS offsets FROM (SELECT o, avg(m) AS m FROM cells GROUP BY 1)",
    "a19_error_scores": "SELECT l_returnflag AS method, count(*) AS n, count(DISTINCT l_orderkey) AS holes, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS p50, round(quantile_cont(abs(e), 0.9), 6) AS p90 FROM (SELECT *, l_linenumber * 8.0::DOUBLE - l_quantity AS e FROM lineitem) GROUP BY 1",
    "a21_fair_crps": "SELECT vec_id, round((SELECT avg(abs(CAST(m AS DOUBLE) - CAST(embedding[1] AS DOUBLE))) FROM unnest(embedding[2:9]) t(m)) - (SELECT sum(abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE))) FROM unnest(embedding[2:9]) t(a), unnest(embedding[2:9]) u(b)) / (2 * 8 * 7), 6) AS crps FROM embeddings WHERE len(embedding) > 8",
    "a23_brier": "SELECT round(avg((0.7 - quality) ** 2), 9) AS brier, round(avg(-(quality * ln(0.7) + (1 - quality) * ln(1 - 0.7))), 9) AS log_score FROM labels",
    "a25_quantiles": "SELECT l_returnflag AS analyte, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM lineitem GROUP BY 1",
    "a26_quantile_higher": "SELECT l_returnflag, l_extendedprice AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS nth, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE nth = ceil(0.9 * (n - 1))",
    "a43_weighted_deciles": "SELECT l_returnflag, CAST(decile AS INTEGER) AS decile, min(l_extendedprice) AS value FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS share FROM lineitem), range(1, 10) t(decile) WHERE share * 10 >= decile GROUP BY 1, 2",
    "t1_minimum_curvature": f"""WITH {STATIONS}, t AS (SELECT hole, md, sin(radians(azimuth)) * cos(radians(dip)) AS e, cos(radians(azimuth)) * cos(radians(dip)) AS n, sin(radians(dip)) AS u FROM stations),
p AS (SELECT *, lag(md) OVER w AS m0, lag(e) OVER w AS e0, lag(n) OVER w AS n0, lag(u) OVER w AS u0 FROM t WINDOW w AS (PARTITION BY hole ORDER BY md)),
a AS (SELECT *, acos(least(1.0, greatest(-1.0, e * e0 + n * n0 + u * u0))) AS angle FROM p), h AS (SELECT *, (md - m0) * CASE WHEN angle < 1e-6 THEN 0.5 WHEN angle < 3.141592 THEN tan(angle / 2) / angle END AS f FROM a)
SELECT hole, md, round(degrees(angle), 5) AS dogleg, round(sum(coalesce(f * (e + e0), 0)) OVER w, 5) AS x, round(sum(coalesce(f * (n + n0), 0)) OVER w, 5) AS y, round(sum(coalesce(f * (u + u0), 0)) OVER w, 5) AS z FROM h WINDOW w AS (PARTITION BY hole ORDER BY md ROWS UNBOUNDED PRECEDING)""",
    "a16_downhole_variogram": "WITH " + SAMPLES + ", a AS (SELECT hole, sample, (from_md + to_md) / 2 AS depth, value FROM samples), p AS (SELECT round_even(abs(a.depth - b.depth) / 25, 0) AS bin, (a.value - b.value) ** 2 AS q FROM a JOIN a b ON a.hole = b.hole AND a.sample < b.sample) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS pairs, round(avg(q) / 2 / 1e6, 4) AS gamma FROM p WHERE bin BETWEEN 1 AND 6 GROUP BY 1",
}
