"""Evaluation queries: scores, convergence, choices, bases, variograms by direction, methods side by side."""

from pyspark.sql import functions as F

from stratalake.operators import evaluation as E, scores, spatial

from .numbers import ALL, EACH, estimates, whole
from .views import SITES, read, sites

KNOTS = [(x * 2000.0 - 2000.0, y * 500.0) for x in range(4) for y in range(6)] + [(1e6, 1e6)]


def errors(s, d):
    return read(s, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_orderkey").alias("hole"), F.col("l_quantity").alias("truth"), (F.col("l_linenumber") * 8.0).alias("estimate"), (F.col("l_linenumber") - 1.0).alias("length"))


ERRORS = "errors AS (SELECT l_returnflag AS method, l_orderkey AS hole, l_linenumber * 8.0::DOUBLE - l_quantity AS e, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1.0 ELSE 1.0 END AS w, l_linenumber * 7.0::DOUBLE - l_quantity AS e2 FROM lineitem)"


def ensembles(s, d):
    e = read(s, d, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("truth"), F.transform(F.slice("embedding", F.lit(2), F.when(F.col("vec_id") % 3 == 0, 16).otherwise(40)), lambda x: x.cast("double")).alias("members"))


def ensemble_sql(m):
    return f"""SELECT {m} AS realizations, count(*) AS targets, round(sqrt(avg((list_avg(v) - t) ** 2)), 6) AS rmse, round(avg(list_avg(list_transform(v, lambda x: abs(x - t))) - (SELECT sum(abs(a - b)) FROM unnest(v) x(a), unnest(v) y(b)) / (2 * {m} * ({m} - 1))), 6) AS crps,
  round(avg(CASE WHEN list_aggregate(v, 'quantile_cont', 0.1) <= t AND t <= list_aggregate(v, 'quantile_cont', 0.9) THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage
  FROM (SELECT CAST(embedding[1] AS DOUBLE) AS t, list_transform(embedding[2:{m + 1}], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE {m} <= 16 OR vec_id % 3 <> 0) GROUP BY ALL"""


def reviews(s, d):
    return read(s, d, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 3 == 0).alias("altered"), F.col("value").alias("score"))


def trials(s, d):
    return read(s, d, "orders").select((F.col("o_orderkey") % 12).alias("configuration"), F.col("o_custkey").alias("seed"), (F.col("o_orderkey") % 12 % 5).alias("parameters"), F.round(F.col("o_totalprice") / 1e5).alias("objective"))


def history(s, d):
    return read(s, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("run"), (F.col("l_partkey") % 50).alias("epoch")).agg(F.min("l_extendedprice").alias("loss"))


HISTORY = "history AS (SELECT l_suppkey % 20 AS run, l_partkey % 50 AS epoch, min(l_extendedprice) AS loss FROM lineitem GROUP BY ALL)"


def registrations(s, d):
    n = F.col("l_linenumber")
    return read(s, d, "lineitem").select(F.col("l_suppkey").alias("hole"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity")).alias("own"), F.when(n % 2 == 0, F.col("l_quantity")).when(n == 5, F.col("l_quantity") + F.when(F.col("l_suppkey") % 2 == 0, 1.0).otherwise(0.0)).alias("embedded"))


def fields(s, d):
    line = read(s, d, "lineitem")
    cell = (F.col("l_partkey") % 200).alias("cell")
    truth = line.groupBy(cell).agg(F.min("l_returnflag").alias("category"))
    return truth, line.select(F.col("l_suppkey").alias("realization"), cell, F.col("l_returnflag").alias("category")), line.where("l_linenumber = 7 AND l_quantity > 40").select(cell)


FIELDS = "cells AS (SELECT l_partkey % 200 AS cell, * FROM lineitem), truth AS (SELECT cell, min(l_returnflag) AS category FROM cells GROUP BY 1), hard AS (SELECT DISTINCT cell FROM cells WHERE l_linenumber = 7 AND l_quantity > 40)"


def variograms(s, d):
    return spatial.spatial_variograms(sites(s, d), 300.0, 5, bandwidth=900.0).select("direction", "bin", "pairs", F.round(F.col("gamma") / 1e3, 4).alias("gamma"))


DIRECTED = f"""WITH {SITES}, p AS (SELECT a.value - b.value AS dv, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h FROM sites a JOIN sites b ON a.id < b.id),
q AS (SELECT *, CAST(round_even(h / 300, 0) AS BIGINT) AS bin FROM p WHERE h <= 1650), r AS (SELECT * FROM q WHERE bin BETWEEN 1 AND 5),
u AS (SELECT 'omni' AS direction, bin, dv FROM r UNION ALL SELECT concat('azimuth-', z), bin, dv FROM r, (VALUES (0), (45), (90), (135)) t(z)
  WHERE h > 0 AND abs(dx * sin(radians(z)) + dy * cos(radians(z))) >= h * cos(radians(22.5)) AND abs(dx * cos(radians(z)) - dy * sin(radians(z))) <= 900)
SELECT direction, bin, count(*) AS pairs, round(avg(dv * dv) / 2 / 1e3, 4) AS gamma FROM u GROUP BY ALL"""


def cellular(s, d):
    return read(s, d, "lineitem").where("l_quantity <= 12").select((F.col("l_orderkey") % 2).alias("realization"), F.col("l_returnflag").alias("category"), (F.col("l_partkey") % 12).alias("i"), (F.col("l_suppkey") % 12).alias("j"), F.col("l_linenumber").cast("long").alias("k"))


def connections(s, d):
    holes = s.range(6).select(F.col("id").alias("hole"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k")).select("hole", F.struct((F.col("hole") * 2).alias("i"), (F.col("hole") * 5 % 12).alias("j"), F.col("k").cast("long").alias("k")).alias("node"))
    return spatial.hole_connections(spatial.labelled_cells(cellular(s, d)), holes)


REACH = """cells AS (SELECT DISTINCT {} AS realization, l_returnflag AS category, l_partkey % 12 AS i, l_suppkey % 12 AS j, l_linenumber AS k FROM lineitem {}), nodes AS (SELECT realization, category, i * 10000 + j * 100 + k AS n FROM cells),
edges AS (SELECT a.realization, a.category, a.n AS a, b.n AS b FROM nodes a JOIN (SELECT realization, category, n, unnest([n - 1, n + 1, n - 100, n + 100, n - 10000, n + 10000]) AS m FROM nodes) b ON a.realization = b.realization AND a.category = b.category AND a.n = b.m),
reach AS (SELECT realization, category, n AS o, n FROM nodes UNION SELECT r.realization, r.category, r.o, e.b FROM reach r JOIN edges e ON e.realization = r.realization AND e.category = r.category AND e.a = r.n),
labels AS (SELECT realization, category, n, min(o) AS label FROM reach GROUP BY ALL)"""

BASIS = ", ".join(f"({x}, {y})" for x, y in KNOTS)
QUERIES = {
    "a19_weighted_scores": lambda s, d: E.weighted_scores(errors(s, d), ["method"]).select("method", "n", *(F.round(c, 6).alias(c) for c in ("bias", "mae", "rmse", "hole_rmse"))),
    "a20_paired_difference": lambda s, d: E.paired_difference(errors(s, d).select("method", "hole", (F.col("estimate") - F.col("truth")).alias("error_a"), (F.col("estimate") / 8 * 7 - F.col("truth")).alias("error_b")), ["method"]).withColumn("difference", F.round("difference", 6)),
    "a24_convergence": lambda s, d: E.convergence(ensembles(s, d)).select("realizations", "targets", *(F.round(c, 6).alias(c) for c in ("rmse", "crps", "coverage"))),
    "a44_review_metrics": lambda s, d: E.review_metrics(reviews(s, d), 50.0).select("kind", "altered", F.round("recall", 6).alias("recall"), F.round("false_flags", 6).alias("false_flags")),
    "a41_chosen_configuration": lambda s, d: E.chosen_configuration(trials(s, d)).withColumn("objective", F.round("objective", 9)),
    "w8_stopping": lambda s, d: E.stopping(history(s, d), 6),
    "g13_value_summary": lambda s, d: E.value_summary(registrations(s, d), ["hole"], "embedded").withColumn("mean", F.round("mean", 6)),
    "a39_registration": lambda s, d: E.registration(registrations(s, d), 0.95).withColumn("share", F.round("share", 6)),
    "j14_informed_cells": lambda s, d: E.informed_share(*fields(s, d)).withColumn("agreement", F.round("agreement", 6)),
    "g14_basement_share": lambda s, d: read(s, d, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy("l_linestatus").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("share")),
    "a16_spatial_variograms": variograms,
    "a27_semivariance": lambda s, d: spatial.spatial_variograms(sites(s, d), 300.0, 5).where("direction = 'omni'").select("bin", "pairs", F.round(F.col("gamma") / 1e3, 4).alias("gamma")),
    "a30_neighbour_scale": lambda s, d: spatial.neighbour_summary(spatial.neighbourhoods(sites(s, d), sites(s, d), 2, 8, 2000.0, radius=2000.0, other_holes=True), 3).withColumn("scale", F.round("scale", 6)),
    "j12_other_holes": lambda s, d: spatial.neighbourhoods(sites(s, d), sites(s, d), 2, 8, 2000.0, radius=2000.0, other_holes=True).select("target", "hole", "id", F.round("distance", 6).alias("distance"), "nth"),
    "t12_components": lambda s, d: spatial.grid_components(cellular(s, d)),
    "j15_hole_connections": connections,
    "t20_knot_basis": lambda s, d: sites(s, d).select("id", E.knot_basis(F.col("x"), F.col("y"), KNOTS, 4000.0).alias("basis")).select("id", F.size("basis").alias("knots"), F.size(F.filter("basis", lambda b: b > 0)).alias("live"), F.round(F.aggregate("basis", F.lit(0.0), lambda a, b: a + b), 6).alias("total")),
    "t14_methods": lambda s, d: whole(s, d, spatial.inverse_distance).select(F.lit("inverse-distance").alias("method"), "target", F.round("estimate", 4).alias("estimate"), "status").unionByName(whole(s, d, lambda near: near.where("nth = 1").select("target", F.col("value").alias("estimate"))).select(F.lit("nearest-neighbour").alias("method"), "target", "estimate", "status")),
    "g12_index_scores": lambda s, d: scores.error_scores(errors(s, d).join(read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("hole")), "hole", "left_semi"), ["method"]).select("method", "n", "holes", *(F.round(c, 6).alias(c) for c in ("bias", "mae", "rmse"))),
    "t9_simple_kriging": lambda s, d: whole(s, d, lambda near: spatial.kriging(near, 1.0, 2000.0, 0.1, "simple", 4500.0)),
    "t9_universal_kriging": lambda s, d: whole(s, d, lambda near: spatial.kriging(near, 1.0, 2000.0, 0.1, "universal")),
    "p26_inside_grid": lambda s, d: sites(s, d).select("id", F.floor((F.col("x") - 0.0) / 250.0).alias("i"), ((F.col("x") >= 0) & (F.col("x") < 250.0 * 20)).alias("inside")),
}
ORACLES = {
    "a19_weighted_scores": f"WITH {ERRORS}, h AS (SELECT method, hole, sqrt(avg(e * e)) AS own FROM errors GROUP BY ALL) SELECT method, n, bias, mae, rmse, hole_rmse FROM (SELECT method, count(*) AS n, round(sum(w * e) / sum(w), 6) AS bias, round(sum(w * abs(e)) / sum(w), 6) AS mae, round(sqrt(sum(w * e * e) / sum(w)), 6) AS rmse FROM errors GROUP BY 1) JOIN (SELECT method, round(avg(own), 6) AS hole_rmse FROM h GROUP BY 1) USING (method)",
    "a20_paired_difference": f"WITH {ERRORS} SELECT method, count(*) AS n, count(DISTINCT hole) AS holes, round(avg(abs(e) - abs(e2)), 6) AS difference FROM errors GROUP BY 1",
    "a24_convergence": " UNION ALL ".join(map(ensemble_sql, (8, 16, 32))),
    "a44_review_metrics": "SELECT event_type AS kind, count(*) FILTER (event_id % 3 = 0) AS altered, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) FILTER (event_id % 3 = 0), 6) AS recall, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) FILTER (event_id % 3 <> 0), 6) AS false_flags FROM events GROUP BY 1",
    "a41_chosen_configuration": "SELECT round(avg(round(o_totalprice / 1e5)), 9) AS objective, o_orderkey % 12 % 5 AS parameters, o_orderkey % 12 AS configuration FROM orders GROUP BY 2, 3 ORDER BY avg(round(o_totalprice / 1e5)), 2, 3 LIMIT 1",
    "w8_stopping": f"""WITH {HISTORY}, l AS (SELECT *, min((loss, epoch)) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS low FROM history), m AS (SELECT run, epoch, low[2] AS best FROM l),
s AS (SELECT run, min(epoch) FILTER (epoch - best >= 6) AS a, max(epoch) AS z FROM m GROUP BY 1) SELECT m.run, best, epoch AS stopped FROM m JOIN s ON s.run = m.run AND epoch = coalesce(a, z)""",
    "g13_value_summary": "WITH r AS (SELECT l_suppkey AS hole, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity WHEN l_linenumber = 5 THEN l_quantity + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END END AS v FROM lineitem) SELECT hole, count(v) AS n, min(v) AS low, quantile_cont(v, 0.5) AS middle, max(v) AS high, round(avg(v), 6) AS mean FROM r GROUP BY 1",
    "a39_registration": """WITH r AS (SELECT l_suppkey AS hole, CASE WHEN l_suppkey % 7 <> 0 THEN l_quantity END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity WHEN l_linenumber = 5 THEN l_quantity + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END END AS b FROM lineitem),
g AS (SELECT hole, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) FILTER (a IS NOT NULL AND b IS NOT NULL) AS share FROM r GROUP BY 1)
SELECT hole, compared, round(share, 6) AS share, CASE WHEN compared = 0 THEN 'unregistered' WHEN share >= 0.95 THEN 'confirmed' ELSE 'conflicting' END AS status FROM g""",
    "j14_informed_cells": f"WITH {FIELDS} SELECT cell IN (SELECT cell FROM hard) AS informed, count(DISTINCT cell) AS cells, round(avg(CASE WHEN l_returnflag = category THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM cells JOIN truth USING (cell) GROUP BY 1",
    "g14_basement_share": "SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1",
    "a16_spatial_variograms": DIRECTED,
    "a27_semivariance": f"WITH {SITES}, p AS (SELECT a.value - b.value AS dv, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h FROM sites a JOIN sites b ON a.id < b.id), q AS (SELECT dv, CAST(round_even(h / 300, 0) AS BIGINT) AS bin FROM p WHERE h <= 1650) SELECT bin, count(*) AS pairs, round(avg(dv * dv) / 2 / 1e3, 4) AS gamma FROM q WHERE bin BETWEEN 1 AND 5 GROUP BY 1",
    "p26_inside_grid": f"WITH {SITES} SELECT id, CAST(floor(x / 250) AS BIGINT) AS i, x >= 0 AND x < 5000 AS inside FROM sites",
    "t12_components": f"WITH RECURSIVE {REACH.format('l_orderkey % 2', 'WHERE l_quantity <= 12')}, s AS (SELECT realization, category, label, count(*) AS cells FROM labels GROUP BY ALL) SELECT realization, category, row_number() OVER (PARTITION BY realization, category ORDER BY cells DESC, label) - 1 AS cluster, cells FROM s",
    "t12_grid_components": f"WITH RECURSIVE {REACH.format('1', '')}, s AS (SELECT realization, category, label, count(*) AS cells FROM labels GROUP BY ALL) SELECT realization, category, row_number() OVER (PARTITION BY realization, category ORDER BY cells DESC, label) - 1 AS cluster, cells FROM s",
    "j15_hole_connections": f"""WITH RECURSIVE {REACH.format('l_orderkey % 2', 'WHERE l_quantity <= 12')}, holes AS (SELECT h AS hole, h * 2 * 10000 + h * 5 % 12 * 100 + k AS n FROM range(6) t(h), range(1, 8) u(k)), own AS (SELECT DISTINCT realization, category, label, hole FROM labels JOIN holes USING (n)),
met AS (SELECT DISTINCT a.realization, a.category, a.hole, b.hole AS hole_2 FROM own a JOIN own b ON a.realization = b.realization AND a.category = b.category AND a.label = b.label AND a.hole < b.hole)
SELECT category, hole, hole_2, count(*) / (SELECT count(DISTINCT realization) FROM labels) AS share FROM met GROUP BY ALL""",
    "t20_knot_basis": f"WITH {SITES}, b AS (SELECT id, greatest(1 - sqrt((x - kx) ** 2 + (y - ky) ** 2) / 4000, 0) AS u, sqrt((x - kx) ** 2 + (y - ky) ** 2) / 4000 AS r FROM sites, (VALUES {BASIS}) k(kx, ky)) SELECT id, count(*) AS knots, count(*) FILTER (u > 0) AS live, round(sum(u ** 6 * (35 * r * r + 18 * r + 3) / 3), 6) AS total FROM b GROUP BY 1",
    "t14_methods": f"{ALL}, a AS ({EACH.format('round(blend, 4)')}), b AS ({EACH.format('nearest')}) SELECT 'inverse-distance' AS method, target, estimate, status FROM a UNION ALL SELECT 'nearest-neighbour', target, estimate, status FROM b",
    "g12_index_scores": f"WITH {ERRORS} SELECT method, count(*) AS n, count(DISTINCT hole) AS holes, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM errors WHERE hole IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
}
OTHERS = f"WITH {SITES}, pairs AS (SELECT a.id AS target, b.hole, b.id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS distance FROM sites a JOIN sites b ON a.id <> b.id AND a.hole <> b.hole AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2000), capped AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY target, hole ORDER BY distance, id) <= 2), near AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, id) AS nth FROM capped QUALIFY nth <= 8)"
ORACLES["j12_other_holes"] = f"{OTHERS} SELECT target, hole, id, round(distance, 6) AS distance, CAST(nth AS INTEGER) AS nth FROM near"
ORACLES["a30_neighbour_scale"] = f"{OTHERS} SELECT target, count(*) AS samples, count(DISTINCT hole) AS holes, round(quantile_cont(distance, 0.5), 6) AS scale FROM near GROUP BY 1 HAVING count(DISTINCT hole) >= 3"
