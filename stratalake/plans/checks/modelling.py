"""Queries of model fits, normal scores, indicator kriging, resampling, surfaces and graphs."""

from pyspark.sql import functions as F

from stratalake.operators import evaluation, modelling as M, ranks, records, spatial

from .numbers import ALL
from .views import SITES, read, sites

MODELS = {1000.0: (0.2, 2000.0, 0.02), 4000.0: (0.25, 2000.0, 0.02), 7000.0: (0.2, 2000.0, 0.02)}


def near(s, d):
    a = sites(s, d)
    return spatial.neighbourhoods(a, a, 2, 8, 1500.0)


def gammas(s, d):
    found = spatial.spatial_variograms(sites(s, d), 300.0, 8)
    return found.select("direction", (F.col("bin") * 300.0).alias("distance"), "pairs", (F.col("gamma") / 1e6).alias("gamma"))


def cross_gammas(s, d):
    """Two variables of a site and their sum, by omnidirectional bins."""
    a = sites(s, d).withColumn("other", F.pmod(F.col("id") * 37, F.lit(101)).cast("double"))
    rows = None
    for i, j, value in (("a", "a", F.col("value") / 1000), ("b", "b", F.col("other") / 10), ("s", "s", F.col("value") / 1000 + F.col("other") / 10)):
        one = spatial.spatial_variograms(a.withColumn("value", value), 300.0, 6).where("direction = 'omni'").select(F.lit(i).alias("a"), F.lit(j).alias("b"), "bin", "pairs", "gamma")
        rows = one if rows is None else rows.unionByName(one)
    whole = rows.groupBy("bin").agg(F.first("pairs").alias("pairs"), *(F.sum(F.when(F.col("a") == k, F.col("gamma"))).alias(k) for k in "abs"))
    cross = whole.select("bin", "pairs", F.explode(F.array(*(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), g.alias("gamma")) for i, j, g in (("a", "a", F.col("a")), ("b", "b", F.col("b")), ("a", "b", (F.col("s") - F.col("a") - F.col("b")) / 2))))).alias("x"))
    return cross.select("x.a", "x.b", (F.col("bin") * 300.0).alias("distance"), "pairs", "x.gamma")


def scored(s, d):
    return ranks.normal_scores(read(s, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", "value", "n", F.round("score", 6).alias("score"))


def normal_sql(p):
    def ratio(x, form):
        return "/".join("(" + "".join("(" for _ in side[1:]) + repr(side[0]) + "".join(f" * {x} + {c!r}::DOUBLE)" for c in side[1:]) + ")" for side in form)

    low, t = ranks.TAIL_SHARE, "sqrt(-2 * ln({}))"
    return f"CASE WHEN {p} < {low} THEN {ratio(t.format(p), ranks.TAIL)} WHEN {p} > {1 - low} THEN -({ratio(t.format(f'1 - {p}'), ranks.TAIL)}) ELSE ({p} - 0.5) * {ratio(f'(({p} - 0.5) * ({p} - 0.5))', ranks.CENTRE)} END"


def cells(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0 + 1).alias("y"))


def errors(s, d):
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("hole"), (F.col("l_linenumber") * 8.0 - F.col("l_quantity")).alias("error_a"), (F.col("l_linenumber") * 7.0 - F.col("l_quantity")).alias("error_b"))


def interval(s, d):
    found = M.bootstrap_difference(errors(s, d), 400)
    return found.agg(F.count("*").alias("replicates"), F.avg("difference").alias("mean"), F.percentile("difference", 0.025).alias("low"), F.percentile("difference", 0.975).alias("high"))


def scored_estimates(s, d):
    return read(s, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_orderkey").alias("hole"), F.col("l_quantity").alias("truth"), (F.col("l_linenumber") * 8.0).alias("estimate"), (F.col("l_linenumber") - 1.0).alias("length"))


def chances(s, d):
    """Three categories a line, with chances by its line number."""
    flags = ["A", "N", "R"]
    p = [F.lit(0.2), F.col("l_linenumber") / 10.0, F.lit(0.8) - F.col("l_linenumber") / 10.0]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("category"), x.alias("probability")) for f, x in zip(flags, p)))).alias("x")
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(s, d, "lineitem").select(line.alias("target"), F.col("l_returnflag").alias("truth"), each).select("target", "truth", "x.category", "x.probability")


def pairs_of_variables(s, d):
    """Neighbours of every site: its capped neighbours' values as variable 0, a second variable at the same places."""
    a = near(s, d).select("target", "tx", "ty", "id", "x", "y", (F.col("value") / 1000).alias("value"))
    return a.withColumn("variable", F.lit(0)).unionByName(a.where("id % 2 = 0").withColumn("value", F.pmod(F.col("id") * 37, F.lit(101)) / 10.0).withColumn("variable", F.lit(1)))


PLANS = {"base": {"per_hole": 2, "most": 8}, "small": {"per_hole": 1, "most": 4}, "large": {"per_hole": 4, "most": 16}, "sparse": {"per_hole": 2, "most": 8, "every": 2}}

QUERIES = {
    "t9_cokriging": lambda s, d: M.cokriging(pairs_of_variables(s, d), [("spherical", 2000.0, [[6.0, 1.0], [1.0, 5.0]])], [[0.5, 0.1], [0.1, 0.5]]),
    "t15_variants": lambda s, d: M.variants(sites(s, d), sites(s, d), PLANS, 1500.0, (1.0, 2000.0, 0.1)),
    "t33_evaluation_table": lambda s, d: evaluation.evaluation_table(scored_estimates(s, d), ["method"]).withColumn("value", F.round("value", 6)),
    "t34_categorical_evaluation": lambda s, d: evaluation.categorical_evaluation(chances(s, d)).select("category", "n", *(F.round(c, 9).alias(c) for c in ("brier", "log_score", "reference", "skill")), "hits"),
    "g18_dependent_counts": lambda s, d: records.dependent_counts(read(s, d, "customer").select(F.col("c_custkey").alias("hole")), {"orders": read(s, d, "orders").select(F.col("o_custkey").alias("hole")), "events": read(s, d, "events").select(F.col("user_id").alias("hole"))}),
    "p23_normal_scores": scored,
    "g8_neighbour_diagnostics": lambda s, d: M.neighbour_diagnostics(near(s, d)),
    "t22_graph_edges": lambda s, d: M.graph_edges(near(s, d)).withColumn("weight", F.round("weight", 9)),
    "t30_collar_surface": lambda s, d: M.collar_surface(cells(s, d), sites(s, d).select("x", "y", F.col("value").alias("z"))).withColumn("z", F.round("z", 4)),
    "t7_variogram_fits": lambda s, d: M.fit_variograms(gammas(s, d), ["direction"]),
    "t8_coregionalization": lambda s, d: M.coregionalization(cross_gammas(s, d), [("spherical", 900.0), ("exponential", 2400.0)]),
    "t10_indicator_kriging": lambda s, d: M.indicator_kriging(near(s, d), MODELS),
    "t13_universal_with_retry": lambda s, d: M.universal_with_retry(sites(s, d), sites(s, d), 1, 3, 1500.0, 1.0, 2000.0, 0.1),
    "a20_bootstrap_interval": interval,
}
EVALUATED = """WITH e AS (SELECT l_returnflag AS method, l_orderkey AS hole, l_linenumber * 8.0::DOUBLE - l_quantity AS e, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1.0::DOUBLE ELSE 1 END AS w FROM lineitem),
h AS (SELECT method, avg(r) AS r FROM (SELECT method, hole, sqrt(avg(e * e)) AS r FROM e GROUP BY ALL) GROUP BY 1),
t AS (SELECT e.method, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT hole) AS DOUBLE) AS holes, avg(e) AS bias, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, quantile_cont(abs(e), 0.5) AS p50, quantile_cont(abs(e), 0.9) AS p90,
  sum(w * e) / sum(w) AS weighted_bias, sum(w * abs(e)) / sum(w) AS weighted_mae, sqrt(sum(w * e * e) / sum(w)) AS weighted_rmse, any_value(h.r) AS hole_rmse FROM e JOIN h USING (method) GROUP BY 1)
SELECT method, metric, round(value, 6) AS value FROM (UNPIVOT t ON COLUMNS(* EXCLUDE method) INTO NAME metric VALUE value)"""
CHANCES = """WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS target, category, p, CASE WHEN l_returnflag = category THEN 1.0::DOUBLE ELSE 0 END AS o
  FROM (SELECT *, unnest(['A', 'N', 'R']) AS category, unnest([0.2::DOUBLE, l_linenumber / 10.0::DOUBLE, 0.8::DOUBLE - l_linenumber / 10.0::DOUBLE]) AS p FROM lineitem)),
b AS (SELECT category, sum(o) AS hits FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY p DESC, category, o) = 1) GROUP BY 1),
g AS (SELECT category, count(*) AS n, avg((p - o) ** 2) AS brier, avg(-(o * ln(greatest(0.001, least(0.999, p))) + (1 - o) * ln(1 - greatest(0.001, least(0.999, p))))) AS log_score, avg(o) * (1 - avg(o)) AS reference FROM c GROUP BY 1)
SELECT category, n, round(brier, 9) AS brier, round(log_score, 9) AS log_score, round(reference, 9) AS reference, round(1 - brier / reference, 9) AS skill, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM g LEFT JOIN b USING (category)"""
ORACLES = {
    "t33_evaluation_table": EVALUATED,
    "t34_categorical_evaluation": CHANCES,
    "g18_dependent_counts": "SELECT c_custkey AS hole, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer",
    "p23_normal_scores": f"WITH c AS (SELECT l_returnflag, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, (sum(n) OVER (PARTITION BY l_returnflag ORDER BY value) - n / 2) / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM c) SELECT l_returnflag, value, n, round({normal_sql('p')}, 6) AS score FROM p",
    "g8_neighbour_diagnostics": f"{ALL}, g AS (SELECT target, hole, count(*) AS n FROM near GROUP BY ALL) SELECT target, sum(n)::BIGINT AS samples, count(*) AS holes, max(n) AS from_one_hole FROM g GROUP BY 1",
    "t22_graph_edges": f"{ALL}, e AS (SELECT target AS a, id AS b FROM near UNION SELECT id, target FROM near UNION SELECT target, target FROM near UNION SELECT id, id FROM near), g AS (SELECT a, count(*) AS n FROM e GROUP BY 1) SELECT e.a, e.b, round(1 / sqrt(g.n * h.n), 9) AS weight FROM e JOIN g ON g.a = e.a JOIN g h ON h.a = e.b",
    "t30_collar_surface": f"WITH {SITES}, p AS (SELECT c_custkey AS id, value AS z, sqrt((c_acctbal - x) ** 2 + (c_nationkey * 100.0 + 1 - y) ** 2) AS d FROM customer, sites) SELECT id, round(coalesce(avg(z) FILTER (d = 0), sum(z / d ** 2) FILTER (d > 0) / sum(1 / d ** 2) FILTER (d > 0)), 4) AS z FROM p GROUP BY 1",
}
