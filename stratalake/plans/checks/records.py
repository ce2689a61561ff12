"""Queries of predicates, alterations and checks between stages."""

from pyspark.sql import functions as F

from stratalake.operators import records as R
from stratalake.operators.intervals import overlap_length

from .views import LOGS, STATIONS, logs, read, stations

UNITS = ["AF", "NF", "NO", "RF"]


def lines(s, d):
    return read(s, d, "lineitem")


def assays(s, d):
    return lines(s, d).select(F.col("l_orderkey").alias("hole"), (F.col("l_linenumber") % 2).alias("from_md"), F.col("l_suppkey").alias("support"), F.concat("l_returnflag", "l_linestatus").alias("property"), F.floor("l_extendedprice").alias("value"))


def lookup(s, d):
    named = F.transform(F.map_entries("originals"), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string")))
    return R.canonical_lookup(assays(s, d)).select("hole", "from_md", "support", F.array_join(named, ",").alias("originals"))


def blocks(s, d):
    price, length = F.col("l_extendedprice"), F.col("l_quantity")
    mean = F.when(F.col("l_linenumber") != 6, price / length + F.when(F.col("l_linenumber") == 7, 1.0).otherwise(0.0))
    return lines(s, d).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), price.alias("numerator"), length.alias("covered"), F.lit(45.0).alias("length"), mean.alias("mean"))


def supports(s, d):
    k = F.col("event_id") % 4 + 1
    return read(s, d, "events").select(F.col("event_id").alias("id"), F.sequence(F.lit(1), F.when(F.col("event_id") % 7 == 0, k + 1).otherwise(k)).alias("points"), F.transform(F.sequence(F.lit(1), k), lambda i: F.when(F.col("event_id") % 5 == 0, F.lit(2.0)).otherwise(F.lit(1.0)) / k).alias("weights"))


def shares(s, d):
    total = lines(s, d).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    return lines(s, d).where("l_linenumber < 7").join(total, "l_orderkey").select(F.col("l_orderkey").alias("hole"), (F.col("l_quantity") / F.col("total")).alias("share"))


def pieces(s, d):
    at = lambda c, m: (F.col(c) % m).cast("double")
    return lines(s, d).select(at("l_partkey", 500).alias("x"), at("l_suppkey", 90).alias("y"), (at("l_partkey", 500) + 9).alias("x_2"), (at("l_suppkey", 90) - 4).alias("y_2"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("length"))


def unit_logs(s, d):
    return logs(s, d).select("hole", F.col("code").alias("unit"), "from_md", "to_md", F.when(F.col("hole") % 17 != 0, -90.0 + F.col("hole") % 60).alias("dip"))


QUERIES = {
    "p15_interval_faults": lambda s, d: lines(s, d).select((F.col("l_linenumber") * 10 - F.col("l_quantity")).alias("a"), (F.col("l_linenumber") * 10 - 5.0).alias("b")).groupBy(R.interval_fault(F.col("a"), F.col("b")).alias("fault"), R.interval_fault(F.col("a"), F.col("b"), True).alias("log_fault")).agg(F.count("*").alias("n")),
    "p15_station_faults": lambda s, d: stations(s, d).groupBy(R.station_fault(F.col("md") - 15, F.col("dip") * 1.5).alias("fault")).agg(F.count("*").alias("n")),
    "p16_directions": lambda s, d: R.with_direction(stations(s, d)).select("hole", "md", *((F.round(c, 6) + 0.0).alias(c) for c in ("east", "north", "up"))),
    "p17_overlap_lengths": lambda s, d: logs(s, d).select("hole", "sample", overlap_length(F.col("from_md"), F.col("to_md"), F.lit(50.0), F.lit(95.5)).alias("length")),
    "p22_plane_normals": lambda s, d: read(s, d, "events").select("event_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in zip(("east", "north", "up"), R.plane_normal(F.col("event_id") % 90, F.col("event_id") * 7 % 360)))),
    "ad1_zero_rows": lambda s, d: R.quarantine_zero_rows(lines(s, d), ["l_discount", "l_tax"]).groupBy("quarantined").agg(F.count("*").alias("n")),
    "ad1_long_form": lambda s, d: R.long_form(lines(s, d), ["l_orderkey"], ["l_discount", "l_tax"]).groupBy("l_orderkey", "property").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")),
    "ad2_angle_faults": lambda s, d: R.angle_faults(read(s, d, "events").select("event_id", (-(F.col("event_id") % 90)).alias("dip"), (90.0 - F.col("event_id") % 90 + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).alias("inclination"))),
    "g11_canonical_lookup": lookup,
    "t19_alterations": lambda s, d: R.alterations(read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value")), 1200.0, 300.0).withColumn("value", F.round("value", 4)),
    "t32_column_lineage": lambda s, d: R.column_lineage(read(s, d, "nation").select(F.col("n_name").alias("column"), F.col("n_regionkey").alias("digest")), read(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("column"))),
    "a34_unit_thickness": lambda s, d: R.unit_thickness(unit_logs(s, d), UNITS).select("unit", "holes", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation")),
    "a33_mapped_length": lambda s, d: R.mapped_length(pieces(s, d), 25.0),
    "k5_composite_faults": lambda s, d: R.composite_faults(blocks(s, d)),
    "k5_share_faults": lambda s, d: R.share_faults(shares(s, d), ["hole"]).withColumn("total", F.round("total", 9)),
    "k7_incomplete_targets": lambda s, d: R.incomplete_targets(lines(s, d).select(F.col("l_orderkey").alias("target"), F.col("l_returnflag").alias("method")), read(s, d, "orders").select(F.col("o_orderkey").alias("target")), 3),
    "k11_chain_faults": lambda s, d: R.chain_faults(read(s, d, "nation").select(F.col("n_name").alias("stage"), F.col("n_regionkey").alias("source"), (F.col("n_nationkey") % 3).alias("digest")), read(s, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("source"), (F.col("r_regionkey") % 3).alias("digest"))),
    "g25_weight_faults": lambda s, d: R.weight_faults(supports(s, d)),
    "p32_admissible": lambda s, d: R.admissible(read(s, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_totalprice").alias("work")), lines(s, d).select(F.col("l_orderkey").alias("job"), (F.col("l_partkey") % 20).alias("item")), 5, 200000.0),
}
FAULT = "CASE WHEN a < 0 THEN 'depth below 0' WHEN a {} b THEN 'no length' END"
ORACLES = {
    "p15_interval_faults": f"SELECT {FAULT.format('>=')} AS fault, {FAULT.format('>')} AS log_fault, count(*) AS n FROM (SELECT l_linenumber * 10 - l_quantity AS a, l_linenumber * 10 - 5.0::DOUBLE AS b FROM lineitem) GROUP BY ALL",
    "p15_station_faults": f"WITH {STATIONS} SELECT CASE WHEN md < 15 THEN 'depth' WHEN dip < -60 THEN 'dip' END AS fault, count(*) AS n FROM stations GROUP BY 1",
    "p16_directions": f"WITH {STATIONS} SELECT hole, md, round(sin(radians(azimuth)) * cos(radians(dip)), 6) + 0.0 AS east, round(cos(radians(azimuth)) * cos(radians(dip)), 6) + 0.0 AS north, round(sin(radians(dip)), 6) + 0.0 AS up FROM stations",
    "p17_overlap_lengths": f"WITH {LOGS} SELECT hole, CAST(sample AS INTEGER) AS sample, greatest(0.0::DOUBLE, least(to_md, 95.5::DOUBLE) - greatest(from_md, 50.0::DOUBLE)) AS length FROM logs",
    "p22_plane_normals": "SELECT event_id, round(sin(radians(a)) * sin(radians(t)), 6) + 0.0 AS east, round(sin(radians(a)) * cos(radians(t)), 6) + 0.0 AS north, round(cos(radians(a)), 6) + 0.0 AS up FROM (SELECT event_id, event_id % 90 AS a, event_id * 7 % 360 AS t FROM events)",
    "ad1_zero_rows": "SELECT l_discount = 0 AND l_tax = 0 AS quarantined, count(*) AS n FROM lineitem GROUP BY 1",
    "ad1_long_form": "SELECT l_orderkey, property, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT l_orderkey, 'l_discount' AS property, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem) GROUP BY ALL",
    "ad2_angle_faults": "SELECT event_id, -(event_id % 90) AS dip, 91.0::DOUBLE - event_id % 90 AS inclination FROM events WHERE event_id % 50 = 0",
    "g11_canonical_lookup": "WITH a AS (SELECT l_orderkey AS hole, l_linenumber % 2 AS from_md, concat(l_returnflag, l_linestatus) AS p, min(l_suppkey) AS support, max(CAST(floor(l_extendedprice) AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT hole, from_md, min(support) AS support, string_agg(concat(p, '=', v), ',' ORDER BY p) AS originals FROM a GROUP BY 1, 2",
    "t19_alterations": "WITH p AS (SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS v FROM part) " + " UNION ALL ".join([f"SELECT id, '{k}' AS kind, round(v * {f}, 4) AS value FROM p" for k, f in R.FACTORS.items()] + [f"SELECT id, '{k}', round(sinh(asinh((v - 1200) / 300) + {f}) * 300 + 1200, 4) FROM p" for k, f in R.STEPS.items()]),
    "t32_column_lineage": "SELECT n_name AS column, CASE WHEN n_nationkey % 2 = 0 THEN 'described' ELSE 'undescribed' END AS state, count(*) OVER (PARTITION BY n_regionkey) AS copies FROM nation",
    "a34_unit_thickness": f"WITH {LOGS}, h AS (SELECT DISTINCT hole FROM logs WHERE hole % 17 <> 0), t AS (SELECT h.hole, u.unit, coalesce(sum(CASE WHEN l.code = u.unit THEN (to_md - from_md) * abs(sin(radians(-90.0 + h.hole % 60))) END), 0) AS v FROM h JOIN logs l USING (hole), (VALUES {', '.join(f'({u!r})' for u in UNITS)}) u(unit) GROUP BY ALL) SELECT unit, count(*) AS holes, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM t GROUP BY 1",
    "a33_mapped_length": "SELECT CAST(floor((l_partkey % 500 + 4.5) / 25) AS BIGINT) AS cx, CAST(floor((l_suppkey % 90 - 2.0) / 25) AS BIGINT) AS cy, l_returnflag AS category, sum(l_quantity) AS length FROM lineitem GROUP BY ALL",
    "k5_composite_faults": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, f AS fault FROM lineitem, (VALUES ('cover outside the length'), ('mean not conserved'), ('mean missing')) t(f) WHERE f = 'cover outside the length' AND l_quantity > 45 OR f = 'mean not conserved' AND l_linenumber = 7 OR f = 'mean missing' AND l_linenumber = 6",
    "k5_share_faults": "SELECT l_orderkey AS hole, round(sum(CASE WHEN l_linenumber < 7 THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS total FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber >= 7) AND bool_or(l_linenumber < 7)",
    "k7_incomplete_targets": "SELECT o_orderkey AS target, count(l_orderkey) AS predicted FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 3 OR count(DISTINCT l_returnflag) <> 3",
    "k11_chain_faults": "SELECT n_name AS stage, n_regionkey AS source, CASE WHEN n_regionkey >= 4 THEN 'absent' ELSE 'changed' END AS fault FROM nation WHERE n_regionkey >= 4 OR n_nationkey % 3 <> n_regionkey % 3",
    "g25_weight_faults": "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'lengths differ' ELSE 'weights do not sum to 1' END AS fault FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0",
    "p32_admissible": "SELECT o_orderkey AS job, CASE WHEN count(l_orderkey) = 0 THEN 'no items' WHEN count(l_orderkey) > 5 THEN 'too many items' WHEN count(DISTINCT l_partkey % 20) < count(l_orderkey) THEN 'repeated items' WHEN any_value(o_totalprice) > 200000 THEN 'over budget' END AS reason FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
}
