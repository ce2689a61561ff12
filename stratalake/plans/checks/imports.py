"""Import and normalisation queries."""

from pyspark.sql import functions as F

from stratalake.functions import parsing
from stratalake.operators import imports as I, quality

from .views import LOGS, SAMPLES, STATIONS, logs, read, samples, stations

COLUMNS = ["Cu_ppm", "Au_gpt", "Fe_pct", "plain", "W_ozt"]


def tokens(s, d):
    """Written results, of which some are censored, blank or no numbers."""
    e, k = read(s, d, "events"), F.col("event_id") % 7
    number = F.col("event_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("<"), number)).when(k == 1, F.concat(F.lit(" >"), number, F.lit(" "))).when(k == 2, "trace").when(k == 3, F.concat(number, F.lit(",5"))).otherwise(number)
    return e.select(F.col("event_id").alias("id"), raw.alias("raw"), F.element_at(F.array(*map(F.lit, COLUMNS)), (F.col("event_id") % 5 + 1).cast("int")).alias("column"))


TOKENS = """tokens AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN concat('<', event_id) WHEN 1 THEN concat(' >', event_id, ' ') WHEN 2 THEN 'trace' WHEN 3 THEN concat(event_id, ',5') ELSE CAST(event_id AS VARCHAR) END AS raw,
  ['Cu_ppm', 'Au_gpt', 'Fe_pct', 'plain', 'W_ozt'][event_id % 5 + 1] AS "column" FROM events)"""


def states(s, d):
    """Determinations with faults in some."""
    k = F.col("event_id") % 9
    state = F.element_at(F.array(*map(F.lit, ["measured", "censored-below", "censored-above", "not-analysed"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(s, d, "events").select(F.col("event_id").alias("id"), state.alias("state"), F.col("event_id").cast("double").alias("raw_value"), k.alias("k"))
    made = rows.withColumn("d", I.determination(F.col("state"), F.col("raw_value")))
    return made.select("id", "state", F.when(F.col("k") == 3, F.lit(1.0)).otherwise(F.col("d.value")).alias("value"), F.when(F.col("k") == 5, "~").otherwise(F.col("d.qualifier")).alias("qualifier"), F.when(F.col("k") != 7, F.lit(0.5)).alias("limit"), "k")


STATES = """made AS (SELECT event_id AS id, ['measured', 'censored-below', 'censored-above', 'not-analysed'][event_id % 4 + 1] AS state, CAST(event_id AS DOUBLE) AS raw_value, event_id % 9 AS k FROM events),
determined AS (SELECT *, CASE WHEN state = 'measured' THEN raw_value END AS v, CASE state WHEN 'measured' THEN '=' WHEN 'censored-below' THEN '<' WHEN 'censored-above' THEN '>' END AS q FROM made),
states AS (SELECT id, state, CASE WHEN k = 3 THEN 1.0 ELSE v END AS value, CASE WHEN k = 5 THEN '~' ELSE q END AS qualifier, CASE WHEN k <> 7 THEN 0.5::DOUBLE END AS "limit" FROM determined)"""


def supports(s, d):
    k = F.col("event_id") % 6
    kind = F.element_at(F.array(*map(F.lit, ["interval", "point", "sampling-envelope", "unknown"])), (F.col("event_id") % 4 + 1).cast("int"))
    a = F.col("event_id").cast("double")
    return read(s, d, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), F.when(k < 4, a).alias("from_md"), F.when(k < 3, a + 1).when(k == 3, a).alias("to_md"), F.when(k == 4, a).alias("at_md"))


SUPPORTS = """supports AS (SELECT event_id AS id, ['interval', 'point', 'sampling-envelope', 'unknown'][event_id % 4 + 1] AS kind, CASE WHEN event_id % 6 < 4 THEN CAST(event_id AS DOUBLE) END AS from_md,
  CASE WHEN event_id % 6 < 3 THEN event_id + 1.0 WHEN event_id % 6 = 3 THEN event_id END AS to_md, CASE WHEN event_id % 6 = 4 THEN CAST(event_id AS DOUBLE) END AS at_md FROM events)"""


def readings(s, d):
    return read(s, d, "events").select(F.col("user_id").alias("hole"), (F.col("event_id") % 20 * 10.0).alias("md"), (F.col("event_id") * 7 % 4 * 90.0).alias("azimuth"), F.lit(-60.0).alias("dip"))


READINGS = "readings AS (SELECT user_id AS hole, event_id % 20 * 10.0::DOUBLE AS md, (event_id * 7) % 4 * 90.0::DOUBLE AS azimuth, -60.0::DOUBLE AS dip FROM events)"


def collars(s, d):
    key = F.col("c_custkey")
    return read(s, d, "customer").select(key.alias("hole"), F.when(key % 3 != 0, key % 360).cast("double").alias("azimuth"), F.when(key % 3 != 0, F.lit(-60.0)).alias("dip"), F.when(key % 5 != 0, F.lit(150.0)).alias("depth"))


COLLARS = "collars AS (SELECT c_custkey AS hole, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 360 AS DOUBLE) END AS azimuth, CASE WHEN c_custkey % 3 <> 0 THEN -60.0::DOUBLE END AS dip, CASE WHEN c_custkey % 5 <> 0 THEN 150.0::DOUBLE END AS depth FROM customer)"
GROUPS = f"{READINGS}, stations AS (SELECT hole, md, min((azimuth, dip)) AS low, max((azimuth, dip)) AS high, count(*) AS rows FROM readings GROUP BY ALL), found AS (SELECT *, CASE WHEN low <> high THEN 'SURVEY_DEPTH_CONFLICT' WHEN rows > 1 THEN 'RECORD_DUPLICATE' END AS finding FROM stations)"


def decisions(s, d, start, missing):
    found = I.station_groups(readings(s, d).where("hole % 4 <> 1"))
    return I.trajectory_decisions(collars(s, d), found, readings(s, d).groupBy("hole").agg(F.max("md").alias("deepest")), start, missing)


def decided(start, missing):
    undeclared = "FALSE" if start == "tangent" else "first > 0 AND azimuth IS NULL"
    none = "FALSE" if missing == "vertical" else "first IS NULL AND azimuth IS NULL"
    return f"""WITH {GROUPS}, {COLLARS}, s AS (SELECT hole, min(md) AS first, max(md) AS last, bool_or(coalesce(finding = 'SURVEY_DEPTH_CONFLICT', FALSE)) AS conflict FROM found WHERE hole % 4 <> 1 GROUP BY 1),
c AS (SELECT collars.hole, azimuth, coalesce(depth, deepest) AS e, first, last, coalesce(conflict, FALSE) AS conflict FROM collars LEFT JOIN s ON s.hole = collars.hole LEFT JOIN (SELECT hole, max(md) AS deepest FROM readings GROUP BY 1) d ON d.hole = collars.hole),
j AS (SELECT *, coalesce({undeclared}, FALSE) AS undeclared, coalesce({none}, FALSE) AS nothing FROM c),
b AS (SELECT *, conflict OR undeclared OR nothing AS blocked FROM j)
SELECT hole, CASE WHEN blocked THEN NULL WHEN first IS NOT NULL THEN 'measured-stations' WHEN azimuth IS NOT NULL THEN 'collar-orientation' ELSE 'assumed-vertical' END AS kind,
  CASE WHEN blocked OR first IS NULL OR first = 0 THEN 'none' WHEN azimuth IS NOT NULL THEN 'collar' ELSE 'tangent' END AS start, CASE WHEN NOT blocked THEN e END AS valid_to,
  concat_ws(',', CASE WHEN conflict THEN 'SURVEY_DEPTH_CONFLICT' END, CASE WHEN undeclared THEN 'SURVEY_START_UNDECLARED' END, CASE WHEN first > 0 AND azimuth IS NULL AND NOT undeclared THEN 'SURVEY_START_EXTENDED' END,
    CASE WHEN NOT undeclared AND e > last THEN 'SURVEY_TRUNCATED' END, CASE WHEN first IS NULL AND NOT nothing THEN 'SURVEY_ASSUMED' END, CASE WHEN nothing THEN 'SURVEY_MISSING_UNASSUMED' END) AS codes, blocked FROM b"""


def categories(s, d):
    """Logs with a category for some codes."""
    c = F.col("code")
    return logs(s, d).withColumn("category", F.when(c.startswith("A"), "basement").when(c.startswith("R"), "cover"))


CATEGORIES = f"{LOGS}, cats AS (SELECT *, CASE WHEN code LIKE 'A%' THEN 'basement' WHEN code LIKE 'R%' THEN 'cover' END AS category FROM logs)"


def splits(s, d):
    k = F.col("c_custkey") % 10
    rows = read(s, d, "customer").select(F.col("c_custkey").alias("hole"), F.when(k < 6, "train").when(k < 8, "validation").otherwise("test").alias("split"))
    return rows.where("hole % 50 <> 3").union(rows.where("hole % 70 = 1"))


SPLITS = "base AS (SELECT c_custkey AS hole, CASE WHEN c_custkey % 10 < 6 THEN 'train' WHEN c_custkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM customer), splits AS (SELECT * FROM base WHERE hole % 50 <> 3 UNION ALL SELECT * FROM base WHERE hole % 70 = 1)"


def assignments(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("hole"))


def populations(s, d):
    """Rows of a population: samples or composites of one length."""
    from stratalake.operators.intervals import met_composites

    own = samples(s, d).select("hole", "from_md", "to_md", "analyte", "value", F.lit("sample").alias("population"))
    made = met_composites(samples(s, d), 20.0, 0.5).where("status = 'full'").select("hole", F.col("lo").alias("from_md"), F.col("hi").alias("to_md"), "analyte", F.col("mean").alias("value"), F.lit("composite").alias("population"))
    return own.unionByName(made)


QUERIES = {
    "p1_decimal_comma": lambda s, d: tokens(s, d).select("id", I.decimal_number(F.col("raw"), ",", ("14",)).alias("value")),
    "p3_simple_token": lambda s, d: tokens(s, d).select("id", I.simple_token(F.col("raw")).alias("t")).select("id", "t.*"),
    "p4_unit_name": lambda s, d: tokens(s, d).select("id", I.unit_name(F.col("column")).alias("unit")),
    "p8_axes": lambda s, d: read(s, d, "supplier").select("s_suppkey", *(c.alias(n) for c, n in zip(I.axes(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), "north-east"), ("east", "north")))),
    "p13_determinations": lambda s, d: states(s, d).select("id", "state", "value", "qualifier"),
    "p14_record_kinds": lambda s, d: supports(s, d).where("from_md IS NOT NULL").select("id", I.record_kind(F.col("from_md"), F.col("to_md")).alias("record"), I.code_or_null(F.when(F.col("id") % 3 == 0, F.lit("  ")).otherwise(F.col("kind"))).alias("code")),
    "p28_known_codes": lambda s, d: logs(s, d).groupBy("hole").agg(F.collect_set(F.when(F.col("code") == "NO", "-9999").when(F.col("code") == "AF", "").otherwise(F.col("code"))).alias("codes")).select("hole", F.concat_ws(",", I.known_codes(F.col("codes"))).alias("codes")),
    "a4_station_groups": lambda s, d: I.station_groups(readings(s, d)),
    "t6_trajectories_strict": lambda s, d: decisions(s, d, None, None),
    "t6_trajectories_declared": lambda s, d: decisions(s, d, "tangent", "vertical"),
    "k3_support_faults": lambda s, d: I.support_faults(supports(s, d)),
    "k3_determination_faults": lambda s, d: I.determination_faults(states(s, d)),
    "t3_overlay_fragments": lambda s, d: I.overlay_fragments(samples(s, d), logs(s, d)),
    "t25_binding_faults": lambda s, d: I.binding_faults(read(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}),
    "k6_split_faults": lambda s, d: I.membership(splits(s, d), assignments(s, d))[0],
    "k6_membership": lambda s, d: I.membership(splits(s, d), assignments(s, d))[1],
    "w6_tops_and_cover": lambda s, d: I.tops_and_cover(categories(s, d), ["basement"]),
    "p27_positions": lambda s, d: I.above_and_below(categories(s, d), "basement").select("hole", "sample", "before", "after", "between"),
    "t16_population_rows": lambda s, d: populations(s, d).groupBy("population", "analyte").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("to_md") - F.col("from_md")), 3).alias("length")),
    "a9_representatives": lambda s, d: logs(s, d).groupBy("hole", "from_md", "to_md").agg(F.min("sample").alias("sample"), F.count("*").alias("supports")),
    "o7_geometries": lambda s, d: logs(s, d).select("hole", "from_md", "to_md").distinct(),
    "a2_distinct_values": lambda s, d: logs(s, d).groupBy("hole").agg(F.countDistinct("code").alias("codes"), F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("listed")),
    "j1_supported_results": lambda s, d: samples(s, d).select("hole", "sample", "value").join(read(s, d, "orders").select(F.col("o_orderkey").alias("hole"), "o_custkey"), "hole"),
    "j3_confirmed_holes": lambda s, d: read(s, d, "orders").select(F.col("o_orderkey").alias("hole")).join(logs(s, d).where("code = 'RF'").select("hole"), "hole", "left_semi").join(logs(s, d).where("code = 'NO'").select("hole"), "hole", "left_anti"),
    "o5_key_difference": lambda s, d: read(s, d, "customer").select(F.col("c_custkey").alias("key")).subtract(read(s, d, "orders").where("o_orderkey % 9 = 4").select(F.col("o_custkey").alias("key"))),
    "o5_key_intersection": lambda s, d: read(s, d, "customer").select(F.col("c_custkey").alias("key")).intersect(read(s, d, "orders").select(F.col("o_custkey").alias("key"))),
    "o4_all_findings": lambda s, d: I.support_faults(supports(s, d)).select(F.lit("support").alias("role"), "id").unionByName(I.determination_faults(states(s, d)).select(F.lit("determination").alias("role"), "id")).groupBy("role").agg(F.count("*").alias("findings")),
    "g5_members_by_split": lambda s, d: samples(s, d).join(splits(s, d), "hole").groupBy("split", "analyte").agg(F.count("*").alias("rows"), F.countDistinct("hole").alias("holes")),
    "k2_foreign_keys": lambda s, d: quality.orphans(read(s, d, "lineitem").select("l_orderkey", "l_suppkey"), read(s, d, "orders").where("o_orderkey % 9 <> 4"), "l_orderkey", "o_orderkey").groupBy("l_suppkey").agg(F.count("*").alias("rows")),
    "p10_plain_ids": lambda s, d: read(s, d, "part").select("p_partkey", parsing.plain_id(F.concat(F.lit("dh-00"), F.col("p_partkey"), F.lit("_a"))).alias("plain")),
}
LATE = "row_number() OVER (PARTITION BY hole, from_md, to_md ORDER BY sample)"
ORACLES = {
    "p1_decimal_comma": f"WITH {TOKENS} SELECT id, CASE WHEN trim(raw) = '14' THEN NULL ELSE try_cast(replace(trim(raw), ',', '.') AS DOUBLE) END AS value FROM tokens",
    "p3_simple_token": f"""WITH {TOKENS}, t AS (SELECT id, trim(raw) AS x, try_cast(substr(trim(raw), 2) AS DOUBLE) AS rest, try_cast(trim(raw) AS DOUBLE) AS v FROM tokens)
SELECT id, v AS value, CASE WHEN x[1] = '<' THEN 'censored-below' WHEN x[1] = '>' THEN 'censored-above' WHEN v IS NOT NULL THEN 'measured' ELSE 'malformed' END AS state, CASE WHEN x[1] IN ('<', '>') THEN rest END AS "limit" FROM t""",
    "p4_unit_name": f"""WITH {TOKENS} SELECT id, CASE "column" WHEN 'Cu_ppm' THEN 'ppm' WHEN 'Au_gpt' THEN 'gpt' WHEN 'Fe_pct' THEN 'wt%' WHEN 'W_ozt' THEN 'oz/t' ELSE 'plain' END AS unit FROM tokens""",
    "p8_axes": "SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS east, s_acctbal AS north FROM supplier",
    "p13_determinations": f"WITH {STATES} SELECT id, state, value, qualifier FROM states",
    "p14_record_kinds": f"WITH {SUPPORTS} SELECT id, CASE WHEN to_md IS NULL OR to_md = from_md THEN 'event' ELSE 'interval' END AS record, CASE WHEN id % 3 <> 0 THEN kind END AS code FROM supports WHERE from_md IS NOT NULL",
    "p28_known_codes": f"WITH {LOGS} SELECT hole, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (code NOT IN ('NO', 'AF')), '') AS codes FROM logs GROUP BY 1",
    "a4_station_groups": f"WITH {GROUPS} SELECT hole, md, low[1] AS azimuth, low[2] AS dip, rows, finding FROM found",
    "t6_trajectories_strict": decided(None, None),
    "t6_trajectories_declared": decided("tangent", "vertical"),
    "k3_support_faults": f"""WITH {SUPPORTS} SELECT id, kind FROM supports WHERE NOT CASE WHEN kind IN ('interval', 'sampling-envelope') THEN coalesce(from_md >= 0 AND from_md < to_md, FALSE) AND at_md IS NULL
  WHEN kind = 'point' THEN coalesce(at_md >= 0, FALSE) AND from_md IS NULL AND to_md IS NULL ELSE from_md IS NULL AND to_md IS NULL AND at_md IS NULL END""",
    "k3_determination_faults": f"""WITH {STATES} SELECT id, state FROM states WHERE NOT CASE WHEN state = 'measured' THEN value IS NOT NULL AND qualifier IS NOT DISTINCT FROM '='
  WHEN state LIKE 'censored%' THEN value IS NULL AND qualifier IS NOT DISTINCT FROM CASE state WHEN 'censored-below' THEN '<' ELSE '>' END AND coalesce("limit" > 0, FALSE) ELSE value IS NULL AND qualifier IS NULL END""",
    "t3_overlay_fragments": f"""WITH {SAMPLES}, {LOGS}, g AS (SELECT DISTINCT hole, from_md, to_md FROM samples SEMI JOIN logs USING (hole)),
cuts AS (SELECT g.*, from_md AS lo FROM g UNION SELECT g.*, x FROM g JOIN (SELECT hole, from_md AS x FROM logs UNION SELECT hole, to_md FROM logs) e ON e.hole = g.hole AND x > from_md AND x < to_md),
pieces AS (SELECT *, coalesce(lead(lo) OVER (PARTITION BY hole, from_md, to_md ORDER BY lo), to_md) AS hi FROM cuts)
SELECT p.hole, p.from_md, p.to_md, lo, hi, count(l.hole) AS logs, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM pieces p LEFT JOIN logs l ON l.hole = p.hole AND l.from_md < hi AND l.to_md > lo GROUP BY ALL""",
    "t25_binding_faults": "SELECT o_orderkey AS id, 'o_orderstatus' AS field FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' UNION ALL SELECT o_orderkey, 'o_orderpriority' FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'",
    "k6_split_faults": f"WITH {SPLITS} SELECT c_custkey AS hole, count(split) AS times FROM customer LEFT JOIN splits ON hole = c_custkey GROUP BY 1 HAVING count(split) <> 1",
    "k6_membership": f"WITH {SPLITS} SELECT split, count(*) AS holes, CAST(sum(CAST('0x' || substr(md5(CAST(hole AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM splits GROUP BY 1",
    "w6_tops_and_cover": f"""WITH {CATEGORIES}, t AS (SELECT *, min(from_md) FILTER (category = 'basement') OVER (PARTITION BY hole) AS top FROM cats), c AS (SELECT *, CASE WHEN from_md < top THEN least(to_md, top) - from_md ELSE 0 END AS len FROM t WHERE top IS NOT NULL)
SELECT hole, top, coalesce(sum(len) FILTER (category IS NOT NULL), 0) AS covered, coalesce(sum(len) FILTER (category IS NULL), 0) AS unmapped FROM c GROUP BY 1, 2""",
    "p27_positions": f"""WITH {CATEGORIES} SELECT hole, sample, before, after, coalesce(before = 'basement' AND after = 'basement', FALSE) AS between FROM (SELECT *,
  last_value(category IGNORE NULLS) OVER (PARTITION BY hole ORDER BY from_md, to_md, sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(category IGNORE NULLS) OVER (PARTITION BY hole ORDER BY from_md, to_md, sample ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM cats)""",
    "t16_population_rows": f"""WITH {SAMPLES}, deep AS (SELECT hole, max(to_md) AS d FROM samples GROUP BY 1), edges AS (SELECT hole, k * 20.0::DOUBLE AS lo, (k + 1) * 20.0::DOUBLE AS hi FROM deep, unnest(range(CAST(floor(d / 20) AS BIGINT))) AS t(k)),
c AS (SELECT e.hole, lo, hi, analyte FROM edges e JOIN samples s ON s.hole = e.hole AND from_md < hi AND to_md > lo GROUP BY ALL HAVING sum(least(to_md, hi) - greatest(from_md, lo)) >= 10)
SELECT 'sample' AS population, analyte, count(*) AS rows, round(sum(to_md - from_md), 3) AS length FROM samples GROUP BY ALL UNION ALL SELECT 'composite', analyte, count(*), round(sum(hi - lo), 3) FROM c GROUP BY ALL""",
    "a9_representatives": f"WITH {LOGS} SELECT hole, from_md, to_md, min(sample) AS sample, count(*) AS supports FROM logs GROUP BY ALL",
    "o7_geometries": f"WITH {LOGS} SELECT DISTINCT hole, from_md, to_md FROM logs",
    "a2_distinct_values": f"WITH {LOGS} SELECT hole, count(DISTINCT code) AS codes, string_agg(DISTINCT code, ',' ORDER BY code) AS listed FROM logs GROUP BY 1",
    "j1_supported_results": f"WITH {SAMPLES} SELECT hole, sample, value, o_custkey FROM samples JOIN orders ON o_orderkey = hole",
    "j3_confirmed_holes": f"WITH {LOGS} SELECT o_orderkey AS hole FROM orders WHERE o_orderkey IN (SELECT hole FROM logs WHERE code = 'RF') AND o_orderkey NOT IN (SELECT hole FROM logs WHERE code = 'NO')",
    "o5_key_difference": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 4",
    "o5_key_intersection": "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders",
    "g5_members_by_split": f"WITH {SAMPLES}, {SPLITS} SELECT split, analyte, count(*) AS rows, count(DISTINCT samples.hole) AS holes FROM samples JOIN splits ON splits.hole = samples.hole GROUP BY ALL",
    "k2_foreign_keys": "SELECT l_suppkey, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 4) GROUP BY 1",
    "p10_plain_ids": "SELECT p_partkey, concat('DH', p_partkey, 'A') AS plain FROM part",
}
ORACLES["o4_all_findings"] = (
    f"WITH {SUPPORTS}, {STATES}, a AS ({ORACLES['k3_support_faults'].split(' SELECT id, kind', 1)[1].join(['SELECT id, kind', ''])}), b AS (SELECT id, state{ORACLES['k3_determination_faults'].split('SELECT id, state FROM states', 1)[1].join([' FROM states', ''])})"
    " SELECT 'support' AS role, count(*) AS findings FROM a HAVING count(*) > 0 UNION ALL SELECT 'determination', count(*) FROM b HAVING count(*) > 0"
)
