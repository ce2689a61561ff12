"""Parsing queries."""

from pyspark.sql import functions as F

from stratalake.functions import parsing as P

from .views import read


def tokens(s, d):
    v = F.round("value", 1).cast("string")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("<"), v)).when(F.col("event_id") % 7 == 1, F.concat(F.lit(">"), v)).when(F.col("event_id") % 7 == 2, "NS").when(F.col("event_id") % 7 == 3, " ").when(F.col("event_id") % 7 == 4, "1_000").when(F.col("event_id") % 7 == 5, "12.5").otherwise("-9999")
    return read(s, d, "events").select("event_id", "value", "event_type", raw.alias("raw"))


TOKENS = """tokens AS (SELECT event_id, value, event_type, CASE event_id % 7 WHEN 0 THEN concat('<', CAST(round(value, 1) AS VARCHAR)) WHEN 1 THEN concat('>', CAST(round(value, 1) AS VARCHAR)) WHEN 2 THEN 'NS' WHEN 3 THEN ' ' WHEN 4 THEN '1_000' WHEN 5 THEN '12.5' ELSE '-9999' END AS raw FROM events)"""
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def assay_tokens(s, d):
    t = tokens(s, d).withColumn("t", P.token(F.col("raw"), ["-9999"], {"NS": "not-sampled"}))
    return t.select("event_id", "t.state", "t.value", "t.limit")


def angles(s, d):
    e = read(s, d, "events")
    return e.select("event_id", P.wrapped_azimuth(F.col("event_id") % 1000 - 500.0).alias("azimuth"), P.dip_below_horizontal(F.col("event_id") % 90 + 0.0, "down-positive").alias("dip_a"), P.dip_below_horizontal(F.col("event_id") % 90 + 0.0, "from-vertical").alias("dip_b"))


def units(s, d):
    unit = F.element_at(F.array(*map(F.lit, ["ppm", "%", "gpt", "ppb", "oz"])), (F.col("event_id") % 5 + 1).cast("int"))
    return read(s, d, "events").select("event_id", P.parts_per_million(F.col("event_id") * 1.0, unit).alias("ppm"), P.metres(F.col("event_id") * 1.0, F.when(F.col("event_id") % 2 == 0, "ft").otherwise("m")).alias("metres"))


QUERIES = {
    "p1_number_parse": lambda s, d: tokens(s, d).select("event_id", P.number(F.col("raw")).alias("number")),
    "p2_assay_tokens": assay_tokens,
    "p6_angles": angles,
    "p11_units": units,
    "p10_plain_ids": lambda s, d: read(s, d, "pages").select("page_id", P.plain_id(F.col("url")).alias("plain")),
    "p9_hole_keys": lambda s, d: read(s, d, "nation").select(P.hole_key(F.col("n_regionkey").cast("string"), F.col("n_name")).alias("hole_key")),
    "p18_wendland": lambda s, d: read(s, d, "lineitem").groupBy("l_linenumber").agg(F.max("l_quantity").alias("q")).select("l_linenumber", F.round(P.wendland(F.col("l_linenumber") / 8), 9).alias("basis")),
    "p24_half_even": lambda s, d: read(s, d, "events").select("event_id", P.half_even((F.col("event_id") / 2).cast("decimal(20,1)"), 0).cast("long").alias("whole")),
    "p26_grid_cells": lambda s, d: read(s, d, "supplier").select("s_suppkey", P.grid_cell(F.col("s_acctbal"), -1000.0, 250.0).alias("cell")),
    "p12_support_kinds": lambda s, d: read(s, d, "lineitem").select(P.support_kind(F.when(F.col("l_linenumber") != 3, F.col("l_tax")), F.col("l_discount"), F.col("l_linenumber") % 3).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "p25_record_hash": lambda s, d: read(s, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 256).alias("hash")),
    "sc6_paragraphs": lambda s, d: read(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1)).alias("nth", "p")).select("page_id", "nth", F.regexp_replace("p", "<[^>]*>", "").alias("paragraph")).where(F.col("paragraph").contains("the")),
}
ORACLES = {
    "p1_number_parse": f"WITH {TOKENS} SELECT event_id, CASE WHEN regexp_matches(trim(raw), '{NUMBER}') THEN CAST(trim(raw) AS DOUBLE) END AS number FROM tokens",
    "p2_assay_tokens": f"""WITH {TOKENS}, t AS (SELECT event_id, trim(raw) AS r, CASE WHEN regexp_matches(substr(trim(raw), 2), '{NUMBER}') THEN TRY_CAST(substr(trim(raw), 2) AS DOUBLE) END AS lim, CASE WHEN regexp_matches(trim(raw), '{NUMBER}') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS num FROM tokens),
u AS (SELECT *, CASE WHEN r IN ('', '-9999') THEN 'missing' WHEN r = 'NS' THEN 'not-sampled' WHEN r[1] = '<' AND lim > 0 THEN 'below-limit' WHEN r[1] = '>' AND lim > 0 THEN 'above-limit' WHEN num IS NOT NULL THEN 'measured' ELSE 'undeclared' END AS state FROM t)
SELECT event_id, state, CASE WHEN state = 'measured' THEN num END AS value, CASE WHEN state IN ('below-limit', 'above-limit') THEN lim END AS "limit" FROM u""",
    "p6_angles": "SELECT event_id, CAST(((event_id % 1000 - 500) % 360 + 360) % 360 AS DOUBLE) AS azimuth, CAST(-(event_id % 90) AS DOUBLE) AS dip_a, CAST(event_id % 90 - 90 AS DOUBLE) AS dip_b FROM events",
    "p11_units": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id * 1.0::DOUBLE WHEN 1 THEN event_id * 10000.0::DOUBLE WHEN 2 THEN event_id * 1.0::DOUBLE WHEN 3 THEN event_id * 0.001::DOUBLE END AS ppm, CASE WHEN event_id % 2 = 0 THEN event_id * 0.3048::DOUBLE ELSE event_id * 1.0::DOUBLE END AS metres FROM events",
    "p10_plain_ids": r"SELECT page_id, regexp_replace(upper(regexp_replace(url, '[^0-9A-Za-z]', '', 'g')), '(^|[^0-9])0+([0-9])', '\1\2', 'g') AS plain FROM pages",
    "p9_hole_keys": "SELECT concat(CAST(n_regionkey AS VARCHAR), ':', n_name) AS hole_key FROM nation",
    "p18_wendland": "SELECT l_linenumber, round(pow(greatest(1 - l_linenumber / 8, 0.0), 6) * (35 * pow(l_linenumber / 8, 2) + 18 * (l_linenumber / 8) + 3) / 3, 9) AS basis FROM (SELECT DISTINCT l_linenumber FROM lineitem)",
    "p24_half_even": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id // 2 WHEN (event_id // 2) % 2 = 0 THEN event_id // 2 ELSE event_id // 2 + 1 END AS whole FROM events",
    "p26_grid_cells": "SELECT s_suppkey, CAST(floor((s_acctbal + 1000.0) / 250.0) AS BIGINT) AS cell FROM supplier",
    "p12_support_kinds": "SELECT CASE WHEN l_linenumber = 3 OR l_discount IS NULL THEN 'unknown' WHEN l_linenumber % 3 > 1 THEN 'sampling-envelope' WHEN l_tax = l_discount THEN 'point' ELSE 'interval' END AS kind, count(*) AS n FROM lineitem GROUP BY 1",
    "p25_record_hash": "SELECT n_nationkey, sha256(concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS hash FROM nation",
    "sc6_paragraphs": "SELECT page_id, CAST(i - 1 AS INTEGER) AS nth, p AS paragraph FROM (SELECT page_id, unnest(x) AS q, generate_subscripts(x, 1) AS i, regexp_replace(q, '<[^>]*>', '', 'g') AS p FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS x FROM pages)) WHERE contains(p, 'the')",
}
