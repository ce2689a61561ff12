"""A declared family from samples to populations, and split schemes."""

from pyspark.sql import functions as F

from stratalake.operators import families as P

from .paths import SHARES
from .views import SAMPLES, SITES, read, samples, sites

LENGTHS, LEAST = (20.0, 50.0), 0.75
FAMILY = P.Family(
    "demo", LENGTHS, LEAST,
    (
        P.Population("native", "estimation", "kind = 'interval' AND value IS NOT NULL"), P.Population("points", "display", "kind = 'point'"),
        P.Population("A-20", "estimation", length=20.0, analyte="A"), P.Population("A-50-residual", "review", length=50.0, status="residual", analyte="A"), P.Population("one-hole", "none", refused="one hole forms no groups"),
    ),
    {"without value": "value IS NULL"},
)


def supports(s, d):
    """Samples a third of which have no value; each 13th is a point."""
    x = samples(s, d).where("hole % 5 <> 0 OR sample > 1")
    point = F.pmod(F.col("hole") + F.col("sample"), F.lit(13)) == 0
    value = F.when(F.pmod(F.col("hole") * 3 + F.col("sample"), F.lit(3)) != 0, F.col("value"))
    return x.select(F.concat_ws("-", "hole", "sample").alias("id"), "hole", "sample", "from_md", F.when(point, F.col("from_md")).otherwise(F.col("to_md")).alias("to_md"), F.when(point, "point").otherwise("interval").alias("kind"), "analyte", value.alias("value"))


def collars(s, d):
    return read(s, d, "orders").select(F.col("o_orderkey").alias("hole"), F.when(F.col("o_orderkey") % 7 != 0, F.pmod(F.col("o_custkey"), F.lit(200)).cast("double")).alias("depth"))


def table(name):
    return lambda s, d: P.run_family(FAMILY, supports(s, d), collars(s, d))[name]


def composites(s, d):
    rows = table("composites")(s, d)
    return rows.select("hole", "length", F.col("k").cast("long").alias("k"), "analyte", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("covered", 6).alias("covered"), F.array_join("parents", ",").alias("parents"), F.round("numerator", 2).alias("numerator"), F.col("observed").isNotNull().alias("observed"), F.col("mean").isNotNull().alias("mean"), "status")


def holes(s, d):
    return sites(s, d).select(F.col("id").alias("hole"), "x", "y")


BASE = f"""{SAMPLES}, p AS (SELECT hole || '-' || sample AS id, hole, sample, from_md, CASE WHEN (hole + sample) % 13 = 0 THEN from_md ELSE to_md END AS to_md, CASE WHEN (hole + sample) % 13 = 0 THEN 'point' ELSE 'interval' END AS kind,
  analyte, CASE WHEN (hole * 3 + sample) % 3 <> 0 THEN value END AS value FROM samples WHERE hole % 5 <> 0 OR sample > 1),
i AS (SELECT * FROM p WHERE kind = 'interval' AND to_md > from_md), r AS (SELECT hole, min(from_md) AS first, max(to_md) AS deep FROM i GROUP BY 1),
e AS (SELECT hole, x AS length, unnest(range(0, CAST(ceil((deep - first) / x) AS BIGINT))) AS k, first, deep FROM r, (VALUES (20.0::DOUBLE), (50.0)) t(x)),
g AS (SELECT e.*, first + k * length AS lo, least(first + (k + 1) * length, deep) AS hi, analyte FROM e JOIN (SELECT DISTINCT hole, analyte FROM i) USING (hole)),
m AS (SELECT g.hole, g.length, g.k, g.analyte, sum(value * (least(to_md, hi) - greatest(from_md, lo))) AS numerator, sum(least(to_md, hi) - greatest(from_md, lo)) AS covered, string_agg(sample::VARCHAR, ',' ORDER BY sample) AS parents
  FROM g JOIN i ON i.hole = g.hole AND i.analyte = g.analyte AND value IS NOT NULL AND from_md < hi AND to_md > lo GROUP BY ALL),
c AS (SELECT g.*, coalesce(covered, 0) AS covered, coalesce(parents, '') AS parents, numerator, coalesce(covered, 0) / (hi - lo) >= 0.75 AS enough FROM g LEFT JOIN m USING (hole, length, k, analyte)),
d AS (SELECT *, CASE WHEN NOT enough THEN 'insufficient' WHEN hi - lo < length - 1e-9 THEN 'residual' ELSE 'full' END AS status FROM c),
l AS (SELECT o_orderkey AS hole, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 200)::DOUBLE END AS depth FROM orders),
y AS (SELECT DISTINCT id, p.hole FROM p JOIN l ON l.hole = p.hole AND depth IS NOT NULL AND greatest(from_md, to_md) > depth)"""
MEMBERS = """q AS (SELECT DISTINCT 'native' AS population, 'estimation' AS task, id AS member, hole FROM p WHERE kind = 'interval' AND value IS NOT NULL UNION ALL SELECT DISTINCT 'points', 'display', id, hole FROM p WHERE kind = 'point'
UNION ALL SELECT DISTINCT 'A-20', 'estimation', hole || '/20/' || k, hole FROM d WHERE length = 20 AND status = 'full' AND analyte = 'A' UNION ALL SELECT DISTINCT 'A-50-residual', 'review', hole || '/50/' || k, hole FROM d WHERE length = 50 AND status = 'residual' AND analyte = 'A')"""


def cut(rows, seed, shares, scheme):
    """The seeded cut of `rows` (id) in SQL."""
    listed = ", ".join(f"('{k}', {i}, {v}::DOUBLE)" for i, (k, v) in enumerate(shares.items()))
    return f"""SELECT '{scheme}' AS scheme, id AS hole, name AS split FROM (WITH u AS ({rows}), c AS (SELECT id, row_number() OVER (ORDER BY substr(md5('{seed}:' || id), 1, 15)) AS nth FROM u),
q AS (SELECT name, i, n * share / {sum(shares.values())}::DOUBLE AS exact FROM (VALUES {listed}) t(name, i, share), (SELECT count(*) AS n FROM u)), f AS (SELECT *, floor(exact) AS size FROM q),
h AS (SELECT *, size + CASE WHEN row_number() OVER (ORDER BY exact - size DESC, i) <= (SELECT count(*) FROM u) - sum(size) OVER () THEN 1 ELSE 0 END AS held FROM f),
b AS (SELECT name, sum(held) OVER (ORDER BY i) AS upto, sum(held) OVER (ORDER BY i) - held AS before FROM h) SELECT id, name FROM c JOIN b ON nth > before AND nth <= upto)"""


THREE = {k: v for k, v in SHARES.items() if k != "test"}
SCHEMES = f"""WITH {SITES}, o AS (SELECT id, row_number() OVER (ORDER BY round(sqrt((x - (SELECT avg(x) FROM sites)) ** 2 + (y - (SELECT avg(y) FROM sites)) ** 2), 9) DESC, id) AS nth, x, y FROM sites),
t AS (SELECT * FROM o WHERE nth <= (SELECT ceil(0.15 * count(*)) FROM sites)),
w AS (SELECT 1.5 * quantile_cont(m, 0.5) AS reach FROM (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM sites a JOIN sites b ON a.id <> b.id GROUP BY a.id)),
f AS (SELECT DISTINCT o.id FROM o JOIN t ON sqrt((o.x - t.x) ** 2 + (o.y - t.y) ** 2) <= (SELECT reach FROM w) WHERE o.id NOT IN (SELECT id FROM t))
{cut('SELECT id FROM sites', 'demo', SHARES, 'hole-group')}
UNION ALL {cut('SELECT id FROM sites WHERE id NOT IN (SELECT id FROM t) AND id NOT IN (SELECT id FROM f)', 'demo', THREE, 'spatial-margin')}
UNION ALL SELECT 'spatial-margin', id, 'test' FROM t UNION ALL SELECT 'spatial-margin', id, 'buffered' FROM f
UNION ALL {cut('SELECT id FROM sites WHERE id NOT IN (2, 3, 5)', 'demo', THREE, 'declared')} UNION ALL SELECT 'declared', id, 'test' FROM sites WHERE id IN (2, 3, 5)"""

QUERIES = {
    "t4_composites": composites,
    "t4_populations": table("populations"),
    "t4_population_counts": table("counts"),
    "t4_waterfall": table("waterfall"),
    "t4_beyond_depth": table("beyond"),
    "t5_schemes": lambda s, d: P.split_schemes(holes(s, d), "demo", [2, 3, 5])[0],
}
ORACLES = {
    "t4_composites": f"WITH {BASE} SELECT hole, length, k, analyte, round(lo, 6) AS lo, round(hi, 6) AS hi, round(covered, 6) AS covered, parents, round(coalesce(numerator, 0), 2) AS numerator, NOT enough AND covered > 0 AS observed, enough AS mean, status FROM d",
    "t4_populations": f"WITH {BASE}, {MEMBERS} SELECT * FROM q",
    "t4_population_counts": f"WITH {BASE}, {MEMBERS}, n AS (SELECT * FROM (VALUES ('native', 'estimation', NULL), ('points', 'display', NULL), ('A-20', 'estimation', NULL), ('A-50-residual', 'review', NULL), ('one-hole', 'none', 'one hole forms no groups')) t(population, task, reason)) SELECT n.population, n.task, count(member) AS members, count(DISTINCT hole) AS holes, n.reason FROM n LEFT JOIN q ON q.population = n.population GROUP BY ALL",
    "t4_waterfall": f"""WITH {BASE} SELECT 'supports' AS step, count(DISTINCT id) AS n, NULL::BIGINT AS "full", NULL::BIGINT AS residual, NULL::BIGINT AS insufficient FROM p
UNION ALL SELECT 'repeated intervals', count(*), NULL, NULL, NULL FROM (SELECT hole, from_md, to_md FROM p WHERE kind = 'interval' GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'beyond depth', count(*), NULL, NULL, NULL FROM y
UNION ALL SELECT 'without value', count(DISTINCT id), NULL, NULL, NULL FROM p WHERE value IS NULL
UNION ALL SELECT CAST(length AS INT) || ' m composites', count(*), count(*) FILTER (status = 'full'), count(*) FILTER (status = 'residual'), count(*) FILTER (status = 'insufficient') FROM d GROUP BY length""",
    "t4_beyond_depth": f"WITH {BASE} SELECT id, hole FROM y",
    "t5_schemes": SCHEMES,
}
