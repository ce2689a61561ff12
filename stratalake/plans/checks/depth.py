"""Interval queries."""

from pyspark.sql import functions as F

from stratalake.operators import intervals as I

from .views import LOGS, SAMPLES, logs, samples

PIECES = """ends AS (SELECT hole, from_md AS lo FROM logs UNION SELECT hole, to_md FROM logs),
cuts AS (SELECT hole, lo, lead(lo) OVER (PARTITION BY hole ORDER BY lo) AS hi FROM ends),
pieces AS (SELECT c.hole, c.lo, c.hi, count(DISTINCT code) AS labels, count(*) AS covers, CASE WHEN count(DISTINCT code) = 1 THEN min(code) ELSE 'conflict' END AS label
  FROM cuts c JOIN logs l ON l.hole = c.hole AND l.from_md <= c.lo AND l.to_md >= c.hi WHERE c.hi IS NOT NULL GROUP BY ALL)"""



def composites(s, d, made=I.composites):
    """Numerators are rounded as the values are, to 0.01 over whole lengths."""
    rows = made(samples(s, d), 20.0, 0.5).withColumn("numerator", F.round("numerator", 2))
    return rows.withColumn("mean", F.when(F.col("mean").isNotNull(), F.col("numerator") / F.col("covered")))


QUERIES = {
    "a11_composites": lambda s, d: composites(s, d, I.met_composites),
    "a11_gap_composites": lambda s, d: composites(s, d).where("parents = 0"),
    "t2_fixed_boundaries": lambda s, d: I.fixed_boundaries(samples(s, d), 20.0),
    "j5_overlapping_pairs": lambda s, d: I.overlapping_pairs(logs(s, d), ["hole"]),
    "w1_gaps": lambda s, d: I.gaps(logs(s, d)),
    "w2_elementary_pieces": lambda s, d: I.elementary_pieces(logs(s, d)),
    "a13_doubly_logged": lambda s, d: I.doubly_logged(logs(s, d)),
    "a12_category_shares": lambda s, d: I.category_shares(samples(s, d), logs(s, d)).withColumn("share", F.round("share", 6)),
}
ORACLES = {
    "a11_composites": f"""WITH {SAMPLES}, deep AS (SELECT hole, max(to_md) AS d FROM samples GROUP BY 1),
edges AS (SELECT hole, CAST(k AS INTEGER) AS k, k * 20.0::DOUBLE AS lo, least((k + 1) * 20.0::DOUBLE, d) AS hi FROM deep, unnest(range(CAST(ceil(d / 20) AS BIGINT))) AS t(k)),
total AS (SELECT e.hole, k, lo, hi, analyte, CAST(sum(CAST(value AS DECIMAL(12,2)) * CAST(least(to_md, hi) - greatest(from_md, lo) AS DECIMAL(10,0))) AS DOUBLE) AS numerator,
  sum(least(to_md, hi) - greatest(from_md, lo)) AS covered, count(*) AS parents FROM edges e JOIN samples s ON s.hole = e.hole AND from_md < hi AND to_md > lo GROUP BY ALL)
SELECT hole, k, analyte, lo, hi, numerator, covered, parents, CASE WHEN covered / (hi - lo) >= 0.5 THEN numerator / covered END AS mean,
  CASE WHEN covered / (hi - lo) < 0.5 THEN 'insufficient' WHEN hi - lo < 20 THEN 'residual' ELSE 'full' END AS status FROM total""",
    "a11_gap_composites": f"""WITH {SAMPLES}, deep AS (SELECT hole, max(to_md) AS d FROM samples GROUP BY 1),
edges AS (SELECT hole, CAST(k AS INTEGER) AS k, k * 20.0::DOUBLE AS lo, least((k + 1) * 20.0::DOUBLE, d) AS hi FROM deep, unnest(range(CAST(ceil(d / 20) AS BIGINT))) AS t(k))
SELECT e.hole, k, analyte, lo, hi, 0.0::DOUBLE AS numerator, 0.0::DOUBLE AS covered, 0 AS parents, CAST(NULL AS DOUBLE) AS mean, 'insufficient' AS status
FROM edges e JOIN (SELECT DISTINCT hole, analyte FROM samples) h ON h.hole = e.hole
WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.hole = e.hole AND s.analyte = h.analyte AND from_md < hi AND to_md > lo)""",
    "t2_fixed_boundaries": f"""WITH {SAMPLES}, deep AS (SELECT hole, max(to_md) AS d FROM samples GROUP BY 1)
SELECT hole, CAST(k AS INTEGER) AS k, k * 20.0::DOUBLE AS lo, least((k + 1) * 20.0::DOUBLE, d) AS hi FROM deep, unnest(range(CAST(ceil(d / 20) AS BIGINT))) AS t(k)""",
    "j5_overlapping_pairs": f"""WITH {LOGS} SELECT a.hole, a.sample, a.from_md, a.to_md, b.sample AS sample_2, b.from_md AS from_md_2, b.to_md AS to_md_2 FROM logs a JOIN logs b
ON a.hole = b.hole AND a.from_md < b.to_md AND b.from_md < a.to_md AND (a.from_md <> b.from_md OR a.to_md <> b.to_md) AND a.sample < b.sample""",
    "w1_gaps": f"""WITH {LOGS}, spans AS (SELECT DISTINCT hole, from_md, to_md FROM logs),
reach AS (SELECT *, max(to_md) OVER (PARTITION BY hole ORDER BY from_md, to_md ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_from FROM spans)
SELECT hole, gap_from, from_md AS gap_to FROM reach WHERE from_md - gap_from > 1e-9""",
    "w2_elementary_pieces": f"WITH {LOGS}, {PIECES} SELECT hole, lo, hi, labels, covers, label FROM pieces",
    "a13_doubly_logged": f"WITH {LOGS}, {PIECES} SELECT hole, sum(CASE WHEN covers > 1 THEN hi - lo ELSE 0 END) AS doubled FROM pieces GROUP BY 1",
    "a12_category_shares": f"""WITH {SAMPLES}, {LOGS}, {PIECES}, met AS (SELECT s.hole, s.sample, s.from_md, s.to_md, label, sum(least(to_md, hi) - greatest(from_md, lo)) AS length
  FROM samples s JOIN pieces p ON p.hole = s.hole AND lo < to_md AND hi > from_md GROUP BY ALL) SELECT hole, sample, label, length, round(length / (to_md - from_md), 6) AS share FROM met""",
}
