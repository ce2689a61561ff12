"""Queries of places on hole paths, seeded cuts and coverage of targets."""

from pyspark.sql import functions as F

from stratalake.operators import geometry, intervals, matching

from . import imports
from .depth import PIECES
from .views import LOGS, SAMPLES, STATIONS, logs, read, samples, stations

SHARES = {"train": 60.0, "validation": 15.0, "calibration": 10.0, "test": 15.0}


def depths(s, d):
    """A depth between each station and the next, and one below the last."""
    return stations(s, d).select("hole", F.col("md").alias("id"), (F.col("md") + 4).alias("md"))


def placed(s, d):
    found = geometry.positions_at(stations(s, d), depths(s, d))
    return found.select("hole", "id", "md", *((F.round(c, 4) + 0.0).alias(c) for c in "xyz"), "extended")


def trajectories(s, d):
    """Collars, stations and declarations to paths from depth 0."""
    found = imports.I.station_groups(imports.readings(s, d).where("hole % 4 <> 1"))
    full = geometry.full_stations(imports.collars(s, d), found, imports.decisions(s, d, "tangent", "vertical"))
    return geometry.minimum_curvature(full).select("hole", "md", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))


def at(axis, c):
    arc = f"4 / part * tan(part / 2) * ({c} + (sin(turn - part) * {c} + sin(part) * {c}1) / sin(turn))"
    return f"round({axis} + CASE WHEN m1 IS NULL THEN 4 * {c} WHEN turn < 1e-6 THEN 2 * ({c} + {c}1) WHEN turn < 3.141592 THEN {arc} END, 4) + 0.0 AS {axis}"


QUERIES = {
    "t1_full_trajectories": trajectories,
    "t1_positions_at_depth": placed,
    "w9_permutation_cut": lambda s, d: matching.permutation_cut(read(s, d, "customer").select(F.col("c_custkey").alias("id")), SHARES, "cut"),
    "a12_target_coverage": lambda s, d: intervals.target_coverage(samples(s, d), logs(s, d)).withColumn("coverage", F.round("coverage", 6)),
}
ORACLES = {
    "t1_positions_at_depth": f"""WITH {STATIONS}, t AS (SELECT hole, md, sin(radians(azimuth)) * cos(radians(dip)) AS e, cos(radians(azimuth)) * cos(radians(dip)) AS n, sin(radians(dip)) AS u FROM stations),
s AS (SELECT *, lead(md) OVER w AS m1, lead(e) OVER w AS e1, lead(n) OVER w AS n1, lead(u) OVER w AS u1 FROM t WINDOW w AS (PARTITION BY hole ORDER BY md)),
a AS (SELECT *, acos(least(1.0, greatest(-1.0, e * e1 + n * n1 + u * u1))) AS turn FROM s),
f AS (SELECT *, turn * 4 / (m1 - md) AS part, (m1 - md) * CASE WHEN turn < 1e-6 THEN 0.5 WHEN turn < 3.141592 THEN tan(turn / 2) / turn END AS half FROM a),
p AS (SELECT *, coalesce(sum(coalesce(half * (e + e1), 0)) OVER w, 0) AS x, coalesce(sum(coalesce(half * (n + n1), 0)) OVER w, 0) AS y, coalesce(sum(coalesce(half * (u + u1), 0)) OVER w, 0) AS z FROM f WINDOW w AS (PARTITION BY hole ORDER BY md ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT hole, md AS id, md + 4 AS md, {at('x', 'e')}, {at('y', 'n')}, {at('z', 'u')}, m1 IS NULL AS extended FROM p""",
    "w9_permutation_cut": """WITH c AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY substr(md5('cut:' || c_custkey), 1, 15)) AS nth, count(*) OVER () AS n FROM customer),
q AS (SELECT name, i, n * share / 100 AS exact, floor(n * share / 100) AS size FROM (VALUES ('train', 1, 60.0::DOUBLE), ('validation', 2, 15.0), ('calibration', 3, 10.0), ('test', 4, 15.0)) t(name, i, share), (SELECT count(*) AS n FROM customer)),
r AS (SELECT *, size + CASE WHEN row_number() OVER (ORDER BY exact - size DESC, i) <= (SELECT any_value(c.n) FROM c) - sum(size) OVER () THEN 1 ELSE 0 END AS held FROM q),
b AS (SELECT name, sum(held) OVER (ORDER BY i) AS upto, sum(held) OVER (ORDER BY i) - held AS before FROM r) SELECT id, name AS split FROM c JOIN b ON nth > before AND nth <= upto""",
    "a12_target_coverage": f"WITH {SAMPLES}, {LOGS}, {PIECES}, c AS (SELECT s.hole, s.sample, any_value(s.to_md - s.from_md) AS span, coalesce(sum(greatest(0.0, least(to_md, hi) - greatest(from_md, lo))), 0.0) AS covered FROM samples s LEFT JOIN pieces p ON p.hole = s.hole GROUP BY 1, 2) SELECT hole, CAST(sample AS INTEGER) AS sample, covered, round(covered / span, 6) AS coverage FROM c",
}
