"""Boxes of files, and paths cut at cells."""

from pyspark.sql import functions as F

from stratalake.operators import boxes as B, traces as T

from .views import read

MARGIN = 1000.0


def files(s, d):
    """Points of a file by supplier; files lie along both diagonals, so that some meet with swapped axes only."""
    k = F.col("l_suppkey")
    x = F.when(k % 3 == 0, F.pmod(k * 7919, F.lit(97))).otherwise(k) * 2600.0 + F.pmod(F.col("l_partkey"), F.lit(1000))
    y = F.when(k % 3 == 0, k).otherwise(F.pmod(k * 7919, F.lit(97))) * 2600.0 + F.col("l_quantity") * F.when(k % 11 == 0, 400.0).otherwise(20.0)
    return read(s, d, "lineitem").select(k.alias("file"), x.alias("x"), y.alias("y"))


FILES = """b AS (SELECT l_suppkey AS file, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT l_suppkey,
  (CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey * 7919 % 97 ELSE l_suppkey END) * 2600.0::DOUBLE + l_partkey % 1000 AS x,
  (CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE l_suppkey * 7919 % 97 END) * 2600.0::DOUBLE + l_quantity * (CASE WHEN l_suppkey % 11 = 0 THEN 400.0 ELSE 20.0 END)::DOUBLE AS y FROM lineitem) GROUP BY 1),
p AS (SELECT a.file, c.file AS file_2, greatest(1000.0::DOUBLE, (a.x1 - a.x0) / 2, (a.y1 - a.y0) / 2, (c.x1 - c.x0) / 2, (c.y1 - c.y0) / 2) AS m, a.x0, a.x1, a.y0, a.y1, c.x0 AS u0, c.x1 AS u1, c.y0 AS v0, c.y1 AS v1 FROM b a JOIN b c ON a.file < c.file),
q AS (SELECT *, x0 - m <= u1 AND u0 - m <= x1 AND y0 - m <= v1 AND v0 - m <= y1 AS direct, x0 - m <= v1 AND v0 - m <= x1 AND y0 - m <= u1 AND u0 - m <= y1 AS turned FROM p)"""


def pieces(s, d):
    """A piece of a path by line: its start by part and supplier, its direction by line number, its length the quantity."""
    n = F.col("l_linenumber")
    x, y, z = F.pmod("l_partkey", F.lit(500)).cast("double"), F.pmod("l_suppkey", F.lit(90)).cast("double"), -(n * 8.0)
    q = F.col("l_quantity")
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("hole"), F.col("l_returnflag").alias("category"), x.alias("x0"), y.alias("y0"), z.alias("z0"), (x + q * 0.75).alias("x1"), (y + q * (n - 4) * 0.25).alias("y1"), (z - q * 0.5).alias("z1"))


CELL = (25.0, 20.0, 5.0)
_AXES = {"x": ("CAST(l_partkey % 500 AS DOUBLE)", "l_quantity * 0.75::DOUBLE", 25), "y": ("CAST(l_suppkey % 90 AS DOUBLE)", "l_quantity * (l_linenumber - 4) * 0.25::DOUBLE", 20), "z": ("-(l_linenumber * 8.0::DOUBLE)", "-(l_quantity * 0.5::DOUBLE)", 5)}
PARTS = (
    "WITH p AS (SELECT row_number() OVER () AS id, l_orderkey AS hole, l_returnflag AS category, " + ", ".join(f"({a}) / {c} AS {k}, ({a} + {s}) / {c} AS {k}e" for k, (a, s, c) in _AXES.items()) + " FROM lineitem), "
    + "t AS (SELECT *, list_sort(list_distinct(list_filter(list_concat([0.0::DOUBLE, 1.0::DOUBLE], "
    + ", ".join(f"CASE WHEN {k}e <> {k} THEN list_transform(range(floor(least({k}, {k}e))::BIGINT, ceil(greatest({k}, {k}e))::BIGINT + 1), lambda g: (g - {k}) / ({k}e - {k})) ELSE []::DOUBLE[] END" for k in "xyz")
    + "), lambda v: v >= 0 AND v <= 1))) AS stops FROM p), "
    + "u AS (SELECT *, unnest(range(1, len(stops))) AS i FROM t), v AS (SELECT *, (stops[i] + stops[i + 1]) / 2 AS m, stops[i + 1] - stops[i] AS share FROM u) "
    + "SELECT CAST(floor(x + (xe - x) * m) AS BIGINT) AS ci, CAST(floor(y + (ye - y) * m) AS BIGINT) AS cj, CAST(floor(z + (ze - z) * m) AS BIGINT) AS ck, category, round(sum(share * sqrt(((xe - x) * 25) ** 2 + ((ye - y) * 20) ** 2 + ((ze - z) * 5) ** 2)), 6) AS length, count(DISTINCT hole) AS holes FROM v WHERE share > 1e-12 GROUP BY ALL"
)

QUERIES = {
    "j16_meeting_boxes": lambda s, d: (lambda b: B.box_pairs(b, b, "file", MARGIN).where("file < file_2").select("file", "file_2"))(B.file_boxes(files(s, d))),
    "j16_swapped_axes": lambda s, d: B.swapped_axes(B.file_boxes(files(s, d)), "file", MARGIN),
    "a33_mapped_cells": lambda s, d: T.mapped_cells(pieces(s, d), CELL).withColumn("length", F.round("length", 6)).where("length > 0"),
}
ORACLES = {
    "j16_meeting_boxes": f"WITH {FILES} SELECT file, file_2 FROM q WHERE direct",
    "j16_swapped_axes": f"WITH {FILES} SELECT file, file_2 FROM q WHERE turned AND NOT direct",
    "a33_mapped_cells": f"SELECT * FROM ({PARTS}) WHERE length > 0",
}
