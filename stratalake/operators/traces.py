"""Straight pieces of paths cut at the borders of a grid of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ENDS = ("x0", "y0", "z0", "x1", "y1", "z1")
#: A piece that crosses more cells than this along an axis is cut into parts first, so that no row holds a long list.
CROSSED = 2048
#: Parts below this share of their piece come from rounding where it meets two borders at once, and are left out.
SLIVER = 1e-12


def cut_at_cells(pieces: DataFrame, cell: Sequence[float], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Every piece (x0, y0, z0, x1, y1, z1, ...) as the parts that lie in one cell: (..., ci, cj, ck, length).

    The parameters at which a piece crosses planes of the grid are listed axis by axis, sorted, and taken in neighbouring
    pairs; the middle of a part tells its cell. A part along a border belongs to the cell above. Pieces without a place
    at both ends, or of no length, have no parts. The lengths of a piece's parts add up to its own.
    """
    other = [c for c in pieces.columns if c not in ENDS]
    rows = pieces.where(" AND ".join(f"{e} IS NOT NULL AND NOT isnan({e})" for e in ENDS)).select(*(F.col(c) for c in other), *(((F.col(e) - origin[i % 3]) / cell[i % 3]).alias(e) for i, e in enumerate(ENDS)))
    spans = [F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"]
    size = F.sqrt(sum(((s * c) * (s * c) for s, c in zip(spans, cell)), F.lit(0.0)))
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(*map(F.abs, spans)) / CROSSED)).cast("int")
    rows = rows.withColumn("whole", size).where("whole > 0").withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.col("part") / F.col("parts"), (F.col("part") + 1) / F.col("parts")
    rows = rows.withColumn("low", low).withColumn("high", high)

    def crossings(a: str) -> Column:
        start, span = F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"{a}0")
        ends = start + span * F.col("low"), start + span * F.col("high")
        planes = F.transform(F.sequence(F.floor(F.least(*ends)), F.ceil(F.greatest(*ends))), lambda k: (k - start) / span)
        return F.when(span != 0, planes).otherwise(F.array().cast("array<double>"))

    inside = F.filter(F.concat(*map(crossings, "xyz")), lambda t: (t > F.col("low")) & (t < F.col("high")))
    stops = F.array_sort(F.array_distinct(F.concat(F.array("low", "high"), inside)))
    rows = rows.withColumn("stops", stops)
    spanned = F.explode(F.zip_with(F.slice("stops", F.lit(1), F.size("stops") - 1), F.slice("stops", F.lit(2), F.size("stops") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    cut = rows.withColumn("span", spanned).where(f"span.b - span.a > {SLIVER}").withColumn("t", (F.col("span.a") + F.col("span.b")) / 2)
    places = [F.floor(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col("t")).alias(n) for a, n in zip("xyz", ("ci", "cj", "ck"))]
    return cut.select(*other, *places, (F.col("whole") * (F.col("span.b") - F.col("span.a"))).alias("length"))


def mapped_cells(pieces: DataFrame, cell: Sequence[float], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(ci, cj, ck, category, length, holes) of pieces (hole, category, ends): mapped length and holes by cell and category, none for a null category."""
    cut = cut_at_cells(pieces.where("category IS NOT NULL"), cell, origin)
    return cut.groupBy("ci", "cj", "ck", "category").agg(F.sum("length").alias("length"), F.countDistinct("hole").alias("holes"))


def straight_pieces(positions: DataFrame, keys: Sequence[str] = ("hole",), order: str = "md") -> DataFrame:
    """(keys, order, x0, ..., z1): from each position of a path to the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = positions.select(*keys, order, *(F.col(a).alias(f"{a}0") for a in "xyz"), *(F.lead(a).over(w).alias(f"{a}1") for a in "xyz"))
    return ahead.where("x1 IS NOT NULL")
