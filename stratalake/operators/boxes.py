"""Bounding boxes of files, and pairs of boxes that meet within a margin, by a hierarchy of covering grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EDGES = ("x0", "x1", "y0", "y1")


def file_boxes(points: DataFrame, key: str = "file") -> DataFrame:
    """(key, x0, x1, y0, y1) of points (key, x, y). Points without a place take no part; a file without any has no box."""
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    return known.groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _longest(at: str = "") -> Column:
    return F.greatest(F.col(f"x1{at}") - F.col(f"x0{at}"), F.col(f"y1{at}") - F.col(f"y0{at}"))


def within_margin(least: float) -> Column:
    """Whether boxes (x0, ...) and (x0_2, ...) meet, each side of one moved out by half the longest side of both, `least` at the least."""
    margin = F.greatest(F.lit(least), _longest() / 2, _longest("_2") / 2)
    meets = [(F.col(f"{a}0") - margin <= F.col(f"{a}1_2")) & (F.col(f"{a}0_2") - margin <= F.col(f"{a}1")) for a in "xy"]
    return meets[0] & meets[1]


def box_pairs(left: DataFrame, right: DataFrame, key: str = "file", least: float = 1000.0) -> DataFrame:
    """(key, x0, x1, y0, y1, key_2, x0_2, ...) of all boxes of `left` and `right` that meet within the margin.

    A box is moved out by its own margin and lies in at most four cells of every grid whose cells are as wide as it is;
    grids double from `least` on. Two boxes meet on the grid of the wider one, and of the cells they share there only the
    one with the lower corner of their overlap reports them. Boxes of all sizes thus take the same few rows each.
    """

    def covered(boxes: DataFrame) -> DataFrame:
        own = F.greatest(F.lit(least), _longest() / 2)
        grown = boxes.withColumn("own", own).select("*", *((F.col(e) + (F.col("own") if e[1] == "1" else -F.col("own"))).alias(f"g{e}") for e in EDGES))
        side = F.greatest(F.col("gx1") - F.col("gx0"), F.col("gy1") - F.col("gy0"))
        return grown.withColumn("level", F.greatest(F.ceil(F.log2(side / least)), F.lit(0)).cast("int")).drop("own")

    def in_cells(boxes: DataFrame, levels: list[int]) -> DataFrame:
        wider = F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col("level"))
        out = boxes.withColumn("grid", F.explode(wider)).withColumn("side", F.pow(F.lit(2.0), "grid") * least)
        for a in "xy":
            out = out.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"g{a}0") / F.col("side")), F.floor(F.col(f"g{a}1") / F.col("side")))))
        return out

    a, b = covered(left.select(key, *EDGES)), covered(right.select(key, *EDGES))
    levels = sorted({r["level"] for r in a.select("level").union(b.select("level")).distinct().collect()})  # powers of two of a width: few
    if not levels:
        levels = [0]
    cells = ["grid", "cx", "cy"]
    other = in_cells(b, levels).drop("side").select(*cells, *(F.col(c).alias(f"{c}_2") for c in (key, *EDGES, "gx0", "gy0", "level")))
    met = in_cells(a, levels).join(other, cells).where(F.col("grid") == F.greatest("level", "level_2"))
    for c in "xy":
        met = met.where(F.floor(F.greatest(f"g{c}0", f"g{c}0_2") / F.col("side")) == F.col(f"c{c}"))
    return met.where(within_margin(least)).select(key, *EDGES, f"{key}_2", *(f"{e}_2" for e in EDGES))


def swapped_axes(boxes: DataFrame, key: str = "file", least: float = 1000.0) -> DataFrame:
    """(file, file_2): pairs, file < file_2, that meet only if the axes of file_2 are swapped. A suspicion of easting and northing exchanged."""
    turned = boxes.select(key, F.col("y0").alias("x0"), F.col("y1").alias("x1"), F.col("x0").alias("y0"), F.col("x1").alias("y1"))
    met = box_pairs(boxes, turned, key, least).where(F.col(key) < F.col(f"{key}_2"))
    back = met.select(key, *EDGES, f"{key}_2", *(F.col(f"{b}_2").alias(f"{a}_2") for a, b in zip(EDGES, ("y0", "y1", "x0", "x1"))))
    return back.where(~within_margin(least)).select(key, f"{key}_2")
