"""Depth-interval algebra: boundaries, overlaps, gaps, pieces, composites. Intervals are [from_md, to_md) by hole.

Null ends and empty or reversed intervals take no part; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Equal ends within this distance leave no gap.
TOLERANCE = 1e-9


def sound(df: DataFrame) -> DataFrame:
    return df.where("hole IS NOT NULL AND from_md >= 0 AND to_md > from_md")


def overlap_length(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(b, hi) - F.greatest(a, lo))


def fixed_boundaries(intervals: DataFrame, length: float) -> DataFrame:
    """(hole, k, lo, hi): edges every `length` from 0 to the deepest end; the last piece keeps the residual."""
    deepest = sound(intervals).groupBy("hole").agg(F.max("to_md").alias("deep"))
    edges = deepest.select("hole", "deep", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("deep") / length) - 1).cast("int"))).alias("k"))
    return edges.select("hole", "k", (F.col("k") * length).alias("lo"), F.least((F.col("k") + 1) * length, F.col("deep")).alias("hi")).where("lo < hi")


def _met_composites(intervals: DataFrame, length: float) -> DataFrame:
    """(hole, k, analyte, numerator, covered, parents) of the composites that valued samples meet; a sample names those itself, from its ends."""
    a = sound(intervals).where("value IS NOT NULL")
    first = F.floor(F.col("from_md") / length).cast("int")
    last = F.greatest(F.ceil(F.col("to_md") / length).cast("int") - 1, first)
    each = a.select("hole", "analyte", "value", "from_md", "to_md", F.explode(F.sequence(first, last)).alias("k")).where((F.col("from_md") < (F.col("k") + 1) * length) & (F.col("to_md") > F.col("k") * length))
    part = overlap_length(F.col("from_md"), F.col("to_md"), F.col("k") * length, (F.col("k") + 1) * length)
    return each.groupBy("hole", "k", "analyte").agg(F.sum(F.col("value") * part).alias("numerator"), F.sum(part).alias("covered"), F.count("*").alias("parents"))


def _with_status(total: DataFrame, length: float, least: float) -> DataFrame:
    span = F.col("hi") - F.col("lo")
    kept = (F.col("parents") > 0) & (F.col("covered") / span >= least)
    return total.select(
        "hole", "k", "analyte", "lo", "hi", "numerator", "covered", "parents",
        F.when(kept, F.col("numerator") / F.col("covered")).alias("mean"),
        F.when(~kept, "insufficient").when(span < length - TOLERANCE, "residual").otherwise("full").alias("status"),
    )


def met_composites(intervals: DataFrame, length: float, least: float) -> DataFrame:
    """The composites of `composites` that some valued sample meets, without making the others first."""
    deepest = sound(intervals).groupBy("hole").agg(F.max("to_md").alias("deep"))
    total = _met_composites(intervals, length).join(deepest, "hole")
    return _with_status(total.withColumn("lo", F.col("k") * length).withColumn("hi", F.least((F.col("k") + 1) * length, F.col("deep"))), length, least)


def composites(intervals: DataFrame, length: float, least: float) -> DataFrame:
    """Length-weighted means of fixed-length composites by hole and analyte, where coverage is at least `least`.

    Every composite of a hole is returned for each analyte of the hole; one that no valued sample meets has coverage 0.
    """
    edges = fixed_boundaries(intervals, length)
    wanted = edges.join(sound(intervals).where("analyte IS NOT NULL").select("hole", "analyte").distinct(), "hole")
    total = wanted.join(_met_composites(intervals, length), ["hole", "k", "analyte"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("numerator", "covered", "parents")})
    return _with_status(total, length, least)


def overlapping_pairs(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different overlapping intervals of a hole; identical intervals are no overlap. `sample` orders a pair."""
    rows = sound(intervals).select(*keys, "sample", "from_md", "to_md")
    other = rows.select(*keys, *(F.col(c).alias(f"{c}_2") for c in ("sample", "from_md", "to_md")))
    meets = (F.col("from_md") < F.col("to_md_2")) & (F.col("from_md_2") < F.col("to_md"))
    differ = (F.col("from_md") != F.col("from_md_2")) | (F.col("to_md") != F.col("to_md_2"))
    return rows.join(other, keys).where(meets & differ & (F.col("sample") < F.col("sample_2")))


def gaps(intervals: DataFrame) -> DataFrame:
    """(hole, gap_from, gap_to) between the reach of all earlier spans and the next one."""
    spans = sound(intervals).select("hole", "from_md", "to_md").distinct()
    earlier = Window.partitionBy("hole").orderBy("from_md", "to_md").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.withColumn("gap_from", F.max("to_md").over(earlier))
    return reach.where(F.col("from_md") - F.col("gap_from") > TOLERANCE).select("hole", "gap_from", F.col("from_md").alias("gap_to"))


def elementary_pieces(logs: DataFrame) -> DataFrame:
    """(hole, lo, hi, labels, label): pieces between neighbouring ends, with one label or a conflict; unlogged pieces are left out."""
    rows = sound(logs)
    ends = rows.select("hole", F.col("from_md").alias("lo")).union(rows.select("hole", "to_md")).distinct()
    pieces = ends.withColumn("hi", F.lead("lo").over(Window.partitionBy("hole").orderBy("lo"))).where("hi IS NOT NULL")
    over = pieces.join(rows, "hole").where((F.col("from_md") <= F.col("lo")) & (F.col("to_md") >= F.col("hi")))
    found = over.groupBy("hole", "lo", "hi").agg(F.countDistinct("code").alias("labels"), F.min("code").alias("one"), F.count("*").alias("covers"))
    return found.select("hole", "lo", "hi", "labels", "covers", F.when(F.col("labels") == 1, F.col("one")).otherwise("conflict").alias("label"))


def doubly_logged(logs: DataFrame) -> DataFrame:
    """(hole, doubled): logged length under more than one log."""
    pieces = elementary_pieces(logs)
    return pieces.groupBy("hole").agg(F.sum(F.when(F.col("covers") > 1, F.col("hi") - F.col("lo")).otherwise(0.0)).alias("doubled"))


def category_shares(targets: DataFrame, logs: DataFrame) -> DataFrame:
    """(hole, sample, label, length, share) of log labels under each target interval."""
    pieces = elementary_pieces(logs)
    part = overlap_length(F.col("from_md"), F.col("to_md"), F.col("lo"), F.col("hi"))
    met = sound(targets).join(pieces, "hole").where((F.col("lo") < F.col("to_md")) & (F.col("hi") > F.col("from_md")))
    total = met.groupBy("hole", "sample", "from_md", "to_md", "label").agg(F.sum(part).alias("length"))
    return total.select("hole", "sample", "label", "length", (F.col("length") / (F.col("to_md") - F.col("from_md"))).alias("share"))


def target_coverage(targets: DataFrame, logs: DataFrame) -> DataFrame:
    """(hole, sample, covered, coverage): logged length and share of every target interval, 0 where no log meets it."""
    logged = category_shares(targets, logs).groupBy("hole", "sample").agg(F.sum("length").alias("met"))
    covered = F.coalesce("met", F.lit(0.0))
    return sound(targets).join(logged, ["hole", "sample"], "left").select("hole", "sample", covered.alias("covered"), (covered / (F.col("to_md") - F.col("from_md"))).alias("coverage"))
