"""Normalisation and checks of imported holes: tokens, stations, trajectories, supports, determinations, fragments.

Null keys match nothing; findings are rows (code, severity, hole, ...). Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.functions import parsing

#: Names of units by the suffix of a column, and qualifiers by state.
UNIT_NAMES = {"pct": "wt%", "ppm": "ppm", "ppb": "ppb", "ozt": "oz/t", "g": "g", "mg": "mg", "ug": "ug", "oz": "oz", "KeV": "keV"}
QUALIFIERS = {"measured": "=", "censored-below": "<", "censored-above": ">"}
UNKNOWN_CODES = ("", "-9999")


def _choice(value: Column, names: dict[str, str], other: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, name in names.items():
        out = out.when(value == key, name)
    return out.otherwise(other)


def unit_name(column: Column) -> Column:
    """Unit of a column by what follows its last underscore; other suffixes name themselves."""
    suffix = F.element_at(F.split(column, "_"), -1)
    return _choice(suffix, UNIT_NAMES, suffix)


def simple_token(raw: Column) -> Column:
    """STRUCT<value, state, limit> of a number with an optional < or >; other texts are malformed."""
    text = F.trim(raw)
    sign, rest = F.substring(text, 1, 1), parsing.number(F.substring(text, 2, 1 << 30))
    plain, none = parsing.number(raw), F.lit(None).cast("double")
    marked = sign.isin("<", ">") & rest.isNotNull()
    state = F.when(marked & (sign == "<"), "censored-below").when(marked, "censored-above").when(plain.isNotNull(), "measured").otherwise("malformed")
    return F.struct(plain.alias("value"), state.alias("state"), F.when(marked, rest).otherwise(none).alias("limit"))


def decimal_number(raw: Column, decimal: str = ".", missing: tuple[str, ...] = ()) -> Column:
    """A finite number with the declared decimal mark; declared missing tokens and malformed numbers are null."""
    text = F.trim(raw)
    mark = F.when(F.lit(decimal == ",") & ~text.contains("."), F.replace(text, F.lit(","), F.lit("."))).when(F.lit(decimal != ","), text)
    return F.when(~text.isin(list(missing)), parsing.number(mark)) if missing else parsing.number(mark)


def axes(first: Column, second: Column, order: str) -> tuple[Column, Column]:
    """(east, north) of two coordinates in the declared order."""
    return (second, first) if order == "north-east" else (first, second)


def determination(state: Column, value: Column) -> Column:
    """STRUCT<value, qualifier>: a value for measured results only, and the state's qualifier."""
    return F.struct(F.when(state == "measured", value).alias("value"), _choice(state, QUALIFIERS, F.lit(None)).alias("qualifier"))


def record_kind(from_md: Column, to_md: Column) -> Column:
    """A log row is an event at its depth if its ends are equal or one is missing."""
    return F.when(to_md.isNull() | (from_md == to_md), "event").otherwise("interval")


def code_or_null(raw: Column) -> Column:
    """A code as it is written; blank is none."""
    return F.when(F.trim(raw) != "", raw)


def known_codes(codes: Column) -> Column:
    """Sorted distinct codes of an array or map column's values, without the unknown ones."""
    return F.array_sort(F.array_except(F.filter(codes, lambda c: c.isNotNull()), F.array(*map(F.lit, UNKNOWN_CODES))))


def station_groups(readings: DataFrame) -> DataFrame:
    """(hole, md, azimuth, dip, rows, finding): one station a depth. Different angles at a depth are a conflict, equal ones collapse."""
    met = readings.groupBy("hole", "md").agg(F.count("*").alias("rows"), F.min(F.struct("azimuth", "dip")).alias("low"), F.max(F.struct("azimuth", "dip")).alias("high"))
    finding = F.when(F.col("low") != F.col("high"), "SURVEY_DEPTH_CONFLICT").when(F.col("rows") > 1, "RECORD_DUPLICATE")
    return met.select("hole", "md", "low.azimuth", "low.dip", "rows", finding.alias("finding"))


def trajectory_decisions(collars: DataFrame, stations: DataFrame, deepest: DataFrame, start: str | None = None, missing: str | None = None) -> DataFrame:
    """(hole, kind, start, valid_to, codes, blocked) of collars (hole, azimuth, dip, depth) by grouped stations and the deepest record of a hole.

    Stations come first, then the collar's direction, then the vertical if `missing` declares it. Above the first station a
    hole follows its collar's direction, or the first station's if `start` is tangent; else it is blocked, as are holes
    with two directions at a depth and holes without any direction.
    """
    s = stations.groupBy("hole").agg(F.min("md").alias("first"), F.max("md").alias("last"), F.max((F.col("finding") == "SURVEY_DEPTH_CONFLICT").cast("int")).alias("conflict"))
    c = collars.join(s, "hole", "left").join(deepest.select("hole", "deepest"), "hole", "left")
    end, directed, measured = F.coalesce("depth", "deepest"), F.col("azimuth").isNotNull() & F.col("dip").isNotNull(), F.col("first").isNotNull()
    open_top = measured & (F.col("first") > 0)
    undeclared = open_top & ~directed & F.lit(start != "tangent")
    none = ~measured & ~directed & F.lit(missing != "vertical")
    conflict = F.coalesce(F.col("conflict") == 1, F.lit(False))
    blocked = undeclared | none | conflict
    codes = F.filter(
        F.array(
            F.when(conflict, "SURVEY_DEPTH_CONFLICT"), F.when(undeclared, "SURVEY_START_UNDECLARED"), F.when(open_top & ~directed & ~undeclared, "SURVEY_START_EXTENDED"),
            F.when(measured & ~undeclared & (end > F.col("last")), "SURVEY_TRUNCATED"), F.when(~measured & ~none, "SURVEY_ASSUMED"), F.when(none, "SURVEY_MISSING_UNASSUMED"),
        ),
        lambda x: x.isNotNull(),
    )
    kind = F.when(blocked, None).when(measured, "measured-stations").when(directed, "collar-orientation").otherwise("assumed-vertical")
    top = F.when(blocked | ~open_top, "none").when(directed, "collar").otherwise("tangent")
    return c.select("hole", kind.alias("kind"), top.alias("start"), F.when(~blocked, end).alias("valid_to"), F.concat_ws(",", codes).alias("codes"), blocked.alias("blocked"))


def support_faults(rows: DataFrame) -> DataFrame:
    """Supports (id, kind, from_md, to_md, at_md) whose depths don't suit their kind."""
    a, b, at = F.col("from_md"), F.col("to_md"), F.col("at_md")
    span = F.coalesce((a >= 0) & (a < b), F.lit(False)) & at.isNull()
    point = F.coalesce(at >= 0, F.lit(False)) & a.isNull() & b.isNull()
    sound = F.when(F.col("kind").isin("interval", "sampling-envelope"), span).when(F.col("kind") == "point", point).otherwise(a.isNull() & b.isNull() & at.isNull())
    return rows.where(~sound).select("id", "kind")


def determination_faults(rows: DataFrame) -> DataFrame:
    """Determinations (id, state, value, qualifier, limit) whose value, qualifier and limit don't suit their state."""
    value, qualifier, state = F.col("value"), F.col("qualifier"), F.col("state")
    finite = value.isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    measured = finite & qualifier.eqNullSafe("=")
    censored = value.isNull() & qualifier.eqNullSafe(F.when(state == "censored-below", "<").otherwise(">")) & F.coalesce(F.col("limit") > 0, F.lit(False))
    sound = F.when(state == "measured", measured).when(state.isin("censored-below", "censored-above"), censored).otherwise(value.isNull() & qualifier.isNull())
    return rows.where(~sound).select("id", "state")


def overlay_fragments(geometries: DataFrame, logs: DataFrame) -> DataFrame:
    """(hole, from_md, to_md, lo, hi, logs, codes): each distinct interval of a hole with logs, cut once at the logs' ends inside it.

    `logs` counts the logs that cover a fragment, `codes` lists their known codes. Fragments add up to their interval.
    """
    g = geometries.where("from_md >= 0 AND to_md > from_md").select("hole", "from_md", "to_md").distinct().join(logs.select("hole").distinct(), "hole", "left_semi")
    ends = logs.select("hole", F.explode(F.array("from_md", "to_md")).alias("cut")).distinct()
    inner = g.join(ends, "hole").where("cut > from_md AND cut < to_md")
    cuts = inner.union(g.withColumn("cut", F.col("from_md")))
    key = ["hole", "from_md", "to_md"]
    after = F.lead("cut").over(Window.partitionBy(*key).orderBy("cut"))
    pieces = cuts.select(*key, F.col("cut").alias("lo"), F.coalesce(after, F.col("to_md")).alias("hi"))
    cover = logs.select("hole", F.col("from_md").alias("a"), F.col("to_md").alias("b"), "code")
    met = pieces.join(cover, (pieces.hole == cover.hole) & (F.col("a") < F.col("hi")) & (F.col("b") > F.col("lo")), "left").select(*(pieces[c] for c in pieces.columns), "code", "a")
    return met.groupBy(*key, "lo", "hi").agg(F.count("a").alias("logs"), F.concat_ws(",", known_codes(F.collect_set("code"))).alias("codes"))


def binding_faults(records: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(id, field): the fields in which a record differs from what it is bound to; null differs."""
    differ = F.explode(F.filter(F.array(*(F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in expected.items())), lambda x: x.isNotNull())).alias("field")
    return records.select("id", differ)


def membership(assignment: DataFrame, holes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (hole, split): (hole, times) for holes not assigned just once, and (split, holes, digest), the digest being independent of order."""
    times = holes.select("hole").distinct().join(assignment.groupBy("hole").agg(F.count("*").alias("n")), "hole", "full_outer").select("hole", F.coalesce("n", F.lit(0)).alias("times"))
    known = times.join(holes.select("hole", F.lit(True).alias("known")).distinct(), "hole", "left")
    number = F.conv(F.substring(F.md5(F.col("hole").cast("string")), 1, 8), 16, 10).cast("long")
    return known.where("times <> 1 OR known IS NULL").select("hole", "times"), assignment.groupBy("split").agg(F.count("*").alias("holes"), F.sum(number).alias("digest"))


def tops_and_cover(logs: DataFrame, basement: list[str]) -> DataFrame:
    """(hole, top, covered, unmapped): the first basement depth of each hole and the length above it with and without a category, clipped there."""
    top = F.min(F.when(F.col("category").isin(basement), F.col("from_md"))).over(Window.partitionBy("hole"))
    rows = logs.withColumn("top", top).where("top IS NOT NULL")
    length = F.when(F.col("from_md") < F.col("top"), F.least("to_md", "top") - F.col("from_md")).otherwise(0.0)
    return rows.groupBy("hole", "top").agg(F.sum(F.when(F.col("category").isNotNull(), length).otherwise(0.0)).alias("covered"), F.sum(F.when(F.col("category").isNull(), length).otherwise(0.0)).alias("unmapped"))


def above_and_below(rows: DataFrame, inside: str) -> DataFrame:
    """Log rows with the known categories before and after them in their hole, and whether they lie between two of `inside`: a rule's position clause."""
    order = Window.partitionBy("hole").orderBy("from_md", "to_md", "sample")
    before = F.last("category", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("category", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"before": before, "after": after}).withColumn("between", F.coalesce((F.col("before") == inside) & (F.col("after") == inside), F.lit(False)))
