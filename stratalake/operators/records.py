"""Predicates, directions, alterations and checks on records and tables between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.functions.parsing import direction


def interval_fault(from_md: Column, to_md: Column, points: bool = False) -> Column:
    """Why an interval is refused, else null; logs may have no length (`points`)."""
    short = from_md > to_md if points else from_md >= to_md
    return F.when(from_md.isNull() | to_md.isNull(), "depth missing").when(from_md < 0, "depth below 0").when(short, "no length")


def station_fault(md: Column, dip: Column) -> Column:
    return F.when(md.isNull() | (md < 0), "depth").when(dip.isNull() | (F.abs(dip) > 90), "dip")


def plane_normal(dip: Column, dip_direction: Column) -> tuple[Column, Column, Column]:
    """Upward unit normal (east, north, up) of a plane, in degrees."""
    slope, towards = F.radians(dip), F.radians(dip_direction)
    return F.sin(slope) * F.sin(towards), F.sin(slope) * F.cos(towards), F.cos(slope)


def with_direction(rows: DataFrame) -> DataFrame:
    """Rows (azimuth, dip, ...) with direction cosines east, north, up."""
    return rows.select("*", *(c.alias(name) for name, c in zip(("east", "north", "up"), direction(F.col("azimuth"), F.col("dip")))))


def quarantine_zero_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`quarantined`: whether all measured columns of a row are 0; nulls are not 0."""
    return rows.withColumn("quarantined", F.forall(F.array(*columns), lambda x: F.coalesce(x == 0, F.lit(False))))


def long_form(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, property, value) of the populated cells of columns of one type."""
    return rows.unpivot(keys, columns, "property", "value").where("value IS NOT NULL")


def angle_faults(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose derived inclination is not 90 + dip."""
    return rows.where(F.abs(F.col("inclination") - 90 - F.col("dip")) > tolerance)


def canonical_lookup(rows: DataFrame) -> DataFrame:
    """(hole, from_md, support, originals): the least support at a place and its properties' values by name, the greatest of several."""
    one = rows.where("value IS NOT NULL").groupBy("hole", "from_md", "property").agg(F.min("support").alias("support"), F.max("value").alias("value"))
    return one.groupBy("hole", "from_md").agg(F.min("support").alias("support"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("originals"))


#: Alterations of a value for review tests: factors, and steps in the scaled space of `robust_asinh`.
FACTORS = {"unchanged": 1.0, "times 10": 10.0, "times 10000": 10000.0}
STEPS = {"step 0.25": 0.25, "step 1": 1.0, "step 3": 3.0}


def alterations(rows: DataFrame, median: float, iqr: float) -> DataFrame:
    """(id, kind, value): each value (id, value) as it is and as each alteration has it."""
    scaled = F.asinh((F.col("value") - median) / iqr)
    kinds = [F.struct(F.lit(k).alias("kind"), (F.col("value") * f).alias("value")) for k, f in FACTORS.items()]
    kinds += [F.struct(F.lit(k).alias("kind"), (F.sinh(scaled + step) * iqr + median).alias("value")) for k, step in STEPS.items()]
    return rows.select("id", F.explode(F.array(*kinds)).alias("x")).select("id", "x.kind", "x.value")


def column_lineage(columns: DataFrame, described: DataFrame) -> DataFrame:
    """(column, state, copies): whether a column (column, digest) is described, and how many columns hold the same content."""
    copies = columns.groupBy("digest").agg(F.count("*").alias("copies"))
    known = described.select("column").distinct().withColumn("state", F.lit("described"))
    return columns.join(copies, "digest").join(known, "column", "left").select("column", F.coalesce("state", F.lit("undescribed")).alias("state"), "copies")


def unit_thickness(logs: DataFrame, units: list[str]) -> DataFrame:
    """(unit, holes, mean, deviation) of vertical thickness (hole, unit, from_md, to_md, dip) over all holes; holes without a dip are excluded."""
    usable = logs.withColumn("steep", F.abs(F.sin(F.radians("dip"))))
    by_hole = usable.groupBy("hole").agg(F.count_if(F.col("steep").isNull()).alias("unknown"), *(F.coalesce(F.sum(F.when(F.col("unit") == u, (F.col("to_md") - F.col("from_md")) * F.col("steep"))), F.lit(0.0)).alias(u) for u in units)).where("unknown = 0")
    return by_hole.unpivot(["hole"], units, "unit", "thickness").groupBy("unit").agg(F.count("*").alias("holes"), F.avg("thickness").alias("mean"), F.stddev_pop("thickness").alias("deviation"))


def mapped_length(pieces: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, category, length): length of straight pieces (x, y, x_2, y_2, category, length) by the grid cell of their middle."""
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / cell)
    return pieces.groupBy(middle("x", "x_2").alias("cx"), middle("y", "y_2").alias("cy"), "category").agg(F.sum("length").alias("length"))


def composite_faults(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(id, fault) of composites (id, numerator, covered, length, mean): cover outside the length, a mean that is not numerator over cover."""
    off = F.abs(F.col("mean") * F.col("covered") - F.col("numerator")) > tolerance * F.greatest(F.lit(1.0), F.abs("numerator"))
    faults = F.array(
        F.when((F.col("covered") < 0) | (F.col("covered") > F.col("length") * (1 + tolerance)), "cover outside the length"),
        F.when(F.col("mean").isNotNull() & off, "mean not conserved"), F.when((F.col("covered") > 0) & F.col("mean").isNull(), "mean missing"),
    )
    return rows.select("id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def share_faults(rows: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, total): groups whose shares do not sum to 1."""
    return rows.groupBy(*keys).agg(F.sum("share").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def incomplete_targets(predictions: DataFrame, targets: DataFrame, methods: int) -> DataFrame:
    """(target, predicted): targets that not all methods predicted exactly once, those of none included."""
    found = predictions.groupBy("target").agg(F.count("*").alias("predicted"), F.countDistinct("method").alias("kinds"))
    met = targets.select("target").join(found, "target", "left").select("target", F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
    return met.where((F.col("predicted") != methods) | (F.col("kinds") != methods)).select("target", "predicted")


def weight_faults(jobs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(id, fault) of supports (id, points, weights), both arrays: lengths that differ, weights that do not sum to 1."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    fault = F.when(F.size("points") != F.size("weights"), "lengths differ").when(F.abs(total - 1) > tolerance, "weights do not sum to 1")
    return jobs.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def admissible(jobs: DataFrame, items: DataFrame, most: int, budget: float) -> DataFrame:
    """(job, reason) for each job (job, work): first why it is refused, else null; items are (job, item)."""
    held = items.groupBy("job").agg(F.count("*").alias("n"), F.countDistinct("item").alias("kinds"))
    met = jobs.join(held, "job", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "no items").when(F.col("n") > most, "too many items").when(F.col("kinds") < F.col("n"), "repeated items").when(F.col("work") > budget, "over budget")
    return met.select("job", reason.alias("reason"))


def chain_faults(reads: DataFrame, outputs: DataFrame) -> DataFrame:
    """(stage, source, fault): stages (stage, source, digest) that read a table (source, digest) which is absent or has changed since."""
    met = reads.join(outputs.select("source", F.col("digest").alias("now"), F.lit(True).alias("held")), "source", "left")
    return met.select("stage", "source", F.when(F.col("held").isNull(), "absent").when(~F.col("digest").eqNullSafe(F.col("now")), "changed").alias("fault")).where("fault IS NOT NULL")


def dependent_counts(holes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(hole, a column of counts for each role): records of every hole in tables with a column `hole`, 0 where there is none."""
    found = holes.select("hole").distinct()
    for role, table in tables.items():  # a declared few
        found = found.join(table.groupBy("hole").agg(F.count("*").alias(role)), "hole", "left")
    return found.select("hole", *(F.coalesce(role, F.lit(0)).alias(role) for role in tables))
