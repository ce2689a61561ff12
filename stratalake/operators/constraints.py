"""Checks of committed tables: many rules in one scan of each table, keys, references, and outputs that belong together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from stratalake.storage import written


@dataclass(frozen=True)
class Check:
    """Rules of one table: conditions that a row breaks, columns that tell rows apart, and columns that name rows of other tables.

    references: (column, table, its column); a null refers to nothing and breaks no reference.
    """

    table: str
    key: str
    rows: dict[str, Column] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()


def broken_rows(df: DataFrame, check: Check) -> tuple[DataFrame, Observation]:
    """(table, rule, id) of every row and rule that it breaks, and an observation of the same scan: `rows` read and the breaks of each rule by its place."""
    seen = Observation(f"check {check.table}")
    held = {name: F.coalesce(broken, F.lit(False)) for name, broken in check.rows.items()}
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(b).alias(f"rule_{i}") for i, b in enumerate(held.values())))
    named = F.filter(F.array(*(F.when(b, F.lit(n)) for n, b in held.items())), lambda x: x.isNotNull()) if held else F.array().cast("array<string>")
    found = counted.select(F.lit(check.table).alias("table"), F.explode(named).alias("rule"), F.col(check.key).cast("string").alias("id"))
    return found, seen


def run_checks(tables: dict[str, DataFrame], checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """(findings (table, rule, id), summary (table, rule, rows, broken)) of all checks; tables that are not there are findings of their own.

    Row rules of a table take one scan, whose counts come from the scan itself; keys and references take one grouping or
    anti-join each. The summary has a row for each table and rule, kept or broken.
    """
    spark = next(iter(tables.values())).sparkSession
    parts, told = [], []
    absent = [(c.table, "absent table", None) for c in checks if c.table not in tables]
    parts.append(spark.createDataFrame(absent, "table string, rule string, id string"))
    for c in checks:
        if c.table not in tables:
            told.append((c.table, "absent table", 0, 1))
            continue
        df = tables[c.table]
        found, seen = broken_rows(df, c)
        kept = written(found)
        parts.append(kept)
        counts = seen.get
        told += [(c.table, rule, counts["rows"], counts[f"rule_{i}"]) for i, rule in enumerate(c.rows)]
        pieces = []
        for column in c.unique:
            twice = df.groupBy(column).count().where("count > 1")
            pieces.append((f"{column} not unique", twice.select(F.col(column).cast("string").alias("id"))))
        for column, other, theirs in c.references:
            if other in tables:
                known = tables[other].select(F.col(theirs).alias(column)).where(F.col(column).isNotNull()).distinct()
                pieces.append((f"{column} not in {other}", df.where(F.col(column).isNotNull()).join(known, column, "left_anti").select(F.col(c.key).cast("string").alias("id"))))
            else:
                pieces.append((f"{column} not in {other}", df.where(F.col(column).isNotNull()).select(F.col(c.key).cast("string").alias("id"))))
        for rule, ids in pieces:
            kept = written(ids.select(F.lit(c.table).alias("table"), F.lit(rule).alias("rule"), "id"))
            parts.append(kept)
            told.append((c.table, rule, counts["rows"], kept.count()))
    findings = parts[0]
    for p in parts[1:]:
        findings = findings.unionByName(p)
    return findings, spark.createDataFrame(told, "table string, rule string, rows long, broken long")


def learned_faults(predictions: DataFrame, ensembles: DataFrame, seeds: int, tolerance: float = 1e-9) -> DataFrame:
    """(configuration, target, fault) of ensembles (configuration, target, mean, spread) over predictions (configuration, seed, target, estimate).

    An ensemble is the mean and the population deviation of just `seeds` finite estimates, one of each seed, and every
    predicted target has one.
    """
    finite = F.col("estimate").isNotNull() & ~F.isnan("estimate") & (F.abs("estimate") < float("inf"))
    keys = ["configuration", "target"]
    met = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("seed").alias("seeds"), F.count_if(~finite).alias("odd"), F.avg("estimate").alias("own_mean"), F.stddev_pop("estimate").alias("own_spread"))
    both = met.join(ensembles.withColumn("told", F.lit(True)), keys, "full")
    far = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > tolerance * F.greatest(F.lit(1.0), F.abs(b)), F.lit(True))
    here, told, sound = F.col("n").isNotNull(), F.col("told").isNotNull(), F.coalesce(F.col("odd") == 0, F.lit(False))
    faults = F.array(
        F.when(~here, "no predictions"), F.when(here & ((F.col("n") != seeds) | (F.col("seeds") != seeds)), "seeds missing or repeated"), F.when(here & (F.col("odd") > 0), "estimate not finite"),
        F.when(here & ~told, "no ensemble"), F.when(sound & told & far("mean", "own_mean"), "mean is another"), F.when(sound & told & far("spread", "own_spread"), "spread is another"),
    )
    return both.select(*keys, F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def flag_faults(reviews: DataFrame, bands: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(id, property, fault) of reviews (id, property, value, predicted, residual, flagged) against bands (property, low, high): residual and flag must follow from them."""
    rows = reviews.join(bands, "property", "left")
    outside = (F.col("residual") < F.col("low")) | (F.col("residual") > F.col("high"))
    faults = F.array(
        F.when(F.col("low").isNull() | F.col("high").isNull(), "no band"), F.when(F.coalesce(F.abs(F.col("value") - F.col("predicted") - F.col("residual")) > tolerance * F.greatest(F.lit(1.0), F.abs("value")), F.col("value").isNotNull()), "residual is another"),
        F.when(F.col("low").isNotNull() & ~outside.eqNullSafe(F.col("flagged")), "flag is another"),
    )
    return rows.select("id", "property", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def categorical_faults(chances: DataFrame, categories: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(target, fault) of chances (target, category, probability): from 0 to 1, of declared categories, each once, adding up to 1."""
    p = F.col("probability")
    met = chances.groupBy("target").agg(
        F.count("*").alias("n"), F.countDistinct("category").alias("kinds"), F.count_if(~F.coalesce(F.col("category").isin(categories), F.lit(False))).alias("unknown"),
        F.count_if(~F.coalesce((p >= 0) & (p <= 1), F.lit(False))).alias("odd"), F.sum(p.cast("decimal(38,12)")).alias("total"),
    )
    faults = F.array(
        F.when(F.col("unknown") > 0, "unknown category"), F.when((F.col("n") != len(categories)) | (F.col("kinds") != F.col("n")), "categories missing or repeated"),
        F.when(F.col("odd") > 0, "no probability"), F.when((F.col("odd") == 0) & (F.abs(F.col("total") - 1) > tolerance), "not 1 in all"),
    )
    return met.select("target", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def stale_cells(matrix: DataFrame, artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """(scenario, fault): cells (scenario, state, artifact, digest) of a matrix against artifacts (artifact, digest) and the registered scenarios (scenario)."""
    cells = matrix.join(artifacts.select("artifact", F.col("digest").alias("now")), "artifact", "left").select("scenario", "state", "artifact", "digest", "now")
    rows = cells.join(registry.select("scenario").distinct().withColumn("named", F.lit(True)), "scenario", "full")
    claimed = F.col("state").isin("computed", "verified")
    fault = F.when(F.col("named").isNull(), "not registered").when(F.col("state").isNull(), "no cell").when(claimed & F.col("now").isNull(), "no artifact").when(claimed & ~F.col("digest").eqNullSafe(F.col("now")), "stale").when(~claimed & F.col("artifact").isNotNull(), "artifact without a result")
    return rows.select("scenario", fault.alias("fault")).where("fault IS NOT NULL")
