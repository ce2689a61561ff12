"""Programs of families from declared configurations: populations, waterfalls, records beyond depth, and split schemes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.operators.anchored import passing
from stratalake.operators.intervals import TOLERANCE, gaps, sound
from stratalake.operators.matching import nearest_other, outermost, permutation_cut
from stratalake.operators.ranks import quantiles
from stratalake.operators.spatial import cell_pairs
from stratalake.storage import placed_rows, written

#: Shares of the four splits, of the rest where test is given; least holes of a family; outermost share; buffer in median spacings.
SHARES = {"train": 60.0, "validation": 15.0, "calibration": 10.0, "test": 15.0}
LEAST_HOLES, MARGIN, BUFFER = 4, 0.15, 1.5
#: Columns of a support.
SUPPORT = ["id", "hole", "sample", "from_md", "to_md", "kind", "analyte", "value"]


def anchored_composites(intervals: DataFrame, lengths: list[float], least: float) -> DataFrame:
    """(hole, length, k, analyte, lo, hi, numerator, covered, parents, observed, mean, status): composites of several lengths that start at a hole's first depth.

    Samples are dealt out by hole once and pass in order (`operators/anchored.py`), so that composites are neither shuffled nor
    sorted nor kept. Those that no sample meets are insufficient. `parents` lists samples by number, `observed` is the mean
    where there is cover but not enough, `mean` where there is.
    """
    hole = Window.partitionBy("hole")
    rows = sound(intervals).select("hole", "analyte", "sample", *(F.col(c).cast("double").alias(c) for c in ("from_md", "to_md", "value")))
    reach = rows.withColumns({"first": F.min("from_md").over(hole), "deep": F.max("to_md").over(hole)}).where("analyte IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    form = f"hole {kinds['hole']}, analyte {kinds['analyte']}, first double, deep double, length double, k int, numerator double, covered double, parents array<{kinds['sample']}>"
    met = reach.sortWithinPartitions("hole", "analyte", "from_md", "sample").mapInArrow(passing(tuple(map(float, lengths)), TOLERANCE), form)
    low = F.col("first") + F.col("k") * F.col("length")
    hi = F.least(low + F.col("length"), F.col("deep"))
    enough = F.col("covered") / (hi - low) >= least - TOLERANCE
    mean = F.when(F.col("covered") > 0, F.col("numerator") / F.col("covered"))
    status = F.when(~enough, "insufficient").when(hi - low < F.col("length") - TOLERANCE, "residual").otherwise("full")
    return met.select("hole", "length", "k", "analyte", low.alias("lo"), hi.alias("hi"), "numerator", "covered", "parents", F.when(~enough, mean).alias("observed"), F.when(enough, mean).alias("mean"), status.alias("status"))


@dataclass(frozen=True)
class Population:
    """Members of one task: supports that fulfil the condition `where`, or composites of `length` of one status; none where `refused` says why."""

    id: str
    task: str
    where: str | None = None
    length: float | None = None
    status: str = "full"
    analyte: str | None = None
    refused: str | None = None


@dataclass(frozen=True)
class Family:
    """What a family computes: lengths and least coverage of composites, populations, and counted steps of its waterfall."""

    name: str
    lengths: tuple[float, ...] = ()
    least: float = 1.0
    populations: tuple[Population, ...] = ()
    steps: dict[str, str] = field(default_factory=dict)


def imported_family(name: str, analytes: list[str], lengths: tuple[float, ...], least: float) -> Family:
    """The family of a project that a user imported: for each analyte the measured intervals and full composites of each length."""
    found = []
    for a in analytes:
        found.append(Population(f"{name}-{a}-native", "estimation", analyte=a))
        found += [Population(f"{name}-{a}-{x:g}m", "estimation", length=x, analyte=a) for x in lengths]
    return Family(name, lengths, least, tuple(found))


def _members(rows: DataFrame, tests: list[tuple[Population, Column, Column]]) -> DataFrame:
    """(population, task, member, hole): `rows` in each population whose condition they fulfil, in one pass. A test is a population, its condition and the member's name."""
    named = [F.when(met, F.struct(F.lit(p.id).alias("population"), F.lit(p.task).alias("task"), name.alias("member"))) for p, met, name in tests]
    return rows.select("hole", F.explode(F.array_compact(F.array(*named))).alias("found")).select("found.*", "hole")


def run_family(family: Family, supports: DataFrame, collars: DataFrame) -> dict[str, DataFrame]:
    """Tables of a family over supports (id, hole, sample, from_md, to_md, kind, analyte, value) and collars (hole, depth).

    composites; populations (population, task, member, hole); counts (population, members, holes, reason); waterfall
    (step, n, full, residual, insufficient); beyond (id, hole); repeats (hole, from_md, to_md, ids); gaps. A support of
    several analytes has a row each and counts once by id. The plan of every table follows from the declaration alone, and
    nothing is computed or written before a table is read.
    """
    spark = supports.sparkSession
    # Every part of a table reads the supports under the same observed digest of all their columns. So no part's columns and
    # conditions reach below it, and supports that are dealt out by hole are shuffled once for all parts.
    supports = supports.observe(uuid.uuid4().hex, F.bit_xor(F.xxhash64(*SUPPORT)).alias("digest"))
    intervals = supports.where("kind = 'interval'")
    out: dict[str, DataFrame] = {"gaps": gaps(intervals)}
    if family.lengths:
        out["composites"] = anchored_composites(intervals, list(family.lengths), family.least)
    members = spark.createDataFrame([], "population string, task string, member string, hole " + supports.schema["hole"].dataType.simpleString())
    of_supports, of_composites = [], []
    for p in family.populations:  # a declared few
        analyte = F.col("analyte") == p.analyte if p.analyte else F.lit(True)
        if p.refused:
            continue
        if p.length is not None:
            of_composites.append((p, analyte & (F.col("length") == p.length) & (F.col("status") == p.status), F.concat_ws("/", F.col("hole").cast("string"), F.lit(f"{p.length:g}"), "k")))
        else:
            of_supports.append((p, analyte & F.expr(p.where) if p.where else analyte, F.col("id").cast("string")))
    if of_supports:
        members = members.unionByName(_members(supports, of_supports).distinct())
    if of_composites:
        found = _members(out["composites"], of_composites)
        members = members.unionByName(found if all(p.analyte for p, *_ in of_composites) else found.distinct())  # a composite of an analyte is a row
    out["populations"] = members
    counts = members.groupBy("population").agg(F.count("*").alias("members"), F.countDistinct("hole").alias("holes"))
    declared = spark.createDataFrame([(p.id, p.task, p.refused) for p in family.populations], "population string, task string, reason string")
    out["counts"] = declared.join(counts, "population", "left").select("population", "task", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("holes", F.lit(0)).alias("holes"), "reason")
    place = ["hole", "from_md", "to_md"]
    shared = intervals.select(*place, "id", *(f("id").over(Window.partitionBy(*place)).alias(c) for c, f in (("least", F.min), ("most", F.max)))).where("least < most")
    out["repeats"] = shared.groupBy(*place).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    limit = collars.where("depth IS NOT NULL").select("hole", "depth")
    out["beyond"] = supports.join(limit, "hole").where(F.greatest("from_md", "to_md") > F.col("depth")).select("id", "hole").distinct()
    none = [F.lit(None).cast("long").alias(c) for c in ("full", "residual", "insufficient")]
    named = {"supports": "true", **family.steps}
    ids = supports.where("id IS NOT NULL").groupBy("id").agg(*(F.max(F.coalesce(F.expr(c), F.lit(False))).alias(f"_{i}") for i, c in enumerate(named.values())))
    held = ids.agg(*(F.count_if(f"_{i}").alias(f"_{i}") for i in range(len(named))))
    steps = [held.select(F.explode(F.array(*(F.struct(F.lit(name).alias("step"), F.col(f"_{i}").alias("n")) for i, name in enumerate(named)))).alias("s")).select("s.*")]
    steps += [out["repeats"].agg(F.lit("repeated intervals").alias("step"), F.count("*").alias("n")), out["beyond"].agg(F.lit("beyond depth").alias("step"), F.count("*").alias("n"))]
    rows = [s.select("step", "n", *none) for s in steps]
    if family.lengths:
        named = F.format_string("%s m composites", F.regexp_replace(F.col("length").cast("string"), "[.]0$", ""))
        by = out["composites"].groupBy("length").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in ("full", "residual", "insufficient")))
        rows.append(by.select(named.alias("step"), "n", "full", "residual", "insufficient"))
    out["waterfall"] = reduce(DataFrame.unionByName, rows)
    return out


def _cut(holes: DataFrame, shares: dict[str, float], seed: str) -> DataFrame:
    return permutation_cut(holes.select(F.col("hole").alias("id")), shares, seed).select(F.col("id").alias("hole"), "split")


def split_schemes(collars: DataFrame, seed: str, holdout: list | None = None, least: int = LEAST_HOLES) -> tuple[DataFrame, str | None]:
    """(scheme, hole, split) of collars (hole, x, y), a row each, and why there is none: too few holes.

    hole-group cuts all holes by a seeded order; spatial-margin tests on the outermost share, sets holes within 1.5 median
    spacings of it aside (`buffered`) and cuts the rest in three; declared tests on the holdout. A holdout hole that is no
    collar raises.
    """
    spark, three = collars.sparkSession, {k: v for k, v in SHARES.items() if k != "test"}
    n = collars.select("hole").distinct().count()
    form = f"scheme string, hole {collars.schema['hole'].dataType.simpleString()}, split string"
    if n < least:
        return spark.createDataFrame([], form), f"{n} holes; a grouped split needs at least {least}"
    parts = [_cut(collars, SHARES, seed).withColumn("scheme", F.lit("hole-group"))]
    placed = placed_rows(collars.select("hole", "x", "y"), "hole")  # ids of any type, by their order
    points = placed.select(F.col("place").alias("id"), "x", "y")
    extent = points.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w")).first()["w"]
    near = written(nearest_other(points, max(extent / max(1.0, n**0.5), 1e-9)))
    spacing = quantiles(near, [], "distance", {"median": 0.5}).first()["median"]
    test = written(outermost(points, MARGIN).select("id", "x", "y"))
    inner = points.join(test, "id", "left_anti")
    reach = max(BUFFER * spacing, 1e-9)
    buffered = written(cell_pairs(inner, test, reach).select("id").distinct())
    names = placed.select(F.col("place").alias("id"), "hole")
    rest = inner.join(buffered, "id", "left_anti").join(names, "id").select("hole")
    margin = _cut(rest, three, seed)
    for part, split in ((test, "test"), (buffered, "buffered")):
        margin = margin.unionByName(part.join(names, "id").select("hole", F.lit(split).alias("split")))
    parts.append(margin.withColumn("scheme", F.lit("spatial-margin")))
    if holdout:
        named = spark.createDataFrame([(h,) for h in dict.fromkeys(holdout)], f"hole {collars.schema['hole'].dataType.simpleString()}")
        if unknown := [r["hole"] for r in named.join(collars, "hole", "left_anti").limit(10).collect()]:
            raise ValueError(f"the holdout names holes that are not there: {unknown}")
        kept = _cut(collars.join(named, "hole", "left_anti"), three, seed).unionByName(named.withColumn("split", F.lit("test")))
        parts.append(kept.withColumn("scheme", F.lit("declared")))
    return reduce(DataFrame.unionByName, parts).select("scheme", "hole", "split"), None


def scheme_membership(schemes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(scheme, table, split, rows, digest) of derived tables (id, hole): rows follow their hole; the digest is independent of order. Buffered holes are in no split."""
    out = None
    for name, t in tables.items():
        met = t.select(F.col("id").cast("string").alias("id"), "hole").join(schemes.where("split <> 'buffered'"), "hole")
        one = met.groupBy("scheme", "split").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).cast("string").alias("digest")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("scheme", "table", "split", "rows", "digest")
