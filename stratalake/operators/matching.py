"""Joins by key, depth and distance, classification by rules, and splits of holes.

Null keys match nothing. Repeated rows count as often as they occur unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.operators.ranks import ranked_values
from stratalake.operators.spatial import cell_pairs


def by_rules(rules: list[tuple[str, list[str], str | None]], code: Column, description: Column, other: str | None = None) -> Column:
    """Category of the first rule (category, codes, prefix of the description) that matches; no codes or prefix: any."""
    out = F
    for category, codes, prefix in rules:
        fits = (code.isin(codes) if codes else F.lit(True)) & (description.startswith(prefix) if prefix else F.lit(True))
        out = out.when(fits, category)
    return out.otherwise(other) if rules else F.lit(other).cast("string")


def unique_key_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join over the keys that occur once on both sides."""

    def once(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in others)).where("_n = 1").drop("_n")

    return once(left).join(once(right), keys)


def offset_match(rows: DataFrame, reference: DataFrame, offsets: tuple[int, ...] = (0, -2, -1, 1, 2)) -> DataFrame:
    """(hole, depth, offset): the first offset at which the reference holds the depth with an equal value; null if none.

    Both tables are (hole, depth, value); the offsets are tried in their order.
    """
    tried = rows.select("hole", "depth", "value", F.posexplode(F.array(*map(F.lit, offsets))).alias("turn", "offset"))
    known = reference.select("hole", F.col("depth").alias("at"), "value").distinct()
    met = tried.withColumn("at", F.col("depth") + F.col("offset")).join(known, ["hole", "at", "value"]).groupBy("hole", "depth", "value").agg(F.min_by("offset", "turn").alias("offset"))
    return rows.select("hole", "depth", "value").join(met, ["hole", "depth", "value"], "left")


def segment_of(targets: DataFrame, stations: DataFrame) -> DataFrame:
    """(hole, id, md, md0, md1): the stations around each target depth, in one window pass; null md1 beyond the last.

    A target on a station belongs to the segment that starts there. Targets above the first station have a null md0.
    """
    after = Window.partitionBy("hole").orderBy("md")
    s = stations.select("hole", "md").distinct().withColumn("next", F.lead("md").over(after))
    both = s.select("hole", "md", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.struct("md", "next").alias("station")).unionByName(
        targets.select("hole", "md", F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("struct<md:double,next:double>").alias("station"))
    )
    w = Window.partitionBy("hole").orderBy("md", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("s", F.last("station", True).over(w)).where("kind = 1").select("hole", "id", "md", F.col("s.md").alias("md0"), F.col("s.next").alias("md1"))


def nearest_other(points: DataFrame, first_radius: float) -> DataFrame:
    """(id, nearest_id, distance) of every point with another one, ties to the smaller id.

    Points meet in grid cells of a radius that doubles for those without a neighbour yet, so no cross join is made.
    """
    box = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y"))).first()
    widest = 0.0 if box["n"] < 2 else max(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]) * 2 + first_radius
    left, radius, found = points.select("id", "x", "y"), first_radius, None
    while True:
        met = cell_pairs(left, points, radius).where("id <> id_2").groupBy("id").agg(F.min(F.struct("distance", F.col("id_2").alias("nearest_id"))).alias("best")).select("id", "best.nearest_id", "best.distance")
        found = met if found is None else found.unionByName(met)
        if radius > widest:
            return found
        left = left.join(met.select("id"), "id", "left_anti")
        if left.isEmpty():
            return found
        radius *= 2


def outermost(points: DataFrame, share: float) -> DataFrame:
    """The share of points (rounded up) farthest from their centre, by falling distance and id; rows of one id stay together.

    The last distance and id that belong to it are found from counts, so that the points themselves are only filtered.
    """
    centre = points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n")).first()
    if not centre["n"]:
        return points.withColumn("distance", F.lit(0.0))
    away = F.sqrt(F.pow(F.col("x") - centre["cx"], 2) + F.pow(F.col("y") - centre["cy"], 2))
    placed, wanted = points.withColumn("distance", F.round(away, 9)), -int(-share * centre["n"] // 1)
    nth = lambda table, rank: table.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).first()
    edge = nth(ranked_values(placed.withColumn("nearness", -F.col("distance")), [], "nearness"), wanted)
    if edge is None:
        return placed.where("false")
    tied = placed.where(F.col("distance") == -edge["value"])
    last = nth(ranked_values(tied, [], "id"), wanted - edge["upto"] + edge["n"])
    return placed.where((F.col("distance") > -edge["value"]) | ((F.col("distance") == -edge["value"]) & (F.col("id") <= last["value"])))


def margin_split(points: DataFrame, share: float, buffer: float) -> DataFrame:
    """(id, split): outermost points are test, others within `buffer` of one are buffered, the rest train."""
    test = outermost(points, share).select("id", "x", "y")
    near = cell_pairs(points.select("id", "x", "y").join(test.select("id"), "id", "left_anti"), test, buffer).select("id").distinct()
    marked = points.select("id").join(test.select("id", F.lit(True).alias("test")), "id", "left").join(near.withColumn("near", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.col("test"), "test").when(F.col("near"), "buffered").otherwise("train").alias("split"))


def in_domain(domain: Column, target: Column, distance: Column, soft: float | None = None) -> Column:
    """Whether an observation may inform a target: of the same domain, or within the soft distance of it."""
    same = domain.eqNullSafe(target)
    return same if soft is None else same | (distance <= soft)


def common_targets(predictions: DataFrame, methods: int) -> DataFrame:
    """Targets that so many methods predicted."""
    return predictions.where("estimate IS NOT NULL").groupBy("target").agg(F.countDistinct("method").alias("methods")).where(F.col("methods") == methods).select("target")


def numbered(rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """`unique_id`: the id, with #2, #3, ... on its later rows."""
    nth = F.row_number().over(Window.partitionBy(id_column).orderBy(*order))
    name = F.col(id_column).cast("string")
    return rows.withColumn("nth", nth).withColumn("unique_id", F.when(F.col("nth") == 1, name).otherwise(F.concat(name, F.lit("#"), F.col("nth")))).drop("nth")


def moved_samples(rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """Rows whose interval differs from that of the first row of the same sample id."""
    w = Window.partitionBy(id_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.withColumn("first_from", F.first("from_md").over(w)).withColumn("first_to", F.first("to_md").over(w))
    return first.where(~(F.col("from_md").eqNullSafe(F.col("first_from")) & F.col("to_md").eqNullSafe(F.col("first_to"))))


def findings(rows: DataFrame, file: str, rules: dict[str, Column]) -> DataFrame:
    """(file, finding, rows): how many rows break each rule, in one pass; rules that nothing breaks are left out."""
    broken = F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())).alias("finding")
    return rows.select(F.lit(file).alias("file"), broken).groupBy("file", "finding").agg(F.count("*").alias("rows"))


def scenario_states(registry: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Every registered scenario with its state: verified, computed (not verified yet) or missing."""
    known = metrics.groupBy(*keys).agg(F.max(F.col("verified").cast("int")).alias("verified"))
    return registry.join(known, keys, "left").withColumn("state", F.when(F.col("verified") == 1, "verified").when(F.col("verified") == 0, "computed").otherwise("missing")).drop("verified")


def permutation_cut(ids: DataFrame, shares: dict[str, float], seed: str) -> DataFrame:
    """(id, split): distinct ids in the order of a seeded hash, cut into shares whose sizes are rounded by the largest remainder.

    Ties of remainders go to the share named first. Ranks come from counts over stretches, so no task holds all ids.
    """
    hashed = ids.select("id").where("id IS NOT NULL").distinct().withColumn("at", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long"))
    n = hashed.count()
    exact = {name: n * share / sum(shares.values()) for name, share in shares.items()}
    sizes = {name: int(x) for name, x in exact.items()}
    for name in sorted(exact, key=lambda k: sizes[k] - exact[k])[: n - sum(sizes.values())]:
        sizes[name] += 1
    split, end = F, 0
    for name, size in sizes.items():
        end += size
        split = split.when(F.col("upto") <= end, name)
    ranked = ranked_values(hashed, [], "at").select(F.col("value").alias("at"), "upto")
    return hashed.join(ranked, "at").select("id", split.alias("split"))
