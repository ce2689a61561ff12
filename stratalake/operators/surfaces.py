"""Sums of a power of the inverse distance over all points, those far away through fields interpolated in boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from stratalake.storage import written

#: Chebyshev nodes of a box along each axis; points of a leaf box on average, as a point sees it; the deepest leaves; cells of a task's group.
ORDER, CROWD, DEEPEST, CHUNK = 24, 64, 16, 4096
NODES = np.cos(np.pi * (np.arange(ORDER) + 0.5) / ORDER)


def basis(at: np.ndarray) -> np.ndarray:
    """Values at places in [-1, 1] of the polynomials that are 1 at one node and 0 at the others."""
    k = np.arange(1, ORDER)
    return 1 / ORDER + 2 / ORDER * np.cos(np.arccos(np.clip(at, -1, 1))[:, None] * k) @ np.cos(np.arccos(NODES) * k[:, None])


def _power(square: np.ndarray, power: float) -> np.ndarray:
    return 1 / square if power == 2 else square ** (-power / 2)


def weighted_heights(cells: DataFrame, collars: DataFrame, power: float, block: int = 2048) -> DataFrame:
    """(id, z) of cells (id, x, y) with places, from collars (x, y, z) with places and heights: all weigh on each cell, whatever their distance.

    Boxes halve from a square around all. A collar meets a cell itself if they lie in the same or adjacent leaf boxes. Else
    there is one level at which their boxes aren't adjacent but those above are, and the collar counts in the field of the
    cell's box there: sums at ORDER x ORDER nodes, interpolated at the cell. The kernel is smooth at that distance, and the
    interpolation's error is below 4.2 ** -ORDER of it. So work grows with cells and collars, not their product.
    """
    kind = cells.schema["id"].dataType.simpleString()
    known = written(collars.groupBy("x", "y").agg(F.sum("z").alias("z"), F.count("*").cast("double").alias("n")))
    box = known.select("x", "y").union(cells.select("x", "y")).agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy")).first()
    x0, y0 = box["min_x"], box["min_y"]
    whole = max(box["max_x"] - x0, box["max_y"] - y0) * (1 + 1e-9) or 1.0
    count = known.count()
    parts = max(32, -(-count // block))

    def placed(df: DataFrame, level: int) -> DataFrame:
        step = whole / 2**level
        return df.select("*", *(F.least(F.floor((F.col(c) - o) / step), F.lit(2**level - 1)).cast("long").alias(f"b{c}") for c, o in (("x", x0), ("y", y0))))

    def above(leaf: int, *names: str) -> list:
        """Columns of the box at column `level` above that at the leaf level."""
        return [F.expr(f"shiftright(b{c}, {leaf} - level)").alias(n) for c, n in zip("xy", names)]

    levels = lambda top: F.explode(F.sequence(F.lit(2), F.lit(top))).alias("level")
    crowds = placed(known.repartition(parts, "x", "y"), DEEPEST).select("bx", "by", levels(DEEPEST)).groupBy("level", *above(DEEPEST, "bx", "by")).count()
    seen = {r["level"]: r["crowd"] for r in crowds.groupBy("level").agg((F.sum(F.col("count").cast("double") ** 2) / F.sum("count")).alias("crowd")).collect()}
    leaf = next((k for k in sorted(seen) if seen[k] <= CROWD), DEEPEST)

    sources = placed(known.repartition(parts, "x", "y"), leaf)
    asked = placed(cells, leaf)
    leaves = written(asked.groupBy("bx", "by").agg(F.ceil(F.count("*") / CHUNK).alias("parts")))
    each = sources.select("x", "y", "z", "n", "bx", "by", levels(leaf)).select("level", *above(leaf, "sx", "sy"), "x", "y", "z", "n")
    sizes = each.groupBy("level", "sx", "sy").agg(F.ceil(F.count("*") / block).alias("blocks"))
    lists = each.join(sizes, ["level", "sx", "sy"]).groupBy("level", "sx", "sy", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("x", "y", "z", "n")).alias("collars"))
    boxes = leaves.select("bx", "by", levels(leaf)).select("level", *above(leaf, "bx", "by")).distinct()
    range_of = lambda c: F.explode(F.expr(f"sequence(2 * shiftright({c}, 1) - 2, 2 * shiftright({c}, 1) + 3)"))
    met = boxes.select("*", range_of("bx").alias("sx")).select("*", range_of("by").alias("sy")).where("abs(bx - sx) > 1 OR abs(by - sy) > 1").join(lists, ["level", "sx", "sy"])
    met = met.repartition(parts, "level", "bx", "by", "block").sortWithinPartitions("level", "bx", "by").select("level", "bx", "by", "collars")

    def fields(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, wz = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in now), pa.array([w.ravel()]), pa.array([wz.ravel()])], names=["level", "ax", "ay", "w", "wz"])

        for batch in it:
            for k in range(batch.num_rows):
                at = tuple(batch.column(c)[k].as_py() for c in ("level", "bx", "by"))
                if at != now:
                    if now:
                        yield told()
                    now, w, wz = at, np.zeros((ORDER, ORDER)), np.zeros((ORDER, ORDER))
                    side = whole / 2 ** at[0]
                    xs, ys = x0 + (at[1] + (1 + NODES) / 2) * side, y0 + (at[2] + (1 + NODES) / 2) * side
                held = batch.column("collars")[k].values
                x, y, z, n = (held.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "n"))
                for i in range(0, len(x), 512):
                    part = slice(i, i + 512)
                    kernel = _power(((xs[:, None] - x[part]) ** 2)[:, None] + (ys[:, None] - y[part]) ** 2, power)
                    w += kernel @ n[part]
                    wz += kernel @ z[part]
        if now:
            yield told()

    far = met.mapInArrow(fields, "level long, ax long, ay long, w array<double>, wz array<double>")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    up = leaves.select("bx", "by", levels(leaf)).select("bx", "by", F.col("level").cast("long").alias("level"), *above(leaf, "ax", "ay"))
    far = up.join(far, ["level", "ax", "ay"]).select("bx", "by", "level", "ax", "ay", "w", "wz", *none("double", "x", "y", "z", "n"))
    beside = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    near = sources.select("*", beside.alias("dx")).select("*", beside.alias("dy")).select((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"), *none("long", "level", "ax", "ay"), *none("array<double>", "w", "wz"), "x", "y", "z", "n")
    dealt = asked.join(leaves, ["bx", "by"]).select("id", "x", "y", "bx", "by", F.pmod(F.xxhash64("id", "x", "y"), F.col("parts")).alias("part"))
    given = leaves.select("bx", "by", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")).join(near.unionByName(far), ["bx", "by"])

    def heights(group: pa.Table, given: pa.Table) -> pa.Table:
        at, (gx, gy) = group.column("id"), (group.column(c).to_numpy() for c in "xy")
        w, wz, h, hz = np.zeros((4, len(gx)))
        known = given.filter(pa.compute.is_null(given.column("level")))
        x, y, z, n = (known.column(c).to_numpy() for c in ("x", "y", "z", "n"))
        for i in range(0, len(x), 256):
            part = slice(i, i + 256)
            square = (gx[:, None] - x[part]) ** 2 + (gy[:, None] - y[part]) ** 2
            hit = square == 0
            kernel = np.where(hit, 0.0, _power(np.where(hit, 1.0, square), power))
            w, wz, h, hz = w + kernel @ n[part], wz + kernel @ z[part], h + hit @ n[part], hz + hit @ z[part]
        for r in given.filter(pa.compute.is_valid(given.column("level"))).to_pylist():
            side = whole / 2 ** r["level"]
            a, b = basis(2 * (gx - x0) / side - 2 * r["ax"] - 1), basis(2 * (gy - y0) / side - 2 * r["ay"] - 1)
            w, wz = (s + ((a @ np.array(r[c]).reshape(ORDER, ORDER)) * b).sum(1) for s, c in ((w, "w"), (wz, "wz")))
        with np.errstate(divide="ignore", invalid="ignore"):
            return pa.table({"id": at, "z": np.where(h > 0, hz / h, wz / w)})

    key = ["bx", "by", "part"]
    tasks = max(32, -(-cells.count() // (4 * CHUNK)))
    return dealt.repartition(tasks, *key).groupBy(*key).cogroup(given.repartition(tasks, *key).groupBy(*key)).applyInArrow(heights, f"id {kind}, z double").where("id IS NOT NULL")
