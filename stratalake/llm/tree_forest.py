"""Approximate nearest neighbours: a forest of random-projection trees with one shared priority queue per query.

Trees are grown on a bounded sample of vectors (`SAMPLE`) so that a leaf holds about `LEAF` rows of the whole table;
every row is put into a leaf of each tree. A query opens leaves of all trees in the order of their margins until
enough rows are gathered. Rows and queries meet by leaf in Spark groups, where exact cosines in double precision rank
them; the best of each leaf are merged and ranked again.

Equal vectors are one class with its smallest ids, so a vector that many rows share fills no leaf and no group.
Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose length is not the
commonest one. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import batches, materialize

SAMPLE, TREES, LEAF, LEAST, SHARE, K, EVERY = 20_000, 12, 128, 6_000, 0.7, 5, 50


class Forest:
    """Nodes of all trees as arrays; children below 0 are leaves (-1 - leaf number)."""

    def __init__(self, sample: np.ndarray, trees: int, least: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.roots = [self._grow(sample, np.arange(len(sample)), least, rng) for _ in range(trees)]
        self.plane = np.array(self.planes).reshape(len(self.planes), sample.shape[1] if sample.ndim == 2 else 0)
        self.offset = np.array(self.offsets)
        self.child = np.array(self.children, np.int64).reshape(-1, 2)
        del self.planes, self.offsets, self.children

    def _grow(self, x: np.ndarray, rows: np.ndarray, least: int, rng: np.random.Generator) -> int:
        side = None
        if len(rows) > least:
            for _ in range(3):
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = a - b
                norm = np.linalg.norm(plane)
                if norm == 0:
                    continue
                cast = x[rows] @ (plane / norm)
                offset = float(np.median(cast))
                side = cast > offset
                if 0 < side.sum() < len(rows):
                    break
                side = None
        if side is None:
            self.leaves += 1
            return -self.leaves
        me = len(self.planes)
        self.planes.append(plane / norm)
        self.offsets.append(offset)
        self.children.append([0, 0])
        self.children[me] = [self._grow(x, rows[~side], least, rng), self._grow(x, rows[side], least, rng)]
        return me

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers (rows, trees)."""
        at = np.repeat(np.array(self.roots)[None, :], len(x), 0)
        while (at >= 0).any():
            row, tree = np.nonzero(at >= 0)
            node = at[row, tree]
            up = np.einsum("ij,ij->i", x[row], self.plane[node]) > self.offset[node]
            at[row, tree] = self.child[node, up.astype(np.int64)]
        return -1 - at

    def search(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """Leaves of all trees, nearest margins first, until they hold `wanted` rows."""
        margin = self.plane @ q - self.offset if len(self.offset) else np.zeros(0)
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        out, gathered = [], 0
        while queue and gathered < wanted:
            cost, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (max(cost, abs(m)), int(self.child[node, far])))
                node = int(self.child[node, near])
            out.append(-1 - node)
            gathered += int(sizes[-1 - node])
        return out


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    sound = v.isNotNull() & F.col(id_column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (size[0]["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, least: int = LEAST, share: float = SHARE, sample: int = SAMPLE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each row whose id is divisible by `every`."""
    rows = usable(vectors, id_column, vector_column)
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    classes = materialize(few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")))  # at most k + 1 ids
    kind = rows.schema["vector"].dataType.simpleString()
    asked = rows.where(F.col("vec_id") % every == 0)
    total = classes.count()
    search = max(least, int(share * total))
    drawn = classes.select("vector").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow()
    x = _unit(_matrix(drawn["vector"])) if drawn.num_rows else np.zeros((0, 1))
    forest = Forest(x, trees if len(x) else 0, max(4, round(leaf * len(x) / max(1, total))))
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(forest)  # at most 2 * trees * sample / 4 nodes

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 4096):
            leaves = shared.value.leaves_of(_unit(_matrix(batch.column(1))))
            n, t = leaves.shape
            yield pa.RecordBatch.from_arrays([pa.array(leaves.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), t)), batch.column(1).take(pa.array(np.repeat(np.arange(n), t)))], names=["leaf", "rep", "vector"])

    placed = materialize(classes.select("rep", "vector").mapInArrow(place, f"leaf long, rep long, vector {kind}")) if total else spark.createDataFrame([], f"leaf long, rep long, vector {kind}")
    sizes = np.zeros(forest.leaves + 1, np.int64)
    for row in placed.groupBy("leaf").count().collect():  # a row a leaf of the bounded forest
        sizes[row["leaf"]] = row["count"]
    counted = spark.sparkContext.broadcast(sizes)

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            found = [shared.value.search(q, counted.value, search) for q in _unit(_matrix(batch.column(1)))]
            lengths = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), lengths)), batch.column(1).take(pa.array(np.repeat(np.arange(len(found)), lengths)))], names=["leaf", "query", "vector"])

    wanted = classes.join(asked.select("vector").distinct(), "vector").select("rep", "vector")
    probes = wanted.mapInArrow(probe, f"leaf long, query long, vector {kind}") if total else spark.createDataFrame([], f"leaf long, query long, vector {kind}")
    parts = max(8, total * trees // 40_000)

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, dict[int, float]] = {}
        if left.num_rows and right.num_rows:
            leaf_l, leaf_r = left["leaf"].to_numpy(), right["leaf"].to_numpy()
            q, c = _matrix(left["vector"]), _matrix(right["vector"])
            qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
            query, rep = left["query"].to_numpy(), right["rep"].to_numpy()
            by_leaf, by_query = np.lexsort((rep, leaf_r)), np.argsort(leaf_l, kind="stable")
            ordered, numbers = leaf_r[by_leaf], leaf_l[by_query]
            edges = np.flatnonzero(np.diff(numbers, prepend=numbers[0] - 1, append=numbers[-1] + 1))
            for begin, end in zip(edges[:-1], edges[1:]):
                mine = by_query[begin:end]
                near = by_leaf[np.searchsorted(ordered, numbers[begin]) : np.searchsorted(ordered, numbers[begin], "right")]
                if not len(near):
                    continue
                score = (q[mine] @ c[near].T) / (qn[mine][:, None] * cn[near][None, :])
                most = min(k + 1, len(near))
                cut = np.partition(score, len(near) - most, axis=1)[:, len(near) - most]
                row, col = np.nonzero(score >= cut[:, None])  # ties at the cut stay
                for a, b, x in zip(query[mine[row]].tolist(), rep[near[col]].tolist(), score[row, col].tolist()):
                    own = found.setdefault(a, {})
                    own[b] = max(x, own.get(b, -2.0))
        best = [(a, b, x) for a, own in found.items() for b, x in heapq.nsmallest(k + 1, own.items(), key=lambda i: (-i[1], i[0]))]
        a, b, x = zip(*best) if best else ((), (), ())
        return pa.table({"query": pa.array(a, pa.int64()), "rep": pa.array(b, pa.int64()), "score": pa.array(x, pa.float64())})

    part = (F.col("leaf") % parts).alias("part")
    met = probes.select("*", part).groupBy("part").cogroup(placed.select("*", part).groupBy("part")).applyInArrow(rank, "query long, rep long, score double")
    best = met.groupBy("query", "rep").agg(F.max("score").alias("score"))  # a pair's leaves may round the last bit differently
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("nth") <= k + 1)
    listed = best.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("found"))  # at most (k + 1)^2
    answers = asked.join(classes.select("vector", F.col("rep").alias("query")), "vector").select("query", F.col("vec_id").alias("query_id")).join(listed, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    flat = answers.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return flat.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
