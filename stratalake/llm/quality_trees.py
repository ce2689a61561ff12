"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are numpy statistics of a whole text. Trees are grown level by level from histograms of binned features, on a
bounded sample of labelled rows (`SAMPLE`, by hash of the id), and flattened into arrays that score a whole Arrow batch
at a time. Labels are learned only from rows outside the held-out fold; labels, lang, source and ids are no inputs.

Null text counts as empty and gets a score as any other. Labels that are null are ignored; repeated label rows of a
document all count, as do repeated rows of `docs`. Ties between splits go to the first feature and cut. Other columns are
not read by the scores; an empty table gives no rows. With labels of fewer than two kinds every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, word_texts

#: Most labelled rows that the trees are fitted on.
SAMPLE = 40_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

FEATURES = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "distinct_words", "upper", "lower", "digit", "space", "newline",
    "high", "stop", "comma", "mark", "symbol", "pipe", "hash", "dollar", "percent", "ampersand", "star", "upper_words",
    "short_words", "long_words", "words_per_stop", "line_repeats", "plain_words", "top_word",
]
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def statistics(text: bytes) -> list[float]:
    size = len(text)
    if not size:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.split(b"\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = Counter(words)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    stop, space = c[46], c[32] + c[9:14].sum()
    symbol = size - upper - lower - digit - space - c[128:].sum() - stop - c[44]
    listed = sum(map(bytes.isupper, words))
    plain = sum(map(bytes.isalpha, words))
    return [
        np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), len(kinds) / n, upper / size, lower / size, digit / size, space / size, c[10] / size,
        c[128:].sum() / size, stop / size, c[44] / size, (c[33] + c[63]) / size, symbol / size, c[124] / size, c[35] / size, c[36] / size, c[37] / size, c[38] / size, c[42] / size, listed / n,
        (lengths <= 3).mean(), (lengths >= 15).mean(), np.log1p(n / (1 + stop)), 1 - len(set(lines)) / len(lines), plain / n, max(kinds.values(), default=0) / n,
    ]


@dataclass
class Trees:
    """All trees of a model as flat arrays; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.repeat(self.roots[None, :], len(x), 0)
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    share = float(y.mean()) if len(y) else 0.5
    inside = min(max(share, 1e-4), 1 - 1e-4)
    base = float(np.log(inside / (1 - inside)))
    flat: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []

    def node() -> int:
        me = len(flat["value"])
        for k, v in (("feature", 0), ("cut", 0.0), ("left", me), ("right", me), ("value", 0.0)):
            flat[k].append(v)
        return me

    if len(y) and 0 < share < 1:
        grid = np.linspace(0, 1, bins + 1)[1:-1]
        cuts = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            root = node()
            roots.append(root)
            level, place = [root], np.zeros(len(y), np.int64)  # place: index in level, -1 once in a leaf
            member = np.full(len(y), root)
            for d in range(depth + 1):
                live = place >= 0
                k = len(level)
                gs = np.bincount(place[live], g[live], k)
                hs = np.bincount(place[live], h[live], k)
                for i, me in enumerate(level):
                    flat["value"][me] = -rate * gs[i] / (hs[i] + l2)
                if d == depth or not k:
                    break
                top = np.full(k, 1e-6)
                pick = [None] * k
                at = place[live] * bins
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    cell = at + binned[live, f]
                    gl = np.bincount(cell, g[live], k * bins).reshape(k, bins).cumsum(1)[:, :-1]
                    hl = np.bincount(cell, h[live], k * bins).reshape(k, bins).cumsum(1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs**2 / (hs + l2))[:, None]
                    gain[(hl < least / 4) | (hr < least / 4)] = 0
                    gain = gain[:, : len(c)]
                    b = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(k), b] > top):
                        top[i], pick[i] = gain[i, b[i]], (f, int(b[i]))
                fresh: list[int] = []
                moved = np.full(len(y), -1)
                for i, chosen in enumerate(pick):
                    if chosen is None:
                        continue
                    f, b = chosen
                    me = level[i]
                    flat["feature"][me], flat["cut"][me] = f, float(cuts[f][b])
                    flat["left"][me], flat["right"][me] = node(), node()
                    mine = place == i
                    low = mine & (binned[:, f] <= b)
                    high = mine & ~low
                    moved[low], moved[high] = len(fresh), len(fresh) + 1
                    member[low], member[high] = flat["left"][me], flat["right"][me]
                    fresh += [flat["left"][me], flat["right"][me]]
                level, place = fresh, moved
            value = np.array(flat["value"])
            for me in {flat_i for flat_i in range(root, len(value)) if flat["left"][flat_i] != flat_i}:
                flat["value"][me] = 0.0
            margin += value[member]
    else:
        roots.append(node())
    return Trees(np.array(flat["feature"]), np.array(flat["cut"]), np.array(flat["left"]), np.array(flat["right"]), np.array(flat["value"]), np.array(roots), depth, base)


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fold, features) of every row; fold is crc32 of the decimal id modulo FOLDS."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = [statistics(t) for t in word_texts(batch.column(1))]
            fold = [None if d is None else zlib.crc32(str(d).encode()) % FOLDS for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fold, pa.int32()), pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))], names=["doc_id", "fold", "features"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column]).mapInArrow(run, "doc_id long, fold int, features array<double>")


def _features(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([list(map(float, statistics(t))) for t in word_texts(texts)], pa.list_(pa.float64()))


def fit_on_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Trees:
    """Trees fitted on at most `sample` labelled rows outside the held-out fold, taken by a hash of the id.

    Only the texts that the chosen labels name are looked at. The limit holds for the pairs of a text and a label, so
    that ids with many rows don't lift it; of equal ids and labels, rows of the smallest features come first.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.where((F.crc32(F.col("doc_id").cast("string")) % FOLDS) != HELD_OUT)
    here = docs.select(docs[id_column].cast("long").alias("doc_id")).distinct()
    marked = marked.join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).join(F.broadcast(marked), "doc_id")  # at most `sample` rows of 12 bytes
    rows = texts.select("doc_id", "label", F.arrow_udf(_features, "array<double>")("text").alias("features"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "features").limit(sample).select("doc_id", "label", "features").toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    x = np.array(rows["features"].tolist()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit_trees(x, rows["label"].to_numpy(dtype=np.float64))


def score_features(features: DataFrame, trees: Trees) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 8192):
            x = np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            score = trees.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f == HELD_OUT for f in batch.column(1).to_pylist()], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return features.select("doc_id", "fold", "features").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rows without an id are scored and never held out."""
    return score_features(document_statistics(docs), fit_on_labels(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, all columns kept; the trees score each row in place."""
    trees = fit_on_labels(docs, labels)

    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array(trees.scores(np.array([statistics(t) for t in word_texts(texts)]).reshape(-1, len(FEATURES))))

    good = F.arrow_udf(score, "double")
    return docs.where(good(F.col("text")) >= THRESHOLD)
