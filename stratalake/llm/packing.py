"""Packing of documents into sequences by order-preserving dynamic programming.

The documents of a scan partition are taken in their order as one run of tokens. Cut points lie at document ends
(free), sentence ends (a small truncation penalty) and, only inside sentences that no window holds, every `STRIDE` tokens
(a large one). The cheapest chain of windows of at most `length` tokens is found with a monotone queue: a window's
padding is `length` less its tokens, so the best start of a window is the smallest cost plus position among the points
in reach, which the queue holds in order. Windows whose length is a power of two are not padded and are looked up
beside the queue. Sequences never leave a block of about `BLOCK` tokens, so that memory is bounded by a block and the
longest document, and no row moves between executors.

Ids are those of the JSON tokenizer: the strings of its added tokens become their ids, and the rest is encoded by the
same vocabulary's ranks. Runs of over `RUN` blanks, which the pattern's backtracking can't hold, are cut out first as the
pieces that the pattern would make of them.

Null text counts as empty: such a document is the end id alone. Repeated rows and ids are packed as rows of their own.
An empty table gives no rows. Sequence ids are unique and follow the order within a partition.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batches

LENGTH, BLOCK, STRIDE = 1024, 1 << 20, 16
SENTENCE_COST, INNER_COST = 1, 8
#: Unpadded lengths that are looked up at every point; at the end of a block all powers of two are.
SHORTER = (512, 256, 128)


#: Blanks in a row from which on a run is cut out, and what the pattern takes for blanks (Unicode White_Space, a fixed value).
RUN = 10_000
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Ids of a text by ranks and added tokens, and which ids end a sentence."""

    def __init__(self, ranks_path: str, pattern: str, json_path: str, run: int = RUN):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as file:
            self.added = {t["content"]: int(t["id"]) for t in json.load(file)["added_tokens"]}
        self.ends = np.zeros(max([*ranks.values(), *self.added.values()]) + 2, bool)
        for raw, i in ranks.items():
            self.ends[i] = raw.rstrip(b" ").endswith((b".", b"!", b"?")) or b"\n" in raw
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long_run = re.compile(f"[{BLANKS}]{{{run},}}")
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _segment(self, text: str) -> list[np.ndarray]:
        out, at = [], 0
        for found in self.long_run.finditer(text):
            stop = found.end() if found.end() == len(text) else found.end() - 1  # the last blank goes with what follows
            out += [self.plain.encode_to_numpy(text[at : found.start()], disallowed_special=()), np.array(self.plain._encode_single_piece(text[found.start() : stop]), np.uint32)]
            at = stop
        return [*out, self.plain.encode_to_numpy(text[at:], disallowed_special=())]

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for k, segment in enumerate(self.names.split(text) if self.names else [text]):
            parts += [np.array([self.added[segment]], np.uint32)] if k % 2 else self._segment(segment)
        return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.uint32)


@lru_cache(maxsize=2)
def load_encoder(ranks_path: str, pattern: str, json_path: str) -> Encoder:
    return Encoder(ranks_path, pattern, json_path)


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, long: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions from 0 to the end of the block, and the penalty of a cut at each."""
    price = np.full(len(ids) + 1, -1, np.int32)
    price[1:][ends[ids]] = SENTENCE_COST
    price[0] = 0
    price[doc_ends] = 0
    at = np.flatnonzero(price >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > long)
    if len(wide):
        inner = np.concatenate([np.arange(at[i] + stride, at[i + 1], stride) for i in wide])
        price[inner] = INNER_COST
        at = np.flatnonzero(price >= 0)
    return at, price[at]


def best_cuts(points: np.ndarray, price: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions of the cuts of the cheapest packing, the first point left out and the last one included.

    Neighbouring points must be at most `length` apart.
    """
    at, cost = points.tolist(), price.tolist()
    n = len(at)
    best = [0] * n
    back = [0] * n
    where = {at[0]: 0}
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])  # (cost + position, index), costs rising
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    for i in range(1, n):
        x = at[i]
        low = x - length
        while at[queue[0][1]] < low:
            queue.popleft()
        total, j = queue[0]
        total += length - x
        for size in SHORTER if i < n - 1 else powers:
            k = where.get(x - size)
            if k is not None and best[k] < total:
                total, j = best[k], k
        total += cost[i]
        best[i], back[i] = total, j
        where[x] = i
        key = total + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts, i = [], n - 1
    while i:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1]


def pack_block(doc_ids: list, parts: list[np.ndarray], ends: np.ndarray, first: int, length: int = LENGTH) -> tuple[list[tuple], int]:
    """Rows (doc_id, start, length, crc32, doc_tokens, sequence_id, offset) of a block, and the next sequence id."""
    ids = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    doc_ends = np.cumsum(sizes)
    doc_starts = doc_ends - sizes
    cuts = np.array(best_cuts(*cut_points(ids, doc_ends, ends, length), length))
    edges = np.union1d(np.union1d(cuts, doc_starts), [len(ids)])
    begin, end = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right")
    opened = np.concatenate([[0], cuts[:-1]])[sequence]
    raw = memoryview(ids.astype("<u4").tobytes())
    rows = [
        (doc_ids[d], s, e - s, zlib.crc32(raw[4 * b : 4 * f]), n, first + q, o)
        for d, s, e, b, f, n, q, o in zip(doc.tolist(), (begin - doc_starts[doc]).tolist(), (end - doc_starts[doc]).tolist(), begin.tolist(), end.tolist(), sizes[doc].tolist(), sequence.tolist(), (begin - opened).tolist())
    ]
    return rows, first + len(cuts)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, json_path: str, end_id: int = 0, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most `length` tokens."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_NAMES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(ranks_path, pattern, json_path)
        ends = encoder.ends
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        names: list = []
        parts: list[np.ndarray] = []
        tokens = 0
        last = np.array([end_id], np.uint32)
        for batch in batches(it):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.concatenate([encoder.encode(text), last]) if text else last
                names.append(name)
                parts.append(part)
                tokens += len(part)
                if tokens >= BLOCK:
                    rows, sequence = pack_block(names, parts, ends, sequence, length)
                    names, parts, tokens = [], [], 0
                    yield batch_of(rows)
        if parts:
            yield batch_of(pack_block(names, parts, ends, sequence, length)[0])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column]).mapInArrow(run, SCHEMA)
