"""Periodic runs of words: stretches that repeat one another at least four times.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no neighbouring word
extends. Its Lyndon root, under the order of words in which the run's end falls, is the longest Lyndon word at one of its
first q places. `runs_of` therefore scans a text from right to left with a stack of next smaller suffixes, once under
an order of the words and once under its reverse; suffixes are compared by their longest common extension, found by a
binary search over prefix polynomial hashes and verified on the words themselves. The extension to the right is the one
that ended the comparison, that to the left is searched the same way. No suffix array is built.

Most texts hold no run, so the scan is spent on stretches that can: every run has a five-word gram at distance q for
length - q - 4 neighbouring places, at least 3 q - 4. Places whose gram does not come back in time are left out until
none is left to leave out, and what remains, joined, covers each run to its last word.

A null or empty text, or one of blanks, has no words: no runs and an empty collapsed text. A null id is kept and never
rewritten. Repeated rows give equal rows, an empty table none, and other columns of the table are not read. A text is
handled within one task, in memory in proportion to its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import batches
from .words import as_texts, numbered, split_words

#: Least length and least number of periods of a run, and the gram by which stretches are chosen (at most 5 for these).
LEAST, TIMES, GRAM = 6, 4, 5
PRIME, BASE = (1 << 31) - 1, 1_048_583


class Extensions:
    """Longest common extensions of two places of a sequence, by hashes and then by the words."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        power = np.ones(1, np.uint64)
        while len(power) <= self.n:
            power = np.concatenate([power, power * np.uint64(pow(BASE, len(power), PRIME)) % np.uint64(PRIME)])
        terms = np.array(words, np.uint64) % np.uint64(PRIME) * power[: self.n] % np.uint64(PRIME)
        self.prefix = [0, *(np.cumsum(terms) % np.uint64(PRIME)).tolist()]
        self.power = power[: self.n + 1].tolist()
        self.sure: dict[int, tuple[int, int]] = {}  # distance to the places, from and to, that are known to be equal
        self.ended: dict[int, int] = {}  # distance to the last place where an extension to the right came to its end

    def _same(self, i: int, j: int, size: int) -> bool:
        h = self.prefix
        return ((h[i + size] - h[i]) * self.power[j - i] - h[j + size] + h[j]) % PRIME == 0

    def _verified(self, i: int, stop: int, distance: int) -> bool:
        """Whether the words of [i, stop) equal those `distance` on; looks at each place once for stretches that meet."""
        low, high = self.sure.get(distance, (0, 0))
        w = self.words
        if low <= stop and i <= high and low < high:
            good = (i >= low or w[i:low] == w[i + distance : low + distance]) and (stop <= high or w[high:stop] == w[high + distance : stop + distance])
            low, high = min(i, low), max(stop, high)
        else:
            good, low, high = w[i:stop] == w[i + distance : stop + distance], i, stop
        if good:
            self.sure[distance] = low, high
        return good

    def _search(self, most: int, same: Callable[[int], bool]) -> int:
        low, step = 0, 4
        while low + step <= most and same(low + step):
            low += step
            step *= 2
        high = min(most + 1, low + step)  # `high` fails or is out of reach
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if same(middle) else (low, middle)
        return low

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        low, high = self.sure.get(j - i, (0, 0))
        if low - 1 <= i < high and high == self.ended.get(j - i) and self.words[i] == self.words[j]:
            self.sure[j - i] = min(i, low), high
            return high - i
        size = self._search(self.n - j, lambda k: self._same(i, j, k))
        if not self._verified(i, i + size, j - i):  # a collision: count the words
            size = next(k for k in range(size) if self.words[i + k] != self.words[j + k])
        self.ended[j - i] = i + size
        return size

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        size = self._search(i, lambda k: self._same(i - k, j - k, k))
        if not self._verified(i - size, i, j - i):
            size = next(k for k in range(size) if self.words[i - k - 1] != self.words[j - k - 1])
        return size


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All (start, length, period) of runs with length >= max(least, times * period), by start and period. times >= 3."""
    reach = Extensions(words)
    found = set()
    for sign in (1, -1):
        key = [sign * x for x in words]
        stack: list[int] = []
        begun: dict[int, int] = {}  # period to the start of the leftmost run so far
        for i in range(len(words) - 1, -1, -1):
            own, size = key[i], 0
            while stack:
                j = stack[-1]
                if key[j] != own:
                    size = 0
                    if key[j] < own:
                        break
                else:
                    size = reach.right(i, j)
                    if j + size == len(words) or key[j + size] < key[i + size]:
                        break
                stack.pop()
            if stack:
                period = stack[-1] - i
                if size > (times - 2) * period and begun.get(period, i + 1) > i:
                    before = reach.left(i, i + period)
                    begun[period] = i - before
                    if before + period + size >= max(least, times * period):
                        found.add((i - before, before + period + size, period))
            stack.append(i)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [first, last) outside which no run of a text lies. ends: where each text of `ids` ends."""
    if len(ids) < LEAST:
        return []
    values = ids.astype(np.uint64) + np.uint64(1)
    count = len(ids) - GRAM + 1
    gram = np.zeros(count, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + values[k : count + k]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    text = np.searchsorted(ends, np.arange(count), "right")
    gram = (gram + text.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) ^ (gram >> np.uint64(32))
    inside = np.arange(count) + GRAM <= ends[text]
    ordered = np.sort(gram[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    marks = np.zeros(1 << 20, bool)
    marks[twice & np.uint64(len(marks) - 1)] = True
    at = np.flatnonzero(inside & marks[gram & np.uint64(len(marks) - 1)])
    order = at[np.argsort(gram[at], kind="stable")]
    again = (gram[order[1:]] == gram[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    at, distance = order[:-1][again], (order[1:] - order[:-1])[again]
    by_place = np.argsort(at)
    at, distance = at[by_place], distance[by_place]
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        size = np.repeat(np.diff(first, append=len(at)), np.diff(first, append=len(at)))
        near = (TIMES - 1) * distance - GRAM + 1 <= size
        if near.all():
            break
        at, distance = at[near], distance[near]
    if not len(at):
        return []
    reach = np.maximum.accumulate(at + distance + GRAM)
    first = np.flatnonzero(at >= np.concatenate([[-1], reach[:-1]]))
    return list(zip(at[first].tolist(), reach[np.append(first[1:], len(at)) - 1].tolist()))


def text_runs(ids: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of each text; starts count from the text's first word."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    for low, high in stretches(ids, ends):
        t = int(np.searchsorted(ends, low, "right"))
        base = low - (int(ends[t - 1]) if t else 0)
        _, own = np.unique(ids[low:high], return_inverse=True)
        out[t] += [(base + s, size, p) for s, size, p in runs_of((own + 1).tolist())]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties to the smallest start, then period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def dealt_rewrite(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the query's contract makes the words from a on repeat with period p, else None."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def collapse_runs(docs: DataFrame, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed): runs by start, and the text without what runs repeat, words one space apart.

    A word goes if some run holds it after the run's first period. rewrite: gives (a, p) for texts whose word i >= a is
    to be read as word a + (i - a) % p.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            names = batch.column(0).to_pylist()
            words, sizes = split_words(as_texts(batch.column(1)))
            ends = np.cumsum(sizes)
            place = np.arange(len(words))
            for k, (name, n) in enumerate(zip(names, sizes.tolist())):
                change = rewrite(name, n) if rewrite else None
                if change:
                    a, p = change
                    place[ends[k] - n + a : ends[k]] = ends[k] - n + a + np.arange(n - a) % p
            runs = text_runs(numbered(words)[0][place], ends)
            kept = np.ones(len(words), bool)
            for k, found in enumerate(runs):
                for start, size, period in found:
                    low = int(ends[k] - sizes[k]) + start
                    kept[low + period : low + size] = False
            left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(place[kept]))), " ")
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
            best = [dict(zip(("start", "length", "period"), r)) if (r := strongest(found)) else None for found in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes), pa.array(rows, pa.list_(RUN)), pa.array(best, RUN), collapsed],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, SCHEMA)


def run_digests(docs: DataFrame) -> DataFrame:
    """The columns of the contract, made from `collapse_runs` on the texts as the contract rewrites them."""
    found = collapse_runs(docs, dealt_rewrite)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * strongest.length div strongest.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
