"""N-gram Jaccard join: exact near-duplicate links over word shingles, by relations between sets.

Sets of equal shingles are one class. Classes meet through an inverted index of their prefixes: shingles are ordered
from rare to frequent (counts in `BUCKETS` hashed buckets; any order gives the same links), and two sets that reach the
threshold share a shingle of both prefixes. A list of the index is kept in order of set size and position. It is cut into
blocks of `SKIP` rows, and a block skips those whose sizes, or whose least positions, cannot reach the threshold.

A class carries a signature: its shingles' hashes fall into `signature_bits` cells, and a bit is the parity of a cell.
Two sets differ in at least as many shingles as their signatures differ in bits, so a pair whose signatures differ in more
than a link allows is no link. Pairs that are no links are nearly all dropped by this, in the task that finds them, before
any set is moved; the pairs left are compared shingle by shingle.

Answers are derived from similar sets' answers. The first pass compares each set with the head of its lists and its
neighbour only, which joins groups of copies in linear work. `PIVOTS` further passes compare the sets of a list with the
one of most links and with `DRAWS` drawn ones, where they are in other components, and `CHAMPIONS` passes compare the
pair of each two components that meet in a list whose signatures agree best. The last pass takes the pairs of lists
that are still in two components; the overlap of a set x with the head of a star bounds its overlap with each member y of
the star from both sides (|x∩y| <= |x∩h| + |y - h|, |x∩y| >= |x∩h| + |y∩h| - |h|), and only pairs that the bounds leave
open are compared. No pair within a component is made to find the components, and none across is dropped unjudged. Lists
of over `LIST` rows in several components are cut into blocks, each pair of which is a task's work of its own.

Links are counted after that, within each component, as every link lies in one: its classes are dealt into blocks of at
most about `BLOCK` sets and `BLOCK_SHINGLES` shingles, and each pair of blocks is one task that counts all its overlaps
exactly, relative to one set that stands for the others. Only counts by class leave a task.

Words are runs of non-blanks with A-Z lower-cased; a text of fewer than five words has its whole sequence as one
shingle; texts without words (null, empty, blank) have no shingles and no links. Rows without an id have no component.
Repeated rows and ids stay rows of their own. Shingles are told apart by 64-bit hashes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import batches, drop_tables, materialize, release, word_texts
from .components import connected_components, extended_components

WIDTH, BUCKETS = 5, 1 << 18
#: Passes over lists with their pivots and drawn sets, and over the best pairs of components.
PIVOTS, DRAWS, CHAMPIONS = 1, 3, 1
#: Rows of a list's block for skipping, and of a list before it is cut into blocks for tasks.
SKIP, LIST = 256, 4096
#: Sets and shingles of a component's block, about.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Sets that are compared with one set in one task, about.
SPOKES = 2000
#: Least and most bits of a signature, and bytes of a long text that are hashed at a time.
LEAST_BITS, MOST_BITS, PIECE = 256, 8192, 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(_inverse(int(_BASE))))]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of bytes that end in a blank."""
    up, down = _POWERS.to(len(raw))
    blank = _BLANK[raw]
    before = np.concatenate([[True], blank[:-1]])
    start = np.flatnonzero(~blank & before)
    stop = np.flatnonzero(blank & ~before)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def _long_text(text: bytes, piece: int) -> np.ndarray:
    """Word hashes of one text, `piece` bytes and the rest of a word at a time."""
    found, at = [], 0
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    while at < len(text):
        stop = min(len(text), at + piece)
        more = np.flatnonzero(blank[stop : stop + piece]) if stop < len(text) else ()
        while stop < len(text) and not len(more):  # a word longer than a piece stays whole
            stop = min(len(text), stop + piece)
            more = np.flatnonzero(blank[stop : stop + piece])
        stop += int(more[0]) if len(more) else 0
        found.append(_word_hashes(np.frombuffer(text[at:stop].lower() + b" ", np.uint8))[0])
        at = stop
    return np.concatenate(found)


def shingle_sets(texts: list[bytes], width: int = WIDTH, piece: int = PIECE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if any(len(t) > piece for t in texts):
        words = [_long_text(t, piece) if len(t) > piece else None for t in texts]
        rest = iter(_sets_of_words(*_words_of_texts([t for t in texts if len(t) <= piece]), width))
        return [next(rest) if w is None else _sets_of_words(w, np.array([len(w)]), width)[0] for w in words]
    return _sets_of_words(*_words_of_texts(texts), width)


def _words_of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's end among them."""
    word, start = _word_hashes(np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8))
    return word, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def _sets_of_words(word: np.ndarray, edge: np.ndarray, width: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for k in range(width):
            grams = mixed(grams * _BASE + word[k : k + len(grams)])
        out, first = [], 0
        for last in edge.tolist():
            n = last - first
            if n >= width:
                out.append(np.unique(grams[first : last - width + 1]))
            elif n:
                few = np.array([n], np.uint64)
                for w in word[first:last]:
                    few = mixed(few * _BASE + w)
                out.append(few)
            else:
                out.append(np.zeros(0, np.uint64))
            first = last
    return out


def node_of(shingles: np.ndarray) -> int:
    """Digest of a set, its class's name."""
    with np.errstate(over="ignore"):
        return int(mixed(mixed(shingles).sum(dtype=np.uint64) + mixed(shingles + np.uint64(0x51ED27)).sum(dtype=np.uint64) * _BASE + np.uint64(len(shingles))).astype(np.int64))


def required(a, b):
    """Least overlap of linked sets of these sizes: 100 i >= 80 (a + b - i)."""
    return (4 * (a + b) + 8) // 9


def probe_length(n):
    return n - (4 * n + 4) // 5 + 1


def index_length(n):
    """Prefix of the smaller set of a pair."""
    return n - (8 * n + 8) // 9 + 1


def signature_bits(n):
    """Cells of a signature of n shingles: a power of two of at least 2 n within its bounds."""
    return 1 << min(max(int(2 * n - 1).bit_length(), LEAST_BITS.bit_length() - 1), MOST_BITS.bit_length() - 1)


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by cell, the lowest bits of a hash being its cell."""
    bits = signature_bits(len(shingles))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Signatures:
    """Signatures of rows, which fold onto shorter ones by exclusive or."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.words = np.frombuffer(b"".join(column.to_pylist()), "<u8")
        self.size = np.array([len(s) for s in column.to_pylist()], np.int64) // 8
        self.start = np.cumsum(self.size) - self.size

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Matrix of the rows' signatures at `size` words."""
        out = np.zeros((len(rows), size), np.uint64)
        own = self.size[rows]
        for wide in np.unique(own).tolist():
            at = np.flatnonzero(own == wide)
            whole = self.words[self.start[rows[at]][:, None] + np.arange(wide)]
            out[at] = np.bitwise_xor.reduce(whole.reshape(len(at), wide // size, size), axis=1)
        return out


def slack(one: Signatures, a: np.ndarray, na: np.ndarray, two: Signatures, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many more bits rows a and b, of sets of na and nb shingles, could differ in as a link; below 0: no link."""
    out = np.zeros(len(a), np.int64)
    allowed = na + nb - 2 * required(na, nb)
    least = np.minimum(one.size[a], two.size[b])
    for size in np.unique(least).tolist():
        rows = np.flatnonzero(least == size)
        step = max(1, (1 << 21) // size)
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            differ = np.bitwise_count(one.folded(a[part], size) ^ two.folded(b[part], size)).sum(1, dtype=np.int64)
            out[part] = allowed[part] - differ
    return out


def _digests(docs: DataFrame) -> DataFrame:
    """Rows (kind 0: doc_id, node, n, signature) of all documents and (kind 1: bucket as node, n) of the shingle counts."""
    names = ["kind", "doc_id", "node", "n", "signature"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches(it, 256):
            sets = shingle_sets(word_texts(batch.column(1)))
            flat = np.concatenate(sets)
            counts += np.bincount((flat >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], names=names)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(some), pa.int32()), pa.nulls(len(some), pa.int64()), pa.array(some), pa.array(counts[some]), pa.nulls(len(some), pa.binary())], names=names)

    return docs.mapInArrow(run, "kind int, doc_id long, node long, n long, signature binary")


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, node, n, prefix) of documents with shingles; the prefix is in index order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            ids, nodes, sizes, prefixes = [], [], [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(word_texts(batch.column(1)))):
                if len(s) and doc_id is not None:
                    order = np.lexsort((s, shared.value[(s >> np.uint64(46)).astype(np.int64)]))
                    ids.append(doc_id)
                    nodes.append(node_of(s))
                    sizes.append(len(s))
                    prefixes.append(s[order[: probe_length(len(s))]].astype(np.int64))
            lengths = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], names=["doc_id", "node", "n", "prefix"])

    return docs.mapInArrow(run, "doc_id long, node long, n int, prefix array<long>")


def _reach(na, pa_, nb, pb):
    """Whether a smaller set a and a larger b that meet at these positions can be linked."""
    need = required(na, nb)
    return (5 * na >= 4 * nb) & (pa_ < index_length(na)) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    return low[new], high[new]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _first_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings (h, n, node, pos) in order: pairs with a list's head and with the row before (kind 0: a, b), and the rows of lists of two or more (kind 1: h, node, n, pos)."""

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = _distinct_pairs(a, b)
        zero = pa.array(np.zeros(len(a), np.int32))
        return pa.RecordBatch.from_arrays([zero, pa.array(a), pa.array(b), zero, zero], names=["kind", "a", "b", "n", "pos"])

    def rows(h: np.ndarray, n: np.ndarray, node: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(h), pa.array(node), pa.array(n), pa.array(pos)], names=["kind", "a", "b", "n", "pos"])

    head = last = None  # the open list's first row, its last row and whether that was sent
    sent = False
    for batch in it:
        if not batch.num_rows:
            continue
        h, n, node, pos = _columns(batch)
        joined = last is not None and last[0] == h[0]
        if joined:  # a list goes on from the batch before: its head and last row lead this one
            lead = [head] if head is last else [head, last]
            h, n, node, pos = (np.concatenate([np.array([x[i] for x in lead], c.dtype), c]) for i, c in enumerate((h, n, node, pos)))
        led = len(lead) if joined else 0
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        more = np.flatnonzero(~new)
        more = more[more >= max(led, 1)]
        found = []
        for other in (first[more], more - 1):
            fits = _reach(n[other], pos[other], n[more], pos[more]) & (node[other] != node[more])
            found.append((node[other[fits]], node[more[fits]]))
        a, b = (np.concatenate(x) for x in zip(*found))
        if len(a):
            yield pairs(a, b)
        live = ~new | np.concatenate([~new[1:], [False]])
        if led:
            live[:led] = False
            if not sent:
                live[led - 1] = not new[led] if led < len(h) else False
        where = np.flatnonzero(live)
        if len(where):
            yield rows(h[where], n[where], node[where], pos[where])
        end = len(h) - 1
        head = tuple(x[first[end]] for x in (h, n, node, pos))
        last = head if first[end] == end else tuple(x[end] for x in (h, n, node, pos))
        sent = bool(live[end]) if end >= led else sent or bool(live[end])
        if first[end] != end:
            sent = True


def _near_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and signatures leave open."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 20_000):
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            rows = np.arange(batch.num_rows)
            kept = pa.array(slack(Signatures(batch.column(4)), rows, na, Signatures(batch.column(5)), rows, nb) >= 0)
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[:2]], names=["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("signature").alias(f"s{side}")), side)
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _pivot_pairs(live: DataFrame, labels: DataFrame, stars: DataFrame, seed: int) -> DataFrame:
    """(a, b): each row of the lists (h, n, node, pos) with the row of most links of its list and with drawn ones, where these are of another component and within reach."""
    arms = stars.select(F.col("a").alias("node")).union(stars.select("b")).groupBy("node").agg(F.count("*").alias("arms"))
    named = live.join(labels, "node", "left").join(arms, "node", "left").select("h", "n", "node", "pos", F.coalesce("label", "node").alias("label"), F.coalesce("arms", F.lit(0)).alias("arms"))
    whole = F.struct("n", "node", "pos", "label")
    draws = [F.max_by(whole, F.xxhash64("node", F.lit(seed * DRAWS + i))).alias(f"drawn{i}") for i in range(DRAWS)]
    mixed_lists = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by(whole, F.struct("arms", "node")).alias("pivot"), *draws).where("low <> high")
    others = F.array("pivot", *(f"drawn{i}" for i in range(DRAWS)))

    def fits(other: Column) -> Column:
        mine_first = F.struct(F.col("n"), F.col("node")) < F.struct(other.n, other.node)
        na, nb = F.least(F.col("n"), other.n), F.greatest(F.col("n"), other.n)
        pa_, pb = F.when(mine_first, F.col("pos")).otherwise(other.pos), F.when(mine_first, other.pos).otherwise(F.col("pos"))
        room = 1 + F.least(na - pa_ - 1, nb - pb - 1)
        return (other.label != F.col("label")) & (5 * na >= 4 * nb) & (9 * room >= 4 * (na + nb))

    met = named.join(mixed_lists, "h").select("node", F.explode(F.filter(others, fits)).alias("other"))
    return met.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()


def _in_reach(n: np.ndarray, pos: np.ndarray, node: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (smaller, larger) of pairs of one long list that are of two components and within reach; rows are in order of (n, pos)."""
    start = np.arange(0, len(n), SKIP)
    stop = np.append(start[1:], len(n))
    room = n - pos - 1
    low, high, most, first = n[start], n[stop - 1], np.maximum.reduceat(room, start), np.minimum.reduceat(pos, start)
    one_label = np.minimum.reduceat(label, start) == np.maximum.reduceat(label, start)
    for i in range(len(start)):
        if first[i] >= index_length(high[i]):
            continue
        later = np.arange(i, len(start))
        open_ = (5 * high[i] >= 4 * low[later]) & (1 + np.minimum(most[i], most[later]) >= required(low[i], low[later]))
        open_ &= ~(one_label[i] & one_label[later] & (label[start[i]] == label[start[later]]))
        for j in later[open_].tolist():
            a, b = np.arange(start[i], stop[i])[:, None], np.arange(start[j], stop[j])[None, :]
            fits = _reach(n[a], pos[a], n[b], pos[b]) & (label[a] != label[b]) & (a < b)
            x, y = np.nonzero(fits)
            if len(x):
                yield x + start[i], y + start[j]


def _second_pass(it: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """From rows (h, one, two, block, n, node, pos, label, signature) in order of (h, one, two, n, pos): pairs (a, b) of two components that sizes, positions and signatures leave open, with components (low, high) and slack; the best of two components only if so asked."""

    def finished(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, one, two, block, n, node, pos, label = (t.column(i).to_numpy().astype(np.int64) for i in range(8))
        signatures = Signatures(t.column(8))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def sent() -> pa.RecordBatch:
            x, y = (np.concatenate(c) for c in zip(*found))
            across = (one[x] == two[x]) | (block[x] != block[y])  # pairs within a block have a task of their own
            x, y = x[across], y[across]
            spare = slack(signatures, x, n[x], signatures, y, n[y])
            x, y, spare = x[spare >= 0], y[spare >= 0], spare[spare >= 0]
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            order = np.lexsort((b, a, -spare, high, low) if best else (b, a))
            keys = (low, high) if best else (a, b)
            first = order[np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])] if len(order) else order
            return pa.RecordBatch.from_arrays([pa.array(c[first], pa.int64()) for c in (a, b, low, high, spare)], names=["a", "b", "low", "high", "slack"])

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            small = size <= 32
            end = np.repeat(np.where(small, start + size, 0), size)
            rows = np.flatnonzero(end)
            for step in range(1, 32):
                rows = rows[rows + step < end[rows]]
                if not len(rows):
                    break
                fits = _reach(n[rows], pos[rows], n[rows + step], pos[rows + step]) & (label[rows] != label[rows + step])
                yield rows[fits], rows[fits] + step
            for i in np.flatnonzero(~small).tolist():
                s = slice(start[i], start[i] + size[i])
                for x, y in _in_reach(n[s], pos[s], node[s], label[s]):
                    yield x + start[i], y + start[i]

        for x, y in pairs():
            found.append((x, y))
            held += len(x)
            if held > 500_000:
                yield sent()
                found, held = [], 0
        if held:
            yield sent()

    held: pa.Table | None = None
    for batch in it:
        now = pa.Table.from_batches([batch])
        if held is not None:
            now = pa.concat_tables([held, now])
        if not now.num_rows:
            continue
        key = [now.column(i).to_numpy() for i in range(3)]
        same = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield from finished(now.slice(0, cut).combine_chunks())
        held = now.slice(cut)
    if held is not None and held.num_rows:
        yield from finished(held.combine_chunks())


def _open_pairs(live: DataFrame, labels: DataFrame, classes: DataFrame, width: int, best: bool) -> DataFrame:
    """(a, b): pairs of classes of two components that share a shingle of both prefixes and that sizes, positions and signatures leave open; the best of two components only if so asked."""
    named = live.join(labels, "node", "left").select("h", "n", "node", "pos", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low <> high")
    parts = F.ceil(F.col("rows") / LIST).cast("int")
    dealt = named.join(several.select("h", parts.alias("parts")), "h").join(classes.select("node", "signature"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select("h", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "n", "node", "pos", "label", "signature")
    ordered = paired.repartition(width, "h", "one", "two").sortWithinPartitions("h", "one", "two", "n", "pos")
    found = ordered.mapInArrow(partial(_second_pass, best=best), "a long, b long, low long, high long, slack long")
    if best:
        found = found.groupBy("low", "high").agg(F.max_by(F.struct("a", "b"), F.struct("slack", "a", "b")).alias("pair")).select("pair.*")
    return found.select("a", "b").distinct()


def _sets_of(docs: DataFrame) -> DataFrame:
    """(node, shingles): the sorted hashes of each text as bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            sets = shingle_sets(word_texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def _count_spokes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (hub, part, spoke, shingles) in order, a hub's own set (spoke null) before those of its spokes: (a, b, na, nb, both), a being the smaller node."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches(it, 1024):
        hubs = batch.column(0).to_numpy()
        heads = np.flatnonzero(batch.column(2).is_null().to_numpy(zero_copy_only=False)).tolist()
        spokes = batch.column(2).fill_null(0).to_numpy()
        sets = batch.column(3).to_pylist()
        rows = []
        for first, last in zip([0, *heads], [*heads, batch.num_rows]):
            if first in heads:
                hub, own = int(hubs[first]), np.frombuffer(sets[first], np.uint64)
                first += 1
            if first < last:
                flat = np.frombuffer(b"".join(sets[first:last]), np.uint64)
                size = np.array([len(s) // 8 for s in sets[first:last]])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                rows += [(hub, s, len(own), n, both) for s, n, both in zip(spokes[first:last].tolist(), size.tolist(), np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size).tolist())]
        turned = [(a, b, x, y, both) if a < b else (b, a, y, x, both) for a, b, x, y, both in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*turned) if turned else [()] * 5)], names=["a", "b", "na", "nb", "both"])


def _overlaps(pairs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(a, b, na, nb, both) of distinct pairs of nodes, a < b. The node of a pair that has more pairs is its hub: a hub's set is moved once for about `SPOKES` others."""
    degree = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("pairs"))
    known = pairs.join(degree.select(F.col("node").alias("a"), F.col("pairs").alias("of_a")), "a").join(degree.select(F.col("node").alias("b"), F.col("pairs").alias("of_b")), "b")
    first = F.col("of_a") >= F.col("of_b")
    dealt = known.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("spoke"), F.greatest("of_a", "of_b").alias("pairs"))
    dealt = dealt.select("hub", F.pmod(F.xxhash64("spoke"), F.ceil(F.col("pairs") / SPOKES)).cast("int").alias("part"), "spoke")
    heads = dealt.select("hub", "part").distinct().join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("spoke"), "shingles")
    spokes = dealt.join(sets.withColumnRenamed("node", "spoke"), "spoke").select("hub", "part", "spoke", "shingles")
    ordered = heads.union(spokes).repartition(width, "hub", "part").sortWithinPartitions("hub", "part", F.col("spoke").asc_nulls_first())
    return ordered.mapInArrow(_count_spokes, "a long, b long, na long, nb long, both long")


def _enough(both: Column, na: Column, nb: Column) -> Column:
    return 100 * both >= 80 * (na + nb - both)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap of each left set with each right one: a dense product over the shingles of a middle-sized set, pairs of rows over the rest."""
    sets = left + right
    head = np.sort(sorted(left, key=len)[len(left) // 2])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
    known = head[at] == flat
    dense = np.zeros((len(sets), len(head)), np.float32)  # counts below 2^24 are exact
    dense[row[known], at[known]] = 1
    both = np.rint(dense[: len(left)] @ dense[len(left) :].T).astype(np.int64)
    row, flat = row[~known], flat[~known]
    order = np.lexsort((row, flat))
    row, flat = row[order], flat[order]
    if not len(row):
        return both
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    run = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    ours = np.add.reduceat((row < len(left)).astype(np.int64), start)  # left rows lead each run
    theirs = np.diff(np.append(start, len(row))) - ours
    mine = np.flatnonzero((row < len(left)) & (theirs[run] > 0))
    total = np.cumsum(theirs[run[mine]])
    done = 0
    while done < len(mine):  # a few million pairs at a time
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 4_000_000, "right")))
        part = mine[done:stop]
        n = theirs[run[part]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = row[np.repeat(start[run[part]] + ours[run[part]], n) + within] - len(left)
        both += np.bincount(np.repeat(row[part], n) * len(right) + other, minlength=both.size).reshape(both.shape)
        done = stop
    return both


def _count_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (label, one, two, block, node, shingles) in order of the pair of blocks: (node, n_links) within each pair."""

    def counted(rows: list[tuple[int, int, np.ndarray]], same: bool) -> pa.RecordBatch:
        first = rows[0][0]
        left = [r for r in rows if r[0] == first]
        right = left if same else [r for r in rows if r[0] != first]
        if right:
            both = _common([r[2] for r in left], [r[2] for r in right])
            na, nb = (np.array([len(r[2]) for r in side]) for side in (left, right))
            linked = 100 * both >= 80 * (na[:, None] + nb[None, :] - both)
            if same:
                np.fill_diagonal(linked, False)
            sides = [(left, linked.sum(1))] if same else [(left, linked.sum(1)), (right, linked.sum(0))]
        else:
            sides = []
        nodes = [r[1] for side, _ in sides for r in side]
        counts = np.concatenate([c for _, c in sides]) if sides else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts.astype(np.int64))], names=["node", "n_links"])

    key, held = None, []
    for batch in batches(it, 512):
        label, one, two, block, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
        sets = batch.column(5).to_pylist()
        for i in range(len(node)):
            mine = (label[i], one[i], two[i])
            if mine != key:
                if held:
                    yield counted(held, key[1] == key[2])
                key, held = mine, []
            held.append((block[i], node[i], np.frombuffer(sets[i], np.uint64)))
    if held:
        yield counted(held, key[1] == key[2])


def _link_counts(components: DataFrame, classes: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(node, n_links) of the classes of components (node, label) of two or more."""
    size = components.join(classes, "node").groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    size = size.select("label", "k", parts.alias("parts"))
    named = materialize(components.join(size, "label"))
    two = named.where("k = 2").select("node", F.lit(1).cast("long").alias("n_links"))  # they are linked
    dealt = named.where("k > 2").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(sets, "node")
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "node", "shingles")
    keys = ["label", "one", "two"]
    counts = paired.repartition(width, *keys).sortWithinPartitions(*keys, "block").mapInArrow(_count_pass, "node long, n_links long")
    return two.union(counts.groupBy("node").agg(F.sum("n_links").alias("n_links")))


def link_classes(texts: DataFrame, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): (doc_id, node, n) of every row, and (node, label, component_id, n_links) of every class with an id; n_links only with `count_links`."""
    spark = texts.sparkSession
    digests = materialize(_digests(texts))
    members = digests.where("kind = 0").select("doc_id", "node", "n")
    counts = np.zeros(BUCKETS, np.int64)
    for part in digests.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).toArrow().to_batches():  # BUCKETS rows at most
        counts[part.column(0).to_numpy()] = part.column(1).to_numpy()
    named = digests.where("kind = 0 AND node IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    prefixes = _prefixes(texts, counts).join(classes.select("node", "doc_id"), ["node", "doc_id"])
    postings = prefixes.select("n", "node", F.posexplode("prefix").alias("pos", "h")).select("h", "n", "node", "pos")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = materialize(postings.repartition(width, "h").sortWithinPartitions("h", "n", "node").mapInArrow(_first_pass, "kind int, a long, b long, n int, pos int"))
    release(spark)
    pairs = materialize(_near_enough(first.where("kind = 0").select("a", "b").distinct(), classes))
    live = first.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("node"), "n", "pos")
    known: list[DataFrame] = []  # sets, by the pass that first asked for them

    def sets() -> DataFrame:
        return reduce(DataFrame.union, known)

    def overlaps(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for seen in known:
            asked = asked.join(seen, "node", "left_anti")
        ids = asked.join(classes.select("node", "doc_id"), "node").select("doc_id").distinct()
        rows = _sets_of(texts.join(ids, "doc_id", "left_semi").select("text")).join(asked, "node", "left_semi")
        known.append(materialize(rows.dropDuplicates(["node"])))
        return _overlaps(pairs, sets(), width)

    def linked(pairs: DataFrame) -> DataFrame:
        return overlaps(pairs).where(_enough(F.col("both"), F.col("na"), F.col("nb")))

    tried, stars = [pairs], [materialize(linked(pairs))]
    labels = connected_components(stars[0])
    for turn in range(PIVOTS + CHAMPIONS):
        tries = _near_enough(_pivot_pairs(live, labels, reduce(DataFrame.union, stars), turn), classes) if turn < PIVOTS else _open_pairs(live, labels, classes, width, best=True)
        more = materialize(tries.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"))
        tried.append(more)
        if not more.isEmpty():
            stars.append(materialize(linked(more)))
            joined = extended_components(labels, stars[-1])
            drop_tables(labels)
            labels = joined
    open_pairs = materialize(_open_pairs(live, labels, classes, width, best=False).join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"))
    drop_tables(first, *tried)
    release(spark)
    final = labels
    if not open_pairs.isEmpty():
        derived, between = _derived_links(open_pairs, reduce(DataFrame.union, stars), overlaps)
        derived = materialize(derived)
        final = extended_components(labels, derived)
        drop_tables(*between, derived, labels)
    drop_tables(open_pairs, *stars)
    grouped = classes.join(final, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = grouped.join(smallest, "label").select("node", "label", "component_id")
    if count_links:
        by_class = by_class.join(materialize(_link_counts(final, classes, sets(), width)), "node", "left")
    by_class = materialize(by_class)
    drop_tables(*known, final)
    return members, by_class


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; n_links counts all other classes that the row's class links with."""
    members, by_class = link_classes(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return members.join(by_class, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _derived_links(pairs: DataFrame, stars: DataFrame, overlaps: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) among pairs, derived from the star each second set belongs to where that decides them; and the tables written for them."""
    arms = stars.select(F.col("a").alias("head"), F.col("b").alias("y"), F.col("na").alias("n_head"), F.col("nb").alias("ny"), "both").union(stars.select("b", "a", "nb", "na", "both"))
    heads = stars.select(F.col("a").alias("head")).union(stars.select("b")).groupBy("head").agg(F.count("*").alias("arms"))
    arms = arms.join(heads, "head").groupBy("y").agg(F.max(F.struct("arms", "both", "head", "n_head", "ny")).alias("arm"))  # its most shared star
    turned = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).join(arms, "y").select("x", "y", "arm.*")
    back = pairs.join(turned.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
    turned = turned.union(back.select(F.col("b").alias("x"), F.col("a").alias("y")).join(arms, "y").select("x", "y", "arm.*"))
    turned = materialize(turned.where("x <> head"))
    asked = turned.groupBy("x", "head").agg(F.count("*").alias("uses")).where("uses > 1").select(F.least("x", "head").alias("a"), F.greatest("x", "head").alias("b")).distinct()
    asked = materialize(asked)
    known = overlaps(asked)
    known = known.select(F.col("a").alias("x"), F.col("b").alias("head"), F.col("na").alias("nx"), F.col("both").alias("with_head")).union(known.select("b", "a", "nb", "both"))
    judged = turned.join(known, ["x", "head"])
    low, high = F.col("with_head") + F.col("both") - F.col("n_head"), F.col("with_head") + F.col("ny") - F.col("both")
    yes, no = _enough(low, F.col("nx"), F.col("ny")), ~_enough(high, F.col("nx"), F.col("ny"))
    judged = materialize(judged.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), yes.alias("yes"), no.alias("no")))
    left = materialize(pairs.join(judged.where("yes OR no").select("a", "b"), ["a", "b"], "left_anti"))
    checked = overlaps(left)
    return judged.where("yes").select("a", "b").union(checked.where(_enough(F.col("both"), F.col("na"), F.col("nb"))).select("a", "b")), [turned, judged, asked, left]


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component of near duplicates, that of the smallest id; rows without an id or a shingle all stay.

    An id may come in several rows: these are told apart by their texts' classes, and of rows of one id and class one
    stays. An empty table gives no rows. Columns of any names are kept as they are.
    """
    members, by_class = link_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count_links=False)
    rows = members.where("doc_id IS NOT NULL AND node IS NOT NULL").join(by_class.select("node", "label"), "node")
    best = rows.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    judged = materialize(rows.join(best, "label").select("doc_id", "node", (F.struct("doc_id", "node") == F.col("best")).alias("stays")))
    several = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    told_apart = materialize(several)
    simple = docs.join(judged.where("NOT stays").select("doc_id").union(told_apart).distinct(), "doc_id", "left_anti").select(docs.columns)
    named = next(x for x in ("class", *(f"class_{i}" for i in range(len(docs.columns) + 1))) if x not in docs.columns)
    shared = _with_class(docs.join(told_apart, "doc_id", "left_semi").select(docs.columns), named)
    without = shared.where(F.col(named).isNull()).select(docs.columns)
    kept = judged.where("stays").select(F.col("doc_id").alias("best_id"), F.col("node").alias("best_class")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = shared.groupBy(F.col("doc_id").cast("long").alias("row_id"), F.col(named).alias("row_class")).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row"))
    one = one.join(kept, (F.col("row_id") == F.col("best_id")) & (F.col("row_class") == F.col("best_class"))).select("row.*")
    return simple.union(without).union(one)


def _with_class(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the class of each row's text; null without a shingle."""
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            nodes = [node_of(s) if len(s) else None for s in shingle_sets(word_texts(batch.column(at)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
