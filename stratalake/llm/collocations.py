"""Phrases whose words belong together, by language, from count tries of depth 4.

Three passes over the texts. The first counts words by language and samples paths of up to four words. The second counts
pairs of words by a 64-bit hash. Words and pairs that occur fewer than `least` times stand in no candidate and in no part
of one, so both are told apart by bit fields of a fixed size (2^24 and 2^26 bits): a false hit costs time, a miss can't
happen. The third pass builds the tries: a shard holds the paths that start at each of its frequent words and go on while
the pairs are frequent, at most four words, sorted and counted. Shards are written in blocks of sorted paths, each with
its own words and cut at the bounds of prefix ranges, and a range merges its blocks as they come, in the order of their
first paths, holding one block of each shard that reaches the present path.

The walk over a range's merged paths closes a node of the trie when its prefix ends; it then knows the node's count and,
as ancestors close after their descendants, the left part of every cut of each frequent phrase. The right part is where
suffix links lead: the phrase without its first words, a frequent node of another range, joined by name. Nodes that lie
across the bound of ranges are summed afterwards and their phrases' left parts are joined like the right ones. A hot
first word or pair is thus many ranges, and no task holds the phrases of a language.

Null text is empty, a null lang `und`. Words keep any other bytes, NUL included. Repeated rows count as often as they
stand there, ids aren't read, an empty table gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import batches, drop_tables, materialize
from .words import as_texts, numbered, split_words

LEAST, DEPTH, TOP = 30, 4, 2000
#: Characters that end a piece of text.
BREAKS = "[.,;:!?\n-\r]"
WORD_BITS, PAIR_BITS = 24, 26
#: Texts of a slice in bytes, paths of a shard and of a block, words from one sampled path to the next, bytes of a bound.
SLICE_BYTES, SHARD, BLOCK, SAMPLE, BOUND = 4 << 20, 1_000_000, 4096, 1024, 200
# Words hold no bytes 9 to 13, so bytes below 9 move up by one and 0 can stand between the words of a path.
_UP, _DOWN = bytes([*range(1, 10), *range(9, 256)]), bytes([0, *range(0, 9), *range(10, 256)])


class Piece:
    """Words of one language in a slice: numbers into `words`, and the piece of text that each stands in."""

    def __init__(self, lang: str, ids: np.ndarray, piece: np.ndarray, dictionary: pa.Array):
        self.lang, self.piece = lang, piece
        counts = np.bincount(ids, minlength=len(dictionary))
        present = np.flatnonzero(counts)
        local = np.zeros(len(dictionary), np.int64)
        local[present] = np.arange(len(present))
        self.ids, self.counts = local[ids], counts[present]
        self.words: list[bytes] = dictionary.take(pa.array(present)).cast(pa.binary()).to_pylist()

    def hashes(self) -> np.ndarray:
        """As Spark's xxhash64(lang, word)."""
        seed = xxhash.xxh64_intdigest(self.lang.encode(), 42)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def pairs(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word but the last: whether the next stands in the same piece, and the hash of both."""
        h = hashes[self.ids]
        mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return self.piece[:-1] == self.piece[1:], mixed ^ (mixed >> np.uint64(29))


def pieces(batch: pa.RecordBatch) -> Iterator[Piece]:
    """Words of a batch (lang, text), a language at a time."""
    texts = pc.ascii_lower(as_texts(batch.column(1)))
    cut = pc.split_pattern_regex(texts, BREAKS)
    text_of_piece = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy(zero_copy_only=False))
    words, sizes = split_words(cut.flatten())
    if not len(words):
        return
    ids, dictionary = numbered(words)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    langs = pc.fill_null(batch.column(0), "und").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False)[text_of_piece[piece]]
    for code, name in enumerate(langs.dictionary.to_pylist()):
        own = lang == code
        if own.any():
            yield Piece(name, ids[own], piece[own], dictionary)


def path_key(lang: str, words: list[bytes]) -> bytes:
    """Bytes whose order keeps the paths of a prefix together."""
    return b"\0".join([lang.encode().hex().encode(), *(w.translate(_UP) for w in words)])


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches(it, 100_000, SLICE_BYTES):
        yield from pieces(batch)


def word_counts(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, word, n) of each slice's words, and (lang, null, null, path) for sampled paths."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for x in _slices(it):
            n = len(x.words)
            yield pa.RecordBatch.from_arrays([pa.array([x.lang] * n), pa.array(x.words, pa.binary()).cast(pa.string()), pa.array(x.counts), pa.nulls(n, pa.binary())], names=["lang", "word", "n", "path"])
            paths = []
            for i in range(-seen % sample, len(x.ids), sample):
                same = x.piece[i : i + DEPTH] == x.piece[i]
                paths.append(path_key(x.lang, [x.words[k] for k in x.ids[i : i + DEPTH][same]])[:BOUND])
            seen += len(x.ids)
            m = len(paths)
            yield pa.RecordBatch.from_arrays([pa.array([x.lang] * m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.array(paths, pa.binary())], names=["lang", "word", "n", "path"])

    return texts.mapInArrow(run, "lang string, word string, n long, path binary")


def bit_field(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits at the low `bits` bits of every value of the column h; at most 2^(bits - 6) rows reach the driver."""
    low = F.col("h").bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    field = np.zeros(1 << (bits - 6), np.int64)
    field[words["w"].to_numpy()] = words["b"].to_numpy()
    return field.view(np.uint64)


def has(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(len(field) * 64 - 1)
    return (field[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def frequent_pairs(texts: DataFrame, words, least: int) -> DataFrame:
    """(h): hashes of pairs of frequent words that occur at least `least` times, hashes that coincide taken together."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(it):
            if len(x.ids) < 2:
                continue
            hashes = x.hashes()
            good = has(words.value, hashes)[x.ids]
            same, h = x.pairs(hashes)
            h, n = np.unique(h[same & good[:-1] & good[1:]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


class Shard:
    """Paths of frequent words of one language, as numbers of words, 0 where a path has ended."""

    def __init__(self, lang: str):
        self.lang, self.known, self.paths = lang, {}, []

    def add(self, x: Piece, good: np.ndarray, on: np.ndarray) -> int:
        """good: which words are frequent; on: after which places the path goes on."""
        numbers = np.zeros(len(x.words), np.int32)
        for k in np.flatnonzero(good).tolist():
            numbers[k] = self.known.setdefault(x.words[k], len(self.known) + 1)
        starts = np.flatnonzero(good[x.ids])
        padded = np.concatenate([numbers[x.ids], np.zeros(DEPTH, np.int32)])
        on = np.concatenate([on, np.zeros(DEPTH, bool)])
        columns, going = [padded[starts]], np.ones(len(starts), bool)
        for k in range(1, DEPTH):
            going = going & on[starts + k - 1]
            columns.append(np.where(going, padded[starts + k], 0))
        self.paths.append(np.stack(columns))
        return len(starts)

    def sorted_paths(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words by their order, paths as ranks from 1 on, counts)."""
        words = sorted(self.known, key=lambda w: w.translate(_UP))
        rank = np.zeros(len(words) + 1, np.int32)
        rank[[self.known[w] for w in words]] = np.arange(1, len(words) + 1)
        high, low = (np.concatenate([rank[p[k]].astype(np.int64) << 32 | rank[p[k + 1]] for p in self.paths]) for k in (0, 2))
        self.paths.clear()
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
        high, low = high[first], low[first]
        return words, np.stack([high >> 32, high & 0xFFFFFFFF, low >> 32, low & 0xFFFFFFFF], axis=1), np.diff(first, append=len(order))


def pack(words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> bytes:
    """A block: its own words, sorted, then its paths by columns and the counts."""
    used = np.unique(paths)
    used = used[used > 0]
    local = np.searchsorted(used, paths) + 1
    local[paths == 0] = 0
    listed = b"\0".join(words[k - 1].translate(_UP) for k in used.tolist())
    body = struct.pack("<II", len(counts), len(listed)) + listed + local.T.astype("<u4").tobytes() + counts.astype("<u8").tobytes()
    return zlib.compress(body, 1)


def unpack(block: bytes, lang: str) -> tuple[list[bytes], list[int]]:
    """Keys of the paths of a block, and their counts."""
    body = zlib.decompress(block)
    n, size = struct.unpack_from("<II", body)
    words = pa.array(body[8 : 8 + size].split(b"\0"), pa.binary())
    paths = np.frombuffer(body, "<u4", n * DEPTH, 8 + size).reshape(DEPTH, n).T
    counts = np.frombuffer(body, "<u8", n, 8 + size + 4 * n * DEPTH)
    there = paths > 0
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(paths[there].astype(np.int64) - 1)))
    head = lang.encode().hex().encode() + b"\0"
    return [head + k for k in pc.binary_join(lists, b"\0").to_pylist()], counts.tolist()


def shard_blocks(texts: DataFrame, words, pairs, bounds, shard_paths: int = SHARD, block_paths: int = BLOCK) -> DataFrame:
    """(range, lang, first, block): blocks of the tries of all shards, none across a bound of ranges."""

    def flushed(shards: dict[str, Shard]) -> Iterator[pa.RecordBatch]:
        for shard in shards.values():
            known, paths, counts = shard.sorted_paths()

            def key(i: int) -> bytes:
                return path_key(shard.lang, [known[k - 1] for k in paths[i].tolist() if k])

            cuts = [0, *(bisect.bisect_left(range(len(paths)), b, key=key) for b in bounds.value), len(paths)]
            for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
                for begin in range(low, high, block_paths):
                    end = min(begin + block_paths, high)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([shard.lang]), pa.array([key(begin)], pa.binary()), pa.array([pack(known, paths[begin:end], counts[begin:end])], pa.binary())],
                        names=["range", "lang", "first", "block"],
                    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        held = 0
        for x in _slices(it):
            hashes = x.hashes()
            good = has(words.value, hashes)
            if not good.any():
                continue
            same, h = x.pairs(hashes)
            on = same & good[x.ids][:-1] & good[x.ids][1:]
            on[on] = has(pairs.value, h[on])
            held += shards.setdefault(x.lang, Shard(x.lang)).add(x, good, on)
            if held >= shard_paths:
                yield from flushed(shards)
                shards, held = {}, 0
        yield from flushed(shards)

    return texts.mapInArrow(run, "range int, lang string, first binary, block binary")


def merged_paths(blocks: Iterator[tuple[bytes, str, bytes]]) -> Iterator[tuple[bytes, int]]:
    """Paths of (first path, lang, block) in order, each with its count in all blocks. The blocks come by their first path."""
    heap: list[tuple[bytes, int, int, list[bytes], list[int]]] = []  # path, block's number, place, paths and counts
    last, total = None, 0

    def step() -> tuple[bytes, int]:
        path, number, place, keys, counts = heap[0]
        if place + 1 < len(keys):
            heapq.heapreplace(heap, (keys[place + 1], number, place + 1, keys, counts))
        else:
            heapq.heappop(heap)
        return path, counts[place]

    def upto(bound: bytes | None) -> Iterator[tuple[bytes, int]]:
        nonlocal last, total
        while heap and (bound is None or heap[0][0] < bound):
            path, n = step()
            if path == last:
                total += n
            else:
                if last is not None:
                    yield last, total
                last, total = path, n

    for number, (first, lang, block) in enumerate(blocks):
        yield from upto(first)
        keys, counts = unpack(block, lang)
        heapq.heappush(heap, (keys[0], number, 0, keys, counts))
    yield from upto(None)
    if last is not None:
        yield last, total


def walk(paths: Iterator[tuple[bytes, int]], lower: bytes | None, upper: bytes | None, least: int) -> Iterator[list]:
    """[key, depth, f, l1, l2, l3, open] of the nodes of a range's trie that are frequent or go on in another range.

    l1 to l3: counts of the first words of a phrase, None where that node is open. open: f is this range's part alone.
    """
    stack: list[list] = []  # of each open depth: part of the path, count, phrases of the subtree
    outside = [b for b in (lower, upper) if b is not None]

    def close(depth: int) -> Iterator[list]:
        while len(stack) > depth:
            level = len(stack) - 1
            part, count, inner = stack.pop()
            prefix = b"\0".join([*(s[0] for s in stack), part])
            across = any(b.startswith(prefix + b"\0") for b in outside)
            if level:  # depth 0 is the language
                for node in inner:
                    node[2 + level] = None if across else count
                if count >= least or across:
                    inner.append([prefix, level, count, None, None, None, across])
            if level > 1:
                stack[-1][2] += inner
            elif level == 1:
                yield from inner

    for key, count in paths:
        parts = key.split(b"\0")
        depth = 0
        while depth < len(stack) and depth < len(parts) and stack[depth][0] == parts[depth]:
            depth += 1
        yield from close(depth)
        for level in stack:
            level[1] += count
        stack.extend([part, count, []] for part in parts[depth:])
    yield from close(0)


def trie_nodes(blocks: DataFrame, bounds, least: int) -> DataFrame:
    """(lang, phrase, depth, f, l1, l2, l3, open) of the merged tries of all ranges."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, first, lang, block) for batch in it for r, lang, first, block in zip(*(c.to_pylist() for c in batch.columns)))
        ahead = next(rows, None)
        held: list[list] = []

        def of_range(number: int) -> Iterator[tuple[bytes, str, bytes]]:
            nonlocal ahead
            while ahead and ahead[0] == number:
                yield ahead[1:]
                ahead = next(rows, None)

        def batch_of(nodes: list[list]) -> pa.RecordBatch:
            split = [n[0].split(b"\0") for n in nodes]
            langs = [bytes.fromhex(s[0].decode()).decode() for s in split]
            phrases = [b" ".join(w.translate(_DOWN) for w in s[1:]).decode() for s in split]
            columns = [pa.array(langs), pa.array(phrases), *(pa.array([n[k] for n in nodes], pa.int64()) for k in range(1, 6)), pa.array([n[6] for n in nodes], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "depth", "f", "l1", "l2", "l3", "open"])

        while ahead:
            number, cuts = ahead[0], bounds.value
            for node in walk(merged_paths(of_range(number)), cuts[number - 1] if number else None, cuts[number] if number < len(cuts) else None, least):
                held.append(node)
                if len(held) == 10_000:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    ordered = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "first")
    return ordered.select("range", "lang", "first", "block").mapInArrow(run, "lang string, phrase string, depth long, f long, l1 long, l2 long, l3 long, open boolean")


def range_bounds(sample: DataFrame, ranges: int) -> list[bytes]:
    """At most `ranges` - 1 paths that part the sampled ones evenly."""
    starts = sample.repartitionByRange(ranges, "path").groupBy(F.spark_partition_id()).agg(F.min("path").alias("path")).select("path").collect()
    return sorted({bytes(r.path) for r in starts})[1:]


def phrase_counts(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, shard_paths: int = SHARD, block_paths: int = BLOCK, text_column: str = "text", lang_column: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Written tables (lang, phrase, depth, f, l1, l2, l3) of all phrases of 1 to 4 words that occur at least `least` times, and (lang, n).

    l1 to l3 are counts of the first words of a phrase; where they are null, they are to be looked up.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[lang_column].alias("lang"), docs[text_column].alias("text"))
    counted = materialize(word_counts(texts, sample).groupBy("lang", "word", "path").agg(F.sum("n").alias("n")))
    sizes = materialize(counted.where("path IS NULL").groupBy("lang").agg(F.sum("n").alias("n")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = spark.sparkContext.broadcast(range_bounds(counted.where("path IS NOT NULL"), 4 * parts))  # at most 4 * parts paths of BOUND bytes
    words = spark.sparkContext.broadcast(bit_field(counted.where(f"path IS NULL AND n >= {least}").select(F.xxhash64("lang", "word").alias("h")), WORD_BITS))
    pairs = spark.sparkContext.broadcast(bit_field(frequent_pairs(texts, words, least), PAIR_BITS))
    drop_tables(counted)
    nodes = materialize(trie_nodes(shard_blocks(texts, words, pairs, bounds, shard_paths, block_paths), bounds, least))
    across = nodes.where("open").groupBy("lang", "phrase", "depth").agg(F.sum("f").alias("f"), *[F.lit(None).cast("long").alias(c) for c in ("l1", "l2", "l3")])
    frequent = materialize(nodes.where("NOT open").drop("open").unionByName(across).where(F.col("f") >= least))
    drop_tables(nodes)
    return frequent, sizes


def scored_phrases(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of 2 to 4 words, by their lowest-scoring cut, least k first."""
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.col("depth").cast("int") - 1)).alias("k")
    cuts = frequent.where("depth > 1").select("lang", "phrase", F.col("f").alias("a"), "l1", "l2", "l3", words.alias("w"), cut)
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("CASE k WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END").alias("l"), F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    named = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l_found"))
    links = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    known = cuts.where("l IS NOT NULL").drop("first")
    looked_up = cuts.where("l IS NULL").drop("l").join(named, ["lang", "first"]).select("lang", "phrase", "a", "k", F.col("l_found").alias("l"), "rest")
    whole = known.unionByName(looked_up).join(links, ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = whole.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def swallowed(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, top): count of the most frequent longer phrase that holds each phrase of 2 or 3 words."""
    words = F.split("phrase", " ", -1)
    longer = frequent.where("depth > 2").select("lang", "f", "depth", words.alias("w"))
    spans = F.expr("flatten(transform(sequence(2, cast(depth AS int) - 1), m -> transform(sequence(1, cast(depth AS int) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    return longer.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("top"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, count and spelling. limits: of `phrase_counts`."""
    frequent, sizes = phrase_counts(docs, least, **limits)
    covered = F.coalesce(F.col("top").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * 80, F.lit(False))
    kept = scored_phrases(frequent).join(swallowed(frequent), ["lang", "phrase"], "left").where(~covered)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)  # a language's best are among the best of its 16 parts
    first = kept.withColumn("place", F.row_number().over(some)).where(F.col("place") <= top).drop("place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
