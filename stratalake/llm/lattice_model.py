"""Language-model scoring by the subword lattice.

The pieces of an existing vocabulary weight every segmentation of a text. A forward recursion in log space sums over
all of them, so the score is the marginal log-probability of the text under a unigram model of pieces with an end
symbol. Pieces hold a word-start mark in front at most, so the sum over a text's segmentations is the product of its
words' sums: each distinct word is summed once, and texts add up the words.

Piece scores start from the vocabulary's own order and are re-estimated from all distinct training words by two rounds
of expectation maximisation. Characters without a piece are spelled in bytes. `lattice_score` is the text's probability by
these pieces alone. Pieces alone score far below plain word counts, so for `score` the lattice of a word has one more arc:
the word as a whole where training texts hold it, weighted by its count less `DISCOUNT`; what is discounted weighs the
segmentations into pieces. Such arcs are held for each of the `languages` most frequent languages of the training rows (the
rest share one), with those of all rows below them, and a text's probability is the mixture over languages: `lang` is read
in training only, never for the text that is scored.

Texts are dealt into blocks. The distinct words of a block ask for their scores and counts in a join by word, and come back
to the block in packed form, so that neither a text nor a word of it is a row of a shuffle more than once.

Words are runs of non-blanks with A-Z lower-cased, and each text ends in one end token. Null text counts as empty: the end
token alone. Rows without an id count as training rows. Repeated rows each count. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, materialize, release, word_texts

MARK = "▁"
FOLDS, HELD_OUT, ROUNDS, SMOOTH = 7, 2, 2, 0.1
#: Taken off each count of a word for the arcs below it.
DISCOUNT = 0.75
#: Rows that are packed at a time, and their bytes.
PACKED, PACKED_BYTES = 500_000, 48 << 20
#: Distinct words a task gathers before it sends them on.
GATHERED = 400_000
#: Arcs of characters without a piece, by their number of bytes.
SPELLED = 4
#: Words of smaller probability are summed in logarithms.
LEAST = 1e-250


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and ASCII blanks only


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Vocabulary:
    """Pieces, and a hash table of all their prefixes over code points."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = []
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            special = model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
            if not special and MARK not in p[1:] and not any("A" <= ch <= "Z" for ch in p):
                ranked.append((-model.get_score(i), p))
        self.pieces = [p for _, p in sorted(ranked)]
        n = len(self.pieces)
        start = 1 / (np.arange(n + SPELLED) + 10.0)
        self.start = np.log(start / start.sum())
        prefixes: dict[str, int] = {}
        for p in self.pieces:
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], -1)
        prefixes |= {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)
        keys, ids = [], []
        for p, i in prefixes.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for ch in p:
                    h = (h + np.uint64(ord(ch) + 1)) * _STEP
            keys.append(h)
            ids.append(i)
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.ids = np.array(keys, np.uint64)[order], np.array(ids, np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two prefixes share a hash")
        slots = 1 << 19
        self.first = np.searchsorted(self.keys >> np.uint64(45), np.arange(slots + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is of a prefix, and the piece it is (-1: none)."""
        slot = (h >> np.uint64(45)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        found = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.keys[at] == h[live]
            found[live[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            live, at, end = live[more], at[more], end[more]
        return found >= 0, np.where(found >= 0, self.ids[found], -1)

    def arcs(self, words: list[str]) -> np.ndarray:
        """Piece (or spelled character) by word, end position and length less 1; -1: none. All words are equally long."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        out = np.full((n, size, min(self.longest, size)), -1, np.int32)
        row, col = np.divmod(np.arange(n * size), size)
        h = np.zeros(n * size, np.uint64)
        flat = codes.reshape(-1)
        for k in range(out.shape[2]):
            h = (h + flat[row * size + col + k] + np.uint64(1)) * _STEP
            alive, piece = self.find(h)
            if k == 0:
                code = flat[row * size + col]
                spelled = len(self.pieces) + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
                piece = np.where(piece < 0, spelled, piece)
            some = piece >= 0
            out[row[some], col[some] + k, k] = piece[some]
            alive &= col + k + 1 < size
            row, col, h = row[alive], col[alive], h[alive]
        return out

    def lower(self, scores: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weights of the arcs and forward log sums by position."""
        weight = np.append(scores, -np.inf)[arcs]
        n, size, most = arcs.shape
        forward = np.full((n, size + 1), -np.inf)
        forward[:, 0] = 0
        for i in range(1, size + 1):
            k = min(i, most)
            terms = weight[:, i - 1, :k] + forward[:, i - k : i][:, ::-1]
            top = terms.max(1)
            forward[:, i] = top + np.log(np.exp(terms - top[:, None]).sum(1))
        return weight, forward

    def sums(self, chances: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the arcs and forward sums by position as plain numbers, and whether a word's sum is far from underflow. chances: by piece, and 0 last."""
        weight = chances[arcs]
        n, size, most = arcs.shape
        forward = np.zeros((n, size + 1))
        forward[:, 0] = 1
        for i in range(1, size + 1):
            k = min(i, most)
            forward[:, i] = np.einsum("nk,nk->n", weight[:, i - 1, :k], forward[:, i - k : i][:, ::-1])
        return weight, forward, forward[:, size] > LEAST


_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_length(words: list[str], cells: int = 400_000) -> Iterator[list[int]]:
    """Indices of words of one length, in portions."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for size, members in groups.items():
        step = max(1, cells // size)
        for s in range(0, len(members), step):
            yield members[s : s + step]


def word_scores(vocabulary: Vocabulary, scores: np.ndarray, words: list[str]) -> np.ndarray:
    """Marginal natural log-probability of each word, start mark included, by row of scores."""
    out = np.zeros((len(words), len(scores)))
    marked = [MARK + w for w in words]
    chances = [np.append(np.exp(own), 0) for own in scores]
    for members in by_length(marked):
        arcs, members = vocabulary.arcs([marked[i] for i in members]), np.array(members)
        for k, own in enumerate(scores):
            _, forward, safe = vocabulary.sums(chances[k], arcs)
            out[members[safe], k] = np.log(forward[safe, -1])
            if not safe.all():
                out[members[~safe], k] = vocabulary.lower(own, arcs[~safe])[1][:, -1]
    return out


def expected_pieces(vocabulary: Vocabulary, scores: np.ndarray, words: list[str]) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words."""
    total = np.zeros(len(scores))
    marked = [MARK + w for w in words]
    chances = np.append(np.exp(scores), 0)
    for members in by_length(marked):
        arcs = vocabulary.arcs([marked[i] for i in members])
        weight, forward, safe = vocabulary.sums(chances, arcs)
        if not safe.all():
            total += _expected_in_logs(vocabulary, scores, arcs[~safe])
            arcs, weight, forward = arcs[safe], weight[safe], forward[safe]
        n, size, most = arcs.shape
        backward = np.zeros((n, size + 1))
        backward[:, size] = 1
        for i in range(size - 1, -1, -1):
            k = min(size - i, most)
            backward[:, i] = np.einsum("nk,nk->n", weight[:, np.arange(i, i + k), np.arange(k)], backward[:, i + 1 : i + k + 1])
        row, end, k = np.nonzero(arcs >= 0)
        use = weight[row, end, k] * forward[row, end - k] * backward[row, end + 1] / forward[row, size]
        total += np.bincount(arcs[row, end, k], use, len(total))
    return total


def _expected_in_logs(vocabulary: Vocabulary, scores: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    weight, forward = vocabulary.lower(scores, arcs)
    n, size, most = arcs.shape
    backward = np.full((n, size + 1), -np.inf)
    backward[:, size] = 0
    for i in range(size - 1, -1, -1):
        k = min(size - i, most)
        terms = weight[:, np.arange(i, i + k), np.arange(k)] + backward[:, i + 1 : i + k + 1]
        top = terms.max(1)
        backward[:, i] = top + np.log(np.exp(terms - top[:, None]).sum(1))
    row, end, k = np.nonzero(arcs >= 0)
    use = np.exp(weight[row, end, k] + forward[row, end - k] + backward[row, end + 1] - forward[row, size])
    return np.bincount(arcs[row, end, k], use, len(scores))


def word_counts(texts: DataFrame, classes: list[str]) -> DataFrame:
    """(word, c0, c1, ...) over all rows of (doc_id, text, lang): training counts by class; they may be 0.

    The empty word is the end. The last class holds the rows of all other languages.
    """
    number = {lang: i for i, lang in enumerate(classes)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter[bytes]] = defaultdict(Counter)
        kind = pa.int32()

        def sent() -> Iterator[pa.RecordBatch]:
            for k, counts in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array([k] * len(counts), kind), pa.array(list(counts.values()), pa.int64())], names=["word", "k", "c"])
            seen.clear()

        for batch in batches(it, 512):
            for doc_id, text, lang in zip(batch.column(0).to_pylist(), word_texts(batch.column(1)), batch.column(2).to_pylist()):
                if held_out(doc_id):
                    seen[-1].update(dict.fromkeys([b"", *words_of(text)], 0))
                else:
                    mine = seen[number.get(lang, len(classes))]
                    mine.update(words_of(text))
                    mine[b""] += 1
            if sum(map(len, seen.values())) >= GATHERED:
                yield from sent()
        yield from sent()

    by_class = [F.sum(F.when(F.col("k") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(len(classes) + 1)]
    return texts.mapInArrow(run, "word string, k int, c long").groupBy("word").agg(*by_class)


def fit_scores(vocab: DataFrame, path: str, columns: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities of the pieces by class, re-estimated on the words that the class's column of vocab counts, and last of the end symbol."""
    vocabulary = load_vocabulary(path)
    width, classes = len(vocabulary.start), len(columns)
    scores = np.repeat(vocabulary.start[None, :], classes, 0)
    uses = np.ones((classes, width))
    training = vocab.select("word", *columns)
    for _ in range(rounds):
        shared = vocab.sparkSession.sparkContext.broadcast(scores)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces = load_vocabulary(path)
            total = np.zeros((classes, width))
            for batch in batches(it, 20_000):
                words = np.array(batch.column(0).to_pylist(), object)
                for k in range(classes):
                    total[k] += expected_pieces(pieces, shared.value[k], words[batch.column(k + 1).to_numpy() > 0].tolist())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total.reshape(-1)[some])], names=["piece", "uses"])

        rows = training.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(classes * width)
        uses[rows["piece"].to_numpy()] = rows["uses"].to_numpy()
        uses = uses.reshape(classes, width)
        scores = np.stack([_estimate(u, len(vocabulary.pieces)) for u in uses])[:, :-1]
    return np.stack([_estimate(u, len(vocabulary.pieces)) for u in uses])


def _estimate(uses: np.ndarray, n: int) -> np.ndarray:
    """Smoothed log-probabilities; a spelled character of k bytes has k equal byte symbols."""
    k = np.arange(1, SPELLED + 1)
    pieces, spelled = uses[:n] + SMOOTH, float((uses[n:] * k).sum()) + SMOOTH
    total = pieces.sum() + spelled + 1
    return np.concatenate([np.log(pieces / total), k * np.log(spelled / total / 256), [np.log(1 / total)]])


def word_values(counts: np.ndarray, pieces: np.ndarray, uses: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Log-probability of each word by class. counts, pieces (log-probabilities by the pieces alone): (words, classes); uses, spare: of all rows, then by class."""
    whole = np.maximum(counts.sum(1, keepdims=True) - DISCOUNT, 0) / uses[0]
    own = np.maximum(counts - DISCOUNT, 0) / uses[1:]
    sums = own + spare[1:] * (whole + spare[0] * np.exp(pieces))
    with np.errstate(divide="ignore"):
        return np.where(sums > LEAST, np.log(sums), np.log(spare[1:] * spare[0]) + pieces)  # so small a sum has no whole arc


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (block, word, pieces, c0, c1, ...): for each block of some rows its words, their piece scores and their counts, each packed."""

    def sent(t: pa.Table) -> pa.RecordBatch:
        block = t.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        block = block[order]
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        stop = np.append(start[1:], len(block))
        words = pa.ListArray.from_arrays(pa.array(np.append(start, len(block)), pa.int32()), t.column(1).combine_chunks().take(pa.array(order)))
        counts = np.stack([c.to_numpy() for c in t.columns[3:]], 1)[order]
        pieces = np.frombuffer(b"".join(t.column(2).to_pylist()), np.float32).reshape(counts.shape)[order]
        joined = pc.binary_join(words, " ").cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array(block[start], pa.int32()), pa.array(stop - start, pa.int64()), pa.array([len(w) for w in joined], pa.int64()), pa.array([pa.compress(w, codec="zstd", asbytes=True) for w in joined], pa.binary()), pa.array([pieces[a:b].tobytes() for a, b in zip(start, stop)], pa.binary()), pa.array([pa.compress(counts[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(start, stop)], pa.binary())],
            names=["block", "n", "size", "words", "pieces", "counts"],
        )

    held, rows, size = [], 0, 0
    for batch in it:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACKED or size >= PACKED_BYTES:
            yield sent(pa.Table.from_batches(held))
            held, rows, size = [], 0, 0
    if held:
        yield sent(pa.Table.from_batches(held))


def score_texts(docs: DataFrame, vocabulary_path: str, languages: int = 6) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of every row."""
    spark = docs.sparkSession
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.cast("string").alias("lang"))
    training = F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
    common = texts.where("lang IS NOT NULL").where(training).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    classes = sorted(row["lang"] for row in common)
    columns = [f"c{i}" for i in range(len(classes) + 1)]
    counts = materialize(word_counts(texts, classes))
    release(spark)
    present = counts.agg(*(F.sum(c).alias(c) for c in columns)).first()
    columns = [c for c in columns if present[c]] or columns[:1]  # languages without training rows have no lattice
    counts = counts.select("word", *columns)
    whole = reduce(Column.__add__, map(F.col, columns))
    named = counts.withColumn("c", whole)
    every = ["c", *columns]
    sizes = named.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in every), *(F.count(F.when(F.col(c) > 0, 1)).alias(f"v_{c}") for c in every), *(F.coalesce(F.sum(F.when(F.col("word") == "", F.col(c))), F.lit(0)).alias(f"e_{c}") for c in every)).first()
    n, v = sizes["n_c"], sizes["v_c"]
    uses = np.array([max(1, sizes[f"n_{c}"]) for c in every], np.float64)
    spare = np.array([DISCOUNT * sizes[f"v_{c}"] if sizes[f"n_{c}"] else 1 for c in every]) / uses
    ends = np.array([sizes[f"e_{c}"] for c in columns], np.int64)
    prior = np.log((ends + 0.5) / (ends.sum() + 0.5 * len(columns)))
    fitted = fit_scores(named.where("c > 0 AND word <> ''"), vocabulary_path, columns)
    shared = spark.sparkContext.broadcast(fitted)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(vocabulary_path)
        for batch in batches(it, 20_000):
            pieces = word_scores(vocabulary, shared.value[:, :-1], batch.column(0).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in pieces], pa.binary()), *batch.columns[1:]], names=["word", "pieces", *columns])

    scored = counts.where("word <> ''").mapInArrow(score, "word string, pieces binary, " + ", ".join(f"{c} long" for c in columns))
    blocks = 2 * max(1, texts.rdd.getNumPartitions())
    place = F.pmod(F.xxhash64(F.spark_partition_id(), "doc_id", "text"), F.lit(blocks)).cast("int")  # copies lie in many scan partitions
    dealt = texts.select(place.alias("block"), "doc_id", "text").repartition(4 * blocks, "block")  # read twice, written once

    def distinct(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[bytes]] = defaultdict(set)
        for batch in batches(it, 512):
            for block, text in zip(batch.column(0).to_pylist(), word_texts(batch.column(2))):
                seen[block].update(words_of(text))
        for block, words in seen.items():
            listed = list(words)
            for s in range(0, len(listed), 50_000):
                part = listed[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int32()), pa.array(part, pa.binary()).cast(pa.string())], names=["block", "word"])

    asked = dealt.mapInArrow(distinct, "block int, word string").join(scored, "word").select("block", "word", "pieces", *columns)
    needed = asked.mapInArrow(_packed, "block int, n long, size long, words binary, pieces binary, counts binary")
    end_value = word_values(ends[None, :], fitted[None, :, -1], uses, spare)[0]
    chance = np.exp(prior - np.logaddexp.reduce(prior))

    def mixed_pieces(piece: np.ndarray) -> np.ndarray:
        """Log-probability of words by the pieces, mixed over languages word by word."""
        top = piece.max(1)
        return top + np.log(np.exp(piece - top[:, None]) @ chance)

    end_pieces = mixed_pieces(fitted[None, :, -1])[0]
    end_base, end_known = np.log10((ends.sum() + 1) / (n + v + 1)), int(ends.sum() > 0)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        words: list[bytes] = []
        pieces, parts = [], []
        for rows, size, w, p, c in zip(*(right[name].to_pylist() for name in ("n", "size", "words", "pieces", "counts"))):
            words += pa.decompress(w, size, codec="zstd", asbytes=True).split(b" ")
            pieces.append(np.frombuffer(p, np.float32).reshape(rows, len(columns)))
            parts.append(np.frombuffer(pa.decompress(c, 8 * rows * len(columns), codec="zstd", asbytes=True), np.int64).reshape(rows, len(columns)))
        at_word = dict(zip(words, range(len(words))))
        piece = np.concatenate([np.zeros((0, len(columns))), *pieces])
        count = np.concatenate([np.zeros((0, len(columns)), np.int64), *parts])
        c = count.sum(1)
        each = np.column_stack([c > 0, np.log10((c + 1) / (n + v + 1)), mixed_pieces(piece), word_values(count, piece, uses, spare)])
        del words, pieces, parts, piece, count
        ids, rows = left["doc_id"].to_pylist(), []
        for text in word_texts(left["text"].combine_chunks()):
            at = np.fromiter(map(at_word.__getitem__, words_of(text)), np.int64)
            total = each[at].sum(0)
            rows.append((len(at) + 1, int(total[0]) + end_known, float(total[1] + end_base), float(np.logaddexp.reduce(prior + end_value + total[3:]) / np.log(10)), float((total[2] + end_pieces) / np.log(10))))
        tokens, n_known, base_score, score, lattice = zip(*rows) if rows else ((),) * 5
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(list(map(held_out, ids)), pa.bool_()), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * len(ids), pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64()), "lattice_score": pa.array(lattice, pa.float64()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return dealt.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(add_up, schema)
