"""Exact merge-order (BPE) encoding of a SentencePiece model by backtracking.

A word is encoded without replaying its merges. An Aho-Corasick automaton lists the vocabulary pieces that start at each
position; the search takes the longest one whose neighbour on the left stays apart from it when both are merged anew
(checked once a pair and remembered), goes to shorter pieces where it does not, and steps back where none is left,
noting failed positions in a bit field. The result equals the merge procedure's, since a sequence of pieces is the
merge result of a text if and only if that holds for each two neighbours.

That is so where pieces differ from their own beginnings. In a run of one character every place of a piece looks like the
next, and whether a pair joins depends on how many came before it: neighbours of the true result may then join when they
are merged anew by themselves. Words with two marks or more before them, and words where the search finds no chain, are
therefore merged by the procedure itself, from a heap of pairs, in n log n steps.

No piece has a word-start mark after another character, or a letter beside a character that is none (both are checked
when the model is read), so no merge crosses those places: texts are encoded in such words, and repeated words come from
a bounded memory.

Null text counts as empty; an empty text has no ids and decodes to the empty text. Rows are encoded one by one: repeated
rows and ids give as many rows, a null id stays null, an empty table gives none, other columns are not read. Among equal
scores the leftmost pair merges first, as in the library. Remembered words are bounded by number and by characters.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import batches

MARK = "▁"
#: Marks and letters, marks and other characters, marks at the end.
NUMERIC = "\\d_²³¹¼-¾⁰-₟⅐-↏"
WORDS = re.compile(rf"{MARK}*[^\W{NUMERIC}]+|{MARK}*(?:[^\w{MARK}]|[{NUMERIC}])+|{MARK}+")
#: Words kept in memory at a time, in each Python worker, and the characters of the longest one that is kept.
MEMORY, KEPT = 500_000, 40


def merged(symbols: list[str], scores: dict[str, float], whole: str | None = None) -> list[str]:
    """The merge procedure itself: best score first, ties to the left. Stops at the two parts of `whole`."""
    symbols = list(symbols)
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0 or len(symbols) == 2 and symbols[0] + symbols[1] == whole:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def merged_run(word: str, rank: dict[str, int]) -> list[str]:
    """What the merge procedure makes of a word: the pair of least rank first, ties to the left. rank: of every piece."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of each piece that starts at a place
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        alive[middle], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := rank.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := rank.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    return [word[i : end[i]] for i in range(n) if alive[i]]


class PieceModel:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = model.unk_id()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[piece], self.ids[piece] = model.get_score(i), i
        if any(len(WORDS.findall(p)) != 1 for p in self.scores):
            raise ValueError(f"the model has pieces across words: {[p for p in self.scores if len(WORDS.findall(p)) != 1][:9]}")
        self.pieces = {i: p for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.rank = {p: i for i, p in enumerate(sorted(self.scores, key=lambda p: -self.scores[p]))}
        self.parts: dict[str, tuple[str, str]] = {}  # the last merge of every piece that merging can reach
        for p in self.scores:
            ends = merged(list(p), self.scores, whole=p)
            if len(ends) == 2:
                self.parts[p] = (ends[0], ends[1])
        self.reachable = {p for p in self.scores if len(p) == 1} | set(self.parts)
        self.trie = ahocorasick.Automaton()
        for p in self.reachable:
            self.trie.add_word(p, len(p))
        self.trie.make_automaton()
        self.characters = {p for p in self.reachable if len(p) == 1}
        self.apart: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, tuple[int, str, str]] = {}

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether merging the two neighbours anew ends in the same two pieces.

        Walks back through the last merges of both, latest first; they would join if the pieces at the boundary formed
        a piece before the merge that takes either of them away (left merges win ties).
        """
        rank, parts = self.rank, self.parts
        by_left = by_right = 1 << 60
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < by_left and joined <= by_right:
                return False
            in_left, in_right = parts.get(left), parts.get(right)
            if in_left and (not in_right or rank[left] > rank[right]):
                by_left, left = rank[left], in_left[1]
            elif in_right:
                by_right, right = rank[right], in_right[0]
            else:
                return True

    def remember(self, left: str, right: str) -> bool:
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        fits = self.apart[left, right] = self.stays_apart(left, right)
        return fits

    def segment(self, word: str) -> list[str]:
        """The pieces of a run of characters that are all in the vocabulary."""
        if len(word) == 1 or word in self.parts and not word.startswith(MARK * 2):
            return [word]
        if word.startswith(MARK * 2):
            return merged_run(word, self.rank)
        apart = self.apart
        pieces, left = [], None
        for end, size in self.trie.iter_long(word):  # longest matches throughout, if no pair of them would join
            piece = word[end - size + 1 : end + 1]
            if left is not None:
                fits = apart.get((left, piece))
                if fits is None:
                    fits = self.remember(left, piece)
                if not fits:
                    break
            pieces.append(piece)
            left = piece
        else:
            return pieces
        n = len(word)
        options: list[list[int]] = [[] for _ in range(n)]  # ends of the pieces from each position, rising
        for end, size in self.trie.iter(word):
            options[end - size + 1].append(end + 1)
        failed, path, at, left = 0, [], 0, None
        while at < n:
            here = options[at]
            while here:
                end = here.pop()
                if failed >> end & 1:
                    continue
                piece = word[at:end]
                if left is not None:
                    fits = apart.get((left, piece))
                    if fits is None:
                        fits = self.remember(left, piece)
                    if not fits:
                        continue
                path.append((piece, at))
                at, left = end, piece
                break
            else:
                if not path:
                    return merged_run(word, self.rank)
                failed |= 1 << at  # no piece from here on, whatever stands before: step back
                at = path.pop()[1]
                left = path[-1][0] if path else None
        return [piece for piece, _ in path]

    def word_ids(self, word: str) -> list[int]:
        if self.characters.issuperset(word):
            return [self.ids[p] for p in self.segment(word)]
        ids: list[int] = []
        run = ""
        for ch in word:
            if ch in self.characters:
                run += ch
                continue
            if run:
                ids += [self.ids[p] for p in self.segment(run)]
                run = ""
            ids += [self.bytes[b] for b in ch.encode()] if self.bytes else [self.unknown]
        if run:
            ids += [self.ids[p] for p in self.segment(run)]
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, byte pieces joined to characters; the word-start mark of the first piece is still a space."""
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces.get(i, " ⁇ "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def words(self, text: str) -> list[str]:
        return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def _known(self, word: str) -> tuple[int, str, str]:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            ids = self.word_ids(word)
            found = len(ids), ",".join(map(str, ids)), self.decode_ids(ids)
            if len(word) <= KEPT:
                self.memory[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for word in self.words(text or "") for i in self._known(word)[1].split(",")]

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).removeprefix(" ")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, their decimal list, the decoded text."""
        memory, known = self.memory, self._known
        parts = [memory.get(w) or known(w) for w in self.words(text or "")]
        if not parts:
            return 0, "", ""
        counts, ids, texts = zip(*parts)
        return sum(counts), ",".join(ids), "".join(texts).removeprefix(" ")


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches(it):
            ids = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column]).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without shipping the ids themselves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches(it):
            n, ids, text = [], [], []
            for t in batch.column(1).to_pylist():
                count, listed, decoded = model.digest(t)
                n.append(count)
                ids.append(hashlib.sha256(listed.encode()).hexdigest())
                text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column]).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
