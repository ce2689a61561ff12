"""Removal of repeated byte strings, by hash-compared suffix sorting around content-chosen anchors.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier (in a smaller id, or before in the same
text). Copies of a whole text are settled by digest first; only the copy with the smallest id goes on.

Every window of LENGTH bytes chooses an anchor, the `GRAM`-byte string of least hash in it, so equal windows meet at
equal anchors. Anchors whose whole surroundings are equal are settled at once (all but the first are repeats). The rest
of a group is sorted as suffixes to the right of the anchor and, reversed, to its left: a merge sort whose comparisons
find the common extension of two suffixes by binary search over prefix polynomial hashes, so that a comparison takes
logarithmic time; common extensions of neighbours are verified byte by byte, and a group in which a hash misled is
sorted by its bytes. A window is a repeat if an earlier member shares both extensions.

Groups of over `LARGE` members are not gathered in a task: their windows are hashed one by one and meet in a Spark
aggregation.

Each text has a number, in the order of ids, that stands for its id inside the operator. Rows that share an id but differ
in text are texts of their own, ordered by digest within the id; those that are equal in both are one. Null and empty
texts have nothing to remove, nor do rows without an id. Extra columns are left alone. Matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE, batches, drop_tables, materialize, numbered_rows, release, word_texts
from .jaccard_join import _POWERS, mixed

LENGTH, GRAM, LARGE = 100, 32, 100_000
REACH = LENGTH - GRAM  # windows start at most so far before an anchor
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POSITION_BITS = np.uint64(28)
#: Marks a span among anchors; the lower bits are position and size, or start and stop, of 31 bits each.
SPAN = 1 << 62


def anchors(texts: list[bytes], piece: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, gram hash, hash of the surroundings) of the anchors of all texts; longer texts are taken `piece` bytes of windows at a time."""
    if all(len(t) <= 2 * piece for t in texts):
        return _anchors(texts)
    found = []
    for i, text in enumerate(texts):
        parts = []
        for s in range(0, max(1, len(text) - LENGTH + 1), piece):
            low = max(0, s - REACH)
            part = _anchors([text[low : s + piece + REACH + LENGTH]], s - low, s - low + piece)
            parts.append((part[1] + low, *part[2:]))
        pos, gram, around = (np.concatenate(c) for c in zip(*parts))
        first = np.unique(pos, return_index=True)[1]  # windows of two pieces may choose one anchor
        found.append((np.full(len(first), i), pos[first], gram[first], around[first]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _anchors(texts: list[bytes], first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors chosen by the windows that start from `first` on and before `last`."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if len(raw) > 1 << int(_POSITION_BITS):
        raise ValueError("more bytes at once than positions have bits")
    if len(raw) < LENGTH:
        return none, none, none, none
    up, down = _POWERS.to(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(total) - GRAM])
    key = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    least, have = key, 1
    while 2 * have <= REACH + 1:  # least of 1, 2, 4, ... neighbours
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = REACH + 1 - have
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    start = np.arange(len(least))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    chosen = least[(start + LENGTH <= stop[owner]) & (start >= first) & (start < (len(raw) if last is None else last))]
    at = np.unique((chosen & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64))
    owner = np.searchsorted(stop, at, "right")
    begin = stop[owner] - sizes[owner]
    low, high = np.maximum(begin, at - REACH), np.minimum(stop[owner], at + LENGTH)
    with np.errstate(over="ignore"):
        around = mixed((total[high] - total[low]) * down[low] + mixed((at - low).astype(np.uint64) * np.uint64(257) + (high - at).astype(np.uint64)))
    return owner, at - begin, grams[at].astype(np.int64), around.astype(np.int64)


def window_span(pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the windows over an anchor cover."""
    return np.maximum(0, pos - REACH), np.minimum(pos, size - LENGTH) + LENGTH


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans of a batch, overlapping ones of a document joined."""
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        shift = int(end.max()) + 2
        place = np.unique(doc, return_inverse=True)[1].astype(np.int64) * shift
        reach = np.maximum.accumulate(end + place)
        new = np.concatenate([[True], (start + place)[1:] > reach[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        doc, start, end = doc[first], start[first], reach[last] - place[last]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "start", "stop"])


def _find_anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text): anchors, each surrounding once a batch (its first), and (place over SPAN: doc_id, start, stop) spans that repeats in the batch cover."""
    for batch in batches(it, 512):
        doc = batch.column(0).to_numpy()
        order = np.argsort(doc, kind="stable")
        texts = word_texts(batch.column(1))
        texts, doc = [texts[i] for i in order.tolist()], doc[order]
        sizes = np.array([len(t) for t in texts], np.int64)
        owner, pos, gram, around = anchors(texts)
        kept = np.sort(np.unique(np.stack([gram, around], 1).view([("g", "i8"), ("a", "i8")]).ravel(), return_index=True)[1])
        again = np.ones(len(pos), bool)
        again[kept] = False
        start, end = window_span(pos[again], sizes[owner[again]])
        spans = _spans(doc[owner[again]], start, end)
        parts = [(gram[kept], around[kept], doc[owner[kept]], pos[kept] << 31 | sizes[owner[kept]])]
        if spans.num_rows:  # dealt like anchors
            span_doc, span_start, span_stop = (c.to_numpy() for c in spans.columns)
            parts.append((mixed(span_doc.astype(np.uint64) + span_start.astype(np.uint64)).astype(np.int64), span_doc * 0, span_doc, SPAN | span_start << 31 | span_stop))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)], names=["h", "around", "doc_id", "place"])


def _settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors in order (h, around, doc_id, place): spans of repeated surroundings (h null: doc_id, start, stop), and the first of each surroundings in groups of several (h, doc_id, pos, class number)."""
    held: list[np.ndarray] | None = None

    def finished(c: list[np.ndarray]) -> pa.RecordBatch:
        *c, place = c
        inside = place >= SPAN
        place &= SPAN - 1
        c += [place >> 31, place & (1 << 31) - 1]
        given = [x[inside] for x in c[2:]]
        h, around, doc, pos, size = (x[~inside] for x in c)
        if not len(h):
            spans = _spans(*given)
            return pa.RecordBatch.from_arrays([pa.nulls(spans.num_rows, pa.int64()), *spans.columns], names=["h", "doc_id", "pos", "stop"])
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], around[1:] != around[:-1]])
        group = np.cumsum(new_h) - 1
        classes = np.bincount(group, new)[group]
        first = np.flatnonzero(new & (classes > 1))
        start, end = window_span(pos[~new], size[~new])
        spans = _spans(*(np.concatenate(x) for x in zip(given, (doc[~new], start, end))))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(spans.num_rows, pa.int64()), pa.array(h[first], pa.int64())]), pa.concat_arrays([spans.column(0), pa.array(doc[first], pa.int64())]), pa.concat_arrays([spans.column(1), pa.array(pos[first], pa.int64())]), pa.concat_arrays([spans.column(2), pa.array(classes[first].astype(np.int64), pa.int64())])],
            names=["h", "doc_id", "pos", "stop"],
        )

    for batch in it:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy().astype(np.int64) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [c[cut:] for c in columns]
        if cut:
            yield finished([c[:cut] for c in columns])
    if held is not None:
        yield finished(held)


def _surroundings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, places: h, pos, members): (h, doc_id, pos, members, left, right)."""
    for batch in batches(it, 256):
        rows = []
        for doc, text, places in zip(batch.column(0).to_pylist(), word_texts(batch.column(1)), batch.column(2).to_pylist()):
            rows += [(p["h"], doc, p["pos"], p["members"], text[max(0, p["pos"] - REACH) : p["pos"]], text[p["pos"] : p["pos"] + LENGTH]) for p in places]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["h", "doc_id", "pos", "members", "left", "right"])


def common_extension(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefixes of rows a and b, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), hashes.shape[1] - 1)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes[a, middle] == hashes[b, middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sorted_suffixes(group: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, codes) and the common prefix with the row before (-1 at a group's start).

    `codes` are byte values from 1, padded with 0; groups are contiguous. A merge sort, all groups at once: each row
    finds its place in the neighbouring sorted run by binary search.
    """
    n, width = codes.shape
    hashes = np.zeros((n, width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            hashes[:, j + 1] = (hashes[:, j] + codes[:, j] + np.uint64(1)) * _BASE
    padded = np.concatenate([codes, np.zeros((n, 1), codes.dtype)], 1)

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        shared = common_extension(hashes, a, b)
        x, y = padded[a, shared], padded[b, shared]
        return np.where(shared == width, ties, x < y)

    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(start, n))
    begin, size = np.repeat(start, sizes), np.repeat(sizes, sizes)
    order, place = np.arange(n), np.arange(n) - begin
    run = 1
    while run < sizes.max():
        moving = np.flatnonzero(size > run)  # slots of groups that are not in one run
        mine = place[moving] // run
        other = mine ^ 1
        low = np.minimum(other * run, size[moving])
        end = np.minimum(low + run, size[moving])
        high, ties = end.copy(), mine & 1 == 1
        other_start = low.copy()
        rows = order[moving]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            theirs = order[begin[moving[open_]] + middle]
            goes = before(theirs, rows[open_], ties[open_])
            low[open_], high[open_] = np.where(goes, middle + 1, low[open_]), np.where(goes, high[open_], middle)
        to = np.minimum(mine, other) * run + (place[moving] - mine * run) + (low - other_start)
        order[begin[moving] + to] = rows
        run *= 2
    shared = np.full(n, -1, np.int64)
    inner = np.flatnonzero(np.concatenate([[False], group[order][1:] == group[order][:-1]]))
    shared[inner] = common_extension(hashes, order[inner - 1], order[inner])
    if not _verified(codes, order, inner, shared):
        order = np.lexsort((*codes.T[::-1], group))
        above = codes[order[inner - 1]] != codes[order[inner]]
        shared[inner] = np.where(above.any(1), above.argmax(1), width)
    return order, shared


def _verified(codes: np.ndarray, order: np.ndarray, inner: np.ndarray, shared: np.ndarray) -> bool:
    """Whether neighbours agree in just the bytes that their hashes say, and are in order."""
    a, b = codes[order[inner - 1]], codes[order[inner]]
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), codes.shape[1])
    rows = np.flatnonzero(first < codes.shape[1])
    return bool((first == shared[inner]).all() and (a[rows, first[rows]] < b[rows, first[rows]]).all())


def _matrix(parts: list[bytes], width: int, reverse: bool = False) -> np.ndarray:
    raw = b"".join((p[::-1] if reverse else p).ljust(width, b"\0") for p in parts)
    sizes = np.array([len(p) for p in parts])
    codes = np.frombuffer(raw, np.uint8).reshape(len(parts), width).astype(np.uint16) + 1
    codes[np.arange(width)[None, :] >= sizes[:, None]] = 0
    return codes


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """By member and offset of its anchor in the window: whether an earlier member of the group has the same window."""
    out = np.zeros((len(group), REACH + 1), bool)
    sizes = [np.array([len(p) for p in x]) for x in (left, right)]
    ranks = []
    for parts, width, back in ((left, REACH, True), (right, LENGTH, False)):
        ranks.append(sorted_suffixes(group, _matrix(parts, width, back)))
    numbers = np.zeros((2, len(group)), np.int64)
    for offset in range(REACH + 1):
        whole = np.flatnonzero((sizes[0] >= offset) & (sizes[1] >= LENGTH - offset))
        for k, needed in enumerate((offset, LENGTH - offset)):
            order, shared = ranks[k]
            numbers[k, order] = np.cumsum(shared < needed)
        key = numbers[0, whole] * (len(group) + 1) + numbers[1, whole]
        first = np.unique(key, return_index=True)[1]
        again = np.ones(len(whole), bool)
        again[first] = False
        out[whole, offset] = again
    return out


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members of groups in order (h, doc_id, pos, left, right): spans that repeated windows cover."""
    held: pa.Table | None = None

    def finished(t: pa.Table) -> pa.RecordBatch:
        h, doc, pos = (t[c].to_numpy() for c in ("h", "doc_id", "pos"))
        again = repeated_windows(h, t["left"].to_pylist(), t["right"].to_pylist())
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        return _spans(doc[row], pos[row] - last, pos[row] - first + LENGTH)

    for batch in batches(it, 20_000):
        now = pa.Table.from_batches([batch])
        if held is not None:
            now = pa.concat_tables([held, now])
        h = now["h"].to_numpy()
        if not len(h):
            continue
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield finished(now.slice(0, cut).combine_chunks())
        held = now.slice(cut)
    if held is not None and held.num_rows:
        yield finished(held.combine_chunks())


def _each_window(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members of large groups: (key, doc_id, start) of every window, key being 128 bits of SHA-256."""
    for batch in batches(it, 1024):
        rows = []
        for doc, pos, left, right in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5))):
            around = left + right
            rows += [(hashlib.sha256(around[s : s + LENGTH]).digest()[:16], doc, pos - len(left) + s) for s in range(min(len(left), len(around) - LENGTH) + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.binary(), pa.int64(), pa.int64()))], names=["key", "doc_id", "start"])


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, spans): sizes and what is left."""
    for batch in batches(it, 512):
        rows = []
        for text, spans in zip(word_texts(batch.column(1)), batch.column(2).to_pylist()):
            kept, at, runs, gone = [], 0, 0, 0
            reach = -1
            for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                if s[0] > reach:
                    runs += 1
                    kept.append(text[at : s[0]])
                    gone += s[1] - s[0]
                    reach = at = s[1]
                elif s[1] > reach:
                    gone += s[1] - reach
                    reach = at = s[1]
            kept.append(text[at:])
            rows.append((len(text), gone, runs, b"".join(kept)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(texts: DataFrame, large: int = LARGE) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, start, stop) of spans to remove from texts with one row an id (here the text's number), each text there once; spans may overlap. And the tables they are read from."""
    spark = texts.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = texts.mapInArrow(_find_anchors, "h long, around long, doc_id long, place long")
    dealt = found.repartition(width, "h").sortWithinPartitions("h", "around", "doc_id", "place")
    settled = materialize(dealt.mapInArrow(_settle, "h long, doc_id long, pos long, stop long"))
    release(spark)
    whole = settled.where("h IS NULL").select("doc_id", F.col("pos").alias("start"), "stop")
    places = settled.where("h IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos", F.col("stop").alias("members"))).alias("places"))  # at most an anchor a byte of the text
    around = texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_surroundings, "h long, doc_id long, pos long, members long, left binary, right binary")
    around = materialize(around)
    release(spark)
    usual = around.where(F.col("members") <= large).select("h", "doc_id", "pos", "left", "right").repartition(width, "h").sortWithinPartitions("h", "doc_id", "pos")
    compared = usual.mapInArrow(_compare, "doc_id long, start long, stop long")
    windows = around.where(F.col("members") > large).mapInArrow(_each_window, "key binary, doc_id long, start long")
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = windows.join(first, "key").where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))
    return whole.unionByName(compared).unionByName(met), [settled, around]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", large: int = LARGE) -> DataFrame:
    """(doc_id, digest, n_bytes, n_removed, n_spans, kept) of every row; kept is what is left, digest of what was."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    named = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    listed = materialize(named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    first = listed.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    taken = numbered_rows(first, "doc_id", "digest")
    texts = materialize(named.join(taken, ["doc_id", "digest"]).select(F.col("number").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    release(docs.sparkSession)
    spans, between = repeated_spans(texts, large)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # a few an anchor of the text
    cut = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    cut = materialize(cut)
    drop_tables(texts, *between)
    release(docs.sparkSession)
    copies = taken.select("digest", F.col("doc_id").alias("copied"))
    state = listed.join(taken, ["doc_id", "digest"], "left").join(copies, "digest", "left")
    copy = (F.col("copied") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH)
    state = state.select("doc_id", "digest", "n_bytes", copy.alias("copy"), F.col("number").alias("own"))
    out = state.join(cut.select(F.col("doc_id").alias("own"), "n_removed", "n_spans", "kept"), "own", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", "digest", "n_bytes",
        F.when(F.col("own").isNotNull(), F.col("n_removed")).when(F.col("copy"), F.col("n_bytes")).otherwise(none).alias("n_removed"),
        F.when(F.col("own").isNotNull(), F.col("n_spans")).when(F.col("copy"), F.lit(1).cast("long")).otherwise(none).alias("n_spans"),
        F.when(F.col("own").isNotNull(), F.col("kept")).when(F.col("copy"), F.lit(b"")).alias("kept"),
    )


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.when(F.col("n_removed") == 0, F.col("digest")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated strings removed from text (characters cut in part go too) and n_chars counted anew."""
    free = next(x for x in ("cut", *(f"cut{i}" for i in range(len(docs.columns) + 1))) if not any(c.startswith(x) for c in docs.columns))
    cut = remove_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias(f"{free}_id"), F.col("digest").alias(f"{free}_digest"), F.col("kept").alias(f"{free}_kept")).dropDuplicates([f"{free}_id", f"{free}_digest"])
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)

    def decoded(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for kept in it:
            yield pa.array([None if k is None else k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())

    text = F.when(F.col(f"{free}_id").isNotNull(), F.arrow_udf(decoded, "string")(F.col(f"{free}_kept"))).otherwise(F.col("text"))
    joined = docs.join(cut, (docs.doc_id == F.col(f"{free}_id")) & (digest == F.col(f"{free}_digest")), "left")
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(f"{free}_id").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select([F.col(f"`{c}`") for c in docs.columns])
