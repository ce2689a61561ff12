"""Anchored composites of samples that pass in order of hole, analyte and start, of which only those of open composites are held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Composites that are computed at once, times the most samples that meet one.
BLOCK = 1 << 19


def _counted(depth: np.ndarray) -> np.ndarray:
    """`depth` in whole composites; nan is none."""
    if (depth >= 2**31).any():
        raise OverflowError("a hole of 2^31 composites or more")
    return np.nan_to_num(depth).astype(np.int64)


def _composed(rows: pa.Table, group: np.ndarray, heads: np.ndarray, length: float, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Composites `low` to `high` (left out) of every group; `starts` to `ends` are those that a row meets, none without a value."""
    first, deep, a, b, value = (rows[c].to_numpy() for c in ("first", "deep", "from_md", "to_md", "value"))
    rank = pc.rank(rows["sample"], null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    sampled = rows["sample"].is_valid().to_numpy()
    offset = np.concatenate(([0], np.cumsum(high - low)))
    begin = offset[group] + np.maximum(starts, low[group]) - low[group]
    stop = offset[group] + np.minimum(ends, high[group]) - low[group]
    opened, closed = (np.sort(x[stop > begin]) for x in (begin, stop))
    most = (np.arange(1, len(opened) + 1) - np.searchsorted(closed, opened, "right")).max(initial=1)
    size = max(BLOCK // int(most), 1)
    for lo in range(0, int(offset[-1]), size):
        hi = min(lo + size, int(offset[-1]))
        left = np.maximum(begin, lo)
        many = np.maximum(np.minimum(stop, hi) - left, 0)
        row = np.repeat(np.arange(len(many)), many)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + left[row]
        at = first[row] + (cell - offset[group[row]] + low[group[row]]) * length
        part = np.minimum(b[row], np.minimum(at + length, deep[row])) - np.maximum(a[row], at)
        row, cell, part = (x[part > tolerance] for x in (row, cell - lo, part))
        numerator, covered = (np.bincount(cell, x, hi - lo).astype(float) for x in (value[row] * part, part))  # whole numbers of no cell
        kept = sampled[row]
        row, cell = row[kept], cell[kept]
        order = np.lexsort((rank[row], cell))
        lists = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=hi - lo))))
        parents = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), rows["sample"].take(pa.array(row[order])).combine_chunks())
        k = np.arange(lo, hi)
        of = np.searchsorted(offset, k, "right") - 1
        k = (k - offset[of] + low[of]).astype(np.int32)
        named = rows.select(["hole", "analyte", "first", "deep"]).take(pa.array(heads[of])).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*(c.combine_chunks() for c in named.columns), pa.array(np.full(hi - lo, length)), pa.array(k), pa.array(numerator), pa.array(covered), parents],
            ["hole", "analyte", "first", "deep", "length", "k", "numerator", "covered", "parents"],
        )


def passing(lengths: tuple[float, ...], tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over (hole, analyte, sample, from_md, to_md, value, first, deep); `first` and `deep` are the hole's reach.

    A sample names the composites that it meets, from its ends. Composites before the last start of the last hole and
    analyte of a batch are closed, as no later sample starts before it; samples that reach further are held for the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, np.zeros(len(lengths), np.int64)  # samples of the open group, and its composites that are out
        for batch in chain(batches, [None]):
            parts = [x for x in (held, batch and pa.Table.from_batches([batch])) if x is not None and x.num_rows]
            if not parts:
                continue
            rows = pa.concat_tables(parts).combine_chunks()
            other = np.zeros(rows.num_rows - 1, bool)
            for c in ("hole", "analyte"):
                other |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy()
            heads = np.concatenate(([0], np.flatnonzero(other) + 1))
            group = np.concatenate(([0], np.cumsum(other)))
            first, deep, a, b = (rows[c].to_numpy() for c in ("first", "deep", "from_md", "to_md"))
            valued = rows["value"].is_valid().to_numpy()
            keep = np.zeros(rows.num_rows, bool)
            keep[-1] = batch is not None
            again = np.zeros(len(lengths), np.int64)
            for i, length in enumerate(lengths):
                starts = _counted(np.floor((a - first) / length))
                ends = np.where(valued, np.maximum(_counted(np.ceil((b - first) / length - tolerance)), starts + 1), 0)
                high = np.maximum(_counted(np.ceil((deep[heads] - first[heads]) / length - tolerance)), 1)
                low = np.zeros(len(heads), np.int64)
                low[0] = done[i]  # no group but the open one goes on, and it comes first
                if batch is not None:
                    high[-1] = max(min(high[-1], starts[-1]), low[-1])
                    keep |= (group == group[-1]) & (ends > high[-1])
                    again[i] = high[-1]
                yield from _composed(rows, group, heads, length, starts, ends, low, high, tolerance)
            done = again
            held = rows.filter(pa.array(keep))

    return run
