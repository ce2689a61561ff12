"""Words of texts as Arrow arrays, split and numbered outside Python's objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def as_texts(column: pa.Array) -> pa.Array:
    """Null as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def _without_empties(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    flat = lists.flatten()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(lists)), sizes)[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.bincount(owner, minlength=len(lists)).astype(np.int64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts after each other, and how many each text has."""
    return _without_empties(pc.ascii_split_whitespace(texts))


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct ones, which come beside."""
    if not len(words):
        return np.zeros(0, np.int64), words
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
