"""Words of many texts at once, as numbers, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are what stands between these bytes: \x20 and \x09 to \x0D.
SPACE = " \t\n\v\f\r"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of every word in order, and where each text's words end. Null: no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
    coded = parts.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()  # from white space at either end
    if empty >= 0:
        real = numbers != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        numbers = numbers[real]
    return coded.dictionary, numbers, ends


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, all else as it is."""
    return pc.ascii_lower(texts)


def windows(numbers: np.ndarray, size: int) -> np.ndarray:
    """A number for each window of ``size`` words, equal for equal windows and only for these."""
    keys = numbers.astype(np.int64)
    for k in range(1, size):
        following = numbers[k:].astype(np.int64)
        keys = keys[: len(following)]
        if len(keys) and (int(keys.max()) + 1) * (int(following.max()) + 1) >= 1 << 62:
            keys = np.unique(keys, return_inverse=True)[1]
            following = np.unique(following, return_inverse=True)[1]
        keys = keys * (int(following.max(initial=0)) + 1) + following
    return keys
