"""Token ids of whole texts, with each distinct unit of text encoded once per worker.

A *unit* is a stretch of text that the tokenizer's own pre-splitting never joins
to its neighbours, so the ids of a text are the ids of its units in order; a unit
that ends in punctuation is looked up as two such pieces.  Words repeat, so the
library encodes few of them and the rest are looked up.
"""

from __future__ import annotations

import ctypes
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

_LIBC = ctypes.CDLL(None)

#: Pieces that a worker remembers before it starts anew, and their bytes; bound its memory, not its results.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 64_000_000

#: What the split at single blanks and line feeds cannot take: runs of white space, other
#: white space, white space at either end, and the separator itself (RE2 syntax).
ODD_SPACE = r"[\t\r\v\f\x00\x1c-\x1f\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


#: Marks that end a unit and are never joined to what ``STEM_END`` says.
TAIL_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: What may stand before them: digits and letters of Latin and Cyrillic that keep being one
#: letter when lower-cased and composed (RE2 syntax); other units stay whole.
STEM_END = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}]\z"


#: Words that byte-level pre-splitting keeps whole: a blank or none, then letters of Latin and
#: Cyrillic, digits, or ASCII marks (RE2 syntax).
ONE_WORD = r"\A ?(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}]+|[0-9]+|[!-/:-@\[-`{-~]+)\z"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}


LETTERS = _byte_letters()


class _Places:
    """Pieces by their numbers; a new piece gets the next number."""

    def __init__(self, known: pa.Array | None = None):
        self.known = pa.array([], pa.string()) if known is None else known

    def __len__(self) -> int:
        return len(self.known)

    def values(self) -> range:
        return range(len(self))

    def of(self, pieces: pa.Array) -> np.ndarray:
        places = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(places < 0)
        coded = pieces.take(pa.array(new)).dictionary_encode()
        places[new] = len(self) + coded.indices.to_numpy()
        self.known = pa.concat_arrays([self.known, coded.dictionary])
        return places


def _stretches(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` one after another, and where each of them ends."""
    ends = np.cumsum(sizes)
    at = np.repeat(first - (ends - sizes), sizes)
    at += np.arange(len(at))
    return flat[at], ends


def _split(texts: pa.Array) -> pa.ListArray:
    """Units of each text for a vocabulary that keeps white space."""
    texts = pc.replace_substring(texts, " ", "\x00 ")
    return pc.split_pattern(pc.replace_substring(texts, "\n", "\x00\n\x00"), "\x00")


def _stems_and_tails(units: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each unit cut before the marks that end it, if ``STEM_END`` stands there; else whole and ``""``."""
    if not len(units):
        return units, units
    stems = pc.ascii_rtrim(units, TAIL_MARKS)
    cut = pc.match_substring_regex(stems, STEM_END)
    stems = pc.if_else(cut, stems, units)
    sizes = pc.binary_length(units).to_numpy()
    left = sizes - pc.binary_length(stems).to_numpy()
    ends = np.cumsum(left)
    # the last bytes of each unit, out of all units' bytes one after another
    offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
    at = np.repeat(offsets[1:] - ends, left) + np.arange(left.sum())
    tails = np.frombuffer(units.buffers()[2] or b"", np.uint8)[at]
    edges = np.concatenate([[0], ends]).astype(np.int32)
    return stems, pa.StringArray.from_buffers(len(units), pa.py_buffer(edges), pa.py_buffer(tails))


class UnitEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a vocabulary with a normalizer drops white space, so its units are plain words
        self.drops_space = self.tokenizer.normalizer is not None
        split, plain = self.tokenizer.pre_tokenizer, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        # then the library's model takes a single word as it is, without splitting and offsets
        self.byte_level = not self.drops_space and isinstance(split, ByteLevel) and plain.items() <= json.loads(split.__getstate__()).items()
        self.places = _Places()
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.recent = np.empty(0, np.int64)

    def forget(self) -> None:
        """Forget all pieces but those of the last texts, so that a worker that waits holds little memory."""
        kept = self.recent
        ids, ends = _stretches(self.flat, self.starts[kept], np.diff(self.starts)[kept])
        self.flat = np.concatenate([ids, np.empty(1 << 16, np.uint32)])
        self.starts = np.concatenate([[0], ends])
        self.places = _Places(self.places.known.take(pa.array(kept)))
        self.recent = np.arange(len(kept))

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, and where each text's units end."""
        texts = pc.fill_null(texts, "")
        if self.drops_space:
            texts = pc.ascii_lower(texts)  # it lower-cases everything anyway
            parts = pc.ascii_split_whitespace(texts)
        else:
            odd = pc.match_substring_regex(texts, ODD_SPACE)
            if pc.any(odd).as_py():
                whole = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
                parts = pc.if_else(odd, whole, _split(pc.if_else(odd, "", texts)))
            else:
                parts = _split(texts)
        return parts.flatten(), np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)

    def _ids(self, pieces: pa.Array) -> list[list[int]]:
        """Ids of each piece by the library; of single words by its model alone."""
        alone = pc.match_substring_regex(pieces, ONE_WORD).to_pylist() if self.byte_level else [False] * len(pieces)
        pieces, model = pieces.to_pylist(), self.tokenizer.model
        rest = iter(self.tokenizer.encode_batch_fast([p for p, a in zip(pieces, alone) if not a], add_special_tokens=False))
        return [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(LETTERS))] if a else next(rest).ids for p, a in zip(pieces, alone)]

    def _learn(self) -> None:
        fresh = self.places.known[len(self.starts) - 1 :]
        for i in range(0, len(fresh), 8192):
            ids = self._ids(fresh[i : i + 8192])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = self.starts[-1] + np.cumsum(sizes)
            while ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.starts[-1] : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            self.starts = np.concatenate([self.starts, ends])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids end. A null text is empty."""
        units, ends = self._units(texts)
        units = units.dictionary_encode()
        places = self.places.of(pa.concat_arrays(_stems_and_tails(units.dictionary)))
        self._learn()
        # the ids of each distinct unit, those of its stem and then those of its tail
        parts = places.reshape(2, -1).T.ravel()
        ids, after = _stretches(self.flat, self.starts[parts], self.starts[parts + 1] - self.starts[parts])
        starts = np.concatenate([[0], after[1::2]])
        each = units.indices.to_numpy()
        ids, after = _stretches(ids, starts[each], np.diff(starts)[each])
        self.recent = np.unique(places)
        if len(self.places) > REMEMBERED or self.places.known.nbytes > REMEMBERED_BYTES:
            self.forget()
        return ids, np.concatenate([[0], after])[ends]


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """The encoder of a worker process for a vocabulary file; a task has one core, so the library has one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(path)


def in_slices(texts: pa.Array, most: int = 10_000_000):
    """Cut an array of texts into (from, to) ranges of about ``most`` bytes at most, or one text.

    After the last one the worker gives freed memory back, as it waits for its next task with what it keeps.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield start, stop
        start = stop
    give_memory_back()


def give_memory_back() -> None:
    """Freed memory of a worker goes back to the system, as other tasks of the executor may need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
