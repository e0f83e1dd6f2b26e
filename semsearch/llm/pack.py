"""Best-fit packing by sums of squares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import for_python
from .encode import encoder, give_memory_back, in_slices

#: Bytes of text that are packed together, largest piece first.
SLICE_BYTES = 6_000_000

#: Bytes of text that are encoded at once.
ENCODE_BYTES = 3_000_000


class OpenSequences:
    """The sequences of one task that still have room, by the room they have.

    A piece goes to the room where the sum of the squared counts of open
    sequences per room becomes smallest, so that no room piles up.  A new
    sequence is opened only if the piece fits nowhere.
    """

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.counts = np.zeros(size + 1, np.int64)
        self.at_room: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        """The sequence id and the offset for a piece of this length."""
        fits = self.counts[length : self.size]
        # a sequence leaves its room (-2n+1) and, unless full, enters the remaining one (+2n+1)
        change = 2 * (self.counts[: self.size - length] - fits) + 2
        if len(change):
            change[0] = 1 - 2 * fits[0]
            change[fits == 0] = np.iinfo(np.int64).max
            left = int(change.argmin())
        if not len(change) or not fits[left]:
            sequence, room = self.next_id, self.size
            self.next_id += 1
        else:
            room = length + left
            sequence = self.at_room[room].pop()
            self.counts[room] -= 1
        if room > length:
            self.at_room.setdefault(room - length, []).append(sequence)
            self.counts[room - length] += 1
        return sequence, self.size - room


def pack_documents(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0, keep_pieces: bool = True
) -> DataFrame:
    """Pack the token ids of whole documents into sequences of at most ``max_tokens``.

    Returns one row per piece: doc_id, piece (from 0), start (the document's ids
    before it), length, ids (little-endian unsigned 32-bit), sequence_id, offset.
    A document is its ids and ``end_id``; only one longer than a sequence is cut,
    into pieces of ``max_tokens`` and a rest.

    Every task packs the documents it reads, so nothing is shuffled and a lost
    task is simply run again; each task leaves a handful of sequences with room.
    A null or empty text is a single ``end_id``; repeated rows are packed as often
    as they occur; an empty table gives no rows.  Other columns are not read.

    With ``keep_pieces`` a worker remembers encoded pieces from one task to the next;
    without, it forgets them after each task, which takes more time and less memory
    where the same workers serve other stages.  The result is the same.
    """
    schema = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"

    def pack(batches):
        codec = encoder(vocabulary)
        room = OpenSequences(max_tokens, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for a, b in in_slices(batch.column(1), SLICE_BYTES):
                yield _packed(codec, room, batch.column(0)[a:b], batch.column(1)[a:b], end_id)
        if not keep_pieces:
            codec.forget()
            give_memory_back()

    return for_python(df.select(df[id_col].cast("long"), df[text_col].cast("string"))).mapInArrow(pack, schema)


def _packed(codec, room: OpenSequences, doc_ids: pa.Array, texts: pa.Array, end_id: int) -> pa.RecordBatch:
    parts, sizes = [], []
    for a, b in in_slices(texts, ENCODE_BYTES):
        ids, ends = codec.encode(texts[a:b])
        parts.append(np.insert(ids, ends, end_id).astype("<u4"))
        sizes.append(np.diff(ends, prepend=0) + 1)
    size = np.concatenate(sizes)
    count = -(-size // room.size)
    doc = np.repeat(np.arange(len(size)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * room.size
    length = np.minimum(size[doc] - start, room.size)
    sequence, offset = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    for i in np.argsort(-length, kind="stable").tolist():
        sequence[i], offset[i] = room.place(int(length[i]))
    edges = np.concatenate([[0], np.cumsum(length)]) * 4
    ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.concatenate(parts).tobytes())])
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids.cast(pa.binary()), pa.array(sequence), pa.array(offset)],
        names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
    )
