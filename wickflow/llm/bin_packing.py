"""Best-fit packing of tokenised documents into sequences that hold whole documents, in one pass and bounded space.

Documents come in any order and are placed at once. A fixed number of sequences is open. A bitset has a bit for each
amount of free space that an open sequence has, so the least space that is enough for a document is found by one shift and the
lowest set bit. Where no open sequence has enough, the fullest one (the lowest bit of all) closes first, if as many are open as
may be, and an empty one opens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wickflow.llm.common import named
from wickflow.llm.packing import word_tokenizer

END_ID = 1
CAPACITY = 4096
#: Open sequences of a task; they hold at most CAPACITY ids each, 4 MB in all.
OPEN = 256
#: Rows that a task gathers before it hands them on, and ids.
OUT_ROWS, OUT_IDS = 4096, 1 << 21
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class OpenBins:
    """Bins of equal capacity, at most `limit` of them open. Bins are numbered from 0 in the order in which they open."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.spaces = 0
        self.bins: dict[int, list[int]] = {}
        self.opened = self.open = 0

    def _put(self, number: int, space: int) -> None:
        self.spaces |= 1 << space
        self.bins.setdefault(space, []).append(number)

    def _take(self, space: int) -> int:
        """A bin with exactly this free space leaves the set."""
        there = self.bins[space]
        number = there.pop()
        if not there:
            del self.bins[space]
            self.spaces ^= 1 << space
        return number

    def place(self, size: int) -> tuple[int, int, list[int]]:
        """(bin, offset, bins that close) for an item of 1 to `capacity`."""
        closed = []
        fits = self.spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.limit:
                closed.append(self._take((self.spaces & -self.spaces).bit_length() - 1))
                self.open -= 1
            number, space = self.opened, self.capacity
            self.opened += 1
            self.open += 1
        if space > size:
            self._put(number, space - size)
        else:
            closed.append(number)
            self.open -= 1
        return number, self.capacity - space, closed


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document of n tokens: whole if it fits, else in full pieces and a rest."""
    for piece, start in enumerate(range(0, n, capacity)):
        yield piece, start, min(capacity, n - start)


def pack_whole(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    limit: int = OPEN,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset.

    A document's tokens are those of its text and end_id; a null or blank text has end_id alone. Documents of at most
    `capacity` tokens are whole in one sequence, longer ones (however long) are cut into full pieces, each a sequence of
    its own, and a rest. Each task packs the rows that it reads without a shuffle, with at most `limit` open sequences, which
    bounds its memory, so sequence_id (partition and serial) depends on how the input is split. Null ids are kept,
    repeated rows are packed as often as they come, an empty table gives none. Other columns are ignored, whatever their names.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int32() if n == "piece" else pa.binary() if n == "ids" else pa.int64() for n in names]

    def run(batches: Iterable[pa.RecordBatch]):
        tokenizer, first = word_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        bins, held, out = OpenBins(capacity, limit), {}, []
        end, ready = np.array([end_id], dtype="<u4").tobytes(), 0

        def hand_on():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                doc_id, ids = doc_id.as_py(), tokenizer.encode(text.as_py() or b"") + end
                for piece, start, length in pieces_of(len(ids) // 4, capacity):
                    number, offset, closed = bins.place(length)
                    row = (doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], first + number, offset)
                    held.setdefault(number, []).append(row)
                    for c in closed:
                        rows = held.pop(c)
                        out += rows
                        ready += sum(r[3] for r in rows)
                    if len(out) >= OUT_ROWS or ready >= OUT_IDS:
                        yield hand_on()
                        out.clear()
                        ready = 0
        for rows in held.values():
            out += rows
            if len(out) >= OUT_ROWS:
                yield hand_on()
                out.clear()
        if out:
            yield hand_on()

    doc_id, text = named(docs, id_col, text_col)
    return docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, SCHEMA)
