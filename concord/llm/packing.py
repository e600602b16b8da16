"""Packing documents into training sequences: sum-of-squares online packing.

Each document's tokens (its text's ids, then an end id) are cut into whole
windows of the capacity and one remainder.  A remainder goes to the window fill
level that makes the sum of squared counts of partially filled windows
smallest; the counts sit in a level array, so a placement looks at no more than
``capacity`` numbers.  Ties go to the fullest level.

A remainder may also be cut, so that its first part fills a window to the brim
and the rest starts or fills another, where that makes the sum smaller by more
than ``cut_price``.  So no level's count runs away from the others', and a stream
has some tens of open windows at any length.

Every scan partition packs its own documents as a stream: no shuffle, and a lost
task is redone alone.  At its end the pieces of the open windows are placed once
more, with cuts free, which leaves a window or a few that are not full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from concord.llm.common import set_up, slices, text_or_empty, tidy
from concord.llm.tokens import encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Sequence numbers of one partition lie in a range of this many.
SEQUENCES = 1 << 36
#: By how much a cut must make the sum of squares smaller than a placement as a whole does.
CUT_PRICE = 1.0


class SumOfSquares:
    """The level array: for each fill level the windows that have it, and the choice of the next level.

    ``cut(piece, n)`` gives the first n tokens of a piece and the rest.
    """

    def __init__(self, capacity: int, cut, cut_price: float):
        self.capacity, self.cut, self.cut_price = capacity, cut, cut_price
        self.windows: list[list] = [[] for _ in range(capacity + 1)]
        # what the sum of squares changes by when a window leaves, or reaches, a level
        self._leave = np.full(capacity + 1, np.inf)
        self._leave[0] = 0
        self._reach = np.ones(capacity + 1)
        self._reach[capacity] = 0

    def _recount(self, level: int) -> None:
        n = len(self.windows[level])
        self._leave[level] = 1 - 2 * n if n else np.inf
        self._reach[level] = 2 * n + 1

    def _take(self, level: int) -> list:
        window = self.windows[level].pop() if level else []
        if level:
            self._recount(level)
        return window

    def place(self, size: int, piece) -> list[list]:
        """Put a piece of 1 to capacity - 1 tokens into a window, or into several; the windows that this fills."""
        full = []
        leave, reach, top = self._leave, self._reach, self.capacity
        while True:
            whole = leave[: top - size + 1] + reach[size:]
            level = len(whole) - 1 - int(whole[::-1].argmin())
            if size > 1:
                # a cut fills a window of a level above top - size; the rest fills another or starts one
                cuts = leave[top - size + 1 : top] + np.minimum(reach[1:size], leave[top - 1 : top - size : -1])
                if size % 2 == 0:  # both parts would fill windows of one level
                    n = len(self.windows[top - size // 2])
                    cuts[size // 2 - 1] = leave[top - size // 2] + min(reach[size // 2], 3 - 2 * n if n > 1 else np.inf)
                best = int(cuts.argmin())
                if cuts[best] + self.cut_price < whole[level]:
                    level = top - size + 1 + best
                    head, piece = self.cut(piece, top - level)
                    full.append([*self._take(level), head])
                    size -= top - level
                    continue
            window = [*self._take(level), piece]
            if level + size == top:
                full.append(window)
            else:
                self.windows[level + size].append(window)
                self._recount(level + size)
            return full

    def drain(self) -> list:
        """Every open window's pieces, fullest first; none stays open."""
        found = [w for level in range(self.capacity, 0, -1) for w in self.windows[level]]
        self.__init__(self.capacity, self.cut, self.cut_price)
        return found


def _cut(piece, n: int):
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def _packer(path: str, end_id: int, capacity: int, cut_price: float):
    def pack(batches):
        base = TaskContext.get().partitionId() * SEQUENCES
        coder, levels, end = encoder(path), SumOfSquares(capacity, _cut, cut_price), np.uint32(end_id).astype("<u4").tobytes()
        made = 0
        rows: list[tuple] = []

        def close(windows):
            nonlocal made
            for window in windows:
                at = 0
                for doc, start, ids, total in window:
                    rows.append((doc, start, len(ids) // 4, ids, total, base + made, at))
                    at += len(ids) // 4
                made += 1

        def out():
            found = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            rows.clear()
            return found

        for batch in batches:
            for some in slices(batch, 1, 1024, 2 << 20):
                for doc, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1)), strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % capacity
                    close([(doc, start, ids[4 * start : 4 * (start + capacity)], total)] for start in range(0, whole, capacity))
                    if whole < total:
                        close(levels.place(total - whole, (doc, whole, ids[4 * whole :], total)))
                if len(rows) >= 1000:
                    yield out()
        last = levels.drain()
        levels.cut_price = 0
        for window in last:
            for piece in window:
                close(levels.place(len(piece[2]) // 4, piece))
        close(levels.drain())
        if rows:
            yield out()

    return pack


def pack_sequences(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", cut_price: float = CUT_PRICE) -> DataFrame:
    """Pieces of documents and where they lie: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian uint32 bytes.  Null and empty texts are the end id
    alone; a null id stays null; repeated rows are packed as often as they come;
    a table without rows gives none; other columns are ignored.  Texts of any
    length are tokenised whole, and memory holds the open windows and one batch.
    """
    set_up(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidy(_packer(tokenizer, end_id, capacity, cut_price), lambda: encoder(tokenizer).forget()), PIECES)
