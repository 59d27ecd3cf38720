"""Bounded-space online packing of documents into fixed-length sequences.

Each task keeps a fixed number of open windows. A piece goes to the window it leaves least room in (best fit).
When none has room, the fullest window is closed: a small gap is left as padding, a larger one is filled with
the head of the piece. What stays open at a task's end is packed again by ever fewer tasks, and the last ones
lay their leftovers end to end, so that at most one sequence per such task is short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokenizing import default_path, encoded

#: Tokens of a sequence; open windows per task; a gap of fewer tokens is padded rather than filled with a cut.
SEQUENCE, OPEN, SMALL_GAP = 2048, 32, 16
#: Leftover tokens that a task of a later round packs, and the rounds of best fit before leftovers are laid end to end.
LEFTOVER_TOKENS, ROUNDS = 2_000_000, 2

_SCHEMA = "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, row_id long, ids binary, open boolean"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("row_id", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])


class _Windows:
    """Open windows of one task; closed and leftover pieces pile up in `out`."""

    def __init__(self, first_id: int, size: int, most: int, small: int, width: int):
        self.next, self.size, self.most, self.small, self.width = first_id, size, most, small, width
        self.windows: list[list] = []  # [fill, pieces]
        self.room = np.zeros(0, np.int64)
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple], still_open: bool = False) -> None:
        at = 0
        for doc, start, n, total, row, ids in pieces:
            self.out.append((self.next, at, doc, start, n, total, row, ids, still_open))
            at += n
        self.next += 1

    def add(self, doc, start: int, n: int, total: int, row: int, ids: bytes) -> None:
        w = self.width
        while n >= self.size:
            self._close([(doc, start, self.size, total, row, ids[: self.size * w])])
            start, n, ids = start + self.size, n - self.size, ids[self.size * w :]
        while n:
            fits = np.where(self.room >= n, self.room, self.size + 1)
            if len(fits) and fits.min() <= self.size:
                k = int(fits.argmin())
            elif len(self.windows) < self.most:
                self.windows.append([])
                self.room = np.append(self.room, self.size)
                k = len(self.windows) - 1
            else:  # none fits: the fullest goes
                k = int(self.room.argmin())
                gap = int(self.room[k])
                if gap >= self.small:
                    self.windows[k].append((doc, start, gap, total, row, ids[: gap * w]))
                    start, n, ids = start + gap, n - gap, ids[gap * w :]
                self._close(self.windows[k])
                self.windows[k], self.room[k] = [], self.size
                continue
            self.windows[k].append((doc, start, n, total, row, ids))
            self.room[k] -= n
            if not self.room[k]:
                self._close(self.windows.pop(k))
                self.room = np.delete(self.room, k)
            return

    def leave(self, last: bool) -> None:
        """The open windows: kept open for the next round, or laid end to end with cuts."""
        if not last:
            for pieces in self.windows:
                self._close(pieces, True)
        else:
            held, fill = [], 0
            for doc, start, n, total, row, ids in (x for pieces in sorted(self.windows, key=lambda p: -sum(x[2] for x in p)) for x in pieces):
                while n:
                    take = min(n, self.size - fill)
                    held.append((doc, start, take, total, row, ids[: take * self.width]))
                    start, n, ids, fill = start + take, n - take, ids[take * self.width :], fill + take
                    if fill == self.size:
                        self._close(held)
                        held, fill = [], 0
            if held:
                self._close(held)
        self.windows, self.room = [], np.zeros(0, np.int64)

    def batch(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 9, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, sequence: int = SEQUENCE, open_windows: int = OPEN, small_gap: int = SMALL_GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, offset, doc_id, start, length, doc_tokens, row_id, ids): where each piece of each document lies.

    ids are little-endian unsigned 32-bit integers. Null and empty texts are packed as end_id alone; a null
    doc_id stays null; repeated rows are packed each (row_id tells them apart); other columns are ignored; an empty table
    gives no rows. A sequence_id is unique, with the packing task in its upper bits.
    """
    tokenizer = tokenizer or default_path()
    width = 4

    def first_round(batches):
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        windows = _Windows(task << 32, sequence, open_windows, small_gap, width)
        for rest, ids, at in encoded(batches, tokenizer, end_id):
            data = ids.astype("<u4").tobytes()
            for k, key in enumerate(rest.column(0).to_pylist()):
                n = int(at[k + 1] - at[k])
                windows.add(key, 0, n, n, (task << 32) + row, data[at[k] * width : at[k + 1] * width])
                row += 1
            yield windows.batch()
        windows.leave(False)
        yield windows.batch()

    def later_round(level: int, last: bool):
        def run(batches):
            from pyspark import TaskContext

            windows = _Windows((level << 58) + (TaskContext.get().partitionId() << 32), sequence, open_windows, small_gap, width)
            for batch in batches:
                for x in batch.to_pylist():
                    windows.add(x["doc_id"], x["start"], x["length"], x["doc_tokens"], x["row_id"], x["ids"])
                yield windows.batch()
            windows.leave(last)
            yield windows.batch()

        return run

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = written(picked.mapInArrow(first_round, _SCHEMA), "packed")
    tables = [done.where(~F.col("open"))]
    for level in range(1, ROUNDS + 1):
        left = done.where("open")
        n = left.agg(F.sum("length")).first()[0] or 0
        if not n:
            break
        tasks = max(1, -(-n // LEFTOVER_TOKENS))
        last = tasks == 1 or level == ROUNDS
        done = written(left.drop("sequence_id", "offset", "open").repartition(int(tasks)).mapInArrow(later_round(level, last), _SCHEMA), f"packed-{level}")
        tables.append(done.where(~F.col("open")))
        if last:
            break
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out.drop("open")
