"""Sum-of-squares packing of token sequences.

Each task packs the documents it reads, in order. A document's ids fill whole sequences first; what
is left goes to the fill level that makes the sum of squared counts of partly filled sequences
smallest (a new sequence is level 0), with the counts in an array by level. At the end of a task the
partly filled sequences are strung together and cut anew, so that at most one per task stays partly
filled; its ids are then cut into powers of two, which need no padding.

Null texts are empty documents: their only id is the end id. Repeated rows are packed once each.
An empty table gives an empty result. Other columns do not pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.pieces import Encoded, model, runs

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Packer:
    """Sequences under construction; holds the pieces of partly filled ones only."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level: lists of pieces
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        """A finished sequence; a piece is [doc_id, start, ids, doc_tokens]."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        w, total = self.window, len(ids)
        whole = total // w * w
        for at in range(0, whole, w):
            self._emit([[doc, at, ids[at : at + w], total]])
        r = total - whole
        if not r:
            return
        # Change of the sum of squares when an open sequence of level h becomes one of level h + r; full ones do not count.
        n, room = self.counts, w - r
        change = 2 * (n[r : w + 1] - n[: room + 1]) + 2
        change[room] = 1 - 2 * n[room]
        change[0] = 2 * n[r] + 1
        change[1:][n[1 : room + 1] == 0] = np.iinfo(np.int64).max
        h = room - int(np.argmin(change[::-1]))  # of equal changes the fullest
        pieces = self.open[h].pop() if h else []
        pieces.append([doc, whole, ids[whole:], total])
        if h:
            n[h] -= 1
        if h + r == w:
            self._emit(pieces)
        else:
            self.open[h + r].append(pieces)
            n[h + r] += 1

    def finish(self) -> None:
        """Strings the partly filled sequences together, fullest first."""
        row, room = [], self.window
        for level in reversed(self.open):
            for pieces in level:
                for doc, start, ids, total in pieces:
                    while len(ids):
                        head, ids = ids[:room], ids[room:]
                        row.append([doc, start, head, total])
                        start, room = start + len(head), room - len(head)
                        if not room:
                            self._emit(row)
                            row, room = [], self.window
        left = self.window - room
        while left:
            size = 1 << (left.bit_length() - 1)
            cut, need = [], size
            while need:
                doc, start, ids, total = row[0]
                cut.append([doc, start, ids[:need], total])
                used = len(cut[-1][2])
                need -= used
                if used == len(ids):
                    row.pop(0)
                else:
                    row[0] = [doc, start + used, ids[used:], total]
            self._emit(cut)
            left -= size
        self.open = [[] for _ in range(self.window)]
        self.counts[:] = 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[] for _ in _NAMES]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence: where it starts in the document's ids and in the sequence.

    A task's sequences are numbered from (its partition << 36), so ids are distinct, also after a retry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, packer = model(path), Packer(window, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            begin, names = 0, b.column("doc_id").to_pylist()
            for part in runs(b.column("text")):
                texts = Encoded(m, part)
                for i in range(len(part)):
                    packer.add(names[begin + i], np.concatenate([texts.ids_of(i), end]).astype("<u4", copy=False))
                begin += len(part)
                yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
