"""Pack token sequences of documents into fixed windows: sum-of-squares online packing.

Each task keeps a level array: how many of its open windows are filled up to each level. A
piece goes where the sum of squared level counts grows least, which keeps levels from piling
up, so that later pieces find a fitting gap. Whole windows are cut from long documents first.

Open windows are bounded: at ``max_open`` of them, and at the end of a task, they are drained.
Draining joins their pieces, cuts full windows, and leaves a rest that is cut into powers of
two, which need no padding. Memory is ``max_open`` windows plus one document.

No shuffle: a task packs the documents of its own input partition, so a hot source or a group
of copies changes nothing. A task run again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches
from .tokenizer import load_spec, worker_bpe

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)
NAMES = [c.split()[0] for c in PIECES.split(", ")]
#: Sequence numbers left to each task.
TASK_SHIFT = 36


class Packer:
    """Level array and open windows of one task. A piece is (document, start, ids as u16 bytes)."""

    def __init__(self, width: int, first_id: int, max_open: int):
        self.width, self.max_open, self.next_id = width, max_open, first_id
        self.levels = np.zeros(width + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(width + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc: tuple, ids: bytes) -> None:
        """``doc``: id and number of tokens."""
        size, whole = len(ids) // 2, len(ids) // 2 // self.width * self.width
        for at in range(0, whole, self.width):
            self.close([(doc, at, ids[2 * at : 2 * (at + self.width)])])
        if size > whole:
            self.place((doc, whole, ids[2 * whole :]))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 2
        reach = self.width - size
        # Growth of the sum of squares when a window moves from level h to h + size.
        n = self.levels
        growth = 2 * (n[size:] - n[: reach + 1]) + 2
        growth[reach] = 1 - 2 * n[reach]  # a full window leaves the array
        growth[n[: reach + 1] == 0] = np.iinfo(np.int64).max
        if size < self.width:
            growth[0] = 2 * n[size] + 1  # a new window
        # On a tie the fullest window.
        level = reach - int(np.argmin(growth[::-1]))
        window = []
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + size == self.width:
            self.close(window)
            return
        self.open[level + size].append(window)
        self.levels[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.drain()

    def close(self, window: list) -> None:
        offset, length = 0, sum(len(p[2]) for p in window) // 2
        for (doc_id, tokens), start, ids in window:
            crc = zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids) // 2, crc, tokens, self.next_id, offset, length))
            offset += len(ids) // 2
        self.next_id += 1

    def drain(self) -> None:
        """Close every open window without padding: whole windows, then powers of two."""
        queue = [p for level in reversed(self.open) for window in level for p in window]
        total = sum(len(p[2]) for p in queue) // 2
        sizes = [self.width] * (total // self.width)
        rest = total % self.width
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        queue.reverse()
        for size in sizes:
            window, room = [], size
            while room:
                doc, start, ids = queue.pop()
                if len(ids) // 2 > room:
                    queue.append((doc, start + room, ids[2 * room :]))
                    ids = ids[: 2 * room]
                window.append((doc, start, ids))
                room -= len(ids) // 2
            self.close(window)
        self.levels[:] = 0
        self.open = [[] for _ in range(self.width + 1)]
        self.n_open = 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in NAMES]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def _pieces(spec: str, width: int, end: bytes, max_open: int):
    """Pieces of one task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec)
        packer = Packer(width, TaskContext.get().partitionId() << TASK_SHIFT, max_open)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(text.as_py() or "") + end
                packer.add((doc_id, len(ids) // 2), ids)
                if len(packer.rows) >= 8192:
                    yield packer.take()
        packer.drain()
        yield packer.take()
        del packer
        give_back()

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, width: int = 1024, end_id: int = 0, max_open: int = 512,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: where its ids stand in the document and in the packed sequence.

    A null or empty text is its end id alone. Repeated rows are packed as often as they occur;
    a null ``doc_id`` stays null. Other columns are not read. An empty table gives no rows.
    ``sequence_length`` is the padded length: every sequence here is full or a power of two.
    """
    if width & (width - 1):
        raise ValueError("the width must be a power of two")
    small_batches(docs.sparkSession)
    run = _pieces(load_spec(tokenizer_path), width, np.array([end_id], "<u2").tobytes(), max_open)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)
