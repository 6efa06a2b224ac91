"""Vector bin packing of token sequences.

``pack`` turns examples into sequences that keep three limits at once: tokens,
segments (pieces) and loss-bearing tokens. Each task packs its own rows: whole
pieces of the full token limit go out at once, the rest of each example waits
in a bounded buffer, and a sequence is filled by the dot-product heuristic:
again and again the waiting piece whose limit-scaled vector (tokens, segments,
loss tokens) has the largest dot product with the sequence's free vector is
placed, as long as one fits. What room is left is filled by cutting a waiting
piece, so that only the last sequences of a task need padding.

No shuffle takes place and nothing but the buffer is held, so memory does not
grow with the input. Sequence ids hold the partition in the upper bits. A lost
task is done again as a whole and its output is replaced as a whole.

Edge cases: a null or empty text is one piece with the end id alone; null ids
and repeated rows are packed as any other row; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.tokens import Encoder
from admitflow.llm.wordhash import row_slices, text_buffers

END_ID = 0  # fixed value: the id that ends each example
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, n_loss long, "
          "sequence_id long, offset long")


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence. ``waiting`` pieces are chosen from at a time; a
    gap of fewer than ``least_cut`` tokens is left as padding."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024
    waiting: int = 512
    least_cut: int = 8


class Packer:
    """Packs pieces of one task; ``out`` gets (piece, sequence, offset)."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.pieces: list[tuple] = []   # (doc, ids, prompt, start, stop)
        self.size = np.zeros((0, 3))
        self.out: list[tuple] = []

    def loss(self, prompt: int, start: int, stop: int) -> int:
        """Loss-bearing ids: all but the prompt's and the first of a piece."""
        return max(0, stop - max(prompt, start + 1))

    def reach(self, prompt: int, start: int, stop: int, tokens: int, loss: int) -> int:
        """Where a piece from ``start`` ends at the latest under the room left."""
        return min(stop, start + tokens, max(prompt, start + 1) + loss)

    def emit(self, doc, ids, prompt, start, stop, offset) -> None:
        self.out.append((doc, start, ids[start:stop], len(ids), self.loss(prompt, start, stop), self.sequence, offset))

    def add(self, doc, ids: np.ndarray, prompt: int = 0) -> None:
        limits, start = self.limits, 0
        while len(ids) - start >= limits.tokens or self.loss(prompt, start, len(ids)) >= limits.loss_tokens:
            stop = self.reach(prompt, start, len(ids), limits.tokens, limits.loss_tokens)
            self.emit(doc, ids, prompt, start, stop, 0)
            self.sequence += 1
            start = stop
        if start < len(ids):
            self._wait((doc, ids, prompt, start, len(ids)))
        while len(self.pieces) > limits.waiting:
            self._fill()

    def _wait(self, piece: tuple) -> None:
        doc, ids, prompt, start, stop = piece
        self.pieces.append(piece)
        self.size = np.vstack([self.size, [stop - start, 1, self.loss(prompt, start, stop)]])

    def _fill(self) -> None:
        """Fills one sequence from the waiting pieces."""
        free, vectors = self.scale.copy(), self.size / self.scale
        open_ = np.ones(len(self.pieces), dtype=bool)
        offset = 0
        while True:
            fits = open_ & (self.size <= free).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, vectors @ (free / self.scale), -1.0)))
            self.emit(*self.pieces[best], offset)
            offset += int(self.size[best, 0])
            free -= self.size[best]
            open_[best] = False
        rest = None
        if free[0] >= self.limits.least_cut and free[1] >= 1 and open_.any():
            cut = int(np.argmax(np.where(open_, self.size[:, 0], -1)))
            doc, ids, prompt, start, stop = self.pieces[cut]
            until = self.reach(prompt, start, stop, int(free[0]), int(free[2]))
            if until > start:
                self.emit(doc, ids, prompt, start, until, offset)
                open_[cut], rest = False, (doc, ids, prompt, until, stop)
        self.pieces = [p for p, o in zip(self.pieces, open_, strict=True) if o]
        self.size = self.size[open_]
        if rest is not None and rest[3] < rest[4]:
            self._wait(rest)
        self.sequence += 1

    def finish(self) -> None:
        while self.pieces:
            self._fill()


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    long = lambda x: pa.array(x, pa.int64())
    return pa.record_batch({
        "doc_id": long(columns[0]), "start": long(columns[1]), "length": long([len(x) for x in columns[2]]),
        "ids": pa.array([x.astype("<u4").tobytes() for x in columns[2]], pa.binary()),
        "doc_tokens": long(columns[3]), "n_loss": long(columns[4]), "sequence_id": long(columns[5]),
        "offset": long(columns[6])})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
         limits: Limits = Limits()) -> DataFrame:
    """One row per piece (``PIECES``); ``ids`` are unsigned little-endian 32-bit.

    ``prompt_col``: a text in front of ``text_col`` whose ids bear no loss, for
    instruction data. Every example ends with ``END_ID``.
    """
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    if prompt_col:
        columns.append(F.col(prompt_col).cast("string").alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.default()
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        for batch in batches:
            texts = [text_buffers(batch.column(k)) for k in range(1, batch.num_columns)]
            doc_ids = batch.column(0).to_pylist()
            for lo, hi in row_slices(texts[0][1], 4 << 20):
                encoded = [encoder.encode(d[o[lo]:o[hi]], o[lo:hi + 1] - o[lo]) for d, o in texts]
                ids, bounds = encoded[0]
                for r in range(hi - lo):
                    own = [ids[bounds[r]:bounds[r + 1]], np.array([END_ID], np.uint32)]
                    before = [i[b[r]:b[r + 1]] for i, b in encoded[1:]]
                    packer.add(doc_ids[lo + r], np.concatenate(before + own), sum(map(len, before)))
                    if len(packer.out) >= 2048:
                        yield _batch(packer.out)
                        packer.out = []
        packer.finish()
        if packer.out:
            yield _batch(packer.out)

    return docs.select(*columns).mapInArrow(run, PIECES)
