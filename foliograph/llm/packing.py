"""Operator 7: harmonic packing of token ids into sequences.

A document is cut into whole sequences and a remainder. Class k holds lengths in (capacity/(k+1), capacity/k], and its
bins take exactly k pieces. A remainder that would leave more than ``capacity/64`` of such a bin empty is cut: its head
gets the exact length ``capacity // (k+1)`` of the next class, and the rest goes the same way. Every worker fills bins of
its own, with no exchange. What is left in open bins at the end of a task is joined and cut into full sequences and, for
the rest, sequences whose lengths are powers of two, which need no padding.

Defined results: null or empty text is the end id alone; repeated rows are packed like any others; an empty table makes no
rows; other columns are ignored. Sequence ids are unique; they are not gapless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import prepare, texts_of
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cuts(length: int, capacity: int = 1024) -> list[tuple[int, int]]:
    """(piece length, class) of a document's pieces, in order."""
    whole, rest = divmod(length, capacity)
    out = [(capacity, 1)] * whole
    while rest:
        k = capacity // rest
        if capacity - k * rest <= capacity // 64:
            out.append((rest, k))
            break
        size = capacity // (k + 1)
        out.append((size, k + 1))
        rest -= size
    return out


class Packer:
    """The open bins of one worker. A piece is (doc_id, start, ids, tokens of its document)."""

    def __init__(self, capacity: int = 1024, first_id: int = 0):
        self.capacity, self.next_id, self.open = capacity, first_id, {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        for size, k in cuts(len(ids), self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, at, ids[at : at + size], len(ids)))
            at += size
            if len(bin_) == k:
                self._emit(self.open.pop(k))

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), total, self.next_id, offset, ids.tobytes()))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Join what the open bins hold and cut it into full sequences and powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> b & 1]
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc_id, start, ids, n = left.pop()
                if len(ids) > size:
                    left.append((doc_id, start + size, ids[size:], n))
                    ids = ids[:size]
                size -= len(ids)
                pieces.append((doc_id, start, ids, n))
            self._emit(pieces)

    def taken(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if rows:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), with their ids as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)

    def run(batches):
        encode, packer = encoder(tokenizer).encode, Packer(capacity, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch.column(1)))):
                packer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype("<u4", copy=False))
            if (rows := packer.taken()) is not None:
                yield rows
        packer.finish()
        if (rows := packer.taken()) is not None:
            yield rows

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
