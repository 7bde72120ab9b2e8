"""Vector bin packing of examples into fixed-length training sequences.

Every example has a vector of sizes: tokens, segments (one per piece) and loss-bearing tokens. A
sequence has a limit for each. The open sequence takes, from a bounded pool, the example that fits
and whose vector has the largest dot product with what is left of the limits, each scaled by its
limit. When nothing in the pool fits, the longest example is cut to fill the rest.

The job is one pass over the input without a shuffle: each task packs its own rows, so an executor
that is lost costs only its tasks. Sequence ids carry the number of the partition in their upper
bits. Each task leaves at most a few sequences short, whatever the size of its share.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts
from .tokens import encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs examples under ``limits`` = (tokens, segments, loss tokens); yields rows as sequences close.

    An example is (id, ids as bytes of 4 each, one loss flag per token or None for all). Whole
    sequences are cut from long examples first. The pool holds ``pool`` examples; it bounds memory,
    and every example in it is placed in the end.
    """

    def __init__(self, limits: tuple[int, int, int], pool: int, first_sequence: int, smallest_cut: int = 16) -> None:
        self.limits = np.array(limits, float)
        self.pool, self.smallest_cut = pool, smallest_cut
        self.next, self.sequence = first_sequence + 1, first_sequence
        self.items: list[tuple] = []  # (id, ids, loss flags, start, tokens, all tokens)
        self.sizes = np.zeros((0, 3))
        self.free = self.limits.copy()
        self.offset = 0

    def _loss(self, flags: np.ndarray | None, start: int, length: int) -> int:
        return length if flags is None else int(flags[start : start + length].sum())

    def _row(self, item: tuple, length: int) -> tuple:
        key, ids, flags, start, _, total = item
        loss = self._loss(flags, start, length)
        row = (key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, self.sequence, self.offset, loss)
        self.offset += length
        self.free -= (length, 1, loss)
        return row

    def _close(self) -> None:
        if self.offset:
            self.next, self.sequence = self.next + 1, self.next
            self.offset, self.free = 0, self.limits.copy()

    def _fits(self, item: tuple) -> int:
        """The most tokens at the start of what is left of an example that the open sequence can take."""
        _, _, flags, start, left, _ = item
        most = int(min(left, self.free[0])) if self.free[1] >= 1 else 0
        if flags is None:
            return int(min(most, self.free[2]))
        return int(np.searchsorted(np.cumsum(flags[start : start + most]), self.free[2], side="right"))

    def add(self, key, ids: bytes, flags: np.ndarray | None = None) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        whole = int(self.limits[0])
        if flags is None and self.limits[2] >= whole:
            while total - start > whole:
                yield key, start, whole, zlib.crc32(ids[4 * start : 4 * (start + whole)]), total, self.next, 0, whole
                self.next += 1
                start += whole
        self.items.append((key, ids, flags, start, total - start, total))
        if len(self.items) >= 2 * self.pool:
            yield from self._place(self.pool)

    def _place(self, keep: int) -> Iterator[tuple]:
        """Place examples until ``keep`` of them remain in the pool."""
        items = self.items
        sizes = np.array([(i[4], 1, self._loss(i[2], i[3], i[4])) for i in items], float).reshape(-1, 3)
        here = np.ones(len(items), bool)
        left = len(items)
        weight = 1 / self.limits**2
        while left > keep:
            fits = here & (sizes <= self.free).all(axis=1)
            if fits.any():
                at = int(np.where(fits, sizes @ (self.free * weight), -1.0).argmax())
                yield self._row(items[at], items[at][4])
                here[at] = False
                left -= 1
            else:
                at = int(np.where(here, sizes[:, 0], -1).argmax())
                key, ids, flags, start, tokens, total = items[at]
                n = self._fits(items[at])
                if n and (n >= self.smallest_cut or not self.offset or n == self.free[0]):
                    yield self._row(items[at], n)
                    items[at] = (key, ids, flags, start + n, tokens - n, total)
                    sizes[at] = tokens - n, 1, self._loss(flags, start + n, tokens - n)
                else:
                    self._close()
            if self.free[0] < 1 or self.free[1] < 1:
                self._close()
        self.items = [x for x, y in zip(items, here, strict=True) if y]

    def finish(self) -> Iterator[tuple]:
        yield from self._place(0)
        self._close()


def packed(df: DataFrame, ids_of: Callable[[pa.RecordBatch], Iterator[tuple]], limits: tuple[int, int, int], pool: int = 512) -> DataFrame:
    """Rows of ``df`` packed per partition; ``ids_of`` turns a batch into examples (id, ids, loss flags)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(limits, pool, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in PIECES]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

        for part in slices(batches, 512):
            for example in ids_of(part):
                rows.extend(packer.add(*example))
            if len(rows) >= 4096:
                yield batch()
        rows.extend(packer.finish())
        yield batch()

    return df.mapInArrow(run, PIECES_DDL)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, tokens: int = 2048, segments: int | None = None, loss_tokens: int | None = None, key: str = "doc_id", text: str = "text", words: int = 100_000) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``tokens`` tokens; every token bears loss.

    Without a limit of ``segments`` a sequence may hold as many pieces as tokens, so short texts fill it too.
    Workers remember the ids of up to twice ``words`` words, about 200 bytes each.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens``. A null or empty text is one token, the end id. Null keys stay null; repeated
    rows are packed each on its own; an empty table gives no rows; other columns are not read.
    """

    def ids_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        end = np.asarray([end_id], "<u4").tobytes()
        for k, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary, words).encode(batch.column(1).to_pylist(), 1 << 21), strict=True):
            yield k, ids + end, None

    return packed(texts(docs, key, text).withColumnRenamed(key, "doc_id"), ids_of, (tokens, segments or tokens, loss_tokens or tokens))


def pack_conversations(turns: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, limits: tuple[int, int, int] = (2048, 64, 1024), loss_role: str = "assistant") -> DataFrame:
    """Instruction data: one example per turn of ``(conv_id, turn, role, text)``; tokens of ``loss_role`` bear loss.

    ``doc_id`` of the result is ``conv_id``. A null or empty text is one token, the end id; a null role bears no
    loss. A turn over a limit is cut into pieces; repeated rows are packed each on its own; an empty table gives no
    rows; other columns are not read.
    """
    from pyspark.sql import functions as F

    rows = turns.select(F.col("conv_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"))

    def ids_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        end = np.asarray([end_id], "<u4").tobytes()
        for k, ids, loss in zip(batch.column(0).to_pylist(), encoder(vocabulary, 100_000).encode(batch.column(1).to_pylist(), 1 << 21), batch.column(2).to_pylist(), strict=True):
            yield k, ids + end, np.full(len(ids) // 4 + 1, loss)

    return packed(rows, ids_of, limits)
