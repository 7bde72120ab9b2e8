"""Token-id files of patched frame-of-reference blocks, written and read by Spark.

File format (all little-endian). A chunk holds whole documents:

    magic "PFR1", u32 documents, u64 tokens, u32 blocks, u32 values in a block
    documents: i64 doc_id each, u8 null flag each, u32 tokens each
    blocks: u64 start of each block in the payload (the index), u32 minimum each, u8 width each, u16 exceptions each
    payload: per block the packed low bits of (value - minimum), then the exceptions: u16 places, u32 values above the width

The width of a block is the bits of the ``percentile`` of its differences; larger ones are the
exceptions. Chunks are rows (file_no, chunk, payload) of a table in the shared folder: Spark's
commit protocol makes the write safe when executors are lost, and any store that Spark reads will
do. ``file_no`` is the number of the range partition, so (file_no, chunk) is the order of doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, texts
from .tokens import encoder

MAGIC, HEAD = b"PFR1", "<4sIQII"
CHUNK = pa.schema([("file_no", pa.int32()), ("chunk", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
CHUNK_DDL = "file_no int, chunk int, n_docs long, n_tokens long, payload binary"
READ = pa.schema([("file_no", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ_DDL = "file_no int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long"


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def encode_blocks(ids: np.ndarray, size: int = 256, percentile: float = 90.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Minimum, width and number of exceptions of each block, and the bytes of each block."""
    n = -(-len(ids) // size)
    low, width, more, parts = np.zeros(n, np.uint32), np.zeros(n, np.uint8), np.zeros(n, np.uint16), [b""] * n
    for first in range(0, n, 2048):  # bounds the memory of the bit arrays
        part = ids[first * size : (first + 2048) * size]
        m = -(-len(part) // size)
        block = np.resize(part, m * size)
        block[len(part) :] = part[-1]  # the last block is filled with its last value
        block = block.reshape(m, size).astype(np.uint32)
        least = block.min(axis=1)
        delta = block - least[:, None]
        rank = min(size - 1, int(np.ceil(size * percentile / 100)) - 1)
        bits = widths(np.partition(delta, rank, axis=1)[:, rank])
        over = delta >> bits[:, None].astype(np.uint32)
        low[first : first + m], width[first : first + m], more[first : first + m] = least, bits, (over > 0).sum(axis=1)
        for w in np.unique(bits):
            of = np.flatnonzero(bits == w)
            low_bits = np.unpackbits(delta[of].astype("<u4").view(np.uint8).reshape(len(of), size, 4), axis=2, bitorder="little", count=int(w))
            packed = np.packbits(low_bits.reshape(len(of), -1), axis=1, bitorder="little")
            for k, row in zip(of, packed, strict=True):
                at = np.flatnonzero(over[k])
                parts[first + k] = row.tobytes() + at.astype("<u2").tobytes() + over[k][at].astype("<u4").tobytes()
    return low, width, more, parts


def write_chunk(keys: list, lengths: list[int], ids: np.ndarray, size: int = 256, percentile: float = 90.0) -> bytes:
    low, width, more, parts = encode_blocks(ids, size, percentile)
    starts = np.cumsum([0, *map(len, parts)])[:-1] if parts else np.zeros(0)
    return b"".join((
        struct.pack(HEAD, MAGIC, len(keys), len(ids), len(parts), size),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], "u1").tobytes(), np.array(lengths, "<u4").tobytes(),
        starts.astype("<u8").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), more.astype("<u2").tobytes(), *parts,
    ))


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits from rows of packed bytes: eight values lie in every ``width`` bytes."""
    groups = packed.reshape(len(packed), -1, width).astype(np.uint64)
    out = np.empty((*groups.shape[:2], 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        value = groups[:, :, first]
        for b in range(first + 1, (j * width + width - 1) // 8 + 1):
            value = value | groups[:, :, b] << np.uint64(8 * (b - first))
        out[:, :, j] = value >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out.reshape(len(packed), -1)


def read_chunk(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a chunk."""
    magic, docs, tokens, blocks, size = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = struct.calcsize(HEAD)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    keys, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    starts, low, width, more = take("<u8", blocks), take("<u4", blocks), take("u1", blocks), take("<u2", blocks)
    out = np.zeros((blocks, size), np.uint32)
    raw = np.frombuffer(data, np.uint8, offset=at)
    for w in np.unique(width):
        nbytes = size * int(w) // 8
        every = np.flatnonzero(width == w)
        for of in (every[i : i + 2048] for i in range(0, len(every), 2048)):
            if w:
                out[of] = unpack(raw[starts[of].astype(np.int64)[:, None] + np.arange(nbytes)], int(w))
            for k in of[more[of] > 0]:
                p = at + int(starts[k]) + nbytes
                n = int(more[k])
                out[k, np.frombuffer(data, "<u2", n, p)] |= np.frombuffer(data, "<u4", n, p + 2 * n) << np.uint32(w)
    ids = (out + low[:, None]).reshape(-1)[:tokens].astype("<u4")
    return [None if x else int(k) for k, x in zip(keys, null, strict=True)], lengths, ids


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, chunk_tokens: int = 1 << 20, percentile: float = 90.0) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending ``doc_id`` order to ``path``.

    One range shuffle of the texts by doc_id; rows of one doc_id keep the order of their texts.
    Compressed texts are smaller than their ids, so it is the texts that move.
    A chunk closes at the first document end past ``chunk_tokens``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no, chunk, end = TaskContext.get().partitionId(), 0, np.asarray([end_id], "<u4").tobytes()
        keys: list = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal chunk, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[file_no], [chunk], [len(keys)], [len(ids)], [write_chunk(keys, [len(p) // 4 for p in parts], ids, percentile=percentile)]]
            keys.clear(), parts.clear()
            chunk, held = chunk + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, CHUNK, strict=True)], schema=CHUNK)

        for part in slices(batches, 1024):
            for k, ids in zip(part.column(0).to_pylist(), encoder(vocabulary).encode(part.column(1).to_pylist()), strict=True):
                keys.append(k)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= chunk_tokens:
                    yield close()
        if keys:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, CHUNK_DDL).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document of the files at ``path``: ``doc_id, start, n_tokens, ids_crc32, file_no, chunk``.

    ``start`` counts the ids of all documents before it. The sums run over files and over the
    chunks of a file, never over documents; those over files are in one task, which gets a row per file.
    """
    files = spark.read.schema(CHUNK_DDL).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            keys, lengths, ids = read_chunk(row.column(2)[0].as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * int(a) : 4 * int(b)]) for a, b in zip(starts, ends, strict=True)]
            n = len(keys)
            columns = [[row.column(0)[0].as_py()] * n, [row.column(1)[0].as_py()] * n, keys, starts, lengths.astype(np.int64), crc]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, READ, strict=True)], schema=READ)

    docs = files.select("file_no", "chunk", "payload").mapInArrow(run, READ_DDL)
    by_file = files.groupBy("file_no").agg(F.sum("n_tokens").alias("of_file"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    first = by_file.select("file_no", F.coalesce(F.sum("of_file").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = files.select("file_no", "chunk", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("chunk_start"))
    starts = chunks.join(first, "file_no").select("file_no", "chunk", (F.col("file_start") + F.col("chunk_start")).alias("base"))
    joined = docs.join(starts, ["file_no", "chunk"])
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file_no", "chunk")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the token files and read them back.

    A null or empty text is the end id alone. Null keys come first; an empty table gives no rows;
    repeated rows are written each; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(spark, path)
