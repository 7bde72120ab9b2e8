"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` (100) bytes that covers it also starts earlier: in a document
with a smaller key, or before in the same one. Strings are judged on the input.

1. Candidates. Every window of ``length`` bytes has an anchor: of the 32-byte strings in it, the
   first with the smallest hash. Equal windows have equal anchors at equal places, so windows whose
   anchor hash stands at a single place of the corpus are unique. Counting anchor hashes, about one
   per 35 bytes, finds all windows that may repeat, and no more text is moved than theirs.
2. Pieces. Neighbouring candidate windows with one anchor are a piece of text (at most 168 bytes).
   Of equal pieces only the first needs a look; the others go as they are.
3. Shards. Pieces that share an anchor meet in one shard of bounded size. Each shard builds its
   suffix array by Larsson-Sadakane refinement and its common prefixes by Kasai's rule, both in
   numpy; suffixes with a common prefix of ``length`` bytes are equal windows, the first stays.
4. Merging. Pieces of an anchor that has too many for a shard are dealt over several shards. The
   windows that are first in their shard meet those of the other shards in an aggregation by
   128-bit digest, and the first of all stays. Binary search of each shard in every other one would
   do the same work once per pair of shards, which grows with the square of a hot anchor's pieces;
   the aggregation is linear and has no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, staged, texts

GRAM = 32
SEPARATOR = 0xFF  # never a byte of UTF-8
SPAN_DDL = "doc_id long, mark long, start long, stop long"
SPAN = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done, step = done + more, step * step
    return out


class Anchors:
    """Anchors of the windows of texts of up to ``most`` bytes."""

    def __init__(self, length: int, most: int = 1 << 20) -> None:
        self.length, self.most, self.span = length, most, length - GRAM + 1
        with np.errstate(over="ignore"):
            self.up = _powers(BASE, most + 1)
            self.down = _powers(pow(BASE, -1, 1 << 64), most + 1)

    def of(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the anchor of each window, hash of each 32-byte string); no windows in shorter texts."""
        n = len(text)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
            h = (sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        bits = np.uint64(20)
        low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)  # the first of the smallest: its place in the low bits
        step = 1
        while 2 * step <= self.span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if self.span > step:
            low = np.minimum(low[: len(low) - (self.span - step)], low[self.span - step :])
        return (low & np.uint64((1 << 20) - 1)).astype(np.int64), h

    def pieces(self, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per stretch of a text: (its start, first windows, last windows, anchor hashes) of its pieces."""
        for at in range(0, max(1, len(text) - self.length + 1), self.most - self.length + 1):
            part = np.frombuffer(text, np.uint8, min(self.most, len(text) - at), at)
            place, h = self.of(part)
            if len(place):
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                yield at, first, np.r_[first[1:], len(place)] - 1, h[place[first]].view(np.int64)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes, and the 8-byte words at each place.

    Larsson-Sadakane: after a first sort by 8 bytes, groups of equal suffixes are refined by the
    groups of the suffixes that begin where their sorted prefixes end; each round doubles that
    prefix, and sorted groups are left alone.
    """
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    word = np.zeros(n + 8, np.uint64)
    for j in range(8):
        word |= padded[j : j + n + 8].astype(np.uint64) << np.uint64(56 - 8 * j)
    order = np.argsort(word[:n])
    new = np.r_[True, word[order[1:]] != word[order[:-1]]]
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while True:
        single = new & np.r_[new[1:], True]
        at = np.flatnonzero(~single)
        if not len(at):
            break
        s = order[at]
        group, after = rank[s], rank[np.minimum(s + h, n)]
        by = np.argsort(group * (n + 1) + after)
        order[at] = s[by]
        group, after = group[by], after[by]
        new[at] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        h *= 2
    return order, word


def common_prefixes(word: np.ndarray, order: np.ndarray, most: int, lanes: int = 16384) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, by place, at most ``most``.

    Kasai's rule (for a whole sort): from one place to the next the common prefix shrinks by one at most. Many
    stretches of the text are walked side by side, each by that rule.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    step = -(-n // lanes)
    base = np.arange(0, n, step)
    h = np.zeros(len(base), np.int64)
    for j in range(step):
        i = base + j
        i = i[i < n]
        p = before[i]
        h = np.maximum(h[: len(i)] - 1, 0)
        h[p < 0] = 0
        go = np.flatnonzero((p >= 0) & (h < most))
        while len(go):
            a, b = np.minimum(i[go] + h[go], len(word) - 1), np.minimum(p[go] + h[go], len(word) - 1)
            differ = word[a] ^ word[b]
            same = np.full(len(go), 8)
            for k in range(8):
                same -= differ >= np.uint64(1 << (8 * k)) if k else differ > 0
            h[go] += same
            go = go[(same == 8) & (h[go] < most)]
        out[i] = np.minimum(h, most)
    return out


class Shard:
    """Pieces of a shard: bytes, (doc_id, mark, place in the document) of each."""

    def __init__(self, pieces: list[bytes], keys: np.ndarray, length: int) -> None:
        self.length, self.keys = length, keys
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        text = np.full(int((size + 1).sum()), SEPARATOR, np.uint8)
        at = np.repeat(self.begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        text[at] = np.frombuffer(b"".join(pieces), np.uint8)
        self.text = text
        order, word = suffix_array(text)
        prefix = common_prefixes(word, order, length)
        piece = np.repeat(np.arange(len(pieces)), size + 1)
        inside = np.arange(len(text)) - self.begin[piece]
        window = inside + length <= size[piece]
        equal = np.cumsum(prefix[order] < length)  # suffixes with one number begin alike
        keep = window[order]
        self.at, self.equal = order[keep], equal[keep]
        self.piece, self.inside = piece[self.at], inside[self.at]
        by = np.lexsort((keys[self.piece, 2] + self.inside, keys[self.piece, 1], keys[self.piece, 0], self.equal))
        first = np.ones(len(by), bool)
        first[1:] = self.equal[by][1:] != self.equal[by][:-1]
        self.first = np.zeros(len(by), bool)
        self.first[by] = first

    def spans(self) -> pa.RecordBatch:
        """What goes: stretches of windows that are not the first of their kind."""
        gone = np.flatnonzero(~self.first)
        piece, inside = self.piece[gone], self.inside[gone]
        by = np.lexsort((inside, piece))
        piece, inside = piece[by], inside[by]
        cut = np.r_[True, (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1] + 1)] if len(by) else np.zeros(0, bool)
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(by)] - 1 if len(first) else first
        key = self.keys[piece[first]]
        return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(key[:, 2] + inside[first]), pa.array(key[:, 2] + inside[last] + self.length)], schema=SPAN)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first windows in the order of the suffix array: their bytes, and (doc_id, mark, start) of each."""
        at = np.flatnonzero(self.first)
        rows = self.text[self.at[at][:, None] + np.arange(self.length)]
        key = self.keys[self.piece[at]].copy()
        key[:, 2] += self.inside[at]
        return rows, key


def _keys(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)


def _groups(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Rows (group, piece, doc_id, mark, start) sorted by group, as shards of whole groups of about ``most_bytes``."""
    pieces: list[bytes] = []
    keys: list[np.ndarray] = []
    groups = np.zeros(0, np.int64)
    held = 0
    for batch in batches:
        new = batch.column(1).to_pylist()
        pieces += new
        held += sum(map(len, new))
        keys.append(_keys(batch, 2))
        groups = np.concatenate([groups, batch.column(0).to_numpy(zero_copy_only=False)])
        if held >= most_bytes:
            cut = int(np.searchsorted(groups, groups[-1])) if (groups[1:] >= groups[:-1]).all() else int(np.flatnonzero(groups != groups[-1])[-1]) + 1
            if cut:
                key = np.concatenate(keys)
                yield pieces[:cut], key[:cut]
                pieces, keys, groups = pieces[cut:], [key[cut:]], groups[cut:]
                held = sum(map(len, pieces))
    if pieces:
        yield pieces, np.concatenate(keys)


def _shard_spans(length: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, keys in _groups(batches, most_bytes):
            yield Shard(pieces, keys, length).spans()

    return run


FIRST = pa.schema([*SPAN, ("high", pa.int64()), ("low", pa.int64())])
FIRST_DDL = SPAN_DDL + ", high long, low long"


def _shard_firsts(length: int, most_bytes: int):
    """Spans of each shard (without a digest), and its first windows with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, keys in _groups(batches, most_bytes):
            shard = Shard(pieces, keys, length)
            spans = shard.spans()
            none = pa.nulls(spans.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*spans.columns, none, none], schema=FIRST)
            rows, key = shard.firsts()
            for at in range(0, len(rows), 20_000):
                part = slice(at, at + 20_000)
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in rows[part]), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(key[part, 0]), pa.array(key[part, 1]), pa.array(key[part, 2]), pa.array(key[part, 2] + length), pa.array(d[:, 0]), pa.array(d[:, 1])], schema=FIRST)

    return run


def _ids(docs: DataFrame) -> DataFrame:
    """Whole texts with a key that is never null, and a mark that tells rows of one key apart."""
    mark = F.xxhash64("text")
    return texts(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), mark.alias("mark"), F.col("doc_id").isNull().alias("no_key"), "text")


def _anchor_rows(length: int):
    """Rows (doc, text) to (anchor, doc): each anchor hash of a document, twice if it stands there more than once."""
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for part in slices(batches, 256):
            found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                hashes = [h for _, _, _, h in anchors.pieces(text.encode("utf-8", "surrogatepass"))]
                if hashes:
                    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
                    values = np.concatenate([values, values[counts > 1]])
                    found.append(values), of.append(np.full(len(values), doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(of))], schema=schema)

    return run


PIECE = pa.schema([("anchor", pa.int64()), ("piece", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("high", pa.int64()), ("low", pa.int32())])  # high and low: 96 bits of a digest
PIECE_DDL = "anchor long, piece binary, doc_id long, mark long, start long, size int, high long, low int"


def _piece_rows(length: int):
    """Rows (doc_id, mark, text, candidate anchors) to pieces; a piece that stood before in its document is a span only (no piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        digest_of = xxhash.xxh3_128_digest
        for part in slices(batches, 64):
            columns: list[list] = [[] for _ in PIECE]
            anchor, piece, keys, marks, starts, sizes, highs, lows = columns
            for i, (key, mark, text) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                data = text.encode("utf-8", "surrogatepass")
                wanted = np.sort(part.column(3)[i].values.to_numpy(zero_copy_only=False))
                seen: set[bytes] = set()
                for at, first, last, h in anchors.pieces(data):
                    hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                    start, stop = (first[hit] + at).tolist(), (last[hit] + (at + length)).tolist()
                    found = [data[a:b] for a, b in zip(start, stop, strict=True)]
                    sizes += map(len, found)
                    digests = [digest_of(x) for x in found]
                    value = h[hit].tolist()
                    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                    high, low = both[:, 0].tolist(), (both[:, 1] >> 32).tolist()
                    if len(seen.union(digests)) < len(seen) + len(digests):
                        for j, d in enumerate(digests):
                            if d in seen:
                                value[j] = found[j] = high[j] = low[j] = None
                            seen.add(d)
                    else:
                        seen.update(digests)
                    anchor += value
                    piece += found
                    starts += start
                    highs += high
                    lows += low
                    keys += [key] * len(start)
                    marks += [mark] * len(start)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)

    return run


def _near(docs: DataFrame, keys: DataFrame, broadcast_rows: int) -> DataFrame:
    """``docs`` without the rows that have no match in ``keys(doc)``, if the keys are few enough to broadcast; else ``docs``."""
    if keys.count() <= broadcast_rows:
        return docs.join(F.broadcast(keys), "doc", "left_semi")
    return docs


def repeated_spans(docs: DataFrame, length: int = 100, shard_bytes: int = 2 << 20, hot_pieces: int = 8192, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``doc_id, mark, start, stop``: stretches of bytes to remove, not merged. ``docs`` is from :func:`_ids`."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "mark", "text", F.xxhash64("doc_id", "mark").alias("doc"))  # documents that share it share candidates
    found = staged(keyed.select("doc", "text").mapInArrow(_anchor_rows(length), "anchor long, doc long"), "anchors")
    repeated = found.groupBy("anchor").count().where("count >= 2").select("anchor")
    hits = staged(found.join(repeated, "anchor").groupBy("doc").agg(F.collect_list("anchor").alias("anchors")), "repeated-anchors")
    release(found)

    joined = _near(keyed, hits.select("doc"), broadcast_rows).join(hits, "doc").select("doc_id", "mark", "text", "anchors")
    pieces = staged(joined.mapInArrow(_piece_rows(length), PIECE_DDL), "pieces")
    release(hits)
    stop = (F.col("start") + F.col("size")).alias("stop")
    again = pieces.where("piece IS NULL").select("doc_id", "mark", "start", stop)
    whole = pieces.where("piece IS NOT NULL")
    first_of = whole.groupBy("anchor", "high", "low").agg(F.min(F.struct("doc_id", "mark", "start", "piece")).alias("at"))
    unique = staged(first_of.select("anchor", "high", "low", F.col("at.piece").alias("piece"), F.col("at.doc_id").alias("doc_id"), F.col("at.mark").alias("mark"), F.col("at.start").alias("start")), "unique-pieces")
    lead = unique.select("high", "low", F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("start").alias("s"))
    copies = whole.select("high", "low", "doc_id", "mark", "start", "size").join(lead, ["high", "low"]).where("doc_id <> d OR mark <> m OR start <> s").select("doc_id", "mark", "start", stop)
    again = staged(again.unionByName(copies), "copied-spans")
    release(pieces)

    sizes = unique.groupBy("anchor").count()
    hot = staged(sizes.where(F.col("count") > hot_pieces), "hot-anchors")
    n_hot = hot.count()
    rows = unique.select("anchor", "piece", "doc_id", "mark", "start")
    multiple = sizes.where("count > 1").select("anchor")  # the piece of an anchor with one kind of piece is the first of its kind
    small = F.broadcast(hot.select("anchor")) if n_hot <= 100_000 else hot.select("anchor")
    usual = rows.join(multiple, "anchor")
    if n_hot:
        usual = usual.join(small, "anchor", "left_anti")
    spans = usual.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_shard_spans(length, shard_bytes), SPAN_DDL)
    out = again.unionByName(spans)
    if n_hot:
        sized = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "anchor")
        block = F.xxhash64("anchor", F.pmod(F.xxhash64("piece"), F.ceil(F.col("count") / hot_pieces).cast("long")))
        dealt = sized.select(block.alias("group"), "piece", "doc_id", "mark", "start").repartition(n, "group").sortWithinPartitions("group")
        firsts = staged(dealt.mapInArrow(_shard_firsts(length, shard_bytes), FIRST_DDL), "first-windows")
        windows = firsts.where("high IS NOT NULL")
        least = windows.groupBy("high", "low").agg(F.min(F.struct("doc_id", "mark", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        later = windows.join(least, ["high", "low"]).where(F.struct("doc_id", "mark", "start") != F.col("least")).select("doc_id", "mark", "start", "stop")
        out = out.unionByName(firsts.where("high IS NULL").select("doc_id", "mark", "start", "stop")).unionByName(later)
    return out


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
KEPT_DDL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, starts, stops) without their spans."""
    for part in slices(batches, 128):
        out: dict = {f.name: [] for f in KEPT}
        for i, (key, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            start, stop = (part.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, stop, -1)
            gone = np.cumsum(edge)[:-1] > 0
            turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            out["doc_id"].append(key)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append([{"start": int(a), "stop": int(b)} for a, b in turn.reshape(-1, 2)])
            out["kept"].append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=KEPT)


def suffix_dedup(docs: DataFrame, length: int = 100, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row: maximal removed stretches, and the bytes that stay.

    A null text is empty. A null key comes before all others. Rows that share a key are told apart
    by a hash of their text and follow in its order; rows that repeat key and text count as one
    document and get the same result each. Texts shorter than ``length`` bytes stay as they are; an
    empty table gives no rows; other columns are not read.
    """
    ids = _ids(docs)
    spans = repeated_spans(ids, length, broadcast_rows=broadcast_rows, **options)
    by_doc = staged(spans.groupBy("doc_id", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "spans")
    few = by_doc.count() <= broadcast_rows
    key = F.when(F.col("no_key"), F.lit(None)).otherwise(F.col("doc_id")).cast("long").alias("doc_id")
    keys = by_doc.select("doc_id", "mark")
    touched = (ids.join(F.broadcast(keys), ["doc_id", "mark"], "left_semi") if few else ids).join(by_doc, ["doc_id", "mark"])
    rest = ids.join(F.broadcast(keys) if few else keys, ["doc_id", "mark"], "left_anti")
    cut = touched.select(key, "text", "starts", "stops").mapInArrow(_cut, KEPT_DDL)
    data = F.encode("text", "UTF-8")
    same = rest.select(key, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), data.alias("kept"))
    return cut.unionByName(same)
