"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case. A seed is a run of ``least`` words that a document shares with a
benchmark item; documents and items that share a seed are compared by running Karp-Rabin greedy
string tiling: the longest common runs of words that are not covered yet are marked again and
again, down to ``least`` words. Marked runs never overlap and may stand in any order, so an item
whose sentences were moved about is still found. A document is contaminated by an item when its
tiles cover ``coverage`` of the item's words or more.

While the benchmark's seeds are few (``broadcast_seeds``), they travel with the tasks and each
document is compared where it is read. Beyond that, seeds of documents and items meet in a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, texts, without

WORD = re.compile(r"\w+")
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("covered_words", pa.int64()), ("item_words", pa.int64()), ("first_word", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, coverage double, n_tiles long, covered_words long, item_words long, first_word long"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(words: list[str], known: dict[str, int] | None = None) -> np.ndarray:
    """A 64-bit number per word; with ``known``, zero for other words."""
    if known is not None:
        get = known.get
        return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) | 1 for w in words), np.uint64, len(words))


def window_hashes(numbers: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin value of every window of ``length`` words (modulo 2^64)."""
    n = len(numbers) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(length):
        if n > 0:
            out = out * FACTOR + (numbers[j : j + n] ^ (numbers[j : j + n] >> np.uint64(29)))
    return out


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of numbers: (start in pattern, start in text, length).

    Negative numbers match nothing. Running Karp-Rabin: windows of the search length are hashed,
    matches are extended, marked from the longest down; then the search length shrinks to ``least``.
    """
    marked_p, marked_t = [x < 0 for x in pattern], [x < 0 for x in text]
    found: list[tuple[int, int, int]] = []
    search = max(least, min(len(pattern), len(text)))

    def windows(seq: list[int], marked: list[bool], s: int) -> Iterator[tuple[int, int]]:
        """(start, rolling hash) of unmarked windows of length s."""
        mask, base = (1 << 61) - 1, 1_000_003
        power = pow(base, s - 1, mask)
        value = held = 0
        for i, x in enumerate(seq):
            if marked[i]:
                value = held = 0
                continue
            if held == s:
                value = (value - seq[i - s] * power) % mask
                held -= 1
            value = (value * base + x) % mask
            held += 1
            if held == s:
                yield i - s + 1, value

    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for t, h in windows(text, marked_t, search):
            table[h].append(t)
        matches: list[tuple[int, int, int]] = []
        longest = 0
        for p, h in windows(pattern, marked_p, search):
            for t in table.get(h, ()):
                if p and t and pattern[p - 1] == text[t - 1] and not marked_p[p - 1] and not marked_t[t - 1]:
                    continue  # inside of a match that began one word before
                k = 0
                while p + k < len(pattern) and t + k < len(text) and not marked_p[p + k] and not marked_t[t + k] and pattern[p + k] == text[t + k]:
                    k += 1
                if k >= search:
                    matches.append((k, p, t))
                    longest = max(longest, k)
        if longest > 2 * search:
            search = longest
            continue
        again = False
        for k, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if any(marked_p[p : p + k]) or any(marked_t[t : t + k]):
                again = True  # what is left of it may still be long enough
                continue
            for i in range(k):
                marked_p[p + i] = marked_t[t + i] = True
            found.append((p, t, k))
        if again and matches:
            continue
        if search <= least:
            return found
        search = max(least, search // 2)


def compare(item: np.ndarray, doc: np.ndarray, at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles of an item in the parts of a document near its seeds (``at``: starts of seeds); starts are the document's."""
    if not len(at):
        return []
    inside = np.zeros(len(doc), bool)
    for j in range(least):
        inside[at + j] = True
    where = np.flatnonzero(inside)
    number: dict[int, int] = {}
    pattern = [number.setdefault(int(x), len(number) + 1) for x in item]
    text, place, last = [], [], -2
    for i in where.tolist():
        if i != last + 1:
            text.append(-1), place.append(-1)
        text.append(number.get(int(doc[i]), -1)), place.append(i)
        last = i
    return [(p, place[t], k) for p, t, k in tiles(pattern, text, least)]


class Benchmark:
    """Items as word numbers, and where each seed stands."""

    def __init__(self, items: list[tuple[int, str]], least: int, coverage: float) -> None:
        self.least, self.coverage = least, coverage
        self.items: list[tuple[int, np.ndarray, int]] = []
        self.known: dict[str, int] = {}
        seeds: dict[int, list[int]] = defaultdict(list)
        for key, text in items:
            words = words_of(text)
            numbers = word_hashes(words)
            self.known.update(zip(words, numbers.tolist(), strict=True))
            size = min(least, len(words))
            if not size:
                continue
            self.items.append((key, numbers, size))
            for h in set(window_hashes(numbers, size).tolist()):
                seeds[h, size].append(len(self.items) - 1)
        self.seeds = {size: {h: v for (h, s), v in seeds.items() if s == size} for size in sorted({s for _, s in seeds})}
        self.sorted = {size: np.sort(np.fromiter(d, np.uint64, len(d))) for size, d in self.seeds.items()}

    def check(self, key, text: str) -> list[tuple]:
        """Rows of FOUND for a document: the items whose coverage is high enough."""
        numbers = word_hashes(words_of(text), self.known)
        rows = []
        for size, seeds in self.seeds.items():
            if len(numbers) < size:
                continue
            known = np.convolve(numbers > 0, np.ones(size, np.int64), "valid") == size
            at = np.flatnonzero(known)
            if not len(at):
                continue
            hashes = window_hashes(numbers, size)[at]
            place = np.minimum(np.searchsorted(self.sorted[size], hashes), len(self.sorted[size]) - 1)
            hit = self.sorted[size][place] == hashes
            by_item: dict[int, list[int]] = defaultdict(list)
            for i, h in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
                for item in seeds[h]:
                    by_item[item].append(i)
            for item, starts in by_item.items():
                rows += measured(key, *self.items[item], numbers, np.array(starts), self.coverage)
        return rows


def measured(key, item_id, item: np.ndarray, least: int, numbers: np.ndarray, starts: np.ndarray, coverage: float) -> list[tuple]:
    found = compare(item, numbers, starts, least)
    covered = sum(k for _, _, k in found)
    if not found or covered / len(item) < coverage:
        return []
    return [(key, item_id, covered / len(item), len(found), covered, len(item), min(t for _, t, _ in found))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FOUND]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _carried(items: DataFrame, least: int, coverage: float, most_bytes: int) -> Benchmark | None:
    """The benchmark as one object if its texts have at most ``most_bytes`` bytes."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most_bytes:
        return None
    return Benchmark([(r["item_id"], r["text"]) for r in items.collect()], least, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and benchmark item it contains: ``doc_id, item_id, coverage, n_tiles, covered_words, item_words, first_word``.

    Clean documents have no row. Items of fewer than ``least`` words need all of them as one run;
    items without words match nothing; null texts are empty; null ids stay null; repeated rows give
    repeated rows; empty tables give none; other columns are not read. The benchmark travels with the
    tasks if its texts have at most ``broadcast_bytes`` bytes; beyond that seeds are shuffled.
    """
    items = texts(benchmark, "item_id")
    rows = texts(docs)
    if bench := _carried(items, least, coverage, broadcast_bytes):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 512):
                yield _batch([row for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for row in bench.check(k, t)])

        return rows.mapInArrow(run, FOUND_DDL)

    # Seeds of both sides meet in a shuffle; then each pair is tiled once. Only lengths that the benchmark has are sent.
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "decontamination-docs")
    sizes = staged(items.withColumn("row", F.monotonically_increasing_id()), "decontamination-items")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            found = {min(least, len(words_of(t))) for t in part.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["size"])

    used = sorted(r["size"] for r in sizes.select("text").mapInArrow(lengths, "size int").distinct().collect() if r["size"])

    def seeds(df: DataFrame, whole: bool) -> DataFrame:
        schema = pa.schema([("seed", pa.int64()), ("row", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 64):
                found, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    numbers = word_hashes(words_of(text))
                    for n in [min(least, len(numbers))] if whole else used:
                        if 0 < n <= len(numbers):
                            h = np.unique(window_hashes(numbers, n))
                            found.append(h), of.append(np.full(len(h), row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(of))], schema=schema)

        return df.select("row", "text").mapInArrow(run, "seed long, row long")

    left, right = seeds(rows, False), seeds(sizes, True).withColumnRenamed("row", "item_row")
    pairs = left.join(right, "seed").select("row", "item_row").distinct()
    both = pairs.join(rows.select("row", "doc_id", "text"), "row").join(sizes.select(F.col("row").alias("item_row"), "item_id", F.col("text").alias("item_text")), "item_row")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out: list[tuple] = []
            for key, text, item_id, item_text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                out += Benchmark([(item_id, item_text)], least, coverage).check(key, text)
            yield _batch(out)

    return both.select("doc_id", "text", "item_id", "item_text").mapInArrow(tile, FOUND_DDL)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` whose own text is clean, with all columns as they are.

    Each row stands for itself, whatever its key: a clean row beside a leak under the same or a null key stays.
    Null and empty texts are clean, repeated rows are judged alike, an empty table of either side drops nothing,
    and long texts are read whole. A benchmark that travels with the tasks makes this a filter without a shuffle;
    a larger one numbers the rows in a table of the shared folder and leaves out the numbers found.
    """
    if bench := _carried(texts(benchmark, "item_id"), least, coverage, broadcast_bytes):

        @F.arrow_udf("boolean")
        def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                yield pa.array([not bench.check(0, text.as_py() or "") for text in part], pa.bool_())

        return docs.where(clean(F.coalesce("text", F.lit(""))))
    number = "__number"
    while number in docs.columns:
        number += "_"
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "decontamination-rows")
    found = contaminated(rows.select(F.col(number).alias("doc_id"), "text"), benchmark, least, coverage, broadcast_bytes)
    return without(rows, found.select(F.col("doc_id").alias(number)), [number]).drop(number)
