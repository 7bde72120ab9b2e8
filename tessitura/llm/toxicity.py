"""Toxicity from the nearest labelled examples by an exact cosine: of TF-IDF weights times the terms' chi-square with the label.

Fitting uses a bounded sample of labelled rows (``per_class`` of each label, the first by a hash of
their keys). All of them are examples, with all their terms. A term's weight in a text is
``(1 + log tf) * idf * (chi2 + 0.01)``: document frequencies are counted over the whole corpus, and chi2
is the chi-square of term and label in the sample, so that terms count by how much they depend on the
label (the plain cosine finds texts of a topic, not of a tone); no term is left out.

The examples form an inverted index cut into blocks: each term has its postings and its largest
weight in each block it occurs in. A document visits blocks in descending order of its own upper
bounds and stops when no block can hold a nearer example, so its neighbours are exact. Votes are
weighted by similarity and by how many labelled rows an example stands for, and calibrated by
isotonic regression on leave-one-out votes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

TERM = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


def held_out(key: str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the key as text, modulo 4, is 2 (a null key is not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges (start, count), and the range that each belongs to."""
    of = np.repeat(np.arange(len(start)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of], of


class BlockMaxIndex:
    """Sparse unit vectors, given as (example, term, weight), as an inverted index of blocks of ``size`` examples.

    Terms of over a ``wide`` share of the examples lie in a dense matrix, all others in postings: a
    term has an entry for each block it occurs in, with the largest weight there and the place of its
    postings. Queries come in batches of (query, term, weight).
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, size: int = 128, wide: float = 1 / 32) -> None:
        self.n, self.size, self.blocks = n, size, -(-n // size)
        of_term = np.bincount(term, minlength=terms)
        self.wide = np.full(terms, -1, np.int64)
        dense = np.flatnonzero(of_term > wide * n)
        self.wide[dense] = np.arange(len(dense))
        is_wide = self.wide[term] >= 0
        self.matrix = np.zeros((len(dense), n))
        self.matrix[self.wide[term[is_wide]], example[is_wide]] = weight[is_wide]
        self.matrix_most = np.stack([self.matrix[:, b * size : (b + 1) * size].max(axis=1) for b in range(self.blocks)], axis=1) if len(dense) else np.zeros((0, self.blocks))
        example, term, weight = example[~is_wide], term[~is_wide], weight[~is_wide]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        cell = term[order] * self.blocks + self.example // size
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.entry_block = cell[first] % self.blocks
        self.entry_start, self.entry_count = first, np.diff(np.append(first, len(cell)))
        self.entry_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.term_start = np.searchsorted(cell[first] // self.blocks, np.arange(terms + 1))

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest examples of each query and their cosines; ties go to the smaller number, a cosine of zero is no neighbour.

        Cosines are compared after rounding to nine digits, so that equal texts tie whatever the order of additions.
        """
        n, nb = self.n, self.blocks
        at_wide = self.wide[term]
        dense = np.zeros((queries, len(self.matrix)))
        dense[query[at_wide >= 0], at_wide[at_wide >= 0]] = weight[at_wide >= 0]
        query, term, weight = query[at_wide < 0], term[at_wide < 0], weight[at_wide < 0]
        entry, of = spread(self.term_start[term], self.term_start[term + 1] - self.term_start[term])
        e_query, e_weight, e_block = query[of], weight[of], self.entry_block[entry]
        bound = np.bincount(e_query * nb + e_block, e_weight * self.entry_most[entry], minlength=queries * nb).reshape(queries, nb) + dense @ self.matrix_most
        turn = np.argsort(-bound, axis=1, kind="stable")
        place = np.empty_like(turn)
        np.put_along_axis(place, turn, np.arange(nb)[None, :], axis=1)
        e_turn = place[e_query, e_block]
        by_turn = np.argsort(e_turn, kind="stable")
        turns = np.searchsorted(e_turn[by_turn], np.arange(nb + 1))
        # One whole number orders candidates: the rounded cosine, then the example's number from behind.
        best = np.zeros((queries, k), np.int64)
        active = np.ones(queries, bool)
        local = np.arange(self.size)
        for r in range(nb):
            block = turn[:, r]
            reach = bound[np.arange(queries), block]
            active &= (reach > 0) & (np.ceil(reach * 1e9) + 2 >= best.min(axis=1) // n)
            go = np.flatnonzero(active)
            if not len(go):
                break
            row = np.full(queries, -1)
            row[go] = np.arange(len(go))
            mine = by_turn[turns[r] : turns[r + 1]]
            mine = mine[active[e_query[mine]]]
            posting, of = spread(self.entry_start[entry[mine]], self.entry_count[entry[mine]])
            cell = row[e_query[mine]][of] * self.size + self.example[posting] % self.size
            cosine = np.bincount(cell, e_weight[mine][of] * self.weight[posting], minlength=len(go) * self.size).reshape(len(go), self.size).astype(float)
            for b in np.unique(block[go]).tolist():
                here = np.flatnonzero(block[go] == b)
                part = self.matrix[:, b * self.size : (b + 1) * self.size]
                cosine[here, : part.shape[1]] += dense[go[here]] @ part
            number = block[go][:, None] * self.size + local
            key = np.rint(cosine * 1e9).astype(np.int64) * n + (n - 1 - number)
            key[(key < n) | (number >= n)] = 0
            if without is not None:
                key[without[go][:, None] == number] = 0
            both = np.concatenate([best[go], key], axis=1)
            best[go] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        best = -np.sort(-best, axis=1)
        return np.where(best > 0, n - 1 - best % n, -1), best // n / 1e9


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a non-decreasing step function from scores to label rates (pool adjacent violators)."""
    points, at = np.unique(score, return_inverse=True)
    total, ones = np.bincount(at, weight), np.bincount(at, weight * label)
    stack: list[list[float]] = []
    for x, n, y in zip(points, total, ones, strict=True):
        stack.append([x, x, n, y])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, x1, n1, y1 = stack.pop()
            stack[-1][1] = x1
            stack[-1][2] += n1
            stack[-1][3] += y1
    xs, ys = [], []
    for x0, x1, n, y in stack:
        xs += [x0, x1]
        ys += [y / n, y / n]
    return np.array(xs), np.array(ys)


class Model:
    """Terms and their weights, index, labels and calibration; small enough to travel with a task (bounded by the sample)."""

    def __init__(self, at: dict[str, int], weight: np.ndarray, examples: list[tuple[int, int]], cells: tuple[np.ndarray, np.ndarray, np.ndarray], stand_for: tuple[float, float], k: int) -> None:
        """``cells`` are (example, term, count); ``stand_for`` is how many labelled rows an example of each label stands for."""
        self.at, self.term_weight, self.k = at, weight, k
        example, term, w = self.weigh(*cells, len(examples))
        label, keys = np.array([y for _, y in examples], float), np.array([key for key, _ in examples], np.int64)
        # Examples with the same heaviest term stand together, so that the bounds of blocks are tight.
        heaviest = np.full(len(examples), -1)
        by = np.lexsort((term, w))
        heaviest[example[by]] = term[by]
        order = np.lexsort((keys, label, heaviest))
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        self.keys, self.label, example = keys[order], label[order], new[example]
        self.weight = np.where(self.label == 1, stand_for[1], stand_for[0])
        self.index = BlockMaxIndex(example, term, w, len(examples), len(weight))
        rate = lambda of: float((self.weight[of] * self.label[of]).sum() / self.weight[of].sum()) if of.any() else None
        plain = np.bincount(example, minlength=len(order)) == 0
        self.base = rate(np.ones(len(order), bool)) or 0.0
        self.points, self.rates = np.zeros(1), np.array([self.base])
        if not plain.all():
            votes = np.concatenate([self._left_out(example, term, w, first) for first in range(0, len(order), 256)])
            self.points, self.rates = isotonic(votes[~plain], self.label[~plain], self.weight[~plain])
        # A text without terms shows nothing toxic: the rate of such examples, or the least rate if there are none.
        self.without_terms = rate(plain) if plain.any() else float(self.rates.min())

    def _left_out(self, example: np.ndarray, term: np.ndarray, w: np.ndarray, first: int, rows: int = 256) -> np.ndarray:
        mine = (example >= first) & (example < first + rows)
        n = min(rows, len(self.label) - first)
        return self.votes(example[mine] - first, term[mine], w[mine], n, np.arange(first, first + n))[0]

    def weigh(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of unit vectors; terms of no weight go."""
        w = (1 + np.log(count)) * self.term_weight[term]
        size = np.sqrt(np.bincount(row, w * w, minlength=rows))
        some = w > 0
        return row[some], term[some], w[some] / size[row[some]]

    def votes(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        near, cosine = self.index.nearest(row, term, w, rows, self.k, without)
        w = np.where(near >= 0, cosine * self.weight[near], 0)
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.label[near]).sum(axis=1) / np.where(total > 0, total, 1), self.base), near

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """The calibrated scores, and the keys of the five nearest examples of each text."""
        n, get = len(self.at), self.at.get
        each = [[j for j in map(get, TERM.findall(t.lower())) if j is not None] for t in texts]
        cells = np.concatenate([np.asarray(found, np.int64) + i * n for i, found in enumerate(each)] or [np.zeros(0, np.int64)])
        cells, count = np.unique(cells, return_counts=True)
        row, term, w = self.weigh(cells // max(n, 1), cells % max(n, 1), count, len(texts))
        out = np.full(len(texts), self.without_terms)
        evidence: list[list[int]] = [[] for _ in texts]
        some = np.flatnonzero(np.bincount(row, minlength=len(texts)))
        if len(some):
            vote, near = self.votes(row, term, w, len(texts))
            out[some] = 0.98 * np.interp(vote[some], self.points, self.rates) + 0.02 * vote[some]  # the vote orders what calibration ties
            for i in some.tolist():
                evidence[i] = self.keys[near[i, :5][near[i, :5] >= 0]].tolist()
        return np.clip(out, 0, 1), evidence


def _sample(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Keys and labels of the sample, and how many rows of each label there are to learn from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def _term_rows(rows: DataFrame) -> DataFrame:
    """``doc_id, toxic, tf`` with tf the counts of the text's terms."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("tf", pa.map_(pa.string(), pa.int32()))])
    each = lambda batch: {"doc_id": batch.column(0), "toxic": batch.column(1), "tf": [list(terms(t).items()) for t in batch.column(2).to_pylist()]}
    return rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(arrow_map(schema, each, 256), "doc_id long, toxic int, tf map<string,int>")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, np.ndarray]:
    """Rows of the corpus, and in how many of them each term stands; every task sends one row per term."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches):
        at = {t: i for i, t in enumerate(vocabulary)}
        n = np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[[at[t] for t in set(TERM.findall(text.lower())) if t in at]] += 1
                n[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], schema=schema)

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in texts(docs).select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return int(out[-1]), out[:-1]


def chi_square(with_0: np.ndarray, with_1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Chi-square, corrected for continuity, of term and label from the numbers of examples of each label that have the term."""
    a, b, n = with_1.astype(float), with_0.astype(float), n0 + n1
    apart = np.maximum(np.abs(a * (n0 - b) - b * (n1 - a)) - n / 2, 0)
    return n * apart**2 / np.maximum((a + b) * (n - a - b) * n0 * n1, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1024, k: int = 15) -> Model | None:
    """The model from at most ``per_class`` labelled rows of each label; None without both labels or without terms that depend on them.

    Among so many terms some seem to depend on the label by chance: nothing is learnt unless a term's
    chi-square is over ``2 * log(terms)``, as in samples of a few toxic rows.
    """
    sample, counts = _sample(labels, per_class)
    body = texts(docs).join(F.broadcast(sample), "doc_id")  # at most 2 x per_class keys
    # Copies say nothing new about a term: of equal texts with equal labels, one stays in the sample.
    body = body.groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", "text")
    found = sorted(((r["doc_id"], r["toxic"], r["tf"]) for r in _term_rows(body).toLocalIterator()), key=lambda r: r[:2])
    got = Counter(y for _, y, _ in found)
    if set(got) != {0, 1}:
        return None
    at = {t: i for i, t in enumerate(sorted({t for *_, tf in found for t in tf}))}
    example = np.repeat(np.arange(len(found)), [len(tf) for *_, tf in found])
    term = np.fromiter((at[t] for *_, tf in found for t in tf), np.int64, len(example))
    count = np.fromiter((n for *_, tf in found for n in tf.values()), np.int64, len(example))
    toxic = np.array([y for _, y, _ in found])[example] == 1
    chi2 = chi_square(np.bincount(term[~toxic], minlength=len(at)), np.bincount(term[toxic], minlength=len(at)), got[0], got[1])
    rows, df = document_frequencies(docs, list(at))
    weight = np.log((1 + rows) / (1 + df)) * (chi2 + 0.01)  # no term is left out
    if not weight.any() or chi2.max() <= 2 * np.log(len(at)):  # nothing in the texts depends on the label
        return None
    return Model(at, weight, [(key, y) for key, y, _ in found], (example, term, count), (counts[0] / got[0], counts[1] / got[1]), k)


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.int64()))])


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs``.

    ``evidence`` has the keys of the nearest examples; ties go to the one that stands first in the
    index. A text without any term of the examples, as an empty or null one, gets the rate of toxic
    rows among examples without terms (the least calibrated rate if there are no such examples).
    Where nothing can be learnt every score is zero. Long texts count whole. Null keys are scored; of
    repeated labels of a document the larger counts; repeated rows are scored each; empty tables give
    no rows; other columns are not read.
    """
    model = fit(docs, labels, **options)

    def each(batch: pa.RecordBatch) -> dict:
        score, evidence = model.score(batch.column(1).to_pylist()) if model else (np.zeros(batch.num_rows), [[]] * batch.num_rows)
        return {"doc_id": batch.column(0), "score": score, "predicted": (score >= threshold).astype(np.int32), "evidence": evidence}

    scored = texts(docs).mapInArrow(arrow_map(SCORES, each, 256), "doc_id long, score double, predicted int, evidence array<long>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all columns as they are; one pass without a shuffle.

    Null and empty texts are scored as in :func:`toxicity_scores`; null keys and repeated rows are
    judged each by their text; without labels of both kinds all rows stay.
    """
    model = fit(docs, labels, **options)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        rows = text.fillna("").tolist()
        return pd.Series(np.concatenate([model.score(rows[i : i + 256])[0] for i in range(0, len(rows), 256)] or [np.zeros(0)]))

    return docs.where(score("text") < threshold)
