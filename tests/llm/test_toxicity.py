"""Toxicity: exact neighbours, calibration, held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessitura.llm.toxicity import BlockMaxIndex, drop_toxic, isotonic, toxicity_scores


def sparse(x):
    row, term = np.nonzero(x)
    return row, term, x[row, term]


@pytest.mark.parametrize("size", [4, 128])
@pytest.mark.parametrize("wide", [0.0, 0.2, 1.0])
def test_neighbours_are_exact(size, wide):
    rng = np.random.default_rng(size)
    x = rng.random((300, 20)) * (rng.random((300, 20)) < 0.2)
    x[7] = x[30] = x[200]  # ties
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    q = x[:50]
    index = BlockMaxIndex(*sparse(x), 300, 20, size, wide)
    for without in (None, np.arange(50)):
        near, cosine = index.nearest(*sparse(q), 50, 7, without)
        for i in range(50):
            every = sorted((-round(float(x[j] @ q[i]), 9), j) for j in range(300) if without is None or j != i)[:7]
            want = [(j, -c) for c, j in every if c < 0]
            got = [(j, c) for j, c in zip(near[i].tolist(), cosine[i].tolist()) if j >= 0]
            assert [j for j, _ in got] == [j for j, _ in want] and np.allclose([c for _, c in got], [c for _, c in want], atol=2e-9)


def plain_scores(docs, labels, k=15):
    """Scores by definition: every text against every example, in dictionaries."""
    counts = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, (_, t) in enumerate(docs)}
    df = Counter(t for c in counts.values() for t in c)
    known = {key: y for key, y in labels if y in (0, 1) and zlib.crc32(str(key).encode()) % 4 != 2}
    stand = Counter(known.values())
    first = {}
    for i, (key, text) in sorted(enumerate(docs), key=lambda x: x[1][0]):
        if key in known:
            first.setdefault((known[key], text), (key, i))
    chosen = [(key, y, counts[i]) for (y, _), (key, i) in first.items()]
    n = Counter(y for _, y, _ in chosen)
    has = {y: Counter(t for _, z, c in chosen if z == y for t in c) for y in (0, 1)}
    weight, most = {}, 0.0
    for t in has[0] | has[1]:
        a, b = has[1][t], has[0][t]
        rest = sum(n.values()) - a - b
        apart = max(abs(a * (n[0] - b) - b * (n[1] - a)) - sum(n.values()) / 2, 0)
        chi2 = sum(n.values()) * apart**2 / ((a + b) * rest * n[0] * n[1]) if rest else 0.0
        weight[t] = math.log((1 + len(docs)) / (1 + df[t])) * (chi2 + 0.01)
        most = max(most, chi2)
    if most <= 2 * math.log(len(weight)):
        return [(key, 0.0) for key, _ in docs]

    def unit(c):
        v = {t: (1 + math.log(m)) * weight[t] for t, m in c.items() if weight.get(t, 0) > 0}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = [(key, y, unit(c)) for key, y, c in chosen]
    examples.sort(key=lambda e: (max(((x, t) for t, x in e[2].items()), default=(0, ""))[1], e[1], e[0]))
    each = {y: stand[y] / n[y] for y in (0, 1)}

    def vote(v, out=None):
        cos = [(-round(sum(x * e[2].get(t, 0) for t, x in v.items()), 9), j) for j, e in enumerate(examples) if j != out]
        near = [(-c, examples[j][1]) for c, j in sorted(cos)[:k] if c < 0]
        total = sum(c * each[y] for c, y in near)
        return sum(c * each[y] * y for c, y in near) / total if total else stand[1] / (stand[0] + stand[1])

    some = [(j, e) for j, e in enumerate(examples) if e[2]]
    xs, ys = isotonic(np.array([vote(e[2], j) for j, e in some]), np.array([float(e[1]) for _, e in some]), np.array([each[e[1]] for _, e in some]))
    out = []
    for i, (key, _) in enumerate(docs):
        v = unit(counts[i])
        m = vote(v)
        out.append((key, 0.98 * float(np.interp(m, xs, ys)) + 0.02 * m if v else float(ys.min())))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_scores_are_those_of_a_plain_version(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(900_001, ""), (900_002, None), (900_003, "zzz " * 100_000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    want = dict(plain_scores([(r.doc_id, r.text or "") for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()]))
    got = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[x] - want[x]) for x in got) < 1e-6
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert sum(got[x] >= 0.3 for x in clean) <= 0.1 * len(clean)


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.allclose(np.interp([1, 2, 3, 4], x, y), [0, 0.5, 0.5, 1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(a > np.array(neg)).mean() + (a == np.array(neg)).mean() / 2 for a in pos])
    assert auc > 0.9 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_no_labels_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(901, "a b", 0.5), (None, None, 0.1), (901, "a b", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity_scores(docs, none).collect()] == [0.0] * 3
    assert drop_toxic(docs, none).count() == 3 and toxicity_scores(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(i, f"{t} {i}", 0.1) for i, t in enumerate(["fine day here", "bad idiot thing"] * 60)], docs.schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    kept = drop_toxic(some.union(docs), labels)
    assert kept.columns == docs.columns and sorted({(r.text or "").rstrip("0123456789 ") for r in kept.collect()}) == ["", "a b", "fine day here"]
