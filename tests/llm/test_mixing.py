"""Mixing against a plain version in Python."""

import hashlib
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from tessitura.llm.mixing import TOP, mixed, targets

DDL = "doc_id long, text string, source string, size int, key string, hash int, target string"


def rows_of(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "\x0bone\x0c", "a" * 5000 + " b", "word " * 3000, "nb sp x y"]
    out = [(i, texts[i] if i < len(texts) else " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(["s0"] * 5 + ["s1", "s2", "é", "z", None]), 1, "k", 2, "t") for i in range(400)]
    return out + [(None, "no id", "s1", 1, "k", 2, "t")] * 3 + [(7, "same row", "s2", 1, "k", 2, "t")] * 4 + [(9, "alone " * 2, "tiny", 1, "k", 2, "t")]


def plain(rows, seed=12, rounds=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = [(i, t, s, size(t), int(md5(f"{seed}:{'' if i is None else i}:{md5(t or '')}")[:15], 16)) for i, t, s, *_ in rows]
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(d[3] for d in docs if d[2] == s) for s in names}
    weight = {s: 1 + n % 3 for n, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        shares = sum(w for s, w in weight.items() if s not in capped)
        above = {s for s in names if s not in capped and weight[s] * rest > 3 * sizes[s] * shares}
        if not above:
            break
        capped |= above
    out = []
    for s in names:
        goal = Fraction(3 * sizes[s]) if s in capped else Fraction(weight[s] * rest, shares)
        repeats = int(goal) // sizes[s] if sizes[s] else 0
        left, own = int(goal) - repeats * sizes[s], sorted((d for d in docs if d[2] == s), key=lambda d: d[4])
        once, low, most = set(), -1, TOP
        for _ in range(rounds):
            edge, fits = None, [d for d in own if d[4] > low and 0 < d[3] <= most]
            for h in sorted({d[4] for d in fits}):
                words = sum(d[3] for d in fits if d[4] == h)
                if words > left:
                    edge = h
                    break
                left -= words
                once.add((h, low, most))
            if edge is None or left <= 0:
                break
            low, most = edge, left
        for d in own:
            more = any(d[4] == h and d[3] <= most for h, _, most in once)
            out.append((d[0], d[3], sizes[s], float(goal), d[3] * (repeats + more)))
    return sorted(out, key=repr)


def test_mix_equals_a_plain_one(spark):
    rows = rows_of(3)
    got = mixed(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    # Words taken come near the target, by less than the smallest document left out or one word.
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), docs in by.items():
        taken = sum(r.taken for r in docs)
        assert taken <= target and target - taken < max([1, *(r.size for r in docs)])
        assert all(r.taken <= 3 * r.size for r in docs)


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], DDL)
    assert mixed(empty).collect() == []
    blank = spark.createDataFrame([(1, " ", "a", 0, "", 0, ""), (2, None, None, 0, "", 0, "")], DDL)
    assert sorted(map(tuple, mixed(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_targets_stop_and_are_shared_again(spark):
    sizes = spark.createDataFrame([("0a", 1000), ("0b", 10), ("0c", 1), ("0d", 500)], "key string, source_size long")
    found = {r.key: r.target for r in targets(sizes).collect()}
    assert found["0b"] == 30 and found["0c"] == 3 and abs(sum(found.values()) - 1511) < 1e-9 and found["0a"] == found["0d"]
    assert sizes.count() == targets(sizes).where(F.col("whole") <= F.col("target")).count()
