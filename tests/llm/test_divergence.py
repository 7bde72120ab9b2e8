"""The audit of sources against a plain version."""

import random
import re
from collections import Counter

import pytest

from tessitura.llm.divergence import audited, term_counts, top_terms

DDL = "doc_id long, text string, lang string, source string, term string, n int, value string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most):
    docs = [((r[1] or ""), r[2] or "", r[3] or "") for r in rows]
    terms = lambda t: [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(s, terms(t)) for t, x, s in docs if x == lang]
        kept = {t for t, n in Counter(t for _, ts in own for t in set(ts)).items() if n >= least}
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pair = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in counts if x != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(items, 1) if part == "pair" or n <= most]
    return sorted(out)


def rows_of(seed, count=300):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{'x' * (i % 4)}" for i in range(26)] + ["Straße", "STRASSE", "İx", "naïve", "日本", "ÀB", "á"] + ["p" * 40 + c for c in "abcdefgh"]
    out = []
    for i in range(count):
        source = rng.choice(["hot"] * 4 + ["a", "b", "c", None])
        text = None if i % 37 == 0 else "" if i % 41 == 0 else "".join(rng.choice(words) + rng.choice([" ", "-", "1", "\n", "_"]) for _ in range(rng.randint(1, 25)))
        out.append((i, text, rng.choice(["en", "en", "de", None]), source, "t", 1, "v", "r"))
    return out + [out[5]] * 40 + [(None, "only here", "xx", "one", "t", 1, "v", "r"), (None, None, "xx", "two", "t", 1, "v", "r"), (1, "wa " * 20_000, "en", "hot", "t", 1, "v", "r")]


@pytest.mark.parametrize("least, most", [(30, 50), (10, 3), (1, 5)])
def test_equals_a_plain_version(spark, least, most):
    rows = rows_of(least)
    got = audited(spark.createDataFrame(rows, DDL).repartition(3), least, most).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, most)


def test_no_rows(spark):
    assert audited(spark.createDataFrame([], DDL)).collect() == []


def test_counts_are_flushed_and_summed(spark):
    docs = spark.createDataFrame([(i, f"a b{i} A", "l", "s", "", 0, "", "") for i in range(600)], DDL).coalesce(1)
    found = {bytes(r.term): (r.n, r.docs) for r in term_counts(docs, entries=100).where("term IS NOT NULL").collect()}
    assert found == {b"a": (1200, 600), b"b": (600, 600)}


def test_equal_values_go_by_bytes(spark):
    terms = ["a" * 100 + x for x in ("", "b", "c", "é", "z")] + ["b", "aa", "a"]
    rows = spark.createDataFrame([("l", "s", t, 7) for t in terms] + [("l", "s", "top", 2**29)], "lang string, source string, term string, value long")
    for most in (1, 4, 6, 10):
        got = {r.term for r in top_terms(rows, most).collect()}
        assert got == set((["top"] + sorted(terms, key=str.encode))[:most])
