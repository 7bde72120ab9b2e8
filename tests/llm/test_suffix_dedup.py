"""Suffix-array dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm.suffix_dedup import Anchors, common_prefixes, suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, mark int, start string"


def brute(rows, length):
    """doc_id -> (bytes, removed, spans, hash of what stays); rows in the order of their keys."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[key] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def check(spark, rows, length=100, **options):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA)
    got = suffix_dedup(df, length, **options).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows, length)
    assert len(got) == len(rows)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "añb", "xyz", "lorem", "ipsum"]
    passages = [" ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(40)) for _ in range(6)]
    texts = [None, "", "short", "abab " * 300, "a" * 450, "a" * 99, "a" * 100]
    for _ in range(n):
        parts = [rng.choice(passages)[rng.randrange(40) :] if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randrange(5000)) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 5))]
        texts.append("".join(parts))
    texts += texts[10:14]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"hot_pieces": 2, "shard_bytes": 500}), (3, {"broadcast_rows": 0})])
def test_same_as_all_windows(spark, seed, options):
    check(spark, [*sample(seed, 60), (None, "abab " * 40)], **options)


def test_documents_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "q" * 150, 1, ""), (1, "q" * 150, 1, ""), (1, "r" * 150, 1, "")], SCHEMA)
    assert sorted((r.n_removed, len(r.spans)) for r in suffix_dedup(df).collect()) == [(149, 1), (149, 1), (149, 1)]
    assert suffix_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [b"banana" * 9, b"a" * 300, bytes(random.Random(1).choices(b"ab", k=4000)), b"x"])
def test_suffix_array_and_common_prefixes(text):
    order, word = suffix_array(np.frombuffer(text, np.uint8))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    got = common_prefixes(word, order, 50, lanes=7)
    for a, b in zip(order, order[1:]):
        n = 0
        while n < 50 and a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert got[b] == n or a + n == len(text) or b + n == len(text)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(5)
    inner = rng.integers(97, 100, 300).astype(np.uint8)
    at = Anchors(100)
    a, ha = at.of(inner)
    b, hb = at.of(np.r_[rng.integers(97, 100, 57).astype(np.uint8), inner])
    assert (b[57:] - 57 == a).all() and (hb[57:] == ha).all()


def test_repeats_across_the_border_of_a_stretch(spark):
    """Texts are read in stretches of 1 MB; a repeat may lie over a border, in this or in another document."""
    import hashlib
    import random

    rng = random.Random(9)
    letters = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=n)).decode()
    passage, border = letters(300), 1 << 20
    first = letters(border - 150) + passage + letters(50_000)
    second = letters(1000) + passage + letters(border - 1450) + passage + letters(2000)
    docs = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, len(got[2].spans)) == (0, 600, 2)
    kept = second.replace(passage, "").encode()
    assert hashlib.sha256(bytes(got[2].kept)).digest() == hashlib.sha256(kept).digest()
