"""Packing and token files against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import pytest

from tessitura.llm.packing import Packer, pack_conversations, pack_documents
from tessitura.llm.token_files import read_chunk, token_files, write_chunk
from tessitura.llm.tokens import UNUSUAL, PieceEncoder, vocabulary_path

SF = "/root/testdata/sf0.001"
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name, specials=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    t.encode_special_tokens = not specials
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_library_ids(name, spark):
    enc, lib = PieceEncoder(vocabulary_path(name)), library(name)
    texts = ["", " ", "\n\n a  b\t c", "It's WE'LL 'quoted' 's", "İstanbul ΑΣ Σ", "é é", "12 345é…!? don't", "<|endoftext|> x", "日本語 テスト 한국 😀😀", "\x1c\x85  x", "ſt K"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(3)
    usual = [chr(c) for c in range(0x20, 0xFFFF) if not 0xD800 <= c < 0xE000 and not UNUSUAL.search(chr(c))]
    texts += ["".join(rng.choice(usual[:700] if rng.random() < 0.8 else usual) for _ in range(60)) for _ in range(400)]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == lib(texts)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("specials", [False, True])
def test_strings_of_special_tokens(name, specials):
    enc, lib = PieceEncoder(vocabulary_path(name), specials=specials), library(name, specials)
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "<| endoftext|>", "plain"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == lib(texts)


@pytest.mark.parametrize("name", NAMES)
def test_a_full_memory_forgets(name, spark):
    enc, lib = PieceEncoder(vocabulary_path(name), kept=50), library(name)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:40]
    assert [np.frombuffer(enc.encode([t])[0], "<u4").tolist() for t in texts] == lib(texts)


@pytest.mark.parametrize("name", NAMES)
def test_every_usual_character_splits_alike(name):
    enc, lib = PieceEncoder(vocabulary_path(name)), library(name)
    texts = [f"a1{c} {c}B{c}2.{c}{c}\n c" for c in map(chr, [*range(0xD800), *range(0xE000, 0x10FFF), *range(0x1F300, 0x1F650)]) if not UNUSUAL.search(c)]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(part)] == lib(part)


def rows_of(spark, texts, extra=False):
    data = [(i, t, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, start string, length int")


def test_token_files_round_trip(spark):
    texts = ["", None, "Hello!", "tail " * 5000, "Hello!", "héé\n"]
    df = rows_of(spark, texts).union(spark.createDataFrame([(None, "no key", None, None), (2, "Hello!", None, None)], "doc_id long, text string, start string, length int"))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files(df, chunk_tokens=64).collect()))
    lib = library(NAMES[0])
    rows = sorted([(r.doc_id, r.text or "") for r in df.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for key, text in rows:
        ids = np.asarray([*lib([text])[0], 0], "<u4")
        want.append((start, key, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_blocks_keep_every_value(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.full(n, 7), rng.zipf(1.3, n) % 2**31, np.r_[np.zeros(n - 1, int), 2**32 - 1]):
        keys, lengths, out = read_chunk(write_chunk([5, None], [n - 1, 1], ids.astype(np.uint32)))
        assert keys == [5, None] and list(lengths) == [n - 1, 1] and (out == ids.astype(np.uint32)).all()


def test_packed_documents_are_whole_and_tight(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack_documents(df).collect()
    lib = library("word_bpe_49k.json")
    docs = {r.doc_id: [*lib([r.text or ""])[0], 1] for r in df.collect()}
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(parts) == set(docs)
    for key, found in parts.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(docs[key])
            assert r.ids_crc32 == zlib.crc32(np.asarray(docs[key][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(docs[key])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(found) <= 256
    assert sum(map(len, docs.values())) / (2048 * len(sequences)) > 0.97


def test_packing_limits_hold_together(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = turns.union(spark.createDataFrame([(None, None, None, None), (1, 2, "assistant", "long " * 9000)], turns.schema))
    rows = pack_conversations(turns, limits=(256, 8, 100)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in x) <= 256 and len(x) <= 8 and sum(r.loss_tokens for r in x) <= 100 for x in by.values())
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in library("word_bpe_49k.json")([r.text or "" for r in turns.collect()]))


def test_packer_handles_nothing_and_empty_texts(spark):
    assert list(Packer((8, 2, 8), 4, 0).finish()) == []
    rows = pack_documents(rows_of(spark, ["", None, ""])).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2] and {r.length for r in rows} == {1}
    assert pack_documents(rows_of(spark, [""]).limit(0)).count() == 0


def test_short_texts_fill_their_sequences(spark):
    rows = pack_documents(rows_of(spark, ["ab cd"] * 20_000).coalesce(1)).collect()
    tokens, last = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert len(rows) >= 20_000 and tokens > 0.98 * 2048 * (last - 1)


def plain_packing(sizes, limits, pool, smallest_cut):
    """Rows (example, start, length, sequence, offset) of the same rule in plain loops, without arrays."""
    rows, waiting, state = [], [], {"next": 1, "sequence": 0, "offset": 0, "free": list(limits)}

    def put(item, n):
        rows.append((item[0], item[1], n, state["sequence"], state["offset"]))
        state["offset"] += n
        state["free"] = [state["free"][0] - n, state["free"][1] - 1, state["free"][2] - n]

    def close():
        if state["offset"]:
            state.update(sequence=state["next"], next=state["next"] + 1, offset=0, free=list(limits))

    def place(keep):
        while len(waiting) > keep:
            free = state["free"]
            fitting = [x for x in waiting if x[2] <= free[0] and 1 <= free[1] and x[2] <= free[2]]
            if fitting:
                value = lambda x: sum(a * b / c**2 for a, b, c in zip((x[2], 1, x[2]), free, limits))
                best = max(value(x) for x in fitting)
                item = next(x for x in fitting if abs(value(x) - best) < 1e-12)
                put(item, item[2])
                waiting.remove(item)
            else:
                item = max(waiting, key=lambda x: x[2])
                n = int(min(item[2], free[0], free[2])) if free[1] >= 1 else 0
                if n and (n >= smallest_cut or not state["offset"] or n == free[0]):
                    at = waiting.index(item)
                    put(item, n)
                    waiting[at] = (item[0], item[1] + n, item[2] - n)
                else:
                    close()
            if state["free"][0] < 1 or state["free"][1] < 1:
                close()

    for key, n in enumerate(sizes):
        start = 0
        while n - start > limits[0]:
            rows.append((key, start, limits[0], state["next"], 0))
            state["next"] += 1
            start += limits[0]
        waiting.append((key, start, n - start))
        if len(waiting) >= 2 * pool:
            place(pool)
    place(0)
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_packer_places_what_a_plain_loop_places(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, rng.randrange(1, 20), rng.randrange(1, 150)]) for _ in range(120)]
    limits = (64, rng.choice([3, 8, 100]), 64)
    packer = Packer(limits, 16, 0, 5)
    got = [row for key, n in enumerate(sizes) for row in packer.add(key, bytes(4 * n))] + list(packer.finish())
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in got] == plain_packing(sizes, limits, 16, 5)
