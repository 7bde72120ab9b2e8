"""The pipeline against its stages by brute force on a small table."""

import itertools
import shutil

import corpus_pipeline
from tessitura.llm.decontamination import contaminated, words_of
from tessitura.llm.simhash import shingle_set


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    sf = str(tmp_path)
    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", f"{sf}/{name}.parquet")
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    extra = spark.createDataFrame([(9001, "copy of it all", "en", None, 5), (9002, "copy of it all", "en", None, 5), (9003, None, None, None, None), (9004, f"x {item} y", "en", "s", 1)], source.schema)
    source.union(extra).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() > 0.8 * docs.count()

    unique = stages["exact_dedup"](spark, docs, sf)
    last = {}
    for r in docs.collect():
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(last.values())

    near = stages["near_dedup"](spark, unique, sf)
    sets = {r.doc_id: shingle_set(r.text or "", 5) for r in unique.collect()}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert {r.doc_id for r in near.collect()} == {top(k) for k in sets} != set(sets)

    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rest = {r.doc_id for r in stages["decontamination"](spark, docs, sf).collect()}
    verbatim = {r.doc_id for r in docs.collect() if any(i in " ".join(words_of(r.text or "")) for i in items)}
    gone = {r.doc_id for r in contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert 9004 in verbatim and verbatim <= gone and rest == {r.doc_id for r in docs.collect()} - gone

    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 9001 not in ids and 9002 in ids and 9004 not in ids


def test_columns_of_any_name_pass_the_stages(spark, tmp_path):
    names = ["__file", "__row", "__number", "__path", "node", "root", "id", "rank", "digest", "__gone___file", "n", "at", "body", "key"]
    rows = [(k, t, *(f"{k}{n}" for n in names)) for k, t in [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, None), (3, ""), (4, "other words of a text")]]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    for table, ddl in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", *names]
        assert all(r[n] == f"{r.doc_id}{n}" for r in docs.collect() for n in names)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["2", "3", "4"]
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 3
