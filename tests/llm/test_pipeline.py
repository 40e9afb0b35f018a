"""The pipeline's stages, each against what it says."""

import re

import corpus_pipeline as C
from lattiq.session import materialize, table
from tests.llm.test_corpus import SF, components


def test_stages(spark):
    docs = table(spark, SF, "documents").limit(120)
    stages = dict(C.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    kept = materialize(stages["language_id"](spark, docs, SF), "t1")
    assert kept.columns == docs.columns and kept.count() == docs.count()  # all of them are prose
    once = materialize(stages["exact_dedup"](spark, kept, SF), "t2")
    norm = {}
    for r in kept.collect():
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r.text), []).append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(g)[1] for g in norm.values())
    near = materialize(stages["near_dedup"](spark, once, SF), "t3")
    want = components([(r.doc_id, r.text) for r in once.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if i == c}
    clean = materialize(stages["pii"](spark, near, SF), "t4")
    assert clean.columns == docs.columns and clean.count() == near.count()
    assert not any(re.search(r"[\w.+-]+@[\w-]+(\.[\w-]+)+", r.text) for r in clean.collect())
    packed = stages["packing"](spark, clean, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_stages_take_odd_rows_and_names(spark):
    docs = table(spark, SF, "documents")
    odd = [(90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0), (90_003, " \t\n", None, None, 0), (90_004, "1234 !!", "en", "s", 7), (None, "日本語 のテキスト", "xx", "s", 9)]
    both = docs.unionByName(spark.createDataFrame(odd + odd[:2], docs.schema)).unionByName(docs.limit(3))
    for df in (both.withColumn("a.b", both.doc_id + 1).withColumn("row`s", both.source), both.where("false").withColumn("a.b", both.doc_id)):
        names, rows = df.columns, df
        for name, stage in C.STAGES:
            rows = materialize(stage(spark, rows, SF), "odd")
            if name != "packing":
                assert rows.columns == names
                left = {r.doc_id for r in rows.select("doc_id").collect()}
                assert not left & {90_001, 90_002, 90_003, 90_004}  # rejected by the first stage: no letters
        assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == left
