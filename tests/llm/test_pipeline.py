"""The pipeline, stage by stage, against brute force on what each stage was given."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowloom.llm.common import workspace, written
from flowloom.llm.mixing import mix_sources
from tests.llm.test_dedup import brute_components, normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    folder, docs, kept = workspace(spark), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), folder, name.replace(" ", "-"))
        kept.append((docs, after))
        docs = after
    return kept


def test_all_but_the_last_return_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [after.columns == columns for _, after in stages] == [True, True, True, True, False]


def test_quality_keeps_clean_documents(spark, stages):
    docs, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = ([r.doc_id for r in labels if r.quality == q] for q in (1, 0))
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.35 * len(bad)


def test_exact_stage(stages):
    docs, after = stages[1]
    least = {}
    for r in docs.collect():
        least[normal(r.text)] = min(r.doc_id, least.get(normal(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())


def test_near_stage(stages):
    docs, after = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _, root in brute_components(rows, 5, 80, 100) if i == root]


def test_mix_stage(stages):
    docs, after = stages[3]
    plan = {r.doc_id: r.copies for r in mix_sources(docs).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in after.collect()) == plan


def test_encode_stage(stages):
    docs, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = after.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
