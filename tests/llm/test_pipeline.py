"""The pipeline on the smallest tables, stage by stage, against brute force where a stage has one."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_text_operators import expected_kept, word_list

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from arcweave.runtime import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], DATA), name))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_substring_stage(stages):
    import hashlib

    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i: h for i, _, _, h in expected_kept(rows)}
    got = {r.doc_id: hashlib.sha256(" ".join(word_list(r.text)).encode()).hexdigest() for r in stages[3].collect()}
    assert got == want


def test_later_stages_lose_nothing(stages):
    ids = {r.doc_id for r in stages[3].collect()}
    assert {r.doc_id for r in stages[4].collect()} == ids == {r.doc_id for r in stages[5].collect()}
    assert stages[4].count() == stages[5].count()
    n = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in stages[3].collect()}
    assert all(n[r.doc_id] == r.n_tokens for r in stages[5].collect())
