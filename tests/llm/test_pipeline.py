"""The pipeline on a small fixture: each stage against brute force, and what run() returns."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratavox.llm import registry
from stratavox.llm.tables import settle

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "x", 0), (9002, "123 %%", None, "x", 6), (None, "ordinary the and of with that was", None, "x", 1)], docs.schema)
    out = [settle(docs.unionByName(extra), "fixture")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], DATA), "stage"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256"]


def test_languages_reject_only_what_has_none(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert before.keys() - after.keys() == {9001, 9002}
    assert stages[1].where("lang IS NULL").count() == 0


def test_one_of_each_group_stays(stages):
    from tests.llm.test_llm_operators import joined

    before = {i: t for i, t in texts(stages[1]).items() if i is not None}
    groups = joined(sorted(before.items()), 5, 80)
    assert texts(stages[2]).keys() == {i for i, (_, root) in groups.items() if i == root} | {None}


def test_benchmark_passages_go(spark, stages):
    from tests.llm.test_llm_operators import marked

    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    before = list(texts(stages[2]).items())
    clean = {i for (i, _), m in zip(before, marked([t for _, t in before], items, 10), strict=True) if not m[1]}
    assert texts(stages[3]).keys() == clean


def test_secrets_are_replaced(stages):
    from tests.llm.test_llm_operators import base_spans

    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert not base_spans(after[i])
        if "[SECRET]" not in after[i]:
            assert after[i] == t
    assert stages[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_tokens(stages):
    assert stages[5].count() == stages[4].count() and stages[5].where(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
