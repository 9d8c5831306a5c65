"""The registered corpus queries and the pipeline."""

import collections

import pytest
from check import difference, tables_of
from conftest import plan_of

import corpus_pipeline
from fieldmosaic.llm import ngram_join, quality_rules, queries
from fieldmosaic.llm.common import documents as read

from .test_documents import dedup_by_hand
from .test_tokens import packs_of

NATIVE = ("op2_url_lists", "op4_quality_rules", "op7_line_dedup")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_check(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert difference(got, tables_of(small).execute(queries.oracle_sql()[name]).df()) is None and len(got)


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, small, name):
    plan = plan_of(queries.QUERIES[name](spark, small))
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_stages_against_brute_force(spark, small):
    docs = read(spark, small)
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{queries.new_path(spark, name)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.collect()
    kept = {r.doc_id for r in quality_rules.apply_rules(read(spark, small)).where("kept").collect()}
    assert {r.doc_id for r in rows["quality_rules"]} == kept
    assert {r.doc_id for r in rows["toxicity"]} < kept
    expected = dedup_by_hand([(r.doc_id, r.text) for r in rows["toxicity"]])
    assert {r.doc_id: r.text for r in rows["line_dedup"]} == expected
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"])
    groups = ngram_join.brute_force(expected)
    assert {r.doc_id for r in rows["ngram_join"]} == {c for _, c in groups.values()}
    assert {r.doc_id for r in rows["packing"]} == {r.doc_id for r in rows["ngram_join"]}
    assert all(sum(n for _, n in p) <= 4096 for p in packs_of(rows["packing"]).values())
    again = corpus_pipeline.run(spark, small).collect()
    assert collections.Counter(r.doc_id for r in again) == collections.Counter(r.doc_id for r in rows["packing"])
