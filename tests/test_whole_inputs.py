"""Queries of the engine that must see whole texts and whole tables, and models of the full size."""

import pytest

from millrace.operators import learning
from millrace.plans import catalog


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    far = "word " * 40
    docs = [(7, far + "a deadlock", "en", "s", 1), (19, far + "cleanup", "en", "s", 1), (9003, "x", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3001, "F", "1-URGENT")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(3, 0, "user", far + "memory_leak")], "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def by_id(spark, where, name, column):
    return {r.doc_id: r[column] for r in catalog.QUERIES[name](spark, where).collect()}


def test_terms_far_into_a_message(spark, where):
    assert by_id(spark, where, "stage1_category", "category")[7] is not None
    assert by_id(spark, where, "stage2_reject", "rejected") == {7: False, 19: True, 9003: by_id(spark, where, "stage2_reject", "rejected")[9003]}


def test_pull_requests_of_late_orders(spark, where):
    assert by_id(spark, where, "pr_lookup", "pr_number")[9003] == 3001
    assert [r.doc_id for r in catalog.QUERIES["merged_only"](spark, where).collect()] == [9003]
    assert "PR #3001" in by_id(spark, where, "pr_details", "details")[9003]


def test_label_far_into_an_answer(spark, where):
    assert [r.label for r in catalog.QUERIES["llm_parse"](spark, where).collect()] == [1]
    assert [r.predicted for r in catalog.QUERIES["vote_mode"](spark, where).collect()] == [1]


def test_models_of_full_size(spark, monkeypatch):
    assert (learning.estimator("forest", 70, 10).getNumTrees(), learning.estimator("forest", 70, 10).getMaxDepth()) == (300, 30)
    assert (learning.estimator("logistic", 70, 10).getMaxIter(), learning.estimator("mlp", 70, 10).getMaxIter()) == (1000, 200)
    used = {}
    monkeypatch.setattr(learning, "predict", lambda *a, **how: used.update(how) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        catalog.QUERIES["forest_eval"](spark, "/root/testdata/sf0.001")
    assert used.get("trees", 300) == 300
