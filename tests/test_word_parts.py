"""Word vectors are learnt by more tasks when there are more rows."""

from millrace.operators import learning


def test_parts_grow_with_the_rows(spark, monkeypatch):
    told = []
    real = learning.Word2Vec
    monkeypatch.setattr(learning, "Word2Vec", lambda **how: told.append(how["numPartitions"]) or real(**how))
    monkeypatch.setattr(learning, "WORD_ROWS", 40)
    d = spark.range(100).selectExpr("id AS vec_id", "array('a', CAST(id % 3 AS STRING)) AS tokens", "true AS in_train")
    assert learning.word_vectors(d, size=4, rounds=2).count() == 100
    learning.word_vectors(d.limit(30), size=4, rounds=2)
    assert told == [3, 1]
