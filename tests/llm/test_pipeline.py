"""The pipeline, stage by stage, on odd rows and against brute force."""

import collections

import corpus_pipeline as P
from millrace.llm import minhash, packing, secret_scan, toxicity
from millrace.llm.common import table


def stages(spark, where):
    docs, out = table(spark, where, "documents"), []
    for _, f in P.STAGES:
        docs = f(spark, docs, where).cache()
        out.append(docs)
    return out


def test_columns_and_effects(spark, odd_dir, odd_rows):
    clean, kept, safe, mixed, packed = stages(spark, odd_dir)
    for d in (clean, kept, safe, mixed):
        assert tuple(d.columns) == P.COLUMNS
    docs = table(spark, odd_dir, "documents")
    flagged = toxicity.score(docs, toxicity.train(docs, table(spark, odd_dir, "labels"))).filter("predicted = 1").count()
    assert clean.count() == len(odd_rows) - flagged
    ids = [r.doc_id for r in kept.collect()]
    comp = {r.doc_id: r.component_id for r in minhash.near_duplicates(clean).collect()}
    assert {d for d in ids if d is not None} == {c for c in comp.values() if c is not None}
    texts = {r.doc_id: r for r in safe.collect()}
    before = {r.doc_id: r for r in kept.collect()}
    assert set(texts) == set(before)
    for d, r in texts.items():
        assert (r.text is None) == (before[d].text is None)
        if r.text != before[d].text:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
    assert secret_scan.find_secrets(safe).filter("size(base) > 0").count() == 0
    size = {r.doc_id: len((r.text or "").encode().split()) for r in safe.collect()}
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    twice = {None, 203}  # ids of several rows
    assert all(1 <= n <= 3 and size[d] for d, n in taken.items() if d not in twice)
    words = collections.Counter()
    bins = collections.defaultdict(list)
    for r in packed.collect():
        words[r.doc_id] += r.length
        bins[r.bin].append(r)
    assert {d: n for d, n in words.items() if d not in twice} == {d: size[d] * n for d, n in taken.items() if d not in twice}
    assert sum(words.values()) == sum(len((r.text or "").encode().split()) for r in mixed.collect())
    for rows in bins.values():
        assert sum(r.length for r in rows) <= packing.CAPACITY
        assert len({r.source for r in rows}) == len(rows) and len({r.doc_id for r in rows}) == len(rows)


def test_run_equals_the_stages(spark, small_dir):
    last = stages(spark, small_dir)[-1]
    assert sorted(map(repr, P.run(spark, small_dir).collect())) == sorted(map(repr, last.collect()))


def test_two_runs_at_once(spark, small_dir):
    """Each deletes what it made itself."""
    from multiprocessing.pool import ThreadPool

    with ThreadPool(2) as pool:
        one, two = pool.map(lambda _: sorted(map(repr, P.run(spark, small_dir).collect())), range(2))
    assert one == two and one


def test_empty(spark, empty_dir):
    assert P.run(spark, empty_dir).collect() == []
