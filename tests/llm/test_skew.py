"""Shared ids, hot buckets and mass copies."""

import collections
import hashlib

import numpy as np
import pytest

from millrace.llm import common, context_tree, fingerprint, language_id, media, minhash, mixing, packing, secret_scan, toxicity


def groups(rows):
    """The row numbers of each component by plain comparison of all pairs of texts; a blank text is alone."""
    def shingles(x):
        w = (x or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) if w else frozenset()

    sets = [shingles(x) for _, x in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if n and 100 * n >= 75 * (len(a) + len(b) - n):
                x, y = comp[i], comp[j]
                comp = [y if c == x else c for c in comp]
    out = collections.defaultdict(list)
    for k, c in enumerate(comp):
        out[c].append(k)
    return list(out.values())


def linked(rows):
    """The least id of each row's component."""
    out = {}
    for g in groups(rows):
        out |= dict.fromkeys(g, min(rows[k][0] for k in g))
    return [out[k] for k in range(len(rows))]


def words(rng, n, tag):
    return [f"{tag}{int(x)}" for x in rng.integers(0, 10**9, n)]


def test_op7_rows_that_share_an_id(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(0, 40, 4):
        a, b = words(rng, 100, "a"), words(rng, 100, "b")
        near = lambda x: " ".join([*x[:50], "changed", *x[51:]])
        rows += [(g + 1, " ".join(a)), (g + 1, " ".join(b)), (g + 2, near(a)), (g + 3, near(b)), (g + 3, " ".join(words(rng, 30, "c"))), (g + 1, " ".join(a)), (g + 2, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == collections.Counter((i, c) for (i, _), c in zip(rows, linked(rows)))
    keyed = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, key long")
    kept = {r.key for r in minhash.near_duplicates(keyed, key="key").filter("kept").collect()}
    assert kept == {min(g, key=lambda k: (rows[k][0], k)) for g in groups(rows)}


def test_op7_twenty_thousand_texts_in_a_bucket(spark, monkeypatch):
    """Texts that share a template but don't link, with some near copies among them that only a contested bucket finds."""
    monkeypatch.setattr(minhash, "BLOCK", 512)
    rng = np.random.default_rng(2)
    texts = 20_000
    sk = rng.integers(0, 256, (texts, minhash.T)).astype(np.uint8)
    sk[:, : minhash.ROWS] = 7  # one band in common
    pairs = [(i, i + 1) for i in range(0, 400, 2)]
    for i, j in pairs:
        sk[j, minhash.ROWS :] = sk[i, minhash.ROWS :]
        sk[j, rng.choice(np.arange(minhash.ROWS, minhash.T), 40, replace=False)] = 1
    import pyarrow as pa

    found = set()
    side, comp, band = np.full(2048, 2), np.arange(2048), np.zeros(2048, np.int64)
    for i, js, _ in minhash._candidates(side, comp, sk[:2048], band):
        found |= {(min(i, int(j)), max(i, int(j))) for j in js}
    assert found == set(pairs)
    left = np.concatenate([np.zeros(1024, int), np.ones(1024, int)])
    split = np.concatenate([sk[0:2048:2], sk[1:2048:2]])
    found = {(i, int(j)) for i, js, _ in minhash._candidates(left, comp, split, band) for j in js}
    assert found == {(i // 2, 1024 + i // 2) for i, _ in pairs}
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(2048, np.int64)), pa.array(np.full(2048, 2, np.int32)), pa.array(comp), pa.array(comp), pa.array(band), pa.array(np.full(2048, 100_000)), minhash._fixed(sk[:2048])], ["grp", "side", "rep", "comp", "band", "n_shingles", "sketch"])
    out = list(minhash._contested(iter([batch])))
    assert all(x.num_rows * 100_000 * 8 <= 2 * minhash.PART_BYTES + 1_600_000 for x in out)
    assert sum(len(p.as_py()) // 8 for x in out for p in x.column(3)) == len(pairs)


def test_op7_template(spark, monkeypatch):
    """Buckets of several blocks, on real texts: each pair that links is found, however the buckets are cut."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PART_BYTES", 4096)
    rng = np.random.default_rng(3)
    template = words(rng, 120, "t")
    rows = []
    for k in range(300):
        own = words(rng, 60, "o")
        rows.append((k, " ".join(template + own)))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join([*template[:40], "x", *template[41:], *own])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], linked(rows)))


def test_local_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_columns_that_differ_by_case(spark):
    rows = [(i, 9, f"some words and more of them {i}", None, "en", "s", "other", 1) for i in range(8)]
    df = spark.createDataFrame(rows, "a long, b long, c string, d string, e string, f string, g string, h int").toDF("doc_id", "DOC_ID", "text", "Text", "lang", "source", "SOURCE", "n_chars")
    assert {r.doc_id for r in minhash.near_duplicates(df).collect()} == set(range(8))
    assert {r.source for r in packing.pack(df).collect()} == {"s"}
    assert {r.doc_id for r in common.placed(df, "Place", "doc_id", "text").collect()} == set(range(8))
    assert {r.size for r in mixing.mix_sources(df).collect()} == {7}
    assert {r.lang_pred for r in language_id.label(df, language_id.train(df)).collect()} == {"en"}
    assert len(secret_scan.find_secrets(df).collect()) == len(media.write_media(df).collect()) == 8
    assert len(toxicity.score(df, (np.zeros(toxicity.BUCKETS), -9.0)).collect()) == 8
    assert len(context_tree.score(df, context_tree.train(context_tree.of_columns(df, "doc_id", "text"))).collect()) == 8


def test_op4_one_row_very_often(spark):
    """Equal rows without an id or text don't gather in one shard."""
    row = spark.createDataFrame([(None, None, "s")], "doc_id long, text string, source string")
    docs = row.crossJoin(spark.range(100_000).select("id")).drop("id")
    got = packing.pack(docs).groupBy("bin").count().agg({"count": "max", "bin": "count"}).first()
    assert got["max(count)"] == 1 and got["count(bin)"] == 100_000
    per = packing.pack(docs).selectExpr("shiftright(bin, 32) AS shard").groupBy("shard").count().collect()
    assert len(per) == 25 and max(r["count"] for r in per) < 1.2 * packing.SHARD


def test_op3_ranges(spark, monkeypatch):
    """Any number of ranges gives the same rows: ties, nulls and repeated ids included."""
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(words(rng, int(rng.integers(0, 30)), "w"))) for i in rng.integers(-20, 60, 200)]
    rows += [(None, "no id"), (None, "no id either"), (3, None), (3, ""), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for n in (1, 2, 7, 40):
        out.append(sorted(map(repr, fingerprint.consecutive(docs, fingerprint._edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", n).collect())))
    assert len(out[0]) == len(rows)
    # rows of one id are ordered by text, so each has one next document
    low = -(1 << 63)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-(low if r[0] is None else r[0]), r[0] is None, r[1]))
    want = collections.Counter()
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        want[(i, len(x), hashlib.sha256((x[: len(x) - len(x) // 3] + y[: len(x) // 3]).encode()).hexdigest())] += 1
    got = fingerprint.consecutive(docs, fingerprint._edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", 7).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(x == out[0] for x in out)


def test_parts_are_placed_apart(spark):
    from pyspark.sql import functions as F

    for n in (1, 5, 64):
        d = spark.range(n * 10).select((F.col("id") % n).cast("int").alias("part"))
        d = d.repartitionById(n, "part")
        assert d.select("part", F.spark_partition_id().alias("at")).distinct().groupBy("at").count().filter("count > 1").count() == 0


def test_halving(spark):
    from pyspark.sql import functions as F

    for items in ([], [5], [1, 1, 4, 9], list(range(0, 100, 3))):
        d = spark.range(-2, 105).select("id", common.bisect_left(F.array(*[F.lit(x) for x in items]).cast("array<long>"), F.col("id")).alias("n"))
        assert all(r.n == sum(x < r.id for x in items) for r in d.collect())
