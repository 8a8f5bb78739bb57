"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        first = i // 3 * 3
        yield level[first:i], level[i + 1 : first + 3]
        i //= 3


def plain(rows):
    """rows: doc_id, source, lang, n_chars, text"""
    trees, sources = {}, sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        trees[s] = sorted(((r[0] is not None, r[0] or 0), leaf(r), r) for r in rows if r[1] == s)
    made = {s: levels([x[1] for x in t]) for s, t in trees.items()}
    top = levels([made[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, own, r) in enumerate(trees[s]):
            path = [*siblings(made[s], i), *siblings(top, k)]
            even = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
            x = leaf((*r[:4], r[4].replace("\n", ""))) if even and r[4] is not None else own
            for left, right in path:
                x = h(*left, x, *right)
            out.append((r[0], own, made[s][-1][0], top[-1][0], h(*[y for left, right in path for y in (*left, *right)]), x, x == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_odd_rows(spark, odd_dir, odd_rows):
    want = plain([(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows])
    assert got(merkle.op11_merkle_manifest(spark, odd_dir)) == want


def documents(rng, n, source):
    return [(i, source(i), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["a\nb", "plain", "", None, "\n\n"]) if rng.random() < 0.5 else f"line {i}\nnext") for i in range(n)]


@pytest.mark.parametrize("case", ["one", "two", "hot", "many sources", "same rows"])
def test_shapes(spark, tmp_path, case):
    rng = random.Random(4)
    rows = {
        "one": lambda: documents(rng, 1, lambda i: "s"),
        "two": lambda: documents(rng, 2, lambda i: ["a", None][i]),
        "hot": lambda: documents(rng, 2500, lambda i: "hot" if i % 3 else rng.choice(["é", "z", "Z", "", None])),
        "many sources": lambda: documents(rng, 900, lambda i: f"s{i}"),
        "same rows": lambda: [(7, "s", "en", 1, "x\ny")] * 50 + [(None, "s", None, None, None)] * 30,
    }[case]()
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, schema).select("*", F.lit(1).alias("g"), F.lit("x").alias("h"), F.lit(2).alias("block")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(merkle.op11_merkle_manifest(spark, str(tmp_path))) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 10, 27, 82, 100, 250])
def test_rounds_of_small_blocks(spark, n):
    """Blocks of nine nodes, so that a tree takes up to three rounds."""
    rows = [(i % 2, i // 2, h(str(i))) for i in range(n)]
    tree = merkle.Forest(spark.createDataFrame(rows, "source int, key int, h string"), "source", ("key",), "small", depth=2)
    roots = {r.g: r.root for r in tree.roots().collect()}
    paths = {(r.g, r.key): r for r in tree.paths().collect()}
    assert len(paths) == n
    for s in {r[0] for r in rows}:
        want = levels([r[2] for r in sorted(rows) if r[0] == s])
        assert roots[s] == want[-1][0]
        for i in range(len(want[0])):
            r = paths[s, i]
            assert r.h == want[0][i] and [(x.left, x.right) for x in r.path] == [("".join(a), "".join(b)) for a, b in siblings(want, i)]


def test_a_change_is_found_and_nothing_else(spark, tmp_path):
    rows = [(i, "s", "en", 3, "no line end" if i % 2 else "a\nb") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect():
        assert r.verified == (r.doc_id % 2 == 1 or zlib.crc32(str(r.doc_id).encode()) % 2 == 1)
