"""Conflict-constrained best-fit packing of documents into sequences of ``CAPACITY`` words.

A document is cut into full pieces, each a bin of its own, and a rest. The rests, longest first, go to the tightest
bin that has room and no conflict: a bin holds one document of a source and one of a duplicate cluster at most
(near copies as ``minhash.near_duplicates`` finds them; without any given, equal texts are one). Bins stand in residual order and carry bitmaps of their sources
and clusters; from the first residual that is large enough the search goes on through its successors until a
compatible bin is found, and skips a residual all of whose bins hold the document's source or cluster.

Scale: rows without text are dealt by a hash of doc_id, cluster and place into shards of about ``SHARD`` documents, packed
one by one, so a hot source or cluster, or one row many times, is spread evenly and a shard's memory is bounded.

Null or blank text: one piece of length 0. Null doc_id and null source: packed; null is a source of its own.
Repeated rows: packed one by one, apart as one cluster. Ties: by doc_id, then cluster. Empty table: no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import of_columns, table
from .minhash import near_duplicates
from .mixing import size_of

CAPACITY = 2048
SHARD = 4096


class _Level:
    """The bins of one residual: their numbers in order, and how many hold each source and cluster."""

    __slots__ = ("bins", "clusters", "sources")

    def __init__(self):
        self.bins: list[int] = []
        self.sources: dict[int, int] = {}
        self.clusters: dict[int, int] = {}


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) for each (length, source, cluster), taken in the order given; sources and clusters are
    small non-negative ints."""
    levels: dict[int, _Level] = {}
    order: list[int] = []  # residuals that have bins, ascending
    sources: list[int] = []  # bitmaps of each bin
    clusters: list[int] = []
    held: list[list[tuple[int, int]]] = []
    out = []

    def put(b: int, residual: int, sign: int) -> None:
        level = levels.get(residual)
        if level is None:
            level = levels[residual] = _Level()
            insort(order, residual)
        if sign > 0:
            insort(level.bins, b)
        else:
            del level.bins[bisect_left(level.bins, b)]
        for s, c in held[b]:
            level.sources[s] = level.sources.get(s, 0) + sign
            level.clusters[c] = level.clusters.get(c, 0) + sign
        if not level.bins:
            del levels[residual]
            del order[bisect_left(order, residual)]

    for length, s, c in items:
        found = -1
        for residual in order[bisect_left(order, length) :]:
            level = levels[residual]
            n = len(level.bins)
            if level.sources.get(s, 0) == n or level.clusters.get(c, 0) == n:
                continue
            found = next((b for b in level.bins if not (sources[b] >> s & 1 or clusters[b] >> c & 1)), -1)
            if found >= 0:
                put(found, residual, -1)
                break
        if found < 0:
            found, residual = len(held), capacity
            held.append([])
            sources.append(0)
            clusters.append(0)
        out.append((found, capacity - residual))
        held[found].append((s, c))
        sources[found] |= 1 << s
        clusters[found] |= 1 << c
        put(found, residual - length, 1)
    return out


def _by_text():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_copies(docs: DataFrame) -> DataFrame:
    """same, near: the hash of each text that has near copies, and the least of those of its component."""
    found = near_duplicates(of_columns(docs, "text").select(_by_text().alias("doc_id"), "text"))
    return found.filter("component_id != doc_id").select(F.col("doc_id").alias("same"), F.col("component_id").alias("near")).dropDuplicates(["same"])


def pack(docs: DataFrame, cluster: str | None = None, capacity: int = CAPACITY, shard: int = SHARD, copies: DataFrame | None = None) -> DataFrame:
    """doc_id, source, piece (from 0), start (word of the document), length, bin, bin_start (word of the bin).
    copies: what ``near_copies`` found, where no cluster is given."""
    d = of_columns(docs, *dict.fromkeys(["doc_id", "source", "text", *([cluster] if cluster else [])]))
    group = F.xxhash64(F.col(cluster)) if cluster else _by_text()
    shards = max(1, -(-docs.count() // shard))
    light = d.select("doc_id", "source", size_of().alias("size"), group.alias("cluster"), F.monotonically_increasing_id().alias("row"))
    if copies is not None:
        light = light.join(copies, light.cluster == copies.same, "left").withColumn("cluster", F.coalesce("near", "cluster"))
    light = light.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "row"), F.lit(shards)))

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in group for r in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True)]
        if not rows:
            return
        number: tuple[dict, dict] = {}, {}
        rows.sort(key=lambda r: (-(r[2] % capacity), r[0] is None, r[0] or 0, r[3], r[1] or ""))
        rests = [r for r in rows if r[2] % capacity or not r[2]]
        places = best_fit([(r[2] % capacity, number[0].setdefault(r[1], len(number[0])), number[1].setdefault(r[3], len(number[1]))) for r in rests], capacity)
        base, out = rows[0][4] << 32, []
        for r, (b, at) in zip(rests, places, strict=True):
            out.append((r[0], r[1], r[2] // capacity, r[2] // capacity * capacity, r[2] % capacity, base + b, at))
        bins = 1 + max((b for b, _ in places), default=-1)
        for r in rows:
            for k in range(r[2] // capacity):
                out.append((r[0], r[1], k, k * capacity, capacity, base + bins, 0))
                bins += 1
        for i in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + (1 << 16)], strict=True), types, strict=True)], names)

    names = ["doc_id", "source", "piece", "start", "length", "bin", "bin_start"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return light.select(F.col("doc_id").cast("long"), "source", "size", "cluster", "shard").groupBy("shard").applyInArrow(run, "doc_id long, source string, piece long, start long, length long, bin long, bin_start long")


def op4_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, copies=near_copies(docs))
