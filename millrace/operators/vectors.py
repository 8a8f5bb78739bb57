"""Vectors: splits, exact top-k retrieval, retrieval features, votes and detection metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 5
#: Bytes of vectors in a block.
BLOCK_BYTES = 32 << 20
TAU = 0.4
SAFE = 3


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a SHA-256 of parts joined by ':'."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def labelled(embeddings: DataFrame, seed: int = 42, ratio: float = 0.9, exact: bool = False) -> DataFrame:
    """vec_id, embedding (doubles), label4, project, in_train: by the hash itself, which gives the share on average, or by its rank (``exact``)."""
    rows = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (F.col("label") % 4).cast("int").alias("label4"), (F.col("vec_id") % 6).cast("int").alias("project"), (unit_hash(F.lit(seed), F.col("vec_id")) < ratio).alias("in_train"))
    return exact_split(rows.drop("in_train"), ratio, seed) if exact else rows


#: Rows of a slice of hashes that come to the driver to find the last one of a share.
FEW = 10_000


def exact_split(d: DataFrame, ratio: float = 0.9, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """``d`` with in_train: true for exactly floor(ratio * n) rows, those of least hash of seed and key, ties by key. Rows of one key go together.

    No order of all rows: counts by the hash's leading digits tell the slice in which the share ends, and that slice is divided again until
    it has ``FEW`` rows. What follows is a comparison for each row."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    hashed = d.select(h.alias("h"), F.col(key).alias("k"))
    left = int(hashed.count() * ratio)
    prefix, digits = "", 3
    while True:
        inside = hashed.filter(F.col("h").startswith(prefix))
        part = F.substring("h", 1, len(prefix) + digits)
        counts = inside.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # 4,096 rows at most
        if sum(r["n"] for r in counts) <= FEW or len(prefix) >= 60:
            break
        for r in counts:
            if r["n"] > left:
                prefix = r["p"]
                break
            left -= r["n"]
        else:
            return d.withColumn("in_train", F.lit(True))
    last = inside.orderBy("h", "k").limit(FEW).collect()[:left]
    if not last:
        return d.withColumn("in_train", h < prefix)
    return d.withColumn("in_train", (h < last[-1]["h"]) | ((h == last[-1]["h"]) & (F.col(key) <= last[-1]["k"])))


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: str) -> Column:
    return F.transform(v, lambda x: x / F.greatest(norm(F.col(v)), F.lit(1e-9)))


#: Blocks of a side that are made for the sake of more tasks, and rows that such a block has at least unless it is to be smaller.
MANY, FEW_ROWS = 8, 2048


def _blocks(n: int, width: int, block_bytes: int) -> int:
    """Blocks of a side of ``n`` rows: of ``block_bytes`` each, but ``MANY`` at most unless more are needed to keep within BLOCK_BYTES. A row is sent to
    every block of the other side, so that small blocks mustn't grow in number with the input."""
    rows = lambda size: max(1, size // (8 * max(width, 1)))
    return max(1, -(-n // rows(max(BLOCK_BYTES, block_bytes))), min(MANY, -(-n // min(FEW_ROWS, rows(block_bytes)))))


def _near_best(s: np.ndarray, k: int, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that may be among the k largest of their row, when values are off by half of ``margin`` at most. The k-th largest of maxima
    of sets of columns is no more than the k-th largest value."""
    n = s.shape[1]
    sets = n // 32
    if sets <= 4 * k:
        least = np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(s), -np.inf, s.dtype)
        rows, cols = np.nonzero((s >= (least - margin)[:, None]) & (s > -np.inf))
        return rows, cols
    tops = s[:, : sets * 32].reshape(len(s), 32, sets).max(axis=1)
    floor = (np.partition(tops, sets - k, axis=1)[:, sets - k] - margin)[:, None]
    r, c = np.nonzero((tops >= floor) & (tops > -np.inf))  # a set is looked into only if its maximum is among the best
    held = s[r[:, None], c[:, None] + sets * np.arange(32)]
    i, j = np.nonzero((held >= floor[r]) & (held > -np.inf))
    rest = s[:, sets * 32 :]
    over, at = np.nonzero((rest >= floor) & (rest > -np.inf))
    return np.r_[r[i], over], np.r_[c[i] + sets * j, at + sets * 32]


def _met(rows: DataFrame, cell: str, k: int, parts: int, apart: bool = False, by_project: bool = False, visits: np.ndarray | None = None) -> DataFrame:
    """The k best items of each query of a cell. rows: vec_id, embedding, label4, project, side (0 for queries, 1 for items), and the number of the ``cell``;
    with ``visits`` near too: which groups of items (columns) each group of queries (rows) meets.

    Products are taken in single precision and those that may be among the best again in double, each by itself, so that equal vectors have equal products.
    Of equal items of one project only the k of least id are met."""
    visits = None if visits is None else np.packbits(visits, axis=1)

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group)).combine_chunks()
        ids, side, label, project = (table[c].to_numpy() for c in ("vec_id", "side", "label4", "project"))
        flat = table["embedding"].combine_chunks().flatten().to_numpy()
        m = flat.reshape(len(ids), -1)
        have, ask = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(have) or not len(ask):
            return
        same = np.unique(np.ascontiguousarray(m[have]).view(f"V{m.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel() if m.shape[1] else np.zeros(len(have), int)
        order = np.lexsort((ids[have], same, project[have]))
        runs = np.flatnonzero(np.r_[True, (np.diff(same[order]) != 0) | (np.diff(project[have][order]) != 0)])
        have = have[order[np.arange(len(order)) - np.repeat(runs, np.diff(np.r_[runs, len(order)])) < k]]
        ask = ask[np.argsort(project[ask], kind="stable")]
        size = np.sqrt((m * m).sum(1))
        single = 1e-12 < size.max() < 1e15
        kind, unit = (np.float32, 2.0**-23) if single else (np.float64, 2.0**-52)

        def best(ask: np.ndarray, have: np.ndarray) -> Iterator[pa.RecordBatch]:
            vectors, kinds, far = m[have].astype(kind).T, project[have], size[have].max()
            step = max(1, (4 << 20) // len(have))
            names = np.unique(kinds)
            for i in (ask[j : j + step] for j in range(0, len(ask), step)):
                s = m[i].astype(kind) @ vectors
                margin = (2 * (m.shape[1] + 8) * unit * (size[i] * far + 1e-30)).astype(kind)
                if apart:
                    for x in np.unique(project[i]):
                        s[slice(*np.searchsorted(project[i], [x, x + 1])), slice(*np.searchsorted(kinds, [x, x + 1]))] = -np.inf
                for lo, hi in [np.searchsorted(kinds, [x, x + 1]) for x in names] if by_project else [(0, len(have))]:
                    r, c = _near_best(s[:, lo:hi], k, margin)
                    c = have[c + lo]
                    exact = np.concatenate([np.einsum("ij,ij->i", m[i[r[j : j + 65536]]], m[c[j : j + 65536]]) for j in range(0, len(r), 65536)] or [np.zeros(0)])
                    order = np.lexsort((ids[c], -exact, r))
                    r, c, exact = r[order], c[order], exact[order]
                    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c, exact = r[keep], c[keep], exact[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i][r], ids[c], exact, label[c], project[c])], ["vec_id", "neighbour", "sim", "neighbour_label", "p_"])

        if visits is None:
            yield from best(ask, have)
            return
        near = table["near"].to_numpy()
        for h in np.unique(near[ask]):
            some = have[np.unpackbits(visits[h])[near[have]] == 1]
            if len(some):
                yield from best(ask[near[ask] == h], some)

    # a cell is much work whatever its bytes, so that each is a task of its own
    return rows.repartitionById(max(1, parts), cell).groupBy(cell).applyInArrow(run, "vec_id long, neighbour long, sim double, neighbour_label int, p_ int")


def top_k(queries: DataFrame, items: DataFrame, k: int = K, apart: bool = False, by_project: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, rank, neighbour, sim, neighbour_label, p_: the k items of largest inner product for each query, ties by id.
    apart: only items of other projects than the query's. by_project: the k best among the items of each project (p_).

    Exact. Both sides are dealt into blocks (``_blocks``); two blocks meet in one task as a matrix
    product and leave k rows for each query, and the best of these are taken. A task holds two blocks, whatever the input. By project, a block
    of items holds few projects, since a cell leaves k rows for each."""
    spark, width = queries.sparkSession, queries.select(F.max(F.size("embedding"))).first()[0] or 1

    def dealt(d: DataFrame, side: int) -> tuple[DataFrame, int]:
        if side and by_project:
            each = [(r["project"], r["n"]) for r in d.groupBy("project").agg(F.count("*").alias("n")).collect()]  # a row for each project
            starts = np.cumsum([0] + [n for _, n in each])
            n = _blocks(int(starts[-1]), width, block_bytes)
            at = F.broadcast(spark.createDataFrame([(p, int(s), c) for (p, c), s in zip(each, starts)], "project_ int, start_ long, n_ long"))
            d = d.join(at, F.col("project").eqNullSafe(F.col("project_")))
            place = F.col("start_") + F.pmod(F.xxhash64("vec_id", F.lit(side)), F.lit(1 << 30)) / float(1 << 30) * F.col("n_")
            block = F.least(F.floor(place * n / max(int(starts[-1]), 1)), F.lit(n - 1)).cast("int")
        else:
            n = _blocks(d.count(), width, block_bytes)
            block = F.pmod(F.xxhash64("vec_id", F.lit(side)), F.lit(n)).cast("int")
        return d.select("vec_id", "embedding", "label4", "project", F.lit(side).alias("side"), block.alias("block")), n

    (q, nq), (t, nt) = dealt(queries, 0), dealt(items, 1)
    q = q.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nt - 1)), lambda i: F.col("block") * nt + i)))
    t = t.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nq - 1)), lambda i: i * nt + F.col("block"))))

    pairs = _met(q.unionByName(t).drop("block"), "cell", k, nq * nt, apart, by_project)
    w = W.partitionBy("vec_id", *(["p_"] if by_project else [])).orderBy(F.desc("sim"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Pivots of an index at most; their pairs are weighed on the driver and broadcast, some 16 MB.
PIVOTS = 1024


def pivots_of(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """Some of the items, one for each block that they would fill but ``PIVOTS`` at most, by a hash of their ids."""
    n, width = items.agg(F.count("*"), F.max(F.size("embedding"))).first()
    count = min(PIVOTS, max(1, -(-n * 8 * (width or 1) // block_bytes)))
    picked = items.select(F.xxhash64("vec_id").alias("h"), "vec_id", "embedding").orderBy("h", "vec_id").limit(count).collect()
    return np.array([r["embedding"] for r in picked], float).reshape(len(picked), width or 0)


def by_pivot(d: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``d`` with near, the nearest pivot, and away, the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots**2).sum(1)
        for b in batches:
            flat = b.column(b.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
            m = flat.reshape(b.num_rows, -1)
            near = np.argmin(square[None, :] - 2 * (m @ pivots.T), axis=1) if b.num_rows else np.zeros(0, int)
            away = np.sqrt(((m - pivots[near]) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away)], [*b.schema.names, "near", "away"])

    return d.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", near int, away double")


def write_index(items: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Vectors (vec_id, embedding, label4, project, in_train) with the pivot that each is nearest to, and the pivots."""
    pivots = pivots_of(items, block_bytes)
    by_pivot(items, pivots).write.mode("overwrite").parquet(f"{path}/items")
    rows = [(i, x.tolist()) for i, x in enumerate(pivots)]
    items.sparkSession.createDataFrame(rows, "near int, embedding array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")


def search(queries: DataFrame, path: str, k: int = K, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, int]]:
    """What ``top_k`` gives, from an index, without meeting every block: the neighbours, and how many of the pairs of groups there are and were met.

    Queries and items are grouped by their nearest pivot. An inner product is at most the pivots' own plus what the groups' radii allow, so that a
    group of items can be passed over if that is below the k-th best that each query of a group has. The first round meets the groups of highest
    bounds, the second those that the first can't rule out. Blocks are made of groups and meet as in ``top_k``."""
    spark = queries.sparkSession
    items = spark.read.parquet(f"{path}/items")
    stored = spark.read.parquet(f"{path}/pivots").orderBy("near").collect()  # PIVOTS rows at most
    if not stored:
        return top_k(queries, items, k), {"pairs": 0, "met": 0}
    pivots = np.array([r["embedding"] for r in stored], float)
    columns = ["vec_id", "embedding", "label4", "project"]
    asked = by_pivot(queries.select(*columns), pivots)

    def groups(d: DataFrame) -> dict[int, tuple[int, float]]:
        return {r["near"]: (r["n"], r["away"]) for r in d.groupBy("near").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}

    q, t = groups(asked), groups(items)
    own, other = sorted(q), sorted(t)
    r, big = np.array([q[h][1] for h in own]), np.array([t[g][1] for g in other])
    size = np.linalg.norm(pivots, axis=1)
    bound = pivots[own] @ pivots[other].T + size[own][:, None] * big[None, :] + size[other][None, :] * r[:, None] + r[:, None] * big[None, :] if own and other else np.zeros((len(own), len(other)))
    counts = np.array([t[g][0] for g in other])

    def blocks(groups: dict[int, tuple[int, float]]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """(group, first block, blocks) of each group: small ones share a block, large ones have several; and which blocks hold which groups."""
        n = sum(x[0] for x in groups.values())
        rows = -(-n // _blocks(n, pivots.shape[1], block_bytes))
        placed, block, held = [], 0, 0
        for g in sorted(groups):
            parts = max(1, -(-groups[g][0] // rows))
            if held and (held + groups[g][0] > rows or parts > 1):
                block, held = block + 1, 0
            placed.append((g, block, parts))
            block, held = (block, held + groups[g][0]) if parts == 1 else (block + parts, 0)
        return placed, np.array([[at <= b < at + parts for _, at, parts in placed] for b in range(block + 1)])

    (left_at, left_in), (right_at, right_in) = blocks(q), blocks(t)

    def met(visits: np.ndarray) -> DataFrame:
        """Groups share blocks, and blocks of which any groups meet share a cell; what doesn't meet is passed over there."""
        cells = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(*np.nonzero(left_in.astype(int) @ visits.astype(int) @ right_in.T.astype(int))))] if visits.size else []
        pairs = F.broadcast(spark.createDataFrame(cells, "a int, b int, cell int"))
        whole = np.zeros((len(pivots), len(pivots)), bool)
        whole[np.ix_(own, other)] = visits

        def side(d: DataFrame, placed: list, number: int, mine: str) -> DataFrame:
            at = F.broadcast(spark.createDataFrame(placed, "near int, at int, parts int"))
            block = F.col("at") + F.pmod(F.xxhash64("vec_id", F.lit(number)), F.col("parts")).cast("int")
            return d.select(*columns, "near").join(at, "near").withColumn(mine, block).join(pairs, mine).select(*columns, "near", "cell", F.lit(number).alias("side"))

        return _met(side(asked, left_at, 0, "a").unionByName(side(items, right_at, 1, "b")), "cell", k, len(cells), visits=whole)

    order = np.argsort(-bound, axis=1, kind="stable")
    first = np.zeros(bound.shape, bool)
    for i in range(len(own)):
        enough = int(np.searchsorted(np.cumsum(counts[order[i]]), k)) + 1
        first[i, order[i, : max(enough, 1)]] = True
    best = W.partitionBy("vec_id").orderBy(F.desc("sim"), "neighbour")
    one = met(first).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).persist()
    reached = one.groupBy("vec_id").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    least = asked.select("vec_id", "near").join(reached, "vec_id", "left").groupBy("near").agg(F.min(F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf"))).alias("least"))
    floor = {x["near"]: x["least"] for x in least.collect()}
    second = ~first & (bound * (1 + 1e-9) + 1e-9 >= np.array([floor[h] for h in own])[:, None])
    told = {"pairs": int(bound.size), "met": int(first.sum() + second.sum())}
    both = one.drop("rank").unionByName(met(second)) if second.any() else one.drop("rank")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), told


def retrieval_features(neighbours: DataFrame) -> DataFrame:
    """vec_id, share of each label among the neighbours, mean and maximum similarity; neighbours of no label don't count."""
    ok = neighbours.filter(F.col("neighbour_label").between(0, 3))
    share = [(F.count_if(F.col("neighbour_label") == i) / F.greatest(F.count("*"), F.lit(1))).alias(f"p{i}") for i in range(4)]
    return ok.groupBy("vec_id").agg(*share, F.avg("sim").alias("mean_sim"), F.max("sim").alias("max_sim"))


def feature_vector(vectors: DataFrame, features: DataFrame) -> DataFrame:
    """vec_id, features: vector, label shares, mean and maximum similarity; zeros where nothing was retrieved."""
    d = vectors.join(features, "vec_id", "left")
    rest = F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("p0", "p1", "p2", "p3", "mean_sim", "max_sim")])
    return d.select("vec_id", "label4", "project", "in_train", F.concat("embedding", rest).alias("features"))


def near_lists(neighbours: DataFrame) -> DataFrame:
    """vec_id, near: the neighbours of each vector as one array, nearest first, ties by id."""
    one = F.struct((-F.col("sim")).alias("away"), "neighbour", "neighbour_label", "p_")
    return neighbours.groupBy("vec_id").agg(F.array_sort(F.collect_list(one)).alias("near"))


def list_features(near: Column, k: int = K) -> Column:
    """What ``retrieval_features`` gives, as an array, from the first ``k`` of a list of ``near_lists``; zeros where nothing was retrieved."""
    ok = F.filter(F.slice(near, 1, k), lambda x: x["neighbour_label"].between(0, 3))
    n = F.greatest(F.size(ok), F.lit(1))
    labels = F.transform(ok, lambda x: x["neighbour_label"])
    share = [(F.size(labels) - F.size(F.array_remove(labels, i))) / n for i in range(4)]
    mean = F.aggregate(ok, F.lit(0.0), lambda a, x: a - x["away"]) / n
    return F.array(*[F.coalesce(c, F.lit(0.0)) for c in (*share, mean, -F.get(ok, 0)["away"])])


#: Rows of a part that is read again and again, where parts are more than twice the threads.
PART_ROWS = 65_536


def few_parts(d: DataFrame, rows: int) -> DataFrame:
    """``d``, of so many rows, in parts that are worth a task each time it is read: after a shuffle there are as many parts for few rows as for many."""
    return d.coalesce(max(2 * d.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def majority(votes: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """key, predicted: the most frequent vote; among equals the one seen first."""
    g = votes.groupBy(key, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = W.partitionBy(key).orderBy(F.desc("n"), "first")
    return g.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(key, F.col(vote).alias("predicted"))


def threshold(p: str | Column, tau: float = TAU) -> Column:
    """The first class of largest probability, or safe if that is below ``tau``."""
    c = F.col(p) if isinstance(p, str) else p
    return F.when(F.array_max(c) < tau, SAFE).otherwise(F.array_position(c, F.array_max(c)) - 1).cast("int")


def detection_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of faults (labels below 3); a fault taken for another counts nowhere."""
    t, p = F.col(truth), F.col(predicted)
    g = df.groupBy(*(by or [])).agg(F.count_if((t < SAFE) & (p == t)).alias("tp"), F.count_if((t == SAFE) & (p < SAFE)).alias("fp"), F.count_if((t < SAFE) & (p == SAFE)).alias("fn"))
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    return g.select(*(by or []), "tp", "fp", "fn", F.round(precision, 3).alias("precision"), F.round(recall, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def per_category(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label 0 to 3, correct, total, pct; labels that don't occur have zeros."""
    aggs = [x for i in range(4) for x in (F.count_if((F.col(truth) == i) & (F.col(predicted) == i)).alias(f"c{i}"), F.count_if(F.col(truth) == i).alias(f"t{i}"))]
    row = df.agg(*aggs)
    out = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.col(f"c{i}").alias("correct"), F.col(f"t{i}").alias("total")) for i in range(4)])).alias("x")).select("x.*")
    return out.withColumn("pct", F.round(100.0 * F.col("correct") / F.greatest("total", F.lit(1)), 1))


def bootstrap_mean(folds: DataFrame, value: str, ordinal: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean of a small relation's values and the 2.5 and 97.5 percentiles of resampled means. Draws are hashes."""
    n = folds.count()
    draws = folds.sparkSession.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    draws = draws.withColumn("pick", F.floor(unit_hash(F.lit(seed), F.col("b"), F.col("j")) * n))
    means = draws.join(folds.select(F.col(ordinal).alias("pick"), F.col(value).alias("v")), "pick").groupBy("b").agg(F.avg("v").alias("m"))
    ci = means.agg(F.round(F.expr("percentile(m, 0.025)"), 6).alias("lo"), F.round(F.expr("percentile(m, 0.975)"), 6).alias("hi"))
    return folds.agg(F.round(F.avg(value), 6).alias("mean")).join(ci)

