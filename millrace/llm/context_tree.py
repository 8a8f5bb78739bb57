"""Language-model scores by context-tree weighting over bytes, and a unigram base.

Text: words in lower case (A-Z alone), one blank between two, then one end symbol; contexts before a text are end
symbols. Each byte is eight binary decisions; every decision has its own tree of contexts of 0 to ``DEPTH``
bytes. A node mixes the Krichevsky-Trofimov estimate of its own counts, by half, with the product over its
children; the posterior of these mixtures, given all training texts, is the frozen model. A context is a node
if it holds at least ``LEAST`` training bytes, however large the corpus, so nodes grow with it; what a node's other
contexts saw is one further child, so no count is lost.

Base: log10((c + 1) / (N + V + 1)) summed over the tokens. Words that hold at least 1/``COMMON`` of all training
tokens (at most ``COMMON`` of them) are looked up in memory; counts of all others come by an exact join.

Scale: two passes over the texts. Tasks merge counts before the shuffle, which grows with the corpus, not with
its square. Subtrees below the nearest ``CUT`` bytes are built where their counts lie, as the binary nodes that their grams
reach, and leave sums for each context of CUT - 1 bytes (at most 65,536) to the driver, which mixes the rest; each gram
then gets its log probability. Grams that
hold at least 1/``GRAMS`` of all bytes (at most ``GRAMS`` of them) are looked up in memory, all others by an exact join,
as words are. Words are keyed by 64-bit hashes.

Null or blank text: the end alone. Null doc_id: counts as the empty id. Repeated rows: each is learnt from and
scored. No training texts: every byte has probability 1/256 and N, V are 0. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, column, crc_mod, of_columns, pieces, save, table, text_words, through

DEPTH = 5
LEAST = 2
CUT = 3
#: Grams of whole subtrees that are built at once.
RUN = 30_000
ROWS_AT_ONCE = 2048
COMMON = 1 << 22
GRAMS = 1 << 23
END = 10
END_KEY = 1
HOLD = 3 << 20


def byte_stream(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts with DEPTH end symbols before and one after each, and where each begins (n+1 offsets)."""
    n, d = len(w.at) - 1, len(w.start)
    size = w.end - w.start + 1
    count = np.diff(w.at)
    lengths = np.concatenate([[0], np.cumsum(size)])
    own = lengths[w.at[1:]] - lengths[w.at[:-1]]
    total = own + DEPTH + (count == 0)
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.full(int(at[-1]), END, np.uint8)
    if d:
        doc = np.repeat(np.arange(n), count)
        to = at[doc] + DEPTH + lengths[:-1] - lengths[w.at[doc]]
        gap = np.repeat(to - w.start, size - 1)
        inside = np.ones(int((size - 1).sum()), np.int64)
        inside[0] = w.start[0]
        step = np.cumsum(size - 1)[:-1]
        inside[step] = w.start[1:] - w.end[:-1] + 1
        source = np.cumsum(inside)
        out[source + gap] = w.data[source]
        ends = to + size - 1
        last = np.zeros(d, bool)
        last[w.at[1:][count > 0] - 1] = True
        out[ends[~last]] = 32
    return out, at


def grams(stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes with their contexts (nearest byte in the low bits), without the padding, and text offsets."""
    n = len(stream)
    key = stream.astype(np.int64)
    for k in range(1, DEPTH + 1):
        key[k:] |= stream[: n - k].astype(np.int64) << (8 * k)
    real = np.ones(n, bool)
    real[(at[:-1][:, None] + np.arange(DEPTH)).reshape(-1)] = False
    return key[real], at - DEPTH * np.arange(len(at))


class _Counter:
    def __init__(self):
        self.keys, self.ns, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.put(keys[cut], np.diff(np.append(cut, len(keys))))

    def put(self, keys: np.ndarray, ns: np.ndarray) -> None:
        self.keys.append(keys)
        self.ns.append(ns)
        self.held += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, ns = np.concatenate(self.keys or [np.zeros(0, np.int64)]), np.concatenate(self.ns or [np.zeros(0, np.int64)])
        self.__init__()
        order = np.argsort(keys, kind="stable")
        keys, ns = keys[order], ns[order]
        if not len(keys):
            return keys, ns
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[cut], np.add.reduceat(ns, cut)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = [_Counter() for _ in range(3)]  # words and grams that are learnt, grams that are not

    def rows(kind: int, keys: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
        n = ns.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), min(kind, 1), np.int32)), pa.array(keys), pa.array(n if kind < 2 else 0 * n), pa.array(n)], ["kind", "key", "n", "every"])

    for batch in batches:
        learnt = column(batch, "learnt")
        for part, kinds in ((batch.filter(learnt), (0, 1)), (batch.filter(pc.invert(learnt)), (2,))):
            for p in pieces(part):
                w = text_words(p, hashed=0 in kinds)
                if 0 in kinds:
                    counters[0].add(np.append(w.hash.view(np.int64), np.full(p.num_rows, END_KEY, np.int64)))
                counters[kinds[-1]].add(grams(*byte_stream(w))[0])
                for kind in kinds:
                    if counters[kind].held > HOLD:
                        keys, ns = counters[kind].merged()
                        if len(keys) > HOLD // 2:
                            yield rows(kind, keys, ns)
                        else:
                            counters[kind].put(keys, ns)
    for kind in range(3):
        yield rows(kind, *counters[kind].merged())


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    series = (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _bits(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary nodes, level by level, from counts of the 256 bytes."""
    zeros, ones, level = [], [], n
    while level.shape[1] > 1:
        zeros.insert(0, level[:, 0::2])
        ones.insert(0, level[:, 1::2])
        level = level[:, 0::2] + level[:, 1::2]
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def _by_rows(f, n: np.ndarray) -> np.ndarray:
    """f over runs of rows, so that temporaries stay small."""
    return np.concatenate([f(n[i : i + ROWS_AT_ONCE]) for i in range(0, max(len(n), 1), ROWS_AT_ONCE)])


def _evidence(n: np.ndarray) -> np.ndarray:
    def part(n: np.ndarray) -> np.ndarray:
        a, b = _bits(n.astype(np.float64))
        out, seen = np.zeros(a.shape), a + b > 0
        a, b = a[seen], b[seen]
        out[seen] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)
        return out

    return _by_rows(part, n)


def _estimate(n: np.ndarray) -> np.ndarray:
    def part(n: np.ndarray) -> np.ndarray:
        a, b = _bits(n.astype(np.float64))
        return ((b + 0.5) / (a + b + 1)).astype(np.float32)

    return _by_rows(part, n)


def _rows(p: np.ndarray) -> np.ndarray:
    """log10 of the 256 bytes' probabilities from those of a one at the 255 nodes."""

    def part(p: np.ndarray) -> np.ndarray:
        p = np.clip(p.astype(np.float64), 1e-7, 1 - 1e-7)
        out = np.zeros((len(p), 1))
        for j in range(8):
            q = p[:, (1 << j) - 1 : (2 << j) - 1]
            out = np.stack([out + np.log10(1 - q), out + np.log10(q)], 2).reshape(len(p), 2 << j)
        return out.astype(np.float32)

    return _by_rows(part, p)


def _last(keys: np.ndarray, n: int) -> np.ndarray:
    """The n nearest bytes of each key, which has 8 at most."""
    return keys if n > 7 else keys & ((1 << 8 * n) - 1)


def _before(keys: np.ndarray) -> np.ndarray:
    """The contexts of grams."""
    return keys >> 8 & ((1 << 56) - 1)


class Tree:
    """The nodes of the first depths. contexts: the sorted keys of each depth's nodes; first: the number of each depth's first
    row; table: log10 probabilities of the bytes in each row; acc, rem: the mixture so far and the weight that remains at the
    binary nodes of the last depth. A row of a node with children is that of its other contexts."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], inner: tuple[np.ndarray, np.ndarray] | None = None):
        """nodes: for each depth (gram keys, counts) of its nodes. inner: for each context of the last depth the
        counts and the evidence of children that are kept elsewhere."""
        self.contexts, counts = [], []
        for keys, ns in nodes:
            ctx, at = np.unique(_before(keys), return_inverse=True)
            self.contexts.append(ctx)
            counts.append(np.bincount(at * 256 + (keys & 255), ns, len(ctx) * 256).reshape(-1, 256))
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in self.contexts])])
        self.table = np.full((1, 256), -np.log10(256), np.float32)
        if not len(self.contexts[0]):
            return
        parents, others, weights = [None], [], []
        for d in range(len(counts) - 1):
            up = np.searchsorted(self.contexts[d], self.contexts[d + 1] & ((1 << 8 * d) - 1))
            parents.append(up)
            other = counts[d].copy()
            np.subtract.at(other, up, counts[d + 1])
            others.append(np.maximum(other, 0))
        others.append(np.maximum(counts[-1] - inner[0], 0) if inner else None)
        for d in range(len(counts) - 1, -1, -1):
            own = _evidence(counts[d])
            if others[d] is None:
                below = own
                weights.insert(0, np.float32(1))
                continue
            split = _evidence(others[d])
            if d == len(counts) - 1:
                split += inner[1]
            else:
                np.add.at(split, parents[d + 1], below)
            below = np.logaddexp(own, split) + np.log(0.5)
            weights.insert(0, np.exp(own + np.log(0.5) - below).astype(np.float32))
        rows, acc, rem = [], np.float32(0), np.float32(1)
        for d in range(len(counts)):
            a, r = (acc, rem) if d == 0 else (acc[parents[d]], rem[parents[d]])
            acc = a + r * weights[d] * _estimate(counts[d])
            rem = r * (1 - weights[d])
            rows.append(_rows(acc if others[d] is None else acc + rem * _estimate(others[d])))
        self.table, self.acc, self.rem = np.concatenate(rows), acc, rem

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of the deepest node of each key's context, -1 if none is here."""
        row = np.full(len(keys), -1)
        live = np.arange(len(keys))
        for d, ctx in enumerate(self.contexts):
            if not len(ctx) or not len(live):
                break
            want = keys[live] >> 8 & ((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(ctx, want), len(ctx) - 1)
            hit = ctx[at] == want
            live = live[hit]
            row[live] = self.first[d] + at[hit]
        return row

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte in its context."""
        return self.table[np.maximum(self.find(keys), 0), keys & 255]


_SMALL = 1 << 16
_HALVES: list[np.ndarray] = []


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov evidence of a zeros and b ones."""
    if not _HALVES:
        _HALVES.extend([log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(2 * _SMALL) + 1.0)])
    half, one = _HALVES
    if len(a) and max(a.max(), b.max()) >= _SMALL:
        return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)
    a, b = a.astype(np.int64), b.astype(np.int64)
    return half[a] + half[b] - np.log(np.pi) - one[a + b]


class _Binary:
    """The binary nodes at one bit of the bytes after all contexts of one depth: node of each key, one key of each node,
    zeros and ones there, and whether the context is a node of the tree."""

    def __init__(self, gram: np.ndarray, order: np.ndarray, ns: np.ndarray, bit: int):
        which = gram >> (8 - bit)
        start = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        self.node = np.empty(len(gram), np.int32)
        self.node[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(gram))))
        self.first = order[start]
        total = np.add.reduceat(ns, start)
        self.ones = np.add.reduceat(np.where(gram >> (7 - bit) & 1, ns, 0), start)
        self.zeros = total - self.ones
        self.on = np.ones(len(start), bool)


class Subtrees:
    """The nodes of CUT bytes and more, from all grams of their contexts; what no gram reaches is not kept."""

    def __init__(self, keys: np.ndarray, ns: np.ndarray, least: int):
        self.keys, self.ns = keys, ns
        self.levels: list[list[_Binary]] = []
        self.alive = []  # for each depth whether each key's context is a node
        for d in range(CUT, DEPTH + 1):
            gram = _last(keys, d + 1)
            order = np.argsort(gram)
            level = [_Binary(gram[order], order, ns[order], bit) for bit in range(8)]
            whole = level[0].zeros + level[0].ones >= least
            alive = whole[level[0].node]
            for x in level:
                x.on = alive[x.first]
            self.levels.append(level)
            self.alive.append(alive)
        below = [None] * 8
        for level, under in zip(self.levels[::-1], [None, *self.levels[:0:-1]]):
            for bit, x in enumerate(level):
                own = _kt(x.zeros, x.ones)
                x.estimate = (x.ones + 0.5) / (x.zeros + x.ones + 1)
                if under is None:
                    x.weight, x.other, below[bit] = np.ones(len(own)), x.estimate, own
                    continue
                y = under[bit]
                n, parent, on = len(own), x.node[y.first][y.on], y.on
                zeros = x.zeros - np.bincount(parent, y.zeros[on], n).astype(np.int64)
                ones = x.ones - np.bincount(parent, y.ones[on], n).astype(np.int64)
                split = _kt(zeros, ones) + np.bincount(parent, below[bit][on], n)
                x.other = (ones + 0.5) / (zeros + ones + 1)
                both = np.logaddexp(own, split) + np.log(0.5)
                x.weight, below[bit] = np.exp(own + np.log(0.5) - both), both
        self.below = below

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of CUT - 1 bytes, and for each the counts of bytes, those in nodes, and the nodes' evidence."""
        ctx, at = np.unique(self.keys >> 8 & ((1 << 8 * (CUT - 1)) - 1), return_inverse=True)
        n = len(ctx)
        spot, inside = at * 256 + (self.keys & 255), self.alive[0]
        out = np.zeros((n, 767))
        out[:, :256] = np.bincount(spot, self.ns, n * 256).reshape(-1, 256)
        out[:, 256:512] = np.bincount(spot[inside], self.ns[inside], n * 256).reshape(-1, 256)
        for bit, (x, below) in enumerate(zip(self.levels[0], self.below)):
            key = x.first[x.on]
            place = at[key] * 255 + (1 << bit) - 1 + ((self.keys[key] & 255) >> (8 - bit))
            out[:, 512:] += np.bincount(place, below[x.on], n * 255).reshape(-1, 255)
        return ctx, out

    def score(self, top: Tree) -> np.ndarray:
        """log10 probability of each key's byte in its context."""
        out = top.score(self.keys)
        live = np.flatnonzero(self.alive[0])
        if not len(live):
            return out
        byte = self.keys[live] & 255
        up = np.searchsorted(top.contexts[-1], self.keys[live] >> 8 & ((1 << 8 * (CUT - 1)) - 1))
        worth = np.zeros(len(live))
        for bit in range(8):
            column = (1 << bit) - 1 + (byte >> (8 - bit))
            acc, rem = top.acc[up, column].astype(np.float64), top.rem[up, column].astype(np.float64)
            p = acc
            for level, alive in zip(self.levels, self.alive):
                on, x = alive[live], level[bit]
                node = x.node[live]
                acc = np.where(on, acc + rem * x.weight[node] * x.estimate[node], acc)
                rem = np.where(on, rem * (1 - x.weight[node]), rem)
                p = np.where(on, acc + rem * x.other[node], p)
            p = np.clip(p, 1e-7, 1 - 1e-7)
            worth += np.log10(np.where(byte >> (7 - bit) & 1, p, 1 - p))
        out[live] = worth
        return out


def _context(depth: int):
    return F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by their context of CUT bytes, in runs of whole contexts."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        c = column(t, "ctx").to_numpy()
        return t, np.flatnonzero(c[1:] != c[:-1]) + 1

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= RUN:
            t, cuts = joined()
            i = 0
            while len(cuts := cuts[cuts > i]):
                j = int(cuts[max(np.searchsorted(cuts, i + RUN, "right") - 1, 0)])
                yield t.slice(i, j - i)
                i = j
            held.append(t.slice(i))
    if held:
        yield joined()[0]


def top_tree(rows: pa.Table, least: int) -> Tree:
    """The nodes of less than CUT bytes, from the sums for each context of CUT - 1 bytes."""
    ctx = rows["ctx"].to_numpy()
    sums = np.frombuffer(b"".join(rows["sums"].to_pylist()), np.float64).reshape(len(ctx), 767)
    keys = (ctx[:, None] << 8 | np.arange(256)).reshape(-1)
    own = sums[:, :256].reshape(-1)
    nodes = []
    for d in range(CUT):
        gram = keys & ((1 << 8 * (d + 1)) - 1)
        _, at = np.unique(gram >> 8, return_inverse=True)
        on = (own > 0) & (np.bincount(at, own, 1)[at] >= (least if d else 1))
        nodes.append((gram[on], own[on]))
    last = np.unique(nodes[-1][0] >> 8)
    order = np.argsort(ctx)
    picked = sums[order[np.searchsorted(ctx[order], last)]] if len(last) else np.zeros((0, 767))
    return Tree(nodes, (picked[:, 256:512], picked[:, 512:]))


def train(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, int, int]:
    """The table of grams (key, every, score), that of token counts (key, n), N and V. The model is that of the texts
    of ``docs``, of those with ``learnt`` if there is such a column; only grams of ``docs`` have a score."""
    learnt = F.col("learnt") if "learnt" in docs.columns else F.lit(True)
    counted = through(docs.select("text", learnt.alias("learnt")), _count, "kind int, key long, n long, every long")
    counted = save(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "counts")
    words, full = counted.filter("kind = 0").select("key", "n"), counted.filter("kind = 1")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    full = full.select(_context(CUT).alias("ctx"), "key", "n", "every").repartition("ctx").sortWithinPartitions("ctx")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            ctx, sums = Subtrees(column(b, "key").to_numpy(), column(b, "n").to_numpy(), least).sums()
            yield pa.RecordBatch.from_arrays([pa.array(ctx), pa.array([x.tobytes() for x in sums], pa.binary())], ["ctx", "sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, sums = None, np.zeros(767)
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ctx, sums = c, sums + np.frombuffer(x, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([ctx], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["ctx", "sums"])

    schema = "ctx long, sums binary"
    top = top_tree(through(full, up, schema).groupBy("ctx").applyInArrow(together, schema).toArrow(), least)  # at most 65,536 rows
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for b in _runs(batches):
            out = Subtrees(column(b, "key").to_numpy(), column(b, "n").to_numpy(), least).score(top)
            yield pa.RecordBatch.from_arrays([column(b, "key"), column(b, "every"), pa.array(out.astype(np.float32))], ["key", "every", "score"])

    return save(through(full, down, "key long, every long, score float"), "grams"), words, total, distinct


def score(docs: DataFrame, model: tuple[DataFrame, DataFrame, int, int], common: int = COMMON, common_grams: int = GRAMS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each row of ``docs``,
    whose texts are among those that ``train`` was given."""
    scored, words, total, distinct = model
    top = words.filter(F.col("n") * common >= total).orderBy("key").toArrow()  # at most ``common`` rows
    positions = scored.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    often = scored.filter(F.col("every") * common_grams >= positions).select("key", "score").toArrow()  # at most ``common_grams`` rows
    often = often.sort_by("key")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((often["key"].to_numpy(), often["score"].to_numpy(), top["key"].to_numpy(), top["n"].to_numpy()))
    ground = float(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_worth, keys, ns = shared.value
        worth = np.log10((ns + 1) / ground)
        for batch in batches:
            for p in pieces(batch):
                w = text_words(p)
                n = p.num_rows
                key, at = grams(*byte_stream(w))
                codes, distinct_keys = pd.factorize(key)
                spot = np.minimum(np.searchsorted(gram_keys, distinct_keys), max(len(gram_keys) - 1, 0))
                found = gram_keys[spot] == distinct_keys if len(gram_keys) else np.zeros(len(distinct_keys), bool)
                worth_of = np.zeros(len(distinct_keys))
                worth_of[found] = gram_worth[spot[found]]
                sums = np.add.reduceat(worth_of[codes], at[:-1])
                lost = np.flatnonzero(~found[codes])
                lost_doc = np.searchsorted(at, lost, "right") - 1
                count = np.diff(w.at)
                doc = np.append(np.repeat(np.arange(n), count), np.arange(n))
                h = np.append(w.hash.view(np.int64), np.full(n, END_KEY, np.int64))
                spot = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[spot] == h if len(keys) else np.zeros(len(h), bool)
                base = np.bincount(doc[hit], worth[spot[hit]], n).astype(np.float64)  # of ints if nothing is known
                known = np.bincount(doc[hit], minlength=n)
                rid = column(p, "rid").to_numpy()
                rest = int((~hit).sum()) + len(lost)
                kinds = np.repeat(np.array([0, 1], np.int32), [rest - len(lost), len(lost)])
                nothing = pa.nulls(rest, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rid, rid[doc[~hit]], rid[lost_doc]])),
                        pa.array(np.append(np.full(n, 2, np.int32), kinds)),
                        pa.array(np.concatenate([rid, h[~hit], key[lost]])),  # a text's own row joins nothing, wherever it goes
                        pa.concat_arrays([pa.array(count + 1), nothing]),
                        pa.concat_arrays([pa.array(known), nothing]),
                        pa.concat_arrays([pa.array(base), pa.nulls(rest, pa.float64())]),
                        pa.concat_arrays([pa.array(sums), pa.nulls(rest, pa.float64())]),
                        pa.concat_arrays([pa.array(np.diff(at)), nothing]),
                        pa.concat_arrays([column(p, "doc_id").cast(pa.int64()), nothing]),
                    ],
                    ["rid", "kind", "key", "n_tokens", "known", "base", "score", "n_bytes", "doc_id"],
                )

    flat = of_columns(docs, "doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    rows = through(flat, run, "rid long, kind int, key long, n_tokens long, known long, base double, score double, n_bytes long, doc_id long")
    rare = words.filter(F.col("n") * common < total).select(F.lit(0).alias("kind_"), F.col("key").alias("k_"), F.log10((F.col("n") + 1) / F.lit(ground)).alias("w"))
    rare = rare.union(scored.filter(F.col("every") * common_grams < positions).select(F.lit(1), "key", F.col("score").cast("double")))
    joined = rows.join(rare, (rows.key == rare.k_) & (rows.kind == rare.kind_), "left")
    word, gram = F.col("kind") == 0, F.col("kind") == 1
    worth = F.when(word, F.coalesce("w", F.log10(1 / F.lit(ground)))).when(gram, 0.0).otherwise(F.col("base"))
    found = F.when(word, F.col("w").isNotNull().cast("int")).when(gram, 0).otherwise(F.col("known"))
    gained = F.when(gram, F.coalesce("w", F.raise_error(F.lit("a text that train was not given")).cast("double"))).otherwise(F.coalesce("score", F.lit(0.0)))
    out = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(found).cast("long").alias("n_known"), F.sum(worth).alias("base_score"), F.round(F.sum(gained), 8).alias("score"), F.max("n_bytes").alias("n_bytes"))
    bits = -F.col("score") / F.col("n_bytes") * float(np.log2(10))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.round("base_score", 8).alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))


def op5_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = score(docs, train(docs.withColumn("learnt", crc_mod(7) != 2)))
    return out.select("doc_id", (crc_mod(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
