"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: round i of 2t hashes every shingle of the set. In rounds below t a shingle falls into a random one of the
t coordinates with value i + u; in round t + j all fall into coordinate j. A coordinate keeps its least value, and
a document leaves once all its coordinates are filled, so every coordinate fills, after O(t log t / n + 1) rounds,
with the concentration of t independent samples. R coordinates of equal value make a band; a pair of similarity
0.75 shares none of the 54 bands of 6 with a chance of 2.5e-5.

Links: texts with equal shingle sets are one class, numbered in a written table. A bucket (band, value) of several classes
links each of them with its first, a star, never all pairs: every class first tries the star it shares most bands with,
then, where components still differ, the others. In buckets that then still hold several components, every pair of classes
of different components is compared on its sketches in the first bucket that the two share, and each pair that may reach
the threshold is confirmed on full sets, so no pair is compared twice. Components come from min-label propagation
with shortcuts over the confirmed links. A pair of similarity 0.75 is lost with a chance of at most 5e-5: 2.5e-5 that
it shares no band, and 2e-5 that fewer than ``MAYBE`` of its coordinates agree, if no chain of links joins it otherwise.

Scale: a row for each class and band (16 bytes) is the largest shuffle; a group of near copies is spread over 54 buckets
and more, which stream through their tasks. Copies collapse before it, by an aggregate that combines map-side, and classes
of many copies are joined by a broadcast of at most ``HEAVY`` rows. Full sets exist only for classes that share a bucket,
found by a bit filter, sized by their number up to 64 MB, and an exact join. A contested bucket is compared by blocks of
``BLOCK`` classes; candidates among them go on in parts of at most ``PART_BYTES`` of full sets a side, or one set, so a
task's memory is bounded. All intermediate tables are in the shared folder and are deleted once read; the driver holds
counts and the filter only.

Null or blank text: no shingles, its own component. Repeated rows: each is returned. Several texts with one doc_id: each
row belongs to its own text's component. Null doc_id: returned as its own component (null), linked with nothing. Fewer
than five words: the whole sequence is the one shingle. Very long text: its whole set takes part. Empty table: no rows.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, drop, mix, of_columns, pieces, save, table, text_words, through

SHINGLE, BANDS, ROWS = 5, 54, 6
T = BANDS * ROWS
#: Links have PART * intersection >= SHARE * union.
PART, SHARE = 100, 75
#: Least share of equal coordinates at which a pair in a contested bucket is verified: over 4 deviations below 0.75.
MAYBE = 0.65
BLOCK = 2048
PART_BYTES = 4 << 20
#: A class of more than 1/HEAVY of all rows is heavy.
HEAVY = 4096
#: Bits of the filter: some for each class, in chunks that are made apart.
BITS_EACH, MAX_BITS, CHUNK_BITS = 16, 1 << 29, 1 << 16
SET = ["n_shingles", "s1", "s2"]
_ODD = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after another, and the n+1 offsets."""
    w = text_words(batch)
    n = len(w.at) - 1
    count = np.diff(w.at)
    h = w.hash
    full = np.zeros(0, np.uint64)
    if len(h) >= SHINGLE:
        full = sum((h[k : len(h) - SHINGLE + 1 + k] * _ODD[k] for k in range(1, SHINGLE)), h[: len(h) - SHINGLE + 1] * _ODD[0])
        full = mix(full)
    out = []
    for i in range(n):
        a, c = w.at[i], count[i]
        if c >= SHINGLE:
            s = np.sort(full[a : a + c - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(mix((h[a : a + c] * np.array(_ODD[:c])).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(full[:0])
    return (np.concatenate(out) if out else full), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def sketches(flat: np.ndarray, at: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates (uint64) for each set; sets are not empty. High bits hold the round, so later rounds never win."""
    n = len(at) - 1
    out = np.full((n, t), np.uint64(0xFFFFFFFFFFFFFFFF))
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    values, open_ = flat, np.ones(n, bool)
    for i in range(2 * t):
        h = mix(values + np.uint64(((i + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32) if i < t else np.full(len(h), i - t, np.uint64)
        np.minimum.at(out.reshape(-1), owner * t + bins.astype(np.int64), (np.uint64(i) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
        if i == t - 1 or i < 8 or i % 8 == 0:
            still = (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
            if not still.any():
                break
            if still.sum() < 0.8 * open_.sum():
                mask = still[owner]
                values, owner, open_ = values[mask], owner[mask], still
    return out


def band_keys(sk: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch; its low 6 bits are the band's number."""
    x = sk.reshape(len(sk), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), x.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return (h & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _fixed(a: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * raw.shape[1]).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def set_hashes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    cum = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + salt))]) for salt in _ODD[:2]]
    return np.stack([c[at[1:]] - c[at[:-1]] for c in cum]).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [c for c in batch.schema.names if c != "text"]
        for p in pieces(batch):
            flat, at = shingle_sets(p)
            n = np.diff(at)
            some = n > 0
            sk = sketches(flat, np.concatenate([[0], np.cumsum(n[some])]))
            keys = pa.array([None] * len(n), pa.binary()), pa.array([None] * len(n), pa.binary())
            if some.any():
                spot = pa.array(np.where(some, np.cumsum(some) - 1, 0), mask=~some)
                keys = tuple(_fixed(x).take(spot) for x in (band_keys(sk), (mix(sk) & np.uint64(255)).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([*[column(p, c) for c in ids], pa.array(n.astype(np.int64)), *map(pa.array, set_hashes(flat, at)), *keys], [*ids, *SET, "bands", "sketch"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b"".join(column(b, "bands").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64)), pa.array(np.repeat(column(b, "rep").to_numpy(), BANDS))], ["bucket", "rep"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, rep): keeps buckets of several rows and adds their first rep. Holds one batch and a row."""
    last: tuple | None = None  # the latest row: bucket, leader, whether it is out already
    for b in batches:
        if not b.num_rows:
            continue
        k, r = column(b, "bucket").to_numpy(), column(b, "rep").to_numpy()
        if last is not None:
            k, r = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], r])
        new = np.concatenate([[True], k[1:] != k[:-1]])
        at = np.flatnonzero(new)
        lead = np.repeat(r[at], np.diff(np.append(at, len(k))))
        many = ~new
        many[:-1] |= ~new[1:]
        if last is not None and last[2]:
            many[0] = False
        out_last = bool(many[-1]) or (last is not None and last[2] and len(at) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (k, lead, r)], ["bucket", "leader", "rep"])
        last = (k[-1], lead[-1], out_last)


def _sketches_of(c: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, T)


def _longs_of(c: pa.Array) -> np.ndarray:
    """Views of binary values as 64-bit integers."""
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out = np.empty(len(c), object)
    out[:] = [raw[i:j].view(np.int64) for i, j in zip(at, at[1:])]
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], wide: dict) -> Iterator[list]:
    """The columns of each run of equal values of the first; ``wide`` says how to read binary columns."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [wide[n](column(b, n)) if n in wide else column(b, n).to_numpy() for n in names]
        cut = np.concatenate([[0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, [b.num_rows]])
        for i, j in zip(cut, cut[1:]):
            if held and held[0][0][0] != cols[0][i]:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            held.append([c[i:j] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _candidates(side, comp, sk, band) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row i, rows j of other components that may link with it and share no earlier band, and their equal coordinates.
    Rows of side 2 pair among themselves, those of side 0 with those of side 1."""

    def look(i: int, js: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(js):
            return
        equal = sk[js] == sk[i]
        same = np.count_nonzero(equal, axis=1)
        yes = same >= MAYBE * T
        if yes.any():
            first = equal[yes].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]
            if first.any():
                yield i, js[yes][first], same[yes][first]

    own = np.flatnonzero(side == 2)
    own = own[np.argsort(comp[own], kind="stable")]
    after = np.searchsorted(comp[own], comp[own], "right")
    for i, k in zip(own, after):
        yield from look(int(i), own[k:])
    other = np.flatnonzero(side == 1)
    other = other[np.argsort(comp[other], kind="stable")]
    left = np.flatnonzero(side == 0)
    lo, hi = (np.searchsorted(comp[other], comp[left], x) for x in ("left", "right"))
    for i, a, b in zip(left, lo, hi):
        yield from look(int(i), np.concatenate([other[:a], other[b:]]))


def _parts(size: np.ndarray) -> np.ndarray:
    """Numbers of runs of sets, each of at most PART_BYTES or one set."""
    out, held, part = np.zeros(len(size), np.int64), 0, 0
    for k, n in enumerate(size.tolist()):
        if held and held + 8 * n > PART_BYTES:
            part, held = part + 1, 0
        held += 8 * n
        out[k] = part
    return out


def _contested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (grp, side, rep, comp, band, n_shingles, sketch) sorted by grp, those that may link with one of another
    component: rows (grp, rep, comp, partners, agree) of groups whose sets fit in memory, each with the reps it may link with."""
    for grp, side, rep, comp, band, size, sk in _groups(batches, ["grp", "side", "rep", "comp", "band", "n_shingles", "sketch"], {"sketch": _sketches_of}):
        found = [(np.full(len(js), i), js, same) for i, js, same in _candidates(side, comp, sk, band)]
        if not found:
            continue
        i, j, same = (np.concatenate(x) for x in zip(*found))
        hit = np.unique(np.concatenate([i, j]))
        part = np.zeros(len(rep), np.int64)
        part[hit] = _parts(size[hit])
        cell = part[i] * (part[hit[-1]] + 1) + part[j]
        order = np.lexsort((i, cell))
        i, j, same, cell = i[order], j[order], same[order], cell[order]
        cut = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(cell))):
            rows = np.unique(np.concatenate([i[a:b], j[a:b]]))
            at = np.searchsorted(i[a:b], rows, "left"), np.searchsorted(i[a:b], rows, "right")
            partners = [rep[j[a + x : a + y]].astype(np.int64).tobytes() for x, y in zip(*at)]
            agree = [same[a + x : a + y].astype(np.int64).tobytes() for x, y in zip(*at)]
            name = mix(grp[:1].view(np.uint64) + cell[a : a + 1].astype(np.uint64) * _ODD[2]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, len(rows))), pa.array(rep[rows]), pa.array(comp[rows]), pa.array(partners, pa.binary()), pa.array(agree, pa.binary())], ["grp", "rep", "comp", "partners", "agree"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among rows (grp, rep, comp, partners, agree, set) sorted by grp. Likely pairs come first, and a pair that
    links so far connect is not verified again; every other candidate is, on full sets."""
    wide = dict.fromkeys(["partners", "agree", "set"], _longs_of)
    for _, rep, comp, partners, agree, sets in _groups(batches, ["grp", "rep", "comp", "partners", "agree", "set"], wide):
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        by = np.argsort(rep, kind="stable")
        i = np.repeat(np.arange(len(rep)), [len(x) for x in partners])
        j = by[np.searchsorted(rep[by], np.concatenate(partners))]
        found = []
        for k in np.argsort(-np.concatenate(agree), kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            a, b = find(int(comp[x])), find(int(comp[y]))
            if a == b:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if PART * both >= SHARE * (len(sets[x]) + len(sets[y]) - both):
                root[max(a, b)] = min(a, b)
                found.append((int(rep[x]), int(rep[y])))
        if found:
            x = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = column(b, "shingles")
        at, flat = c.offsets.to_numpy(), c.values.to_numpy()
        yield pa.RecordBatch.from_arrays([column(b, "rep"), pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], ["rep", "set"])


def _bits(slots: DataFrame, size: int) -> np.ndarray:
    """The filter with the bits of ``slots`` (x) set; made by chunks, of which there are at most MAX_BITS / CHUNK_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.sort(column(b, "x").to_numpy())
            chunk, first = np.unique(x // CHUNK_BITS, return_index=True)
            for c, part in zip(chunk.tolist(), np.split(x, first[1:])):
                at = part % CHUNK_BITS
                np.bitwise_or.at(held.setdefault(c, np.zeros(CHUNK_BITS // 8, np.uint8)), at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(size // 8, np.uint8)
    rows = through(slots.repartition(F.floor(F.col("x") / CHUNK_BITS)), run, "chunk long, bits binary").toArrow()
    for c, raw in zip(rows["chunk"].to_pylist(), rows["bits"]):
        out[c * CHUNK_BITS // 8 : (c + 1) * CHUNK_BITS // 8] = np.frombuffer(raw.as_buffer(), np.uint8)
    return out


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp): comp is the least rep reachable over links (a, b). Each round takes the least label of all
    neighbours and then the label's own label, so chains shorten by powers."""
    labels = save(nodes.select("rep", F.col("rep").alias("comp")), "labels")
    both = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    if both.isEmpty():
        return labels
    while True:
        near = both.join(labels, both.b == labels.rep).groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.join(near, labels.rep == near.a, "left").select("rep", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        step = save(step, "step")
        hop = step.select(F.col("rep").alias("r_"), F.col("comp").alias("c_"))
        after = save(step.join(hop, step.comp == hop.r_).select("rep", F.least("comp", "c_").alias("comp"), (F.col("was") != F.least("comp", "c_")).alias("moved")), "labels")
        drop(step)
        more = not after.filter("moved").isEmpty()
        drop(labels)
        labels = after.drop("moved")
        if not more:
            drop(both)
            return labels


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their full sets."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").filter(PART * both >= SHARE * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    return pairs.join(a, "a").join(b, "b").filter("ca != cb").select("a", "b")


def _sets(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(rep, shingles) of the classes ``near``."""
    size = CHUNK_BITS
    while size < min(BITS_EACH * near.count(), MAX_BITS):
        size *= 2
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bits(near.select(F.col("least").alias("doc_id")).select(slot.alias("x")), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        given: set[tuple] = set()  # a text that recurs under one doc_id is given once
        for batch in batches:
            x = column(batch, "x").to_numpy()
            for p in pieces(batch.filter(pa.array((held[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1))):
                flat, at = shingle_sets(p)
                keys = np.stack([np.diff(at), *set_hashes(flat, at)])
                new = np.zeros(p.num_rows, bool)
                for k, name in enumerate(zip(column(p, "doc_id").to_pylist(), *keys.tolist())):
                    if name[1] and name not in given:
                        given.add(name)
                        new[k] = True
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([column(p, "doc_id"), *map(pa.array, keys), sets], ["doc_id", *SET, "shingles"]).filter(pa.array(new))

    texts = through(docs.filter("doc_id IS NOT NULL").select("doc_id", "text", slot.alias("x")), run, "doc_id long, n_shingles long, s1 long, s2 long, shingles array<long>")
    found = texts.join(near, SET).filter("doc_id = least").dropDuplicates(SET).select("rep", "shingles")
    sets = save(found, "sets")
    shared.destroy()
    return sets


def near_duplicates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text). kept: whether doc_id is that of its
    component; given a ``key`` column that no two rows share, it is returned too, and just one row of a component is kept:
    that of the least (doc_id, key)."""
    ids = ["doc_id", *([key] if key else [])]
    docs = of_columns(docs, *ids, "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*ids).schema)
    described = save(through(docs, _describe, f"{kinds}, n_shingles long, s1 long, s2 long, bands binary, sketch binary"), "described")
    ident = F.struct(*ids) if key else F.col("doc_id")
    have = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = have.groupBy(*SET).agg(F.min("doc_id").alias("least"), F.min(ident).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    rows = through(classes.select("rep", "bands"), _explode, "bucket long, rep long")
    stars = save(through(rows.repartition("bucket").sortWithinPartitions("bucket", "rep"), _stars, "bucket long, leader long, rep long"), "stars")

    near = save(stars.select("rep").distinct().join(classes, "rep").select("rep", *SET, "least", "first", "sketch"), "near")
    sets = _sets(docs, near.select("rep", *SET, "least"))
    shared_bands = save(stars.filter("leader != rep").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).count(), "edges")
    best = shared_bands.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b")
    tried = [save(_verified(best, sets), "links")]
    labels = components(near, tried[0])
    tried.append(save(_verified(_open(shared_bands.select("a", "b"), labels), sets), "links"))
    links = tried[0].union(tried[1])
    if not tried[1].isEmpty():
        drop(labels)
        labels = components(near, links)

    member = stars.select("bucket", "rep").join(labels, "rep")
    per = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("bucket", "n")
    member = member.join(per, "bucket").join(near.select("rep", "n_shingles", "sketch"), "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    member = member.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    grp = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") < F.col("other"), 0).when(F.col("mine") > F.col("other"), 1).otherwise(2)
    member = member.select(grp.alias("grp"), side.cast("int").alias("side"), "rep", "comp", F.col("bucket").bitwiseAND(F.lit(63)).cast("int").alias("band"), "n_shingles", "sketch")
    contested = save(through(member.repartition("grp").sortWithinPartitions("grp"), _contested, "grp long, rep long, comp long, partners binary, agree binary"), "contested")
    if not contested.isEmpty():
        rows = contested.join(through(sets, _packed, "rep long, set binary"), "rep").select("grp", "rep", "comp", "partners", "agree", "set")
        tried.append(save(through(rows.repartition("grp").sortWithinPartitions("grp", "rep"), _settled, "a long, b long"), "links"))
        if not tried[2].isEmpty():
            drop(labels)
            labels = components(near, links.union(tried[2]))

    whole = labels.join(near.select("rep", "least", "first"), "rep").groupBy("comp").agg(F.min("least").alias("component_id"), F.min("first").alias("winner"))
    klass = classes.select("rep", *SET, "least", "first", "copies").join(labels.join(whole, "comp").select("rep", "component_id", "winner"), "rep", "left")
    klass = klass.select(*SET, "copies", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("winner", "first").alias("winner"))
    klass = save(klass, "components")
    for done in (classes, stars, near, sets, shared_bands, labels, contested, *tried):
        drop(done)
    total = klass.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    heavy = F.broadcast(klass.filter(F.col("copies") * HEAVY > total).drop("copies"))  # fewer than HEAVY rows
    light = klass.filter(F.col("copies") * HEAVY <= total).drop("copies")
    have = have.select(*ids, *SET)
    alone = described.filter("n_shingles = 0 OR doc_id IS NULL").select(*ids, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    found = have.join(heavy, SET).unionByName(have.join(heavy, SET, "left_anti").join(light, SET))
    out = save(found.select(*ids, "n_shingles", "component_id", (ident == F.col("winner")).alias("kept")).union(alone), "near-duplicates")
    for done in (described, klass):
        drop(done)
    return out


def op7_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
