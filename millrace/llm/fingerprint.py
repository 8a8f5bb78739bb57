"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words (lower case, A-Z alone) and how often each occurs. For sample k a term of weight w has
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r.
The term of least a, with its t, is the sample, and two texts agree on one with a chance of their generalised
Jaccard similarity, sum min(w) / sum max(w). A fingerprint holds 16 bits of each of ``SAMPLES`` samples; likeness is the
share of equal ones, corrected for chance agreement.

``consecutive`` pairs each text with the next in descending order of doc_id (the last with the first): ranges of
doc_id from approximate quantiles, one exchange of the texts, and the first rows of a range copied to the end of
the one before. Rows then stream in order, in blocks.

Null text: as empty. A text without words: all samples 0; likeness 1 to another such, 0 to others. Null doc_id: last.
Equal doc_ids and repeated rows: by text. One row: it is its own next. Long texts: whole. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, RANGE_BYTES, Words, bisect_left, column, mix, of_columns, table, through

SAMPLES = 64
PAIRS_AT_ONCE = 1 << 15
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def draws(term: np.ndarray, weight: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """For each weighted term and sample: ln a, made an unsigned integer of the same order, over 16 bits of the sample."""
    out = np.empty((len(term), samples), np.uint64)
    log_w = np.log(weight.astype(np.float32))[:, None]
    for i in range(0, len(term), 8192):
        h = term[i : i + 8192, None] + (np.arange(1, samples + 1, dtype=np.uint64) * _STEP[0])[None, :]
        x, y = mix(h), mix(h ^ _STEP[1])

        def gamma(z: np.ndarray) -> np.ndarray:
            high = ((z >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
            low = ((z & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
            return -np.log(high) - np.log(low) + np.float32(1e-12)

        r, c = gamma(x), gamma(y)
        spare = x * _STEP[2] ^ y
        b = (spare >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_w[i : i + 8192] / r + b)
        value = (np.log(c) - r * (t - b) - r).astype(np.float32)
        bits = value.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        own = (mix(spare + t.astype(np.int64).view(np.uint64) * _STEP[0]) >> np.uint64(48)) | np.uint64(1)
        out[i : i + 8192] = bits << np.uint64(32) | own
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """16 bits of each sample of each text of a UTF-8 buffer; 0 where a text has no words."""
    w = Words(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, samples), np.uint16)
    terms, weights, size = [], [], np.zeros(n, np.int64)
    for i in range(n):
        if w.at[i + 1] > w.at[i]:
            h = np.sort(w.hash[w.at[i] : w.at[i + 1]])
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            terms.append(h[cut])
            weights.append(np.diff(np.append(cut, len(h))))
            size[i] = len(cut)
    if not terms:
        return out
    term, weight = np.concatenate(terms), np.concatenate(weights)
    del w, terms, weights
    key = term + weight.astype(np.uint64) * _STEP[1]
    order = np.argsort(key)
    cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    which = np.empty(len(key), np.int64)
    which[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(key))))
    term, weight = term[order][cut], weight[order][cut]
    at = np.concatenate([[0], np.cumsum(size)])
    ids = np.flatnonzero(size)
    best = np.full((n, samples), np.uint64(0xFFFFFFFFFFFFFFFF))
    # runs of samples bound the memory of the draws, runs of texts that of the pairs
    width = max(4, min(samples, (1 << 22) // max(len(term), 1)))
    for lo in range(0, samples, width):
        drawn = _window(term, weight, lo, min(lo + width, samples))
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(at, at[ids[i]] + PAIRS_AT_ONCE, "right")) - 1)
            j = min(len(ids), max(i + 1, int(np.searchsorted(ids, j))))
            a, b = at[ids[i]], at[ids[j - 1] + 1]
            best[ids[i:j], lo : lo + width] = np.minimum.reduceat(drawn[which[a:b]], at[ids[i:j]] - a, axis=0)
            i = j
    out[ids] = (best[ids] & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _window(term: np.ndarray, weight: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return draws(term + np.uint64(lo) * _STEP[0], weight, hi - lo)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated generalised Jaccard similarity of rows of fingerprints, 0 to 1."""
    same = (a == b).mean(1)
    return np.clip((same - 2**-15) / (1 - 2**-15), 0, 1)


def consecutive(docs: DataFrame, work, schema: str, shards: int | None = None) -> DataFrame:
    """``work(texts, ids) -> RecordBatch`` over runs of rows in descending doc_id; texts has one more, the next one's."""
    d = of_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    shards = shards or max(1, -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    low = F.lit(-(1 << 63))
    key = F.coalesce("doc_id", low)
    bounds = d.agg(F.percentile_approx(key, [i / shards for i in range(1, shards)] or [0.5], 20 * shards)).first()[0]
    bounds = sorted(set(bounds or [])) if shards > 1 else []
    part = (len(bounds) - bisect_left(F.array(*[F.lit(b) for b in bounds]), key)).cast("int") if bounds else F.lit(0)
    heads = dict(d.groupBy(part.alias("part")).agg(F.max(key)).collect())  # a row for each range
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    n = len(bounds) + 1
    head, to = (F.get(F.array(*[F.lit(x.get(p)).cast("long") for p in range(n)]), part) for x in (heads, before))
    own = F.struct(part.alias("part"), F.lit(0).alias("kind"))
    goes = F.when(head == key, F.array(own, F.struct(to.cast("int").alias("part"), F.lit(1).alias("kind")))).otherwise(F.array(own))
    rows = d.select("doc_id", "text", F.explode(goes).alias("x")).select("x.part", "x.kind", "doc_id", "text")
    rows = rows.repartitionById(n, "part").sortWithinPartitions("part", "kind", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ids: list[int | None] = []
        now, held, closed = None, 0, False
        for b in batches:
            for p, kind, i, x in zip(*[column(b, c) for c in ("part", "kind", "doc_id", "text")], strict=True):
                p, kind, i, x = p.as_py(), kind.as_py(), i.as_py(), x.as_py()
                if p != now:
                    now, closed = p, False
                if closed:
                    continue
                texts.append(x)
                held += len(x)
                if kind:
                    closed = True
                else:
                    ids.append(i)
                if closed or held > CHUNK_BYTES and len(texts) > 1:
                    yield work(texts, ids if closed else ids[:-1])
                    texts, ids = ([], []) if closed else (texts[-1:], ids[-1:])
                    held = sum(map(len, texts))

    return through(rows, run, schema)


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _edit(texts: list[str], ids: list) -> pa.RecordBatch:
    edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for x, y in zip(texts, texts[1:])]
    both = fingerprints(*_pack(texts + edited))
    n = len(ids)
    own, after, new = both[:n], both[1 : n + 1], both[n + 1 :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            pa.array([x.astype(">u2").tobytes().hex() for x in own]),
            pa.array([x.astype(">u2").tobytes().hex() for x in new]),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op3_consistent_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consecutive(table(spark, sf_dir, "documents"), _edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
