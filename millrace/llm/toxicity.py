"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is a logistic function of its hashed words and of the beginnings of longer words; a
document's is the noisy-or of its sentences. The weights are fitted to document labels alone, by proximal gradient steps with an L1
penalty, so a few telling words remain and the offending sentences can be located.

Fit: on a sample of at most about ``MAX_DOCS`` labelled documents and ``MAX_BYTES`` of text, chosen by a hash of doc_id; the model has
2**20 weights whatever the corpus. Scoring reads each text once, whole, without a shuffle.

Null or empty text: one empty sentence, which has the bias alone. Null doc_id: scored like any other. Repeated rows:
scored one by one. A label is used if it is not null; of several for an id the largest counts. No usable labels,
or one class only: every score is that of the bias. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, column, crc_mod, mix, of_columns, pieces, spans_hash, table, text_words, through, utf8

BUCKETS = 1 << 20
MAX_DOCS = 4_000
#: Bytes of their texts that come to the fit at most; a single longer text still does.
MAX_BYTES = 64 << 20
#: Features that a pass over the sample holds at once.
RUN = 1 << 21
STEPS = 150
#: Bytes of the beginnings of words that are features; the word itself is one too.
PREFIXES = (4, 5, 6, 7)
L1 = 2e-4
#: A sentence without evidence: rare enough that hundreds of them don't make a document toxic.
BIAS = -9.0
_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Sentences:
    """Features of all sentences of a batch: bucket and sentence of each feature, words' spans, and the
    n+1 sentence offsets of the texts; a text without words has one sentence without features."""

    def __init__(self, w: Words):
        n, d = len(w.at) - 1, len(w.start)
        start, end = w.start.copy(), w.end.copy()
        while True:  # punctuation at the edges of a word doesn't belong to it
            a = (start < end) & _EDGE[w.data[np.minimum(start, len(w.data) - 1)]] if d else np.zeros(0, bool)
            b = (start < end - 1) & _EDGE[w.data[end - 1]] if d else a
            if not (a.any() or b.any()):
                break
            start, end = start + a, end - (b & ~a)
        h = spans_hash(w.data, start, np.maximum(start, end)) if d else np.zeros(0, np.uint64)
        line = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(w.data == 10, out=line[1:])
        first = np.zeros(d, bool)
        if d:
            first[0] = True
            first[1:] = _STOP[w.data[w.end[:-1] - 1]] | (line[w.start[1:]] > line[w.end[:-1]])
            first[w.at[:-1][np.diff(w.at) > 0]] = True
        blank = np.diff(w.at) == 0
        per = np.zeros(n, np.int64)
        cum = np.concatenate([[0], np.cumsum(first)])
        per = cum[w.at[1:]] - cum[w.at[:-1]] + blank
        self.at = np.concatenate([[0], np.cumsum(per)])
        doc = np.repeat(np.arange(n), np.diff(w.at))
        shift = np.concatenate([[0], np.cumsum(blank)])[doc] if d else np.zeros(0, np.int64)
        self.sentence = (np.cumsum(first) - 1 + shift) if d else np.zeros(0, np.int64)
        self.first_word = np.flatnonzero(first)
        parts, owners = [h], [self.sentence]
        for k in PREFIXES:
            longer = np.flatnonzero(end - start > k)
            parts.append(spans_hash(w.data, start[longer], start[longer] + k) + np.uint64(k))
            owners.append(self.sentence[longer])
        self.feature = (mix(np.concatenate(parts)) % np.uint64(BUCKETS)).astype(np.int32)
        self.owner = np.concatenate(owners)
        self.words = w


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(feature: np.ndarray, owner: np.ndarray, at: np.ndarray, label: np.ndarray, steps: int = STEPS, l1: float = L1) -> tuple[np.ndarray, float]:
    """Weights and bias from the sentences' features and the documents' labels; l1 is a share of the documents."""
    n, s = len(label), int(at[-1])
    weights, bias = np.zeros(BUCKETS), BIAS
    if n == 0 or label.min() == label.max():
        return weights, bias
    seen = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(feature), RUN):
        seen += np.bincount(feature[i : i + RUN], minlength=BUCKETS)
    keep = seen[feature] >= 3
    feature, owner = feature[keep], owner[keep]
    square, b_square = np.full(BUCKETS, 1e-8), 1e-8
    share = np.where(label == 1, np.clip(0.5 * (label == 0).sum() / (label == 1).sum(), 1.0, 3.0), 1.0) / n
    for step in range(steps):
        z = np.full(s, bias)
        for i in range(0, len(feature), RUN):
            z += np.bincount(owner[i : i + RUN], weights[feature[i : i + RUN]], s)
        total = np.maximum(np.add.reduceat(softplus(z), at[:-1]), 1e-9)
        slope = share * np.where(label == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        g = np.repeat(slope, np.diff(at)) / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.zeros(BUCKETS)
        for i in range(0, len(feature), RUN):
            grad += np.bincount(feature[i : i + RUN], g[owner[i : i + RUN]], BUCKETS)
        square += grad * grad
        rate = 0.5 / np.sqrt(square)
        weights -= rate * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * l1, 0)
        b_square += g.sum() ** 2
        bias = min(bias - 0.1 * g.sum() / np.sqrt(b_square), BIAS)
        if step % 20 == 19:  # what the penalty holds at zero by now stays there
            keep = weights[feature] != 0
            feature, owner = feature[keep], owner[keep]
    return weights, float(bias)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch):
            s = Sentences(text_words(p))
            order = np.argsort(s.owner, kind="stable")
            owner, feature = s.owner[order], s.feature[order]
            cut = np.searchsorted(owner, s.at)
            per = np.bincount(owner, minlength=int(s.at[-1])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [column(p, "toxic"), pa.array(np.diff(s.at).astype(np.int32)), pa.array([feature[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([per[i:j].tobytes() for i, j in zip(s.at, s.at[1:])], pa.binary())],
                ["toxic", "n", "feature", "per"],
            )


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """The model from documents and labels whose crc32(doc_id) mod 5 is not 0. Of several rows with one id the longest text counts."""
    labels = of_columns(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(5) != 0))
    there = labels.count()
    share = min(1.0, max_docs / there) if there else 0.0
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = order < int(share * (1 << 30)) + 1
    labels = labels.filter(picked).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = of_columns(docs, "doc_id", "text").filter(picked & (crc_mod(5) != 0))
    bytes_of = F.octet_length(F.coalesce("text", F.lit("")))
    size = texts.join(labels, "doc_id", "left_semi").groupBy("doc_id", order.alias("at")).agg(F.max(bytes_of).alias("size")).orderBy("at", "doc_id").collect()  # a row for each picked id
    fits = int(np.searchsorted(np.cumsum([r["size"] for r in size]), max_bytes, "right"))
    if 1 < len(size) and fits < len(size):  # long texts: fewer of them, the rest in the order of the hash
        texts = texts.filter(order < size[max(fits, 1)]["at"])
    one = texts.join(labels, "doc_id").groupBy("doc_id").agg(F.max(F.struct(bytes_of.alias("size"), F.coalesce("text", F.lit("")).alias("text"), "toxic")).alias("x")).select("doc_id", "x.text", "x.toxic")
    rows = through(one, _featurize, "toxic int, n int, feature binary, per binary").toArrow()  # a row an id, bounded by max_docs and max_bytes
    if not rows.num_rows:
        return np.zeros(BUCKETS), BIAS
    raw = [x.as_py() for x in rows["feature"]]
    label = rows["toxic"].to_numpy()
    order = sorted(range(len(raw)), key=lambda i: (raw[i], label[i]))  # sums depend on the order of rows
    feature = np.frombuffer(b"".join(raw[i] for i in order), np.int32)
    n = rows["n"].to_numpy()[order]
    per = np.frombuffer(b"".join(rows["per"][i].as_py() for i in order), np.int32)
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    del raw, rows
    return fit(feature, np.repeat(np.arange(len(per), dtype=np.int32), per), at, (label[order] > 0).astype(np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted, n_offending, top_start and top_end (code points of the likeliest sentence), and the
    columns of ``carry``."""
    weights, bias = model[0].astype(np.float32), model[1]
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB
    flat = of_columns(docs, *dict.fromkeys(["doc_id", "text", *carry]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for p in pieces(batch):
                w = text_words(p)
                s = Sentences(w)
                z = np.bincount(s.owner, held[s.feature], int(s.at[-1])) + bias if s.at[-1] else np.zeros(0)
                total = np.add.reduceat(softplus(z), s.at[:-1]) if len(z) else np.zeros(0)
                out = -np.expm1(-total)
                best = np.array([a + int(np.argmax(z[a:b])) for a, b in zip(s.at, s.at[1:])], np.int64)
                bad = np.add.reduceat((z > 0).astype(np.int64), s.at[:-1]) if len(z) else np.zeros(0, np.int64)
                top = np.zeros((2, p.num_rows), np.int64)
                if len(w.start):
                    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                    real = np.diff(w.at) > 0
                    i = np.searchsorted(s.sentence, best[real])
                    j = np.searchsorted(s.sentence, best[real], "right") - 1
                    base = chars[utf8(column(p, "text"))[1][:-1][real]]
                    top[0][real], top[1][real] = chars[w.start[i]] - base, chars[w.end[j]] - base
                made = {"score": pa.array(out), "predicted": pa.array((out >= 0.5).astype(np.int32)), "n_offending": pa.array(bad), "top_start": pa.array(top[0]), "top_end": pa.array(top[1])}
                yield pa.RecordBatch.from_arrays([column(p, c) for c in keep] + list(made.values()), keep + list(made))

    keep = list(dict.fromkeys(["doc_id", *carry]))
    fields = {f.name: f for f in flat.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int, n_offending long, top_start long, top_end long"
    return through(flat, run, schema)


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", "predicted", "n_offending", "top_start", "top_end")
