"""Languages of texts and of their spans: script ranges, word scores, Viterbi.

Each word (a run of visible characters) has a script mask by the ranges of its letters (Unicode category L, so neither digits
nor signs nor marks); the languages that use
the script in training are its candidates. Its score for a language is the log-likelihood of its byte 1- to
4-grams, word edges included, relative to the likeliest language. Viterbi with a penalty for each switch labels the
words of a text, and runs of one label are its spans. A text's language is the one that holds most bytes.

Fit: n-gram counts of at most about ``MAX_DOCS`` labelled documents, chosen by a hash of doc_id, in a table of fixed
size; at most ``MAX_LANGUAGES`` languages. Languages share them evenly, so each keeps about ``MAX_DOCS`` / languages documents, or all if it has less, however
large the others are. Rows of one doc_id, or without one, are learnt from together or not at all; a language of such rows alone can be missed. Scoring reads each text once, whole, without a shuffle; texts of a batch step through Viterbi side by side.

Null text or one without a letter: ``und``, score 0, no spans. Words without a letter take no side. Null lang: not
learnt from. No labels at all: ``und`` everywhere. Ties: the label that sorts first. Repeated rows: one by one.
Null doc_id: labelled like any other. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, column, crc_mod, mix, of_columns, pieces, table, text_words, through, utf8

MAX_DOCS = 12_000
BUCKETS = 1 << 17
GRAMS = 4
SWITCH = 12.0
WORST = -8.0
#: A language uses a script if at least this share of its words do.
USES = 0.01
#: Words, and bytes of their scores, that wait for Viterbi at most, beside the last piece.
BATCH_WORDS, BATCH_BYTES = 1 << 20, 64 << 20
#: Weights that are gathered at a time, and bytes of the weights of candidates that a task keeps.
CHUNK_FLOATS, KEPT_BYTES = 4 << 20, 64 << 20
#: The model has BUCKETS numbers of four bytes for each language, on the driver and in each worker: 128 MB at most.
MAX_LANGUAGES = 256

#: First code point of each range and its script; fixed by Unicode's blocks. 0: letters of all other scripts.
RANGES = ((0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xC0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0))
SCRIPTS = 14
#: Beyond this code point no letters are assigned.
POINTS = 0x40000
_SCRIPT: list[np.ndarray] = []


def script_of() -> np.ndarray:
    """For each code point the bit of its script if it is a letter (Unicode category L), else 0."""
    if not _SCRIPT:
        letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(POINTS)), bool, POINTS)
        first = np.array([a for a, _ in RANGES])
        script = np.array([k for _, k in RANGES])[np.searchsorted(first, np.arange(POINTS), "right") - 1]
        _SCRIPT.append(np.where(letter, 1 << script, 0).astype(np.int32))
    return _SCRIPT[0]


def script_bits(data: np.ndarray) -> np.ndarray:
    """For each byte that begins a letter, the bit of its script; 0 elsewhere."""
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    n = len(data)
    a, b, c, d = pad[:n], pad[1 : n + 1] & 63, pad[2 : n + 2] & 63, pad[3 : n + 3] & 63
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d)))
    bits = script_of()[np.minimum(point, POINTS - 1)]
    bits[(a & 0xC0) == 0x80] = 0
    return bits


class Grams:
    """Buckets of the n-grams of each word of a batch, the word of each, and each word's script mask."""

    def __init__(self, w: Words):
        n, d = len(w.data), len(w.start)
        self.mask = np.bitwise_or.reduceat(np.append(script_bits(w.data), 0), np.stack([w.start, w.end], 1).reshape(-1))[::2] if d else np.zeros(0, np.int32)
        size = w.end - w.start
        word = np.repeat(np.arange(d), size + 1)  # and a place for the edge after it
        within = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        place = w.start[word] + within
        edge = within == size[word]
        byte = np.where(edge, 32, np.append(w.data, 32)[np.minimum(place, n)]).astype(np.uint64)
        gram = np.zeros(len(word), np.uint64)
        out = []
        for k in range(GRAMS):
            prior = np.full(len(word), 32, np.uint64)
            prior[k:] = byte[: len(byte) - k] if k else byte
            gram = gram | np.where(within >= k, prior, np.uint64(32) if k == 0 else np.where(within == k - 1, 32, 0).astype(np.uint64)) << np.uint64(8 * k)
            valid = within >= k - 1 if k else ~edge
            out.append((word[valid], (mix(gram[valid] + np.uint64(((k + 1) << 40))) % np.uint64(BUCKETS)).astype(np.int32)))
        self.parts = out


def _languages(docs: DataFrame) -> DataFrame:
    return of_columns(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(5) != 0))


def shares(sizes: dict[str, int], max_docs: int) -> dict[str, float]:
    """The share of each language's documents that is learnt from: as many of each, as far as it has them."""
    out, left = {}, max_docs
    for k, x in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        take = min(sizes[x], max(1, left // (len(sizes) - k)))
        out[x] = take / sizes[x]
        left -= take
    return out


class Model:
    """names, weights (BUCKETS x languages, log-likelihoods), uses (languages x scripts)."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.weights = np.log(smooth / smooth.sum(0)).astype(np.float32) if names else np.zeros((BUCKETS, 0), np.float32)
        self.uses = scripts >= USES * np.maximum(scripts.sum(1, keepdims=True), 1)

    def candidates(self, mask: int) -> np.ndarray:
        """The languages that use a script of a mask; all if none does."""
        on = [s for s in range(SCRIPTS) if mask >> s & 1]
        found = np.flatnonzero(self.uses[:, on].any(1))
        return found if len(found) else np.arange(len(self.names))

    def of(self, cand: np.ndarray) -> np.ndarray:
        """The weights of some languages; the last few sets are kept."""
        if len(cand) == len(self.names):
            return self.weights
        kept = self.__dict__.setdefault("kept", {})
        key = cand.tobytes()
        if key not in kept:
            while kept and sum(x.nbytes for x in kept.values()) + BUCKETS * 4 * len(cand) > KEPT_BYTES:
                del kept[next(iter(kept))]
            kept[key] = np.ascontiguousarray(self.weights[:, cand])
        return kept[key]


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """The model from documents whose crc32(doc_id) mod 5 is not 0."""
    rows = _languages(docs)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    names = sorted(sizes)
    number = {x: i for i, x in enumerate(names)}
    width = len(names)
    if width > MAX_LANGUAGES:
        raise ValueError(f"{width} languages; the model's size is bound to {MAX_LANGUAGES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch):
                w = text_words(p)
                lang = np.repeat(np.array([number[x] for x in column(p, "lang").to_pylist()], np.int64), np.diff(w.at))
                g = Grams(w)
                keys = [lang[word] * BUCKETS + bucket for word, bucket in g.parts]
                keys += [width * BUCKETS + lang[(g.mask >> s & 1) == 1] * SCRIPTS + s for s in range(SCRIPTS)]
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    upto = [F.lit(y) for x, share in shares(sizes, max_docs).items() for y in (x, int(share * (1 << 30)) + 1)]
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.create_map(*upto)[F.col("lang")]) if upto else rows
    total = through(picked, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most languages x BUCKETS
    flat = np.zeros(width * (BUCKETS + SCRIPTS))
    flat[total["key"].to_numpy()] = total["n"].to_numpy()
    return Model(names, flat[: width * BUCKETS].reshape(width, BUCKETS).T if width else np.zeros((BUCKETS, 0)), flat[width * BUCKETS :].reshape(width, SCRIPTS))


def _sums(model: Model, cand: np.ndarray, word: np.ndarray, bucket: np.ndarray, total: np.ndarray) -> None:
    """Adds to each word's row of ``total`` the weights of its n-grams for the candidates, some n-grams at a time."""
    weights, step = model.of(cand), max(1, CHUNK_FLOATS // max(len(cand), 1))
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    cut, i = np.concatenate([[0], edge]), 0
    while i < len(cut):
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + step, "right")) - 1) if cut[-1] - cut[i] > step else len(cut)
        stop = cut[j] if j < len(cut) else len(word)
        total[word[cut[i:j]]] += np.add.reduceat(weights[bucket[cut[i] : stop]], cut[i:j] - cut[i], axis=0)
        i = j


def word_scores(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x languages) relative to the best candidate, and whether a word has a letter. Words of one script are scored
    together, for the languages that use it alone; words without a letter are not scored."""
    g = Grams(w)
    d, width = len(w.start), len(model.names)
    seen = g.mask != 0
    out = np.zeros((d, width), np.float32)
    if not width:
        return out, seen
    masks, which = np.unique(g.mask, return_inverse=True)
    for k, mask in enumerate(masks.tolist()):
        if not mask:
            continue
        cand = model.candidates(mask)
        here = np.flatnonzero(which == k)
        place = np.zeros(d, np.int64)
        place[here] = np.arange(len(here))
        total = np.zeros((len(here), len(cand)), np.float32)
        for word, bucket in g.parts:
            if len(here) < d:
                on = which[word] == k
                word, bucket = place[word[on]], bucket[on]
            if len(word):  # short words have no long n-grams
                _sums(model, cand, word, bucket, total)
        total -= total.max(1, keepdims=True)
        row = np.full((len(here), width), np.float32(WORST + 2 * WORST))
        row[:, cand] = np.maximum(total * 0.5, WORST)
        out[here] = row
    return out, seen


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word of the texts scores[at[i]:at[i+1]]; all texts take a step at a time."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], at[:-1][order]
    out = np.zeros(len(scores), np.int16)
    steps = int(size[0]) if len(size) else 0
    if not steps:
        return out
    live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    final = np.zeros(len(size), np.int16)
    back = []
    v = np.zeros((scores.shape[1], live[0]), np.float32)
    for t in range(steps):
        n = live[t]
        if n < v.shape[1]:
            final[n : v.shape[1]] = v[:, n:].argmax(0)
            v = v[:, :n]
        best = v.argmax(0).astype(np.int16)
        other = v.max(0) - np.float32(switch)
        back.append((v < other, best))
        v = np.maximum(v, other) + scores[first[:n] + t].T
    final[: v.shape[1]] = v.argmax(0)
    state = final.copy()
    for t in range(steps - 1, -1, -1):
        n = live[t]
        moved, best = back[t]
        now = state[:n]
        out[first[:n] + t] = now
        state[:n] = np.where(moved[now, np.arange(n)], best, now)
    return out


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, and spans: array of (lang, start, end) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.uses))  # BUCKETS x languages
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model([], np.zeros((BUCKETS, 0)), np.zeros((0, SCRIPTS)))
        held.names, held.weights, held.uses = shared.value
        names, width = held.names, len(held.names)
        waiting: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in waiting])
            score, seen, begin, end, size = (np.concatenate([x[i] for x in waiting]) for i in range(1, 6))
            count = np.concatenate([x[6] for x in waiting])
            letters = np.concatenate([x[7] for x in waiting])
            waiting.clear()
            at = np.concatenate([[0], np.cumsum(count)])
            best = viterbi(score, at) if width else np.zeros(len(score), np.int16)
            n = len(count)
            doc = np.repeat(np.arange(n), count)
            weight = np.bincount(doc * max(width, 1) + best, size * seen, n * max(width, 1)).reshape(n, -1)
            top = weight.argmax(1)
            whole = weight.sum(1)
            known = letters & (width > 0)
            share = np.where(known & (whole > 0), weight.max(1) / np.maximum(whole, 1), 0.0)
            share[known & (whole == 0)] = 1 / max(width, 1)
            cut = np.ones(len(best), bool)
            if len(best):
                cut[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
            i = np.flatnonzero(cut)
            i = i[known[doc[i]]] if len(i) else i
            stop = np.append(np.flatnonzero(cut), len(best))
            j = stop[np.searchsorted(stop, i, "right")] - 1 if len(i) else i
            spans = pa.StructArray.from_arrays([pa.array([names[k] for k in best[i]], pa.string()), pa.array(begin[i]), pa.array(end[j])], ["lang", "start", "end"])
            per = np.concatenate([[0], np.cumsum(np.bincount(doc[i], minlength=n))]).astype(np.int32) if len(i) else np.zeros(n + 1, np.int32)
            return pa.RecordBatch.from_arrays([ids, pa.array([names[k] if y else "und" for k, y in zip(top, known)], pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(per), spans)], ["doc_id", "lang_pred", "score", "spans"])

        for batch in batches:
            for p in pieces(batch):
                w = text_words(p, hashed=False)
                score, seen = word_scores(w, held)
                chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                count = np.diff(w.at)
                base = np.repeat(chars[utf8(column(p, "text"))[1][:-1]], count)
                letters = np.bincount(np.repeat(np.arange(p.num_rows), count), seen, p.num_rows) > 0
                waiting.append((column(p, "doc_id"), score, seen, chars[w.start] - base, chars[w.end] - base, w.end - w.start, count, letters))
                if sum(len(x[1]) for x in waiting) >= min(BATCH_WORDS, BATCH_BYTES // (4 * max(width, 1))):
                    yield flush()
            if sum(len(x[6]) for x in waiting) >= 20_000:
                yield flush()
        if waiting:
            yield flush()

    return through(of_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, schema)


def op2_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = label(docs, train(docs))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["lang"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))
