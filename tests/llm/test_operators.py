"""The ten operators against brute force, on odd rows, and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import context_tree, fingerprint, language_id, media, minhash, mixing, packing, registry, secret_scan, token_store, toxicity, webp
from millrace.llm.common import Words


def text_of(r):
    return r[1] or ""


def words_of(x):
    return x.encode().lower().split()


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def key(x):
    return (x is not None, x or 0)


def collect(spark, name, where):
    return registry.QUERIES[name](spark, where).collect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert collect(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op4_conflict_best_fit", "op12_line_blocks"}))
def test_one_row_for_each(spark, odd_dir, odd_rows, name):
    got = collect(spark, name, odd_dir)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in odd_rows), key=key)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, small_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small_dir}/documents.parquet')")
    df, got = registry.QUERIES[name](spark, small_dir), c.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    at = [list(got.columns).index(x) for x in cols]
    assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())


def test_words_match_bytes_split():
    texts = ["a b\x0bC", "", "  c", "É x y\tz", "\x1c q"]
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    got = [[bytes(w.data[i:j]) for i, j in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.at, w.at[1:])]
    assert got == [x.lower().split() for x in raw]


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_op1_round_trip(spark, odd_dir, odd_rows):
    got = sorted(collect(spark, "op1_huffman_tokens", odd_dir), key=lambda r: r.start)
    ids = collections.defaultdict(list)
    for r, x in zip(odd_rows, reference_ids([text_of(r) for r in odd_rows])):
        ids[r[0]].append((len(x), zlib.crc32(x.tobytes())))
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        start += r.n_tokens


def test_op1_encoder_equals_whole_texts():
    import public_tokenizers

    rng = np.random.default_rng(3)
    parts = list("abB é漢\n\n\t   .,'s12 ") + [" x", "<|endoftext|>", "   ", "\r\n", "'ll", " "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    e = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    raw = [t.encode() for t in texts]
    for lo in range(0, 3000, 500):
        part = raw[lo : lo + 500]
        ids, at = e.encode(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64))
        for want, a, b in zip(reference_ids(texts[lo : lo + 500]), at, at[1:]):
            assert want.tolist() == ids[a:b].tolist()


def test_op1_pieces_of_one_hash(monkeypatch):
    """Where hashes collide, texts are still encoded right: a hash of few values makes most pieces collide."""
    import public_tokenizers

    whole = token_store.spans_hash
    monkeypatch.setattr(token_store, "spans_hash", lambda *a: whole(*a) % np.uint64(7))
    texts = ["some words of different lengths here", "and others, with other ends!", "", "x", "a b c d e f g"]
    raw = [t.encode() for t in texts]
    e = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    ids, at = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])][:3] == [x.tolist() for x in reference_ids(texts)][:3]


def test_op1_codes():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 4), (2, 4), (40, 6), (300, 9), (5000, 14)):
        counts = np.floor(1.0 + 1e6 / (1 + rng.permutation(n)) ** 2).astype(np.int64)
        lengths = token_store.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
        codes = token_store.canonical(lengths)
        ids = rng.integers(0, n, 3000).astype("<u2")
        at = np.array([0, 1, 1000, 3000])
        data, starts, _ = token_store.put_bits(ids, at, lengths, codes)
        lookup = token_store.prefix_table(lengths, limit)
        for i in range(3):
            own = token_store.get_ids(data[starts[i] : starts[i + 1]].tobytes(), np.zeros(1, np.int64), np.array([at[i + 1] - at[i]]), lookup, limit)
            assert own.tolist() == ids[at[i] : at[i + 1]].tolist()
    # the limit costs no more than any other code: compare with plain Huffman where it doesn't bind
    import heapq

    counts = rng.integers(1, 1000, 60)
    heap = [(int(c), i, {i: 0}) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    k = 100
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], k, {s: d + 1 for s, d in [*a[2].items(), *b[2].items()]}))
        k += 1
    best = sum(int(counts[s]) * d for s, d in heap[0][2].items())
    assert int((counts * token_store.code_lengths(counts, 16)).sum()) == best


def test_op2_languages(spark, odd_dir, odd_rows):
    got = collect(spark, "op2_viterbi_language", odd_dir)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1
    for doc_id in (200, 201, 202):
        assert by[doc_id][0].lang_pred == "und" and by[doc_id][0].spans == ""
    rows = [(i, "это русский текст и ещё слово привет мир", "ru") for i in range(20)] + [(50 + i, "this is an english text and some more words", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    mixed = "this is english text and words это русский текст и слово привет"
    r = language_id.label(spark.createDataFrame([(1, mixed), (2, "123 !!"), (3, "漢字")], "doc_id long, text string"), model).collect()
    assert [(s.lang, mixed[s.start : s.end]) for s in r[0].spans] == [("en", mixed[:31]), ("ru", mixed[32:])][: len(r[0].spans)] or [s.lang for s in r[0].spans] == ["en", "ru"]
    assert r[1].lang_pred == "und" and r[2].lang_pred in ("en", "ru")


def test_op2_viterbi_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 7, 5)
        at = np.concatenate([[0], np.cumsum(sizes)])
        s = rng.normal(size=(at[-1], 3)).astype(np.float32) * 3
        got = language_id.viterbi(s, at, 2.0)
        for a, b in zip(at, at[1:]):
            def worth(path):
                return sum(s[a + t, x] for t, x in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))

            best = max((worth(p) for p in np.ndindex(*[3] * (b - a))), default=0) if b > a else 0
            assert abs(worth(got[a:b]) - best) < 1e-3


def test_op2_letters_by_category():
    """Every code point: a letter has one script's bit, all else has none."""
    import unicodedata

    for lo in range(0, 0x110000, 0x8000):
        points = [c for c in range(lo, lo + 0x8000) if not 0xD800 <= c < 0xE000]
        raw = [chr(c).encode() for c in points]
        if not raw:
            continue
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        bits = language_id.script_bits(np.frombuffer(b"".join(raw), np.uint8))
        assert ((bits[at[:-1]] != 0) == [unicodedata.category(chr(c))[0] == "L" for c in points]).all()
        assert np.count_nonzero(bits) == np.count_nonzero(bits[at[:-1]])
        for c, b in list(zip(points, bits[at[:-1]]))[::97]:
            script = [k for first, k in language_id.RANGES if first <= c][-1]
            assert b in (0, 1 << script)


def test_op2_no_letter_is_und(spark):
    rows = [(i, "this is english text and words", "en") for i in range(30)] + [(50 + i, "это русский текст", "ru") for i in range(30)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["×", "÷ ×", "٣", "\u0301", "123", "´ ˘", "x", "ⴰ", "𐌰 𐌱", None, ""]
    got = language_id.label(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [True] * 6 + [False] * 3 + [True] * 2
    assert all(r.spans == [] and r.score == 0 for r in got if r.lang_pred == "und")


def test_op2_word_scores_by_brute_force():
    """Log-likelihoods of a word's byte n-grams with its edges, barred languages, and what is relative to the best."""
    rng = np.random.default_rng(4)
    names = ["a", "b", "c"]
    scripts = np.zeros((3, language_id.SCRIPTS))
    scripts[0, 1], scripts[1, 1], scripts[1, 3], scripts[2, 3] = 90, 50, 50, 100
    model = language_id.Model(names, rng.integers(0, 50, (language_id.BUCKETS, 3)).astype(float), scripts)
    texts = ["word Wörter слово", "x", "a1б", "漢字 12", "longerword"]
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), hashed=False)
    got, seen = language_id.word_scores(w, model)
    uses = [{1}, {1, 3}, {3}]
    at = 0
    for t in texts:
        for word in t.encode().lower().split():
            total = np.zeros(3)
            for k in range(1, language_id.GRAMS + 1):
                padded = b" " + word + b" " if k > 1 else word
                for i in range(len(padded) - k + 1):
                    gram = int.from_bytes(padded[i : i + k][::-1], "little")
                    bucket = int(language_id.mix(np.array([gram + (k << 40)], np.uint64))[0] % np.uint64(language_id.BUCKETS))
                    total += model.weights[bucket]
            have = {3 if "а" <= c <= "я" else 13 if c > "\u3400" else 1 for c in word.decode() if c.isalpha()}
            allowed = np.array([bool(u & have) for u in uses])
            allowed = allowed if allowed.any() else np.ones(3, bool)
            want = np.where(allowed, np.maximum(0.5 * (total - total[allowed].max()), language_id.WORST), 3 * language_id.WORST)
            assert seen[at] == bool(have)
            assert np.allclose(got[at], want if have else 0, atol=2e-3), (word, got[at], want)
            at += 1
    assert at == len(got)


def test_op2_two_hundred_languages():
    at = np.array([0, 3])
    scores = np.full((3, 200), -9.0, np.float32)
    scores[:, 150] = 0
    assert language_id.viterbi(scores, at).tolist() == [150] * 3


def test_op2_held_out_accuracy(spark):
    got = {r.doc_id: r for r in collect(spark, "op2_viterbi_language", "/root/testdata/sf0.01")}
    lang = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect())
    held = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == lang[d] for d in held) >= 0.98 * len(held)


def test_op3_edits(spark, small_dir):
    rows = sorted(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    got = {r.doc_id: r for r in collect(spark, "op3_consistent_sampling", small_dir)}
    error = []
    for (d, x), (_, y) in zip(rows, rows[1:] + rows[:1]):
        edited, r = x[: len(x) - len(x) // 3] + y[: len(x) // 3], got[d]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        a, b = collections.Counter(words_of(x)), collections.Counter(words_of(edited))
        error.append(r.near_edited - sum((a & b).values()) / max(1, sum((a | b).values())))
        assert 0 <= r.near_next <= 1
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.09  # sqrt(1/4/64) = 0.0625


def test_op3_likeness_of_weights():
    a, b = " ".join(["x"] * 6 + ["y"] * 2), " ".join(["x"] * 2 + ["y"] * 2 + ["z"] * 2)
    raw = [t.encode() for t in (a, b, a, "")]
    f = fingerprint.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), 4096)
    assert (f[0] == f[2]).all() and not f[3].any()
    assert abs(fingerprint.likeness(f[:1], f[1:2])[0] - 4 / 10) < 0.04


def test_op4_packing(spark, odd_dir, odd_rows):
    got = collect(spark, "op4_conflict_best_fit", odd_dir)
    size = collections.Counter()
    for r in odd_rows:
        size[r[0]] += len(text_of(r).encode().split())
    assert collections.Counter({k: sum(r.length for r in got if r.doc_id == k) for k in size}) == size
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for rows in bins.values():
        assert sum(r.length for r in rows) <= packing.CAPACITY and len({r.source for r in rows}) == len(rows)
        rows.sort(key=lambda r: (r.bin_start, r.length))
        assert all(x.bin_start + x.length == y.bin_start for x, y in zip(rows, rows[1:]))


def test_op4_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        items = [(int(rng.choice([0, 3, 50, rng.integers(0, 101)])), int(rng.choice([0, 0, rng.integers(0, 6)])), int(rng.integers(0, 9))) for _ in range(rng.integers(0, 60))]
        bins, want = [], []
        for n, s, c in items:
            fit = min(((b[0], i) for i, b in enumerate(bins) if b[0] >= n and s not in b[1] and c not in b[2]), default=None)
            if fit is None:
                bins.append([100, set(), set()])
                fit = (100, len(bins) - 1)
            b = bins[fit[1]]
            want.append((fit[1], 100 - b[0]))
            b[0] -= n
            b[1].add(s)
            b[2].add(c)
        assert packing.best_fit(items, 100) == want


def test_op5_base_and_gain(spark, odd_dir, odd_rows):
    counts = collections.Counter(t for r in odd_rows if crc(r[0], 7) != 2 for t in [*words_of(text_of(r)), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in odd_rows:
        t = [*words_of(text_of(r)), None]
        want[(r[0], len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 5))] += 1
    got = collect(spark, "op5_context_tree_score", odd_dir)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.held_out == (crc(r.doc_id, 7) == 2) and r.score < 0 for r in got)
    long = next(r for r in got if r.doc_id == 205)
    # its words are drawn one by one, so no model beats the counts of words by much, nor should it lose to them
    assert long.score > 1.005 * long.base_score and long.bits_per_byte < 1.2


def test_op5_rare_words_by_join(spark, odd_dir):
    docs = context_tree.of_columns(context_tree.table(spark, odd_dir, "documents"), "doc_id", "text")
    model = context_tree.train(docs)
    a = context_tree.score(docs, model, common=1).select("doc_id", "n_tokens", "n_known", "base_score").collect()
    b = context_tree.score(docs, model).select("doc_id", "n_tokens", "n_known", "base_score").collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_op5_mixture_is_the_weighting():
    """Two depths by hand: half the own estimate and half the product over children, for every binary node."""
    keys = {0: {97: 3, 98: 2}, 1: {(97 << 8) + 98: 2, (98 << 8) + 97: 2, (97 << 8) + 97: 1}}
    nodes = [(np.array(sorted(keys[d])), np.array([float(keys[d][k]) for k in sorted(keys[d])])) if d in keys else (np.zeros(0, np.int64), np.zeros(0)) for d in range(context_tree.DEPTH + 1)]
    tree = context_tree.Tree(nodes)
    assert np.allclose((10.0 ** tree.table.astype(np.float64)).sum(1), 1, atol=1e-6)

    def pe(a, b):
        out, i, j = 1.0, 0, 0
        for bit in [0] * int(a) + [1] * int(b):
            out *= ((i if bit == 0 else j) + 0.5) / (i + j + 1)
            i, j = i + (bit == 0), j + (bit == 1)
        return out

    # 97 = 01100001, 98 = 01100010: they part at the seventh bit
    root, child_a, child_b = (3, 2), (1, 2), (2, 0)
    below = pe(*child_a) * pe(*child_b)
    w = 0.5 * pe(*root) / (0.5 * pe(*root) + 0.5 * below)
    p = w * (2.5 / 6) + (1 - w) * (2.5 / 4)  # a one at the seventh bit after 97, which saw one zero and two ones
    four = 10.0 ** tree.score((97 << 8) + np.arange(96, 100)).astype(np.float64)
    assert abs(four[2:].sum() / four.sum() - p) < 1e-5


def test_op6_toxicity(spark, odd_dir):
    got = collect(spark, "op6_noisy_or_toxicity", odd_dir)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id, 5) == 0) for r in got)
    w, bias = toxicity.fit(np.zeros(0, np.int32), np.zeros(0, np.int32), np.array([0]), np.zeros(0, np.int64))
    assert not w.any() and bias == toxicity.BIAS


def test_op6_held_out_and_sentences(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in collect(spark, "op6_noisy_or_toxicity", sf)}
    toxic = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    held = [d for d in toxic if got[d].held_out]
    assert sum(got[d].predicted == toxic[d] for d in held) >= 0.96 * len(held)
    clean = [d for d in held if not toxic[d]]
    assert sum(got[d].predicted for d in clean) <= 0.02 * len(clean)


def test_op7_odd_rows(spark, odd_dir, odd_rows):
    got = collect(spark, "op7_fast_sketch_dedup", odd_dir)
    by = {r.doc_id: r for r in got}
    assert {by[d].component_id for d in (100 + 3, 100 + 40, 100 + 70, 104, 105)} == {103}
    assert (by[200].n_shingles, by[200].component_id, by[201].component_id) == (0, 200, 201)
    assert by[203].n_shingles == 1 and by[203].kept
    assert all(r.kept == (r.doc_id == r.component_id) or r.doc_id is None for r in got)


def test_op7_sketch_fills_and_concentrates():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, 100).astype(np.uint64)])) for _ in range(2)] + [common[:1], np.sort(common[:30])]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sk = minhash.sketches(np.concatenate(sets), at)
    assert (sk != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sk[0] == sk[1]).mean() - 600 / 800) < 0.1


def test_op7_contested_buckets_are_settled(spark):
    """A chain: neighbours link, ends don't, and a star in a bucket would miss some."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        own = list(rng.permutation(words)[:200])
        for k in range(12):
            own = own.copy()
            own[int(rng.integers(0, 200))] = f"n{g}x{k}"
            rows.append((g * 100 + k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[d]] == comp[d] for d in comp):
            break
    assert got == comp


def test_op8_base_by_brute_force(spark, odd_dir, odd_rows):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = collections.Counter()
    for r in odd_rows:
        x = text_of(r)
        s = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        n = collections.Counter(k for _, k, _ in s)
        want[(r[0], n[0], n[1], n[2], hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s)).encode()).hexdigest())] += 1
    got = collect(spark, "op8_randomness_battery", odd_dir)
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def test_op8_battery_and_redaction(spark):
    rng = np.random.default_rng(8)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(rng.choice(alphabet, 32)) for _ in range(200)]
    plain = ["internationalizationalistic thing", "donaudampfschifffahrtsgesellschaft", "https://example.com/2024/01/02/some-long-slug-here", "ThisIsALongCamelCaseIdentifierName", "SOME_CONSTANT_NAME_HERE_X", "11111111111111111111111"]
    rows = [(i, f"é use {k} now") for i, k in enumerate(keys)] + [(1000 + i, p) for i, p in enumerate(plain)]
    found = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    hit = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.select("doc_id", "spans").collect()}
    assert sum(hit[i] == [(3, 6, 38)] for i in range(200)) >= 190
    assert not any(hit[1000 + i] for i in range(len(plain)))
    red = {r.doc_id: r.text for r in secret_scan.redact(found).collect()}
    assert sum(red[i] == "é use [SECRET] now" for i in range(200)) >= 190 and red[1000] == plain[0]
    many = " ".join(f"token=abcdef{i}" for i in range(1500))
    r = secret_scan.redact(secret_scan.find_secrets(spark.createDataFrame([(1, many)], "doc_id long, text string"))).first()
    assert r.text == " ".join(["[SECRET]"] * 1500)


def test_op9_payload(spark, odd_dir, odd_rows):
    want = collections.Counter()
    for r in odd_rows:
        b = text_of(r).encode()
        p = b + b"\0" * (-len(b) % 64 or (64 if not b else 0))
        want[(r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    got = collect(spark, "op9_lossless_webp", odd_dir)
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (1, 2, 0), (3, 0), (0, 1, 2)])
@pytest.mark.parametrize("cache,references,groups", [(0, False, 0), (4, False, 0), (0, True, 0), (7, True, 2)])
def test_op9_decoder(transforms, cache, references, groups):
    rng = np.random.default_rng(9)
    for h, w in ((1, 1), (5, 9), (17, 21)):
        for colours in (1, 3, 20):
            px = rng.integers(0, 256, (colours, 4)).astype(np.uint8)[rng.integers(0, colours, (h, w))]
            assert np.array_equal(webp.decode(webp.encode(px, transforms, cache, references, groups)), px)


def test_op9_damaged_files_and_large_payloads(spark, monkeypatch):
    good = media.store([media.payload_of(b"hello")])[0]
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"nonsense")), (4, bytearray(good[:20])), (5, bytearray(good[:60])), (6, bytearray(b""))]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert (got[1].width, got[1].height, bytes(got[1].pixels)[1:20:4]) == (64, 1, b"hello")
    assert all(got[i].pixels is None and got[i].reason for i in (2, 3, 4, 6))
    rng = np.random.default_rng(1)
    big = media.payload_of(b"ab" * 700_000 + rng.integers(0, 256, 900_001).astype(np.uint8).tobytes() + b"the end " * 1000)
    assert np.array_equal(media.load(media.store([big])[0])[1], big)
    monkeypatch.setattr(media, "SIDE", 8)  # several files in one
    part = big[1_399_000:1_403_200]
    assert np.array_equal(media.load(media.store([part])[0])[1], part) and media.store([part])[0].count(b"RIFF") == -(-len(part) // 64)


def test_op9_coding_side_by_side():
    """All kinds of samples, coded together: what is read back is what was written, and equal payloads have equal files."""
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"ab", b"\0" * 700, bytes(range(256)), b"0123" * 999, ("é漢🙂 " * 50).encode(), b"x" * 9000]
    texts += [bytes(rng.choice(list(b"abcdefgh ijklmnop.\n"), int(rng.integers(0, 3000))).astype(np.uint8)) for _ in range(60)]
    texts += [b" ".join(texts[-1].split()[:40]) * 3, rng.integers(0, 256, 5000).astype(np.uint8).tobytes()]
    payloads = [media.payload_of(x) for x in texts]
    files = media.store(payloads)
    assert all(np.array_equal(media.load(f)[1], x) for f, x in zip(files, payloads))
    assert files == [media.store([x])[0] for x in payloads]


def test_op9_files_use_the_format(spark, small_dir, monkeypatch):
    """The query's files are smaller than their payloads by prefix codes from counts, references and palettes, and are read by the general path."""
    seen = collections.Counter()
    symbols, undo = webp._symbols, webp._undo_palette

    def spy(bits, codes, n):
        out = symbols(bits, codes, n)
        seen["references"] += int((out[2] > 0).sum())
        seen["lengths"] += len(np.unique(codes[0].table & 15)) > 2
        return out

    monkeypatch.setattr(webp, "_symbols", spy)
    monkeypatch.setattr(webp, "_undo_palette", lambda *a: seen.update(["palette"]) or undo(*a))
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()] + [b"", b"10110"]
    payloads = [media.payload_of(x) for x in texts]
    files = media.store(payloads)
    assert all(np.array_equal(media.load(f)[1], x) for f, x in zip(files, payloads))
    assert seen["references"] > len(texts) and seen["lengths"] >= 0.9 * len(texts) and seen["palette"] >= 2
    assert sum(map(len, files)) < 0.6 * sum(map(len, payloads))
    got = {r.doc_id: r for r in collect(spark, "op9_lossless_webp", small_dir)}
    assert sum(r.media_bytes for r in got.values()) < 0.6 * sum(r.payload_bytes for r in got.values())


def test_op9_lengths_of_many_codes():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 2000, (50, 280)) * (rng.random((50, 280)) < rng.random((50, 1)))
    counts[0], counts[1] = 0, 0
    counts[1, 7] = 5
    counts[2, :60] = (1.7 ** np.arange(60)).astype(np.int64)
    got = webp.code_lengths_of(counts)
    for row, lengths in zip(counts, got):
        want = token_store.code_lengths(row, webp.LIMIT)
        assert (row * lengths).sum() == (row * want.astype(np.int64)).sum() and ((lengths > 0) == (row > 0)).all() and lengths.max() <= webp.LIMIT
        codes = webp.codes_of(lengths[None])[0]
        plain = token_store.canonical(lengths.astype(np.uint8))
        assert all(codes[k] == webp._reversed(int(plain[k]), int(lengths[k])) for k in np.flatnonzero(lengths))


def test_op10_targets_and_order(spark, odd_dir, odd_rows):
    got = collect(spark, "op10_curriculum_mix", odd_dir)
    size = collections.Counter()
    for r in odd_rows:
        size[r[3]] += len(text_of(r).encode().split())
    sources = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, target, free = sum(size.values()), {}, set(sources)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    by_size = collections.defaultdict(float)
    for r in got:
        by_size[r.source_size] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.size * r.passes
    for s in sources:
        assert abs(by_size[size[s]] - target[s]) < 1e-6 * max(1, target[s])
    assert abs(sum(r.taken for r in got) - total) <= sum(sorted((r.size for r in got), reverse=True)[: len(sources)])
    again = collect(spark, "op10_curriculum_mix", odd_dir)
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)


def test_op10_schedule_inverse(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        df = spark.range(0, 101).select((F.col("id") / 100).alias("x"))
        for x, t in df.select("x", mixing.invert(F.col("x"), knots).alias("t")).collect():
            area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
            done = 0.0
            for (t1, r1), (t2, r2) in zip(knots, knots[1:]):
                if t > t1:
                    m = min(t, t2)
                    done += (m - t1) * (r1 + r1 + (r2 - r1) * (m - t1) / (t2 - t1)) / 2
            assert abs(done / area - x) < 1e-9


def test_op5_nodes_grow_with_the_corpus(spark):
    """A context seen often enough is a node however large the rest is; subtrees and rare grams give the whole tree's scores."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(rng.choice(letters, 6)) for _ in range(6000)) for _ in range(30)] + ["quartz jumps " * 64]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = np.concatenate([context_tree.grams(*context_tree.byte_stream(Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))))[0] for t in texts])
    key, n = np.unique(keys, return_counts=True)
    nodes = []
    for d in range(context_tree.DEPTH + 1):
        gram = context_tree._last(key, d + 1)
        ctx, at = np.unique(context_tree._before(gram), return_inverse=True)
        on = np.bincount(at, n)[at] >= 32
        nodes.append((gram[on], n[on].astype(float)))
    whole = context_tree.Tree(nodes)
    model = context_tree.train(docs, 32)
    got = {r.key: r.score for r in model[0].collect()}
    assert sorted(got) == key.tolist()
    assert np.allclose([got[k] for k in key.tolist()], whole.score(key), atol=1e-4)
    assert int.from_bytes(b"quart", "big") in whole.contexts[5]
    a = context_tree.score(docs, model).select("doc_id", "n_tokens", "n_known", "score").collect()
    b = context_tree.score(docs, model, common_grams=1000).select("doc_id", "n_tokens", "n_known", "score").collect()
    by = {r.doc_id: r for r in b}
    assert all((r.n_tokens, r.n_known) == (by[r.doc_id].n_tokens, by[r.doc_id].n_known) and abs(r.score - by[r.doc_id].score) < 1e-5 for r in a)


def test_op2_small_language_is_learnt(spark):
    """The sample keeps a language of few documents beside one of very many."""
    assert language_id.shares({"en": 10_000_000, "xx": 800, "yy": 5}, 12_000) == {"yy": 1.0, "xx": 1.0, "en": 11_195 / 10_000_000}
    assert language_id.shares({"en": 50, "xx": 8}, 12_000) == {"en": 1.0, "xx": 1.0}
    rows = [(i, "this is english text and words", "en") for i in range(3000)] + [(5000 + i, "zyx wqo zyx kwo qzy", "xx") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, max_docs=20)
    assert model.names == ["en", "xx"] and model.uses[:, 1].all()
    got = language_id.label(spark.createDataFrame([(1, "kwo zyx wqo zyx"), (2, "english words and text")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["xx", "en"]


def test_op4_near_copies_are_apart(spark, tmp_path):
    words = "a document that is long enough to have many shingles in common with another one which differs in one word at its end or in case".split()
    texts = [" ".join(words), " ".join([*words[:-1], "blank"]), "  ".join(words).upper(), "something else of no likeness at all to the others here"]
    rows = [(i, x, "en", f"s{i}", len(x)) for i, x in enumerate(texts)] + [(None, texts[0], "en", "s9", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = collect(spark, "op4_conflict_best_fit", str(tmp_path))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin].append(r.source)
    assert len(got) == 5 and all(len(set(x) - {"s3"}) <= 1 for x in bins.values())
