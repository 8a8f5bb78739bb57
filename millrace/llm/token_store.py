"""Token ids in files, by canonical length-limited Huffman codes.

Texts are encoded by a tokenizer of the tokenizers library, and an end id closes each. Pieces recur, so one that a
worker has met is not encoded again: a cut before a blank or after a single line end, if a visible character
follows, or between a letter and a mark never changes the tokens on either side, and what lies between cuts is
encoded one for all.

Code: counts of ids over all documents, lengths limited by package-merge, canonical codes. Files: a folder with
``blocks`` (Parquet, a folder for each range of doc_id, ascending; rows ascending), ``code`` (the length of each
id's code) and ``index`` (documents and ids of each range, and ids before it). A block holds whole documents, its
bit stream, and the bit offset of every ``STEP``-th id of each document; from these checkpoints a table of all
prefixes decodes thousands of places at once, and a block needs nothing but the code.

Scale: texts are read and encoded once; ids go to the shared folder, counts are arrays of the vocabulary's
size, and only coded bits are shuffled, by ranges of doc_id from approximate quantiles. The driver holds
counts of the vocabulary and a row for each range.

Null or empty text: the end id alone. Null doc_id: before all others. Repeated rows: each is stored, ordered by
length and content. A very long text: one block. Empty table: empty files. Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANGE_BYTES, column, drop, new_path, of_columns, pieces, save, spans_hash, table, through, utf8

END_ID = 2
MAX_BITS = 18
STEP = 128
BLOCK_IDS = 1 << 18
#: Pieces that a worker keeps, some 30 bytes each.
CACHE_PIECES = 2_500_000
#: Pieces that are encoded as one text; longer texts are slower for the library.
JOINED = 32
#: Bytes of text that are encoded at once; small, as two workers share an executor with its heap.
ENCODE_BYTES = 1 << 20
#: ASCII blanks and control separators, and the first bytes of all other blanks.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(c) for c in ".,!?;:"]] = True


class _Pool:
    """Ids of pieces of text by the pieces' hashes: sorted keys over one run of ids, and a mark that a piece has to have too."""

    def __init__(self, dtype: str):
        self.keys, self.start, self.length, self.mark = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, dtype), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def add(self, keys: np.ndarray, mark: np.ndarray, ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """New keys, ascending, with their marks, a run of ids and where in it those of each key are."""
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(ids)), self.ids.dtype)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        to = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.length = np.insert(self.keys, to, keys), np.insert(self.start, to, self.used + begin), np.insert(self.length, to, length)
        self.mark = np.insert(self.mark, to, mark)
        self.used += len(ids)


class Encoder:
    """Whole texts to ids; equal to the tokenizer's own result on each text. Pieces are keyed by 64-bit hashes; one whose length, first
    or last byte isn't that of the piece with its hash has its text encoded whole."""

    def __init__(self, path: str, end_id: int, dtype: str = "<u2"):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.dtype, self.pool = Tokenizer.from_file(path), end_id, dtype, _Pool(dtype)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each id: a byte-level vocabulary spells a byte by one character.
        self.size = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece where its own begin and how many they are. Pieces that may stand side by side are encoded
        joined, some at a time, and ids are dealt out by bytes; a line end parts those that would merge."""
        begin, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        blank = [k for k, x in enumerate(pieces) if x[:1] == b" "]
        solid = [k for k, x in enumerate(pieces) if x[:1] != b" " and x and not _BLANK[x[0]] and not _BLANK[x[-1]]]
        alone = sorted(set(range(len(pieces))).difference(blank, solid))
        flat, used = [], 0
        for which, gap in ((blank, b""), (solid, b"\n")):
            if not which:
                continue
            own = [pieces[k] for k in which]
            ids = np.concatenate(self.ids([gap.join(own[i : i + JOINED]).decode() for i in range(0, len(own), JOINED)]))
            size = np.array([len(x) for x in own], np.int64)
            after = np.full(len(own), len(gap), np.int64)
            after[JOINED - 1 :: JOINED] = 0
            after[-1] = 0
            end = np.cumsum(size + after) - after
            place = np.cumsum(self.size[ids])
            begin[which] = used + np.searchsorted(place, end - size, "right")
            length[which] = np.searchsorted(place, end) + 1 + used - begin[which]
            flat.append(ids)
            used += len(ids)
        for k, ids in zip(alone, self.ids([pieces[k].decode() for k in alone])):
            begin[k], length[k] = used, len(ids)
            flat.append(ids)
            used += len(ids)
        return np.concatenate(flat), begin, length

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a UTF-8 buffer, each with the end id, and their n+1 offsets."""
        n, count = len(data), len(at) - 1
        follows = np.zeros(n, bool)  # whether a visible character of a kind that is safe to cut at comes next
        follows[:-1] = ~_BLANK[data[1:]]
        last = at[1:][np.diff(at) > 0] - 1
        follows[last] = False
        solid = np.zeros(n, bool)
        solid[1:] = ~_BLANK[data[:-1]]
        cut = (data == 32) & follows
        line = np.flatnonzero((data == 10) & follows & solid)
        cut[line + 1] = True
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        cut[at[:-1][np.diff(at) > 0]] = True
        raw = data.tobytes()
        odd = sorted({int(np.searchsorted(at, m.start(), "right")) - 1 for s in self.special for m in re.finditer(re.escape(s), raw)})
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)[: len(start)]
        keys = spans_hash(data, start, end)
        mark = (end - start) << 16 | data[start].astype(np.int64) << 8 | data[end - 1]
        order = np.argsort(keys)
        ordered = keys[order]
        change = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        distinct, first = ordered[change], order[change]  # ascending: lookups walk through memory
        pool = self.pool
        spot, hit = pool.find(distinct)
        if not hit.all():
            new = np.flatnonzero(~hit)
            learnt = self.learn([raw[i:j] for i, j in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            if len(pool.keys) + len(new) > CACHE_PIECES:  # full: these serve this batch alone
                side = _Pool(self.dtype)
                keep = spot[hit]
                a, b = pool.start[keep], pool.length[keep].astype(np.int64)
                gather = np.repeat(a - np.cumsum(b) + b, b) + np.arange(int(b.sum()))
                side.add(distinct[hit], pool.mark[keep], pool.ids[gather], np.cumsum(b) - b, b)
                pool = side
            pool.add(distinct[new], mark[first[new]], *learnt)
            spot, _ = pool.find(distinct)
        whole = np.empty(len(keys), np.int64)
        whole[order] = spot[np.cumsum(change) - 1]
        spot = whole
        other = np.flatnonzero(pool.mark[spot] != mark)  # another piece of this hash
        odd = sorted({*odd, *(np.searchsorted(at, start[other], "right") - 1).tolist()})
        piece = np.searchsorted(start, at)  # of each text's first piece
        begin, length = pool.start[spot], pool.length[spot].astype(np.int64)
        ends = pool.used
        ids = np.append(pool.ids[:ends], np.array([self.end_id], self.dtype))
        begin, length = np.insert(begin, piece[1:], ends), np.insert(length, piece[1:], 1)
        offset = np.concatenate([[0], np.cumsum(length)])
        out = ids[np.repeat(begin - offset[:-1], length) + np.arange(int(offset[-1]))]
        own = offset[piece + np.arange(count + 1)]
        if odd:
            parts = [out[i:j] for i, j in zip(own, own[1:])]
            for k, x in zip(odd, self.ids([raw[at[k] : at[k + 1]].decode() for k in odd])):
                parts[k] = np.append(x, np.array([self.end_id], self.dtype))
            out, own = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return out, own


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """doc_id, n_tokens, ids (binary, ``dtype``) of each document; ids end with ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path, end_id, dtype)  # of this task alone: nothing of it is left in an idle worker
        for batch in batches:
            for p in pieces(batch, limit=ENCODE_BYTES):
                ids, at = encoder.encode(*utf8(column(p, "text")))
                binary = pa.Array.from_buffers(pa.binary(), p.num_rows, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([column(p, "doc_id"), pa.array(np.diff(at)), binary], ["doc_id", "n_tokens", "ids"])

    return through(of_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids binary")


def counts_of(tokens: DataFrame, vocabulary: int, dtype: str = "<u2") -> np.ndarray:
    """How often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(column(b, "ids").to_pylist()), dtype), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    rows = through(tokens.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64)
    marks, merged = [], np.zeros(0)
    for _ in range(limit):
        pack = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pack])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        marks.append(order < n)
    take = 2 * n - 2
    for mark in reversed(marks):
        leaves = int(mark[:take].sum())
        out[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def put_bits(ids: np.ndarray, at: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents ids[at[i]:at[i+1]], each from a byte's start: bytes, byte offsets of documents (n+1), and
    the bits before each id (n+1 of them) without the fill at the ends of documents."""
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(lengths[ids], out=total[1:], dtype=np.int64)
    bits = total[at[1:]] - total[at[:-1]]
    starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    words = np.zeros(int(starts[-1]) // 8 + 2, np.uint64)
    if len(ids):
        place = total[:-1] + np.repeat(starts[:-1] * 8 - total[at[:-1]], np.diff(at))
        w, offset = place >> 6, (place & 63).astype(np.uint64)
        top = (codes << (np.uint64(64) - np.maximum(lengths, 1).astype(np.uint64)))[ids]  # from the highest bit on
        cut = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        words[w[cut]] = np.bitwise_or.reduceat(top >> offset, cut)
        last = np.append(cut[1:], len(ids)) - 1  # only a word's last id can reach into the next
        over = last[offset[last] + lengths[ids[last]] > 64]
        words[w[over] + 1] |= top[over] << (np.uint64(64) - offset[over])
    return words.astype(">u8").view(np.uint8)[: int(starts[-1])], starts, total


def prefix_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For every ``limit`` bits: the id they begin with * 32 + its length."""
    out = np.zeros(1 << limit, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(1, limit - lengths[order].astype(np.int64))
    filled = np.repeat(order.astype(np.uint32) * np.uint32(32) + lengths[order], span)
    out[: len(filled)] = filled
    return out


def get_ids(payload: bytes, checkpoints: np.ndarray, counts: np.ndarray, lookup: np.ndarray, limit: int) -> np.ndarray:
    """The ids after each checkpoint (bit offset), ``counts`` of them, one run after another."""
    raw = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.uint64)
    pair = (raw[:-1] << np.uint64(32)) | raw[1:]
    out = np.empty(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    to = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    place, left = checkpoints[order].astype(np.int64), counts[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))
        p = place[:n]
        hit = lookup[((pair[p >> 5] >> (np.uint64(64 - limit) - (p & 31).astype(np.uint64))) & np.uint64((1 << limit) - 1)).astype(np.int64)]
        out[to[:n] + k] = hit >> np.uint32(5)
        p += (hit & np.uint32(31)).astype(np.int64)
    return out


def _checkpoints(n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many checkpoints each document has, and the ids after each."""
    per = -(-n_tokens // STEP)
    size = np.full(int(per.sum()), STEP, np.int64)
    size[np.cumsum(per) - 1] = n_tokens - (per - 1) * STEP
    return per, size


def write(tokens: DataFrame, path: str, vocabulary: int, dtype: str = "<u2", limit: int = MAX_BITS, shards: int | None = None) -> None:
    """Writes ``tokenize``'s rows as files under ``path``."""
    spark = tokens.sparkSession
    lengths = code_lengths(counts_of(tokens, vocabulary, dtype), limit)
    codes = canonical(lengths)
    shards = shards or max(1, -(-(tokens.agg(F.sum("n_tokens")).first()[0] or 0) * np.dtype(dtype).itemsize // RANGE_BYTES))
    low = -(1 << 63)
    grid = [i / shards for i in range(1, shards)] or [0.5]
    bounds = tokens.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(low)), grid, 20 * shards)).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64)) if shards > 1 else np.zeros(0, np.int64)
    parts = len(bounds) + 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "ids"):
                n = column(p, "n_tokens").to_numpy()
                at = np.concatenate([[0], np.cumsum(n)])
                data, starts, total = put_bits(np.frombuffer(b"".join(column(p, "ids").to_pylist()), dtype), at, lengths, codes)
                per, size = _checkpoints(n)
                first = np.repeat(at[:-1], per)
                spots = (total[first + np.arange(len(size)) * STEP - np.repeat((np.cumsum(per) - per) * STEP, per)] - total[first]).astype("<u4").tobytes()
                cut = np.concatenate([[0], np.cumsum(per)]) * 4
                raw = data.tobytes()
                doc = column(p, "doc_id").fill_null(low).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [column(p, "doc_id"), pa.array(n), pa.array(np.searchsorted(bounds, doc, "left").astype(np.int32)), pa.array([raw[a:b] for a, b in zip(starts, starts[1:])], pa.binary()), pa.array([spots[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                    ["doc_id", "n_tokens", "part", "bits", "spots"],
                )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        state = {"part": None, "before": 0, "ids": 0}

        def flush() -> pa.RecordBatch:
            doc, n, _, bits, spots = zip(*held, strict=True)
            base = np.concatenate([[0], np.cumsum([len(x) for x in bits])])[:-1] * 8
            marks = np.concatenate([np.frombuffer(s, "<u4").astype(np.int64) + b for s, b in zip(spots, base, strict=True)])
            out = pa.RecordBatch.from_arrays(
                [pa.array([state["part"]], pa.int32()), pa.array([state["before"]], pa.int64()), pa.array([list(doc)], pa.list_(pa.int64())), pa.array([list(n)], pa.list_(pa.int64())), pa.array([marks.astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(bits)], pa.binary())],
                ["part", "before", "doc_ids", "n_tokens", "marks", "payload"],
            )
            state["before"] += state["ids"]
            state["ids"] = 0
            held.clear()
            return out

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if held and (row[2] != state["part"] or state["ids"] + row[1] > BLOCK_IDS):
                    yield flush()
                if row[2] != state["part"]:
                    state["part"], state["before"] = row[2], 0
                held.append(row)
                state["ids"] += row[1]
        if held:
            yield flush()

    coded = through(tokens, code, "doc_id long, n_tokens long, part int, bits binary, spots binary")
    rows = coded.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n_tokens", "bits")
    blocks = through(rows, block, "part int, before long, doc_ids array<long>, n_tokens array<long>, marks binary, payload binary")
    blocks.write.partitionBy("part").parquet(f"{path}/blocks")
    spark.createDataFrame([(limit, bytearray(lengths.tobytes()))], "bits int, lengths binary").coalesce(1).write.parquet(f"{path}/code")
    rows = sorted(_blocks(spark, path).groupBy("part").agg(F.sum(F.size("doc_ids")).alias("docs"), F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids")).collect())
    start, index = 0, []
    for part, n, ids in rows:  # a row for each range
        index.append((part, n, ids, start))
        start += ids
    spark.createDataFrame(index, "part int, docs long, ids long, start long").coalesce(1).write.parquet(f"{path}/index")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("before long, doc_ids array<long>, n_tokens array<long>, marks binary, payload binary, part int").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens of every document in files that ``write`` made, and its ids (array), or with ``digest``
    their crc32 as little-endian unsigned 32-bit integers."""
    limit, raw = spark.read.schema("bits int, lengths binary").parquet(f"{path}/code").first()
    lengths = np.frombuffer(bytes(raw), np.uint8)
    starts = {r.part: r.start for r in spark.read.schema("part int, docs long, ids long, start long").parquet(f"{path}/index").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = prefix_table(lengths, limit)
        for b in batches:
            for part, before, doc, n, marks, payload in zip(*[column(b, c).to_pylist() for c in ("part", "before", "doc_ids", "n_tokens", "marks", "payload")], strict=True):
                n = np.array(n, np.int64)
                _, size = _checkpoints(n)
                ids = get_ids(payload, np.frombuffer(marks, "<i8"), size, lookup, limit).astype("<u4")
                at = np.concatenate([[0], np.cumsum(n)])
                if digest:
                    last = pa.array([zlib.crc32(ids[i:j]) for i, j in zip(at, at[1:])], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(starts[part] + before + at[:-1]), pa.array(n), last], ["doc_id", "start", "n_tokens", "ids"])

    kind = "ids_crc32 long" if digest else "ids array<long>"
    return through(_blocks(spark, path), run, f"doc_id long, start long, n_tokens long, {kind}")


def op1_huffman_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokens = save(tokenize(table(spark, sf_dir, "documents"), tokenizer), "tokens")
    path = new_path(spark, "token-files")
    write(tokens, path, Tokenizer.from_file(tokenizer).get_vocab_size())
    drop(tokens)
    return read(spark, path, digest=True)
