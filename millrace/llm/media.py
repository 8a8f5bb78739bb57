"""Media columns: bytes of texts stored as lossless WebP images, and images read back as pixel arrays.

A payload (the text's UTF-8, zero bytes up to a positive multiple of 64) is the run of green samples of an opaque image, 64
pixels a row; beyond 1 MB rows widen, and zeros fill the last one; beyond 256 MB a further file follows. A file notes its
payload's length in a chunk of its own. Samples take prefix codes from their own counts and back-references, few kinds of
samples a palette; ``webp.decode`` reads these as any lossless file: prefix codes, back-references, colour cache, all four
transforms. A text has no use for cache, predictor or cross-colour (one channel, no neighbours above), so images alone have them.

Scale: one pass over the texts without a shuffle; texts are coded side by side, about a megabyte at a time, longer ones
alone, a megabyte after the other.

Null or empty text: 64 zero bytes. Null doc_id and repeated rows: each row is stored. Very long texts: whole, in as
many files as the format needs. Empty table: no rows. A damaged or null file: null pixels and a reason. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .common import column, of_columns, pieces, table, through, utf8

STEP = 64
SIDE = 1 << 14
NOTE = b"PLEN"


def payload_of(text: bytes) -> np.ndarray:
    n = max(STEP, -(-len(text) // STEP) * STEP)
    out = np.zeros(n, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """The stored form of each payload."""
    runs, widths, notes, owner = [], [], [], []
    for k, whole in enumerate(payloads):
        for i in range(0, len(whole), SIDE * SIDE):
            x, width = whole[i : i + SIDE * SIDE], STEP
            while len(x) > width * SIDE:
                width *= 2
            notes.append(NOTE + struct.pack("<IQ", 8, len(x)))
            runs.append(x if len(x) % width == 0 else np.concatenate([x, np.zeros(-len(x) % width, np.uint8)]))
            widths.append(width)
            owner.append(k)
    out = [b""] * len(payloads)
    for k, file in zip(owner, webp.encode_samples(runs, widths, notes)):
        out[k] += file
    return out


def load(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of the first file, and the payload: of every file the green samples that the note counts, or all."""
    pixels, parts, i = None, [], 0
    while i < len(data):
        size = 8 + int.from_bytes(data[i + 4 : i + 8], "little")
        file = data[i : i + size]
        found = webp.decode(file)
        note = webp.chunks_of(file).get(NOTE)
        parts.append(np.ascontiguousarray(found[:, :, 1]).reshape(-1)[: struct.unpack("<Q", note)[0] if note else None])
        pixels = found if pixels is None else pixels
        i += size + (size & 1)
    return pixels, np.concatenate(parts)


def features(pixels: np.ndarray) -> str:
    """Means of the four channels, and a 64-bit hash: whether each of 65 even stretches of pixels is brighter than the one before."""
    flat = pixels.reshape(-1, 4)
    means = flat.mean(0)
    cut = np.linspace(0, len(flat), 66).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat[:, :3].sum(1, dtype=np.int64))])
    bright = (total[cut[1:]] - total[cut[:-1]]) / np.maximum(np.diff(cut), 1)
    code = np.packbits(bright[1:] > bright[:-1]).tobytes().hex()
    return ";".join(f"{c}={m:.3f}" for c, m in zip("rgba", means)) + f";hash={code}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    """Runs of rows, their texts and the stored forms of these."""
    for b in batches:
        for p in pieces(b):
            data, at = utf8(column(p, "text"))
            texts = [data[i:j].tobytes() for i, j in zip(at, at[1:])]
            yield p, texts, store([payload_of(x) for x in texts])


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, texts, files in _stored(batches):
            yield pa.RecordBatch.from_arrays([column(p, "doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return through(of_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


def read_media(rows: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, width, height, pixels (RGBA bytes, row by row) and reason of each file of a binary column."""
    flat = of_columns(rows, key, media)
    kind = flat.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = column(b, media)[i].as_py()
                try:
                    if data is None:
                        raise ValueError("no file")
                    p = webp.decode(data)
                    out = [p.shape[1], p.shape[0], np.ascontiguousarray(p).tobytes(), None]
                except (ValueError, IndexError) as e:
                    out = [None, None, None, str(e)]
                types = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([column(b, key).slice(i, 1), *[pa.array([v], t) for v, t in zip(out, types)]], [key, "width", "height", "pixels", "reason"])

    return through(flat, run, f"`{key}` {kind}, width int, height int, pixels binary, reason string")


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, texts, files in _stored(batches):
            out = []
            for text, media in zip(texts, files):
                pixels, back = load(media)
                raw = back.tobytes()
                out.append((len(text), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-STEP:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels)))
            yield pa.RecordBatch.from_arrays([column(p, "doc_id"), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    docs = of_columns(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return through(docs, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
