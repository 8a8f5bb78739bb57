"""What the operators share: tables, the shared folder, Arrow text buffers and word hashes.

Texts are handled as whole UTF-8 buffers of an Arrow batch. A null text counts as the empty one. Words are
maximal runs of bytes outside 0x20 and 0x09-0x0D; ``lower`` maps A-Z alone.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on one machine, as in tests, a temporary one. A cluster
    that names no folder is refused: its executors wouldn't see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="millrace-"))
        base = f"file://{_LOCAL[0]}"
    return base.rstrip("/")


#: The folders that the run at hand has made; a run that begins its own list sees no other's.
_RUN: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def tables_of_run() -> Iterator[list[str]]:
    """A list of the folders that are made within, in this thread."""
    mine: list[str] = []
    before = _RUN.set(mine)
    try:
        yield mine
    finally:
        _RUN.reset(before)


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    mine = _RUN.get()
    if mine is not None:
        mine.append(path)
    return path


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: what follows doesn't depend on lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    mine = _RUN.get()
    if mine is not None:
        mine[:] = [x for x in mine if x.rsplit("/", 1)[1] != path.rstrip("/").rsplit("/", 1)[1]]


def drop(df: DataFrame) -> None:
    """Deletes a table that ``save`` wrote and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        _delete(spark, path)


def release() -> None:
    """Gives the memory that a pass has freed back to the system: idle workers stand beside those of the next stage."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def through(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``, after whose last batch a worker gives its memory back."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(lean, schema)


def of_columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, exact case first, so that extra columns with clashing names do no harm."""
    have = df.columns
    picked = []
    for n in names:
        at = [i for i, c in enumerate(have) if c == n] or [i for i, c in enumerate(have) if c.lower() == n.lower()]
        if not at:
            raise ValueError(f"no column {n} among {have}")
        picked.append(at[0])
    flat = df.toDF(*[f"_{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"_{i}").alias(n) for i, n in zip(picked, names, strict=True)])


def placed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """These columns and ``name``, which no two rows share: a row's file and its place there. What isn't just a read of files is
    written first."""
    files = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and df.inputFiles()
    if not files or "_metadata" in [c.lower() for c in df.columns]:
        df = save(of_columns(df, *columns), "rows")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return of_columns(df.drop(name).withColumn(name, place), *columns, name)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its values; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with at most ``limit`` bytes of text, or one row."""
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64 bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


class Words:
    """Words of a batch of texts: start, end (bytes of ``data``), the 64-bit hash of each, and the n+1 word
    offsets of the texts in ``at``. Equal words have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True):
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        solid = ~SPACE[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edge = offsets[:-1][offsets[:-1] < n]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.at = np.searchsorted(self.start, offsets)
        if hashed:
            self.hash = spans_hash(data, self.start, self.end)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a buffer by one prefix sum of a polynomial modulo 2**64."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def text_words(batch: pa.RecordBatch, **how) -> Words:
    return Words(*utf8(batch.column(batch.schema.get_field_index("text"))), **how)


def bisect_left(items: Column, value: Column) -> Column:
    """How many of a sorted array's items are below ``value``, by halving."""
    kind = "struct<lo:int,hi:int>"

    def step(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        less = F.get(items, mid) < value
        half = F.struct(F.when(less, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(less, a["hi"]).otherwise(mid).alias("hi")).cast(kind)
        return F.when(a["lo"] >= a["hi"], a).otherwise(half)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi")).cast(kind), step, lambda a: a["lo"])


#: Bytes of a range of documents that is sorted in one task.
RANGE_BYTES = 16 << 20


def crc_mod(n: int, doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
