"""What the corpus operators share: sessions, checkpoints, Arrow text blocks and word hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, release, shared_folder  # noqa: F401

#: Rows and bytes that one Arrow batch to Python holds at most; both bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bytes of text that one vectorised block holds, apart from a single longer document.
BLOCK_BYTES = 256 << 10
#: Rows of ids up to which a table is broadcast (8 or 16 bytes each); more go through a shuffle.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def picked(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is among ``ids`` (left_semi) or isn't (left_anti); no text moves while ids are few."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, how)


def small(table: DataFrame) -> DataFrame:
    """A table that is written or kept, to be broadcast in joins if it has no more than BROADCAST_IDS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast; columns that clash with working names never meet them."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def as_text(column: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty) and with 32-bit offsets from 0."""
    column = pc.fill_null(column.cast(pa.string()), "")
    return pa.concat_arrays([column]) if column.offset else column


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of whole documents of about ``limit`` bytes.

    Yields (index of the first document, the run's bytes, the documents' offsets in them).
    """
    column = as_text(column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; afterwards freed memory goes back to the system, as other stages use the same Python worker."""
    yield from batches
    trim_memory()


def trim_memory() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values (multiply and shift, as in splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        one = np.ones(1, np.uint64)
        _powers[:] = [
            np.concatenate([one, np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_BASE, _BASE_INVERSE)
        ]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), equal for equal content and length."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document: starts and ends in the bytes, and word offsets by document.

    ``space`` tells which bytes part words; left alone, words are ``[^\\x20\\x09-\\x0D]+``.
    """
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every word (A-Z lower-cased) and the word offsets by document."""
    starts, ends, at = words(data, offsets, space)
    return span_hash(prefix_hash(_LOWER[data]), starts, ends), at


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within documents, and their offsets by document.

    A document of fewer words, but one at least, has its whole sequence as its one shingle.
    """
    n = np.diff(at)
    first = np.arange(max(0, len(hashes) - k + 1))
    acc = np.zeros(len(first), np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0xE7037ED1A0B428DB) + hashes[j : j + len(first)] + np.uint64(1))
    owner = np.repeat(np.arange(len(n)), n)[: len(first)]
    acc = acc[first + k <= at[owner + 1]] if len(first) else acc
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return acc, out_at
    out = np.empty(out_at[-1], np.uint64)
    full = np.ones(len(out), bool)
    full[out_at[short]] = False
    out[full] = acc
    for d in short:
        value = np.full(1, n[d], np.uint64)
        for w in hashes[at[d] : at[d + 1]]:
            value = mix(value * np.uint64(0xE7037ED1A0B428DB) + w + np.uint64(1))
        out[out_at[d]] = mix(value ^ np.uint64(0x8EBC6AF09C88C6E3))[0]
    return out, out_at
