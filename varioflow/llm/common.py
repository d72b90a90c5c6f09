"""Shared pieces: shared-folder tables, word arrays, window hashes, packed blobs.

The heavy operators hash every word window of the corpus.  A row per window
would cost a Spark row header per eight-byte hash, so windows travel as packed
numpy blobs, one per (chunk of documents, hash range); Spark shuffles, groups
and retries the blobs like any other rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import shared_dir, shuffle_width, stored  # noqa: F401

#: Text bytes that one vectorised step of a Python worker handles at a time.
CHUNK_BYTES = 4 << 20
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_ranges(df: DataFrame, text: str, per_range: int = 1 << 20, bytes_per_word: float = 5.5) -> int:
    """How many hash ranges keep each near ``per_range`` windows, from the corpus size."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first()["b"] or 0
    return max(2 * shuffle_width(df.sparkSession), int(total / bytes_per_word / per_range) + 1)


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut (or join) Arrow batches so that each holds about ``max_bytes`` of text, never less than a row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, k in enumerate(n):
            if size and size + k > max_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield _joined(held)
                held, size, start = [], 0, i
            size += int(k)
        if start < len(n):
            held.append(batch.slice(start))
    if held:
        yield _joined(held)
    release()


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task, and stages share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole.to_batches()[0] if whole.num_rows else parts[0]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, and the row offsets into them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=bounds[1:])
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.zeros(len(some) + 1, np.int64)
    np.cumsum(some, out=before[1:])
    return (flat if some.all() else flat.filter(pa.array(some))), before[bounds]


def distinct(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words and each word's place among them."""
    coded = pc.dictionary_encode(flat)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash per word."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    names, at = distinct(flat)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    return own[at]


#: Base of the polynomial (any odd 64-bit number).
BASE = 0x9E3779B97F4A7C15


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash mod 2**64 of each ``k`` consecutive values.

    Built by doubling, so a window costs about log2(k) multiply-adds.
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width = np.uint64(BASE), 1
    have, out, out_width = values, None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if out is None:
                    out, out_width = have, width
                else:  # out stands first, have follows it
                    m = len(have) - out_width
                    out = out[:m] * power + have[out_width:]
                    out_width += width
            width *= 2
            if width > k:
                break
            half = width // 2
            have = have[: len(have) - half] * power + have[half:]
            power = power * power
    return mixed(out[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each hash, by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte in planes: zero planes pack to nothing."""
    raw = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw.T).tobytes()


def unplanes(raw: bytes | memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``, as a column."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(mod))
