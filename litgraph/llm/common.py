"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, durable, shared_folder

__all__ = ["blocks", "components", "durable", "id_remainder", "key_map", "read", "release", "shared_folder", "text_bytes", "without_cycles", "word_hashes"]

#: Bytes of text that a task turns into Python or numpy objects at a time.
BLOCK_BYTES = 4 << 20
#: Bits of a map of keys, for each of them, and the most bits it has.
MAP_BITS, MOST_BITS = 16, 1 << 27
#: Bytes of text whose words are hashed at a time.
HASH_BYTES = 1 << 17
#: Factor of the hashes of words, and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A random value for each byte, for hashes of words.
BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches so that a slice has at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_bytes(batch.column(column))[2])
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])
    release()


def release() -> None:
    """Gives freed memory back to the system at the end of a task, as its worker stays beside the others of an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying: (bytes, start of each row, length of each row)."""
    if pa.types.is_large_string(texts.type):
        width = np.dtype(np.int64)
    else:
        width = np.dtype(np.int32)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width, len(texts) + 1, texts.offset * width.itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    length = np.diff(at)
    if texts.null_count:
        length = np.where(np.asarray(texts.is_valid()), length, 0)
    return whole, at[:-1], length


@contextmanager
def without_cycles() -> Iterator[None]:
    """Work that makes many lists and no reference cycles, during which the search for cycles only costs time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@dataclass(frozen=True)
class KeyMap:
    """A bit map of 64-bit keys: all of them are in it, and few others."""

    bits: int
    packed: Broadcast

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys % self.bits
        return (self.packed.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def column(self, key: Column) -> Column:
        def has(keys: pa.Array) -> pa.Array:
            return pa.array(self.has(keys.to_numpy()))

        return F.arrow_udf(has, "boolean")(key)


def key_map(keys: DataFrame, key: str) -> KeyMap:
    """Built by Spark and broadcast: MAP_BITS bits for each key, MOST_BITS (16 MB) at most; a full map only lets more through."""
    bits = max(1 << 15, min(MOST_BITS, MAP_BITS * keys.count()))
    at = F.pmod(key, F.lit(bits)) + 1  # positions are counted from 1
    buckets = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    packed = np.zeros(((bits >> 15) + 1) << 12, np.uint8)
    for r in buckets:
        packed[(r["bucket"] - 1) << 12 : r["bucket"] << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return KeyMap(bits, keys.sparkSession.sparkContext.broadcast(packed))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, ``n`` of them at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            _powers[k] = np.full(n, base)
            _powers[k][0] = 1
            np.multiply.accumulate(_powers[k], out=_powers[k])
    return _powers


def word_hashes(raw: np.ndarray, borders: np.ndarray, gap_bytes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of these bytes; no word goes over a border.

    ``gap_bytes`` says which bytes part words, ``value`` what each byte counts in a hash.
    Bytes are hashed in pieces cut between words, so memory is that of the words.
    """
    starts, ends, hashes, low, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0, len(raw)
    gap = gap_bytes[raw]
    while low < n:
        high = min(low + HASH_BYTES, n)
        if high < n:
            back = int(np.argmax(gap[low:high][::-1]))
            if gap[high - 1 - back]:
                high -= back
            else:  # a word longer than a piece
                ahead = int(np.argmax(gap[high:]))
                high = high + ahead if gap[high + ahead] else n
        own, parted = ~gap[low:high], borders[np.searchsorted(borders, low) : np.searchsorted(borders, high)] - low
        first = own.copy()
        first[1:] &= ~own[:-1]
        first[parted] = own[parted]
        last = own.copy()
        last[:-1] &= ~own[1:] | first[1:]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value[raw[low:high]] * power[: high - low], out=sums[1:])
        starts.append(start + low)
        ends.append(end + low)
        hashes.append((sums[end] - sums[start]) * inverse[start])
        low = high
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
