"""Helpers shared by the corpus operators: Arrow text buffers, words, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that one step of vectorised work takes at a time, so that its arrays stay small.
SLICE_BYTES = 1 << 18


def parts(spark: SparkSession, times: int = 1) -> int:
    """So many groups of work as the session's shuffle partitions ask for, times a factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def ascii_lower(col):
    """Lower-case A-Z and nothing else; plain ASCII texts take the faster built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def held_out(doc_id):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column as one array, and n + 1 offsets; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, body = arr.buffers()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column whose i-th value is data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    if n and offsets[-1] >= 1 << 31:
        raise ValueError("a chunk keeps more than 2 GB, which 32-bit offsets cannot tell")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most ``limit`` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


# --- hashing ---------------------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FIN = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> _HALF)
    h *= _FIN
    h ^= h >> _HALF
    h *= _FIN
    h ^= h >> _HALF
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MUL), ("down", _INV)):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            _powers[name] = np.multiply.accumulate(seq)
    return _powers["up"], _powers["down"]


class Spans:
    """Hashes of any spans of a sequence of 64-bit values, each in constant time from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = _power(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * _FIN)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of k values."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each document, and each document's first word (n + 1 numbers)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]]) if n else space
    after = np.concatenate([space[1:], [True]]) if n else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(BYTE_VALUES[data]).hash(starts, ends)
