"""Substring deduplication of words with an FM-index per shard.

A shard indexes its segments: sorted to the depth of a window, their Burrows-Wheeler transform lies in a wavelet
matrix of packed bits, with a count of 32 bits for each 64 of them; all places are numbers of 32 bits, and what the sorting needed is let go. Backward search streams all segments, from their ends, through it; when a match is longer than
a window it gives up its last word. Where the matching statistic reaches the window's length, the interval in the index
holds all places of that window, and the smallest document id among them is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_array
from .repeats import LAST, OFTEN, Unit, covered, remove_repeats

_ONE, _SIX, _LOW6 = np.uint64(1), np.uint64(6), np.uint64(63)


class WaveletMatrix:
    """Rank queries on a sequence of codes, one row of packed bits for each bit of a code."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.rows, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (codes >> level & 1).astype(np.uint8)
            words = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            ones = np.zeros(len(words) + 1, np.uint32)
            np.cumsum(np.bitwise_count(words), out=ones[1:], dtype=np.uint32)
            self.rows.append((words, ones, level))
            self.zeros.append(len(bit) - int(bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])
            del bit
        self.begin = np.zeros(0, np.int64)

    def descend(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the codes before ``place`` that equal ``code`` end in the last row."""
        for (words, ones, level), zeros in zip(self.rows, self.zeros):
            word = place >> 6
            before = ones[word].astype(np.int64) + np.bitwise_count(words[word] & ((_ONE << (place.astype(np.uint64) & _LOW6)) - _ONE))
            place = np.where(code >> level & 1, zeros + before, place - before)
        return place

    def rank(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of the first ``place`` codes equal ``code``."""
        if not len(self.begin):
            every = np.arange(1 << len(self.rows))
            self.begin = self.descend(every, np.zeros(len(every), np.int64))
        return self.descend(code, place) - self.begin[code]


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int32)


def _later(rank: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), rank.dtype)])[: len(rank)]


def _bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place: where its class begins and ends, and the class's number."""
    at = np.flatnonzero(first).astype(np.int32)
    size = np.diff(np.concatenate([at, [len(first)]]))
    return np.repeat(at, size), np.repeat((at + size).astype(np.int32), size), np.repeat(np.arange(len(at), dtype=np.int32), size)


def fm_windows(units: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """The smallest id of each window's equals, by backward search of every segment in an FM-index of all of them."""
    if len(units) + len(sizes) >= 1 << 31:
        raise ValueError("a shard's text is longer than 32-bit places can tell")
    code = (np.unique(units, return_inverse=True)[1] + 1).astype(np.int32)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(len(code) + len(sizes), np.int32)  # 0 ends each segment
    text[np.arange(len(code)) + np.repeat(np.arange(len(sizes)), sizes)] = code
    del code
    # sort to the depth of a window by doubling
    rank, depth = text, 1
    while depth * 2 < length:
        rank, depth = _ranked(rank, _later(rank, depth)), depth * 2
    shorter = _ranked(rank, _later(rank, length - 1 - depth)) if length - 1 > depth else rank
    full = _ranked(rank, _later(rank, length - depth))
    order = np.argsort(full, kind="stable").astype(np.int32)
    step = lambda r: np.concatenate([[True], r[order][1:] != r[order][:-1]])
    _, _, number = _bounds(step(full))
    low, high, _ = _bounds(step(shorter))
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    least = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(step(full)))
    del rank, shorter, full, owner
    bits = max(1, int(text.max()).bit_length())
    index = WaveletMatrix(text[order - 1], bits)
    del order
    before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])

    windows = sizes - length + 1
    base = np.cumsum(windows) - windows
    out = np.full(int(windows.sum()), LAST)
    by_size = np.argsort(-sizes, kind="stable")
    lo, hi, matched = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(text)), np.zeros(len(sizes), np.int64)
    falling = -sizes[by_size]
    for k in range(int(sizes.max())):  # k units from the end
        live = by_size[: np.searchsorted(falling, -k)]
        c = text[begin[live] + sizes[live] - 1 - k]
        long = matched[live] == length
        some = live[long]
        lo[some], hi[some] = low[lo[some]], high[lo[some]]
        matched[some] -= 1
        lo[live] = before[c] + index.rank(c, lo[live])
        hi[live] = before[c] + index.rank(c, hi[live])
        matched[live] += 1
        hit = live[(matched[live] == length) & (hi[live] > lo[live])]
        out[base[hit] + sizes[hit] - 1 - k] = least[number[lo[hit]]]
    return out


def _finish(unit: Unit):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows, total, removed, bodies, ends = docs.num_rows, [], [], [], [np.zeros(1, np.int64)]
        for i, j, data, at, first, (starts, stops), gone in covered(unit, docs, found) if rows else ():
            n = np.diff(first)
            owner = np.repeat(np.arange(j - i), n)
            total.append(n)
            removed.append(np.bincount(owner[gone], minlength=j - i))
            kept = np.flatnonzero(~gone)
            mark = np.zeros(len(data) + 2, np.int32)
            mark[starts[kept]] += 1
            mark[stops[kept]] -= 1
            # one space between kept words, in the place of the byte behind a word
            again = kept[:-1][owner[kept][1:] == owner[kept][:-1]] if len(kept) else kept
            gaps = stops[again]
            keep = np.cumsum(mark[: len(data)]) > 0
            keep[gaps] = True
            body = data.copy()
            body[gaps] = 0x20
            bodies.append(body[keep])
            sizes = np.concatenate([[0], np.cumsum(keep)])[at]
            ends.append(sizes[1:] + ends[-1][-1])
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        return pa.table({"id": docs.column("id"), "n_words": join(total, np.int64), "n_removed": join(removed, np.int64), "kept": binary_array(join(bodies, np.uint8), np.concatenate(ends))})

    return run


def dedup_windows(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN) -> DataFrame:
    """Remove from each text the words of windows that also start in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``length`` consecutive words of one document, judged on the
    input. Returns one row per row of ``docs``: id, ``n_words``, ``n_removed`` and ``kept``, the other words joined by
    one space, as UTF-8 bytes.

    Null and empty texts have no words and keep nothing. A null id is larger than any other and no smaller than another
    null. Rows that repeat an id remove nothing from each other. Texts shorter than a window stay whole. Other columns are not looked at.
    An empty table gives an empty result. ``gram`` (words of an anchor) and ``often`` (different segments of an anchor in a chunk
    from which on it counts as frequent) change the work, not the result.
    """
    unit = Unit(length, gram, True, "u8")
    return remove_repeats(docs, unit, fm_windows, _finish(unit), "id long, n_words long, n_removed long, kept binary", id_col, text_col, often).withColumnRenamed("id", id_col)
