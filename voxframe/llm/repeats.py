"""Finding windows of a fixed length that also start in a document with a smaller id, whatever the method of comparison.

Every window has an anchor: its k-gram with the least hash, so equal windows have equal anchors wherever
they stand. Windows that follow each other with the same anchor form a segment. Documents are dealt into chunks by
their ids, and the work goes in five steps:

1. each chunk sends its different anchors, as hashes, to buckets;
2. each bucket answers which of them other chunks have too;
3. each chunk tells shards its different segments with such an anchor, by their hashes and smallest ids, and for each
   different segment the shard asks one chunk for its content;
4. an index of the contents compares their windows, and the shard answers each chunk with the smallest id of each window;
5. each chunk removes what its windows with a smaller id cover.

An anchor may have different segments without bound, as at the ends of a passage that very many documents quote. Where many
chunks have many such segments, the anchor's windows are sent one by one, to the shard of their own content, so that they meet no
more than their equals, of which each chunk tells one.

Segments are told apart inside a shard by 64-bit hashes of their contents. With a trillion different segments in 100,000 shards, 0.3 pairs
of unlike segments are expected to share one; no smaller table has a pair to be expected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Spans, parts, slices, text_buffers, word_hashes, word_spans

LAST = np.iinfo(np.int64).max
#: Bytes of text in a chunk at most, by estimate; a task's arrays take about ten times as much.
CHUNK_BYTES = 1 << 25
#: Different segments of one anchor in one chunk from which on it counts as frequent there.
OFTEN = 16
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)
_PLACE = np.uint64(31)
_PLACES = np.uint64((1 << 31) - 1)


@dataclass
class Unit:
    """What a window counts: words or bytes."""

    length: int  #: units of a window
    gram: int  #: units of an anchor
    words: bool
    kind: str  #: NumPy type of a unit in a segment

    def read(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """(hashed units, units as sent in segments, offsets of the documents, the words' spans)"""
        if not self.words:
            return BYTE_VALUES[data], data, at, ()
        starts, ends, first = word_spans(data, at)
        values = word_hashes(data, starts, ends)
        return values, values, first, (starts, ends)


@dataclass
class Runs:
    """Segments of some documents: windows [start, stop) of document ``doc``, with their anchor's and content's hashes."""

    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    spans: Spans | None

    def __getitem__(self, keep) -> Runs:
        return Runs(self.start[keep], self.stop[keep], self.doc[keep], self.anchor[keep], self.content[keep], self.spans)

    def single(self, chosen: np.ndarray, length: int) -> Runs:
        """The chosen segments as one segment for each of their windows, the others as they are."""
        if not chosen.any():
            return self
        some, rest = self[chosen], self[~chosen]
        n = some.stop - some.start
        k = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + some.start[k]
        content = some.spans.hash(start, start + length)
        both = lambda a, b: np.concatenate([a, b])
        return Runs(both(rest.start, start), both(rest.stop, start + 1), both(rest.doc, some.doc[k]), both(rest.anchor, some.anchor[k]), both(rest.content, content), self.spans)


def runs_of(values: np.ndarray, offsets: np.ndarray, unit: Unit) -> Runs:
    n, width = len(values) - unit.length + 1, unit.length - unit.gram + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), None)
    spans = Spans(values)
    grams = spans.grams(unit.gram)
    least = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:n], least[width - step : width - step + n])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    windows = np.flatnonzero(np.arange(n) + unit.length <= offsets[1:][owner])
    if not len(windows):
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), None)
    place = (least[windows] & _PLACES).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    start = windows[fresh]
    stop = np.concatenate([windows[fresh[1:] - 1], windows[-1:]]) + 1
    return Runs(start, stop, owner[start], grams[place[fresh]], spans.hash(start, stop - 1 + unit.length), spans)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, at = text_buffers(table.column("text"))
    return data, at, table.column("id").fill_null(LAST).to_numpy()


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _packed(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed: high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(blob[4:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _split(order_by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different value with the places that have it."""
    order = np.argsort(order_by, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(order_by[order]) != 0])) if len(order) else []
    for i, j in zip(at, [*at[1:], len(order)]):
        yield int(order_by[order[i]]), order[i:j]


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("often", pa.binary())])
_SHARED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("common", pa.binary())])
_SEGMENTS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("content", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("common", pa.binary())])
_ASKED = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("content", pa.binary()), ("common", pa.binary())])
_UNITS = pa.schema([("shard", pa.int32()), ("content", pa.binary()), ("sizes", pa.binary()), ("units", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int32()), ("content", pa.binary()), ("start", pa.binary()), ("stop", pa.binary()), ("least", pa.binary()), ("common", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def send_anchors(unit: Unit, buckets: int, enough: int):
    """The different anchors of a chunk, and which of them have ``enough`` different segments or more here."""

    def run(table: pa.Table) -> pa.Table:
        data, at, _ = _texts(table)
        anchors, contents = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for i, j in slices(at):
            values, _, offsets, _ = unit.read(data[at[i] : at[j]], at[i : j + 1] - at[i])
            runs = runs_of(values, offsets, unit)
            anchors.append(runs.anchor), contents.append(runs.content)
        one = np.unique(np.concatenate(contents), return_index=True)[1]
        anchors, times = np.unique(np.concatenate(anchors)[one], return_counts=True)
        bucket = ((anchors & _LOW) % np.uint64(buckets)).astype(np.int64)
        keys, chunk, often = (anchors >> _HIGH).astype(np.uint32), table.column("chunk")[0].as_py(), times >= enough
        return _rows(_ANCHORS, [(b, chunk, _blob(keys[k]), _blob(keys[k[often[k]]])) for b, k in _split(bucket)])

    return run


def answer_anchors(common: int):
    """Which anchors several chunks have, and which of these have many different segments in more than ``common`` chunks."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
        _, code, times = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        times, rows, a = times[code], [], 0
        often, many = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("often")]), return_counts=True)
        often = often[many > common]
        bucket = table.column("bucket")[0].as_py()
        for chunk, blob in zip(table.column("chunk").to_pylist(), blobs):
            n = times[a : a + len(blob)]
            rows.append((bucket, chunk, _blob(blob[n > 1]), _blob(blob[_among(blob, often)])))
            a += len(blob)
        return _rows(_SHARED, rows)

    return run


def _codes(table: pa.Table, name: str) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for bucket, x in zip(table.column("bucket").to_pylist(), table.column(name)):
        out.append(np.uint64(bucket << 32) | np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64))
    return np.sort(np.concatenate(out))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array has."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def tell_segments(unit: Unit, buckets: int, shards: int):
    """The different segments of a chunk whose anchors other documents have, with the smallest and largest id of each."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(_SEGMENTS, [])
        data, at, ids = _texts(docs)
        known, common = _codes(shared, "keys"), _codes(shared, "common")
        every = []
        for i, j in slices(at):
            values, _, offsets, _ = unit.read(data[at[i] : at[j]], at[i : j + 1] - at[i])
            runs = runs_of(values, offsets, unit)
            code = ((runs.anchor & _LOW) % np.uint64(buckets)) << _HIGH | runs.anchor >> _HIGH
            every.append((runs, ids[i:][runs.doc], _among(code, known), _among(code, common)))
        # anchors that several documents of this chunk have, which no answer needs to tell
        anchors, owners = np.concatenate([r.anchor for r, *_ in every]), np.concatenate([o for _, o, *_ in every])
        order = np.lexsort([owners, anchors])
        anchors, owners = anchors[order], owners[order]
        here = np.unique(anchors[1:][(anchors[1:] == anchors[:-1]) & (owners[1:] != owners[:-1])])
        content, doc, route, hot = [], [], [], []
        for runs, _, wanted, often in every:
            wanted |= _among(runs.anchor, here)
            runs, often = runs[wanted], often[wanted]
            hot.append(np.unique(runs.anchor[often]))
            runs = runs.single(often, unit.length)
            content.append(runs.content), route.append(np.where(_among(runs.anchor, hot[-1]), runs.content, runs.anchor)), doc.append(runs.doc)
        doc = [ids[i:][d] for (i, _), d in zip(slices(at), doc)]
        content, doc, route, hot = (np.concatenate(x) for x in (content, doc, route, hot))
        if not len(content):
            return _rows(_SEGMENTS, [])
        order = np.argsort(content, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
        first, last = np.minimum.reduceat(doc[order], new), np.maximum.reduceat(doc[order], new)
        content, shard = content[order[new]], (route[order[new]] % np.uint64(shards)).astype(np.int64)
        chunk, rows, tell = docs.column("chunk")[0].as_py(), [], _blob(np.unique(hot))
        for s, k in _split(shard):
            rows.append((s, chunk, _blob(content[k]), _packed(first[k]), _packed(last[k] - first[k]), tell))
        return _rows(_SEGMENTS, rows)

    return run


def ask_contents(table: pa.Table) -> pa.Table:
    """For each different segment, the chunk of the smallest number that has it."""
    chunks, rows = table.column("chunk").to_pylist(), []
    blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("content")]
    content, owner = np.concatenate(blobs), np.repeat(np.array(chunks), [len(x) for x in blobs])
    order = np.lexsort([owner, content])
    first = order[np.concatenate([[True], content[order][1:] != content[order][:-1]])]
    own = owner[first]
    for chunk, tell in zip(chunks, table.column("common").to_pylist()):
        rows.append((chunk, table.column("shard")[0].as_py(), _blob(content[first[own == chunk]]), tell))
    return _rows(_ASKED, rows)


def send_contents(unit: Unit):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return _rows(_UNITS, [])
        data, at, _ = _texts(docs)
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in asked.column("content")]
        known, shard = np.concatenate(blobs), np.repeat(np.array(asked.column("shard").to_pylist()), [len(x) for x in blobs])
        order = np.argsort(known)
        known, shard = known[order], shard[order]
        common = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in asked.column("common")]))
        sent = np.zeros(len(known), bool)
        place, size, body = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, unit.kind)]
        for i, j in slices(at):
            values, units, offsets, _ = unit.read(data[at[i] : at[j]], at[i : j + 1] - at[i])
            runs = runs_of(values, offsets, unit)
            runs = runs.single(_among(runs.anchor, common), unit.length)
            found = np.minimum(np.searchsorted(known, runs.content), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[found] == runs.content) if len(known) else np.zeros(0, np.int64)
            which, one = np.unique(found[hit], return_index=True)
            hit, which = hit[one[~sent[which]]], which[~sent[which]]
            sent[which] = True
            n = runs.stop[hit] - runs.start[hit] - 1 + unit.length
            place.append(which), size.append(n)
            body.append(units[np.repeat(runs.start[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        place, size, body = (np.concatenate(x) for x in (place, size, body))
        begin, rows = np.cumsum(size) - size, []
        for s, k in _split(shard[place]):
            n = size[k]
            at_ = np.repeat(begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows.append((s, _blob(known[place[k]]), _packed(n.astype(np.uint32)), _packed(body[at_])))
        return _rows(_UNITS, rows)

    return run


#: (units, sizes of the segments, smallest id of each, window length) -> the smallest id of each window's equals
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def compare_segments(unit: Unit, compare: Compare):
    def run(told: pa.Table, sent: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _rows(_FOUND, [])
        unpack = lambda table, name, kind: [_unpacked(x.as_py(), kind) for x in table.column(name)]
        distinct = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in sent.column("content")])
        n, units = (np.concatenate(unpack(sent, name, kind)) for name, kind in (("sizes", "u4"), ("units", unit.kind)))
        n = n.astype(np.int64)
        order = np.argsort(distinct)
        contents, firsts = [np.frombuffer(x.as_buffer(), np.uint64) for x in told.column("content")], unpack(told, "first", "i8")
        lasts = [a + b for a, b in zip(firsts, unpack(told, "last", "i8"))]
        code = order[np.searchsorted(distinct[order], np.concatenate(contents))]
        least = np.full(len(distinct), LAST)
        np.minimum.at(least, code, np.concatenate(firsts))
        found = compare(units, n, least, unit.length)
        windows = n - unit.length + 1
        base = np.cumsum(windows) - windows
        fresh = np.concatenate([[True], found[1:] != found[:-1]])
        fresh[base] = True
        at = np.flatnonzero(fresh)
        owner = np.repeat(np.arange(len(n)), windows)[at]
        start, stop, value = at - base[owner], np.concatenate([at[1:], [len(found)]]) - base[owner], found[at]
        many = np.bincount(owner, minlength=len(n))
        head, rows, a = np.cumsum(many) - many, [], 0
        for chunk, own, last, tell in zip(told.column("chunk").to_pylist(), contents, lasts, told.column("common").to_pylist()):
            which = code[a : a + len(own)]
            a += len(own)
            m = many[which]
            k = np.repeat(head[which], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            useful = value[k] < np.repeat(last, m)  # others remove nothing from this chunk
            k, name = k[useful], np.repeat(own, m)[useful]
            rows.append((chunk, _blob(name), _packed(start[k].astype(np.uint16)), _packed(stop[k].astype(np.uint16)), _packed(value[k]), tell))
        return _rows(_FOUND, rows)

    return run


def covered(unit: Unit, docs: pa.Table, found: pa.Table) -> Iterator[tuple]:
    """(bytes, offsets, unit offsets, word spans, covered units) of runs of documents, and the range of the documents."""
    data, at, ids = _texts(docs)
    read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in found.column(name))])
    unpack = lambda name, kind: np.concatenate([np.zeros(0, kind), *(_unpacked(x.as_py(), kind) for x in found.column(name))])
    content, start, stop, least = read("content", np.uint64), unpack("start", "u2"), unpack("stop", "u2"), unpack("least", "i8")
    common = np.unique(read("common", np.uint64))
    order = np.argsort(content, kind="stable")
    content, start, stop, least = content[order], start[order].astype(np.int64), stop[order].astype(np.int64), least[order]
    for i, j in slices(at):
        part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
        values, _, offsets, words = unit.read(part, own)
        mark = np.zeros(len(values) + 1, np.int64)
        if len(content):
            runs = runs_of(values, offsets, unit)
            runs = runs.single(_among(runs.anchor, common), unit.length)
            lo, hi = np.searchsorted(content, runs.content), np.searchsorted(content, runs.content, side="right")
            n = hi - lo
            run = np.repeat(np.arange(len(n)), n)
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = least[k] < ids[i:j][runs.doc[run]]
            run, k = run[hit], k[hit]
            np.add.at(mark, runs.start[run] + start[k], 1)
            np.add.at(mark, runs.start[run] + stop[k] - 1 + unit.length, -1)
        yield i, j, part, own, offsets, words, np.cumsum(mark[:-1]) > 0


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0)


def remove_repeats(docs: DataFrame, unit: Unit, compare: Compare, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str, id_col: str, text_col: str, often: int = OFTEN) -> DataFrame:
    spark = docs.sparkSession
    # rows of the two exchanges are blobs of one sender for one receiver, so their number is the product of these
    chunks = max(parts(spark, 2), -(-text_bytes(docs, text_col) // CHUNK_BYTES))
    buckets = shards = max(parts(spark, 1), chunks // 2)
    shards *= 2
    # by id and text: rows without an id, or that repeat one, are spread as others are
    rows = docs.select(F.pmod(F.xxhash64(id_col, F.col(text_col).cast("string")), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    anchors = rows.groupBy("chunk").applyInArrow(send_anchors(unit, buckets, often), _ddl(_ANCHORS))
    shared = anchors.groupBy("bucket").applyInArrow(answer_anchors(max(4, chunks // 4)), _ddl(_SHARED))
    told = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(tell_segments(unit, buckets, shards), _ddl(_SEGMENTS))
    asked = told.groupBy("shard").applyInArrow(ask_contents, _ddl(_ASKED))
    sent = rows.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(send_contents(unit), _ddl(_UNITS))
    found = told.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(compare_segments(unit, compare), _ddl(_FOUND))
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)
