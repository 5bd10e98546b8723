"""N-gram Jaccard join in size-banded tiles, with hashed bitmap signatures before exact intersection.

Sets of similar size share a band. In a band the hashed shingles are dealt over more buckets than two
linked sets can differ in shingles, so some bucket is the same in both; of a set's buckets in order, the
first few suffice to hold such a one. The content's hash is the tile in which the two meet, and no link is missed.

In small tiles each pair is looked at once: the differing bits of two bitmaps, as long as the sets are large, bound the overlap
from above, and what passes is decided by intersecting the sorted sets. A large tile is cut into blocks of bounded size. A block
keeps its members' groups while it compares, so that it returns fewer links than members; first each set goes
to one block, then those that are still apart from others in their tiles go to a few more, and only pairs that share none of
these blocks are sought out at last.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Tables
from ..operators.components import graph_components
from .common import Spans, lower_bytes, mixed, slices, text_buffers, word_hashes, word_spans

#: Sizes of a band are under this times its smallest.
BAND = 2
#: Buckets of a band, in terms of the most differences that its links can have.
BUCKETS = 1.25
#: Bits of a bitmap for each shingle, at least.
BITS_EACH = 8
#: Members of a tile that are compared pair by pair.
SMALL = 16
#: Bytes of the sorted sets in one block of a larger tile, by expectation.
BLOCK_BYTES = 1 << 23
#: Blocks that a set goes to, in each turn.
TURNS = (1, 8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashed shingles of each text. A text of fewer words has its whole sequence as the only one, one without words none."""
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = lower_bytes(data[offsets[i] : offsets[j]])
        starts, ends, first = word_spans(part, at)
        spans = Spans(word_hashes(part, starts, ends))
        grams = spans.grams(words)
        whole = spans.hash(first[:-1], first[1:])
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            yield np.unique(grams[a : b - words + 1]) if b - a >= words else whole[k : k + 1] if b > a else whole[:0]


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


def differences(sizes: int, percent: int) -> int:
    """The most shingles that only one of two linked sets has, by the sum of their sizes."""
    return sizes * (100 - percent) // (100 + percent)


def tile_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a set, in each band where the smaller set of a link with it may be.

    If two sets differ in ``most`` shingles at most, no more than ``most`` buckets that are full in the one can be
    unlike those of the other. So the first full bucket that they have in common is among the first ``most + 1`` full ones of
    either. Where a set has no more than ``most`` full buckets, all of them count, and empty ones after them.
    """
    size, keys = len(shingles), []
    if not size:
        return np.zeros(0, np.uint64)
    own = band_of(size)
    spread, values = shingles >> np.uint64(32), mixed(shingles)
    for band in range(band_of(max(1, -(-size * percent // 100))), own + 1):
        top = math.ceil(BAND ** (band + 1)) - 1  # the largest size of the band
        most = differences(size + size * 100 // percent if band == own else size + top, percent)
        if not most:
            continue  # only equal sets link
        m = int(BUCKETS * differences(top + top * 100 // percent, percent)) + 2
        bucket = (spread * np.uint64(m)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        full, sums = bucket[at], np.add.reduceat(values, at)
        if len(full) <= most:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), full)
            full, sums = np.concatenate([full, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        full, sums = full[: most + 1], sums[: most + 1]
        keys.append(mixed(sums ^ mixed(full * np.uint64(1 << 20) + np.uint64(band + 1))))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def bitmap(shingles: np.ndarray, bits: int = 0) -> np.ndarray:
    """Bytes of a bitmap with a power of two of bits, in proportion to the set unless given."""
    bits = bits or max(64, 1 << (BITS_EACH * len(shingles) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A shorter bitmap of the same set."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def signatures(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                size, digest, bits, keys = [], [], [], []
                for s in shingle_sets(*text_buffers(some.column("text")), words):
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bits.append(bitmap(s).tobytes())
                    keys.append(tile_keys(s, percent).view(np.int64))
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                tiles = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), tiles], names=["id", "size", "digest", "bits", "tiles"])

    return run


def whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                sets = [s.tobytes() for s in shingle_sets(*text_buffers(some.column("text")), words)]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _linked(overlap, a_size, b_size, percent: int):
    return 100 * overlap >= percent * (a_size + b_size - overlap)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def possible(percent: int):
    """Pairs whose bitmaps leave room for enough overlap: each differing bit stands for at least one shingle that one set lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = []
            for x, y in zip(batch.column("a_bits"), batch.column("b_bits")):
                p, q = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                n = min(len(p), len(q))
                differ.append(int(np.bitwise_count(folded(p, n) ^ folded(q, n)).sum()))
            size = [batch.column(c).to_numpy() for c in ("a_size", "b_size")]
            yield batch.select(["a", "b"]).filter(pa.array(_linked((size[0] + size[1] - np.array(differ, np.int64)) // 2, *size, percent)))

    return run


def exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(_linked(_overlap(p, q), len(p), len(q), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(table: pa.Table) -> np.ndarray:
    """Which blocks each row's set has been to, as a bitmap; blocks of no other row here are left out."""
    homes = table.column("homes").combine_chunks()
    row = np.repeat(np.arange(len(homes)), homes.value_lengths().to_numpy(zero_copy_only=False))
    found, code, times = np.unique(homes.flatten().to_numpy(), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    marks = np.zeros((len(homes), -(-max(1, int((times > 1).sum())) // 8) * 8), np.uint8)
    several = times[code] > 1
    marks[row[several], number[code[several]]] = 1
    return np.packbits(marks, axis=1)


def _partners(table: pa.Table, label: np.ndarray):
    """For the i-th row: the later rows of another label and, where blocks meet in a tile, of the other block and with no earlier block in common."""
    blocks = table.column("block").to_numpy() if "block" in table.column_names else None
    across = blocks is not None and table.column("low")[0].as_py() != table.column("high")[0].as_py()
    seen = _apart(table) if blocks is not None else None

    def of(i: int) -> np.ndarray:
        ok = label[i + 1 :] != label[i]
        if across:
            ok &= blocks[i + 1 :] != blocks[i]
        js = np.flatnonzero(ok) + i + 1
        return js[~(seen[js] & seen[i]).any(1)] if seen is not None and len(js) else js

    return of


def open_members(table: pa.Table) -> pa.Table:
    """The rows of two blocks of a tile that have a partner left to be compared with."""
    label = table.column("label").to_numpy()
    of, wanted = _partners(table, label), np.zeros(len(label), bool)
    for i in range(len(label)):
        js = of(i)
        wanted[js] = True
        wanted[i] |= len(js) > 0
    return table.filter(pa.array(wanted))


def link_block(percent: int):
    """Links that join the members of a block, fewer than there are members: pairs that are in one group by then are not looked at."""

    def run(table: pa.Table) -> pa.Table:
        ids, label = table.column("id").to_numpy(), table.column("label").to_numpy().copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        size = np.array([len(s) for s in sets], np.int64)
        length = 8 * len(bitmap(max(sets, key=len)))
        bits = np.stack([bitmap(s, length) for s in sets]).view(np.uint64)
        of, a, b = _partners(table, label), [], []
        for i in range(len(ids)):
            js = of(i)
            js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
            if not len(js):
                continue
            differ = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
            for j in js[_linked((size[js] + size[i] - differ) // 2, size[js], size[i], percent)]:
                if label[j] != label[i] and _linked(_overlap(sets[i], sets[j]), size[i], size[j], percent):
                    label[label == label[j]] = label[i]
                    a.append(ids[i]), b.append(ids[j])
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Group the rows of ``docs`` by links of near copies.

    A text's set is its distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer words
    it is the whole sequence, without words or text it is empty and links with nothing. Two rows link when
    100 * intersection >= ``percent`` * union. Returns one row per row of ``docs``: id, ``n_shingles`` and
    ``component_id``, the smallest id reachable by links, itself included.

    Rows with equal sets are one node until the end, so copies make no pairs. Rows that share an id are one
    node of the links too. A row with a null id has a null component and links with nothing. Other columns are not
    looked at. An empty table gives an empty result. A text's arrays take about 40 times its bytes while it is read. ``small`` (members
    of a tile that are compared pair by pair) and ``block_bytes`` (bytes of sets in a block of a larger tile) change the work, not the result.
    """
    work = Tables(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = work.keep(rows.mapInArrow(signatures(words, percent), "id long, size long, digest binary, bits binary, tiles array<long>"), "signed")
    own = signed.where("size > 0 and id is not null")
    firsts = work.keep(own.groupBy("digest").agg(F.min("id").alias("first")), "firsts")
    # one row of equal sets stands for all; the wide rows are shuffled once for that, the same at every size
    copies = work.keep(own.select("digest", "id").join(firsts.select("digest", F.col("first").alias("id")), ["digest", "id"], "left_anti").distinct(), "copies")
    nodes = own.join(copies.hint("merge"), ["digest", "id"], "left_anti")

    # most tiles have one member and end here; the rows are shuffled once
    tile = Window.partitionBy("tile")
    met = nodes.select("id", "size", F.explode("tiles").alias("tile"))
    met = met.withColumns({"members": F.count(F.lit(1)).over(tile), "weight": F.sum("size").over(tile), "_low": F.min("id").over(tile), "_high": F.max("id").over(tile)})
    met = work.keep(met.where("_low < _high").drop("_low", "_high"), "met")

    few = met.where(F.col("members") <= small).groupBy("tile").agg(F.collect_set(F.struct("id", "size")).alias("all"))
    fits = lambda x, y: (y["id"] > x["id"]) & (100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"]))
    pairs = few.select(F.explode("all").alias("x"), "all").select(F.col("x.id").alias("a"), F.explode(F.filter("all", lambda y: fits(F.col("x"), y))).alias("y"))
    a, b = (own.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")) for c in "ab")
    pairs = pairs.select("a", F.col("y.id").alias("b")).distinct().join(a, "a").join(b, "b")
    maybe = work.keep(pairs.mapInArrow(possible(percent), "a long, b long"), "maybe")
    # bitmaps and tiles, most of what is written, have been read for the last time
    named = work.keep(signed.select("id", "size", "digest"), "named")
    own = named.where("size > 0 and id is not null")
    work.drop("signed")

    # larger tiles in blocks; a set's homes are blocks of its fullest tiles
    cuts = F.ceil(F.col("weight") * 8 / block_bytes).cast("int")
    large = met.where(F.col("members") > small).select("tile", "id", cuts.alias("cuts"), "members").distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    large = work.keep(large.withColumn("home", F.xxhash64("tile", "block")), "large")
    fullest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("members"), "tile"))
    homes = work.keep(large.withColumn("turn", fullest).where(F.col("turn") <= max(TURNS)).select("id", "home", "turn"), "homes")

    wanted = maybe.select(F.col("a").alias("id")).union(maybe.select("b")).union(homes.select("id")).distinct()
    # the texts are many whatever the size of the wanted ids: one shuffle, the same at every size
    sets = rows.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"])
    sets = work.keep(sets.mapInArrow(whole_sets(words), "id long, shingles binary").where("shingles <> X''"), "sets")
    both = maybe.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set")), "b")
    links = work.keep(both.mapInArrow(exact(percent), "a long, b long").distinct(), "links")
    # an id with several texts is one node
    shared = own.select("id", "digest").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("id")
    links = links.union(work.keep(own.join(shared, "id").join(firsts, "digest").select(F.col("id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct(), "same-id"))

    labels = graph_components(links)
    for turn in TURNS if large.limit(1).count() else ():
        open_, more = _open(large, labels), homes.where(F.col("turn") <= turn)
        some = open_.join(more, ["id", "home"]).select("home", "id", "label").join(sets, "id")
        found = work.keep(some.groupBy("home").applyInArrow(link_block(percent), "a long, b long"), f"links-{turn}")
        if found.limit(1).count():
            labels = graph_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found))
    # pairs of open tiles that have met in none of these blocks
    been = homes.groupBy("id").agg(F.collect_list("home").alias("homes"))
    left = _open(large, labels).join(been, "id").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    left = left.select("tile", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "id", "label", "homes")
    left = work.keep(left.groupBy("tile", "low", "high").applyInArrow(open_members, left.schema), "left")
    if left.limit(1).count():
        found = work.keep(left.join(sets, "id").groupBy("tile", "low", "high").applyInArrow(link_block(percent), "a long, b long"), "links-left")
        if found.limit(1).count():
            labels = graph_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found))
    work.drop("met", "large", "homes", "sets", "left", "maybe")

    out = named.join(firsts, "digest", "left").join(labels.withColumnRenamed("id", "first"), "first", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("size") == 0, F.col("id")).otherwise(F.coalesce("component", "first"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"))


def _open(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of larger tiles whose members are not yet in one group, with their groups' labels."""
    labelled = large.join(labels, "id", "left").select(*large.columns, F.coalesce("component", "id").alias("label"))
    apart = labelled.groupBy("tile").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("tile")
    return labelled.join(apart, "tile", "left_semi")


def keep_first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    Rows with a null id stay, as do rows without words. Rows that repeat an id share its fate. An empty table stays empty.
    """
    groups = jaccard_components(docs, words, percent, id_col, text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    # the row is one column, so that no name of it can clash; as above, the texts are many whatever the size of the ids
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone.hint("merge"), "id", "left_anti").select("row.*")
