"""Cross-tokenizer alignment by exact-text deduplication.

The rows are shuffled by their full texts, and each distinct text is tokenised and aligned once, however many rows have it.
How many documents hold an id pair is the sum of these numbers over the texts that hold it; measures go back to the
documents by their texts' digests.

Where a text is cut so that both tokenizers end a token, its groups fall apart. Every space after a character that is not
white space is such a place, so a text is a sequence of chunks, and what a task has learned of a chunk serves all its occurrences.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Tables

#: Ids of B are under this; a pair is one number.
B_IDS = 1 << 20
#: Bytes of what a worker remembers of chunks, about.
MEMORY = 1 << 26
#: Links of a group that are written out one by one; of larger groups, different ids are counted first.
LARGE = 1 << 12
#: Texts that are aligned in one step.
STEP = 256
#: Pairs whose counts every task has at hand, those of the highest counts; others are joined.
COMMON_PAIRS = 1 << 19
#: The places before a space that follows something else than white space; texts where white space comes before a space.
_CUT = re.compile(r"(?<=\S)(?= )")
_WIDE = re.compile(r"\s ")
#: FIXED VALUES: the tokenizer file's letters for bytes, those that print as themselves first and then the others from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[str, int]:
    others = [b for b in range(256) if b not in _PLAIN]
    return {**{chr(b): b for b in _PLAIN}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Tokenizers:
    """Ids of space + text by both tokenizers, from their files, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in entries]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) > B_IDS:
            raise ValueError("the piece model has more ids than a pair's number can tell")
        self.space = self.b.encode("a ")[len(self.b.encode("a")) :]  # a text's last space; alone it would be an empty text
        # Chunks may be read one by one if no piece goes on over a space, and if the other's pattern cuts there.
        file = json.loads(self.a.to_str())
        pre = file.get("pre_tokenizer") or {}
        plain = file.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.by_chunks = bool(plain) and not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode("a  b c", out_type=str)[0] == "▁a"

    def chunks(self, text: str) -> list[str]:
        """Space + text in pieces that both tokenizers read apart from each other; each begins with a space, which is B's own and is left out here."""
        if not self.by_chunks:
            return [text]
        if _WIDE.search(text) or text[0] == " ":
            return [c[1:] for c in _CUT.split(" " + text)]
        return text.split(" ")

    def encode(self, chunks: list[str]) -> list[list[list[int]]]:
        """Ids of space + chunk, by A and by B."""
        b = [ids if chunk else self.space for chunk, ids in zip(chunks, self.b.encode(chunks, num_threads=1))]
        return [[e.ids for e in self.a.encode_batch([" " + c for c in chunks], add_special_tokens=False)], b]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its length says, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their times."""
    if len(codes) < 2:
        return codes, times
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(times, at)


class Aligner:
    """Aligns texts, and remembers their chunks within a bound.

    Of a chunk it holds whether its tokens' bytes are its own, the numbers of tokens, groups and links, its groups as text,
    and the codes of its linked pairs with how often each is linked.
    """

    def __init__(self, a_path: str, b_path: str):
        self.tokenizers = Tokenizers(a_path, b_path)
        self.lengths = [np.array([len(x) for x in side]) for side in (self.tokenizers.a_bytes, self.tokenizers.b_bytes)]
        self.texts_of = [f"{i}{mark}".encode() for mark in ",|;" for i in range(max(map(len, self.lengths)))]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held, self.groups = 0, []
        self.stats, self.cuts = np.zeros((0, 5), np.int64), np.zeros(1, np.int64)
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks that are not known."""
        bodies = [b" " + c.encode() for c in chunks]
        ids = self.tokenizers.encode(chunks)
        size = np.array([len(b) for b in bodies])
        counts = [np.array([len(x) for x in side]) for side in ids]
        flat = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(ids, counts)]
        owner = [np.repeat(np.arange(len(chunks)), n) for n in counts]
        right = np.ones(len(chunks), bool)
        for side, table in zip((0, 1), (self.tokenizers.a_bytes, self.tokenizers.b_bytes)):
            if b"".join(map(table.__getitem__, flat[side].tolist())) != b"".join(bodies):
                right &= np.array([b"".join(map(table.__getitem__, x)) == body for x, body in zip(ids[side], bodies)])
        for side in (0, 1):  # chunks that are not their tokens' bytes have no tokens
            ok = right[owner[side]]
            flat[side], owner[side] = flat[side][ok], owner[side][ok]
        ends = [np.cumsum(self.lengths[side][flat[side]]) for side in (0, 1)]
        both = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(both, e) for e in ends]
        each = [np.bincount(g, minlength=len(both)) for g in group]
        first = [np.cumsum(n) - n for n in each]
        home = owner[0][first[0]] if len(both) else np.zeros(0, np.int64)
        links = each[0] * each[1]

        stats = np.zeros((len(chunks), 5), np.int64)
        stats[:, 0] = right
        for k, (place, weight) in enumerate(((owner[0], None), (owner[1], None), (home, None), (home, links)), 1):
            stats[:, k] = np.bincount(place, weight, len(chunks)) if weight is None else _added(place, weight, len(chunks))

        # groups as text: of each group the ids of A, the last with a bar, then those of B, the last with a semicolon
        marks = [np.where(np.append(g[1:] != g[:-1], True), m, 0) if len(g) else g for g, m in zip(group, (1, 2))]
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        names = np.concatenate(marks) * (len(self.texts_of) // 3) + np.concatenate(flat)
        names = list(map(self.texts_of.__getitem__, names[order].tolist()))
        long = np.zeros(len(chunks), np.int64)
        np.add.at(long, np.concatenate(owner)[order], np.array(list(map(len, names)), np.int64))
        whole, at = b"".join(names), np.concatenate([[0], np.cumsum(long)]).tolist()

        # links: all pairs of a group; of large groups the pairs of different ids, with the products of their numbers
        few = links <= LARGE
        k = _ranges(np.zeros(int(few.sum()), np.int64), links[few])
        wide = np.repeat(each[1][few], links[few])
        a = flat[0][np.repeat(first[0][few], links[few]) + k // np.maximum(wide, 1)]
        b = flat[1][np.repeat(first[1][few], links[few]) + k % np.maximum(wide, 1)]
        where, codes, times = [np.repeat(home[few], links[few])], [a * B_IDS + b], [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(~few):
            x, y = (np.unique(flat[s][first[s][g] : first[s][g] + each[s][g]], return_counts=True) for s in (0, 1))
            codes.append((x[0][:, None] * B_IDS + y[0]).ravel()), times.append((x[1][:, None] * y[1]).ravel())
            where.append(np.full(len(codes[-1]), home[g]))
        where, codes, times = (np.concatenate(x) for x in (where, codes, times))
        order = np.lexsort((codes, where))
        where, codes, times = where[order], codes[order], times[order]
        fresh = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (where[1:] != where[:-1]))) if len(codes) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, fresh) if len(fresh) else times

        for c in chunks:
            self.number[c] = len(self.number)
        self.groups += [whole[i:j] for i, j in zip(at, at[1:])]
        self.stats = np.concatenate([self.stats, stats])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(np.bincount(where[fresh], minlength=len(chunks)))])
        self.codes, self.times = np.concatenate([self.codes, codes[fresh]]), np.concatenate([self.times, times])
        self.held += int(size.sum()) + 100 * len(chunks) + 16 * len(fresh)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: numbers of A and B tokens, groups and links (rows of four); the digest of its groups; and lengths, codes and times of its linked pairs."""
        if self.held > MEMORY:
            self._forget()
        cut = [self.tokenizers.chunks(t) if t else [] for t in texts]
        new = list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.number))
        if new:
            self._learn(new)
        rows = [list(map(self.number.__getitem__, chunks)) for chunks in cut]
        count = np.array([len(r) for r in rows])
        flat, doc = np.fromiter(chain.from_iterable(rows), np.int64, int(count.sum())), np.repeat(np.arange(len(texts)), count)
        right = np.bincount(doc, self.stats[flat, 0] == 0, len(texts)) == 0
        total = np.stack([_added(doc, self.stats[flat, k], len(texts)) for k in (1, 2, 3, 4)], 1)
        total[~right] = 0
        digest = [hashlib.sha256(b"".join(map(self.groups.__getitem__, r))[:-1]).hexdigest() if r and ok else "" for r, ok in zip(rows, right)]

        flat, doc = flat[right[doc]], doc[right[doc]]
        long = self.cuts[flat + 1] - self.cuts[flat]
        at = _ranges(self.cuts[flat], long)
        key, times = np.repeat(doc << 36, long) + self.codes[at], self.times[at]
        many = times > 1
        key, times = summed(np.concatenate([key, key[many]]), np.concatenate([np.ones(len(key), np.int64), times[many] - 1])) if len(key) else (key, times)
        return total, digest, np.bincount(key >> 36, minlength=len(texts)), key & ((1 << 36) - 1), times


def _added(place: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by place; places are in order."""
    sums = np.concatenate([[0], np.cumsum(weight)])
    ends = np.searchsorted(place, np.arange(n + 1))
    return sums[ends[1:]] - sums[ends[:-1]]


ALIGNED = "digest string, weight long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"


_aligners: dict[tuple[str, str], Aligner] = {}


def align_texts(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:  # a worker keeps what it knows from task to task
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        aligner = _aligners[a_path, b_path]
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                total, digest, long, codes, times = aligner.align(some.column("text").to_pylist())
                at = pa.array(np.concatenate([[0], np.cumsum(long)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (codes, times)]
                yield pa.RecordBatch.from_arrays([some.column("digest"), some.column("weight"), *map(pa.array, total.T), pa.array(digest, pa.string()), *lists], schema=_schema(ALIGNED))

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair among this task's texts, added up batch by batch within a bound."""
    codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    send = lambda: pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["code", "docs"])
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for i in range(0, batch.num_rows, 512):
            lists = batch.column("codes").slice(i, 512)
            own = np.repeat(weight[i : i + 512], lists.value_lengths().to_numpy(zero_copy_only=False))
            codes, times = summed(np.concatenate([codes, lists.flatten().to_numpy()]), np.concatenate([times, own]))
            if len(codes) > 1 << 20:
                yield send()
                codes, times = codes[:0], times[:0]
    yield send()


def measure(common, name: str):
    """For each text, what its common pairs come to, and the pairs that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, docs, best = common.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                lists, times = some.column("codes"), some.column("times").flatten().to_numpy()
                own, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(length)), length)
                at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
                hit = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                n_best, count_sum = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
                np.add.at(count_sum, row[hit], times[hit] * docs[at[hit]])
                np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
                left = [x[~hit] for x in (own, times)]
                cut = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(length)))]).astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in left]
                yield pa.RecordBatch.from_arrays([some.column("digest"), pa.array(n_best), pa.array(count_sum), *rest], names=["digest", "n_best", "count_sum", "codes", "times"])

    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """How two tokenizers cut each text, and how usual its linked id pairs are in the corpus.

    A (``a_path``, a byte-level tokenizer file) reads space + text, B (``b_path``, a piece model that adds the space) reads the text; neither adds
    special tokens, and their strings in a text are plain text. Byte offsets where a token of either ends cut the text into groups; in a group each
    occurrence of an A token is linked with each of a B token. A pair of ids counts once for each row of ``docs`` that holds it linked.

    Returns, per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the highest count of its A id, ties
    included), ``count_sum`` (counts added up over links) and ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``: ids of the groups in order).

    Texts that are null, empty or whose tokens' bytes are not space + text have no tokens: zeros, and '' for the digest. Rows with null or
    repeated ids are documents like others, and so are rows that repeat others; columns besides these two are not looked at. An empty table gives an
    empty result. A text is read whole, in a time that follows its length but for groups of many tokens, whose pairs are all linked.

    ``common_pairs`` pairs, those of the highest counts, are at hand in every task (24 bytes each, so 12 MB by default, whatever the corpus);
    the others meet their counts in a shuffle. This bound changes the work and not the result.
    """
    spark = docs.sparkSession
    work = Tables(spark, "alignment")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("weight"))
    aligned = work.keep(texts.select(F.sha2("text", 256).alias("digest"), "weight", "text").mapInArrow(align_texts(a_path, b_path), ALIGNED), "texts")

    pairs = aligned.select("weight", "codes").mapInArrow(count_pairs, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    pairs = work.keep(pairs, "pairs")
    # the first ids are a vocabulary, so their table has a bound
    most = pairs.groupBy(F.expr(f"code div {B_IDS}").alias("a")).agg(F.max("docs").alias("most"))
    counts = work.keep(pairs.withColumn("a", F.expr(f"code div {B_IDS}")).join(F.broadcast(most), "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")
    some = counts.orderBy(F.desc("docs"), "code").limit(common_pairs).toArrow().sort_by("code")
    common = spark.sparkContext.broadcast(tuple(some.column(c).to_numpy() for c in ("code", "docs", "best")))

    own = work.keep(aligned.select("digest", "codes", "times").mapInArrow(measure(common, "common"), "digest string, n_best long, count_sum long, codes array<long>, times array<long>"), "measured")
    rare = own.where(F.size("codes") > 0).select("digest", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("digest", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    rare = rare.join(counts, "code").groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("docs")).alias("_sum"))
    measures = aligned.drop("weight", "codes", "times").join(own.select("digest", "n_best", "count_sum"), "digest").join(rare, "digest", "left")
    measures = work.keep(measures.select("digest", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256"), "measures")
    work.drop("texts", "pairs", "counts", "measured")

    out = rows.select("id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("digest")).join(measures, "digest", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select(F.col("id").alias(id_col), *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
