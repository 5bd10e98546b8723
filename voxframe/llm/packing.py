"""Packing documents into training sequences by concatenating and cutting.

First pass: tokenise every text and write its ids with the running token count of its file segment.
The totals of the segments, summed in order, then give each document its place in one long stream;
the second pass cuts that stream into windows of fixed length. A document that a window's end cuts has
one record on each side of the boundary.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored

#: Words that one Python worker remembers with their ids, in each of two generations; so many pieces of words too.
CACHE_WORDS = 250_000
#: Words of printable ASCII and the accented letters of Latin-1, which are the same in every normal form.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: The tokenizer's pieces of such a word, once that is in lower case.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
#: How a tokenizer file must cut text for its words to be cut here: fixed values, held against the file when it is read.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Opens the names of special tokens, which the tokenizer looks for in the text as it stands.
_SPECIAL = "<|"
_coders: dict = {}


def _byte_letters() -> dict[int, str]:
    """How a byte-level model writes the accented letters: a byte that prints is itself, the others follow from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    letter = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class Memory(dict):
    """Makes a missing value by ``make``; holds up to twice ``limit``, of which those not asked for in a while go."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Coder:
    """Token ids of texts, by way of a bounded memory of the ids of white-space-separated words and their pieces.

    A tokenizer that cuts text as ``NORMALIZER`` and ``PRE_TOKENIZER`` say, and whose special tokens open with ``<|``, drops white space and never
    joins across it, so a text's ids are those of its words in order. Only space, tab, line feed and carriage return are split
    at here. A plain word is cut into pieces as the tokenizer does, and the pieces go to its model; it reads all other
    words itself. Any other tokenizer reads the texts whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        special = all(t["content"].startswith(_SPECIAL) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
        self.by_words = special and told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words, self.pieces = Memory(self.of_word, cache_words), Memory(self.of_piece, cache_words)

    def of_piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]
        return pack_ids(f"<{len(ids)}I", *ids)

    def of_word(self, word: str) -> bytes:
        if PLAIN(word) and _SPECIAL not in word:
            low = word.lower()
            return self.pieces[low] if low.isalpha() else b"".join([self.pieces[p] for p in PIECES(low)])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, 4 bytes each."""
        if not self.by_words:
            return [pack_ids(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        get = self.words.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenise(path: str, end_id: int):
    """First pass. Rows come with the file and block they were read from; counts run on within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = coder(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32).tobytes()
        at: dict[tuple, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                files, blocks = some.column("file").to_pylist(), some.column("block").to_pylist()
                ids, before = [], []
                for f, b, x in zip(files, blocks, code.encode([t or "" for t in some.column("text").to_pylist()])):
                    ids.append(np.frombuffer(x + end, "<u4"))
                    before.append(at.get((f, b), 0))
                    at[f, b] = before[-1] + len(ids[-1])
                small = all(int(x.max()) < 1 << 16 for x in ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"), some.column("file"), some.column("block"), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([2 if small else 4] * len(ids), pa.int32()), pa.array([x.astype("<u2" if small else "<u4").tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "file", "block", "part", "before", "doc_tokens", "width", "ids"],
                )

    return run


def cut(length: int):
    """Second pass: pieces of each document between the stream's multiples of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, count = batch.column("begin").to_numpy(), batch.column("doc_tokens").to_numpy()
            first, last = begin // length, (begin + count - 1) // length
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(begin)), pieces)
            window = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[doc]
            lo = np.maximum(window * length, begin[doc])
            hi = np.minimum((window + 1) * length, begin[doc] + count[doc])
            start = lo - begin[doc]
            width, raw = batch.column("width").to_pylist(), batch.column("ids").to_pylist()
            crc = [zlib.crc32(np.frombuffer(raw[d], f"<u{width[d]}", int(n), int(s) * width[d]).astype("<u4").tobytes()) for d, s, n in zip(doc.tolist(), start, hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), *(pa.array(np.asarray(x, np.int64)) for x in (start, hi - lo, crc, count[doc], window, lo - window * length)), pa.array(start > 0), pa.array(hi < begin[doc] + count[doc])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after"],
            )

    return run


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean"


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, doc_tokens (with the closing id), begin (its place in the stream of all ids), width (bytes per id) and ids.

    The stream follows the names of the files that ``docs`` is read from and the rows in them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    schema = "doc_id long, file string, block long, part int, before long, doc_tokens long, width int, ids binary"
    tokens = stored(rows.mapInArrow(tokenise(tokenizer_path, end_id), schema), "tokens")
    segment = ["file", "block", "part"]
    totals = tokens.groupBy(*segment).agg(F.sum("doc_tokens").alias("total"))
    # one row per file block that a task read: as many as tasks, whatever the number of documents
    order = Window.orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select(*segment, F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base")), "bases")
    return tokens.join(bases, segment).select("doc_id", "doc_tokens", (F.col("base") + F.col("before")).alias("begin"), "width", "ids")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the concatenated ids of all documents into sequences of ``length``; only the last one is short.

    A document is its text's ids, without special tokens, and then ``end_id``; null and empty texts are
    that id alone. Returns one row per piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence), and the boundary flags ``cut_before`` and ``cut_after``.

    Rows with equal or null ids are documents of their own. Other columns are not looked at. An empty
    table gives no pieces. A text of any length takes memory in proportion to itself, once.
    """
    return token_stream(docs, tokenizer_path, end_id, id_col, text_col).mapInArrow(cut(length), SCHEMA)
