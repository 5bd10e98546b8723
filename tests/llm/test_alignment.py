"""Cross-tokenizer alignment against a plain version that reads whole texts, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from voxframe.llm import alignment
from voxframe.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
BITS = [" ", "  ", "   ", "\n", "\t", "\r\n", " ", "　", "\x0b", "\x1c", "\x85", " ", "​", "﻿", "\0", "a", "B", "é", "é", "日本", "😀", "'s", "'", "12", "!", "...", "<|endoftext|>", "<s>", "<0x41>", "▁", "word", "antidisestablishment", "ʼ", "ß"]


def plain(texts):
    """One tuple per text, from whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, groups = alignment.byte_letters(), []
    for text in texts:
        found = []
        if text:
            sides = []
            ids = a.encode(" " + text, add_special_tokens=False).ids
            sides.append([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids])
            sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
            if all(b"".join(x for _, x in side) == (" " + text).encode() for side in sides):
                ends, by_end = [], []
                for side in sides:
                    at, own = 0, []
                    for i, x in side:
                        at += len(x)
                        own.append((at, i))
                    ends.append({e for e, _ in own}), by_end.append(own)
                cuts = sorted(ends[0] & ends[1])
                for lo, hi in zip([0, *cuts], cuts):
                    found.append([[i for e, i in own if lo < e <= hi] for own in by_end])
        groups.append(found)
    held = [Counter((x, y) for g in found for x in g[0] for y in g[1]) for found in groups]
    docs = Counter(p for h in held for p in h)
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for found, h in zip(groups, held):
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in found)
        out.append((sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), sum(h.values()), sum(n for p, n in h.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in h.items()), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "  ", "a", "a ", " a", "a  ", "\n", "x\n y", "▁x", "<|endoftext|>", "ab" * 4000, "ก" * 500, "'s 's's", "the end"] + ["the cat sat. " * 30] * 3
    return texts + ["".join(rng.choices(BITS, k=rng.randint(1, 25))) for _ in range(600)]


@pytest.mark.parametrize("common", [0, 50, 1 << 19])
def test_matches_the_plain_version(spark, common):
    texts = odd_texts()
    rows = [(None if k % 50 == 7 else k, t, "x", k, t) for k, t in enumerate(texts)] + [(3, texts[3], "x", 1, "y"), (18, texts[18], "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, code long, n_a string").repartition(3)
    got = alignment.align_tokenizers(docs, A, B, common_pairs=common).collect()
    want = plain([r[1] for r in rows])
    key = lambda rows: sorted((-1 if i is None else i, *map(str, r)) for i, r in rows)
    assert key((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in got) == key((r[0], w) for r, w in zip(rows, want))


def test_chunks_are_read_as_the_whole_text():
    t, rng = alignment.Tokenizers(A, B), random.Random(6)
    assert t.by_chunks
    for _ in range(3000):
        text = "".join(rng.choices([x for x in BITS if x != "▁"], k=rng.randint(1, 30)))  # B takes that letter for a space, so such texts have no tokens
        a, b = t.encode(t.chunks(text))
        assert sum(a, []) == t.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert sum(b, []) == t.b.encode(text), repr(text)


def test_whole_texts_where_chunks_cannot_be_told():
    one, other = alignment.Aligner(A, B), alignment.Aligner(A, B)
    other.tokenizers.by_chunks = False
    texts = [t for t in odd_texts() if t]
    for x, y in zip(one.align(texts), other.align(texts)):
        assert list(map(str, x)) == list(map(str, y))


def test_forgets_within_its_bound(monkeypatch):
    texts = [t or "" for t in odd_texts()]
    whole = alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(alignment, "MEMORY", 5000)
    small = alignment.Aligner(A, B)
    parts = [small.align(texts[i : i + 40]) for i in range(0, len(texts), 40)]
    assert [d for p in parts for d in p[1]] == whole[1]
    assert sum((p[3].tolist() for p in parts), []) == whole[3].tolist()


def test_empty_table(spark):
    got = alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.columns == ["doc_id", *COLUMNS] and got.count() == 0
