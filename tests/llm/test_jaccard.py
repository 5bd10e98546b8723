"""The n-gram Jaccard join where tiles are large: families of near copies that link, nearly link, and do not."""

import random
import re

import numpy as np
import pytest

from voxframe.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups_of(texts: dict, words: int, percent: int) -> dict:
    sets = {i: shingles(t, words) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(rng, size: int, length: int, edits: int) -> list[str]:
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = family(rng, 60, 200, 3) + family(rng, 70, 150, 8) + family(rng, 40, 60, 2) + family(rng, 30, 400, 14)
    out += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("words,percent,small,block_bytes", [(3, 90, 4, 1 << 23), (5, 80, 2, 12_000)])
def test_large_tiles(spark, texts, words, percent, small, block_bytes):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = groups_of(texts, words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d, words, percent, small=small, block_bytes=block_bytes).collect()}
    assert got == want
    sizes = [g for _, g in want.values()]
    assert len(set(sizes)) < len(sizes) - 40 and len(set(sizes)) > 80


def test_ids_with_several_texts_are_one_node(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(30)) for c in "ab")
    d = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (4, a + " z"), (7, "q"), (None, a), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard.jaccard_components(d, 3, 90).collect())
    assert got == [(-1, None), (-1, None), (3, 3), (4, 3), (5, 3), (5, 3), (7, 7), (9, 3)]
    assert sorted(r.doc_id or -1 for r in jaccard.keep_first_of_groups(d, 3, 90).collect()) == [-1, -1, 3, 7]


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_at_the_threshold_share_a_tile(percent):
    rng = np.random.default_rng(2)
    for size in [*range(3, 140), 255, 256, 257, 1000, 5000]:
        a = np.unique(rng.integers(0, 1 << (63 + size % 2), size, dtype=np.uint64))  # half of them with empty buckets
        for _ in range(3):
            own = int(rng.integers(0, jaccard.differences(2 * size, percent) + 1))
            new = int(rng.integers(0, jaccard.differences(2 * size, percent) - own + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[: size - own], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and own + new:
                assert set(jaccard.tile_keys(a, percent)) & set(jaccard.tile_keys(b, percent)), (size, own, new)
                n = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b)))
                differ = np.bitwise_count(jaccard.folded(jaccard.bitmap(a), n) ^ jaccard.folded(jaccard.bitmap(b), n)).sum()
                assert differ <= own + new


def test_unlike_sets_share_few_tiles():
    """A set of chance shingles meets none of its size, so tiles do not grow with a band."""
    rng = np.random.default_rng(3)
    for size in (60, 150, 300, 1000):
        keys = [jaccard.tile_keys(np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64)), 80) for _ in range(200)]
        assert np.unique(np.concatenate(keys), return_counts=True)[1].max() <= 2
        assert max(map(len, keys)) <= 0.55 * size + 4


def test_wide_table_goes_once_read(spark):
    """Bitmaps and tiles, as large as the texts, do not lie in the shared folder while later steps run."""
    from pathlib import Path

    rows = [(i, " ".join(f"w{(i // 2) * 50 + k}" for k in range(40)) + (" end" if i % 2 else "")) for i in range(20)]
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("jaccard-signed-*"))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    (made,) = set(folder.glob("jaccard-signed-*")) - before
    assert spark.read.parquet(str(made)).count() == 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {i: (36 + i % 2, i - i % 2) for i, _ in rows}
