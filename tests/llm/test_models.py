"""The trained operators against dense computations of the same models, over odd tables."""

import random
import zlib

import numpy as np
import pytest

from voxframe.llm import langid, quality


def held(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    make = lambda junk: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) + (rng.choice("$|#!") if rng.random() < junk else "") for _ in range(rng.randint(1, 90)))
    out = [(i, make(0.6 if i % 3 == 0 else 0.1), int(i % 3 != 0) if rng.random() < 0.9 else 0) for i in range(500)]
    out += [(500, None, 0), (501, "", 1), (502, " \n", None), (503, make(0.1) * 400, 1), (504, "é" * 50_000, 0), (None, "a b c", 1)]
    return [*out, out[3], out[3]]


def pooled(x, y, w):
    """Blocks of an isotonic fit, as the first and last x of each and its value."""
    blocks = []
    for a, b, c in zip(x, y, w):
        blocks.append([a, a, b * c, c])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return np.array([e for b in blocks for e in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


def test_quality_against_a_dense_solve(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, stats string, score double").repartition(4)
    labels = spark.createDataFrame(sorted({(i, q) for i, _, q in rows if i is not None}), "doc_id long, quality int")
    stat = lambda t: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].astype(np.float32).astype(float)
    known = [(stat(t), q) for i, t, q in rows if i is not None and not held(i) and q is not None]
    x, y = np.array([s for s, _ in known]), np.array([q for _, q in known], float)
    scale = x.std(0)
    model = quality.Model(x.mean(0), np.where(scale > 1e-9, scale, 1), 256, 0.03, 11)
    phi = model.phi(x)
    penalty = np.eye(phi.shape[1])
    penalty[0, 0] = 1e-9
    model.weights = np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
    at = np.clip(np.rint((phi @ model.weights + 0.5) / 2 * 512), 0, 511)
    bins = np.unique(at)
    model.steps = pooled(bins / 512 * 2 - 0.5, [y[at == b].mean() for b in bins], [(at == b).sum() for b in bins])
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    want = {i: (float(model.score(stat(t)[None])[0]), held(i)) for i, t, _ in rows}
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id][0], abs=1e-5) and r.held_out == want[r.doc_id][1] and r.predicted == int(r.score >= 0.7)


def test_language_against_direct_bundling(spark):
    rng = random.Random(7)
    kinds = {"aa": "abcdeé", "bb": "vwxyzäÖ", "cc": "klmnoß日"}
    rows = [(i, "  ".join("".join(rng.choices(kinds[g], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))), g if rng.random() < 0.9 else None) for i, g in enumerate(list(kinds) * 60)]
    rows += [(900, "Ab1c,  d\n\nE", None), (901, None, "aa"), (902, "12", "bb"), (903, "x" * 200_000, None), (904, "", None), (None, rows[0][1], "aa"), rows[5], rows[5]]
    docs = spark.createDataFrame([(i, t, g, 1.0, "q") for i, t, g in rows], "doc_id long, text string, lang string, score double, profile string").repartition(3)
    table, letters = langid._classes(), langid.letter_vectors().astype(float)

    def vector(text):
        kinds, total = [int(table[ord(c)]) for c in f" {(text or '').lower()} "], np.zeros(langid.DIMS)
        kinds = [k for n, k in enumerate(kinds) if n == 0 or k or kinds[n - 1]]
        for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
            if a or b or c:
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    cache = {t: vector(t) if len(t or "") < 1000 else vector(t[:10]) * 0 + vector("x" * 3) - vector("x" * 2) for _, t, _ in rows}
    cache["x" * 200_000] = vector("xx") + (200_000 - 2) * (vector("xxx") - vector("xx"))
    proto = {}
    for i, t, g in rows:
        if g and t is not None and not held(i):
            proto[g] = proto.get(g, 0) + cache[t]
    names = sorted(proto)
    matrix = np.array([proto[n] / np.linalg.norm(proto[n]) for n in names])
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for i, t, _ in rows if i == r.doc_id)
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        near = matrix @ cache[t] / np.linalg.norm(cache[t])
        assert r.lang_pred == names[int(near.argmax())] and r.score == pytest.approx(max(0, near.max()), abs=1e-4) and r.held_out == held(r.doc_id)
