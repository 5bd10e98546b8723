"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place; a text's vector bundles (adds) those of its n-grams; a
language's prototype bundles those of its texts. A text gets the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

DIMS = 1024
#: Letter classes: 0 between words, 1-26 for a-z, the rest for other letters by their code.
CLASSES = 64
GRAMS = CLASSES**3
#: Characters and texts handled at a time.
SLICE_CHARS, SLICE_TEXTS = 1 << 19, 1024
_tables: dict = {}


def letter_vectors(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, DIMS))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams, given as a * CLASSES**2 + b * CLASSES + c."""
    if "parts" not in _tables:
        letters = letter_vectors()
        _tables["parts"] = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
    first, second, third = _tables["parts"]
    return first[grams // CLASSES**2] * second[grams // CLASSES % CLASSES] * third[grams % CLASSES]


def _classes() -> np.ndarray:
    if "classes" not in _tables:
        table = np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
                table[code] = code - 96 if 97 <= code <= 122 else 27 + code % (CLASSES - 27)
        _tables["classes"] = table
    return _tables["classes"]


def trigrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Over runs [i, j) of the texts: the trigrams, the text that each is in, and which texts have a letter."""
    table, i = _classes(), 0
    while i < len(texts):
        j, size, some = i, 0, []
        while j < len(texts) and j - i < SLICE_TEXTS and (j == i or size + len(texts[j] or "") < SLICE_CHARS):
            some.append((texts[j] or "").lower())
            size += len(some[-1])
            j += 1
        codes = np.frombuffer("".join(f" {t} " for t in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(some)), [len(t) + 2 for t in some])
        kinds = table[codes]
        keep = np.ones(len(kinds), bool)
        keep[1:] = (kinds[1:] > 0) | (kinds[:-1] > 0) | (owner[1:] != owner[:-1])  # one gap between words
        kinds, owner = kinds[keep].astype(np.int64), owner[keep]
        has = np.bincount(owner, kinds > 0, len(some)) > 0
        grams = kinds[:-2] * CLASSES**2 + kinds[1:-1] * CLASSES + kinds[2:]
        inside = (owner[:-2] == owner[2:]) & (grams > 0)
        yield i, j, grams[inside], owner[:-2][inside], has
        i = j


def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundled vector of each language over this task's texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
        for i, j, grams, owner, _ in trigrams(texts):
            names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
            own = code[owner]
            for k, name in enumerate(names):
                found = np.bincount(grams[own == k], minlength=GRAMS)
                counts[name] = counts[name] + found if name in counts else found
    for name, found in counts.items():
        grams = np.flatnonzero(found)
        total = np.zeros(DIMS)
        for s in range(0, len(grams), 8192):
            some = grams[s : s + 8192]
            total += found[some].astype(float) @ gram_vectors(some)
        yield pa.RecordBatch.from_arrays([pa.array([str(name)]), pa.array([total.tobytes()], pa.binary())], names=["lang", "profile"])


def bundled(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("profile"))
    return pa.table({"lang": table.column("lang")[:1], "profile": pa.array([total.tobytes()], pa.binary())})


def text_vectors(n: int, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The bundled vectors of n texts: counts of the distinct trigrams times their vectors."""
    out = np.zeros((n, DIMS), np.float32)
    distinct, code = np.unique(grams, return_inverse=True)
    for s in range(0, len(distinct), 4096):
        some = (code >= s) & (code < s + 4096)
        width = min(4096, len(distinct) - s)
        counts = np.bincount(owner[some] * width + code[some] - s, minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ gram_vectors(distinct[s : s + width]).astype(np.float32)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", profiles_of: DataFrame | None = None) -> DataFrame:
    """Predict the language of every whole text of ``docs``.

    Learns from the texts and non-null languages of ``docs`` (or of ``profiles_of``) that are not held out. Returns
    one row per row of ``docs``: id, ``held_out``, ``lang_pred`` (a learned language) and ``score``, the cosine
    with its prototype, 0 at least.

    ``lang_pred`` is ``und`` and the score 0 where the text is null, empty or has no letter, or where nothing was learned.
    Of equally near languages the first by name is taken. Repeated rows are predicted alike; null ids
    are not held out. An empty table gives an empty result. The driver gets one vector per language.
    """
    learn = docs if profiles_of is None else profiles_of
    known = learn.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = known.mapInArrow(profiles, "lang string, profile binary").groupBy("lang").applyInArrow(bundled, "lang string, profile binary").collect()
    learned = sorted(((r.lang, np.frombuffer(bytes(r.profile))) for r in found), key=lambda x: x[0])
    names = [name for name, p in learned if p.any()]
    matrix = np.array([p / np.linalg.norm(p) for _, p in learned if p.any()], np.float32).reshape(-1, DIMS)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for i, j, grams, owner, has in trigrams(texts) if names else ():
                vectors = text_vectors(j - i, grams, owner)
                near = (vectors @ matrix.T).astype(float) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                best = near.argmax(1)
                for k in np.flatnonzero(has):
                    langs[i + k] = names[best[k]]
                    scores[i + k] = min(1.0, max(0.0, near[k, best[k]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
