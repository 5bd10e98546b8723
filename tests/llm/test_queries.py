"""Every corpus query on the smallest tables: columns, types, rows, and the digests that the queries derive from their operators."""

import hashlib
import re

import duckdb
import pytest

from voxframe.llm import queries as corpus

SF = "/root/testdata/sf0.001"
FIXED = {
    "op1_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_mixing": {"doc_id": "bigint", "source": "string", "block": "bigint", "slot": "bigint"},
    "op11_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_near_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
}


@pytest.fixture(scope="module")
def results(spark):
    frames = {n: f(spark, SF) for n, f in corpus.queries().items()}
    return {n: (dict(d.dtypes), d.collect()) for n, d in frames.items()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_columns_and_types(results):
    assert set(results) == set(FIXED)
    for name, columns in FIXED.items():
        types, rows = results[name]
        assert {c: types[c] for c in columns} == columns, name
        assert rows, name


def test_one_row_per_document(results, texts):
    for name in ("op1_quality_classifier", "op2_substring_dedup", "op3_language_id", "op5_suffix_dedup", "op7_exact_dedup", "op9_ngram_jaccard", "op10_mixing", "op13_alignment"):
        assert sorted(r.doc_id for r in results[name][1]) == sorted(texts), name
    assert {r.doc_id for r in results["op6_packing"][1]} == set(texts)


def test_digests(results, texts):
    words = {i: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for i, t in texts.items()}
    for r in results["op2_substring_dedup"][1]:
        assert r.n_words == len(words[r.doc_id])
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(b" ".join(words[r.doc_id])).hexdigest()
    for r in results["op5_suffix_dedup"][1]:
        body = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(body) and (r.n_removed or r.kept_sha256 == hashlib.sha256(body).hexdigest())
    for r in results["op7_exact_dedup"][1]:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        assert r.text_sha256 == hashlib.sha256(low.encode()).hexdigest() and r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_matches_sql(results):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(corpus.OP7_SQL).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in results["op7_exact_dedup"][1])


def test_sequences_and_ranks(results):
    rows = results["op6_packing"][1]
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 for s, n in ends.items() if s != max(ends))
    found = {}
    for r in sorted(results["op8_ann"][1], key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert all(q % 100 == 0 and [x for x, *_ in v] == list(range(1, 11)) and v == sorted(v) for q, v in found.items())
