"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from voxframe.llm import ann, exact_dedup, fm_dedup, jaccard, langid, mixing, packing, quality, suffix_dedup, url_rules
from voxframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def texts(n=60, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(rng.choices(words, k=k))
    passage = make(70)
    out = [make(rng.randint(1, 120)) for _ in range(n)]
    out[3] = out[9] = out[2].upper()
    for i in (5, 11, 20, 33, 34):
        out[i] = make(rng.randint(0, 60)) + " " + passage + " " + make(rng.randint(0, 60))
    for i in (40, 41, 42, 43):
        w = out[20].split()
        w[rng.randrange(len(w))] = f"x{i}"
        out[i] = " ".join(w)
    return out + [None, "", " \n\t ", "a", "a", "a b", "Été  naïve\x0bEnd", make(6000), "!" * 400, "ab" * 200]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", f"s{min(i % 5, 2)}" if i % 7 else None, i) for i, t in enumerate(texts())]
    rows.append(rows[2])  # a repeated row
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "id", "kept", "size", "block", "chunk", "tile", "begin", "file", "score"):
        df = df.withColumn(name, df.doc_id.cast("string"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def source_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("weak,bits", [(False, 1 << 26), (False, 64), (True, 1 << 16)])
def test_exact_dedup(docs, weak, bits):
    from pyspark.sql import functions as F

    digest = (lambda t: (F.crc32(t.cast("binary")) % 3).cast("string")) if weak else (lambda t: F.sha2(t, 256))
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = collections.defaultdict(list)
    for i, t in source_rows(docs):
        groups[low(t)].append(i)
    got = exact_dedup.exact_dedup(docs, digest=digest, filter_bits=bits).collect()
    assert len(got) == docs.count()
    for r in got:
        own = next(g for g in groups.values() if r.doc_id in g)
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def test_filter_of_digests_loses_none(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    keys = rows.where("id % 7 = 3").select("digest")
    for bits, most in ((1 << 20, 3200), (1 << 10, 20_000)):
        got = {r.id for r in exact_dedup.maybe_in(rows, keys, "digest", bits).collect()}
        assert {i for i in range(20_000) if i % 7 == 3} <= got and len(got) <= most


@pytest.mark.parametrize("unit,length", [("words", 50), ("bytes", 40), ("bytes", 50)])
def test_substring_dedup(docs, unit, length):
    f = fm_dedup.dedup_windows if unit == "words" else suffix_dedup.dedup_bytes
    got = collected(f(docs, length=length))
    first, seen = {}, {}
    split = lambda t: WORD.findall((t or "").encode()) if unit == "words" else (t or "").encode()
    for i, t in sorted(set(source_rows(docs)), key=lambda r: r[0]):
        s = seen[i] = split(t)
        for k in range(len(s) - length + 1):
            first.setdefault(b"\0".join(s[k : k + length]) if unit == "words" else s[k : k + length], i)
    assert len(got) == len(seen)
    for i, s in seen.items():
        gone = [False] * len(s)
        for k in range(len(s) - length + 1):
            if first[b"\0".join(s[k : k + length]) if unit == "words" else s[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        kept = b" ".join(w for w, g in zip(s, gone) if not g) if unit == "words" else bytes(b for b, g in zip(s, gone) if not g)
        assert (got[i][1], got[i].n_removed, bytes(got[i].kept)) == (len(s), sum(gone), kept), i
        if unit == "bytes":
            assert sum(r.stop - r.start for r in got[i].spans) == sum(gone) and len(got[i].spans) == got[i].n_spans
    assert any(r.n_removed for r in got.values())


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_frequent_anchors_change_nothing(spark, unit):
    rng = random.Random(8)
    make = lambda k: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(k))
    passage = make(60)
    d = spark.createDataFrame([(i, f"{make(rng.randint(0, 40))} {passage} {make(rng.randint(0, 40))}") for i in range(120)], "doc_id long, text string")
    f = fm_dedup.dedup_windows if unit == "words" else suffix_dedup.dedup_bytes
    shown = lambda often: sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in f(d, often=often).collect())
    assert shown(1) == shown(1000) and sum(r[1] for r in shown(1)) >= 119 * (60 if unit == "words" else len(passage))


def shingles(text, n):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_components(docs, words, percent):
    sets = {i: shingles(t, words) for i, t in source_rows(docs)}
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
    got = jaccard.jaccard_components(docs, words, percent).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), root(i)) for i, s in sets.items()}
    assert any(root(i) != i for i in sets)


def test_tiles_lose_no_link():
    """Sets at the very threshold, of all small sizes, share a tile."""
    rng = np.random.default_rng(2)
    for size in [*range(9, 60), 200, 1000]:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = size * 10 // 100
        b = np.sort(rng.permutation(a)[: size - drop])
        assert 100 * len(b) >= 90 * len(a)
        if len(b) < len(a):
            assert set(jaccard.tile_keys(a, 90)) & set(jaccard.tile_keys(b, 90)), size


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in source_rows(docs)}
    got = packing.pack(docs, tokenizer_path(), length=256).collect()
    spans = sorted((r.sequence_id, r.offset, r.length) for r in got)
    where = 0
    for s, o, n in spans:  # gapless, every sequence but the last full
        assert s * 256 + o == where
        where += n
    assert where == sum(r.doc_tokens for r in got if r.start == 0)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert r.cut_before == (r.start > 0) and r.cut_after == (r.start + r.length < r.doc_tokens)


def test_coder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(tokenizer_path()), packing.Coder(tokenizer_path(), 5)
    odd = ["", " ", "a\x1cb\u00a0c\u2003d", "<|endoftext|>x <|startoftext|>", "It's they'LL 12345 foo_bar'd!!", "e\u0301 \u0301x İstanbul ΣΑΣ ς", "\x00\x01 tab\tnew\nline\r", "日本語 テスト 🙂", "a" * 3000, "№ ½ x²", "Ça Ÿ ÀÉß×÷ª µ ÿé", "l’été «été»"]
    for x in odd:
        assert np.frombuffer(c.encode([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_mixing_keeps_its_promise():
    weights = {"a": 0.62, "b": 0.2, "c": 0.13, "d": 0.05}
    shares = mixing.exact_parts(weights)
    assert shares == {"a": 62, "b": 20, "c": 13, "d": 5}
    slots = mixing.pfair_period(shares)
    assert sorted(t for s in slots.values() for t in s) == list(range(100))
    for s, own in slots.items():
        for t in range(101):
            assert abs(sum(x < t for x in own) - t * shares[s] / 100) < 1


def plain_schedule(weights, blocks, slots):
    """Slot by slot: of the blocks that may run, the one that is due first."""
    done, out = dict.fromkeys(weights, 0), []
    for t in range(slots):
        may = [(math.ceil(Fraction(done[s] + 1) / w), s) for s, w in weights.items() if w and done[s] < blocks[s] and math.floor(done[s] / w) <= t]
        if may:
            out.append((t, min(may)[1]))
            done[min(may)[1]] += 1
        else:
            idle = [s for s in sorted(weights) if not weights[s] and done[s] < blocks[s]]
            if idle:
                out.append((t, idle[0]))
                done[idle[0]] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_mixing_against_a_plain_schedule(seed):
    rng = random.Random(seed)
    given = {f"s{i}": rng.choice([0, 0.01, 0.5, rng.random(), round(rng.random(), 3)]) for i in range(rng.randint(1, 7))}
    shares = mixing.exact_parts(given)
    total = sum(shares.values())
    exact = {s: Fraction(x, total) for s, x in shares.items()}
    blocks = {s: rng.randint(0, 60) for s in given}
    got = list(mixing.pfair(shares, blocks))
    assert [(t, s) for t, s, *_ in got] == plain_schedule(exact, blocks, got[-1][0] + 1 if got else 0) and len(got) == sum(blocks.values())
    over = min((math.floor(blocks[s] / w) for s, w in exact.items() if w), default=0)  # until then no source is used up
    seen = collections.Counter()
    for t, s, k, release, due in got:
        assert release <= t < due and k == seen[s]
        seen[s] += 1
        if t < over:
            assert all(abs(seen[x] - (t + 1) * w) < 1 for x, w in exact.items())


def test_mixing(docs):
    got = mixing.mix_sources(docs, block_bytes=300).select("doc_id", "source", *mixing.COLUMNS).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in source_rows(docs))
    size = {i: len((t or "").encode()) + 1 for i, t in source_rows(docs)}
    assert all(r.release <= r.slot < r.deadline for r in got)
    owner = {}
    for r in got:
        assert owner.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    for s in {r.source for r in got}:  # blocks are consecutive pieces of the source
        own, at = sorted((r.block * 300 + r.block_offset, r.doc_id) for r in got if r.source == s), 0
        for start, i in own:
            assert start == at
            at += size[i]
    order = [r.doc_id for r in mixing.mixed_order(docs).collect()]
    assert sorted(order) == sorted(r.doc_id for r in got)


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 3.0, "b": 2**0.5, "c": 0.017}])
def test_mixing_keeps_the_weights_over_many_periods(spark, weights):
    total = sum(weights.values())
    rows = [(i, "x" * 9, "en", s, 9) for s, w in weights.items() for i in range(int(4500 * w / total))]  # one document per block
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), weights, block_bytes=10).select("source", *mixing.COLUMNS).collect()
    assert len(got) == len({r.slot for r in got}) == len(rows) and all(r.release <= r.slot < r.deadline for r in got)
    for s, w in weights.items():
        own = sorted(r.slot for r in got if r.source == s)
        for k, t in enumerate(own):  # just before and just after each of its slots the source is farthest off
            assert abs(k - t * w / total) < 1 and abs(k + 1 - (t + 1) * w / total) < 1


def test_mixing_shares_are_not_shifted_to_small_sources():
    many = {"a": 1 / 3} | {f"s{i}": 2 / 3 / 400 for i in range(400)}
    slots = [t for t, s, *_ in mixing.pfair(mixing.exact_parts(many), dict.fromkeys(many, 3000)) if t < 6000 and s == "a"]
    total = sum(many.values())
    assert all(abs(k - t / 3 / total) < 1 for k, t in enumerate(slots)) and abs(len(slots) - 2000) < 1
    assert mixing.exact_parts({"a": 0.5, "b": 0.25, "c": 0.0}) == {"a": 2, "b": 1, "c": 0}
    assert mixing.exact_parts({"a": 0, "b": 0}) == {"a": 1, "b": 1}


def test_mixing_without_weight_and_clashing_names(spark):
    rows = [(i, "x" * 9, "en", "ab"[i % 2], 9, 100 + i) for i in range(40)]
    d = spark.createDataFrame(rows, SCHEMA + ", slot long")
    got = mixing.mix_sources(d, {"b": 1.0}, block_bytes=10).collect()
    assert max(r.slot for r in got if r.source == "b") < min(r.slot for r in got if r.source == "a")
    kept = mixing.mixed_order(d, block_bytes=10).collect()
    assert {(r.doc_id, r.slot) for r in kept} == {(i, 100 + i) for i in range(40)}


def test_quality_learns_held_out(spark):
    rng = random.Random(1)
    make = lambda junk: " ".join("".join(rng.choices("abcdef", k=4)) + ("$$$" if junk else "") for _ in range(40))
    rows = [(i, make(i % 4 == 0)) for i in range(400)] + [(400, None), (401, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(3, None), (9999, 1), (5, 7)], "doc_id long, quality int")
    got = collected(quality.quality_scores(d, labels))
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    test = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert test and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in test) / len(test) > 0.95
    none = quality.quality_scores(d, labels.where("quality > 5")).collect()
    assert {r.score for r in none} == {0.5}
    kept = {r.doc_id for r in quality.keep_good(d, labels).collect()}
    assert kept >= {r.doc_id for r in test if r.doc_id % 4}


def test_language(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdé", "bb": "vwxyz", "cc": "klmno"}
    rows = [(i, " ".join("".join(rng.choices(letters[g], k=5)) for _ in range(30)), g) for i, g in enumerate(list(letters) * 40)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 ?!", "bb"), (903, "日本", None), (904, rows[0][1], None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collected(langid.identify(d))
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == g for i, _, g in rows[:120])
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred in letters and got[904].lang_pred == "aa"
    assert {r.lang_pred for r in langid.identify(d.withColumn("lang", d.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und", ""}


def test_urls(spark):
    urls = {
        1: "http://a.Example.COM/en/x", 2: "https://www.example.com/en/", 3: "http://x.com", 4: "http://x.com/?q=1", 5: "http://net/es/1", 6: "http://b.net/fr/#t", 7: "http://b.net/de/1",
        8: None, 9: "no scheme/en/", 10: "ftp://q.org/en/5?x=1", 11: "", 12: "http://exXample.com/en/", 13: "a://b://c/d", 14: "http://b.org/fr/9",
    }
    d = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    expect = {1: ("a.example.com", "/en/x", "example.com/en/"), 2: ("www.example.com", "/en/", "www.example.com/en/"), 3: ("x.com", "", None), 4: ("x.com", "/", "com/"), 5: ("net", "/es/1", "net/es/"), 6: ("b.net", "/fr/", "net/fr/"), 7: ("b.net", "/de/1", None), 8: ("", "", None), 9: ("", "", None), 10: ("q.org", "/en/5", None), 11: ("", "", None), 12: ("exxample.com", "/en/", "com/"), 13: ("b:", "//c/d", None), 14: ("b.org", "/fr/9", None)}
    got = collected(url_rules.judge_urls(d, min_support=0.05), "page_id")
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == expect
    verdict = {"example.com/en/": "block", "www.example.com/en/": "allow", "com/": "allow", "net/es/": "block", "net/fr/": "block"}
    assert all(r.verdict == verdict[r.rule] for r in got.values() if r.rule) and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert got[14].verdict == "block" and got[14].mined  # learned from the blocked /fr/


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice('abc')}.site{rng.randint(1, 3)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randint(1, 9)}") for i in range(300)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    from pyspark.sql import functions as F

    host, path = url_rules.host_and_path(F.col("url"))
    name, verdict = url_rules.fixed_rule(host, path)
    t = d.select("page_id", url_rules.url_tokens(F.col("url"), host, path).alias("tokens"), verdict.alias("verdict"))
    # every token an item of its own: all rules there are, which the items of equal rows must stand for
    apart = t.select(F.explode("tokens").alias("token")).distinct().select("token", F.col("token").alias("item"))
    rules = url_rules.mine(t.where("verdict is not null").select("tokens", "verdict"), apart, 0.02, 0.8).collect()
    labelled = [r for r in t.collect() if r.verdict]
    for r in rules:
        have = [x for x in labelled if set(r.antecedent) <= set(x.tokens)]
        assert sum((x.verdict == "block") == r.block for x in have) / len(have) == pytest.approx(r.confidence)
    got = collected(url_rules.judge_urls(d, min_support=0.02), "page_id")
    for x in t.collect():
        fit = [r for r in rules if set(r.antecedent) <= set(x.tokens)]
        if not x.verdict:
            best = max(fit, key=lambda r: (r.confidence, r.support, len(r.antecedent), not r.block, r.antecedent), default=None)
            assert got[x.page_id].verdict == ("block" if best and best.block else "allow")


def test_mined_rules_of_many_tokens(spark):
    keys = "abcde"
    urls = [f"http://x.com/zz/?{'&'.join(k for k in keys if k != out)}" for out in keys for _ in range(20)]  # allowed: four of the keys
    urls += [f"http://x.net/fr/?{'&'.join(keys)}"] * 60  # blocked: all five
    urls += [f"http://y.org/yy/?{'&'.join(keys)}", "http://y.org/yy/?a&b&c&d"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = collected(url_rules.judge_urls(d), "page_id")
    assert got[160].verdict == "block" and {f"q={k}" for k in keys} <= set(got[160].mined) and got[160].confidence == 1
    assert got[161].verdict == "allow" and got[161].mined is None


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 12)) + rng.integers(0, 4, (900, 1)) * 3
    x[200:260] = x[100]  # one vector many times
    rows = [(i, [float(v) for v in q]) for i, q in enumerate(x.astype(np.float32))]
    odd = [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] * 12), (5300, [1.0, 2.0]), (None, [1.0] * 12), (5400, [None] + [1.0] * 11), (5500, [float("inf")] * 12)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(d).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    v = x.astype(np.float32).astype(float)
    assert set(got) == set(range(0, 900, 100))
    hit = 0
    for q, found in got.items():
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        dist[q] = np.inf
        order = np.lexsort((np.arange(900), dist))[:10]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and all(s == pytest.approx(dist[i], abs=1e-12) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(order.tolist()))
    assert hit >= 0.9 * 90
    assert [i for _, i, _ in got[100]] == list(range(200, 210))


def test_neighbours_with_repeated_ids(spark):
    near = [(1, [1.0, 2.0, 3.0])] * 30 + [(i, [1.0, 2.0, 3.0]) for i in range(2, 5)]
    near += [(5, [1.0 + k / 1000, 2.0, 3.0]) for k in range(1, 30)]  # one id with many vectors
    rows = [(100, [1.0, 2.0, 3.0])] + near + [(i, [1.0, 2.0, 3.0 + i]) for i in range(6, 20)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found = sorted((r.rank, r.vec_id) for r in got)
    assert found == [(k, k) for k in range(1, 11)] and all(r.query_id == 100 for r in got)


def test_hilbert_neighbours_are_adjacent():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert len(np.unique(ann.hilbert(cells, 3))) == side**3 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(empty, labels).count() == 0
    assert fm_dedup.dedup_windows(empty).count() == 0
    assert suffix_dedup.dedup_bytes(empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d", "en", None, 1), (None, None, None, "s", 1), (1, "a b c d", "en", "s", 1)], SCHEMA)
    assert exact_dedup.exact_dedup(d).count() == 3
    assert jaccard.jaccard_components(d).where("component_id is null").count() == 2
    assert packing.pack(d, tokenizer_path()).count() == 3
    assert mixing.mix_sources(d).count() == 3
    assert fm_dedup.dedup_windows(d, length=4, gram=2).agg({"n_removed": "sum"}).first()[0] == 4
    assert langid.identify(d).count() == 3


def test_stages_judge_rows_that_share_an_id(spark):
    d = spark.createDataFrame([(None, "x y", "en", "s", 1), (9, "X y", "en", "s", 2), (None, "p q", "en", "s", 3), (5, "X Y", "en", "s", 4), (5, "r", "en", "s", 5), (5, "R", "en", "t", 6), (7, None, "en", "s", 7), (7, "", "en", "s", 7), (None, "p q", "en", "t", 8)], SCHEMA)
    kept = exact_dedup.keep_last_copies(d)
    assert kept.columns == d.columns
    got = sorted(((r.doc_id or -1, (r.text or "").lower()) for r in kept.collect()))
    assert got == [(-1, "p q"), (5, "r"), (7, ""), (9, "x y")]
    assert kept.where("doc_id = 5").first().text == "R"
    rng = random.Random(3)
    make = lambda junk: " ".join("".join(rng.choices("abcdef", k=4)) + ("$$$" if junk else "") for _ in range(40))
    rows = [(i, make(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    good, bad = [make(False) for _ in range(3)], [make(True) for _ in range(3)]
    extra = [(None, good[0]), (None, bad[0]), (1001, good[1]), (1001, bad[1]), (1002, good[2]), (1002, good[2])]
    left = quality.keep_good(spark.createDataFrame(rows + extra, "doc_id long, text string"), labels).where("doc_id is null or doc_id > 1000").collect()
    assert collections.Counter((r.doc_id, r.text) for r in left) == {(None, good[0]): 1, (1001, good[1]): 1, (1002, good[2]): 2}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == names
            kept.append({r.doc_id: r.text for r in docs.collect()})
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for i, t in kept[1].items():
        best[low(t)] = max(best.get(low(t), -1), i)
    assert set(kept[2]) == set(best.values())
    sets = {i: shingles(t, 5) for i, t in kept[2].items()}
    alike = lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and group[i] != group[j] and alike(i, j):
                    lo, hi = sorted((group[i], group[j]))
                    group = {k: lo if g == hi else g for k, g in group.items()}
                    changed = True
    assert set(kept[3]) == {i for i, g in group.items() if i == g} and kept[4] == kept[3]
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(kept[4])
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    ends = collections.Counter()
    for r in pieces:
        ends[r.sequence_id] += r.length
    assert all(n == 4096 for s, n in ends.items() if s != max(ends))


def test_mixture_order_reaches_the_packing(spark, tmp_path):
    """Packing follows the order in which the mixing stage wrote its files."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixing.mixed_order(d, block_bytes=2000).write.parquet(str(tmp_path / "m"))
    want = [r.doc_id for r in mixing.mix_sources(d, block_bytes=2000).orderBy("slot", "block_offset").collect()]
    pieces = packing.pack(spark.read.parquet(str(tmp_path / "m")), tokenizer_path()).where("start = 0").orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in pieces] == want
