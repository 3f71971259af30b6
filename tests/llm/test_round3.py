"""The lexical search, phrase mining and sketch operators against brute force, and on odd tables; sums of cells, and class numbers."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, exact_dedup, jaccard_join, lexical_search, media, phrases, setsketch

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, " \t\n\x0b", "en", "s", 4),
    (4, "one two three", "en", "s", 13),
    (5, "One TWO\tthree", None, "s", 13),
    (6, "naïve 日本 😀 " * 30, "fr", "t", 360),
    (6, "naïve 日本 😀 " * 30, "fr", "t", 360),
    (7, "word" * 30_000, "en", "t", 120_000),
    (8, "a b c d e f g " * 9_000, "en", None, 126_000),
    (None, "no id here at all", "en", "s", 17),
    (None, "no id here at all", "en", "s", 17),
]


@pytest.fixture(scope="module")
def odd(spark):
    clash = [F.lit(0).alias(c) for c in ("node", "row", "rank", "term", "bucket", "slice", "score", "item", "phrase", "f", "key", "digest", "band", "n", "size", "component_id", "kept")]
    return spark.createDataFrame(ODD, SCHEMA).select("*", *clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 12. ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def searched(docs, items, k):
    """Every document scored for every item, in Python's own numbers."""
    tfs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    tfs = [(i, tf) for i, tf in tfs if tf]
    n_docs, words = len(tfs), sum(sum(tf.values()) for _, tf in tfs)
    df = Counter(t for _, tf in tfs for t in tf)
    out = []
    for item, text in items:
        best = []
        for at, (i, tf) in enumerate(tfs):
            m = 75 + 25 * sum(tf.values()) * n_docs // words
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if tf[t])
            if score:
                best.append((-score, i is None, i or 0, at, i))
        out += [(item, r + 1, b[4], -b[0]) for r, b in enumerate(sorted(best)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [200_000, 40])
def test_search_equals_brute_force(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical_search, "RUN_BYTES", 20_000)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DIR}/benchmark.parquet'").fetchall()[:12] + [(100, None), (101, "..."), (102, "the the of nowhere-else"), (102, "la de, EN")]
    made = lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), buckets=5)
    got = lexical_search.search(made, spark.createDataFrame(items, "item_id long, text string"), buckets=5, block_terms=block_terms).collect()
    assert sorted(map(tuple, got), key=str) == searched(docs, items, 20)


def test_search_odd_and_empty_tables(spark, odd, empty):
    items = [(1, "ONE word naïve a"), (2, ""), (3, None), (None, "here 日本")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = lexical_search.search(lexical_search.index(odd), asked).collect()
    assert sorted(map(tuple, got), key=str) == searched([(r[0], r[1]) for r in ODD], items, 20)
    assert lexical_search.search(lexical_search.index(odd), asked.limit(0)).count() == 0
    assert lexical_search.search(lexical_search.index(empty), asked).count() == 0


def test_search_ties_go_by_id(spark):
    docs = [(9 - i, "same words here") for i in range(8)] + [(i, f"filler {i}") for i in range(20, 60)]
    got = lexical_search.search(lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame([(1, "words")], "item_id long, text string"), k=3)
    assert [(r["rank"], r.doc_id) for r in got.orderBy("rank").collect()] == [(1, 2), (2, 3), (3, 4)]


# 11. phrases


def phrases_of(docs, least, percent=100, keep=2000, most=5):
    """Every phrase counted, every cut scored, every longer candidate looked at."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if a >= least}
        inside = {p[i:j] for p, c in known.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * c >= percent * known[p[i:j]]}
        rows = []
        for p, a in known.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n[lang] // (known[p[:k]] * known[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), known[p[:k]], known[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(rows)[:keep])]
    return sorted(out)


@pytest.mark.parametrize(("bits", "least", "percent", "keep"), [(1 << 16, 12, 100, 2000), (64, 12, 60, 40)])
def test_phrases_equal_brute_force(spark, monkeypatch, bits, least, percent, keep):
    """A bit table with nearly all bits set rules nothing out, and changes nothing."""
    monkeypatch.setattr(phrases, "LEAST_BITS", min(bits, phrases.LEAST_BITS))
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "RUN_BYTES", 30_000)
    docs = duckdb.sql(f"SELECT lang, text FROM '{DIR}/documents.parquet'").fetchall() + [(None, "To be,  or NOT\tto be: to be to be to be " * 9), ("en", "São Paulo são paulo\x0bsão")]
    got = phrases.mined(spark.createDataFrame(docs, "lang string, text string").repartition(5), least=least, percent=percent, keep=keep).collect()
    assert sorted(map(tuple, got)) == phrases_of(docs, least, percent, keep)


def test_phrases_odd_and_empty_tables(spark, odd, empty):
    assert sorted(map(tuple, phrases.mined(odd, least=2).collect())) == phrases_of([(r[2], r[1]) for r in ODD], 2)
    assert phrases.mined(empty).collect() == []


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 - 7, 10**14 - 3, 10**13 + 9, 10**13 + 1), (10**15, 10**16, 10**15 + 1, 10**15 + 3), (100, 10**14, 100, 100)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").withColumn("score", F.expr(phrases.SCORE)).collect()
    assert [r.score for r in got] == [1000 * a * n // (l * r) for a, n, l, r in rows]


# 13. near duplicates by SetSketch


def grams(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near(rows, k, percent):
    """``(doc_id, size, component)`` of each row, by all pairs."""
    found, top = [grams(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in enumerate(found):
        for b in range(a):
            both = len(x & found[b])
            if both and 100 * both >= percent * (len(x) + len(found[b]) - both):
                top[find(a)] = find(b)
    lowest = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            lowest[find(a)] = min(i, lowest.get(find(a), i))
    out = [(i, len(x), lowest.get(find(a)) if x else i) for a, ((i, _), x) in enumerate(zip(rows, found, strict=True))]
    return sorted([(*r, r[0] == r[2]) for r in out], key=str)


def varied(seed, groups=12, copies=14):
    """Groups of texts with more and more words changed, some of which share a passage with other groups."""
    rnd, out = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for g in range(groups):
        base = [f"w{g}_{rnd.randrange(10_000)}" for _ in range(rnd.randrange(3, 160))] + (passage if g % 3 == 0 else [])
        for c in range(copies):
            words = list(base)
            for _ in range(rnd.randrange(0, 1 + len(words) // (6 + 2 * (c % 5)))):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("limits", [{}, {"most_listed": 1, "block_sketches": 3, "block_grams": 500, "block_classes": 3}])
def test_near_duplicates_equal_brute_force(spark, limits):
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DIR}/documents.parquet'").fetchall()] + varied(5)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80, **limits)
    assert sorted(map(tuple, got.collect()), key=str) == near(rows, 4, 80)


def test_near_duplicates_odd_and_empty_tables(spark, odd, empty):
    rows = [(r[0], r[1]) for r in ODD]
    want = [(i, n, c, i == c) for i, n, c, _ in near(rows, 5, 80)]
    assert sorted(map(tuple, setsketch.near_duplicates(odd).collect()), key=str) == sorted(want, key=str)
    assert setsketch.near_duplicates(empty).collect() == []


def test_sketches_merge_and_tell_similarity():
    rnd = np.random.default_rng(1)
    every = rnd.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    with np.errstate(over="ignore"):
        a, b, both = setsketch.sketches([every[:3000], every[1000:], every])
    assert (setsketch.merged(a, b) == both).all() and (setsketch.sketches([every[:0]]) == 0).all()
    equal = []
    for j in (0.5, 0.8, 0.9):
        n, k = 900, round(900 * 2 * j / (1 + j))
        found = [rnd.integers(0, 1 << 63, 2 * n - k, dtype=np.uint64) * np.uint64(2) for _ in range(60)]
        with np.errstate(over="ignore"):
            left, right = setsketch.sketches([x[:n] for x in found]), setsketch.sketches([x[n - k :] for x in found])
        equal.append((left == right).mean())
        ok = setsketch._passes((left == right).sum(1), (left > right).sum(1), np.full(60, n), np.full(60, n), 80)
        assert ok.all() if j >= 0.8 else not ok.any()
        assert abs(equal[-1] - math.log(1 + j * (setsketch.BASE - 1)) / math.log(setsketch.BASE)) < 0.02


def test_each_band_bears_its_share(spark):
    """Pairs of similarity 0.8 agree in all registers of a band about as often as the recall in the docstring takes for granted."""
    rnd, hits = np.random.default_rng(2), []
    for _ in range(60):
        x = rnd.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
        with np.errstate(over="ignore"):
            a, b = setsketch.sketches([x[:450], x[50:]])
        hits.append((a == b).reshape(-1, setsketch.ROWS).all(1).mean())
    assert abs(np.mean(hits) - 0.8077**6) < 0.05


# what doesn't hang on the size of a value or a snapshot


@pytest.mark.parametrize("unit", [b"%PDF-1 %%EOF ", b"%PDF-1 startxref 7 %%EOF ", b"%PDF-1 1 0 obj startxref 7 %%EOF ", b"PK\x03\x04PK\x05\x06" + b"\0" * 18, b"1 0 obj ", b"1" * 64, b"%PDF-1 1 0 obj "])
def test_long_values_full_of_markers_take_linear_time(unit):
    raw = unit * (5_000_000 // len(unit))
    began = time.perf_counter()
    media.sniff(raw)
    assert time.perf_counter() - began < 20


def test_updates_and_embedded_pdfs():
    def pdf(body, more=b""):
        head = b"%PDF-1.4\n1 0 obj\n" + body + b"\nendobj\n"
        return head + b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(head) + more

    inner = pdf(b"inner")
    outer = pdf(b"stream " + inner + b" endstream")
    update = b"\n2 0 obj\nx\nendobj\nxref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % (len(outer) + len(b"\n2 0 obj\nx\nendobj\n"))
    for raw, parts in ((outer, [outer, inner]), (outer + update, [outer + update, inner]), (inner + b" and " + inner, [inner, inner])):
        assert [raw[a:b] for _, a, b in media.sniff(raw)] == parts


def test_a_large_batch_meets_an_empty_snapshot_in_parts(spark, empty):
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)], "doc_id long, text string")
    snapshot = docs.where("doc_id < 0")
    got = exact_dedup.exact_dedup(snapshot, docs, bucket_keys=16).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 300, 3) for i in range(900)}
    digests = docs.select(F.lit(0).cast("long").alias("bucket"), F.xxhash64("doc_id").alias("key"))
    filters = exact_dedup.snapshot_filters(digests.where("key % 3 = 0"))
    assert exact_dedup.screened(filters, digests, 19).where("key % 3 = 0 and not maybe").count() == 0
    plan = exact_dedup.screened(filters, digests, 19)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "part" in plan[plan.index("hashpartitioning") :].split(")")[0]


# sums of cells, and numbers of classes


@pytest.mark.parametrize("fan_in", [2, 64])
def test_cells_are_added_up_in_a_tree(spark, fan_in):
    rng = np.random.default_rng(4)
    tables = [rng.integers(0, 9, 2 * common.CHUNK) * (rng.random(2 * common.CHUNK) < 0.01) for _ in range(40)]
    rows = [(k % 2, chunk, bytearray(cells)) for k, table in enumerate(tables) for chunk, cells in common.packed(table)]
    chunks = common.written(spark.createDataFrame(rows, "model int, chunk int, cells binary").repartition(23), "test")
    got = {(r.model, r.chunk): common.unpacked(r.cells) for r in common.added_up(chunks, ["model", "chunk"], fan_in).collect()}
    assert len(got) == 4
    for model in (0, 1):
        assert (np.concatenate([got[model, 0], got[model, 1]]) == sum(tables[model::2])).all()


@pytest.mark.parametrize("bits", [0, 3])
def test_sets_that_share_a_number_are_told_apart(spark, bits):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in (5, 30, 59)] + [f"apart {k} from all of the others" for k in range(12)] + ["", "a b", "A b"]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    columns = ["doc_id", "n_shingles", "component_id", "n_links"]
    plain = jaccard_join.jaccard_components(docs).select(*columns).orderBy("doc_id").collect()
    assert len({r.component_id for r in plain}) > 10
    assert jaccard_join.jaccard_components(docs, node_bits=bits).select(*columns).orderBy("doc_id").collect() == plain
