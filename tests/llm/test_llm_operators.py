"""Each operator against a brute-force version or an exact round trip, and on the odd tables that all have to take."""

import collections
import gzip
import hashlib
import io
import random
import re
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, exact_dedup, hilbert, jaccard_join, line_dedup, lm_score, media, mixing, packing, pii, shingles, toxicity

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
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
]


@pytest.fixture(scope="module")
def odd(spark):
    clash = [F.lit(0).alias(c) for c in ("node", "size", "hash", "cut", "token", "key", "score", "n_lines", "copies", "head", "curve", "_copy", "n_deleted", "__x")]
    return spark.createDataFrame(ODD, SCHEMA).select("*", *clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall())


OPERATORS = {
    "jaccard": jaccard_join.jaccard_components,
    "pii": pii.found,
    "hilbert": hilbert.shards,
    "mixing": mixing.mixed,
    "lines": line_dedup.line_dedup,
    "packing": packing.packed,
    "media": media.stored_texts,
    "toxicity": lambda d: toxicity.scored(d.select("doc_id", "text", *([c for c in d.columns if c == "score"])), toxicity.Lexicon([("idiot", 5.0, False)])),
    "lm": lambda d: lm_score.scored(d, lm_score.models(lm_score.labelled(d, d.select("doc_id", F.lit(1).alias("quality")), F.col("quality") == 1))),
    "exact": lambda d: exact_dedup.exact_dedup(*exact_dedup.halves(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, empty, name):
    rows = OPERATORS[name](odd).collect()
    ids = [r.doc_id for r in rows]
    assert set(ids) == {r[0] for r in ODD}
    if name != "packing":
        assert len(ids) == len(ODD)
    assert OPERATORS[name](empty).count() == 0


def test_repeated_keeps_columns(odd, empty):
    out = mixing.repeated(odd.withColumn("_copy", F.lit(9)))
    assert out.columns == odd.columns and {r._copy for r in out.collect()} == {9}
    assert mixing.repeated(empty).count() == 0


# 1. n-gram Jaccard join


def grams(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows, percent=85):
    sets, top = [(i, grams(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                u, v = find(i), find(j)
                top[max(u, v)] = min(u, v)
    return {i: (len(x), find(i)) for i, x in sets}


@pytest.mark.parametrize("most_listed", [200, 2])
def test_jaccard_equals_brute_force(spark, most_listed):
    r = random.Random(7)
    rows = []
    for group in range(6):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([5, 9, 40, 120]))]
        for _ in range(r.randint(1, 25)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                words[r.randrange(len(words))] = f"x{r.randint(0, 30)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", " ", "a", "A", "a b", "a b c d", "a b c d e"])]
    r.shuffle(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), most_listed=most_listed, block_grams=2000).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == components(rows)


@pytest.mark.parametrize("most_listed", [200, 2])
def test_jaccard_counts_all_links(spark, most_listed):
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(r.sample(range(200), 30))]
    rows += [(40, rows[3][1]), (40, rows[3][1]), (41, " ".join(base[:180])), (42, "a b"), (43, "A b"), (44, ""), (45, "")]
    for i in range(46, 90):  # some link in part only
        words = [f"v{j}" for j in range(60)]
        for j in r.sample(range(60), r.choice([0, 1, 1, 2])):
            words[j] = "x"
        rows.append((i, " ".join(words)))
    sets = [grams(t) for _, t in rows]
    plain = collections.Counter()
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            plain[a] += a != b and bool(x & y) and 100 * len(x & y) >= 85 * len(x | y)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), most_listed=most_listed, block_grams=2000).collect()
    assert sorted((x.doc_id, x.n_links) for x in got) == sorted((rows[a][0], n) for a, n in plain.items())


def test_shingle_words_and_edges():
    data = ["", " a  b ", "A\tb\nc d e", "x"]
    flat = [list(shingles.words(raw, at)) for _, raw, at in shingles.pieces(pa.array(data))][0]
    assert np.diff(flat[1]).tolist() == [0, 2, 5, 1]
    assert [len(s) for s in shingles.sets(pa.array(data), 4)] == [0, 1, 2, 1]
    long = pa.array(["a b c d " * 5, None, "zz"])
    assert [s.tolist() for s in shingles.sets(long, 2)] == [s.tolist() for x in long for s in shingles.sets(pa.array([x], pa.string()), 2)]


# 2. toxicity


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["scum", "idiot", "loser", "worthless", "closer"]
    own = toxicity.Automaton(toxicity.Lexicon([(t, 1.0, False) for t in terms]))
    r = random.Random(2)
    for _ in range(4000):
        word = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randint(0, 1)] = r.choice(["", "a", "s", "e"])
        word = "".join(word)
        best = min((distance(word, t) for t in terms if distance(word, t) <= toxicity.edits(t)), default=None)
        found = own.match(word)
        assert (found and found[0]) == best, word


def test_context_and_stems():
    own = toxicity.Automaton(toxicity.Lexicon([("idiot", 4.0, False), ("vequ", 3.0, True)]))
    weight = lambda t: toxicity.evidence(t, own)[0]
    assert weight("you idiot") > weight("an idiot") > weight('she said "idiot" once') > 0
    assert weight("1d10t") > 0 and weight("vequxyz.") == 3.0 and weight("equ idle") == 0 and weight("") == 0


def test_toxicity_on_held_out_rows(spark):
    docs = common.documents(spark, "/root/testdata/sf0.1").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = toxicity.scored(docs, model).join(labels.where(toxicity.held_out()), "doc_id").select("predicted", "toxic").collect()
    hit = sum(x.predicted and x.toxic for x in got)
    assert hit / sum(x.toxic for x in got) > 0.85 and hit / sum(x.predicted for x in got) > 0.85
    assert toxicity.train(docs, labels.where("toxic = 0")).terms == []


# 3. language models


def test_lm_scores_tell_quality(spark):
    docs = common.documents(spark, "/root/testdata/sf0.1").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted = lm_score.models(lm_score.labelled(docs, labels.where(~toxicity.held_out()), F.col("quality") == 1))
    got = lm_score.scored(docs, fitted).join(labels.where(toxicity.held_out()), "doc_id").toPandas()
    ranks = (-got.ce_difference).rank()
    good = got.quality == 1
    n1, n0 = good.sum(), (~good).sum()
    assert (ranks[good].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95


def test_lm_counts_and_paths(spark, monkeypatch):
    docs = common.documents(spark, DIR).select("doc_id", "text")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    marked = lm_score.labelled(docs, labels, F.col("quality") == 1).collect()
    texts = spark.createDataFrame([(r.text, r.is_target) for r in marked], "text string, is_target boolean")
    monkeypatch.setattr(lm_score, "HEAVY_PAIRS", 0)  # pairs are of heavy words only
    fitted = lm_score.models(texts)
    assert not len(fitted.pairs[0])
    every, target = {}, {}
    for r in marked:
        for w in WORD.findall(r.text.translate(LOWER)):
            every[w] = every.get(w, 0) + 1
            target[w] = target.get(w, 0) + r.is_target
    # exact counts, of the shared vocabulary and of all tokens
    assert fitted.totals == (sum(every.values()), sum(target.values()))
    assert (fitted.heavy[1][1] > 0).sum() + fitted.vocabulary.count() == sum(n >= 2 for n in target.values())
    assert fitted.heavy[1].sum(1).tolist() == [sum(every[w] for w, n in target.items() if n >= 2), sum(n for n in target.values() if n >= 2)]
    with_heavy = lm_score.scored(docs, fitted).toPandas().sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(lm_score, "HEAVY", 1)  # now nearly all words go through the join
    by_join = lm_score.scored(docs, lm_score.models(texts)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (with_heavy.n_tokens == by_join.n_tokens).all()
    assert np.allclose(with_heavy.ce_difference, by_join.ce_difference, atol=1e-4)


def test_lm_losses(spark, monkeypatch):
    """Every loss by plain Python, with exact counts of words, pairs and bytes; some words heavy, some met by the join."""
    monkeypatch.setattr(lm_score, "HEAVY", 120)
    monkeypatch.setattr(lm_score, "HEAVY_PAIRS", 100)
    rng = random.Random(5)
    known = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choices(known, [60 / (k + 1) for k in range(40)], k=rng.randrange(1, 40))), i % 3 == 0) for i in range(60)]
    rows += [(60, "W0 w1 w2", False), (61, "w0", True), (62, " w1\t", False), (63, None, False), (64, "", True), (65, "unheard naïve w0 w1", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").repartition(3)
    fitted = lm_score.models(docs.select("text", "is_target"))
    got = {r.doc_id: r for r in lm_score.scored(docs.select("doc_id", "text"), fitted).collect()}

    tables = []
    for mine in (False, True):
        words, pairs, grams = collections.Counter(), collections.Counter(), [collections.Counter() for _ in range(3)]
        for _, text, is_target in rows:
            if mine and not is_target:
                continue
            lowered = WORD.findall((text or "").translate(LOWER))
            words.update(lowered)
            pairs.update(zip(lowered, lowered[1:], strict=False))
            raw = b"   " + (text or "").encode()
            for i in range(3, len(raw)):
                for table, key in zip(grams, (raw[i - 3 : i + 1], raw[i - 3 : i], raw[i - 1 : i + 1]), strict=True):
                    table[key] += 1
        tables.append((words, pairs, grams))
    target = tables[1]
    totals = [sum(t[0].values()) for t in tables]
    bytes_in = [sum(t[2][2].values()) for t in tables]
    kept = {p for p, n in tables[0][1].items() if n * 100 >= totals[0] and target[1][p] >= 2}
    assert len(kept) == len(fitted.pairs[0]) > 3
    heavy = {w for w, n in tables[0][0].items() if n * 120 >= totals[0]}
    assert 3 < len(heavy) < 40 and {w for p in kept for w in p} <= heavy

    def loss(text, k):
        words, pairs, (four, head, pair) = tables[k]
        scale = 1 if k else bytes_in[1] / bytes_in[0]
        spelled_share = 1 - 0.5 * sum(n for w, n in words.items() if target[0][w] >= 2) / totals[k]
        raw, out, before = b"   " + text.encode(), 0.0, None
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
            w = m.group().lower().decode()
            spelled = spelled_share
            for i in range(m.start(), min(m.end() + 1, len(raw))):
                row = sum(n for key, n in pair.items() if key[0] == raw[i - 1]) * scale
                low = (pair[raw[i - 1 : i + 1]] * scale + 0.5) / (row + 128)
                spelled *= min(1.0, (four[raw[i - 3 : i + 1]] * scale + 20 * low) / (head[raw[i - 3 : i]] * scale + 20))
            alone = spelled + (0.5 * words[w] / totals[k] if target[0][w] >= 2 else 0)
            share = 0.5 * pairs[before, w] / words[before] if (before, w) in kept else 0
            left = 1 - sum(pairs[p] / words[before] for p in kept if p[0] == before)
            out -= np.log(share + ((0.5 + 0.5 * max(0, left)) if before else 1) * alone)
            before = w
        return out

    for i, text, _ in rows:
        n = len(WORD.findall(text or ""))
        assert got[i].n_tokens == n
        for k, c in ((0, "ce_background"), (1, "ce_target")):
            assert got[i][c] == pytest.approx(loss(text or "", k) / max(1, n), rel=1e-4, abs=1e-6)


# 4. personal data

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_pii_equals_plain_patterns(spark):
    r = random.Random(1)
    parts = ["a", "@", ".", "b.c", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "+", "0", "1", " ", "-", "(", "255", "é", "😀", "\n", "_", "%", "a@b.c", "+1 (988) 555-2485", "999"]
    data = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    data += ["1" * 20_000, "a" * 20_000 + "@", "a@" * 2000, "1." * 5000]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = pii.found(df).select("doc_id", F.expr(pii._listed("filter(found, x -> x.kind in ('email', 'ip', 'card', 'phone'))")).alias("s")).collect()
    plain = {i: base_spans(t) for i, t in enumerate(data) if len(t) < 15_000 or i >= 3002}
    assert all(r.s == plain[r.doc_id] for r in got if r.doc_id in plain)


def test_pii_checksums_and_context(spark):
    data = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00", "SSN 123-45-6789", "part 123-45-6789"]
    got = pii.found(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.found] for r in got] == [["iban"], [], ["ssn"], []]


# 5. Hilbert shards


def test_curve_is_a_hilbert_curve(spark):
    g = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    got = g.select("a", "b", "c", hilbert.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3).alias("i")).toPandas().sort_values("i")
    assert got.i.tolist() == list(range(512))
    assert set(got[["a", "b", "c"]].diff().dropna().abs().sum(axis=1)) == {1.0}


def test_shards_are_even_and_gapless(spark, texts):
    got = hilbert.op5_hilbert_shards(spark, DIR).toPandas()
    slots = got.groupby("shard").slot.agg(["min", "max", "count"])
    assert len(got) == len(texts) and slots["count"].max() - slots["count"].min() <= 1
    assert (slots["min"] == 0).all() and (slots["max"] + 1 == slots["count"]).all()
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.itertuples())


# 6. mixing


def shares(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixture_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 60), r.choice([None, "", "a", "b", "c", "ü", "z"] + ["hot"] * 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = mixing.mixed(df).toPandas(), mixing.mixed(df.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    source, size = {i: s for i, _, s in rows}, {i: len(WORD.findall(t)) for i, t, _ in rows}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    target, taken = shares(sizes), collections.Counter()
    for x in got.itertuples():
        assert x.size == size[x.doc_id] and x.source_size == sizes[source[x.doc_id]] and 0 <= x.taken <= 2 * x.size
        assert x.target == pytest.approx(target[source[x.doc_id]])
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)  # half of the largest row


# 7. line dedup


def deduped(rows, least):
    docs = [(i, [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n") if WORD.search(x)]) for i, t in sorted(rows)]
    at, gone = collections.defaultdict(list), collections.defaultdict(set)
    for a, (_, own) in enumerate(docs):
        for p, x in enumerate(own):
            at[x].append((a, p))
    for a, (i, own) in enumerate(docs):
        for p in range(len(own)):
            for b, q in at[own[p]]:
                if (b, q) >= (a, p):
                    break
                other, k, words = docs[b][1], 0, 0
                while p + k < len(own) and q + k < len(other) and own[p + k] == other[q + k]:
                    words += len(WORD.findall(own[p + k]))
                    k += 1
                if words >= least:
                    gone[i].update(range(p, p + k))
    return {i: "\n".join(x for k, x in enumerate(y for y in t.split("\n") if WORD.search(y)) if k not in gone[i]) if gone[i] else t for i, t in rows}


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_dedup_equals_brute_force(spark, least):
    r = random.Random(least)
    rows = [(i, "\n".join(" ".join(r.choice("ab") for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 12)))) for i in range(80)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    assert {x.doc_id: x.text for x in got} == deduped(rows, least)


def test_line_dedup_takes_null_ids(spark):
    rows = [(None, "a b c\nd e\nfirst"), (None, "a b c\nd e\nsecond"), (7, "third\na b c\nd e"), (8, "fourth")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    nulls = sorted((x.text, x.n_deleted) for x in got if x.doc_id is None)
    assert nulls in ([("a b c\nd e\nfirst", 0), ("second", 2)], [("a b c\nd e\nsecond", 0), ("first", 2)])
    assert {x.doc_id: (x.text, x.n_deleted) for x in got if x.doc_id} == {7: ("third", 2), 8: ("fourth", 0)}


# 8. packing


def test_ids_are_the_tokenizers_own(texts):
    from tokenizers import Tokenizer

    own, full = packing.tokenizer(packing.tokenizer_file()), Tokenizer.from_file(packing.tokenizer_file())
    odd = ["a\x0bb \x1c c\x85d\xa0e  f", "<|endoftext|>hi", "naïve ªº²³ ¼ x", "日本 語　x", "a  \n\n b\t\tc", "", "it's we'll X'S", " \n", "😀👍"]
    for text in [*odd, *texts.values()]:
        assert own.ids(text) == full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [(2048, 64, 2048), (64, 3, 50), (16, 1, 16)])
def test_packing_is_exact_and_within_limits(spark, texts, limits):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.tokenizer_file())
    some = dict(list(texts.items())[:60]) | {-1: ""}
    df = spark.createDataFrame([(i, t, 5) for i, t in some.items()], "doc_id long, text string, prompt int")
    got = packing.packed(df, limits, prompt="prompt", room=16).toPandas()
    for i, part in got.sort_values("start").groupby("doc_id"):
        ids = [*full.encode(some[i], add_special_tokens=False).ids, 1]
        assert [x for piece in part.ids for x in piece] == ids and (part.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in part.itertuples())
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= limits[0] and len(part) <= limits[1]
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert sum(max(0, p.length - max(0, 5 - p.start)) for p in part.itertuples()) <= limits[2]


# 9. media


def test_stored_texts_round_trip(spark, texts):
    for x in media.stored_texts(spark.createDataFrame([*texts.items(), (-1, None)], "doc_id long, text string")).collect():
        plain = (texts.get(x.doc_id) or "").encode()
        payload = plain.ljust(max(1, -(-len(plain) // 192)) * 192, b" ")
        assert media.read_wav(bytes(x.media)) == payload and x.n_bytes == len(plain) and x.payload_bytes == len(payload)
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.tail_crc32 == zlib.crc32(payload[-16:])
        assert x.media_sha256 == hashlib.sha256(x.media).hexdigest() and x.media_bytes == len(x.media)


def test_media_is_carved_and_types_corrected(spark):
    def png():
        chunk = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", "b")
    parts = [("audio/wav", media.wav(b"hello")), ("application/gzip", gzip.compress(b"abc")), ("image/png", png()), ("application/zip", held.getvalue())]
    raw = b"xx" + b"BM junk".join(p for _, p in parts)
    rows = [(1, raw, "image/png"), (2, png(), "image/jpeg"), (3, png(), "image/png"), (4, None, None), (5, png()[:-1], "image/png"), (6, b"RIFF", "audio/wav")]
    got = {r.id: r for r in media.corrected(spark.createDataFrame(rows, "id long, content binary, declared string")).collect()}
    assert [(c.type, bytes(c.content)) for c in got[1].carved] == parts and got[1].actual is None
    assert (got[2].actual, got[2].matches, got[3].matches) == ("image/png", False, True)
    assert not any(got[i].actual or got[i].carved for i in (4, 5, 6))


def flac(samples, stated=True):
    """One frame of 8-bit mono, and one of constant left and Rice-coded side, each of the number of samples given."""

    def crc(data, poly, width):
        x = 0
        for byte in data:
            x ^= byte << (width - 8)
            for _ in range(8):
                x = (x << 1 ^ (poly if x >> (width - 1) else 0)) & ((1 << width) - 1)
        return x.to_bytes(width // 8, "big")

    def frame(number, n, channels, bits):
        head = bytes([0xFF, 0xF8, 0x60, channels << 4 | 2, number, n - 1])
        head += crc(head, 7, 8)
        body = head + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        return body + crc(body, 0x8005, 16)

    n = len(samples)
    verbatim = "00000010" + "".join(f"{x:08b}" for x in samples)
    constant = "00000000" + f"{7:08b}"
    rice = "00010010" + f"{3:09b}" + "00" + "0000" + "0010" + "".join("0" * (x % 5) + "1" + f"{x % 4:02b}" for x in samples[1:])
    info = bytes([0, n, 0, n]) + bytes(6) + (8000 << 44 | 7 << 36 | (2 * n if stated else 0)).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\0\0\x22" + info + frame(0, n, 0, verbatim) + frame(1, n, 8, constant + rice)


def test_media_ends_where_the_item_ends():
    def pdf(body, updates=0):
        raw = b"%PDF-1.4\n1 0 obj\n<</A (" + body + b")>>\nendobj\n"
        for _ in range(updates + 1):
            raw += b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(raw)
        return raw

    def packed(name, method=zipfile.ZIP_STORED, data=b"text"):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", method) as z:
            z.writestr(name, data)
            z.writestr("second", b"more")
        return held.getvalue()

    one, other = flac(bytes(range(90))), flac(bytes(range(40, 170)), stated=False)
    for kind, parts in [("application/zip", [packed("a"), packed("bc", zipfile.ZIP_DEFLATED), packed("a")]), ("application/pdf", [pdf(b"x"), pdf(b"y", 2), pdf(b"x")]), ("audio/flac", [one, other, one])]:
        for junk in (b"", b"-- junk --"):
            raw = junk + junk.join(parts) + junk
            assert [(t, raw[a:b]) for t, a, b in media.sniff(raw)] == [(kind, p) for p in parts]
    outer = packed("in.zip", data=packed("a"))
    assert [(t, outer[a:b]) for t, a, b in media.sniff(outer)] == [("application/zip", outer), ("application/zip", packed("a"))]
    assert media.sniff(one[:-1]) == [] and media.sniff(pdf(b"x").replace(b"startxref\n", b"startxref\n9"))[0][0] == "application/pdf"


# 10. exact dedup


def test_fuse_filter_has_no_false_negatives():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = r.integers(0, 1 << 63, n, dtype=np.uint64)
        made = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(np.concatenate([keys, keys])).to_bytes())
        assert made.holds(keys).all()
        assert made.holds(r.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01


@pytest.mark.parametrize("digest_hex", [64, 2])
def test_exact_dedup_equals_grouping(spark, digest_hex):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("ab \t\n") for _ in range(r.randint(0, 7)))) for i in range(600)] + [(-1, None)]
    got = exact_dedup.exact_dedup(*exact_dedup.halves(spark.createDataFrame(rows, "doc_id long, text string")), digest_hex=digest_hex, bucket_keys=50).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    plain = {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    assert {x.doc_id: (x.keep_id, x.group_size, x.text_sha256) for x in got} == plain
    assert all(x.kept == (x.doc_id == x.keep_id) for x in got)
