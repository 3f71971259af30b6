"""Phrases of several words that belong together, by level-wise passes.

Pass k counts phrases of k words, but only those whose first and whose last k - 1 words are frequent themselves. The frequent
phrases of each level stand in a table; which they are goes to every task as a bit table of bounded size. A bit too many lets a phrase be counted
that can't be frequent, and the exact count drops it, so the results don't depend on the bit table. Cuts are scored by joins of the level tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, shingles

#: Blanks part words, breaks part pieces.
_BLANK = [0x20, 0x09]
_BREAK = [*b".,;:!?", *range(0x0A, 0x0E)]
_IS_BREAK, _IS_APART = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[_BREAK] = True
_IS_APART[_BLANK + _BREAK] = True
#: Bits of the table for each frequent phrase, and bits at most: 128 MB. Beyond some hundreds of millions of frequent phrases a level the table rules out less.
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 30
#: Texts taken together, in bytes.
RUN_BYTES = 1 << 21
#: A language's candidates are ranked in so many parts before its best ones are ranked together.
PARTS = 128
#: Products go to 38 digits.
SCORE = "(cast(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(34,0)) * 1000) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))"


class _Run:
    """The words of a run of texts: where they are, which follow each other within a piece, and their hashes by language."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, langs: np.ndarray):
        self.s, self.e = shingles.spans(raw, at, _IS_APART)
        doc = np.searchsorted(at, self.s, "right") - 1
        piece = np.cumsum(_IS_BREAK[raw])[self.s] if len(self.s) else self.s
        self.follows = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        self.langs, self.raw = langs[doc], raw
        sizes = self.e - self.s + 2  # each word with a blank behind it
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        inner = np.arange(int(self.begins[-1])) + np.repeat(self.s - self.begins[:-1], sizes)
        self.clean = shingles._LOWER[raw[np.minimum(inner, len(raw) - 1)]]
        self.clean[self.begins[1:] - 1] = 0x20

    def within(self, k: int) -> np.ndarray:
        """Whether k words from each one on stand in one piece."""
        n = max(0, len(self.s) - k + 1)
        return reduce(np.logical_and, [self.follows[j : j + n] for j in range(k - 1)], np.ones(n, bool))

    def hashes(self, k: int, seeds: np.ndarray) -> np.ndarray:
        n = max(0, len(self.s) - k + 1)
        words = shingles.hashed(self.raw, self.s, self.e) if n else np.zeros(0, np.uint64)
        x = seeds[self.langs[:n]]
        for j in range(k):
            x = shingles.mixed(x * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
        return x

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from each of ``at`` on, in lower case, single blanks between words."""
        first, sizes = self.begins[at], self.begins[at + k] - 1 - self.begins[at]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.clean[take]))


def _bits_of(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a phrase in a table of ``size`` bits."""
    mask = np.uint64(size - 1)
    return (x & mask).astype(np.int64), ((x >> np.uint64(32)) & mask).astype(np.int64)


def _seeds(langs: pa.Array) -> np.ndarray:
    return np.array([shingles.xxhash.xxh3_64_intdigest(v.encode()) for v in langs.to_pylist()], np.uint64)


def _counts(k: int, table):
    """``lang, phrase, f`` of every run of texts: its phrases of k words, those alone that the table of the level before allows. Words come with their number, without phrase."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                coded = batch["lang"].dictionary_encode()
                names, codes, seeds = coded.dictionary, coded.indices.to_numpy(), _seeds(coded.dictionary)
                for row, raw, at in shingles.pieces(batch["text"], RUN_BYTES):
                    if not len(raw):
                        continue
                    words = _Run(raw, at, codes[row : row + len(at) - 1])
                    go = words.within(k)
                    if k > 1:
                        bits = np.frombuffer(table.value, np.uint8)
                        one, two = _bits_of(words.hashes(k - 1, seeds), len(bits) * 8)
                        known = ((bits[one >> 3] >> (one & 7)) & (bits[two >> 3] >> (two & 7)) & 1).astype(bool)
                        go &= known[:-1] & known[1:]
                    places = np.flatnonzero(go)
                    for lang in np.unique(words.langs[places]):
                        mine = places[words.langs[places] == lang]
                        found = pc.value_counts(words.phrases(mine, k))
                        phrase, f = found.field("values").cast(pa.string()), found.field("counts")
                        if k == 1:
                            phrase, f = pa.concat_arrays([phrase, pa.nulls(1, pa.string())]), pa.concat_arrays([f, pa.array([len(mine)], pa.int64())])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(f), lang))), phrase, f], names=["lang", "phrase", "f"])

    return run


def _bit_table(frequent: DataFrame, k: int):
    """A broadcast of the bits of the frequent phrases of k words, at most MOST_BITS of them. Bits are put together by words of 64, before and after the shuffle."""
    spark = frequent.sparkSession
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS * frequent.count()):
        size *= 2

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                coded = batch["lang"].dictionary_encode()
                codes, seeds = coded.indices.to_numpy(), _seeds(coded.dictionary)
                for row, raw, at in shingles.pieces(batch["phrase"], RUN_BYTES):
                    words = _Run(raw, at, codes[row : row + len(at) - 1])
                    x = words.hashes(k, seeds)[words.within(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits_of(x, size)))], names=["bit"])

    places = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast(table.tobytes())


def _inner(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def mined(docs: DataFrame, most_words: int = 5, least: int = 100, percent: int = 100, keep: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``keep`` best phrases of 2 to ``most_words`` words that occur ``least`` times or more.

    ``docs(text, lang)``: A-Z are lowered, texts are split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. All counts are of a
    language (null: ``und``), exact and over whole texts, overlapping occurrences included. A phrase of frequency a, cut after its first words into parts of
    frequencies l and r, scores floor(1000 * a * n / (l * r)) with n the number of all words; its lowest cut counts, of equal ones the first. Phrases that lie in a longer
    one with at least ``percent`` % of their frequency go. Order: score, then a, both descending, then the phrase by bytes.

    Null, empty and blank texts have no words. Repeated rows count each time; very long texts are runs of their own. No rows give none. Other columns, whatever their
    names, are ignored. A phrase is counted within each run of texts, then by Spark, before and after the shuffle, so that a hot one is a row for each run.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), common.text_of().alias("text"))
    levels, table, totals = [], None, None
    for k in range(1, most_words + 1):
        counted = texts.mapInArrow(_counts(k, table), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        frequent = common.written(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), f"level{k}")
        if k == 1:
            totals = frequent.where("phrase is null").select("lang", F.col("f").alias("n"))
            frequent = frequent.where("phrase is not null")
        levels.append(frequent.withColumn("k", F.lit(k)))
        if k < most_words:
            table = _bit_table(frequent, k)
    known = reduce(DataFrame.unionAll, levels)
    found = known.where("k > 1").withColumn("words", F.split("phrase", " "))
    inner = found.where("k > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(_inner(F.col("words"), F.lit(1), F.col("k") - 1), _inner(F.col("words"), F.lit(2), F.col("k") - 1))).alias("phrase"))
    # a longer phrase that is frequent enough has one of one word more in it that is so, too
    longer = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = found.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {percent} * f").drop("longer")
    cut = F.col("cut")
    cuts = alone.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", _inner(F.col("words"), F.lit(1), cut).alias("head"), _inner(F.col("words"), cut + 1, F.col("k") - cut).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    scored = cuts.withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")

    def first(rows: DataFrame, *by) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)

    parted = first(best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part")
    return first(parted.drop("rank", "part"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir):
    return mined(common.documents(spark, sf_dir))


OP11_SQL = r"""WITH w AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents WHERE text IS NOT NULL)),
t AS (SELECT lang, p, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, word AS g1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5 FROM t WINDOW o AS (PARTITION BY p ORDER BY i)),
e AS (SELECT lang, 1 AS k, g1 AS phrase FROM g UNION ALL SELECT lang, 2, concat_ws(' ', g1, w2) FROM g WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, concat_ws(' ', g1, w2, w3) FROM g WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, concat_ws(' ', g1, w2, w3, w4) FROM g WHERE w4 IS NOT NULL UNION ALL SELECT lang, 5, concat_ws(' ', g1, w2, w3, w4, w5) FROM g WHERE w5 IS NOT NULL),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM e GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a FROM f x WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.k > x.k AND contains(concat(' ', y.phrase, ' '), concat(' ', x.phrase, ' ')) AND 100 * y.f >= 100 * x.f)),
s AS (SELECT c.lang, c.phrase, a, cut, lf.f AS l, rf.f AS r, n, CAST((1000::HUGEINT * a * n) // (lf.f::HUGEINT * rf.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(string_split(c.phrase, ' ')[:cut], ' ') JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000"""
