"""Toxicity by a learned lexicon, matched through Levenshtein automata, and the context of each hit.

Terms that mark toxic texts are learned from labels. They form a trie; its intersection with the Levenshtein
automaton of each term is one automaton that is built as far as words need it, and accepts misspelled terms.
Stems match all that begins like them, misspelled too. Words glued by punctuation are taken apart. Hits
weigh less in quotation or report and more in address; the sum goes through a fitted logistic curve.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Signs that stand for letters in disguised words.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
EDGE = " \t\r\n.,;:!?\"'()[]{}<>«»„“”‘’*_#&%|/\\-"
_INNER = re.compile("[" + re.escape(EDGE) + "]+")
#: Words that report what others said, and words of address, in the four languages of the corpus.
REPORT = frozenset("said says wrote called quote quoted quoting sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())
ADDRESS = frozenset("you your you're u du dein deine ihr euch tu toi ton vous votre tú eres usted vosotros".split())
QUOTES = "\"“”„«»"


@dataclass
class Lexicon:
    """``terms``: (term, weight, stem); a stem also takes all that begins with it. ``known``: words never taken for a misspelled term."""

    terms: list[tuple[str, float, bool]]
    known: frozenset[str] = frozenset()
    intercept: float = -4.0
    slope: float = 1.0


def edits(term: str, stem: bool = False) -> int:
    """Misspellings allowed for a term: none for short ones, where other words are near; a stem has to be a letter longer for as many."""
    n = len(term) - stem
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Trie and Levenshtein automaton in one, made deterministic state by state as words come.

    A place is ``(trie node, edits)``; behind a whole stem it is ``(-1 - term, edits)``, which stays.
    """

    def __init__(self, lexicon: Lexicon):
        self.child: list[dict[str, int]] = [{}]
        self.at: list[list[int]] = [[]]
        most = [0]
        for index, (term, _, stem) in enumerate(lexicon.terms):
            node, path = 0, [0]
            for c in term:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = len(self.child)
                    self.child.append({}), self.at.append([]), most.append(0)
                    self.child[node][c] = nxt
                node = nxt
                path.append(node)
            self.at[node].append(index)
            for x in path:
                most[x] = max(most[x], edits(term, stem))
        self.most, self.weights = most, [t[1] for t in lexicon.terms]
        self.is_stem = [t[2] for t in lexicon.terms]
        self.allowed = [edits(t[0], t[2]) for t in lexicon.terms]
        self.known = lexicon.known
        self.next: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.accepts: list[tuple[int, int] | None] = []
        self.memo: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """The state of these places, with what letters left out reach."""
        todo, all_places = list(places), set(places)
        while todo:
            node, e = todo.pop()
            if node < 0:
                continue
            reached = [(nxt, e + 1) for nxt in self.child[node].values() if e + 1 <= self.most[nxt]]
            reached += [(-1 - i, e) for i in self.at[node] if self.is_stem[i] and e <= self.allowed[i]]
            for place in reached:
                if place not in all_places:
                    all_places.add(place)
                    todo.append(place)
        key = frozenset(all_places)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            hits = []
            for node, e in key:
                if node < 0:
                    hits.append((e, -node - 1))
                else:
                    hits += [(e, i) for i in self.at[node] if e <= self.allowed[i]]
            self.accepts.append(min(hits, key=lambda h: (h[0], -self.weights[h[1]], h[1])) if hits else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if node < 0:
                out.add((node, e))
                continue
            for letter, nxt in self.child[node].items():
                if letter == c:
                    out.add((nxt, e))
                elif e + 1 <= self.most[nxt]:
                    out.add((nxt, e + 1))
            if e + 1 <= self.most[node]:
                out.add((node, e + 1))
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """``(edits, term)`` of the nearest term that the whole word may mean."""
        state = self.start
        for c in word:
            nxt = self.next.get((state, c))
            if nxt is None:
                nxt = self._step(state, c)
                if len(self.next) < 1_000_000:  # a bound of what is kept, not of what is found
                    self.next[state, c] = nxt
            state = nxt
            if not self.states[state]:
                return None
        return self.accepts[state]

    def _plain(self, word: str) -> tuple[int, int] | None:
        if len(word) < 3:
            return None
        found = self.match(word)
        if found is None and not word.isalpha():
            found = self.match(word.translate(LOOKALIKE))
            found = found and (max(1, found[0]), found[1])
        return None if found and found[0] and word in self.known else found

    def find(self, raw: str) -> tuple[int, int] | None:
        """The same for a word as it stands in a lower-case text, whatever its length; answers are kept, within bounds."""
        if raw in self.memo:
            return self.memo[raw]
        word = raw.strip(EDGE)
        found = self._plain(word)
        if found is None and (parts := _INNER.split(word))[1:]:
            found = min((hit for part in parts if (hit := self._plain(part))), key=lambda h: (h[0], -self.weights[h[1]], h[1]), default=None)
        if len(raw) <= 64:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[raw] = found
        return found


def evidence(text: str, automaton: Automaton, window: int = 6) -> tuple[float, int, list[tuple[int, str, int, float]]]:
    """``(sum, hits, [(word number, word, term, weight)])`` of a text."""
    low = text.lower()
    if not any(automaton.find(w) for w in set(low.split())):
        return 0.0, 0, []
    words, hits, inside, count = low.split(), [], False, {}
    quoted = []
    for w in words:
        marks = sum(w.count(q) for q in QUOTES)
        quoted.append(inside or marks > 0)
        inside ^= marks % 2 == 1
    for i, w in enumerate(words):
        found = automaton.find(w)
        if not found:
            continue
        e, term = found
        near = {x.strip(EDGE) for x in words[max(0, i - window) : i + window + 1]}
        weight = automaton.weights[term] * (1.0, 0.6, 0.4)[e]
        if quoted[i] and near & REPORT:
            weight *= 0.3
        elif near & ADDRESS:
            weight *= 1.2
        # the same word over and over says little more
        count[w] = count.get(w, 0) + 1
        hits.append((i, w, term, weight / count[w]))
    return sum(h[3] for h in hits), len(hits), hits


@dataclass
class Settings:
    """Training takes at most ``toxic_rows`` and ``clean_rows`` labelled texts, those with the least hashes of their ids; all that is kept on the driver is of these."""

    toxic_rows: int = 3000
    clean_rows: int = 6000
    support: int = 3
    ratio: float = 8.0
    cover: int = 3
    stems: tuple[int, ...] = field(default=(4, 5, 6, 7))


def _terms(text: str, settings: Settings) -> set[str]:
    out = set()
    for w in {part for word in set(text.lower().split()) for part in _INNER.split(word)}:
        if len(w) > 2 and w.isalpha():
            out.add(w)
            out.update(w[:n] + "*" for n in settings.stems if len(w) > n)
    return out


def sample_rows(labels: DataFrame, settings: Settings) -> list[tuple[int, int]]:
    each = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("o", F.xxhash64("doc_id"))
    take = each.where("toxic = 1").orderBy("o").limit(settings.toxic_rows).unionAll(each.where("toxic <> 1").orderBy("o").limit(settings.clean_rows))
    return [(r["doc_id"], int(r["toxic"] == 1)) for r in take.select("doc_id", "toxic").collect()]


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Lexicon:
    """A lexicon from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; without toxic or without clean rows an empty one.

    Rows with null ids, null labels or null texts teach nothing or count as empty; a row that repeats an id counts once, as toxic if any of its labels says so,
    and of labelled rows with equal hashes any may be taken. Very long texts are read whole. No rows, or labels of one kind, give the empty lexicon.
    Terms are words, and stems marked by a star. Those that toxic texts have far more often are chosen one by one, each time the one
    that most toxic texts lack so far, until each has ``cover`` of them; so words that merely stand in copies of a
    toxic text find no place; of equals the one rarer in clean texts, longer, later in the alphabet. Copies count once. Short terms (under
    five letters, stems under six) are found only as they are spelled.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    rows = sample_rows(labels, settings)
    empty = Lexicon([], intercept=-3.0)
    if not rows:
        return empty
    picked = spark.createDataFrame(rows, "doc_id long, toxic int")
    texts = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "training")  # the sample is bounded

    def words(batches):
        for batch in batches:
            term, toxic = [], []
            for text, flag in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = _terms(text, settings)
                term += found
                toxic += [flag] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(toxic, pa.int64())], names=["term", "toxic"])

    sizes = {int(r["toxic"]): r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a_all, b_all = sizes.get(1, 0), sizes.get(0, 0)
    if not a_all or not b_all:
        return empty
    counts = texts.mapInArrow(words, "term string, toxic long").groupBy("term").agg(F.sum("toxic").cast("long").alias("a"), F.sum(1 - F.col("toxic")).cast("long").alias("b"))
    lift = (F.col("a") + 0.5) / (a_all + 1) / ((F.col("b") + 0.5) / (b_all + 1))
    good = counts.where(F.col("a") >= settings.support).withColumn("lift", lift).where(F.col("lift") >= settings.ratio)
    chosen = good.orderBy(F.desc("a"), "b", F.desc(F.length("term")), "term").collect()  # words of the bounded sample
    number = {r["term"]: i for i, r in enumerate(chosen)}

    def members(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([sorted(number[t] for t in _terms(x, settings) if t in number) for x in batch["text"].to_pylist()], pa.list_(pa.int32()))], names=["toxic", "has"])

    has = [(r["toxic"], r["has"]) for r in texts.where("toxic = 1").mapInArrow(members, "toxic int, has array<int>").collect()]
    need = np.full(len(has), settings.cover)
    inside = [[] for _ in chosen]
    for i, (_, terms) in enumerate(has):
        for t in terms:
            inside[t].append(i)
    inside = [np.array(x, np.int64) for x in inside]
    by_prefix: dict[str, list[int]] = {}
    for k, row in enumerate(chosen):
        for n in settings.stems:
            by_prefix.setdefault(row["term"].rstrip("*")[:n], []).append(k)

    def key(k: int, gain: int):
        return -gain, chosen[k]["b"], -len(chosen[k]["term"]), [-ord(c) for c in chosen[k]["term"]]

    # what a term adds only shrinks, so its last known gain is a bound: the first whose gain holds is the best
    queue = [(key(k, len(x)), k) for k, x in enumerate(inside)]
    heapq.heapify(queue)
    terms: dict[tuple[str, bool], float] = {}
    while queue:
        known, k = heapq.heappop(queue)
        gain = int((need[inside[k]] > 0).sum()) if len(inside[k]) else 0
        if key(k, gain) != known:
            if gain >= settings.support:
                heapq.heappush(queue, (key(k, gain), k))
            continue
        if gain < settings.support:
            break
        need[inside[k]] -= 1
        row, bare = chosen[k], chosen[k]["term"].rstrip("*")
        stem = row["term"].endswith("*")
        terms[bare, stem] = math.log(row["lift"])
        inside[k] = np.zeros(0, np.int64)
        # words and stems that begin alike find the same texts: one of them is enough. A stem's words stay beside it, to be found misspelled
        for other in {x for n in settings.stems for x in by_prefix.get(bare[:n], ())}:
            its = chosen[other]["term"].rstrip("*")
            its_stem = chosen[other]["term"].endswith("*")
            if its_stem and bare.startswith(its) or stem and its.startswith(bare):
                inside[other] = np.zeros(0, np.int64)
                if stem and not its_stem and edits(its):
                    terms.setdefault((its, False), math.log(row["lift"]))
    terms = [(t, weight, stem) for (t, stem), weight in terms.items()]
    # what is spelled almost like a term but stands in clean texts is another word
    lexicon = Lexicon(terms)

    def near(batches):
        own = Automaton(lexicon)
        for batch in batches:
            found = [part for x in batch["text"].to_pylist() for w in set(x.lower().split()) if own.find(w) for part in {w.strip(EDGE), *_INNER.split(w)} if (m := own._plain(part)) and m[0]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    lexicon.known = frozenset(r["word"] for r in texts.where("toxic = 0").select("text").mapInArrow(near, "word string").groupBy("word").count().where("count > 1").select("word").collect())  # words of the bounded sample

    def sums(batches):
        own = Automaton(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([evidence(x, own)[0] for x in batch["text"].to_pylist()], pa.float64())], names=["toxic", "x"])

    got = texts.select("text", "toxic").mapInArrow(sums, "toxic int, x double").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    lexicon.intercept, lexicon.slope = _logistic(x, y)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a ridge that keeps separable data finite."""
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.diag([1e-3, 1.0]), a.T @ (y - p) - ridge * np.array([1e-3, 1.0]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and ``n_hits``. Null and empty texts have the score of no evidence.

    Every row is scored alone, so repeated rows score alike and very long texts are read whole. No rows give none. Other columns stay, but for ones of these names.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(lexicon)  # words of the bounded training sample
    docs = docs.drop("score", "predicted", "n_hits")

    def run(batches):
        model = held.value
        own = Automaton(model)
        for batch in batches:
            got = [evidence(x or "", own) for x in batch["text"].to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * np.array([g[0] for g in got], float), -30, 30)))
            columns = [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32()), pa.array([g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted", "n_hits"])

    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.LongType())])
    return docs.mapInArrow(run, out)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op2_toxicity(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits")
