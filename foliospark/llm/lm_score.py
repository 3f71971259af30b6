"""Cross-entropy difference of two n-gram models: how much more a text is like the target than like the background.

Tokens are words. Both models share one vocabulary, the words and the pairs of neighbouring words that the target has at least
twice, with exact counts of all texts. A word's chance after another is half the pair's share of the first word's counts; the other
half, and what the first word's pairs leave over, goes by the word alone: half its share of the counts and half its
spelling by a model of four bytes, which also spells what is outside the vocabulary, so both models give every text a chance. Counts of the
spelling background are scaled to the target's total, which matches what smoothing does in both without leaving out a row.

Words and pairs above a fixed share of all tokens, of which there can be only so many, are sent to all tasks. All others are too rare
to be a hot key: their occurrences meet the counts in a join, and their tables grow with the corpus. A bit table of bounded size tells
what can't be in the vocabulary and needs no join; a bit too many sends an occurrence to the join in vain, and the result stays the same.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import _MIX, mixed, pieces, spans, words
from .toxicity import held_out

#: Cells of hashed counts of four bytes, and of their first three: bounds of the spelling models' size.
GRAMS, HEADS = 1 << 21, 1 << 20
PAIRS = 1 << 16
MODELS = ("background", "target")
#: Words of at least 1 / HEAVY of all tokens are heavy, so there are at most HEAVY of them.
HEAVY = 1 << 20
#: Pairs of at least 1 / HEAVY_PAIRS of all tokens are heavy; no more than HEAVY, so that both words are heavy too.
HEAVY_PAIRS = 1 << 19
#: Bits of the table for each word or pair of the vocabulary, and bits at most: 64 MB. With more than some 100 million of them more rows are joined in vain.
BITS, MOST_BITS = 16, 1 << 29
#: The bit table is put together in chunks of so many words of 64 bits.
BIT_CHUNK = 1 << 12
#: Words and pairs that a task counts before it hands counts on.
HELD_WORDS = 1 << 21
#: The same of pairs, which come beside words or with their first words.
HELD_PAIRS = 1 << 20
#: Factors of a pair's words in its hash.
FIRST, SECOND = np.uint64(0xE7037ED1A0B428DB), np.uint64(0xA0761D6478BD642F)
#: Of texts: ``kind`` is a table of cells, or ``word``, or ``target pair`` with the pair's hash in ``word``.
COUNTED = "model int, kind string, chunk int, cells binary, word long, n long, t long"
COUNTED_SCHEMA = pa.schema([("model", pa.int32()), ("kind", pa.string()), ("chunk", pa.int32()), ("cells", pa.binary()), ("word", pa.int64()), ("n", pa.int64()), ("t", pa.int64())])


def _pairs(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of neighbouring words of one text, and where the second word of each stands."""
    second = np.ones(len(hashes), bool)
    second[start[:-1][start[:-1] < len(hashes)]] = False  # the first word of each text
    at = np.flatnonzero(second)
    a = hashes[at - 1]
    return mixed((a ^ (a >> np.uint64(31))) * FIRST + hashes[at] * SECOND), at


def _second(pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The second words of pairs' hashes, whose first words are known: each step of ``_pairs`` can be undone."""
    one, two, last = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_MIX[0], _MIX[1], SECOND))
    pair, a = pair.view(np.uint64), first.view(np.uint64)
    x = (pair ^ (pair >> np.uint64(32))) * two
    x = (x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))) * one
    return ((x ^ (x >> np.uint64(32))) - (a ^ (a >> np.uint64(31))) * FIRST) * last


def _cells(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte: the text it is in, and its cells among four bytes, heads and pairs. Three blanks stand before each text."""
    sizes = np.diff(at)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(raw)) - at[row]
    code = raw.astype(np.uint32)
    before = []
    for k in (1, 2, 3):
        x = np.full(len(raw), 32, np.uint32)
        x[k:] = code[:-k]
        x[place < k] = 32
        before.append(x)
    head = before[0] | (before[1] << np.uint32(8)) | (before[2] << np.uint32(16))
    mixed = (head * np.uint32(0x9E3779B1)) ^ (head >> np.uint32(7))
    four = (mixed ^ (code * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    return row, (four >> np.uint32(11)).astype(np.int64), (mixed >> np.uint32(12)).astype(np.int64), ((before[0] << np.uint32(8)) | code).astype(np.int64)


class _Tally:
    """Counts of words, of all texts and of the target's, or of pairs, within bounded memory; what is carried comes along with each."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, hashes: np.ndarray, mine: np.ndarray | None = None, carried: np.ndarray | None = None) -> None:
        self.hold(hashes, [None] if mine is None else [None, mine], carried)
        if self.size > self.most and len(self.parts) > 1:
            self.merge()

    def hold(self, key: np.ndarray, weights: list, carried: np.ndarray | None) -> None:
        found, *one, at = np.unique(key, return_index=carried is not None, return_inverse=True)
        self.parts.append((found, [np.bincount(at, w, len(found)).astype(np.int64) for w in weights], carried if carried is None else carried[one[0]]))
        self.size += len(found)

    def merge(self) -> None:
        keys, sums, carried = zip(*self.parts, strict=True)
        self.parts, self.size = [], 0
        self.hold(np.concatenate(keys), [np.concatenate(x) for x in zip(*sums, strict=True)], None if carried[0] is None else np.concatenate(carried))

    def taken(self, over: int = 0):
        """What is counted so far in slices, and forgotten here, once merged parts hold more than ``over`` words or pairs."""
        if not self.parts or self.size <= over:
            return
        self.merge()
        if self.size > over:
            (key, sums, carried), self.parts, self.size = self.parts[0], [], 0
            for k in range(0, len(key), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield [pa.array(x[part].view(np.int64)) for x in (key, *sums, *([] if carried is None else [carried]))]

    def rows(self, kind: str, over: int = 0):
        for word, *sums in self.taken(over):
            none = pa.nulls(len(word))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), pa.array([kind] * len(word)), none.cast(pa.int32()), none.cast(pa.binary()), word, sums[0], sums[-1]], schema=COUNTED_SCHEMA)


def _chunks(model: int, name: str, table: np.ndarray):
    for chunk, cells in common.packed(table):
        yield pa.RecordBatch.from_pylist([{"model": model, "kind": name, "chunk": chunk, "cells": cells}], COUNTED_SCHEMA)


def counts(docs: DataFrame) -> DataFrame:
    """Counts of each task of ``docs(text, is_target)``: of n-grams of bytes, packed in chunks, of words, and of the target's pairs."""
    layout = (("four", GRAMS), ("head", HEADS), ("pair", PAIRS))

    def run(batches):
        total = [{name: np.zeros(size, np.int64) for name, size in layout} for _ in MODELS]
        tally, pairs = _Tally(HELD_WORDS), _Tally(HELD_PAIRS)
        with np.errstate(over="ignore"):
            for batch in batches:
                target = np.array(batch["is_target"].to_pylist(), bool)
                for first, raw, at in pieces(batch["text"], 1 << 20):
                    row, *cells = _cells(raw, at)
                    mine = target[first + row]
                    for (name, size), cell in zip(layout, cells, strict=True):
                        total[0][name] += np.bincount(cell, minlength=size)
                        if mine.any():
                            total[1][name] += np.bincount(cell[mine], minlength=size)
                    hashes, start = words(raw, at)
                    is_mine = np.repeat(target[first : first + len(at) - 1], np.diff(start))
                    tally.add(hashes, is_mine)
                    pair, place = _pairs(hashes, start)
                    pairs.add(pair[is_mine[place]])
                    yield from tally.rows("word", HELD_WORDS)
                    yield from pairs.rows("target pair", HELD_PAIRS)
        yield from tally.rows("word")
        yield from pairs.rows("target pair")
        for model, tables in enumerate(total):
            for name, table in tables.items():
                yield from _chunks(model, name, table)

    return docs.mapInArrow(run, COUNTED)


def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a table of ``size`` bits, a power of two."""
    hashes = hashes.view(np.uint64)
    return (hashes & np.uint64(size - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def _may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _places(hashes, len(bits) * 8)
    return ((bits[one >> 3] >> (one & 7)) & (bits[two >> 3] >> (two & 7)) & 1).astype(bool)


def _bit_table(keys: DataFrame) -> np.ndarray:
    """The bits of all ``keys(word)``. They are put together by words of 64, before and after the shuffle, and then by chunks."""
    size = 1 << 12
    while size < min(MOST_BITS, BITS * keys.count()):
        size *= 2

    def run(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(batch["word"].to_numpy(), size)))], names=["bit"])

    def packs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(min(BIT_CHUNK, size // 64), np.int64)
        for batch in batches:
            cells[batch["at"].to_numpy() % BIT_CHUNK] = batch["bits"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([cells.astype("<i8").tobytes()], pa.binary())], names=["chunk", "cells"])

    sixty_four = keys.mapInArrow(run, "bit long").groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    table = np.zeros(size // 8, np.uint8)
    for r in sixty_four.withColumn("chunk", F.expr(f"at div {BIT_CHUNK}")).groupBy("chunk").applyInArrow(packs, "chunk long, cells binary").collect():
        table[r["chunk"] * BIT_CHUNK * 8 :][: len(r["cells"])] = np.frombuffer(r["cells"], np.uint8)
    return table


def _paired(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(word, first, n)``: counts in all texts of each pair that ``bits`` may hold, and its first word."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # at most MOST_BITS

    def run(batches):
        tally = _Tally(HELD_PAIRS)

        def rows(over: int = 0):
            for pair, n, first in tally.taken(over):
                yield pa.RecordBatch.from_arrays([pair, first, n], names=["word", "first", "n"])

        with np.errstate(over="ignore"):
            for batch in batches:
                for _, raw, at in pieces(batch["text"]):
                    hashes, start = words(raw, at)
                    pair, place = _pairs(hashes, start)
                    may = _may_hold(held.value, pair)
                    tally.add(pair[may], None, hashes[place[may] - 1])
                    yield from rows(HELD_PAIRS)
        yield from rows()

    found = docs.select("text").mapInArrow(run, "word long, first long, n long")
    return found.groupBy("word").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def _filled(counted: DataFrame, tables: dict[tuple[int, str], np.ndarray]) -> None:
    """Puts the sums of all tasks' cells into ``tables``, whose size is all that reaches the driver."""
    for r in common.added_up(counted.where("cells is not null"), ["model", "kind", "chunk"]).collect():
        tables[r["model"], r["kind"]][r["chunk"] * common.CHUNK : (r["chunk"] + 1) * common.CHUNK] = common.unpacked(r["cells"])


@dataclass
class Models:
    """``spelling``: of both models, of fixed size. ``vocabulary(word, n, t, back_*)``: a table of all words but the heavy ones.

    ``heavy``: the heavy words in order, and their counts by model, 0 where outside the vocabulary. ``pairs``: heavy pairs' hashes in order, their shares of
    the first word's counts by model. ``left``: by model, what the pairs of each heavy word leave over. ``rare``: a table of all other pairs of the vocabulary,
    ``word`` their hash, with half their ``share_*``, the second word's counts and what comes back to it; none where they are left out.
    ``bits``: a table for which of all these a text's words and pairs can be; ``others``: the heavy pairs among those that it can't tell from the vocabulary's.
    """

    spelling: list[dict[str, np.ndarray]]
    vocabulary: DataFrame
    heavy: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    left: np.ndarray
    totals: tuple[float, float]
    spelled: tuple[float, float]
    rare: DataFrame | None
    bits: np.ndarray
    others: np.ndarray


def _facts(rare: DataFrame, vocabulary: DataFrame, heavy: tuple[np.ndarray, np.ndarray], left: np.ndarray) -> DataFrame:
    """``(word, n, t, back_*, share_*)`` of pairs. Counts of heavy words, which are hot keys, are looked up in ``heavy``, those of others joined."""
    held = rare.sparkSession.sparkContext.broadcast((heavy, left))  # at most HEAVY words
    fields = {"word": "long", "n": "long", "t": "long", "first": "long", "second": "long", "n1": "long", "t1": "long", "back_background": "double", "back_target": "double", "n2": "long", "t2": "long"}

    def run(batches):
        (keys, numbers), left = held.value
        for batch in batches:
            first = batch["first"].to_numpy()
            with np.errstate(over="ignore"):
                second = _second(batch["word"].to_numpy(), first).view(np.int64)
            out = [*[batch[c] for c in list(fields)[:4]], pa.array(second)]
            for key, values in ((first, [*numbers, *(0.5 + 0.5 * left)]), (second, numbers)):
                place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                missing = keys[place] != key if len(keys) else np.ones(len(key), bool)
                out += [pa.array(x[place] if len(keys) else np.zeros(len(key), x.dtype), mask=missing) for x in values]
            yield pa.RecordBatch.from_arrays(out, names=list(fields))

    def known(rows: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
        """``rows`` whose ``names`` of a heavy ``key`` are there, and all others with those of the vocabulary."""
        there = F.col(next(iter(names))).isNotNull()
        of = vocabulary.select(F.col("word").alias(key), *[F.col(c).alias(name) for name, c in names.items()])
        return rows.where(there).unionByName(rows.where(~there).drop(*names).join(of.hint("merge"), key))

    backs = {c: c for c in ("back_background", "back_target")}
    both = known(known(rare.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields.items())), "first", {"n1": "n", "t1": "t"} | backs), "second", {"n2": "n", "t2": "t"})
    return both.select("word", F.col("n2").alias("n"), F.col("t2").alias("t"), *backs, (0.5 * F.col("n") / F.col("n1")).alias("share_background"), (0.5 * F.col("t") / F.col("t1")).alias("share_target"))


def models(docs: DataFrame, least: int = 2, rare_pairs: bool = False) -> Models:
    """The two models of ``docs(text, is_target)``; the vocabulary holds words and pairs that the target has ``least`` times.

    ``rare_pairs``: all such pairs. Without it only the heavy ones are in the vocabulary, and scoring joins no pairs.
    """
    counted = common.written(counts(docs), "counts")
    out = [{"four": np.zeros(GRAMS), "head": np.zeros(HEADS), "pair": np.zeros(PAIRS)} for _ in MODELS]
    _filled(counted, {(k, name): table for k, tables in enumerate(out) for name, table in tables.items()})
    scale = out[1]["pair"].sum() / max(1.0, out[0]["pair"].sum())
    ready = []
    for model, factor in zip(out, (scale, 1.0), strict=True):
        pair = model["pair"].reshape(256, 256) * factor
        low = (pair + 0.5) / (pair.sum(1, keepdims=True) + 128)
        ready.append({"four": (model["four"] * factor).astype(np.float32), "head": (model["head"] * factor).astype(np.float32), "low": low.ravel().astype(np.float32)})
    all_words = common.written(counted.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "words")
    known = F.col("t") >= least
    sums = all_words.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in ("n", "t")], *[F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).cast("double") for c in ("n", "t")]).first()
    totals = max(sums[0], 1.0), max(sums[1], 1.0)
    kept = all_words.select("word", F.when(known, F.col("n")).otherwise(0).alias("n"), F.when(known, F.col("t")).otherwise(0).alias("t"), (F.col("n") * HEAVY >= totals[0]).alias("heavy"))
    wanted = common.written(counted.where("kind = 'target pair'").groupBy("word").agg(F.sum("t").alias("t")).where(known), "wanted")
    common.dropped(counted)
    common.release(docs.sparkSession)
    bits = _bit_table(wanted.select("word").unionAll(kept.where("not heavy and t > 0").select("word")))
    found = common.written(_paired(docs, bits).join(wanted.hint("merge"), "word", "left").withColumn("heavy", F.col("n") * HEAVY_PAIRS >= totals[0]), "pairs")
    common.dropped(wanted)
    top_pairs = found.where("heavy").select("word", "first", "n", "t").toArrow().sort_by("word")  # at most HEAVY_PAIRS pairs
    is_known = np.asarray(top_pairs["t"].is_valid())
    others, pairs = top_pairs["word"].to_numpy()[~is_known], top_pairs.filter(pa.array(is_known))
    among = found.where("t is not null") if rare_pairs else found.where("heavy and t is not null")
    lead = among.groupBy(F.col("first").alias("word")).agg(F.sum("n").alias("of_n"), F.sum("t").alias("of_t"))
    over = [(F.lit(1.0) - F.coalesce(F.col(f"of_{c}") / F.when(F.col(c) > 0, F.col(c)), F.lit(0.0))).alias(f"left_{m}") for m, c in zip(MODELS, ("n", "t"), strict=True)]
    all_kept = common.written(kept.where("heavy or t > 0").join(lead.hint("merge"), "word", "left").select("word", "n", "t", "heavy", *over), "vocabulary")
    common.dropped(all_words)
    top = all_kept.where("heavy").drop("heavy").toArrow().sort_by("word")  # at most HEAVY words
    heavy = top["word"].to_numpy(), np.stack([top[c].to_numpy() for c in ("n", "t")])
    left = np.stack([top[f"left_{m}"].to_numpy() for m in MODELS])
    first = np.searchsorted(heavy[0], pairs["first"].to_numpy())
    shares = np.stack([pairs[c].to_numpy() / np.maximum(heavy[1][k][first], 1) for k, c in enumerate(("n", "t"))])
    vocabulary = all_kept.where("not heavy").select("word", "n", "t", *[(0.5 + 0.5 * F.col(f"left_{m}")).alias(f"back_{m}") for m in MODELS])
    rare = None
    if rare_pairs:
        rare = common.written(_facts(found.where("not heavy and t is not null"), vocabulary, heavy, left), "facts")
    common.dropped(found)
    common.release(docs.sparkSession)
    return Models(ready, vocabulary, heavy, (pairs["word"].to_numpy(), shares), left, totals, (1 - 0.5 * sums[2] / totals[0], 1 - 0.5 * sums[3] / totals[1]), rare, bits, others)


#: What texts and facts send: to the share ``part`` of all hashes, or as sums to the documents of ``block``.
SENT = "part long, kind int, block long, packed binary"
SENT_SCHEMA = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("packed", pa.binary())])
#: Kinds of what is sent; in this order a part's facts come before the words and pairs that look them up.
WORD_FACTS, PAIR_FACTS, WORD, FOLLOWED, PAIR, DOCUMENTS, SUMS = range(7)
#: The columns of each kind: of facts the hash, both counts, what comes back and, of pairs, the shares; of words and pairs the hash, the document's place in its block and the
#: spelling's logarithms; of documents the place, the id and whether it is there, the size and both losses.
COLUMNS = {WORD_FACTS: ("<u8", *["<f4"] * 4), PAIR_FACTS: ("<u8", *["<f4"] * 6), DOCUMENTS: ("<u2", "<i8", "u1", "<i8", "<f8", "<f8"), SUMS: ("<u2", "<f4", "<f4")} | dict.fromkeys((WORD, FOLLOWED, PAIR), ("<u8", "<u2", "<f4", "<f4"))
#: Documents of a block; words and pairs, or facts, that a task holds before it sends them; words of the corpus for each part, so that a part's facts fit a task.
BLOCK, HELD, PART_WORDS = 1 << 13, 1 << 20, 1 << 20


def _packed(kind: int, columns: list[np.ndarray]) -> bytes:
    """Columns of one length as bytes, those of equal place side by side. Hashes are in order and kept as steps."""
    out = []
    for dtype, x in zip(COLUMNS[kind], columns, strict=True):
        x = np.diff(x, prepend=x.dtype.type(0)) if dtype == "<u8" else x
        out.append(np.ascontiguousarray(x, dtype).view(np.uint8).reshape(len(x), -1).T.tobytes())
    return len(columns[0]).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(b"".join(out), asbytes=True)


def _columns(kind: int, packed: bytes) -> list[np.ndarray]:
    n, out, at = int.from_bytes(packed[:4], "little"), [], 0
    dtypes = [np.dtype(x) for x in COLUMNS[kind]]
    raw = np.frombuffer(pa.Codec("zstd").decompress(packed[4:], n * sum(d.itemsize for d in dtypes)), np.uint8)
    for d in dtypes:
        x = np.ascontiguousarray(raw[at : at + n * d.itemsize].reshape(d.itemsize, n).T).view(d).ravel()
        out.append(np.cumsum(x, dtype=np.uint64) if d == np.uint64 else x)
        at += n * d.itemsize
    return out


def _sent(part: int, kind: int, block: int, columns: list[np.ndarray]) -> tuple[int, int, int, bytes]:
    return part, kind, block, _packed(kind, columns)


def _rows(sent: Iterator[tuple[int, int, int, bytes]], most: int = 64) -> Iterator[pa.RecordBatch]:
    """What is sent as batches of a few rows, which are large."""
    while some := list(itertools.islice(sent, most)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), SENT_SCHEMA, strict=True)], schema=SENT_SCHEMA)


def _dealt(kind: int, block: int, columns: list[np.ndarray], parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``columns``, of which the first holds hashes, in order of them and cut by parts: the share of a hash is its highest bits."""
    order = np.argsort(columns[0])
    columns = [x[order] for x in columns]
    part = (columns[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield _sent(int(part[a]), kind, block, [x[a:b] for x in columns])


def _facts_sent(facts: DataFrame, kind: int, parts: int) -> DataFrame:
    names = ["n", "t", *[f"back_{m}" for m in MODELS], *[f"share_{m}" for m in MODELS if kind == PAIR_FACTS]]

    def sent(batches):
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append([batch["word"].to_numpy().view(np.uint64), *[batch[c].to_numpy(zero_copy_only=False).astype(np.float32) for c in names]])
                size += len(batch)
            if held and (batch is None or size >= HELD):
                yield from _dealt(kind, -1, [np.concatenate(x) for x in zip(*held, strict=True)], parts)
                held, size = [], 0

    return facts.select("word", *names).mapInArrow(lambda batches: _rows(sent(batches)), SENT)


def _met(sent: DataFrame, totals: tuple[float, float]) -> DataFrame:
    """What words and pairs change of their documents' losses, as sums of a task, and the documents themselves. ``sent`` comes part by part, facts first."""

    def gains(kind: int, facts: list[np.ndarray], key: np.ndarray, spelled: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the words or pairs the facts have, and what each of these adds to both losses."""
        place = np.minimum(np.searchsorted(facts[0], key), max(len(facts[0]) - 1, 0))
        at = np.flatnonzero(facts[0][place] == key) if len(facts[0]) else np.zeros(0, np.int64)
        place, out = place[at], []
        for k, total in enumerate(totals):
            count, back = (facts[c][place].astype(float) for c in (1 + k, 3 + k))
            alone_spelled = spelled[k][at].astype(float)
            alone = np.log(count * (0.5 / total) + np.exp(alone_spelled))
            alone[count <= 0] = alone_spelled[count <= 0]
            if kind == PAIR:
                out.append(-(np.log(facts[5 + k][place] + back * np.exp(alone)) - np.log(back) - alone))
            else:
                out.append(alone_spelled - alone - (np.log(back) if kind == FOLLOWED else 0.0))
        return at, out

    def run(batches):
        part, facts, tally = None, {}, []  # the tally: rows and both sums
        held, size, counted = {}, 0, 0

        def looked_up():
            nonlocal held, size, counted
            for kind, several in held.items():
                of = PAIR_FACTS if kind == PAIR else WORD_FACTS
                if isinstance(facts.get(of), list) and facts[of]:
                    columns = [np.concatenate(x) for x in zip(*facts[of], strict=True)]
                    order = np.argsort(columns[0])
                    facts[of] = tuple(x[order] for x in columns)
                if of in facts and len(facts[of]):
                    row, key, *spelled = (np.concatenate(x) for x in zip(*several, strict=True))
                    at, added = gains(kind, facts[of], key, spelled)
                    tally.append((row[at], *added))
                    counted += len(at)
            held, size = {}, 0

        def summed():
            nonlocal counted, tally
            row, *added = (np.concatenate(x) for x in zip(*tally, strict=True))
            found, at = np.unique(row, return_inverse=True)
            tally, counted = [(found, *[np.bincount(at, x, len(found)) for x in added])], len(found)

        def sums(over: int):
            nonlocal counted, tally
            if tally and counted > over:
                summed()
                if counted > over // 2:
                    (row, *added), tally, counted = tally[0], [], 0
                    cuts = [0, *(np.flatnonzero(np.diff(row // BLOCK)) + 1).tolist(), len(row)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if b > a:
                            yield _sent(0, SUMS, int(row[a]) // BLOCK, [row[a:b] % BLOCK, *[x[a:b] for x in added]])

        for batch in batches:
            for of, kind, block, packed in zip(*[batch[c].to_pylist() for c in ("part", "kind", "block", "packed")], strict=True):
                if of != part:
                    looked_up()
                    yield from sums(HELD)
                    part, facts = of, {}
                if kind == DOCUMENTS:
                    yield of, kind, block, packed
                elif kind in (WORD_FACTS, PAIR_FACTS):
                    facts.setdefault(kind, []).append(_columns(kind, packed))
                else:
                    key, row, *spelled = _columns(kind, packed)
                    held.setdefault(kind, []).append((block * BLOCK + row.astype(np.int64), key, *spelled))
                    size += len(key)
                    if size >= HELD >> 2:
                        looked_up()
                        yield from sums(HELD)
        looked_up()
        yield from sums(0)

    return sent.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(lambda batches: _rows(run(batches)), SENT)


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a block, their losses with all sums."""
    total, documents = np.zeros((2, BLOCK)), []
    for batch in batches:
        for kind, packed in zip(batch["kind"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            row, *columns = _columns(kind, packed)
            if kind == DOCUMENTS:
                documents.append((row, *columns))
            for k in range(2):
                total[k] += np.bincount(row, columns[k - 2], BLOCK)
    for row, doc_id, there, size, *_ in documents:
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=there == 0), pa.array(size), *[pa.array(x[row]) for x in total]], names=["doc_id", "n_tokens", "b", "t"])


def scored(docs: DataFrame, fitted: Models, weight: float = 20.0) -> DataFrame:
    """``doc_id, n_tokens, ce_target, ce_background, ce_difference`` for every row of ``docs(doc_id, text)``, in nats a word.

    The difference is target less background: below zero, a text is more like the target. Null, empty and blank texts have
    no tokens and zeros. Rows that repeat are scored each; other columns are ignored. Rows are numbered where they are read, so a table that
    can come in another order when a lost task runs again, as after a shuffle, is to be written before.
    ``weight``: how many n-grams of bytes the estimate by pairs counts for.
    """
    small = (fitted.spelling, fitted.heavy, fitted.pairs, fitted.left, fitted.totals, fitted.spelled, fitted.bits, fitted.others)
    held = docs.sparkSession.sparkContext.broadcast(small)  # fixed size, and at most HEAVY words, HEAVY_PAIRS pairs and MOST_BITS
    joins_pairs = fitted.rare is not None
    parts = 1
    while parts * PART_WORDS < fitted.totals[0]:
        parts *= 2

    def blocks(batches):
        """Texts by blocks of documents: the block's number, the first one's place in it, ids and texts."""
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            while at < len(batch):
                size = min(len(batch) - at, BLOCK - number % BLOCK)
                yield number // BLOCK, number % BLOCK, batch["doc_id"].slice(at, size), batch["text"].slice(at, size)
                number, at = number + size, at + size

    def run(batches):
        spelling, (keys, numbers), (pairs, shares), left, totals, spelled, bits, others = held.value
        waiting, waits, now = {}, 0, None

        def dealt():
            nonlocal waiting, waits
            for kind, several in waiting.items():
                yield from _dealt(kind, now, [np.concatenate(x) for x in zip(*several, strict=True)], parts)
            waiting, waits = {}, 0

        for block, place_in_block, ids, texts in blocks(batches):
            if block != now:
                yield from dealt()
                now = block
            size = len(texts)
            sums, sizes = np.zeros((2, size)), np.zeros(size, np.int64)
            with np.errstate(over="ignore", divide="ignore"):
                for first, raw, at in pieces(texts):
                    if not len(raw):
                        continue
                    row, four, head, pair = _cells(raw, at)
                    s, e = spans(raw, at)
                    hashes, start = words(raw, at)
                    both, second = _pairs(hashes, start)
                    hashes, both = hashes.view(np.int64), both.view(np.int64)
                    of = np.repeat(np.arange(len(at) - 1), np.diff(start))
                    sizes[first : first + len(at) - 1] = np.diff(start)
                    end = np.minimum(e + 2, at[of + 1])  # the space that ends a word is spelled too
                    place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                    is_heavy = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                    is_rare = ~is_heavy
                    is_rare[is_rare] = _may_hold(bits, hashes[is_rare])
                    # what the word before leaves to the word alone, and the place of the pair where it is known
                    back = np.ones((len(MODELS), len(hashes)))
                    follows = second[is_heavy[second - 1]]
                    back[:, follows] = 0.5 + 0.5 * left[:, place[follows - 1]]
                    known = np.full(len(hashes), -1)
                    if len(pairs):
                        its = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
                        known[second] = np.where(pairs[its] == both, its, -1)
                    logs = []
                    for k, model in enumerate(spelling):
                        p = (model["four"][four] + weight * model["low"][pair]) / (model["head"][head] + weight)
                        upto = np.concatenate([[0.0], np.cumsum(np.log(np.minimum(p, 1.0)), dtype=np.float64)])
                        logs.append(upto[end] - upto[s] + np.log(spelled[k]))
                        counted = numbers[k][place[is_heavy]]
                        alone = np.logaddexp(np.log(0.5 * counted / totals[k]), logs[k][is_heavy])
                        its = known[is_heavy]
                        share = np.where(its >= 0, 0.5 * shares[k][its], 0.0) if len(pairs) else np.zeros(len(its))
                        loss = -np.log(back[k]) - logs[k]  # what a rare word or pair changes of it is added where its facts are
                        loss[is_heavy] = -np.logaddexp(np.log(share), np.log(back[k][is_heavy]) + alone)
                        sums[k, first : first + len(at) - 1] = np.bincount(of, loss, len(at) - 1)
                    followed = np.zeros(len(hashes), bool)
                    followed[second - 1] = True
                    sent = [(kind, np.flatnonzero(x), hashes[x]) for kind, x in ((WORD, is_rare & ~followed), (FOLLOWED, is_rare & followed))]
                    if joins_pairs:
                        may = known[second] < 0
                        may[may] = _may_hold(bits, both[may])
                        may[may] = ~np.isin(both[may], others)
                        sent.append((PAIR, second[may], both[may]))
                    for kind, where, key in sent:
                        if len(where):
                            waiting.setdefault(kind, []).append((key.view(np.uint64), (place_in_block + first + of[where]).astype(np.uint16), *[x[where].astype(np.float32) for x in logs]))
                            waits += len(where)
                    if waits >= HELD:
                        yield from dealt()
            yield _sent(block % parts, DOCUMENTS, block, [place_in_block + np.arange(size), ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()), sizes, *sums])
        yield from dealt()

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(lambda batches: _rows(run(batches)), SENT)
    sent = sent.unionAll(_facts_sent(fitted.vocabulary, WORD_FACTS, parts))
    if joins_pairs:
        sent = sent.unionAll(_facts_sent(fitted.rare, PAIR_FACTS, parts))
    sums = _met(sent, fitted.totals).groupBy("block").applyInArrow(_added, "doc_id long, n_tokens long, b double, t double")
    each = F.greatest("n_tokens", F.lit(1))
    made = sums.select("doc_id", "n_tokens", (F.col("t") / each).alias("ce_target"), (F.col("b") / each).alias("ce_background"))
    return made.withColumn("ce_difference", F.col("ce_target") - F.col("ce_background"))


def labelled(docs: DataFrame, labels: DataFrame, is_target: Column) -> DataFrame:
    """``text, is_target`` of all rows; rows without a label are background only."""
    marks = labels.groupBy("doc_id").agg(F.max(is_target).alias("mark"))
    return docs.select("doc_id", common.text_of().alias("text")).join(marks.hint("merge"), "doc_id", "left").select("text", F.coalesce("mark", F.lit(False)).alias("is_target"))


def op3_lm_score(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    found = scored(docs, models(labelled(docs, labels, F.col("quality") == 1), rare_pairs=True))
    return found.withColumn("held_out", held_out())
