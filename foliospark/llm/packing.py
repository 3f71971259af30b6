"""Packing of tokenised texts into sequences under several limits at once, by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens. Each task keeps a bounded pool of
pieces; the sequence in work takes the piece, among those that fit, whose demand has the largest dot product with
what the sequence has left. When none fits whole, the one that can fill most of the rest is cut: where no more tokens may bear
loss, it is one whose head, which bears none, is long.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

END = 1
#: What every version of Unicode classes alike, without the odd white space: only such texts take the fast path.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e¡-ž]")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokenizer:
    """The ids that the ``tokenizers`` library gives for a byte-level BPE file, special tokens not added.

    Plain texts go through ``tiktoken`` with the same vocabulary, which is several times faster; texts with other
    characters, or with the string of a special token, through ``tokenizers`` itself. The tests compare both.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if _ODD.search(text) or any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


class Pool:
    """Pieces that wait for a sequence: ``[row, start, ids, loss-free tokens at its head]``, with their demands."""

    def __init__(self, limits: tuple[int, int, int], room: int = 512):
        self.limits, self.room = np.array(limits, np.float64), room
        self.items: list = [None] * room
        self.demand = np.full((room, 3), np.inf)
        self.free, self.size = list(range(room - 1, -1, -1)), 0

    def put(self, item) -> None:
        at = self.free.pop()
        self.items[at], self.demand[at] = item, self._demand(item)
        self.size += 1

    @staticmethod
    def _demand(item) -> tuple[int, int, int]:
        return len(item[2]), 1, max(0, len(item[2]) - item[3])

    def _take(self, at: int):
        item = self.items[at]
        self.items[at], self.demand[at] = None, np.inf
        self.free.append(at)
        self.size -= 1
        return item

    def sequence(self) -> list:
        """The pieces of one more sequence."""
        left, out = self.limits.copy(), []
        while self.size and left[0] >= 1 and left[1] >= 1:
            fits = np.flatnonzero((self.demand <= left).all(1))
            if len(fits):
                score = (self.demand[fits] / self.limits**2) @ left
                item = self._take(int(fits[np.argmax(score)]))
            else:
                length, loss = np.where(np.isinf(self.demand[:, 0]), 0, self.demand[:, 0]), np.where(np.isinf(self.demand[:, 2]), 0, self.demand[:, 2])
                # of those that can fill as much, the one with most to give
                most = np.minimum(np.minimum(left[0], length - loss + left[2]), length)
                at = int(np.argmax(most + length / (self.limits[0] * 2)))
                cut = int(most[at])
                if cut < 1:
                    break
                row, start, ids, head = self._take(at)
                self.put((row, start + cut, ids[cut:], max(0, head - cut)))
                item = (row, start, ids[:cut], min(head, cut))
            left -= self._demand(item)
            out.append(item)
        return out


def packed(docs: DataFrame, limits: tuple[int, int, int] = (2048, 64, 2048), path: str | None = None, prompt: str | None = None, room: int = 512, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text)``.

    Tokens of a document: the ids of its text, then id 1. Null texts count as empty and have that id alone. ``limits``: tokens,
    segments and loss-bearing tokens of a sequence; ``prompt`` names a column with the number of tokens at the head of a text
    that bear no loss (none else; null: none). Every id is in one piece; a document may be cut anywhere, and very long ones run over many
    sequences. ``sequence_id`` is unique over all tasks, ``offset`` gapless within it, ``loss_tokens`` counts a piece's ids that bear
    loss, ``padded_length`` is the first limit unless the sequence's length is a power of two. Each task packs what it reads,
    without a shuffle, and at its end one sequence or few stay short. Rows that repeat an id are packed each; equal demands
    go by their place in the pool. Tables without rows give none. Other columns, whatever their names, are ignored. ``room``:
    pieces that wait at a time, each shorter than a sequence.
    """
    path = path or tokenizer_file()
    most = limits[0]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64()), ("loss_tokens", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches):
        known, pool = tokenizer(path), Pool(limits, room)
        counter = TaskContext.get().partitionId() << 36
        rows: dict[str, list] = {f.name: [] for f in schema}

        def close(pieces) -> None:
            nonlocal counter
            at, used = 0, sum(len(p[2]) for p in pieces)
            padded = used if used & (used - 1) == 0 else most
            for (doc_id, total), start, ids, free in pieces:
                values = [doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, counter, at, padded, max(0, len(ids) - free)]
                if with_ids:
                    values.append(ids.astype(np.int32))
                for name, value in zip(rows, values, strict=True):
                    rows[name].append(value)
                at += len(ids)
            counter += 1

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
            for v in rows.values():
                v.clear()
            return batch

        for batch in batches:
            heads = batch["head"].to_pylist()
            for doc_id, text, head in zip(batch["doc_id"].to_pylist(), batch["text"], heads, strict=True):
                ids = np.array([*known.ids(text.as_py()), END], "<u4")
                row, start, total = (doc_id, len(ids)), 0, len(ids)
                # whole sequences need no choice, where the other limits allow them
                while total - start >= most and max(0, most - max(0, head - start)) <= limits[2]:
                    close([(row, start, ids[start : start + most], max(0, head - start))])
                    start += most
                while start < total:
                    piece = ids[start : start + most - 1] if total - start >= most else ids[start:]
                    while not pool.free:
                        close(pool.sequence())
                    pool.put((row, start, piece, max(0, head - start)))
                    start += len(piece)
                while pool.size >= room - 1:
                    close(pool.sequence())
                if len(rows["doc_id"]) >= 2000:
                    yield flushed()
        while pool.size:
            close(pool.sequence())
        if rows["doc_id"]:
            yield flushed()

    head = F.coalesce(F.col(prompt).cast("long"), F.lit(0).cast("long")) if prompt else F.lit(0).cast("long")
    types = {pa.int64(): T.LongType()}
    out = T.StructType([T.StructField(f.name, types.get(f.type) or T.ArrayType(T.IntegerType())) for f in schema])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), head.alias("head")).mapInArrow(run, out)


#: The query's rule for plain documents: a text's first ids, seen without context, bear no loss; of a sequence's 2048 ids at most so many bear loss.
CONTEXT, LOSS_BEARING = 64, 2000


def op8_packing(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text", F.lit(CONTEXT).alias("context"))
    return packed(docs, (2048, 64, LOSS_BEARING), prompt="context", with_ids=False)
