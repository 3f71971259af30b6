"""Writes that hold only while a row is as it was read: rounds of writing, reading back what had changed, and deciding anew."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import annotations as A
from . import reconcile as R

#: Sends one change, ``(action, key, version, row)``, and gives ``(status, row now)``: updated, deleted, conflict or missing, and with a conflict the row as it stands.
Send = Callable[[str, str, int, dict], tuple[str, dict | None]]


def _sent(changes: DataFrame, send: Send) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch[n].to_pylist() for n in ("action", "key", "version", "row")], strict=True)
            found = [send(action, key, version, json.loads(row)) for action, key, version, row in rows]
            now = [None if row is None else json.dumps(row, ensure_ascii=False) for _, row in found]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([s for s, _ in found], pa.string()), pa.array(now, pa.string())], names=["key", "status", "now"])

    return changes.mapInArrow(run, "key string, status string, now string")


def written_back(changes: DataFrame, send: Send, again: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """``key, status, tries`` of each of ``changes(action, key, version, row)``, where ``row`` is JSON; one change a key.

    A change holds where the service's version is the expected one. What comes back as a conflict, ``key, now``, goes through ``again``, which makes changes
    of the rows as they stand now, or none where there is nothing left to do: such rows are superseded. After ``rounds`` rounds a conflict stays one.
    Each round is its own job, whose outcome is in the shared folder before the next begins: no action on the result writes again. A task that is tried
    again repeats its writes with the old version, so at worst it reads its own write as a conflict, and the next round decides by the row itself.
    """
    outcomes, now = [], changes
    for n in range(1, rounds + 1):
        sent = scratch.written(_sent(now, send), "sent")
        conflicts = sent.where("status = 'conflict'")
        if n == rounds or conflicts.isEmpty():
            outcomes.append(sent.select("key", "status", F.lit(n).alias("tries")))
            break
        now = scratch.written(again(conflicts.select("key", "now")), "again")
        gone = conflicts.join(now.select("key"), "key", "left_anti")
        outcomes.append(sent.where("status <> 'conflict'").select("key", "status", F.lit(n).alias("tries")))
        outcomes.append(gone.select("key", F.lit("superseded").alias("status"), F.lit(n).alias("tries")))
    return reduce(DataFrame.unionAll, outcomes)


def _changes(action: str, rows: DataFrame, row: Column) -> DataFrame:
    return rows.select(F.lit(action).alias("action"), F.col("key").cast("string").alias("key"), F.col("version").cast("long").alias("version"), F.to_json(row).alias("row"))


def _as_read(found: DataFrame, like: DataFrame, columns: list[str]) -> DataFrame:
    """``key, now`` as rows of ``like``."""
    schema = ", ".join(f"{n} {like.schema[n].dataType.simpleString()}" for n in columns)
    return found.select(F.col("key").cast(like.schema["key"].dataType).alias("key"), F.from_json("now", schema).alias("r")).select("key", "r.*")


def healed_in_place(read: Callable[[], DataFrame], send: Send, candidates: DataFrame, repair: bool = True, delete: bool = True, rounds: int = 3, prefix: str = "para:") -> tuple[DataFrame, DataFrame]:
    """Repairs broken annotations in the store itself, then deletes what is broken still; the annotations as they stand then, and what happened, by PDF.

    ``read`` gives ``annotations(key, pdf, version, data, tags)`` as they are. Repairs go out under the version read; where somebody else was faster the row is looked at again, and repaired,
    deleted or left alone by what it is then. Deletion follows on a fresh read. ``pdf, broken, tagged, repaired, deleted, superseded, conflicts``: the first two
    before, the others what the service said.
    """
    columns = ["pdf", "version", "data", "tags"]
    before = scratch.written(read(), "before")
    counts = A.broken_counts(before, prefix)
    whole = F.struct(*columns)

    def repairs(rows: DataFrame) -> DataFrame:
        found = A.repaired(rows, candidates, prefix)
        return _changes("update", A.with_repairs(found.withColumn("_go", F.col("outcome") == "repaired")).where("_go"), whole)

    def deletions(rows: DataFrame) -> DataFrame:
        return _changes("delete", rows.where(A.is_broken(F.col("data"))), whole)

    outcomes = []
    for wanted, make in ((repair, repairs), (delete, deletions)):
        if wanted:
            rows = before if not outcomes else scratch.written(read(), "between")
            done = written_back(make(rows), send, lambda stale, make=make: make(_as_read(stale, before, columns)), rounds)
            outcomes.append(rows.select(F.col("key").cast("string").alias("key"), "pdf").join(done, "key"))
    zero = F.lit(0).cast("long")
    named = {"repaired": "updated", "deleted": "deleted", "superseded": "superseded", "conflicts": "conflict"}
    if outcomes:
        said = reduce(DataFrame.unionAll, outcomes).groupBy("pdf").agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in named.items()])
        counts = counts.join(said, "pdf", "left").select("pdf", "broken", "tagged", *[F.coalesce(n, zero).alias(n) for n in named])
    else:
        counts = counts.select("*", *[zero.alias(n) for n in named])
    return read(), counts


def retagged_in_place(items: DataFrame, changes: DataFrame, send: Send, rounds: int = 3) -> DataFrame:
    """``key, status, tries``: ``changes(key, add, remove)`` to the tags of ``items(key, version, tags)`` in the store. Where an item had changed its tags are read again and merged anew; where nothing would change nothing is written."""
    wanted = scratch.written(changes.select(F.col("key").cast("string").alias("key"), "add", "remove"), "wanted")

    def merged(rows: DataFrame) -> DataFrame:
        both = rows.withColumn("key", F.col("key").cast("string")).join(wanted, "key")
        after = R.merged_tags(F.col("tags"), F.col("add"), F.col("remove"))
        return _changes("update", both.withColumn("_after", after).where(F.array_sort("tags") != F.col("_after")).withColumn("tags", F.col("_after")), F.struct("version", "tags"))

    return written_back(merged(items), send, lambda stale: merged(_as_read(stale, items, ["version", "tags"])), rounds)
