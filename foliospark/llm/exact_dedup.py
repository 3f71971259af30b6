"""Exact duplicates by static binary-fuse filters over immutable snapshots.

The digests of a snapshot never change, so each bucket of them gets a binary fuse filter once, when the snapshot is
published; digests and filters are kept as tables beside it, and any number of batches later meet them as they stand. Digests of a new
batch meet only the filter of their bucket. What it rejects is new and is grouped within the batch; what it lets pass is
joined with the exact digests of the snapshot, and the bytes of all rows that share a digest are compared before they count as equal.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of splitmix64 over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed) * _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class FuseFilter:
    """A static three-wise binary fuse filter with prints of 8 bits: no false negatives, about 0.4 % false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @classmethod
    def build(cls, keys: np.ndarray, tries: int = 100) -> FuseFilter:
        """``keys``: unsigned 64-bit integers; repeated ones count once. Keys are peeled in rounds, all lone slots of a round at once."""
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
        factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, (round(n * factor) + segment - 1) // segment - 2)
        for seed in range(1, tries + 1):
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if made._fill(keys):
                return made
        raise RuntimeError("no seed gave an acyclic filter")

    def _slots(self, h: np.ndarray) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        low = np.uint64(self.segment - 1)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * self.segment)) ^ (h & low)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        h = _mixed(keys, self.seed)
        slots, size = self._slots(h), len(self.prints)
        count = np.bincount(slots.ravel(), minlength=size)
        ids = np.arange(len(keys), dtype=np.int64)
        held = np.zeros(size, np.int64)  # exclusive or of the keys in a slot: the key itself once it is alone
        for row in slots:
            np.bitwise_xor.at(held, row, ids)
        rounds, left, lone = [], len(keys), np.flatnonzero(count == 1)
        while left and len(lone):
            key, at = np.unique(held[lone], return_index=True)
            rounds.append((key, lone[at]))
            left -= len(key)
            touched = slots[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(held, row, key)
            lone = np.unique(touched)
            lone = lone[count[lone] == 1]
        if left:
            return False
        prints = self._print(h)
        for key, slot in reversed(rounds):
            a, b, c = slots[:, key]
            self.prints[slot] = 0
            self.prints[slot] = prints[key] ^ self.prints[a] ^ self.prints[b] ^ self.prints[c]
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(np.asarray(keys, np.uint64), self.seed)
        a, b, c = self._slots(h)
        return self._print(h) == self.prints[a] ^ self.prints[b] ^ self.prints[c]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FuseFilter:
        seed, segment, segments = np.frombuffer(raw[:24], "<i8").tolist()
        return cls(seed, segment, segments, np.frombuffer(raw[24:], np.uint8))


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(common.text_of(column), common.SPACE + "+", "")


def snapshot_filters(digests: DataFrame) -> DataFrame:
    """``(bucket, filter)`` from ``digests(bucket, key)``; a bucket has a bounded number of keys, as its count follows the input."""

    def build(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy().view(np.uint64)
        return pa.table({"bucket": table["bucket"][:1].cast(pa.int64()), "filter": pa.array([FuseFilter.build(keys).to_bytes()], pa.binary())})

    return digests.select("bucket", "key").groupBy("bucket").applyInArrow(build, "bucket long, filter binary")


def screened(filters: DataFrame, digests: DataFrame, parts: int = 1) -> DataFrame:
    """``digests(bucket, key, ...)`` with ``maybe``: false only for keys that the snapshot surely lacks.

    Buckets follow the snapshot; a larger batch is dealt over ``parts`` parts of each bucket, to every one of which the bucket's filter goes.
    """
    schema = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("maybe", pa.bool_())])

    def look(mine: pa.Table, new: pa.Table) -> pa.Table:
        keys = new["key"].to_numpy()
        if len(mine):
            maybe = FuseFilter.from_bytes(mine["filter"][0].as_py()).holds(keys.view(np.uint64))
        else:
            maybe = np.zeros(len(keys), bool)
        return pa.table({"bucket": new["bucket"].cast(pa.int64()), "key": new["key"], "maybe": pa.array(maybe, pa.bool_())}, schema)

    everywhere = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = digests.select("bucket", "key", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int").alias("part"))
    return everywhere.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInArrow(look, "bucket long, key long, maybe boolean")


@dataclass
class Snapshot:
    """A published table: its rows, and where its digests, groups and filters stand."""

    docs: DataFrame
    path: str
    digest_hex: int = 64
    bucket_keys: int = 1 << 17

    def table(self, name: str) -> DataFrame:
        return self.docs.sparkSession.read.parquet(f"{self.path}/{name}")


def _rows(df: DataFrame, digest_hex: int) -> DataFrame:
    norm = df.select("doc_id", common.text_of().alias("text")).select("doc_id", F.length("text").alias("points"), normalised().alias("norm"))
    return norm.select("doc_id", "points", "norm", F.sha2("norm", 256).alias("sha")).withColumn("digest", F.unhex(F.substring("sha", 1, digest_hex)))


def _digests(df: DataFrame, digest_hex: int) -> DataFrame:
    return _rows(df, digest_hex).select("doc_id", "points", F.unhex("sha").alias("sha"), "digest")


def _best() -> Column:
    """The row that stays: most code points, then the least id, a row without an id last."""
    return F.max(F.struct("points", F.bitwise_not("doc_id").alias("un_id"))).alias("best")


def _groups(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.count("*").alias("n"), _best()).withColumn("key", F.xxhash64("digest"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.shiftright("key", 7), F.lit(buckets))


def publish(docs: DataFrame, path: str, digest_hex: int = 64, bucket_keys: int = 1 << 17) -> Snapshot:
    """Writes the digests, groups and filters of ``docs(doc_id, text)`` below ``path``; ``docs`` itself has to stay as it is.

    ``bucket_keys`` bounds the keys of one filter; ``digest_hex`` shortens the digest (a test hook: with few digits texts
    collide, and only the byte check keeps them apart).
    """
    made = Snapshot(docs, path, digest_hex, bucket_keys)
    _digests(docs, digest_hex).write.parquet(f"{path}/digests")
    _groups(made.table("digests")).write.parquet(f"{path}/keys")
    buckets = max(1, -(-made.table("keys").count() // bucket_keys))
    made.table("keys").withColumn("bucket", _bucket(buckets)).write.parquet(f"{path}/groups")
    filters = snapshot_filters(made.table("groups"))
    filters.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")
    return made


def against(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """One row for each row of the snapshot and of ``batch(doc_id, text)``, with the row that stays of its group of equal texts.

    Texts are equal when the same after white space is deleted; null counts as empty, so nulls, empty texts and
    texts of white space alone form one group. Of a group the row with most code points in its original
    text stays, then the one with the least ``doc_id``, one without an id last: where that one stays for its length, ``keep_id`` is null.
    ``kept`` is never null. Rows that repeat both ``doc_id`` and text can't be told apart and get the same answer. Very long
    texts are compared by their digests, and whole where these are shared. Other columns, whatever their names, are ignored. Empty inputs give no rows.
    """
    digest_hex = snapshot.digest_hex
    mine = common.written(_digests(batch, digest_hex), "digests")
    filters = snapshot.table("filters")
    held = filters.agg(F.max("buckets")).first()[0] or 1
    old = snapshot.table("groups")
    new = common.written(_groups(mine).withColumn("bucket", _bucket(held)), "groups")
    parts = max(1, -(-new.count() // (held * snapshot.bucket_keys)))  # an empty or small snapshot has one bucket, whatever comes
    verdict = common.written(screened(filters.drop("buckets"), new, parts), "screened")
    # what passed the filters meets the exact digests of the snapshot
    hits = new.join(verdict.where("maybe").select("key").distinct(), "key", "left_semi").select("digest").join(old.select("digest"), "digest", "left_semi")
    shared = hits.unionAll(old.where("n > 1").select("digest")).unionAll(new.where("n > 1").select("digest")).distinct()
    # byte check: rows of a shared digest are grouped by the text itself, combined before the shuffle
    full = _rows(snapshot.docs, digest_hex).unionAll(_rows(batch, digest_hex))
    # a text that a third of all rows have is dealt over many tasks by a salt, until equal texts of a task are one row
    heavy = common.heavy_keys(old.select("digest", "n").unionAll(new.select("digest", "n")), ["digest"], "n")
    bytes_equal = (
        common.salted(full, heavy, ["digest"], ["doc_id"])
        .join(common.with_salts(shared, heavy, ["digest"]).hint("merge"), ["digest", "_salt"], "left_semi")
        .groupBy("digest", "sha", "norm")
        .agg(F.count("*").alias("n"), _best())
        .select("digest", F.unhex("sha").alias("sha"), F.struct("n", "best").alias("g"))
        .groupBy("digest", "sha")
        .agg(F.count("*").alias("texts"), F.max("g").alias("g"))
    )
    # two texts with one full SHA-256 would need a longer digest; such a run stops instead of merging them
    checked = bytes_equal.select("digest", "sha", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share one SHA-256"))).otherwise(F.col("g.n")).cast("long").alias("n"), F.col("g.best.un_id").alias("un_id"))
    base = snapshot.table("digests").unionAll(mine)
    keep = F.when(F.col("n").isNotNull(), F.bitwise_not("un_id")).otherwise(F.col("doc_id"))
    base = common.salted(base, heavy, ["digest"], ["doc_id"])
    found = base.join(common.with_salts(checked, heavy, ["digest"]).hint("merge"), ["digest", "sha", "_salt"], "left").select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(snapshot: DataFrame, batch: DataFrame, digest_hex: int = 64, bucket_keys: int = 1 << 17) -> DataFrame:
    """``against`` a snapshot that is published for this call alone."""
    path = f"{common.shared_dir(batch.sparkSession).rstrip('/')}/foliospark-snapshot-{uuid.uuid4().hex}"
    return against(publish(snapshot, path, digest_hex, bucket_keys), batch)


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as a published snapshot and a new batch, told apart by a checksum of the id."""
    late = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 1
    return docs.where(~late), docs.where(late)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(*halves(common.documents(spark, sf_dir)))


WS_SQL = r"[\x20\x09-\x0D]"
OP10_SQL = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{WS_SQL}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
