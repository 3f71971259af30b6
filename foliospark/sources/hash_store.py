"""A growing set of content hashes, kept where the next run can join it without moving it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

BUCKETS, PREFIX = 16, 1


class HashStore:
    """Hashes in a table at ``path``: bucketed and sorted by hash, in folders by the first ``prefix`` hex digits, each with the number of the batch that brought it.

    A join by hash takes the buckets as they are: only the other side is dealt. A batch that has few hashes reads the folders of its prefixes only.
    ``buckets`` and ``prefix`` are given when a store is made, and are the same ever after; take as many buckets as a bucket of the whole store should fit one task.
    Adding is safe to repeat: what is there already isn't added again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, prefix: int = PREFIX):
        self.spark, self.path, self.buckets, self.prefix = spark, path, buckets, prefix
        self.name = f"hash_store_{hashlib.sha1(path.encode()).hexdigest()[:16]}"
        known = scratch.exists(spark, path)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (hash STRING, batch BIGINT, prefix STRING) USING parquet PARTITIONED BY (prefix) CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{place}'")
        if known:
            spark.catalog.recoverPartitions(self.name)

    def rows(self) -> DataFrame:
        """``hash, batch, prefix``."""
        return self.spark.table(self.name)

    def prefixes(self, hashes: DataFrame, key: str = "hash") -> list[str]:
        """The folders that a batch can meet, 16 ** prefix at most; as many as that and the batch had better read all."""
        return [r[0] for r in hashes.select(F.substring(key, 1, self.prefix)).distinct().collect()]

    def unseen(self, rows: DataFrame, key: str = "hash", batch: int | None = None, prune: bool = False) -> DataFrame:
        """``rows`` whose hash isn't stored, or only by the batch of that number. Equal ones within ``rows`` all stay; rows without a hash stay too."""
        stored = self.rows()
        if prune:
            stored = stored.where(F.col("prefix").isin(self.prefixes(rows, key)))
        if batch is not None:
            stored = stored.where(F.col("batch") != batch)
        return rows.hint("merge").join(stored.select(F.col("hash").alias(key)), key, "left_anti")

    def add(self, rows: DataFrame, batch: int, key: str = "hash") -> None:
        """Adds the hashes of ``rows`` that aren't stored by any batch. Rows are dealt as the buckets are, so that a task writes one bucket."""
        fresh = self.unseen(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("hash")).distinct())
        made = fresh.select("hash", F.lit(batch).cast("long").alias("batch"), F.substring("hash", 1, self.prefix).alias("prefix"))
        # what is read is written to as well, so the new ones are set down first
        held = scratch.written(made, "hashes")
        held.repartition(self.buckets, "hash").sortWithinPartitions("prefix", "hash").write.insertInto(self.name)
