"""Paragraph intake as a stream: each micro-batch adds only hashes that aren't stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.hash_store import HashStore


def store_unseen(paragraphs: DataFrame, path: str, checkpoint: str, store: str | None = None, key: str = "hash") -> StreamingQuery:
    """Runs until all that is there is read: rows whose hash no earlier batch had go to ``path``, their hashes to a hash store.

    A batch reads the folders of the store that its hashes can be in, not the batches written before. It is written under its number and matched with
    the others' hashes only, so that a repeated one replaces itself. Equal rows of one batch all stay. The store stands at ``store``, else beside ``path``.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = HashStore(batch.sparkSession, store or f"{path.rstrip('/')}-hashes")
        batch = batch.persist()
        try:
            held.unseen(batch, key, number, prune=True).write.mode("overwrite").parquet(f"{path}/batch={number}")
            held.add(batch, number, key)
        finally:
            batch.unpersist()

    return paragraphs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
