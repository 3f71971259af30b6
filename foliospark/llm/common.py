"""What several operators share: scratch tables in the cluster's shared folder, ranks over all partitions, and components of a graph."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract: blank and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local master gets a folder of its own; a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        known = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return known


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table of the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/foliospark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def dropped(*tables: DataFrame) -> None:
    """Removes scratch tables of ``written`` once all that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(rows: DataFrame, order: list[str], weight: str | None = None) -> tuple[DataFrame, int]:
    """``rows`` (written) with ``upto``, the number of rows (or the sum of ``weight``) up to and with each one by ``order``, and the total.

    Rows are dealt by range and summed within each range; a range adds what the ranges before it hold. No task sees more than a range.
    """
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    dealt = written(rows.repartitionByRange(*order).withColumn("_run", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_run").agg(F.sum(amount).alias("k")).orderBy("_run").collect()  # one row for each partition of the sort
    before, total = [], 0
    for r in sums:
        before.append((r["_run"], total))
        total += r["k"]
    if not before:
        return dealt.drop("_run").withColumn("upto", F.lit(None).cast("long")), 0
    starts = rows.sparkSession.createDataFrame(before, "_run int, _before long")
    inside = F.sum(amount).over(Window.partitionBy("_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("upto", inside).join(F.broadcast(starts), "_run").withColumn("upto", F.col("upto") + F.col("_before")).drop("_run", "_before"), total


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, so that they don't add up on the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key is heavy when it has more rows than LEAST_HEAVY and at least 1 / MOST_HEAVY of all, so there are at most MOST_HEAVY of them.
LEAST_HEAVY, MOST_HEAVY, SALTS = 1000, 10_000, 32


def heavy_keys(counted: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The heavy keys of ``counted(*keys, size)``, marked ``_heavy``, for a broadcast: a bounded number whatever the input."""
    total = counted.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(counted.where((F.col(size) > LEAST_HEAVY) & (F.col(size) * MOST_HEAVY >= total)).select(*keys).distinct().withColumn("_heavy", F.lit(True)))


def salted(rows: DataFrame, heavy: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``_salt``, by which a join deals the rows of a heavy key over many tasks; 0 for all others."""
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(heavy, keys, "left").withColumn("_salt", salt).drop("_heavy")


def with_salts(facts: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """The other side of such a join: what belongs to a heavy key comes once for each salt."""
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return facts.join(heavy, keys, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")


#: The counts of a cell table are packed in chunks of so many; a group adds up the chunks of so many partitions, or of sums before.
CHUNK, FAN_IN = 1 << 16, 64


def packed(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The chunks of a table of counts that hold any, each with its number."""
    for at in range(0, len(counts), CHUNK):
        if counts[at : at + CHUNK].any():
            yield at // CHUNK, zlib.compress(counts[at : at + CHUNK].astype("<i8").tobytes(), 1)


def unpacked(cells: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cells), "<i8")


def _kept(total: np.ndarray) -> bytes:
    return zlib.compress(total.tobytes(), 1)


def added_up(chunks: DataFrame, keys: list[str], fan_in: int = FAN_IN, last: Callable[[np.ndarray], bytes] = _kept) -> DataFrame:
    """One row ``(*keys, cells)`` for each of ``keys``, the sum of its packed chunks.

    Sums are made in a tree: a group takes what ``fan_in`` partitions hold of a chunk, batch after batch with one sum in memory, and the groups
    of the next step take that many sums. However many tasks counted, no group grows with their number. ``chunks`` is a written table: its partitions are cut by bytes.
    ``last`` packs the whole sums, in the step that makes them, so that no task holds two Python workers.
    """
    fields = [f for f in chunks.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]

    def adds(pack: Callable[[np.ndarray], bytes]):
        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for cells in batch["cells"]:
                    total = total + unpacked(cells.as_py())
            yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([pack(total)], pa.binary())], names=[*names, "part", "cells"])

        return add

    rows, parts = chunks.select(*names, "cells").withColumn("part", F.spark_partition_id()), max(1, chunks.rdd.getNumPartitions())
    while parts:
        parts = -(-parts // fan_in) if parts > fan_in else 0
        rows = rows.withColumn("part", F.expr(f"int(part div {fan_in})")).groupBy(*names, "part").applyInArrow(adds(_kept if parts else last), f"{schema}, part int, cells binary")
    return rows.select(*names, "cells")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, where root is the least node that links lead to.

    Alternates large-star and small-star steps. Each step is a minimum per node, combined before the
    shuffle, and a join that adaptive execution can split, so that a hub with a third of all links
    is no task of its own. The edges of every round are written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        before = now
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "low"), F.struct(F.col("v").alias("u"), "low"))).alias("e"))
        now = written(small.select("e.u", F.col("e.low").alias("v")).where("u <> v").distinct(), "links")
        dropped(before)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
