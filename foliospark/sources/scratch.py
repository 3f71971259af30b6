"""Tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a local master gets one of its own, and a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/foliospark-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, whatever reads it, and not again when an executor is lost.

    ``group_bytes``: the size of a row group, which a writer holds in memory until it is full; else Spark's.
    """
    path = new_path(df.sparkSession, tag)
    out = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
