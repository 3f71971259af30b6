"""What the fourth review found: each test fails without its repair."""

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliospark.operators import layout
from foliospark.plans import catalogue, library_queries  # noqa: F401  (the last adds its queries)
from foliospark.sources import scratch


def agrees(spark, path, name, table) -> list[tuple]:
    """The rows of a query, which must be those of its SQL on one thread."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    found = sorted((tuple(r) for r in catalogue.QUERIES[name](spark, str(path)).collect()), key=repr)
    assert found == sorted(con.sql(catalogue.ORACLES[name]).fetchall(), key=repr)
    return found


def test_payloads_of_all_paragraphs(spark, tmp_path):
    docs = [(i, "\n".join(f"line {i} {n}" for n in range(9)) + "\nshared", "src0" if i < 4 else "src1", "en", 1) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = agrees(spark, tmp_path, "payloads", "documents")
    assert sum(r[0] == 5 for r in found) == 10 and sum(r[0] == 4 for r in found) == 9 and sum(r[0] == 2 for r in found) == 0


def test_attachments_without_key_or_number(spark, tmp_path):
    rows = [(1, None, 1, "N"), (1, 11, 2, "N"), (1, 12, None, "N"), (2, 21, None, "N"), (3, None, 4, "N"), (4, 41, 3, "N"), (4, 42, 3, "N"), (4, 43, 1, "R"), (None, 51, 1, "N"), (5, 61, 1, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert (1, 11, 1) in agrees(spark, tmp_path, "first_attachment", "lineitem")


def test_lines_of_a_paragraph_are_trimmed_once_each(spark):
    assert str(layout.joined_lines(F.col("parts"))).count("trim(") == str(layout.T.normalize(F.col("parts"))).count("trim(") + 1
    parts = F.array(*[F.lit(x) for x in (" a hy-", "", "phen and ", "1-", "x-")])
    assert spark.range(1).select(layout.joined_lines(parts)).first()[0] == "a hyphen and 1- x-"


def test_a_table_of_small_row_groups(spark):
    rows = spark.range(40_000, numPartitions=1).select(F.repeat(F.sha1(F.col("id").cast("string")), 20).alias("t"))
    groups = lambda df: sum(pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in (r[0].replace("file://", "file:") for r in df.select("_metadata.file_path").distinct().collect()))
    assert groups(scratch.written(rows, "t")) == 1 and groups(scratch.written(rows, "t", 1 << 20)) > 4
