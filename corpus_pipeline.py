"""A corpus from documents to packed sequences: toxic texts go, repeated passages go, one text of each near-copy group stays, sources are mixed, the rest is packed.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents, and more columns of docs, whatever
their names, with them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import common, jaccard_join, line_dedup, mixing, packing, toxicity


def _apart(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with all but the used columns renamed, so that no stage's own columns meet them, and what brings the names back."""
    back = [F.col(n) if n in used else F.col(f"_in_{n}").alias(n) for n in docs.columns]
    return docs.select(*[F.col(f"`{n}`").alias(n if n in used else f"_in_{n}") for n in docs.columns]), back


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under the threshold; the lexicon is learned from the labelled rows that aren't held out.

    Every row is judged alone, so repeated rows go or stay together; null and empty texts have no evidence and stay, very long ones
    are read whole. Without labels nothing goes. No rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    lexicon = toxicity.train(docs, labels)
    rows, back = _apart(docs, ("text",))
    return toxicity.scored(rows, lexicon).where("predicted = 0").select(*back)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages; a row all of whose lines were copies goes.

    Null and empty texts stay. Rows without an id count as the first ones; rows that repeat both id and text are treated alike.
    Very long texts are cut as any other. No rows give none.
    """
    rows, back = _apart(docs, ("doc_id", "text"))
    rows = line_dedup.line_dedup(rows).where("n_deleted = 0 or text <> ''")
    if "_in_n_chars" in rows.columns:
        rows = rows.withColumn("_in_n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("_in_n_chars")))
    return rows.select(*back)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (80 % of their shingles of five words) one row, that with the least id; empty texts are similar to nothing and stay.

    Rows without an id come last in their group, ties go by a hash of the text, and of rows alike in both one stays. Null texts count as
    empty, very long ones as any other. No rows give none.
    """
    found = jaccard_join.jaccard_components(docs, words=5, percent=80)
    key = {"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long"))}
    row = F.struct(*[c.alias(f"__its_{n}") for n, c in key.items()], F.col("text_hash").alias("__its_hash")).alias("r")
    best = found.where("n_shingles > 0").groupBy("component").agg(F.min(row).alias("r")).select("r.*", F.lit(1).alias("__most"))
    blank = found.where("n_shingles = 0").select(row).distinct().select("r.*", F.lit(None).cast("int").alias("__most"))
    keep = common.written(best.unionAll(blank), "keep")
    key["hash"] = F.xxhash64(common.text_of())
    rows = docs.withColumns({f"__{n}": c for n, c in key.items()})
    rows = rows.join(keep.hint("merge"), reduce(and_, [F.col(f"__{n}") == F.col(f"__its_{n}") for n in key]))
    same = [f"__{n}" for n in key]
    rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*same).orderBy(*same)))
    return rows.where("__most is null or __row <= __most").select(*[F.col(f"`{n}`") for n in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them: not at all, once or twice.

    Null sources are one source; rows that repeat an id are taken alike, those without an id too. Null texts have no words: in a source that is
    taken whole they come as often as the others. Very long texts may carry a source past its target by one row. No rows give none.
    """
    return mixing.repeated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids. Null and empty texts are one id; rows that repeat an id are packed each; no rows give none."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Learned scores, hashes of ids and a tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.dropped(before)
        before = docs
    return docs
