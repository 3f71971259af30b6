"""Layout dumps as input and output, paragraphs and page texts as XML or JSON, and a batched sink with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.layout import SCHEMA


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout dumps, one JSON document a file or a line; documents without a list of pages are an error."""
    raw = spark.read.schema(SCHEMA).json(path)
    return raw.withColumn("pages", F.when(F.col("pages").isNull(), F.raise_error(F.lit("pages must be a list"))).otherwise(F.col("pages")))


def scan_layout(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sound layout dumps under ``path``, and ``file, reason, sample`` of the others: no document ends the job.

    A line is a document, or with ``whole_files`` a file, which may then be indented. Reasons: ``malformed`` where it is no JSON, ``wrong_types`` where a field has
    another type than a dump's, ``no_pages`` where there is no list of pages. Blank lines are none. The text is read once for both, and ``sample`` is its beginning.
    """
    raw = spark.read.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = raw.withColumn("r", F.from_json("value", f"{SCHEMA}, _corrupt string", how))
    reason = F.when(~T.is_json(F.col("value")), "malformed").when(F.col("r._corrupt").isNotNull(), "wrong_types").when(F.col("r.pages").isNull(), "no_pages")
    marked = read.withColumn("reason", reason)
    good = marked.where("reason is null").select(F.col("r.doc_id").alias("doc_id"), F.col("r.pages").alias("pages"))
    return good, marked.where("reason is not null").select("file", "reason", F.left("value", F.lit(200)).alias("sample"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("key"), "content")


def xml_rows(paragraphs: DataFrame) -> DataFrame:
    """The rows of the XML form: number and caption flag as attributes, text, pages, and boxes by page; control characters, which XML forbids, become blanks."""
    has = paragraphs.columns
    rows = [F.col("ord").alias("_id"), F.coalesce(F.col("caption" if "caption" in has else "is_caption"), F.lit(False)).cast("int").alias("_is_caption") if {"caption", "is_caption"} & set(has) else F.lit(0).alias("_is_caption")]
    rows.append(T.scrub(F.col("text")).alias("text"))
    if "pages" in has:
        rows.append(F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))
    if "bboxes" in has:
        box = lambda b: F.struct(*[b[n].alias(f"_{n}") for n in ("page", "x0", "y0", "x1", "y1")])
        rows.append(F.struct(F.transform("bboxes", box).alias("bbox")).alias("bboxes"))
    return paragraphs.select(*rows)


def write_paragraphs_xml(paragraphs: DataFrame, path: str) -> None:
    """One XML file set."""
    xml_rows(paragraphs).write.format("xml").option("rowTag", "paragraph").option("rootTag", "paragraphs").mode("overwrite").save(path)


def preview(paragraphs: DataFrame, most: int = 20) -> DataFrame:
    """The first paragraphs of each document as a preview shows them: index, hash, hashes, page, text and places."""
    from ..operators.reconcile import capped

    rows = capped(paragraphs, "doc_id", "ord", most)
    return rows.select("doc_id", F.col("ord").alias("index"), "hash", "dedup_hashes", "page", "text", "coords")


def page_texts(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages(doc_id, page, text)`` with scrubbed texts and their lengths."""
    return pages.withColumn(text, T.scrub(F.coalesce(F.col(text), F.lit("")))).withColumn("chars", F.length(text))


def page_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


def binary_facts(content: Column, with_bytes: bool = False) -> Column:
    """How a dump stands for bytes: their number and hash, and themselves as text where asked."""
    facts = [F.octet_length(content).alias("len"), F.sha1(content).alias("sha1")]
    return F.struct(*facts, *([F.base64(content).alias("base64")] if with_bytes else []))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_batched(rows: DataFrame, item: str, order: list[str], create: Callable[[list[dict]], list[bool]], size: int = 10) -> DataFrame:
    """``item, planned, created, failed``: rows go to ``create`` in batches of ``size``; what fails in a batch is tried once more alone.

    ``create`` runs on the executors, takes rows as dicts and tells for each whether it was stored. It has to be idempotent, for a lost
    task is run again.
    """
    from ..operators.reconcile import batches

    schema = f"{item} string, planned long, created long"

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for (key, _), part in frame.groupby([item, "batch"], sort=False):
                records = part.drop(columns=["batch"]).to_dict("records")
                stored = create(records)
                stored = [ok or create([r])[0] for ok, r in zip(stored, records, strict=True)]
                out.append((str(key), len(records), sum(stored)))
            yield pd.DataFrame(out, columns=[item, "planned", "created"])

    dealt = batches(rows, item, order, size).repartition(item, "batch").sortWithinPartitions(item, "batch", *order)
    done = dealt.mapInPandas(run, schema)
    return done.groupBy(item).agg(F.sum("planned").alias("planned"), F.sum("created").alias("created")).withColumn("failed", F.col("planned") - F.col("created"))


def with_retry(call: Callable[[], str], attempts: int = 3, first: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after temporary and rate-limit errors, with doubling waits; other errors go up at once."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except ProviderError as error:
            if error.kind not in ("temporary", "rate_limit") or n == attempts:
                raise
            sleep(min(most, first * 2 ** (n - 1)))
    raise AssertionError("attempts must be at least 1")


class ProviderError(RuntimeError):
    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind
