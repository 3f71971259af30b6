"""The chain from a document's paragraphs to those that are kept: filters, places on the page, hashes, continuation merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from . import layout
from . import paragraphs as P


def without_captions(paragraphs: DataFrame, skip: bool = True) -> DataFrame:
    return paragraphs.where(~F.col("caption")) if skip else paragraphs


def font_threshold(paragraphs: DataFrame, least: float | str = "auto", ratio: float = 0.8) -> DataFrame:
    """``paragraphs`` with ``least_font``: a fixed size, or a share of the upper quartile (nearest rank) of the document's median sizes; 0 where off or unknown."""
    if least != "auto":
        return paragraphs.withColumn("least_font", F.lit(float(least)))
    doc, known = Window.partitionBy("doc_id"), F.col("median_font") > 0
    rows = paragraphs.withColumn("_place", F.row_number().over(doc.orderBy(known.desc(), "median_font")) - 1).withColumn("_n", F.count_if(known).over(doc))
    value = F.max(F.when(known & (F.col("_place") == P.rank_of(F.col("_n"))), F.col("median_font"))).over(doc)
    return rows.withColumn("least_font", F.coalesce(value * ratio, F.lit(0.0))).drop("_place", "_n")


def without_small_fonts(paragraphs: DataFrame) -> DataFrame:
    """Without paragraphs whose type is smaller than ``least_font``, where both are known."""
    return paragraphs.where(~((F.col("least_font") > 0) & (F.col("median_font") > 0) & (F.col("median_font") < F.col("least_font"))))


def without_references(paragraphs: DataFrame, skip: bool = True) -> DataFrame:
    """Without what follows the heading of a reference list, that heading, and entries wherever they stand."""
    return P.after_latch(paragraphs, F.col("text").rlike(T.REFERENCES), T.is_bib_entry(F.col("text"))) if skip else paragraphs


def without_headings(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where(~T.is_heading(F.col("text")))


def without_table_rows(paragraphs: DataFrame, skip: bool = True) -> DataFrame:
    return paragraphs.where(F.col("caption") | ~T.is_table_row(F.col("text"))) if skip else paragraphs


def coords(anchor: Column, bboxes: Column) -> Column:
    """Places as ``page, x, y, w, h``: the anchor alone where there is one, else all boxes."""
    place = lambda b: F.struct(b["page"].alias("page"), b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))
    whole = anchor.isNotNull() & anchor["page"].isNotNull() & anchor["x0"].isNotNull() & anchor["y0"].isNotNull() & anchor["x1"].isNotNull() & anchor["y1"].isNotNull()
    return F.when(whole, F.array(place(anchor))).otherwise(F.transform(F.coalesce(bboxes, F.array()), place))


def filtered_paragraphs(paragraphs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, ord, text, page, coords`` of the paragraphs that all filters leave, before continuations are merged."""
    s = settings or Settings()
    rows = font_threshold(without_captions(paragraphs, s.skip_captions), s.min_font, s.min_font_ratio)
    rows = without_references(rows.where(F.trim("text") != ""), s.skip_references)
    rows = without_table_rows(without_headings(rows), s.skip_table_like)
    rows = without_small_fonts(rows.where(P.length_between(F.col("text"), s.min_chars, s.max_chars)))
    rows = rows.withColumn("coords", coords(F.col("anchor"), F.col("bboxes")))
    rows = rows.withColumn("page", F.coalesce(F.try_element_at("pages", F.lit(1)), F.try_element_at("coords", F.lit(1))["page"]))
    return rows.select("doc_id", "ord", "text", "page", "coords")


def kept_paragraphs(paragraphs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, ord, text, hash, dedup_hashes, coords, page`` of ``paragraphs(doc_id, ord, text, caption, median_font, pages, bboxes, anchor)``."""
    return P.merge_captions(filtered_paragraphs(paragraphs, settings)).withColumn("dedup_hashes", F.array("hash"))


def extracted(dumps: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The kept paragraphs of layout dumps."""
    return kept_paragraphs(layout.document_paragraphs(dumps), settings)
