"""From page layout to paragraphs: spans, lines, page statistics, line filters, assembly.

A page is one row, its lines one array; spans, statistics and filters are expressions over that array. Documents are grouped
once, for the running headers; all that follows, pages and whole documents, reuses that partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch
from . import assembly, blocks
from . import paragraphs as P

SCHEMA = "doc_id long, pages array<struct<page:int,width:double,height:double,dict:struct<blocks:array<struct<type:int,lines:array<struct<bbox:array<double>,spans:array<struct<text:string,bbox:array<double>,size:double>>>>>>>>>"
PAGE = ["doc_id", "page_index"]

# Patterns and thresholds that results depend on.
ABSTRACT = r"(?i)^\s*(?:Abstract|(?:\d+\s+)?Introduction)\b"
BODY_CHARS, BODY_LINES, NEAR_LINES = 10, 8, 6
LOW_SHARE, HIGH_SHARE, BAND_PAD, OUTER_PAD = 0.06, 0.94, 2.0, 1.0
NOTE_TOP, SMALL_TOP, SMALL_FONT, NEAR_FONT = 0.72, 0.80, 0.92, 0.25
MARGIN, CENTRE, CORNER, NUMBER_FONT = 0.08, 0.12, 0.2, 1.3
HEADER_CHARS, HEADER_PAGES = 12, 3

#: Bytes of a row group of the pages' table: what each task that writes or reads it holds at once.
GROUP_BYTES = 8 << 20


def span_text(spans: Column) -> Column:
    """Spans of a line from left to right, with a blank where the gap is wide for the type size."""
    full = F.filter(spans, lambda s: F.trim(s["text"]) != "")
    ordered = F.sort_array(F.transform(full, lambda s: F.struct(s["bbox"][0].alias("x0"), s["bbox"][2].alias("x1"), s["text"].alias("text"))))
    sizes = F.sort_array(F.transform(full, lambda s: s["size"]))
    gap = F.greatest(F.lit(0.5), F.coalesce(array_median(sizes), F.lit(0.0)) * 0.06)
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("x1"))
    folded = F.aggregate(ordered, start, lambda s, x: F.struct(F.concat(s["text"], F.when((x["x0"] - s["x1"] >= gap) & ~s["text"].endswith(" "), " ").otherwise(""), x["text"]).alias("text"), x["x1"].alias("x1")))
    return T.normalize(T.scrub(folded["text"]))


def array_median(values: Column) -> Column:
    """The median of a sorted array; null when empty."""

    def middle(v: Column) -> Column:
        n = F.size(v)
        return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)

    return T.bound(values, middle)


def array_quantile(values: Column, share: float) -> Column:
    """The quantile of a sorted array by linear interpolation; null when empty."""

    def between(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(share)
        low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return F.when(F.size(v) > 0, low + (high - low) * (at - F.floor(at)))

    return T.bound(values, between)


def pages_of(layout: DataFrame) -> DataFrame:
    """``doc_id, page_index, page_w, page_h, lines``: the lines of the text blocks of each page. Blocks keep their number among all; lines without text or box go."""
    pages = layout.select("doc_id", F.explode("pages").alias("p")).where("p.page > 0")

    def line(block: Column, block_no: Column):
        def one(x: Column, line_no: Column) -> Column:
            box = {n: F.get(x["bbox"], F.lit(i)) for i, n in enumerate(("x0", "y0", "x1", "y1"))}
            font = F.coalesce(array_median(F.sort_array(F.transform(x["spans"], lambda s: s["size"]))), F.lit(0.0))
            whole = F.coalesce(F.size(x["bbox"]) == 4, F.lit(False))
            return F.when(whole, blocks.line(ord=(block_no * 100_000 + line_no).cast("long"), **box, text=span_text(x["spans"]), font_size=font))

        return F.when(block["type"] == 0, F.transform(F.coalesce(block["lines"], F.array()), one)).otherwise(F.array().cast(blocks.LINES_TYPE))

    made = F.flatten(F.transform(F.coalesce(F.col("p.dict.blocks"), F.array()), line))
    lines = F.filter(made, lambda x: x.isNotNull() & (x["text"] != ""))
    return pages.select("doc_id", (F.col("p.page") - 1).alias("page_index"), F.col("p.width").alias("page_w"), F.col("p.height").alias("page_h"), lines.alias("lines"))


def lines_of(layout: DataFrame) -> DataFrame:
    """The lines of ``pages_of`` as rows."""
    return pages_of(layout).select(*PAGE, "page_w", "page_h", F.inline("lines"))


def pages_from_lines(lines: DataFrame) -> DataFrame:
    """Rows of lines with ``doc_id, page_index, page_w, page_h`` gathered by page, in their order."""
    line = F.struct(*blocks.LINE).cast(blocks.LINE_TYPE)
    return lines.groupBy(*PAGE, "page_w", "page_h").agg(F.sort_array(F.collect_list(F.struct(line["ord"].alias("k"), line.alias("x")))).alias("lines")).withColumn("lines", F.transform("lines", lambda p: p["x"]))


def _sorted(lines: Column, value, keep=None) -> Column:
    made = F.transform(lines, value)
    return F.sort_array(F.filter(made, lambda v: v > 0) if keep is None else made)


def _height(x: Column) -> Column:
    return x["y1"] - x["y0"]


def _width(x: Column) -> Column:
    return x["x1"] - x["x0"]


def _lettered(x: Column) -> Column:
    return (F.length(x["text"]) >= BODY_CHARS) & x["text"].rlike("[A-Za-z]")


def with_metrics(pages: DataFrame) -> DataFrame:
    """``pages`` with the page's line height, median width and size of its lines, and the band that body lines fill.

    ``line_h``, ``median_w``, ``page_font``; ``top, bottom, band_h, band_w`` and ``font``, the body's, which are null, and 0 for the
    font, where a page has too few body lines. Body lines are found in two passes: first by length, letters and place, then without
    small lines at the foot, and the band itself from lines of about the median size.
    """
    x = F.col("lines")
    heights = lambda a: _sorted(a, _height)
    fonts = lambda a: _sorted(a, lambda l: l["font_size"])
    widths = lambda a: _sorted(a, _width)
    body = F.filter(x, _lettered)
    page = pages.withColumn("_all_h", heights(x)).withColumn("_body_h", heights(body))
    page = page.withColumn("line_h", F.when(F.size("_all_h") == 0, 10.0).when(F.size("_body_h") >= BODY_LINES, array_median(F.col("_body_h"))).otherwise(array_median(F.col("_all_h"))))
    page = page.withColumn("median_w", F.coalesce(array_median(widths(F.filter(x, lambda l: F.length(l["text"]) >= BODY_CHARS))), F.lit(0.0)))
    page = page.withColumn("page_font", F.coalesce(array_median(fonts(x)), F.lit(0.0)))
    plain = lambda l: _lettered(l) & ~l["text"].rlike(blocks.CAPTION) & ~((l["y0"] >= F.col("page_h") * NOTE_TOP) & l["text"].rlike(blocks.FOOTNOTE))
    page = page.withColumn("_c", F.filter(x, plain)).withColumn("_f", fonts(F.col("_c")))
    page = page.withColumn("_ok", (F.col("page_h") > 0) & (F.size("_c") >= BODY_LINES) & (F.size("_f") > 0) & (F.size(heights(F.col("_c"))) > 0)).withColumn("_m", array_median(F.col("_f")))
    small = lambda l: (l["y0"] >= F.col("page_h") * SMALL_TOP) & (l["font_size"] > 0) & (l["font_size"] <= F.col("_m") * SMALL_FONT)
    page = page.withColumn("_c2", F.filter("_c", lambda l: ~small(l)))
    enough = F.size("_c2") >= BODY_LINES
    page = page.withColumn("_m", F.when(enough, F.coalesce(array_median(fonts(F.col("_c2"))), F.col("_m"))).otherwise(F.col("_m"))).withColumn("_c", F.when(enough, F.col("_c2")).otherwise(F.col("_c")))
    near = F.filter("_c", lambda l: (l["font_size"] > 0) & (F.abs(l["font_size"] - F.col("_m")) / F.greatest(F.col("_m"), F.lit(1e-6)) <= NEAR_FONT))
    page = page.withColumn("_n", near).withColumn("_n", F.when(F.size("_n") >= NEAR_LINES, F.col("_n")).otherwise(F.col("_c")))
    page = page.withColumn("band_h", F.coalesce(array_median(heights(F.col("_n"))), array_median(heights(F.col("_c")))))
    page = page.withColumn("band_w", F.coalesce(array_median(widths(F.col("_n"))), array_median(widths(F.col("_c"))), F.lit(0.0)))
    pad = F.greatest(F.col("band_h"), F.lit(1.0)) * BAND_PAD
    low, high = (array_quantile(F.sort_array(F.transform("_n", lambda l: l[c])), q) for c, q in (("y0", LOW_SHARE), ("y1", HIGH_SHARE)))
    page = page.withColumn("top", F.greatest(F.lit(0.0), low - pad)).withColumn("bottom", F.least(F.col("page_h"), high + pad))
    page = page.withColumn("_ok", F.coalesce(F.col("_ok") & (F.col("bottom") > F.col("top")), F.lit(False)))
    for n in ("top", "bottom", "band_h", "band_w"):
        page = page.withColumn(n, F.when(F.col("_ok"), F.col(n)))
    return page.withColumn("font", F.when(F.col("_ok"), F.col("_m")).otherwise(0.0)).drop("_all_h", "_body_h", "_c", "_f", "_ok", "_m", "_c2", "_n")


def page_metrics(lines: DataFrame) -> DataFrame:
    """One row for each page of ``lines``, with the metrics of ``with_metrics``."""
    return with_metrics(pages_from_lines(lines)).drop("lines")


def outside_band(x: Column) -> Column:
    """Whether a line is clearly above or below the body; on pages without a band, whether it touches the margin."""
    pad = F.greatest(F.col("band_h"), F.lit(1.0)) * OUTER_PAD
    margin = F.col("page_h") * MARGIN
    touches = (x["y0"] <= margin) | (x["y1"] >= F.col("page_h") - margin)
    return F.when(F.col("top").isNotNull(), (x["y1"] < F.col("top") - pad) | (x["y0"] > F.col("bottom") + pad)).otherwise(touches)


def is_page_number(x: Column) -> Column:
    middle = (x["x0"] + x["x1"]) / 2
    placed = (F.abs(middle - F.col("page_w") / 2) <= F.col("page_w") * CENTRE) | (x["x0"] <= F.col("page_w") * CORNER) | (x["x1"] >= F.col("page_w") * (1 - CORNER))
    large = (F.col("font") > 0) & (x["font_size"] > F.col("font") * NUMBER_FONT)
    return x["text"].rlike(blocks.PAGE_NUMBER) & outside_band(x) & placed & ~large


def is_narrow_tall(x: Column) -> Column:
    w, h = _width(x), _height(x)
    banded = (F.col("band_w") > 0) & (w < F.col("band_w") * 0.25) & (F.col("band_h") > 0) & (h > F.col("band_h") * 3)
    return F.when(F.col("top").isNotNull(), banded).otherwise((w < F.col("page_w") * 0.08) & (h > F.col("page_h") * 0.25))


def running_texts(pages: DataFrame) -> DataFrame:
    """``doc_id, text``: what stands outside the band on at least three pages of a document.

    Pages are counted by document and text, first apart for each page, so neither a long document nor a text that is on all its pages is one task.
    """
    asked = F.filter("lines", lambda x: (F.length(x["text"]) >= HEADER_CHARS) & outside_band(x) & ~x["text"].rlike(blocks.PAGE_NUMBER))
    each = pages.select(*PAGE, F.explode(F.array_distinct(F.transform(asked, lambda x: x["text"]))).alias("text"))
    return each.groupBy("doc_id", "text").agg(F.count_distinct("page_index").alias("n")).where(F.col("n") >= HEADER_PAGES).select("doc_id", "text")


def _is(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def without_running(pages: DataFrame) -> DataFrame:
    """``pages`` (a table, for it is read twice) without the lines whose text runs through their document, wherever on a page they stand.

    The texts of each page meet the running ones, and a page gets back those that it has: no row holds more than a page.
    """
    running = running_texts(pages).select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    long = F.filter("lines", lambda x: F.length(x["text"]) >= HEADER_CHARS)  # as running ones are
    texts = pages.select(*PAGE, F.explode(F.array_distinct(F.transform(long, lambda x: x["text"]))).alias("text"))
    hits = texts.join(running, _is("doc_id", "_doc") & _is("text", "_text")).groupBy("doc_id", "page_index").agg(F.collect_set("text").alias("_running"))
    hits = hits.select(F.col("doc_id").alias("_doc"), F.col("page_index").alias("_page"), "_running")
    found = pages.join(hits, _is("doc_id", "_doc") & _is("page_index", "_page"), "left")
    kept = F.when(F.col("_running").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("_running", x["text"])))
    return found.withColumn("lines", kept).drop("_doc", "_page", "_running")


def filtered_pages(layout: DataFrame) -> DataFrame:
    """Pages with their metrics, without page numbers, narrow tall lines, running headers and footers; metrics are from before, and are computed once, into a table."""
    pages = without_running(scratch.written(with_metrics(pages_of(layout)), "pages", GROUP_BYTES))
    return pages.withColumn("lines", F.filter("lines", lambda x: ~is_page_number(x) & ~is_narrow_tall(x)))


def filtered_lines(layout: DataFrame) -> DataFrame:
    pages = filtered_pages(layout)
    return pages.select(*[n for n in pages.columns if n != "lines"], F.inline("lines"))


def raw_paragraphs(layout: DataFrame) -> DataFrame:
    """``doc_id, page_index, ord, caption, lines`` and the page's sizes: the paragraphs of each page, in reading order."""
    return assembly.page_paragraphs(blocks.without_blocks(filtered_pages(layout)))


def described(paragraphs: DataFrame) -> DataFrame:
    """``text, hash, n_lines, pages, bboxes, anchor, median_font`` from a paragraph's ``lines``.

    ``anchor``: the topmost line on the first page, a placeholder only where there is nothing else.
    """
    lines = F.col("lines")
    pages = F.sort_array(F.array_distinct(F.transform(lines, lambda x: x["page_index"] + 1)))
    box = lambda x: {n: x[n] for n in ("x0", "y0", "x1", "y1")}

    def common_box(page: Column) -> Column:
        def edges(mine: Column) -> Column:
            edge = lambda n, f: f(F.transform(mine, lambda x: x[n])).alias(n)
            return F.struct(page.alias("page"), edge("x0", F.array_min), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max))

        return T.bound(F.filter(lines, lambda x: x["page_index"] + 1 == page), edges)

    first = F.filter(lines, lambda x: x["page_index"] + 1 == F.col("pages")[0])
    rank = lambda x: F.struct(x["text"].startswith(blocks.MATH).alias("math"), x["y0"].alias("k"), x["x0"].alias("k2"), *[c.alias(n) for n, c in box(x).items()])
    made = paragraphs.withColumn("text", joined_lines(F.transform(lines, lambda x: x["text"]))).withColumn("hash", T.content_hash(F.col("text")))
    made = made.withColumn("n_lines", F.size(lines).cast("long")).withColumn("pages", pages).withColumn("bboxes", F.transform("pages", common_box))
    made = made.withColumn("_top", F.array_min(F.transform(first, rank)))
    made = made.withColumn("anchor", F.struct(F.col("pages")[0].alias("page"), *[F.col(f"_top.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")])).drop("_top")
    return made.withColumn("median_font", F.coalesce(array_median(_sorted(lines, lambda x: x["font_size"])), F.lit(0.0)))


def paragraphs_of(layout: DataFrame) -> DataFrame:
    """``doc_id, page_index, ord, text, hash, n_lines, x0, y0, x1, y1, caption`` of the assembled paragraphs of each page."""
    made = described(raw_paragraphs(layout))
    box = F.col("bboxes")[0]
    return made.select(*PAGE, "ord", "text", "hash", "n_lines", *[box[n].alias(n) for n in ("x0", "y0", "x1", "y1")], "caption")


def document_paragraphs(layout: DataFrame, references: bool = True) -> DataFrame:
    """``doc_id, ord, text, hash, pages, bboxes, anchor, caption, median_font, n_lines`` of each document, numbered from 0.

    Paragraphs that go on over pages are joined, formulas join the prose around them, the list of references goes, and so do
    headings that stand alone and tiny noise.
    """
    rows = described(assembly.merged_documents(raw_paragraphs(layout)))
    if references:
        rows = P.cut_references(rows)
    dropped = [blocks.is_heading_only(F.col("text"), F.col("n_lines")), blocks.is_tiny_noise(F.col("text"))]
    rows = rows.where(reduce(lambda a, b: a & b, [~F.coalesce(d, F.lit(False)) | F.col("caption") for d in dropped]))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).cast("long")
    return rows.withColumn("ord", number).select("doc_id", "ord", "text", "hash", "pages", "bboxes", "anchor", "caption", "median_font", "n_lines")


def joined_lines(parts: Column) -> Column:
    """Lines with blanks between them; a word split by a hyphen at a line's end is joined."""

    def ended(full: Column) -> Column:
        return F.transform(full, lambda x, i: F.when(i + 1 == F.size(full), x).when(x.rlike(r"\p{L}-$"), F.regexp_replace(x, "-$", "")).otherwise(F.concat(x, F.lit(" "))))

    # bound, for each line asks how many there are
    return T.normalize(F.array_join(T.bound(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), ended), ""))


def layout_of_texts(docs: DataFrame, lines_a_page: int = 40) -> DataFrame:
    """A plain layout for texts, one line below the other, so that layout queries run over documents."""
    docs = docs.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    lines = F.col("lines")
    pages = F.sequence(F.lit(0), F.greatest(F.floor((F.size(lines) - 1) / lines_a_page), F.lit(0)).cast("int"))

    def line(x: Column, i: Column) -> Column:
        top = i * 18.0 + 60.0
        box = F.array(F.lit(50.0), top, F.lit(300.0), top + 12.0)
        return F.struct(box.alias("bbox"), F.array(F.struct(x.alias("text"), box.alias("bbox"), F.lit(10.0).alias("size"))).alias("spans"))

    def page(p: Column) -> Column:
        mine = F.slice(lines, p * lines_a_page + 1, F.lit(lines_a_page))
        block = F.struct(F.lit(0).alias("type"), F.transform(mine, line).alias("lines"))
        return F.struct((p + 1).alias("page"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.struct(F.array(block).alias("blocks")).alias("dict"))

    return docs.select("doc_id", F.transform(pages, page).alias("pages"))
