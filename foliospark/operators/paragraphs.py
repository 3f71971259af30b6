"""Operators over ordered paragraphs: filters, latches, merges and context."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions import text as T
from ..functions.plain import is_captionish


def split_lines(docs: DataFrame, pattern: str = "\n") -> DataFrame:
    """``doc_id, lang, source, ord, text``: the normalised parts of each text, empty ones too."""
    parts = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", pattern)).alias("ord", "raw"))
    return parts.select("doc_id", "lang", "source", "ord", T.normalize(F.col("raw")).alias("text"))


def length_between(text: Column, least: int = 60, most: int = 1500) -> Column:
    return F.length(text).between(least, most)


def drop_running_headers(lines: DataFrame, least_chars: int = 12, pages: int = 3, page: str = "doc_id", text: str = "text") -> DataFrame:
    """Without lines whose exact text stands on ``pages`` different pages: a count per text, combined before the shuffle, then an anti join."""
    running = lines.where((F.length(text) >= least_chars) & ~F.col(text).rlike(r"^\d{1,4}$")).select(text, page).distinct().groupBy(text).count().where(F.col("count") >= pages).select(text)
    return lines.join(running, text, "left_anti")


def rank_of(n: Column, share: float = 0.75) -> Column:
    """The place, from 0, of the nearest rank among ``n`` values: half to even."""
    return F.rint((n - 1) * F.lit(share)).cast("long")


def nearest_rank(df: DataFrame, column: str, share: float = 0.75) -> DataFrame:
    """One row with the value at round-half-even(share * (n - 1)) in order.

    Values are counted before they are ordered; counted values are cut into runs, and only the run that holds the rank is looked into.
    """
    known = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # a value's run is found by approximate cuts of the counted values; which run holds the rank follows from the runs' sums
    cuts = known.agg(F.percentile_approx("value", [k / 64 for k in range(1, 64)], 1000).alias("c")).first()["c"] or []
    run = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    runs = known.withColumn("run", run)
    sums = runs.groupBy("run").agg(F.sum("n").alias("n")).orderBy("run").collect()  # 64 at most
    total, before, chosen = sum(r["n"] for r in sums), 0, -1
    place = round((total - 1) * share) if total else 0
    for r in sums:
        if before + r["n"] > place:
            chosen = r["run"]
            break
        before += r["n"]
    upto = F.sum("n").over(Window.partitionBy("run").orderBy("value")) + before
    return runs.where(F.col("run") == chosen).withColumn("upto", upto).where(F.col("upto") > place).agg(F.min("value").alias("value"))


def merge_continuations(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, ord, text, hash, hashes``: paragraphs that continue the one before are joined to it; the first one's hash stays.

    A paragraph continues when it begins in lower case or with a closing sign, the one before ends no sentence, and it is on the same or the next
    page. All tests look at neighbours only, so this is a running count of breaks.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    pages = "page" in paragraphs.columns
    before = F.lag("text").over(order)
    close = (F.col("page") - F.lag("page").over(order)).isin(0, 1) if pages else F.lit(True)
    joins = before.isNotNull() & F.col("text").rlike(T.CONTINUES) & ~before.rlike(T.SENTENCE_END) & F.coalesce(close, F.lit(True))
    marked = paragraphs.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    rows = marked.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    joined = T.normalize(F.array_join(F.transform("parts", lambda p: p["text"]), " "))
    hashes = F.transform("parts", lambda p: F.sha1(F.encode(p["text"], "UTF-8")))
    return rows.select("doc_id", F.col("parts")[0]["ord"].alias("ord"), joined.alias("text"), hashes[0].alias("hash"), hashes.alias("hashes"))


#: So much of a text's beginning is kept in mind: a longer text can't be short, and a caption's label stands at its beginning.
HEAD_CHARS = 256


def _with_runs(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_run``, counted up in each document wherever a paragraph doesn't join the one before.

    Rows come in the order of their document and pass through; of what has been joined so far only its beginning, whether it ends a sentence, and its pages are kept.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begun, run, head, captioned, ended, page, ends = None, False, 0, "", False, False, None, None
        for batch in batches:
            runs = []
            columns = [batch[n].to_pylist() for n in ("doc_id", "_head", "_captioned", "_more", "_goes_on", "_ended", "_page", "_begins", "_ends")]
            for its_doc, its_head, its_captioned, more, goes_on, its_ended, its_page, its_begin, its_end in zip(*columns, strict=True):
                if not begun or its_doc != doc:
                    doc, begun, run, joins = its_doc, True, 0, False
                else:
                    if ends is not None and its_begin is not None:
                        near = its_begin - ends in (0, 1)
                    else:
                        near = page is None or its_page is None or page == its_page
                    joins = near and (more if captioned else goes_on and not ended)
                    run += not joins
                if joins:
                    head = f"{head.rstrip(' ')} {its_head.lstrip(' ')}".strip(" ")[:HEAD_CHARS] if len(head) < HEAD_CHARS else head
                    captioned, ended = is_captionish(head), its_ended
                    ends = its_end if ends is None else ends if its_end is None else max(ends, its_end)
                else:
                    head, captioned, ended, page, ends = its_head, its_captioned, its_ended, its_page, its_end
                runs.append(run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], names=[*batch.schema.names, "_run"])

    return rows.mapInArrow(walk, ty.StructType([*rows.schema.fields, ty.StructField("_run", ty.LongType())]))


def merge_captions(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, ord, text, hash``, and ``coords, page`` where given: the merge that knows captions.

    Captions take short continuations only, other paragraphs those that begin in lower case or with a closing sign, on the same or the next page.
    The tests look at the text gathered so far, of which its beginning, its end and its pages tell all they ask: a document is walked through in order, in batches, in
    time that grows with its paragraphs, and no row holds more than a run that is joined. A merged paragraph has the hash of its whole text.
    """
    more = [n for n in ("page", "coords") if n in paragraphs.columns]
    text = F.coalesce("text", F.lit(""))
    pages = F.transform("coords", lambda c: c["page"]) if "coords" in more else F.lit(None).cast("array<int>")
    flags = {
        "_head": F.left(text, F.lit(HEAD_CHARS)),
        "_captioned": T.is_caption(text) | T.continues_caption(text),
        "_more": T.continues_caption(text),
        "_goes_on": F.ltrim(text).rlike(T.CONTINUES),
        "_ended": text.rlike(T.SENTENCE_END),
        "_page": (F.col("page") if "page" in more else F.lit(None)).cast("int"),
        "_begins": F.array_min(pages).cast("int"),
        "_ends": F.array_max(pages).cast("int"),
    }
    rows = paragraphs.select("doc_id", "ord", "text", *more, *[c.alias(n) for n, c in flags.items()]).repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    part = F.struct("ord", "text", *more)
    runs = _with_runs(rows).groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(part)).alias("run"))
    texts = F.transform("run", lambda x: x["text"])
    joined = F.when(F.size("run") == 1, texts[0]).otherwise(F.array_join(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), " "))
    made = runs.select("doc_id", F.col("run")[0]["ord"].alias("ord"), joined.alias("text"), "run").withColumn("hash", T.content_hash(F.col("text")))
    whole = {"page": lambda: F.col("run")[0]["page"], "coords": lambda: F.flatten(F.transform("run", lambda x: F.coalesce(x["coords"], F.array())))}
    return made.select("doc_id", "ord", "text", "hash", *[whole[n]().alias(n) for n in more])


def after_latch(paragraphs: DataFrame, opens: Column, each: Column | None = None) -> DataFrame:
    """Without what follows the first row that ``opens``, that row, and rows that ``each`` names."""
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    latched = F.max(F.when(opens, 1).otherwise(0)).over(order)
    kept = paragraphs.withColumn("_latch", latched).where("_latch = 0").drop("_latch")
    return kept if each is None else kept.where(~each)


def cut_references(paragraphs: DataFrame, least_ratio: float = 0.30, sure_ratio: float = 0.85) -> DataFrame:
    """Without the reference list and what follows: from the first heading of one that stands late enough.

    Its place is its first page among the document's (``pages``, else ``page``, else its row). It counts when it has entries in
    itself, when one of the next two paragraphs looks like an entry, or when it stands very late. Captions never count.
    """
    doc, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("ord")
    text = F.col("text")
    if "pages" in paragraphs.columns:
        ratio = F.coalesce(F.array_min("pages"), F.lit(1)) / F.max(F.array_max("pages")).over(doc)
    elif "page" in paragraphs.columns:
        ratio = F.coalesce("page", F.lit(1)) / F.max("page").over(doc)
    else:
        ratio = (F.row_number().over(order) - 1) / F.greatest(F.count("*").over(doc) - 1, F.lit(1))
    entry = T.reference_score(text) >= 2
    near = F.coalesce(F.lead(entry, 1).over(order), F.lit(False)) | F.coalesce(F.lead(entry, 2).over(order), F.lit(False))
    marked = paragraphs.withColumn("_ratio", ratio).withColumn("_near", near)
    merged = (F.length(text) >= 120) | (F.regexp_count(text, F.lit(r"\b(?:19|20)\d{2}\b")) >= 3) | F.upper(text).startswith("REFERENCES ")
    opens = text.rlike(T.REFERENCE_SECTION) & (F.col("_ratio") >= least_ratio) & (merged | F.col("_near") | (F.col("_ratio") >= sure_ratio))
    if "caption" in paragraphs.columns:
        opens = opens & ~F.col("caption")
    return after_latch(marked, opens).drop("_ratio", "_near")


def with_context(df: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("prev_text", F.coalesce(F.lag(text).over(w), F.lit(""))).withColumn("next_text", F.coalesce(F.lead(text).over(w), F.lit("")))
