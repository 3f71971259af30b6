"""Annotations: what is written for a paragraph, what is wrong with stored ones, and what a run did to an item.

``annotations(key, pdf, version, data, tags)``: ``data`` is a map of strings, in which a missing key is not a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import position as pos
from . import reconcile as R
from .library import deleted

# The names of fields, of which results are made.
SORT, LABEL, PLACE = "annotationSortIndex", "annotationPageLabel", "annotationPosition"
COMMENT, NOTE = "annotationComment", "note"


def body_field(data: Column) -> Column:
    """The field that holds an annotation's text: the comment where there is such a key, else the note, else the comment."""
    has = lambda k: F.map_contains_key(data, F.lit(k))
    return F.when(has(COMMENT), COMMENT).when(has(NOTE), NOTE).otherwise(COMMENT)


def body(data: Column) -> Column:
    return F.trim(F.coalesce(F.try_element_at(data, body_field(data)), F.lit("")))


def is_broken(data: Column) -> Column:
    return R.is_broken(F.try_element_at(data, F.lit(SORT)), F.try_element_at(data, F.lit(LABEL)), F.try_element_at(data, F.lit(PLACE)))


def dedup_tags(hashes: Column, prefix: str = "para:") -> Column:
    return F.transform(hashes, lambda h: F.concat(F.lit(prefix), h))


def position_fields(coords: Column, page_h: Column, page_w: Column, page: Column | None = None) -> Column:
    """A note's position as JSON text, its page label and sort index."""
    p = pos.note_position(coords, page_h, page_w, page)

    def fields(p: Column) -> Column:
        place = F.struct(p["page_index"].alias("pageIndex"), F.array(F.array(*[p[n] for n in ("x1", "y1", "x2", "y2")])).alias("rects"), F.lit(0).alias("rotation"))
        return F.struct(F.to_json(place).alias(PLACE), (p["page_index"] + 1).cast("string").alias(LABEL), p["sort_index"].alias(SORT))

    return T.bound(p, fields)


def payload(pdf: Column, comment: Column, fields: Column, tags: Column, mode: str = "note") -> Column:
    """What is sent to create an annotation: a note, or a small highlight, at the paragraph's place."""
    named = F.filter(tags, lambda t: t.isNotNull() & (F.trim(t) != ""))
    made = [F.lit("annotation").alias("itemType"), pdf.alias("parentItem"), F.lit(mode).alias("annotationType"), comment.alias(COMMENT)]
    return F.struct(*made, *[fields[n].alias(n) for n in (PLACE, LABEL, SORT)], F.transform(named, lambda t: F.struct(t.alias("tag"))).alias("tags"))


def planned(paragraphs: DataFrame, existing: DataFrame, sizes: DataFrame | None = None, most: int | None = 100, prefix: str = "para:", extra: tuple[str, ...] = ("za:translate",), mode: str = "note") -> DataFrame:
    """The first ``most`` paragraphs of each document, all for None, with ``duplicate`` and the ``payload`` of those without a stored tag.

    ``paragraphs(doc_id, ord, text, hash, dedup_hashes, coords, page)``, with ``comment`` where texts are translated, else with the ``extra``
    tags; ``existing(doc_id, tag)``; ``sizes(doc_id, page_index, w, h)``, else a common page.
    """
    rows = R.capped(paragraphs, "doc_id", "ord", most).withColumn("tags", dedup_tags(F.coalesce("dedup_hashes", F.array("hash")), prefix))
    known = existing.select("doc_id", F.col("tag").alias("_tag")).distinct()
    seen = rows.select("doc_id", "ord", F.explode("tags").alias("_tag")).join(known, ["doc_id", "_tag"], "left_semi").select("doc_id", "ord").distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(seen, ["doc_id", "ord"], "left").withColumn("duplicate", F.coalesce("_seen", F.lit(False))).drop("_seen")
    index = F.greatest(F.coalesce(F.try_element_at("coords", F.lit(1))["page"], F.col("page"), F.lit(1)) - 1, F.lit(0))
    rows = rows.withColumn("page_index", index)
    rows = pos.page_size(rows, sizes) if sizes is not None else rows.withColumn("w", F.lit(None).cast("double")).withColumn("h", F.lit(None).cast("double"))
    fields = position_fields(F.col("coords"), F.coalesce("h", F.lit(pos.DEFAULT_H)), F.coalesce("w", F.lit(pos.DEFAULT_W)), F.col("page"))
    given = "comment" in paragraphs.columns
    tags = F.col("tags") if given else F.concat("tags", F.array(*[F.lit(t) for t in extra]))
    made = payload(F.col("doc_id").cast("string"), F.col("comment" if given else "text"), fields, tags, mode)
    return rows.withColumn("payload", F.when(~F.col("duplicate"), made)).drop("page_index", "w", "h")


def item_summary(plan: DataFrame, totals: DataFrame, item: str = "doc_id") -> DataFrame:
    """``total, processed, duplicates, planned`` of each item; ``totals(item, total)`` counts all paragraphs, beyond the cap too."""
    done = plan.groupBy(item).agg(F.count("*").alias("processed"), F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("duplicate")).alias("planned"))
    zero = F.lit(0).cast("long")
    return totals.join(done, item, "left").select(item, "total", *[F.coalesce(n, zero).alias(n) for n in ("processed", "duplicates", "planned")])


def complete(required: DataFrame, available: DataFrame, most: int = 100, read_only: bool = False, item: str = "doc_id") -> DataFrame:
    """``item, complete``: whether all of ``required(item, tag)`` are in ``available(item, tag)``; never when read only, or when the cap hid paragraphs.

    ``required`` has a row for each tag of each paragraph, with ``paragraphs``, their number in the item.
    """
    have = available.select(item, "tag").distinct().withColumn("_have", F.lit(True))
    each = required.join(have, [item, "tag"], "left").groupBy(item).agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("all"), F.max("paragraphs").alias("n"))
    return each.select(item, (F.col("all") & (F.col("n") <= most) & F.lit(not read_only)).alias("complete"))


def repaired(annotations: DataFrame, candidates: DataFrame, prefix: str = "para:") -> DataFrame:
    """``annotations`` with ``repair``: of broken ones with a hash tag that a paragraph has, the new position fields; and why others have none.

    ``candidates(pdf, tag, fields, rank)``. The first of an annotation's tags with a paragraph counts; of paragraphs with one tag the last.
    ``outcome``: sound, repaired, unmatched, or untagged where no tag has the prefix.
    """
    mine = F.filter("tags", lambda t: t.startswith(prefix))
    rows = annotations.withColumn("_broken", is_broken(F.col("data"))).withColumn("_mine", mine)
    asked = rows.where("_broken").select("key", "pdf", F.posexplode("_mine").alias("tag_ord", "tag"))
    last = candidates.groupBy("pdf", "tag").agg(F.max_by("fields", "rank").alias("fields"))
    found = asked.join(last, ["pdf", "tag"]).groupBy("key").agg(F.min_by("fields", "tag_ord").alias("repair"))
    outcome = F.when(F.size("_mine") == 0, "untagged").when(~F.col("_broken"), "sound").when(F.col("repair").isNotNull(), "repaired").otherwise("unmatched")
    return rows.join(found, "key", "left").withColumn("outcome", outcome).drop("_broken", "_mine")


def with_repairs(repairs: DataFrame) -> DataFrame:
    """The annotations of ``repaired`` with the new fields in their data."""
    names = (PLACE, LABEL, SORT)
    kept = F.map_filter("data", lambda k, _v: ~k.isin(*names))
    made = F.map_concat(kept, F.create_map(*[x for n in names for x in (F.lit(n), F.col("repair")[n])]))
    return repairs.withColumn("data", F.when(F.col("repair").isNotNull(), made).otherwise(F.col("data"))).drop("repair", "outcome")


def without_broken(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound annotations, and the status of each deletion."""
    return deleted(annotations, annotations.where(is_broken(F.col("data"))).select("key", F.col("version").alias("expected")))


def without_all(annotations: DataFrame, pdfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations of other PDFs than ``pdfs(pdf)``, and the status of each deletion."""
    return deleted(annotations, annotations.join(pdfs.select("pdf").distinct(), "pdf", "left_semi").select("key", F.col("version").alias("expected")))


def broken_counts(annotations: DataFrame, prefix: str = "para:") -> DataFrame:
    """``pdf, broken, tagged``: how many lack a field, and of these how many have a hash tag."""
    bad = is_broken(F.col("data"))
    tagged = bad & F.exists("tags", lambda t: t.startswith(prefix))
    return annotations.groupBy("pdf").agg(F.count_if(bad).alias("broken"), F.count_if(tagged).alias("tagged"))


def self_healed(annotations: DataFrame, candidates: DataFrame, repair: bool = True, delete: bool = True, read_only: bool = False, prefix: str = "para:") -> tuple[DataFrame, DataFrame]:
    """The annotations after repair, then deletion of what is broken still, and ``pdf, broken, tagged, repaired, deleted``.

    Read only, nothing changes and nothing is counted.
    """
    zero = F.lit(0).cast("long")
    if read_only:
        return annotations, annotations.select("pdf").distinct().select("pdf", *[zero.alias(n) for n in ("broken", "tagged", "repaired", "deleted")])
    counts = broken_counts(annotations, prefix)
    after = annotations
    if repair:
        fixed = repaired(annotations, candidates, prefix)
        counts = counts.join(fixed.groupBy("pdf").agg(F.count_if(F.col("outcome") == "repaired").alias("repaired")), "pdf", "left")
        after = with_repairs(fixed)
    else:
        counts = counts.withColumn("repaired", zero)
    left = after.where(is_broken(F.col("data"))).groupBy("pdf").agg(F.count("*").alias("deleted"))
    counts = counts.join(left, "pdf", "left") if delete else counts.withColumn("deleted", zero)
    after = after.where(~is_broken(F.col("data"))) if delete else after
    return after.select(annotations.columns), counts.select("pdf", "broken", "tagged", *[F.coalesce(n, zero).alias(n) for n in ("repaired", "deleted")])


def translation_targets(annotations: DataFrame, pending: str = "za:translate", done: str = "za:translated", prefix: str = "para:") -> DataFrame:
    """``annotations`` with ``match``: translated, other, or target; of targets the text, and what is odd about their hash tags."""
    good, bad = R.split_para_tags(F.col("tags"), prefix)
    match = F.when(F.array_contains("tags", done), "translated").when(~F.array_contains("tags", pending), "other").otherwise("target")
    return annotations.withColumn("match", match).withColumn("field", body_field(F.col("data"))).withColumn("text", body(F.col("data"))).withColumn("good_tags", F.size(good)).withColumn("bad_tags", F.size(bad))


def target_counts(targets: DataFrame, item: str = "pdf") -> DataFrame:
    is_ = lambda m: F.col("match") == m
    mine = is_("target")
    return targets.groupBy(item).agg(
        F.count_if(is_("translated")).alias("already"),
        F.count_if(is_("other")).alias("not_pending"),
        F.count_if(mine).alias("targeted"),
        F.count_if(mine & (F.col("good_tags") == 0)).alias("untagged"),
        F.count_if(mine & (F.col("bad_tags") > 0)).alias("invalid"),
        F.count_if(mine & (F.col("good_tags") > 1)).alias("several"),
        F.count_if(mine & (F.col("text") == "")).alias("blank"),
    )


def with_answers(targets: DataFrame, item: str = "pdf", order: str = "key", pending: str = "za:translate", done: str = "za:translated") -> DataFrame:
    """Targets with ``answer, error``, those before an item's first error written: the text in its field, the tags moved on. ``updated`` tells which."""
    go = R.before_error(targets, item, order, F.col("error").isNotNull()) & (F.col("match") == "target") & (F.col("text") != "") & F.col("answer").isNotNull()
    rows = targets.withColumn("updated", F.coalesce(go, F.lit(False)))
    kept = F.map_filter("data", lambda k, _v: k != F.col("field"))
    data = F.when(F.col("updated"), F.map_concat(kept, F.create_map("field", "answer"))).otherwise(F.col("data"))
    tags = F.when(F.col("updated"), R.merged_tags(F.col("tags"), F.array(F.lit(done)), F.array(F.lit(pending)))).otherwise(F.col("tags"))
    return rows.withColumn("data", data).withColumn("tags", tags)


def probed(paragraphs: DataFrame, existing: DataFrame, index: int, read_only: bool = False, prefix: str = "para:", mode: str = "note") -> DataFrame:
    """One paragraph of each document, that with number ``index``: ``doc_id, status, hash, payload``.

    Status: error where the document has fewer, duplicate where a tag of it is stored, read_only, else created; the tests come before any translation.
    """
    docs = paragraphs.groupBy("doc_id").agg(F.count("*").alias("_n"))
    one = planned(paragraphs.where(F.col("ord") == index), existing, most=1, prefix=prefix, extra=(), mode=mode).select("doc_id", "hash", "duplicate", "payload")
    status = F.when(F.col("duplicate").isNull(), "error").when(F.col("duplicate"), "duplicate").otherwise("read_only" if read_only else "created")
    return docs.join(one, "doc_id", "left").select("doc_id", status.alias("status"), "hash", "payload")


def create_summary(responses: DataFrame, planned_column: str = "planned") -> DataFrame:
    """``responses`` with ``created, failed, samples, recognised`` from ``response``, the JSON text of an answer to a batch.

    A list stands for what was created; an object has maps of successful and failed rows, up to three of which are sampled; anything else,
    an object with neither too, counts as all planned.
    """
    v = F.try_parse_json("response")
    as_list = F.try_variant_get(v, "$", "array<variant>")
    part = lambda p: F.try_variant_get(v, p, "map<string,variant>")
    rows = responses.withColumn("_list", as_list).withColumn("_good", part("$.successful")).withColumn("_bad", part("$.failed"))
    good, bad = (F.coalesce(F.size(F.map_keys(c)), F.lit(0)) for c in ("_good", "_bad"))
    known = F.col("_list").isNotNull() | (good > 0) | (bad > 0)
    created = F.when(F.col("_list").isNotNull(), F.size("_list")).when(known, good).otherwise(F.col(planned_column))
    samples = F.slice(F.array_sort(F.coalesce(F.map_keys("_bad"), F.array())), 1, 3)
    return rows.withColumn("created", created.cast("long")).withColumn("failed", bad.cast("long")).withColumn("samples", samples).withColumn("recognised", known).drop("_list", "_good", "_bad")


def with_errors(stages: DataFrame, item: str, order: list[tuple[str, Column]]) -> DataFrame:
    """``stages`` with ``skipped_reason``: the first stage whose test says it failed, by name; items go on regardless of others."""
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in order])
    return stages.withColumn("skipped_reason", reason)
