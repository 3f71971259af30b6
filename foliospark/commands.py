"""One function for each thing a user does: they take tables and settings and return tables; sinks write what they return.

``Library`` holds the tables: ``items(key, version, tags, title, data)``, ``files(key, parent, ord, content_type)``, ``dumps`` (layout
by ``doc_id``, the file's key), ``annotations(key, pdf, version, data, tags)`` and, where known, ``sizes(doc_id, page_index, w, h)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .operators import adapter, enrich, layout, library, providers
from .operators import annotations as A
from .operators import paragraphs as P
from .operators import reconcile as R
from .sources import layout_json, scratch


@dataclass
class Library:
    items: DataFrame
    files: DataFrame
    dumps: DataFrame
    annotations: DataFrame
    sizes: DataFrame | None = None


@dataclass
class Run:
    """What a run did: the plan of all paragraphs, the payloads to create, item tags after it, and a row for each item."""

    plan: DataFrame
    payloads: DataFrame
    items: DataFrame
    summary: DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, into the shared folder, for what several results of a run are made of."""
    return scratch.written(rows, "run")


def validated(tag: str | None = None, item_keys: list | None = None, max_items: int = 10, delete_broken: bool = False, keep_broken: bool = False) -> None:
    if max_items < 1:
        raise ValueError("max_items must be at least 1")
    if tag and item_keys:
        raise ValueError("either tag or item_keys, not both")
    if delete_broken and keep_broken:
        raise ValueError("at most one of delete_broken and keep_broken")


def search(held: Library, settings: Settings, tags: list[str] | None = None, max_items: int = 20) -> DataFrame:
    """Items with any of the tags, those that are done in part first."""
    validated(max_items=max_items)
    found = library.search(held.items, tags or [settings.target_tag, settings.base_done_tag], settings.base_done_tag, max_items)
    return library.console_table(found)


def _targets(held: Library, settings: Settings, tag: str | None, item_keys: list | None, max_items: int) -> DataFrame:
    """``item, doc_id, found``: the items of a run with their first PDF; without one ``doc_id`` is null."""
    validated(tag, item_keys, max_items)
    chosen = library.selected_items(held.items, item_keys, tag or settings.target_tag, max_items).select(F.col("key").alias("item"), "found")
    pdf = library.first_pdf(held.files).select(F.col("parent").alias("item"), F.col("key").alias("doc_id"))
    return settled(chosen.join(pdf, "item", "left"))


def paragraphs(held: Library, settings: Settings, doc_ids: DataFrame | None = None) -> DataFrame:
    """The kept paragraphs of all dumps, or of those asked for; numbered anew in each document."""
    dumps = held.dumps if doc_ids is None else held.dumps.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return settled(adapter.extracted(dumps, settings))


def preview(held: Library, settings: Settings, doc_ids: DataFrame, max_rows: int = 20) -> DataFrame:
    return layout_json.preview(paragraphs(held, settings, doc_ids), max_rows)


def _candidates(rows: DataFrame, settings: Settings) -> DataFrame:
    """The position fields of each paragraph by each of its tags."""
    fields = A.position_fields(F.col("coords"), F.lit(A.pos.DEFAULT_H), F.lit(A.pos.DEFAULT_W), F.col("page"))
    placed = rows.select(F.col("doc_id").alias("pdf"), A.dedup_tags(F.col("dedup_hashes"), settings.dedup_prefix).alias("tags"), fields.alias("fields"), F.col("ord").alias("rank"))
    return placed.select("pdf", F.explode("tags").alias("tag"), "fields", "rank")


def _answers(rows: DataFrame, item: str, order: str, settings: Settings, transport, ledger: str | None, context: bool) -> DataFrame:
    """``rows`` with answers, none after an item's first failure: from a ledger where there is one, else computed once."""
    if ledger:
        return enrich.translated_with_ledger(rows, item, order, ledger, settings, context=context, transport=transport)
    return scratch.written(enrich.translated_in_order(rows, item, order, context=context, settings=settings, transport=transport), "answers")


def _annotated(held: Library, settings: Settings, tag, item_keys, max_items: int, read_only: bool, keep_broken: bool, translate: bool, transport, ledger: str | None = None) -> Run:
    targets = _targets(held, settings, tag, item_keys, max_items)
    rows = paragraphs(held, settings, targets)
    mine = held.annotations.join(targets.select(F.col("doc_id").alias("pdf")).distinct(), "pdf", "left_semi")
    places = _candidates(rows, settings)
    healed, health = A.self_healed(mine, places, settings.repair_broken, settings.delete_broken and not keep_broken, read_only, settings.dedup_prefix)
    healed, health = settled(healed), settled(health)
    existing = healed.select(F.col("pdf").alias("doc_id"), F.explode("tags").alias("tag"))
    failed = None
    if translate:
        capped = P.with_context(rows, "doc_id", "ord").transform(lambda df: R.capped(df, "doc_id", "ord", settings.max_paragraphs))
        fresh = A.planned(capped, existing, held.sizes, settings.max_paragraphs, settings.dedup_prefix).where("not duplicate").drop("payload", "duplicate", "tags")
        answered = enrich.with_sources(_answers(fresh, "doc_id", "ord", settings, transport, ledger, True))
        failed = answered.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "ord").alias("error"))
        comments = answered.select("doc_id", "ord", "comment")
        rows = rows.join(comments, ["doc_id", "ord"], "left")
    plan = A.planned(rows, existing, held.sizes, settings.max_paragraphs, settings.dedup_prefix, (settings.pending_tag,), settings.annotation_mode)
    if failed is not None:
        # one failure voids its item
        plan = plan.join(failed, "doc_id", "left").withColumn("payload", F.when(F.col("error").isNull(), F.col("payload")))
    plan = settled(plan)
    payloads = plan.where("payload is not null").select("doc_id", "ord", "payload.*")
    totals = targets.join(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("item", "doc_id", F.coalesce("n", F.lit(0)).alias("total"))
    summary = A.item_summary(plan, totals.where("doc_id is not null").select("doc_id", "total"))
    required = rows.select("doc_id", F.explode(A.dedup_tags(F.col("dedup_hashes"), settings.dedup_prefix)).alias("tag")).join(totals.select("doc_id", F.col("total").alias("paragraphs")), "doc_id")
    available = existing.unionByName(plan.where("payload is not null").select("doc_id", F.explode("tags").alias("tag")))
    done = A.complete(required, available, settings.max_paragraphs, read_only).where("complete").join(targets.select("item", "doc_id"), "doc_id").select(F.col("item").alias("key"))
    gone = [settings.remove_tag, *([settings.base_done_tag] if translate else [])]
    changes = done.select("key", F.array(F.lit(settings.done_tag if translate else settings.base_done_tag)).alias("add"), F.array(*[F.lit(t) for t in gone]).alias("remove"))
    shown = targets.join(summary, "doc_id", "left").join(health.withColumnRenamed("pdf", "doc_id"), "doc_id", "left")
    reasons = [("item_not_found", ~F.col("found")), ("no_pdf", F.col("doc_id").isNull())]
    if failed is not None:
        shown, reasons = shown.join(failed, "doc_id", "left"), [*reasons, ("translation_failed", F.col("error").isNotNull())]
    shown = A.with_errors(shown, "item", reasons)
    return Run(plan, payloads.limit(0) if read_only else payloads, library.retagged(held.items, changes), shown)


def base(held: Library, settings: Settings, tag: str | None = None, item_keys: list | None = None, max_items: int = 10, read_only: bool = False, keep_broken: bool = False) -> Run:
    """Annotations with the paragraphs as they are, tagged as pending; an item whose paragraphs are all there moves on."""
    return _annotated(held, settings, tag, item_keys, max_items, read_only, keep_broken, False, None)


def run(held: Library, settings: Settings, tag: str | None = None, item_keys: list | None = None, max_items: int = 10, read_only: bool = False, keep_broken: bool = False, transport: providers.Transport = providers.send, ledger: str | None = None) -> Run:
    """Annotations with translated paragraphs, made with their neighbours, and the snippet of their source. An item's first failure ends its calls and voids it.

    Answers are kept in the ledger at the path given, and aren't asked for again.
    """
    return _annotated(held, settings, tag, item_keys, max_items, read_only, keep_broken, True, transport, ledger)


def translate(held: Library, settings: Settings, tag: str | None = None, item_keys: list | None = None, max_items: int = 10, read_only: bool = False, transport: providers.Transport = providers.send, ledger: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending annotations with their texts translated in place: the annotations, the items, and counts for each item.

    Texts go without neighbours and without snippet. After an item's first failure nothing of it is sent; answers are kept in the ledger at the path given. An item without pending annotations moves on.
    """
    targets = _targets(held, settings, tag or settings.base_done_tag, item_keys, max_items)
    mine = held.annotations.join(targets.select(F.col("doc_id").alias("pdf")).distinct(), "pdf", "left_semi")
    matched = A.translation_targets(mine, settings.pending_tag, settings.translated_tag, settings.dedup_prefix)
    matched = settled(matched)
    counts = A.target_counts(matched)
    asked = _answers(matched.where("match = 'target' and text <> ''"), "pdf", "key", settings, transport, ledger, False).drop("calls")
    rest = matched.where("not (match = 'target' and text <> '')").withColumn("answer", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    written = A.with_answers(asked.unionByName(rest), "pdf", "key", settings.pending_tag, settings.translated_tag)
    after = mine.withColumn("updated", F.lit(False)) if read_only else settled(written)
    stats = counts.join(after.groupBy("pdf").agg(F.count_if("updated").alias("updated")), "pdf", "left")
    pending = after.groupBy("pdf").agg(F.count_if(F.array_contains("tags", settings.pending_tag)).alias("pending"))
    finished = targets.join(pending, F.col("doc_id") == F.col("pdf"), "left").where(F.coalesce("pending", F.lit(0)) == 0).where("found and doc_id is not null")
    changes = finished.select(F.col("item").alias("key"), F.array(F.lit(settings.done_tag)).alias("add"), F.array(F.lit(settings.base_done_tag)).alias("remove"))
    items = held.items if read_only else library.retagged(held.items, changes)
    return after.select(*mine.columns, "updated"), items, stats


def probe(held: Library, settings: Settings, doc_ids: DataFrame, index: int, read_only: bool = False) -> DataFrame:
    """One paragraph of each document as it would be annotated."""
    existing = held.annotations.select(F.col("pdf").alias("doc_id"), F.explode("tags").alias("tag"))
    rows = paragraphs(held, settings, doc_ids)
    number = F.row_number().over(P.Window.partitionBy("doc_id").orderBy("ord")) - 1
    return A.probed(rows.withColumn("ord", number), existing, index, read_only, settings.dedup_prefix, settings.annotation_mode)


def probe_translation(held: Library, settings: Settings, doc_ids: DataFrame, index: int, transport: providers.Transport = providers.send) -> DataFrame:
    """One paragraph of each document translated, with its neighbours; ``status`` ok or error."""
    rows = P.with_context(paragraphs(held, settings, doc_ids), "doc_id", "ord")
    number = F.row_number().over(P.Window.partitionBy("doc_id").orderBy("ord")) - 1
    one = rows.withColumn("_n", number).where(F.col("_n") == index)
    made = enrich.translated(one, settings=settings, transport=transport)
    return made.select("doc_id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "hash", "answer", "error")


def dump_xml(held: Library, settings: Settings, doc_ids: DataFrame, path: str) -> None:
    """All paragraphs of the asked dumps as XML, captions too unless the settings skip them."""
    layout_json.write_paragraphs_xml(reconstruct(held.dumps.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi"), settings.skip_captions), path)


def dump_page_texts(held: Library) -> tuple[DataFrame, DataFrame]:
    """The plain text of each page, and totals of each document."""
    pages = layout.pages_of(held.dumps).select("doc_id", (F.col("page_index") + 1).alias("page"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
    texts = layout_json.page_texts(pages)
    return texts, layout_json.page_totals(texts)


def dump_layout(held: Library, path: str) -> None:
    layout_json.write_json(held.dumps, path)


def reconstruct(dumps: DataFrame, skip_captions: bool = False) -> DataFrame:
    """The paragraphs of layout dumps, offline."""
    rows = layout.document_paragraphs(dumps)
    return rows.where("not caption") if skip_captions else rows


def repair_annotations(held: Library, settings: Settings, read_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Broken annotations with the places of the paragraphs they belong to, and counts of what was repaired, unmatched and untagged."""
    found = A.repaired(held.annotations, _candidates(paragraphs(held, settings), settings), settings.dedup_prefix)
    counts = found.groupBy("pdf").agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in ("repaired", "unmatched", "untagged", "sound")])
    return (held.annotations if read_only else A.with_repairs(found)), counts


def delete_broken_annotations(held: Library, read_only: bool = False) -> tuple[DataFrame, DataFrame]:
    after, status = A.without_broken(held.annotations)
    return (held.annotations if read_only else after), status


def delete_all_annotations(held: Library, pdfs: DataFrame, read_only: bool = False) -> tuple[DataFrame, DataFrame]:
    after, status = A.without_all(held.annotations, pdfs)
    return (held.annotations if read_only else after), status


def audit_annotations(held: Library, settings: Settings) -> DataFrame:
    """For each document the hashes that no annotation has, by the settings and without length limits, and the annotations that lack fields. Layouts are read once for both."""
    everything = replace(settings, min_chars=0, max_chars=max(settings.max_chars, 20_000))
    have = held.annotations.select(F.col("pdf").alias("doc_id"), F.explode("tags").alias("tag")).distinct()
    whole = settled(layout.document_paragraphs(held.dumps))

    def missing(s: Settings, name: str) -> DataFrame:
        wanted = adapter.kept_paragraphs(whole, s).select("doc_id", F.explode(A.dedup_tags(F.col("dedup_hashes"), s.dedup_prefix)).alias("tag")).distinct()
        return R.unseen(wanted, have, ["doc_id", "tag"]).groupBy("doc_id").agg(F.count("*").alias(name))

    from .functions import text as T

    field = lambda n: F.coalesce(F.trim(F.try_element_at("data", F.lit(n))), F.lit(""))
    place = field(A.PLACE)
    faults = held.annotations.groupBy(F.col("pdf").alias("doc_id")).agg(
        F.count("*").alias("annotations"),
        F.count_if(field(A.SORT) == "").alias("missing_sort"),
        F.count_if(field(A.LABEL) == "").alias("missing_label"),
        F.count_if(place == "").alias("missing_position"),
        F.count_if((place != "") & ~T.is_json(place)).alias("invalid_position"),
    )
    docs = held.dumps.select("doc_id").distinct()
    both = docs.join(missing(settings, "missing_filtered"), "doc_id", "left").join(missing(everything, "missing_all"), "doc_id", "left").join(faults, "doc_id", "left")
    return both.na.fill(0)
