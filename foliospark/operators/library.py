"""Items of a library as tables: scans by tag, lookups, children, first attachment, and writes that check versions.

``items(key, version, tags, ...)``; what the library stores of an item beside that is a map ``data``, where a missing key is not a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reconcile as R


def tag_names(tags: Column) -> Column:
    """The non-blank names of an array of tag structs."""
    return F.filter(F.transform(F.coalesce(tags, F.array()), lambda t: t["tag"]), lambda t: t.isNotNull() & (F.trim(t) != ""))


def items_by_tag(items: DataFrame, tag: str, most: int | None = None, key: str = "key") -> DataFrame:
    """Items with a tag, in the order of their keys where capped; the filter reaches the scan."""
    found = items.where(F.array_contains("tags", tag))
    return found if most is None else found.orderBy(key).limit(most)


def looked_up(keys: DataFrame, items: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with their items; a key without item keeps its row, with ``found`` false."""
    return keys.join(items.withColumn("_found", F.lit(True)), key, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def selected_items(items: DataFrame, keys: list[str] | None = None, tag: str | None = None, most: int = 10, key: str = "key") -> DataFrame:
    """The items of a run: explicit keys, each once in the order given, capped, also those without item; else those with a tag."""
    if not keys:
        return items_by_tag(items, tag or "", most, key).withColumn("found", F.lit(True))
    kind = items.schema[key].dataType
    wanted = items.sparkSession.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys(k for k in keys if k not in (None, ""))) if i < most], "pos long, k string")
    wanted = wanted.select("pos", F.col("k").cast(kind).alias(key))
    return looked_up(F.broadcast(wanted), items, key)  # at most `most` keys


def children_of(parents: DataFrame, children: DataFrame, key: str = "key", parent: str = "parent") -> DataFrame:
    return parents.join(children, parents[key] == children[parent])


def annotations_of(parents: DataFrame, children: DataFrame, key: str = "key", parent: str = "parent", kind: str = "item_type") -> DataFrame:
    """Children that are annotations; the test is made before the join, so other children aren't shuffled."""
    return children_of(parents, children.where(F.col(kind) == "annotation"), key, parent)


def first_pdf(children: DataFrame, parent: str = "parent", order: tuple[str, ...] = ("ord",), content_type: str = "content_type") -> DataFrame:
    """For each parent its first child whose content type names a PDF. ``order`` should tell children of a parent apart, else any of equal ones may come."""
    return R.first_of_kind(children.where(F.lower(F.col(content_type)).contains("pdf")), parent, [F.col(n) for n in order])


def search(items: DataFrame, tags: list[str], first: str, most: int = 20, key: str = "key") -> DataFrame:
    """Items with any of the tags, with ``matched`` in the order asked; those with ``first`` lead, then by key."""
    hits = items.withColumn("matched", R.matched_tags(F.col("tags"), list(dict.fromkeys(tags)))).where(F.size("matched") > 0)
    return hits.orderBy(F.array_contains("matched", first).desc(), key).limit(most)


def _accepted() -> Column:
    return F.coalesce(F.col("_expected").isNull() | (F.col("_expected") == F.col("version")), F.lit(False))


def updated(items: DataFrame, changes: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The items after ``changes(key, expected, data)``, and ``key, status`` of each change: updated, conflict or missing.

    A change holds where its expected version is the item's, or null; keys of ``data`` replace the item's, the version goes up by one.
    One change a key is applied, that with the highest expected version.
    """
    one = changes.groupBy(key).agg(F.max_by(F.struct("expected", "data"), F.coalesce("expected", F.lit(-1))).alias("c")).select(key, F.col("c.expected").alias("_expected"), F.col("c.data").alias("_data"), F.lit(True).alias("_asked"))
    both = items.join(one, key, "left")
    go = F.coalesce(F.col("_asked"), F.lit(False)) & _accepted()
    kept = F.map_filter("data", lambda k, _v: ~F.array_contains(F.map_keys("_data"), k))
    after = both.withColumn("data", F.when(go, F.map_concat(kept, "_data")).otherwise(F.col("data"))).withColumn("version", F.when(go, F.col("version") + 1).otherwise(F.col("version")))
    status = one.join(items.select(key, "version"), key, "left").select(key, F.when(F.col("version").isNull(), "missing").when(_accepted(), "updated").otherwise("conflict").alias("status"))
    return after.select(items.columns), status


def deleted(items: DataFrame, wanted: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The items without those of ``wanted(key, expected)`` whose version is as expected, or null; and ``key, status``: deleted, conflict or missing."""
    asked = wanted.groupBy(key).agg(F.max("expected").alias("_expected"))
    status = asked.join(items.select(key, "version"), key, "left").select(key, F.when(F.col("version").isNull(), "missing").when(_accepted(), "deleted").otherwise("conflict").alias("status"))
    return items.join(status.where("status = 'deleted'").select(key), key, "left_anti"), status


def retagged(items: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """Items with the tags of ``changes(key, add, remove)``, read as they stand now; where these change nothing the version stays."""
    both = items.join(changes.select(key, F.col("add").alias("_add"), F.col("remove").alias("_remove")), key, "left")
    after = F.when(F.col("_add").isNotNull(), R.merged_tags(F.col("tags"), F.col("_add"), F.col("_remove"))).otherwise(F.col("tags"))
    rows = both.withColumn("_after", after).withColumn("version", F.col("version") + (F.array_sort("tags") != F.array_sort("_after")).cast("int"))
    return rows.withColumn("tags", F.col("_after")).select(items.columns)


def console_table(items: DataFrame, chars: int = 40) -> DataFrame:
    """What a search shows: number, matched tags, key, and title and tags cut to fit."""
    from ..functions import text as T

    shown = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("-")
    number = F.row_number().over(Window.orderBy(F.array_contains("matched", F.col("matched")[0]).desc(), "key"))
    return items.select(number.alias("n"), shown(F.col("matched")).alias("matched_tags"), "key", T.truncate(T.normalize(F.col("title")), chars).alias("title"), T.truncate(shown(F.col("tags")), chars).alias("tags"))
