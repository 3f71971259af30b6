"""Operators that compare paragraphs with what is stored: tags, repair, audit, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unseen(paragraphs: DataFrame, existing: DataFrame, key: str | list[str] = "hash") -> DataFrame:
    """Paragraphs without a stored hash. Equal ones within a batch all stay."""
    return paragraphs.join(existing.select(key).distinct(), key, "left_anti")


def capped(paragraphs: DataFrame, item: str, order: str, most: int | None = 100) -> DataFrame:
    """The first ``most`` of each item, duplicates counted, before they are matched; all for None."""
    if most is None:
        return paragraphs
    rank = F.row_number().over(Window.partitionBy(item).orderBy(order))
    return paragraphs.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def merged_tags(current: Column, add: Column, remove: Column) -> Column:
    """Union less what goes, sorted; removal wins."""
    return F.array_sort(F.array_except(F.array_union(current, add), remove))


def matched_tags(tags: Column, wanted: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.array_contains(tags, t))


def split_para_tags(tags: Column, prefix: str = "para:") -> tuple[Column, Column]:
    """Valid and invalid hash tags."""
    mine = F.filter(tags, lambda t: t.startswith(prefix))
    good = F.filter(mine, lambda t: F.substring(t, len(prefix) + 1, 1000).rlike("^[0-9a-f]{40}$"))
    return good, F.array_except(mine, good)


def first_match(stored: DataFrame, candidates: DataFrame, key: str, tag: str, order: str) -> DataFrame:
    """For each stored row the first of its tags that a candidate has; of candidates with one tag the last wins."""
    last = candidates.groupBy(tag).agg(F.max_by("value", order).alias("value"))
    return stored.join(last, tag).groupBy(key).agg(F.min_by(F.struct(tag, "value"), "tag_ord").alias("m")).select(key, f"m.{tag}", "m.value")


def first_of_kind(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def batches(df: DataFrame, item: str, order: list[str], size: int = 10) -> DataFrame:
    """Write batches of ``size`` rows within each item."""
    n = F.row_number().over(Window.partitionBy(item).orderBy(*order)) - 1
    return df.withColumn("batch", F.expr("0").cast("long") + F.floor(n / size))


def is_broken(sort_index: Column, page_label: Column, position: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return blank(sort_index) | blank(page_label) | blank(position)


def before_error(df: DataFrame, key: str, order: str, failed: Column) -> Column:
    """Whether a row stands before the first failure of its key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(F.coalesce(failed, F.lit(False)).cast("int")).over(w) == 0


def until_first_error(df: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Rows before the first failure of each key: the prefix that was written."""
    return df.withColumn("_good", before_error(df, key, order, failed)).where("_good").drop("_good")
