"""Items and annotations as a service sends them: JSON of an open schema, as VARIANT, where a missing key, a null, a text and an object are four things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotations import COMMENT, LABEL, NOTE, PLACE, SORT


def value(data: Column, name: str) -> Column:
    """What stands under a key, a null too; SQL's null where there is no such key."""
    return F.try_variant_get(data, f"$.{name}", "variant")


def text_of(data: Column, name: str) -> Column:
    """The text under a key; null for anything else than a text."""
    found = value(data, name)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def body_field(data: Column) -> Column:
    """The field that holds an annotation's text: the comment where there is such a key, be it null, else the note, else the comment."""
    return F.when(value(data, COMMENT).isNotNull(), COMMENT).when(value(data, NOTE).isNotNull(), NOTE).otherwise(COMMENT)


def body(data: Column) -> Column:
    """An annotation's text without blanks around it; empty for nulls, numbers as they are written."""
    written = lambda n: F.coalesce(F.try_variant_get(value(data, n), "$", "string"), F.lit(""))
    return F.trim(F.when(body_field(data) == NOTE, written(NOTE)).otherwise(written(COMMENT)))


def is_broken(data: Column) -> Column:
    """Whether sort index or page label are no text or a blank one, or the position neither a text nor an object."""
    blank = lambda n: F.trim(F.coalesce(text_of(data, n), F.lit(""))) == ""
    placed = F.schema_of_variant(value(data, PLACE)).startswith("OBJECT")
    return blank(SORT) | blank(LABEL) | (blank(PLACE) & ~F.coalesce(placed, F.lit(False)))


def as_map(data: Column) -> Column:
    """The form the other operators take: a map of texts. Objects and lists are their JSON, nulls are empty."""
    entries = F.coalesce(F.try_variant_get(data, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.transform_values(entries, lambda _k, v: F.when(F.schema_of_variant(v) == "VOID", "").when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def parsed(rows: DataFrame, column: str = "data") -> tuple[DataFrame, DataFrame]:
    """``rows`` with JSON text made VARIANT, and the rows whose text is no JSON object."""
    made = rows.withColumn("_v", F.try_parse_json(F.col(column)))
    sound = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    return made.where(sound).withColumn(column, F.col("_v")).drop("_v"), made.where(~sound).drop("_v")
