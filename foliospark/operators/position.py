"""Where a note goes on its page, and page sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The page that stands in for one of unknown size.
DEFAULT_W, DEFAULT_H = 595.0, 842.0


def note_position(coords: Column, page_h: Column, page_w: Column, page: Column | None = None, dx: float = -30.0, dy: float = 5.0, icon: float = 12.0) -> Column:
    """``page_index, x1, y1, x2, y2, sort_index`` from coordinates (page, x, y, w, h), top-origin; of its first page only.

    Without coordinates a fixed point of the page. The sort index has the height before the offset, rounded half to even.
    """
    first = F.filter(coords, lambda c: c["page"] == coords[0]["page"])
    left = F.array_min(F.transform(first, lambda c: c["x"]))
    top = F.array_min(F.transform(first, lambda c: F.struct(c["y"].alias("y"), c["h"].alias("h"))))
    have = F.coalesce(F.size(coords), F.lit(0)) > 0
    known = [F.try_element_at(coords, F.lit(1))["page"], *([] if page is None else [page]), F.lit(1)]
    index = F.greatest(F.coalesce(*known) - 1, F.lit(0))
    x = F.when(have, left).otherwise(page_w * 0.1)
    y = F.when(have, page_h - (top["y"] + top["h"])).otherwise(page_h * 0.9)
    return F.struct(
        index.alias("page_index"),
        (x + dx).alias("x1"),
        (y + dy).alias("y1"),
        (x + dx + icon).alias("x2"),
        (y + dy + icon).alias("y2"),
        F.format_string("%05d|000000|%05d", index.cast("long"), F.rint(y).cast("long")).alias("sort_index"),
    )


def dominant_size(boxes: DataFrame, key: str) -> DataFrame:
    """The most frequent (w, h) of each key, rounded to 2 places; then the higher summed score, then the first seen."""
    rounded = boxes.where("w > 0 and h > 0").select(key, "ord", "score", F.bround("w", 2).alias("w"), F.bround("h", 2).alias("h"))
    counts = rounded.groupBy(key, "w", "h").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.min("ord").alias("first"))
    return counts.groupBy(key).agg(F.max_by(F.struct("w", "h", "n"), F.struct("n", "score", (-F.col("first")).alias("o"))).alias("m")).select(key, "m.w", "m.h", "m.n")


def boxes_in(raw: DataFrame) -> DataFrame:
    """``key, ord, score, w, h`` of every crop and media box in ``raw(key, content)``; crop boxes score 2, media boxes 1."""
    text = F.decode("content", "ISO-8859-1")
    number = r"\s*(-?\d+(?:\.\d+)?)"
    found = F.regexp_extract_all(text, F.lit(r"/(?:CropBox|MediaBox)\s*\[" + number * 4 + r"\s*\]"), F.lit(0))
    each = raw.select("key", F.posexplode(found).alias("ord", "box"))
    part = lambda k: F.regexp_extract("box", r"\[" + number * 4, k).cast("double")
    return each.select("key", "ord", F.when(F.col("box").startswith("/CropBox"), 2).otherwise(1).alias("score"), (part(3) - part(1)).alias("w"), (part(4) - part(2)).alias("h"))


def page_sizes(raw: DataFrame) -> DataFrame:
    """``key, page_index, w, h`` of the pages that stand as plain objects in ``raw(key, content)``, in their order; else the dominant box as page 0.

    A crop box goes before a media box; a page turned by a quarter has its sides exchanged; pages without a sound box are left out, but counted.
    """
    text = F.decode("content", "ISO-8859-1")
    number = r"\s*(-?\d+(?:\.\d+)?)"
    objects = F.regexp_extract_all(text, F.lit(r"(?s)\bobj\b((?:(?!\bendobj\b).)*?/Type\s*/Page\b(?!s)(?:(?!\bendobj\b).)*)"), F.lit(1))
    each = raw.select("key", F.posexplode(objects).alias("page_index", "page"))

    def side(k: int) -> Column:
        crop, media = (F.regexp_extract("page", rf"/{n}\s*\[" + number * 4 + r"\s*\]", k) for n in ("CropBox", "MediaBox"))
        return F.when(crop != "", crop).when(media != "", media).cast("double")

    turned = F.coalesce(F.when(F.regexp_extract("page", r"/Rotate\s+(-?\d+)", 1) != "", F.regexp_extract("page", r"/Rotate\s+(-?\d+)", 1)).cast("int"), F.lit(0)) % 180 != 0
    sized = each.select("key", "page_index", (side(3) - side(1)).alias("a"), (side(4) - side(2)).alias("b"), turned.alias("turned")).where("a > 0 and b > 0")
    known = sized.select("key", "page_index", F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("w"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("h"))
    rest = boxes_in(raw).join(known.select("key").distinct(), "key", "left_anti")
    return known.unionByName(dominant_size(rest, "key").select("key", F.lit(0).alias("page_index"), "w", "h"))


def page_size(wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """The size of a page, else of page 0, else null; never another page's."""
    zero = sizes.where("page_index = 0").select("doc_id", F.col("w").alias("w0"), F.col("h").alias("h0"))
    rows = wanted.join(sizes, ["doc_id", "page_index"], "left").join(zero, "doc_id", "left")
    return rows.select(*wanted.columns, F.coalesce("w", "w0").alias("w"), F.coalesce("h", "h0").alias("h"))
