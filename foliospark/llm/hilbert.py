"""Shards along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to the same few bits by its own quantiles; those of strings follow from the ranks of their distinct values. A row's place on the curve is the
Hilbert index of its cell; rows sorted by it are cut into runs, so that the files of a shard cover a
compact box in all dimensions at once, which minimum and maximum statistics can prune.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def string_cuts(rows: DataFrame, column: str, cells: int) -> list[str]:
    """At most ``cells`` - 1 strings that cut the rows, in the order of whole strings, into parts of near equal numbers.

    Counted values are ranked, not rows, so a value that a third of all rows hold is one row here.
    """
    counts = rows.groupBy(column).agg(F.count("*").alias("k"))
    upto, total = common.ranked(counts, [column], "k")
    if not total:
        return []
    place = lambda c: F.expr(f"({c} * {cells}) div {total}")
    crossing = upto.where((place("upto") > place("(upto - k)")) & (F.col("upto") < total))
    return sorted((r[column] for r in crossing.select(column).collect()), key=lambda x: x.encode())  # at most one for each cut


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index of a cell on the curve, from coordinates of ``bits`` bits: Skilling's transposition, folded over the bits."""
    n = len(cells)

    def flips(state: Column, q: Column) -> Column:
        # the inverse-undo step for one bit plane: invert or exchange the low bits with the first coordinate
        x = [state[f"x{i}"] for i in range(n)]
        p = q - 1
        for i in range(n):
            hit = x[i].bitwiseAND(q) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            low = x[0]
            x[0] = F.when(hit, low.bitwiseXOR(p)).otherwise(low.bitwiseXOR(swap))
            if i:
                x[i] = F.when(hit, x[i]).otherwise(x[i].bitwiseXOR(swap))
        return F.struct(*[c.alias(f"x{i}") for i, c in enumerate(x)])

    planes = F.array(*[F.lit(1 << k) for k in range(bits - 1, 0, -1)])
    start = F.struct(*[c.cast("int").alias(f"x{i}") for i, c in enumerate(cells)])
    turned = F.aggregate(planes, start, flips) if bits > 1 else start

    def read(s: Column) -> Column:
        x = [s["x0"]]
        for i in range(1, n):
            x.append(s[f"x{i}"].bitwiseXOR(x[-1]))  # Gray encoding
        fix = reduce(lambda a, k: a.bitwiseXOR(F.when(x[-1].bitwiseAND(F.lit(1 << k)) != 0, F.lit((1 << k) - 1)).otherwise(0)), range(bits - 1, 0, -1), F.lit(0))
        out = F.lit(0).cast("long")
        for k in range(bits - 1, -1, -1):
            for c in x:
                out = out * 2 + F.shiftright(c.bitwiseXOR(fix), k).bitwiseAND(F.lit(1)).cast("long")
        return out

    # the fold's result is bound once: a transform over an array of one
    return F.transform(F.array(turned), read)[0]


def shards(docs: DataFrame, shard_count: int = 40, bits: int = 5, accuracy: int = 10_000) -> DataFrame:
    """Every row of ``docs(doc_id, text, lang, source)`` in one of ``shard_count`` runs along the curve; row counts differ by one at most.

    Dimensions: source, language (null as the empty string), size (the text's UTF-8 bytes, none for null, plus 16). Quantiles of the size
    within 1 / ``accuracy``, those of strings exact, by whole strings. Rows of one cell go by the text's checksum, then ``doc_id``, so equal
    texts of a cell stay together where the counts allow; a group of copies larger than a shard is spread over the next ones, and equal
    texts of other sources, languages stand in other cells. Null ids come first. Rows equal in all these share places in any order.
    Very long texts count by their bytes, which only the size and the checksum read. With fewer rows than shards some shards stay
    empty; no rows give no rows. Other columns, whatever their names, are ignored.
    The rank is exact whatever the partitions: rows are dealt by range, and each range adds the counts before it.
    """
    text = common.text_of()
    blank = F.lit("")
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.col("source").cast("string"), blank).alias("d0"),
        F.coalesce(F.col("lang").cast("string"), blank).alias("d1"),
    )
    base = common.written(base, "places")  # texts are read once
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    sizes = base.agg(F.percentile_approx("size", shares, accuracy).alias("cuts")).first()["cuts"]
    cuts = {"d0": string_cuts(base, "d0", 1 << bits), "d1": string_cuts(base, "d1", 1 << bits), "size": sorted({int(x) for x in sizes or []})}

    def cell(d: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[d]]), lambda c: c < F.col(d))) if cuts[d] else F.lit(0)

    cells = [cell(d) for d in ("d0", "d1", "size")]
    placed = base.select("doc_id", "size", "text_crc32", hilbert_index(cells, bits).alias("curve"))
    upto, n = common.ranked(placed, ["curve", "text_crc32", "doc_id"])
    ranked = upto.withColumn("rank", F.col("upto") - 1)
    shard = F.expr(f"(rank * {shard_count}) div {max(n, 1)}")
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - F.expr(f"(cast(shard as bigint) * {n} + {shard_count - 1}) div {shard_count}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op5_hilbert_shards(spark, sf_dir):
    return shards(common.documents(spark, sf_dir))
