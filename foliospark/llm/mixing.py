"""A mixture of sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket. The bucket in which a source's budget ends is the only one
that is looked into again, at ever finer buckets, until it holds one hash. A row is taken again when its hash is
under its source's threshold: nothing is sorted, and larger budgets take a superset of smaller ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

HASH_BITS = 60


def word_count(column: str = "text"):
    return F.regexp_count(common.text_of(column), F.lit(common.WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. Budget: ``percent`` of all sizes, shared by weight, but
    no source gets over ``most`` times its size; the excess is shared again. That is water of one level: a source
    is full when the level times its weight reaches its bound. The level rises from the one at which none is full; each
    step is a sum over all sources, and it ends when no further source fills. Sources are ranked by range, so there may be very many.
    """
    numbered = sizes.withColumn("_last", F.col("source").isNull())
    numbered, _ = common.ranked(numbered, ["_last", "source"])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("upto") - 1) % len(weights) + 1).cast("int"))
    bound = (F.col("source_size") * most).cast("double")
    rows = common.written(numbered.select("source", "source_size", w.alias("w"), bound.alias("bound")), "weights")
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * percent / 100.0
    level, before = 0.0, -1
    while True:
        full = F.col("bound") <= F.lit(level) * F.col("w") if before >= 0 else F.lit(False)
        k, held, rest = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if k == before or not rest:
            break
        level, before = (budget - held) / rest, k
    target = F.least(F.col("bound"), F.lit(level) * F.col("w")) if rest else F.col("bound")
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, step: int = 12) -> DataFrame:
    """``(source, copies, below)``: how often each row of a source is taken whole, and under which hash once more.

    ``rows(source, hash, size)``, hash of ``HASH_BITS`` bits. The threshold is the one whose sum comes nearest to what the
    target leaves after whole copies, by rows of one hash.
    """
    state = targets.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
        "target",
        "source_size",
    ).select("source", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("bucket")).withColumn("none", F.col("rest") <= 0)
    left = HASH_BITS
    state = common.written(state, "state")
    while left:
        left -= step
        mine = rows.join(state.select(F.col("source").alias("s"), "rest", "bucket"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", left + step) == F.col("bucket")))
        found = mine.groupBy("source", F.shiftright("hash", left).alias("b")).agg(F.sum("size").cast("long").alias("sum"), F.min("hash").alias("h0"), F.max("hash").alias("h1"), F.first("rest").alias("rest"))
        so_far = F.sum("sum").over(Window.partitionBy("source").orderBy("b"))
        found = found.withColumn("upto", so_far)
        # the first bucket that goes over what is left, if any: else all are under
        over = found.where("upto > rest").groupBy("source").agg(F.min(F.struct("b", (F.col("rest") - (F.col("upto") - F.col("sum"))).alias("rest"), "h0", "h1", "sum")).alias("o"))
        state = common.written(
            state.select(F.col("source").alias("s"), "copies", F.col("rest").alias("old"), "bucket", "none")
            .join(over, F.col("source").eqNullSafe(F.col("s")), "left")
            .select(
                F.col("s").alias("source"),
                "copies",
                "none",
                F.coalesce("o.rest", "old").alias("rest"),
                # no bucket is over: the threshold is above the whole range
                F.coalesce("o.b", F.shiftleft(F.col("bucket") + 1, step)).alias("bucket"),
                F.coalesce(F.col("o.h0") < F.col("o.h1"), F.lit(False)).alias("open"),
                F.col("o.h0").alias("h0"),
                F.col("o.sum").alias("sum"),
            ),
            "state",
        )
        if not state.where("open").limit(1).count():
            break
        state = state.select("source", "copies", "none", "rest", "bucket", "h0", "sum")
    # a single hash is left in the boundary bucket: it is in if that comes nearer
    below = F.when(F.col("h0").isNull(), F.shiftleft("bucket", left)).otherwise(F.col("h0") + F.when(F.col("sum") - F.col("rest") < F.col("rest"), 1).otherwise(0))
    # nothing is left after whole copies: no row is taken once more, one without words neither
    below = F.when(F.col("none"), 0).otherwise(below)
    return state.select("source", "copies", below.alias("below"))


#: A plan has one row for each source. Up to so many it is sent to all tasks, beyond it is joined.
MOST_BROADCAST = 20_000


def _plan(docs: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their sizes and hashes, and what to take of each source."""
    rows = common.written(docs.select("doc_id", "source", word_count().alias("size"), _hash().alias("hash")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = common.written(source_targets(totals, weights, percent, most), "targets")
    marks = thresholds(rows, targets)
    plan = targets.join(marks.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "copies", "below")
    plan = common.written(plan, "plan")
    return rows, F.broadcast(plan) if plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else plan


def _hash():
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 64 - HASH_BITS)


def _copies():
    return F.col("copies") + (F.col("hash") < F.col("below")).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs(doc_id, text, source)``.

    Size: words of the text, 0 for null. Which rows a source takes follows from a hash of ``doc_id`` alone, so reruns agree;
    rows that repeat an id are taken together. Texts without words are taken but add nothing. Null is a source of its own,
    apart from the empty string. Very long texts count as they are, so a source's words may miss its target by one row's. Tables without rows give none.
    Other columns, whatever their names, are ignored.
    """
    rows, plan = _plan(docs, weights, percent, most)
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", _copies().alias("copies"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """The same mixture as rows: each row of ``docs`` with all its columns as often as it is taken."""
    _, plan = _plan(docs, weights, percent, most)
    rows = docs.select("source", _hash().alias("hash"), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("row.*")


def op6_mixing(spark, sf_dir):
    return mixed(common.documents(spark, sf_dir))
