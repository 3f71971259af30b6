"""Repeated runs of lines by a suffix array over line numbers, built by distributed prefix doubling.

Lines that occur once end every repeated run, so only the others take part. Their suffixes get ranks, places of
an order by line number, and each round doubles the lines that a rank tells apart: it counts the pairs of ranks (here, and
one stride on) and adds up the counts within a rank. Suffixes of one rank share that many lines: an interval of the
suffix array whose neighbours have at least so long a common prefix. A run of a length between two powers is named by two ranks
that overlap, which tells its interval without the values of its neighbours' prefixes. The order is made as deep as
the longest of the least windows, since deeper places decide nothing.
All in DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DOC = ["doc_id", "text_hash"]
#: Sums along an order are made in so many parts, then within each part.
PARTS_LOG2 = 12


def full_lines(text: str = "text") -> Column:
    """The lines of a text that aren't blank."""
    return F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(common.WORD))


def _first_places(keys: DataFrame) -> DataFrame:
    """``h1, h2, r`` from ``(h1, h2, n)``: the suffixes that begin with lesser lines, summed in two steps."""
    part = F.shiftright("h1", 64 - PARTS_LOG2)
    keys = keys.withColumn("part", part)
    sums = keys.groupBy("part").agg(F.sum("n").alias("all"))
    before = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("h1", "h2")) - F.col("n")
    return keys.withColumn("inside", inside).join(before, "part").select("h1", "h2", (F.col("before") + F.col("inside")).alias("r"))


def _doubled(now: DataFrame, stride: int, total: int) -> DataFrame:
    """Ranks that tell twice ``stride`` lines apart, from ``(..., r)`` that tell ``stride``."""
    by_doc = Window.partitionBy(*DOC).orderBy("pos")
    there = F.when(F.lead("pos", stride).over(by_doc) == F.col("pos") + stride, F.lead("r", stride).over(by_doc))
    now = now.withColumn("then", F.coalesce(there, F.lit(-1).cast("long")))
    pairs = now.groupBy("r", "then").agg(F.count("*").alias("n"))
    # one line may be followed by very many others: their counts are added up in parts
    pairs = pairs.withColumn("part", F.when(F.col("then") < 0, -1).otherwise(F.expr(f"(then * 256) div {max(total, 1)}")))
    sums = pairs.groupBy("r", "part").agg(F.sum("n").alias("all"))
    before = sums.select("r", "part", (F.sum("all").over(Window.partitionBy("r").orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("r", "part").orderBy("then")) - F.col("n")
    ranks = pairs.withColumn("inside", inside).join(before, ["r", "part"]).select("r", "then", (F.col("r") + F.col("before") + F.col("inside")).alias("r2"))
    return now.join(ranks, ["r", "then"]).drop("r", "then").withColumnRenamed("r2", "r")


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``doc_id, text_hash, cut``: for each text with deletions, the intervals of its full lines that go.

    A line goes when it lies in a run of at least ``min_words`` words that stands earlier in the table too, by
    ``doc_id``, then place. Runs end at lines that stand once in the table; blank lines don't count. Each such run is the union of the
    least windows of ``min_words`` words that begin or end in it, so windows of at most ``min_words`` lines decide all.
    """
    base = docs.select("doc_id", common.text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lines = base.select(*DOC, F.posexplode(full_lines()).alias("pos", "line"))
    lines = lines.select(*DOC, "pos", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")).alias("line"))
    lines = lines.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line", F.lit(2)).alias("h2"), F.regexp_count("line", F.lit(common.WORD)).alias("words"))
    # rows that repeat an id and its text are one text here
    lines = common.written(lines, "lines")
    keys = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    now = lines.join(_first_places(keys), ["h1", "h2"]).select(*DOC, "pos", "words", "r").dropDuplicates([*DOC, "pos"])
    now = common.written(now.withColumn("ranks", F.array("r")), "ranks")
    # the least windows that begin and end at each line, within runs of lines that repeat
    span = Window.partitionBy(*DOC).orderBy("pos")
    item = F.struct("pos", "words")

    def least(frame: Column, ahead: bool) -> Column:
        sign = 1 if ahead else -1
        arr = frame if ahead else F.reverse(frame)
        state = F.aggregate(
            arr,
            F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("ok")),
            lambda s, x: F.when(s["ok"] & (s["w"] < min_words) & (x["pos"] == F.col("pos") + sign * s["n"]), F.struct((s["n"] + 1).alias("n"), (s["w"] + x["words"]).alias("w"), F.lit(True).alias("ok"))).otherwise(
                F.struct(s["n"].alias("n"), s["w"].alias("w"), F.lit(False).alias("ok"))
            ),
        )
        return F.when(state["w"] >= min_words, state["n"]).otherwise(0)

    ahead = least(F.collect_list(item).over(span.rowsBetween(0, min_words - 1)), True).alias("ahead")
    back = least(F.collect_list(item).over(span.rowsBetween(1 - min_words, 0)), False).alias("back")
    windows = now.select(*DOC, "pos", ahead, back).where("ahead > 0 or back > 0")
    windows = windows.select(*DOC, F.explode(F.array(F.struct(F.col("pos").alias("start"), F.col("ahead").alias("n")), F.struct((F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("n")))).alias("w"))
    windows = common.written(windows.select(*DOC, "w.start", "w.n").where("n > 0").distinct(), "windows")
    size = now.agg(F.count("*").alias("n"), F.countDistinct("r").alias("groups")).first()
    longest = windows.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    stride, level, groups = 1, 0, size["groups"]
    while stride * 2 <= longest:
        before, following = now, _doubled(now, stride, size["n"])
        now = common.written(following.withColumn("ranks", F.concat("ranks", F.array("r"))), "ranks")
        common.dropped(before)
        stride, level = stride * 2, level + 1
        if (found := now.agg(F.countDistinct("r")).first()[0]) == groups:
            break  # no rank was split, so none will be
        groups = found
    # a window of n lines: the ranks for the largest power within n at its first line and at its last ones
    power = F.least(F.floor(F.log2("n") + 1e-9), F.lit(level)).cast("int")
    named = windows.withColumn("k", power).withColumn("last", F.greatest(F.col("start"), F.col("start") + F.col("n") - F.pow(F.lit(2), F.col("k")).cast("int")))
    for place, r in (("start", "r1"), ("last", "r2")):
        at = now.select(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"), F.col("pos").alias("its_pos"), "ranks")
        here = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")) & (F.col(place) == F.col("its_pos"))
        named = named.join(at, here).withColumn(r, F.element_at("ranks", F.col("k") + 1)).drop("its_id", "its_hash", "its_pos", "ranks")
    named = common.written(named.select(*DOC, "start", "n", "r1", "r2"), "named")
    # an interval may hold a third of all windows: its first one is found with partial sums, and the join back deals heavy ones by a salt
    name = ["n", "r1", "r2"]
    first = common.written(named.groupBy(*name).agg(F.min(F.struct(*DOC, "start")).alias("first"), F.count("*").alias("c")).where("c > 1"), "first")
    heavy = common.heavy_keys(first, name, "c")
    later = common.salted(named, heavy, name, [*DOC, "start"]).join(common.with_salts(first.drop("c"), heavy, name), [*name, "_salt"]).where(F.struct(*DOC, "start") > F.col("first"))
    cut = later.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos"))
    runs = cut.withColumn("island", island).groupBy(*DOC, "island").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    cuts = common.written(runs.groupBy(*DOC).agg(F.collect_list(F.struct("a", "b")).alias("cut")), "cuts")
    common.dropped(lines, now, windows, named, first)
    return cuts


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and with ``n_lines`` and ``n_deleted``.

    A text without deletions stays as it is, null too. From others blank lines go as well, and a text all of whose lines
    were copies is left empty. Rows that repeat both ``doc_id`` and text are treated alike, and are no copies of each other.
    Null ids sort first. Of copies the one with the least id, then place stays. Very long texts are lines as any other. All other columns stay, but for ones of these two names. No rows give none.
    """
    cuts = repeated_lines(docs, min_words).select("doc_id", "text_hash", F.col("cut").alias("__cut"))
    docs = docs.drop("n_lines", "n_deleted")
    names = docs.columns
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(common.text_of("d.text")) == F.col("c.text_hash"))
    rows = docs.alias("d").join(cuts.hint("merge").alias("c"), same, "left").select(*[F.col(f"d.`{n}`") for n in names], F.col("c.__cut"))
    lines = full_lines()
    left = F.filter(lines, lambda x, i: ~F.exists(F.col("__cut"), lambda c: (i >= c["a"]) & (i <= c["b"])))
    gone = F.aggregate(F.coalesce("__cut", F.array().cast("array<struct<a:int,b:int>>")), F.lit(0), lambda s, c: s + c["b"] - c["a"] + 1)
    rows = rows.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_deleted", gone.cast("long"))
    return rows.withColumn("text", F.when(F.col("__cut").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))).drop("__cut")


def op7_line_dedup(spark, sf_dir):
    return line_dedup(common.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted", "text")
