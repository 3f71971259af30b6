"""Queries of the layout stage over pages made from the driver tables, and their SQL.

The tables hold no layout, so a line item stands for a line: its numbers give its place, one of a dozen fixed texts its words. The same
expressions make the lines in both engines; what an operator decides about them is then said once in the library and once, from
the kinds of texts and the places alone, in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adapter, assembly, blocks, layout
from ..operators import paragraphs as P
from ..sources import scratch
from .catalogue import LINES, lines, query, table

#: The texts by kind: prose and sentence, prose in lower case, formula, table caption, figure caption, table row, page number, note, formula number, algorithm, short words, heading.
TEXTS = ["This is a line of plain prose with many words in it.", "goes on in lower case with quite a few more words here", "E = mc^2", "Table 2: results", "Figure 3: a plot", "12 3.4 56 7 8", "17", "1 A small note", "(4)", "Algorithm 1 Sort", "Short words", "2 Method"]
PROSE, CONTINUED, FORMULA, TABLE, FIGURE, ROW, NUMBER, NOTE, EQUATION, ALGORITHM, SHORT, HEADING = range(12)
TEXT = "CASE kind " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEXTS)) + " END"
KIND = "(l_partkey + l_suppkey * 3 + l_linenumber) % 12"
#: Line items with their number in the order, for equal line numbers occur.
ITEMS = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)"


def page_sql(kind: str, x0: str, y0: str, width: str, font: str, doc: str = "l_orderkey", page: str = "0", height: str = "12", source: str = ITEMS, ord_: str = "rn") -> str:
    """The lines of pages, in words that both engines understand."""
    box = f"CAST({x0} AS DOUBLE) AS x0, CAST({y0} AS DOUBLE) AS y0, CAST({x0} + {width} AS DOUBLE) AS x1, CAST({y0} + {height} AS DOUBLE) AS y1"
    rows = f"SELECT CAST({doc} AS BIGINT) AS doc_id, CAST({page} AS INT) AS page_index, CAST({ord_} AS BIGINT) AS ord, CAST({kind} AS INT) AS kind, {box}, CAST({font} AS DOUBLE) AS font_size FROM {source}"
    return f"SELECT *, CAST(600 AS DOUBLE) AS page_w, CAST(800 AS DOUBLE) AS page_h, {TEXT} AS text FROM ({rows}) r"


def page_lines(spark, sf_dir: str, sql: str) -> DataFrame:
    """The same lines in Spark; the tables go into the text as parameters, not as views."""
    return spark.sql(sql.replace("FROM lineitem)", "FROM {lineitem})"), lineitem=table(spark, sf_dir, "lineitem"))


def pages_with(lines_: DataFrame, **metrics: float | None) -> DataFrame:
    """Pages with given metrics instead of their own, so that a step is seen alone."""
    known = {"line_h": 12.0, "median_w": 0.0, "page_font": 10.0, "font": 10.0, "top": None, "bottom": None, "band_h": None, "band_w": None} | metrics
    pages = layout.pages_from_lines(lines_)
    return pages.select("*", *[F.lit(v).cast("double").alias(n) for n, v in known.items()])


def stepped(lines_: DataFrame, step, **metrics) -> DataFrame:
    """The lines that one step over pages leaves."""
    return pages_with(lines_, **metrics).withColumn("lines", step(F.col("lines"))).select("doc_id", F.inline("lines"))


def summed(rows: DataFrame) -> DataFrame:
    """Of each page the lines left, the sums of their numbers, corners and text lengths, so that a changed line shows."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("ord").alias("ords"), F.sum(F.length("text")).alias("chars"), F.round(F.sum(F.col("x1") * 3 + F.col("y1")), 3).alias("corners"))


SUMMED = "SELECT doc_id, count(*) AS n, CAST(sum(ord) AS BIGINT) AS ords, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(x1 * 3 + y1), 3) AS corners FROM {} GROUP BY doc_id"

# metrics of pages

BAND = page_sql(KIND, "50 + l_partkey % 3 * 10 + CASE WHEN l_quantity > 25 THEN 270 ELSE 0 END", "l_extendedprice % 790", "CASE WHEN l_partkey % 7 = 0 THEN 20 ELSE 180 + l_partkey % 60 END", "CASE l_linenumber % 4 WHEN 0 THEN 7 WHEN 1 THEN 10 WHEN 2 THEN 10.5 ELSE 14 END", "l_suppkey % 2", "l_suppkey", "CASE WHEN l_partkey % 50 = 0 THEN 230 ELSE 10 + l_partkey % 4 END", ord_="l_orderkey * 100 + rn")
METRICS = rf"""l AS ({BAND}), a AS (SELECT *, y1 - y0 AS h, x1 - x0 AS w FROM l),
m AS (SELECT doc_id, page_index, CASE WHEN count(*) FILTER (kind NOT IN (2, 5, 6, 8, 11)) >= 8 THEN median(h) FILTER (kind NOT IN (2, 5, 6, 8, 11)) ELSE median(h) END AS line_h, median(w) FILTER (kind NOT IN (2, 6, 8, 11)) AS median_w, median(font_size) AS page_font FROM a GROUP BY ALL),
c AS (SELECT * FROM a WHERE kind NOT IN (2, 3, 4, 5, 6, 8, 11) AND NOT (kind = 7 AND y0 >= 800 * 0.72)), f AS (SELECT doc_id, page_index, median(font_size) AS m0, count(*) AS nc FROM c GROUP BY ALL),
c2 AS (SELECT c.*, m0 FROM c JOIN f USING (doc_id, page_index) WHERE nc >= 8 AND NOT (y0 >= 800 * 0.8 AND font_size <= m0 * 0.92)), f2 AS (SELECT doc_id, page_index, median(font_size) AS m1 FROM c2 GROUP BY ALL HAVING count(*) >= 8),
n AS (SELECT c2.*, m1 FROM c2 JOIN f2 USING (doc_id, page_index) WHERE abs(font_size - m1) / m1 <= 0.25),
b AS (SELECT doc_id, page_index, median(h) AS band_h, median(w) AS band_w, greatest(0.0, quantile_cont(y0, 0.06) - 2 * median(h)) AS top, least(800.0, quantile_cont(y1, 0.94) + 2 * median(h)) AS bottom, max(m1) AS font FROM n GROUP BY ALL HAVING count(*) >= 6)"""


@query("body_band", f"WITH {METRICS} SELECT doc_id, page_index, round(line_h, 6) AS line_h, round(median_w, 6) AS median_w, round(page_font, 6) AS page_font, round(band_h, 6) AS band_h, round(band_w, 6) AS band_w, round(top, 6) AS top, round(bottom, 6) AS bottom, round(font, 6) AS font FROM m JOIN b USING (doc_id, page_index)")
def _(spark, d):
    found = layout.page_metrics(page_lines(spark, d, BAND))
    return found.select("doc_id", "page_index", *[F.round(n, 6).alias(n) for n in ("line_h", "median_w", "page_font", "band_h", "band_w", "top", "bottom", "font")])


FLAGS = f"""{METRICS}, g AS (SELECT a.*, top, bottom, band_h, band_w, font, (y1 < top - greatest(band_h, 1) OR y0 > bottom + greatest(band_h, 1)) AS outside FROM a JOIN b USING (doc_id, page_index))"""


@query("edge_lines", f"WITH {FLAGS} SELECT doc_id, page_index, count(*) FILTER (outside) AS outside, count(*) FILTER (outside AND kind = 6 AND (abs((x0 + x1) / 2 - 300) <= 72 OR x0 <= 120 OR x1 >= 480) AND font_size <= font * 1.3) AS numbers, count(*) FILTER (w < band_w * 0.25 AND h > band_h * 3) AS tall FROM g GROUP BY ALL")
def _(spark, d):
    pages = layout.with_metrics(layout.pages_from_lines(page_lines(spark, d, BAND)))
    count = lambda f: F.size(F.filter("lines", f)).cast("long")
    return pages.select("doc_id", "page_index", count(layout.outside_band).alias("outside"), count(layout.is_page_number).alias("numbers"), count(layout.is_narrow_tall).alias("tall"))


@query("running_texts", f"WITH {FLAGS} SELECT doc_id, array_to_string(list_sort(list(text)), '|') AS running FROM (SELECT doc_id, text FROM g WHERE outside AND length(text) >= 12 GROUP BY ALL HAVING count(DISTINCT page_index) >= 3) GROUP BY doc_id")
def _(spark, d):
    found = layout.running_texts(layout.with_metrics(layout.pages_from_lines(page_lines(spark, d, BAND))))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "|").alias("running"))


@query("without_running", f"WITH {FLAGS}, r AS (SELECT doc_id, text FROM g WHERE outside AND length(text) >= 12 GROUP BY ALL HAVING count(DISTINCT page_index) >= 3), k AS (SELECT a.* FROM a LEFT JOIN r USING (doc_id, text) WHERE r.text IS NULL) SELECT doc_id, page_index, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM k GROUP BY ALL")
def _(spark, d):
    pages = layout.without_running(scratch.written(layout.with_metrics(layout.pages_from_lines(page_lines(spark, d, BAND))), "pages"))
    return pages.where(F.size("lines") > 0).select("doc_id", "page_index", F.size("lines").cast("long").alias("lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"])).alias("chars"))


@query("quantile_band", "SELECT lang, round(quantile_cont(n_chars, 0.06), 6) AS low, round(quantile_cont(n_chars, 0.94), 6) AS high, round(median(n_chars), 6) AS middle FROM documents GROUP BY lang")
def _(spark, d):
    held = table(spark, d, "documents").groupBy("lang").agg(F.sort_array(F.collect_list(F.col("n_chars").cast("double"))).alias("v"))
    v = F.col("v")
    return held.select("lang", F.round(layout.array_quantile(v, 0.06), 6).alias("low"), F.round(layout.array_quantile(v, 0.94), 6).alias("high"), F.round(layout.array_median(v), 6).alias("middle"))


# steps over the lines of a page

ROWS = page_sql(KIND, "CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE 118 + l_partkey % 14 END + CASE WHEN l_quantity > 40 THEN 270 ELSE 0 END", "60 + 30 * floor(l_linenumber / 3.0) + l_suppkey % 5", "66 + l_partkey % 6", "CASE l_suppkey % 4 WHEN 0 THEN 7 ELSE 10 END")


@query("same_baseline", rf"""WITH l AS ({ROWS}), o AS (SELECT *, row_number() OVER w AS i, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, lead(y0) OVER w AS ny0, lead(y1) OVER w AS ny1, lead(font_size) OVER w AS nf, lead(text) OVER w AS nt, lead(ord) OVER w AS nord FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY y0, x0, ord)),
g AS (SELECT *, CASE WHEN x0 <= nx0 THEN nx0 - x1 ELSE x0 - nx1 END AS gap, nord IS NOT NULL AND abs(y0 - ny0) <= 3 AND abs(y1 - ny1) <= 3 AND (x0 < 300) = (nx0 < 300) AND abs(font_size - nf) <= 0.25 * greatest(font_size, nf) AS row_fits FROM o),
f AS (SELECT *, coalesce(row_fits AND gap BETWEEN -1 AND greatest(1.5, font_size * 1.4), false) AS fits FROM g), s AS (SELECT *, i - sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
t AS (SELECT *, fits AND row_number() OVER (PARTITION BY doc_id, run, fits ORDER BY i) % 2 = 1 AS merges FROM s), u AS (SELECT *, coalesce(lag(merges) OVER (PARTITION BY doc_id ORDER BY i), false) AS taken FROM t),
r AS (SELECT doc_id, ord, CASE WHEN merges THEN greatest(x1, nx1) ELSE x1 END AS x1, CASE WHEN merges THEN greatest(y1, ny1) ELSE y1 END AS y1, CASE WHEN merges THEN concat(text, ' ', nt) ELSE text END AS text FROM u WHERE NOT taken)
{SUMMED.format('r')}""")
def _(spark, d):
    return summed(stepped(page_lines(spark, d, ROWS), blocks.merge_same_baseline))


RIGHT = page_sql(KIND, "CASE WHEN l_quantity > 20 THEN 420 + l_partkey % 9 ELSE 50 END", "60 + 24 * floor(l_linenumber / 3.0) + l_suppkey % 6", "CASE WHEN l_quantity > 20 THEN 60 ELSE 200 + l_partkey % 120 END", "CASE l_suppkey % 4 WHEN 0 THEN 8 ELSE 10 END")


@query("nearest_left", rf"""WITH l AS ({RIGHT}), o AS (SELECT * FROM l), p AS (SELECT r.doc_id, r.ord AS rord, r.x1 AS rx1, r.y1 AS ry1, r.text AS rtext, arg_min(p.ord, (r.x0 - p.x1, p.ord)) AS target FROM o r JOIN o p ON p.doc_id = r.doc_id AND p.x0 < 300 AND abs(p.y0 - r.y0) <= 3.6 AND abs(p.y1 - r.y1) <= 3.6 AND p.x1 <= r.x0 AND p.kind IN (0, 1) WHERE r.kind = 2 AND r.x0 >= 408 GROUP BY ALL),
t AS (SELECT doc_id, target, max(rx1) AS rx1, max(ry1) AS ry1, sum(length(rtext) + 1) AS extra FROM p GROUP BY ALL),
r AS (SELECT o.doc_id, o.ord, greatest(o.x1, coalesce(t.rx1, 0)) AS x1, greatest(o.y1, coalesce(t.ry1, 0)) AS y1, repeat('x', CAST(length(o.text) + coalesce(t.extra, 0) AS INT)) AS text FROM o LEFT JOIN t ON t.doc_id = o.doc_id AND t.target = o.ord WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = o.doc_id AND p.rord = o.ord))
{SUMMED.format('r')}""")
def _(spark, d):
    return summed(stepped(page_lines(spark, d, RIGHT), blocks.merge_right_math))


TALL = page_sql(f"CASE WHEN rn = 2 THEN {TABLE} WHEN {KIND} = {TABLE} THEN {SHORT} ELSE {KIND} END", "CASE WHEN l_quantity > 35 THEN 320 ELSE 50 END", "l_extendedprice % 760", "150", "10")


@query("band_drop", rf"""WITH l AS ({TALL}), c AS (SELECT doc_id, y0 AS cy0, y1 AS cy1, x0 < 300 AS ccol FROM l WHERE kind = {TABLE}),
a AS (SELECT l.doc_id, l.ord FROM l JOIN c ON c.doc_id = l.doc_id AND (l.x0 < 300) = ccol WHERE l.kind NOT IN (0, 1, 3, 4) AND l.y1 > greatest(cy0 - 440, 0) AND l.y0 < cy0),
b AS (SELECT l.doc_id, l.ord, count(*) OVER (PARTITION BY l.doc_id) AS n FROM l JOIN c ON c.doc_id = l.doc_id AND (l.x0 < 300) = ccol WHERE l.kind IN (2, 5, 6, 9, 11) AND l.y1 > cy1 AND l.y0 < least(cy1 + 440, 800) AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = l.doc_id AND a.ord = l.ord)),
r AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = l.doc_id AND a.ord = l.ord) AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = l.doc_id AND b.ord = l.ord AND n >= 3))
{SUMMED.format('r')}""")
def _(spark, d):
    return summed(stepped(page_lines(spark, d, TALL), blocks.drop_table_bodies))


FLOW = page_sql(KIND, "CASE WHEN l_quantity > 35 THEN 320 ELSE 50 END", "60 + 30 * l_linenumber + l_partkey % 20", "200 + l_partkey % 90", "CASE l_suppkey % 3 WHEN 0 THEN 8 ELSE 10 END")


@query("algorithm_drop", rf"""WITH RECURSIVE l AS ({FLOW}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, ord) AS i FROM l),
s AS (SELECT doc_id, 0 AS i, false AS gone, false AS inside, 0.0::DOUBLE AS top, false AS lft, false AS wide, 0.0::DOUBLE AS below FROM (SELECT DISTINCT doc_id FROM o)
 UNION ALL SELECT o.doc_id, o.i::INT, m.more OR o.kind = {ALGORITHM}, m.more OR o.kind = {ALGORITHM}, CASE WHEN m.more THEN s.top ELSE o.y0 END, CASE WHEN m.more THEN s.lft ELSE o.x0 < 300 END, CASE WHEN m.more THEN s.wide ELSE o.x1 > 312 END, o.y1
 FROM s JOIN o ON o.doc_id = s.doc_id AND o.i = s.i + 1, LATERAL (SELECT s.inside AND o.y1 - s.top <= 440 AND (s.wide OR (o.x0 < 300) = s.lft) AND o.y0 - s.below <= 26.4 AS more) m),
r AS (SELECT o.* FROM o JOIN s ON s.doc_id = o.doc_id AND s.i = o.i WHERE NOT s.gone) {SUMMED.format('r')}""")
def _(spark, d):
    return summed(stepped(page_lines(spark, d, FLOW), blocks.drop_algorithms))


FRONT = FLOW.replace(f"'{TEXTS[HEADING]}'", "'Abstract'")


@query("front_matter_drop", f"WITH l AS ({FRONT}), o AS (SELECT doc_id, min(y0) AS opens FROM l WHERE kind = {HEADING} GROUP BY doc_id), r AS (SELECT l.* FROM l LEFT JOIN o USING (doc_id) WHERE opens IS NULL OR y1 >= opens) {SUMMED.format('r')}")
def _(spark, d):
    return summed(stepped(page_lines(spark, d, FRONT), blocks.drop_front_matter))


FOOT = page_sql(f"CASE WHEN l_linenumber % 2 = 1 THEN {NOTE} ELSE {KIND} END", "50", "640 + 15 * l_linenumber + l_partkey % 9", "200", "CASE (l_suppkey + l_linenumber) % 3 WHEN 0 THEN 10 ELSE 8 END")


@query("footnote_drop", rf"""WITH RECURSIVE l AS ({FOOT}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, ord) AS i FROM l),
s AS (SELECT doc_id, 0 AS i, false AS gone, false AS inside, 0.0::DOUBLE AS below, 0 AS n FROM (SELECT DISTINCT doc_id FROM o)
 UNION ALL SELECT o.doc_id, o.i::INT, (m.near AND o.kind <> 6) OR m.starts, CASE WHEN s.inside AND (o.y0 < 704 OR (m.near AND o.kind = 6)) THEN true WHEN m.near THEN s.n + 1 < 6 ELSE m.starts END, CASE WHEN (m.near AND o.kind <> 6) OR m.starts THEN o.y1 ELSE s.below END, CASE WHEN m.near AND o.kind <> 6 THEN s.n + 1 WHEN m.starts THEN 0 ELSE s.n END
 FROM s JOIN o ON o.doc_id = s.doc_id AND o.i = s.i + 1, LATERAL (SELECT s.inside AND o.y0 >= 704 AND o.y0 - s.below <= 15.6 AND o.font_size <= 9.66 AS near, NOT (s.inside AND (o.y0 < 704 OR (o.y0 - s.below <= 15.6 AND o.font_size <= 9.66))) AND o.y0 >= 704 AND o.kind IN ({NOTE}, {HEADING}) AND o.font_size <= 9.2 AS starts) m),
r AS (SELECT o.* FROM o JOIN s ON s.doc_id = o.doc_id AND s.i = o.i WHERE NOT s.gone) {SUMMED.format('r')}""")
def _(spark, d):
    return summed(stepped(page_lines(spark, d, FOOT), blocks.drop_footnotes))


EQUATIONS = page_sql(f"CASE WHEN rn = 3 THEN {EQUATION} WHEN {KIND} = {EQUATION} THEN {SHORT} ELSE {KIND} END", "CASE WHEN rn = 3 THEN 500 ELSE 50 + l_partkey % 40 END", "60 + 14 * l_linenumber + l_partkey % 23", "CASE WHEN rn = 3 THEN 30 ELSE 200 END", "CASE l_suppkey % 3 WHEN 0 THEN 8 ELSE 10 END")


@query("numbered_math", rf"""WITH l AS ({EQUATIONS}), e AS (SELECT doc_id, ord AS eord, (y0 + y1) / 2 AS mid FROM l WHERE kind = {EQUATION}),
c AS (SELECT l.*, eord, abs((y0 + y1) / 2 - mid) <= 18 OR kind = 2 AS core FROM l JOIN e USING (doc_id) WHERE abs((y0 + y1) / 2 - mid) <= 28.8), k AS (SELECT doc_id, max(eord) AS ord, max(x1) AS x1, max(y1) AS y1, '[MATH](4)' AS text FROM c WHERE core OR kind = 6 GROUP BY doc_id HAVING count(*) FILTER (core) >= 2),
r AS (SELECT doc_id, ord, x1, y1, text FROM k UNION ALL SELECT l.doc_id, l.ord, l.x1, l.y1, l.text FROM l WHERE NOT EXISTS (SELECT 1 FROM k JOIN c ON c.doc_id = k.doc_id WHERE (c.core OR c.kind = 6) AND c.doc_id = l.doc_id AND c.ord = l.ord))
{SUMMED.format('r')}""")
def _(spark, d):
    return summed(stepped(page_lines(spark, d, EQUATIONS), blocks.collapse_numbered_math))


# paragraphs of a page


def outcome(rows: DataFrame) -> DataFrame:
    """Of each page its paragraphs in order: caption flag, number of lines, and the length of the text."""
    text = layout.joined_lines(F.transform("lines", lambda x: x["text"]))
    part = F.concat_ws(":", F.when(F.col("caption"), "c").otherwise("p"), F.size("lines").cast("string"), F.length(text).cast("string"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "ord", part.alias("s")))), lambda x: x["s"]), " ").alias("paragraphs"))


def assembled(lines_: DataFrame, **metrics) -> DataFrame:
    return outcome(assembly.page_paragraphs(pages_with(lines_, **metrics)))


READ = page_sql(f"CASE {KIND} % 4 WHEN 0 THEN {PROSE} WHEN 1 THEN {CONTINUED} WHEN 2 THEN {SHORT} ELSE {HEADING} END", "CASE WHEN l_quantity > 35 THEN 320 ELSE 50 + 60 * (l_partkey % 3) END", "60 + 20 * l_linenumber + l_suppkey % 17", "100 + l_suppkey % 60", "CASE l_suppkey % 5 WHEN 0 THEN 7 ELSE 10 END")
JOINED = "concat({c}, ':', count(*), ':', length(string_agg(text, ' ' ORDER BY i)))"


@query("reading_order", rf"""WITH l AS ({READ}), o AS (SELECT *, row_number() OVER w AS i, lag(kind) OVER w AS pk, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(font_size) OVER w AS pf FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY x0 >= 300, y0, x0, ord)),
b AS (SELECT *, CASE WHEN pk IS NULL OR kind = {HEADING} OR pk = {HEADING} OR (x0 >= 300) <> (px0 >= 300) OR y0 - py1 > 18 OR (y0 - py1 > 7.2 AND pk = 0 AND kind IN (0, {SHORT})) OR greatest(0, least(x1, px1) - greatest(x0, px0)) / least(x1 - x0, px1 - px0) < 0.2 OR abs(font_size - pf) > 0.25 * greatest(font_size, pf) THEN 1 ELSE 0 END AS brk FROM o),
s AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM b), p AS (SELECT doc_id, island, {JOINED.format(c="'p'")} AS s FROM s GROUP BY doc_id, island) SELECT doc_id, string_agg(s, ' ' ORDER BY island) AS paragraphs FROM p GROUP BY doc_id""")
def _(spark, d):
    return assembled(page_lines(spark, d, READ))


#: Two lines for each order: a caption, and a line below it whose distance, width and words vary.
PAIR = "(SELECT *, unnest([1, 2]) AS n FROM orders)"
PAIR_SPARK = "(SELECT *, explode(array(1, 2)) AS n FROM orders)"
BELOW = "CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 10 END"


def pair_sql(source: str) -> str:
    made = page_sql(f"CASE WHEN n = 1 THEN CASE WHEN o_custkey % 2 = 0 THEN {TABLE} ELSE {FIGURE} END ELSE {BELOW} END", "CASE WHEN n = 1 THEN 50 WHEN o_orderkey % 4 = 0 THEN 250 ELSE 50 END", "CASE WHEN n = 1 THEN 100 ELSE 112 + o_orderkey % 47 END", "CASE WHEN n = 1 THEN 120 ELSE 140 END", "10", "o_orderkey", source=source, ord_="n")
    return made.replace(f"'{TEXTS[FIGURE]}'", "'Figure 3: a plot of things.'")


@query("caption_lines", rf"""WITH l AS ({pair_sql(PAIR)}), p AS (SELECT a.doc_id, a.kind AS cap, b.kind AS below, b.y0 - a.y1 AS gap, b.x0 = 50 AS under, length(a.text) AS la, length(b.text) AS lb FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.ord = 1 AND b.ord = 2),
q AS (SELECT *, cap = {FIGURE} AS ended FROM p), r AS (SELECT *, under AND gap <= 18 AND gap <= 19.2 AND NOT (ended AND below = 1) AS grown FROM q),
t AS (SELECT *, NOT grown AND under AND (((la <= 24 OR ended) AND gap <= 14.4) OR (below = 1 AND NOT ended AND gap <= 23.04)) AS taken FROM r)
SELECT doc_id, CASE WHEN grown AND ended AND below <> 1 AND gap > 7.2 THEN concat('c:1:', la, ' c:1:', lb) WHEN (grown OR taken) AND NOT (ended AND below = 1 AND gap <= 31.2) THEN concat('c:2:', la + lb + 1) WHEN grown OR taken THEN concat('c:1:', la, ' p:1:', lb) ELSE concat('c:1:', la, ' p:1:', lb) END AS paragraphs FROM t""")
def _(spark, d):
    return assembled(spark.sql(pair_sql(PAIR_SPARK).replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")))


def number_sql(source: str) -> str:
    return page_sql(f"CASE WHEN n = 1 THEN {PROSE} ELSE {EQUATION} END", "CASE WHEN n = 1 THEN 50 ELSE 480 + o_custkey % 20 END", "CASE WHEN n = 1 THEN 100 ELSE 94 + o_orderkey % 13 END", "CASE WHEN n = 1 THEN 200 ELSE 30 END", "10", "o_orderkey", source=source, ord_="n")


@query("equation_numbers", rf"""WITH l AS ({number_sql(PAIR)}), p AS (SELECT a.doc_id, abs(b.y0 - a.y0) <= 4.2 AS same FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.ord = 1 AND b.ord = 2) SELECT doc_id, CASE WHEN same THEN 'p:1:9' ELSE 'p:1:{len(TEXTS[PROSE])} p:1:9' END AS paragraphs FROM p""")
def _(spark, d):
    return assembled(spark.sql(number_sql(PAIR_SPARK).replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")))


def rows_sql(source: str) -> str:
    """A table's caption in the middle of a page, and rows 35 points apart around it."""
    return page_sql(f"CASE WHEN n = 12 THEN {TABLE} WHEN (n + o_custkey) % 5 = 0 THEN {SHORT} WHEN (n + o_orderkey) % 7 = 0 THEN {PROSE} ELSE {ROW} END", "50", "40 + 35 * n", "200", "10", "o_orderkey", source=source, ord_="n")


MANY, MANY_SPARK = "(SELECT *, unnest(range(1, 12 + CAST(o_custkey % 9 AS INT))) AS n FROM orders WHERE o_orderkey % 8 = 0)", "(SELECT *, explode(sequence(1, 11 + CAST(o_custkey % 9 AS INT))) AS n FROM orders WHERE o_orderkey % 8 = 0)"


@query("table_paragraphs", rf"""WITH l AS ({rows_sql(MANY)}), c AS (SELECT doc_id, y0 AS cy0, y1 AS cy1 FROM l WHERE kind = {TABLE}),
a AS (SELECT l.doc_id, l.ord, l.kind, l.y0 < cy0 AS above FROM l JOIN c USING (doc_id) WHERE l.kind NOT IN (0, {TABLE}) AND ((l.y0 < cy0 AND l.y1 > cy0 - 440) OR (l.y1 > cy1 AND l.y0 < least(800, cy1 + 440)))),
n AS (SELECT doc_id, above, count(*) FILTER (kind = {ROW}) AS k FROM a GROUP BY ALL), g AS (SELECT a.doc_id, a.ord FROM a JOIN n USING (doc_id, above) WHERE (above AND k >= 8) OR (NOT above AND k >= 4 AND kind = {ROW})),
r AS (SELECT *, CASE WHEN kind = {TABLE} THEN 'c' ELSE 'p' END AS c FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND g.ord = l.ord)) SELECT doc_id, string_agg(concat(c, ':1:', length(text)), ' ' ORDER BY y0) AS paragraphs FROM r GROUP BY doc_id""")
def _(spark, d):
    lines_ = spark.sql(rows_sql(MANY_SPARK).replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    # no run of formulas, so that rows stay rows: they are no formulas for the step before
    return assembled(lines_)


def math_sql(source: str) -> str:
    """Prose, two formula lines, and prose, with gaps that vary."""
    gap = "o_orderkey % 61"
    return page_sql(f"CASE n WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN {PROSE} ELSE {CONTINUED} END WHEN 4 THEN CASE WHEN o_custkey % 3 = 0 THEN {PROSE} ELSE {CONTINUED} END ELSE {FORMULA} END", "CASE WHEN n IN (2, 3) THEN 90 ELSE 50 END", f"CASE n WHEN 1 THEN 100 WHEN 2 THEN 112 + {gap} WHEN 3 THEN 128 + {gap} ELSE 140 + {gap} + o_custkey % 53 END", "200", "CASE WHEN n IN (2, 3) THEN 7 ELSE 10 END", "o_orderkey", source=source, ord_="n")


FOUR, FOUR_SPARK = "(SELECT *, unnest([1, 2, 3, 4]) AS n FROM orders)", "(SELECT *, explode(array(1, 2, 3, 4)) AS n FROM orders)"


@query("unnumbered_math", rf"""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 61 AS g1, o_custkey % 53 AS g2, o_custkey % 2 = 0 AS ended, o_custkey % 3 <> 0 AS goes_on FROM orders),
s AS (SELECT *, 4 + CASE WHEN g1 <= 36 THEN 2 WHEN g1 <= 46.8 THEN 1 ELSE 0 END + CASE WHEN ended THEN 0 ELSE 2 END AS before, 4 + CASE WHEN g2 <= 36 THEN 2 WHEN g2 <= 46.8 THEN 1 ELSE 0 END + 2 + CASE WHEN goes_on THEN 2 ELSE 0 END AS after FROM o),
t AS (SELECT *, CASE WHEN before >= 6 AND after >= 6 THEN CASE WHEN NOT ended THEN 'before' WHEN goes_on THEN 'after' ELSE 'alone' END WHEN before >= 6 THEN 'before' WHEN after >= 6 THEN 'after' ELSE 'alone' END AS goes, CASE WHEN ended THEN {len(TEXTS[PROSE])} ELSE {len(TEXTS[CONTINUED])} END AS la, CASE WHEN goes_on THEN {len(TEXTS[CONTINUED])} ELSE {len(TEXTS[PROSE])} END AS lb FROM s)
SELECT doc_id, CASE goes WHEN 'before' THEN concat('p:1:', la + 7, ' p:1:', lb) WHEN 'after' THEN CASE WHEN goes_on THEN concat('p:1:', la, ' p:1:', lb + 7) ELSE concat('p:1:', la, ' p:1:', lb + 7) END ELSE concat('p:1:', la, ' p:1:6 p:1:', lb) END AS paragraphs FROM t""")
def _(spark, d):
    return assembled(spark.sql(math_sql(FOUR_SPARK).replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")))


# paragraphs of a document


def paragraph_rows(spark, d: str, sql: str) -> DataFrame:
    """Lines as paragraphs of one line each."""
    lines_ = spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    line = F.struct("page_index", *blocks.LINE).cast(assembly.LINE_SQL)
    caption = F.col("kind").isin(TABLE, FIGURE)
    return lines_.select("doc_id", "page_index", "ord", caption.alias("caption"), F.array(line).alias("lines"), "page_w", "page_h", F.lit(12.0).alias("line_h"))


def documents_outcome(rows: DataFrame) -> DataFrame:
    return outcome(assembly.merged_documents(rows).withColumn("page_index", F.lit(0)))


def over_sql(source: str) -> str:
    """A paragraph at the foot of one page and one at the head of the next, under a caption for every third order."""
    y = "CASE n WHEN 1 THEN 640 + o_orderkey % 140 WHEN 2 THEN 10 ELSE 20 + o_custkey % 700 END"
    return page_sql(f"CASE n WHEN 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN {PROSE} ELSE {CONTINUED} END WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN {FIGURE} ELSE {SHORT} END ELSE CASE WHEN o_custkey % 7 = 0 THEN {PROSE} ELSE {CONTINUED} END END", "CASE WHEN n = 3 AND o_custkey % 4 = 0 THEN 320 ELSE 50 END", y, "200", "10", "o_orderkey", "CASE WHEN n = 1 THEN 0 ELSE 1 END", source=source, ord_="n")


THREE, THREE_SPARK = "(SELECT *, unnest([1, 2, 3]) AS n FROM orders)", "(SELECT *, explode(array(1, 2, 3)) AS n FROM orders)"


@query("over_pages", rf"""WITH o AS (SELECT o_orderkey AS doc_id, 652 + o_orderkey % 140 AS foot, 20 + o_custkey % 700 AS head, o_orderkey % 5 <> 0 AS is_open, o_custkey % 3 = 0 AS captioned, o_custkey % 7 <> 0 AS low, o_custkey % 4 <> 0 AS below FROM orders),
m AS (SELECT *, is_open AND low AND below AND ((800 - foot) + head < 24 OR ((800 - foot) < 96 AND (head < 360 OR (captioned AND head < 680)))) AS merges, CASE WHEN is_open THEN {len(TEXTS[CONTINUED])} ELSE {len(TEXTS[PROSE])} END AS la, CASE WHEN captioned THEN 'c:1:{len(TEXTS[FIGURE])}' ELSE 'p:1:{len(TEXTS[SHORT])}' END AS mid, CASE WHEN low THEN {len(TEXTS[CONTINUED])} ELSE {len(TEXTS[PROSE])} END AS lb FROM o)
SELECT doc_id, CASE WHEN merges THEN concat('p:2:', la + lb + 1, ' ', mid) ELSE concat('p:1:', la, ' ', mid, ' p:1:', lb) END AS paragraphs FROM m""")
def _(spark, d):
    return documents_outcome(paragraph_rows(spark, d, over_sql(THREE_SPARK)))


def placeholder_sql(source: str) -> str:
    made = page_sql(f"CASE n WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN {PROSE} ELSE {CONTINUED} END WHEN 2 THEN {EQUATION} ELSE CASE WHEN o_custkey % 3 = 0 THEN {PROSE} ELSE {CONTINUED} END END", "CASE WHEN n = 2 THEN 90 ELSE 50 END", "CASE n WHEN 1 THEN 100 WHEN 2 THEN 112 + o_orderkey % 61 ELSE 124 + o_orderkey % 61 + o_custkey % 53 END", "200", "CASE WHEN n = 2 THEN 7 ELSE 10 END", "o_orderkey", source=source, ord_="n")
    return made.replace(f"'{TEXTS[EQUATION]}'", "'[MATH](4)'")


@query("placeholder_merge", rf"""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 61 AS g1, o_custkey % 53 AS g2, o_custkey % 2 = 0 AS ended, o_custkey % 3 <> 0 AS goes_on FROM orders),
s AS (SELECT *, 4 + CASE WHEN g1 <= 36 THEN 2 WHEN g1 <= 46.8 THEN 1 ELSE 0 END + CASE WHEN ended THEN 0 ELSE 2 END AS before, 4 + CASE WHEN g2 <= 36 THEN 2 WHEN g2 <= 46.8 THEN 1 ELSE 0 END + 2 + CASE WHEN goes_on THEN 2 ELSE 0 END AS after FROM o),
t AS (SELECT *, CASE WHEN before >= 6 AND after >= 6 THEN CASE WHEN NOT ended THEN 'before' WHEN goes_on THEN 'after' ELSE 'alone' END WHEN before >= 6 THEN 'before' WHEN after >= 6 THEN 'after' ELSE 'alone' END AS goes, CASE WHEN ended THEN {len(TEXTS[PROSE])} ELSE {len(TEXTS[CONTINUED])} END AS la, CASE WHEN goes_on THEN {len(TEXTS[CONTINUED])} ELSE {len(TEXTS[PROSE])} END AS lb FROM s),
u AS (SELECT *, CASE WHEN goes = 'after' THEN 4 + CASE WHEN g1 + 12 + g2 <= 36 THEN 2 WHEN g1 + 12 + g2 <= 46.8 THEN 1 ELSE 0 END + CASE WHEN ended THEN 0 ELSE 2 END END AS again FROM t)
SELECT doc_id, CASE goes WHEN 'before' THEN concat('p:1:', la + 10, ' p:1:', lb) WHEN 'after' THEN CASE WHEN 1 + again >= 6 THEN concat('p:1:', la + 11 + lb) ELSE concat('p:1:', la, ' p:1:', lb + 10) END ELSE concat('p:1:', la, ' p:1:9 p:1:', lb) END AS paragraphs FROM u""")
def _(spark, d):
    return documents_outcome(paragraph_rows(spark, d, placeholder_sql(THREE_SPARK)))


DESCRIBED = page_sql(KIND, "50 + l_partkey % 40", "60 + 20 * l_linenumber", "200 + l_suppkey % 9", "CASE l_suppkey % 4 WHEN 0 THEN 0 ELSE 8 + l_suppkey % 4 END", page="l_linenumber % 3").replace(f"'{TEXTS[EQUATION]}'", "'[MATH](4)'").replace(f"'{TEXTS[SHORT]}'", "'Short wor-'")


@query("paragraph_facts", rf"""WITH l AS ({DESCRIBED}), t AS (SELECT doc_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY ord), '([a-z])- ', '\1', 'g')) AS text, CAST(count(*) AS BIGINT) AS n_lines, round(coalesce(median(font_size) FILTER (font_size > 0), 0), 6) AS median_font, min(page_index) + 1 AS p FROM l GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(concat(page_index + 1, '/', CAST(x0 AS INT), '/', CAST(y0 AS INT), '/', CAST(x1 AS INT), '/', CAST(y1 AS INT)), ' ' ORDER BY page_index) AS boxes FROM (SELECT doc_id, page_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l GROUP BY ALL) GROUP BY doc_id),
a AS (SELECT l.doc_id, arg_min(CAST(l.y0 AS INT), (l.kind = {EQUATION}, l.y0, l.x0)) AS anchor_y, arg_min(CAST(l.x0 AS INT), (l.kind = {EQUATION}, l.y0, l.x0)) AS anchor_x FROM l JOIN t ON t.doc_id = l.doc_id AND l.page_index + 1 = t.p GROUP BY l.doc_id)
SELECT doc_id, sha1(text) AS hash, n_lines, median_font, boxes, p AS anchor_page, anchor_x, anchor_y FROM t JOIN b USING (doc_id) JOIN a USING (doc_id)""")
def _(spark, d):
    line = F.struct("page_index", *blocks.LINE).cast(assembly.LINE_SQL)
    rows = page_lines(spark, d, DESCRIBED).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("x")))).alias("lines")).withColumn("lines", F.transform("lines", lambda p: p["x"]))
    made = layout.described(rows)
    box = lambda b: F.concat_ws("/", b["page"].cast("string"), *[b[n].cast("int").cast("string") for n in ("x0", "y0", "x1", "y1")])
    return made.select("doc_id", "hash", "n_lines", F.round("median_font", 6).alias("median_font"), F.array_join(F.transform("bboxes", box), " ").alias("boxes"), F.col("anchor.page").alias("anchor_page"), F.col("anchor.x0").cast("int").alias("anchor_x"), F.col("anchor.y0").cast("int").alias("anchor_y"))


# from paragraphs to kept ones

MARKED = "CASE WHEN ord = 7 AND doc_id % 3 = 0 THEN 'References' WHEN ord % 11 = 8 THEN concat('[12] Smith, J. et al. 1999 ', text) WHEN ord % 9 = 4 THEN concat('2.1 ', left(text, 20)) WHEN ord % 13 = 5 THEN '12 3.4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18' ELSE text END"
PARAS = LINES + f", p AS (SELECT doc_id, ord, {MARKED} AS text, ord % 6 = 1 AS caption, CAST(6 + (doc_id + ord * 7) % 9 AS DOUBLE) * CAST(ord % 10 > 0 AS INT) AS median_font, 1 + CAST(floor(ord / 4.0) AS INT) AS page FROM l)"


def marked_paragraphs(spark, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("text", F.expr(MARKED)).withColumn("caption", F.expr("ord % 6 = 1"))
    rows = rows.withColumn("median_font", F.expr("cast(6 + (doc_id + ord * 7) % 9 as double) * cast(ord % 10 > 0 as int)")).withColumn("page", F.expr("1 + cast(floor(ord / 4.0) as int)"))
    box = F.struct(F.col("page"), (F.col("ord") * 10.0).alias("x0"), F.lit(5.0).alias("y0"), (F.col("ord") * 10.0 + 100).alias("x1"), F.lit(17.0).alias("y1"))
    anchor = F.when(F.col("ord") % 2 == 0, box)
    return rows.select("doc_id", "ord", "text", "caption", "median_font", F.array("page").alias("pages"), F.array(box, box).alias("bboxes"), anchor.alias("anchor"))


REFS = r"(CASE WHEN length(text) < 12 THEN 0 ELSE (CASE WHEN regexp_matches(text, '^\[\d{1,4}\]') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(text, '^\d{1,4}[.)]\s+') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(text, '\b(19|20)\d{2}\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '(?i)\b(?:et al\.|arXiv|doi|vol\.|pp\.|Proc\.|Proceedings)\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '^[A-Z][A-Za-z\x27`-]+,\s+[A-Z]') THEN 1 ELSE 0 END) END)"


@query("references_cut", PARAS + rf""", n AS (SELECT *, CAST(page AS DOUBLE) / max(page) OVER (PARTITION BY doc_id) AS ratio, coalesce(lead({REFS}, 1) OVER w, 0) >= 2 OR coalesce(lead({REFS}, 2) OVER w, 0) >= 2 AS near FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
c AS (SELECT *, max(CASE WHEN text = 'References' AND NOT caption AND ratio >= 0.3 AND (near OR ratio >= 0.85) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS cut FROM n) SELECT doc_id, count(*) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars FROM c WHERE cut = 0 GROUP BY doc_id""")
def _(spark, d):
    kept = P.cut_references(marked_paragraphs(spark, d))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("chars"))
