"""All queries over the driver tables, and their SQL.

The tables have no page layout, so they stand for it: a line of a document for a paragraph, a document for a PDF, its source for
an item, benchmark texts for stored hashes, labels for tags, conversation turns for paragraphs with neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import paragraphs as P
from ..operators import position as pos
from ..operators import reconcile as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same relation as split_lines, for the oracles.
LINES = r"""WITH raw AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS ord, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS text
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)) """
WORDS = "(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END)"
SENTENCE = rf"(regexp_matches(text, '[a-z]') AND {WORDS} >= 6 AND regexp_matches(text, '[.!?][\x22\x27)\]]*\s*$'))"
LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
SIGNS = r"(length(text) - length(regexp_replace(text, '[=∈→←{}\\_^]', '', 'g')))"
PROSE = f"({WORDS} >= 6 AND {LETTERS} >= 15 AND NOT ({SIGNS} >= 4 AND {SIGNS} > {LETTERS} * 0.15))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, pattern: str = "\n") -> DataFrame:
    return P.split_lines(table(spark, sf_dir, "documents"), pattern)


def stored_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(T.content_hash(F.col("text")).alias("hash"))


STORED = r"s AS (SELECT DISTINCT sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM benchmark)"


@query("new_paragraphs_by_lang", LINES + f", {STORED} SELECT lang, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars FROM l WHERE length(text) BETWEEN 60 AND 1500 AND sha1(text) NOT IN (SELECT hash FROM s) GROUP BY lang")
def _(spark, d):
    fresh = R.unseen(lines(spark, d).where(P.length_between(F.col("text"))).withColumn("hash", T.content_hash(F.col("text"))), stored_hashes(spark, d))
    return fresh.groupBy("lang").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query("para_normalize_hash", LINES + "SELECT doc_id, ord, sha1(text) AS hash, length(text) AS chars FROM l")
def _(spark, d):
    return lines(spark, d).select("doc_id", "ord", T.content_hash(F.col("text")).alias("hash"), F.length("text").alias("chars"))


@query("text_predicates", LINES + rf"""SELECT doc_id, ord, {SENTENCE} AS sentence, {PROSE} AS prose,
regexp_matches(text, '^(?:[a-z]|[,)\]}}]|(?:and|or|where|which|that|with|for|to)\b)') AS continues,
text <> '' AND length(text) <= 80 AND NOT regexp_matches(text, '[.!?][\x22\x27)\]]*\s*$') AND NOT regexp_matches(text, '[,;]') AND NOT regexp_matches(text, '[=∈→←{{}}\\_]') AND (
 (regexp_matches(text, '^\d{{1,2}}(?:\.\d{{1,2}})*\s+') AND {WORDS} BETWEEN 2 AND 18 AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[.:;]$'))
 OR (regexp_matches(text, '(?i)^[IVXLC]{{1,6}}\s+') AND {WORDS} BETWEEN 2 AND 12 AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[.:;]$'))
 OR (regexp_matches(text, '(?i)^(?:\d{{1,2}}(?:\.\d{{1,2}})*|[IVXLC]{{1,6}})\s+[A-Za-z][A-Za-z0-9-]*(?:\s+(?:[A-Za-z][A-Za-z0-9-]*|vs\.?))*$') AND {WORDS} <= 18)
 OR regexp_matches(text, '(?i)^(?:Abstract|Introduction|Background|Conclusions?|Related Work|References|Acknowledge?ments?)$')) AS heading FROM l""")
def _(spark, d):
    t = F.col("text")
    return lines(spark, d).select("doc_id", "ord", T.is_sentence(t).alias("sentence"), T.is_prose(t).alias("prose"), T.starts_continuation(t).alias("continues"), T.is_heading(t).alias("heading"))


def _score_sql(percent: str) -> str:
    tk = "list_filter(string_split(text, ' '), lambda t: t <> '')"
    worded = f"list_filter({tk}, lambda t: regexp_matches(t, '[A-Za-z]'))"
    return rf"""round(CASE WHEN text = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 0.55::DOUBLE * len(list_filter({tk}, lambda t: regexp_matches(t, '^[+\-−]?\d+(?:\.\d+)?{percent}$'))) / greatest(len({tk}), 1)
 + 0.22::DOUBLE * len(list_filter({tk}, lambda t: length(t) <= 2)) / greatest(len({tk}), 1)
 + 0.18::DOUBLE * len(list_filter({worded}, lambda t: regexp_matches(t, '^\p{{Lu}}') OR suffix(t, '.'))) / greatest(len({worded}), 1)
 + CASE WHEN len({tk}) >= 12 THEN 0.15::DOUBLE ELSE 0.0 END - CASE WHEN {SENTENCE} THEN 0.7::DOUBLE ELSE 0.0 END)) END, 6)"""


@query("table_like_score", LINES + f"SELECT doc_id, ord, {_score_sql('%?')} AS score, {_score_sql('')} AS strict_score FROM l")
def _(spark, d):
    t = F.col("text")
    return lines(spark, d).select("doc_id", "ord", F.round(T.table_score(t), 6).alias("score"), F.round(T.table_score(t, percent=False), 6).alias("strict_score"))


INJECT = "CASE WHEN ord % 5 = 0 THEN concat('Figure ', CAST(ord AS VARCHAR), ': ', text) WHEN ord % 5 = 1 THEN concat('Table IV. ', text) WHEN ord % 5 = 2 THEN concat('[12] Smith, J. et al. 1999 ', text) WHEN ord % 5 = 3 THEN concat('7. Doe (2004) doi ', text) ELSE text END"


def injected(df: DataFrame) -> DataFrame:
    """Captions and reference entries, which the tables lack, put before lines by their number."""
    n = F.col("ord") % 5
    t = F.col("text")
    made = F.when(n == 0, F.concat(F.lit("Figure "), F.col("ord").cast("string"), F.lit(": "), t)).when(n == 1, F.concat(F.lit("Table IV. "), t)).when(n == 2, F.concat(F.lit("[12] Smith, J. et al. 1999 "), t)).when(n == 3, F.concat(F.lit("7. Doe (2004) doi "), t)).otherwise(t)
    return df.withColumn("text", F.trim(made))


@query("caption_flags", LINES + rf", j AS (SELECT doc_id, ord, trim({INJECT}) AS text FROM l) SELECT doc_id, ord, regexp_matches(text, '(?i)^(?:Figure|Fig\.?|Table|Tbl\.?|図|表)\s*(?:\d+|[IVXLC]+)\s*[:.]') AS caption, text <> '' AND length(text) <= 120 AND NOT regexp_matches(text, '^\p{{Ll}}') AND (contains(text, ',') OR {WORDS} <= 6) AS caption_more FROM j")
def _(spark, d):
    t = F.col("text")
    return injected(lines(spark, d)).select("doc_id", "ord", T.is_caption(t).alias("caption"), T.continues_caption(t).alias("caption_more"))


@query("reference_entries", LINES + rf", j AS (SELECT doc_id, ord, trim({INJECT}) AS text FROM l) SELECT doc_id, ord, CASE WHEN length(text) < 12 THEN 0 ELSE (CASE WHEN regexp_matches(text, '^\[\d{{1,4}}\]') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(text, '^\d{{1,4}}[.)]\s+') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(text, '\b(19|20)\d{{2}}\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '(?i)\b(?:et al\.|arXiv|doi|vol\.|pp\.|Proc\.|Proceedings)\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '^[A-Z][A-Za-z\x27`-]+,\s+[A-Z]') THEN 1 ELSE 0 END) END AS points, regexp_matches(text, '^\s*(?:\[\s*\d{{1,4}}\s*\]|\d{{1,4}}\.)\s+\S') AS bib_entry FROM j")
def _(spark, d):
    t = F.col("text")
    return injected(lines(spark, d)).select("doc_id", "ord", T.reference_score(t).alias("points"), T.is_bib_entry(t).alias("bib_entry"))


@query("running_header_drop", LINES + r", r AS (SELECT text FROM l WHERE length(text) >= 12 AND NOT regexp_matches(text, '^\d{1,4}$') GROUP BY text HAVING count(DISTINCT doc_id) >= 3) SELECT doc_id, count(*) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars FROM l WHERE text NOT IN (SELECT text FROM r) GROUP BY doc_id")
def _(spark, d):
    return P.drop_running_headers(lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("chars"))


@query("auto_threshold", "SELECT list_sort(list(n_chars))[CAST(round_even(0.75 * (count(*) - 1), 0) AS BIGINT) + 1] AS value, round(0.8 * list_sort(list(n_chars))[CAST(round_even(0.75 * (count(*) - 1), 0) AS BIGINT) + 1], 6) AS threshold FROM documents")
def _(spark, d):
    return P.nearest_rank(table(spark, d, "documents"), "n_chars").select("value", F.round(F.col("value") * 0.8, 6).alias("threshold"))


FRAGS = LINES.replace("string_split(text, chr(10))", r"regexp_split_to_array(text, ',\s|\n')")
ISLANDS = FRAGS + r""", m AS (SELECT *, CASE WHEN lag(text) OVER w IS NOT NULL AND regexp_matches(text, '^([a-z]|[,)\]])') AND NOT regexp_matches(lag(text) OVER w, '[.!?][\x22\x27)\]]*\s*$') THEN 0 ELSE 1 END AS brk FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM m) """


@query("continuation_merge", ISLANDS + r"SELECT doc_id, min(ord) AS ord, sha1(trim(regexp_replace(string_agg(text, ' ' ORDER BY ord), '\s+', ' ', 'g'))) AS merged_hash, sha1(arg_min(text, ord)) AS hash, count(*) AS parts FROM i GROUP BY doc_id, island")
def _(spark, d):
    merged = P.merge_continuations(lines(spark, d, r",\s|\n"))
    return merged.select("doc_id", "ord", F.sha1(F.encode("text", "UTF-8")).alias("merged_hash"), "hash", F.size("hashes").cast("long").alias("parts"))


@query("references_latch", LINES + r", j AS (SELECT doc_id, ord, CASE WHEN ord = 4 AND doc_id % 2 = 0 THEN ' references ' WHEN ord % 7 = 3 THEN concat('[', ord, '] ', text) ELSE text END AS text FROM l), f AS (SELECT *, max(CASE WHEN regexp_matches(text, '(?i)^\s*(?:References|Bibliography)\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS latch FROM j) SELECT doc_id, count(*) AS kept, max(ord) AS last_ord FROM f WHERE latch = 0 AND NOT regexp_matches(text, '^\s*(?:\[\s*\d{1,4}\s*\]|\d{1,4}\.)\s+\S') GROUP BY doc_id")
def _(spark, d):
    from ..operators import adapter

    text = F.expr("case when ord = 4 and doc_id % 2 = 0 then ' references ' when ord % 7 = 3 then concat('[', ord, '] ', text) else text end")
    kept = adapter.without_references(lines(spark, d).withColumn("text", text))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.max("ord").alias("last_ord"))


@query("dedup_anti_join", LINES + ", e AS (SELECT DISTINCT sha1(text) AS hash FROM l WHERE source = 'src0') SELECT source, count(*) AS fresh FROM l WHERE source <> 'src0' AND sha1(text) NOT IN (SELECT hash FROM e) GROUP BY source")
def _(spark, d):
    hashed = lines(spark, d).withColumn("hash", T.content_hash(F.col("text")))
    return R.unseen(hashed.where("source <> 'src0'"), hashed.where("source = 'src0'")).groupBy("source").agg(F.count("*").alias("fresh"))


@query("capped_dedup", LINES + ", e AS (SELECT DISTINCT sha1(text) AS hash FROM l WHERE lang = 'en' AND source = 'src0'), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM l) SELECT doc_id, count(*) AS capped, count(*) FILTER (sha1(text) NOT IN (SELECT hash FROM e)) AS planned FROM c WHERE k <= 100 GROUP BY doc_id")
def _(spark, d):
    hashed = lines(spark, d).withColumn("hash", T.content_hash(F.col("text")))
    stored = hashed.where("lang = 'en' and source = 'src0'").select("hash").distinct().withColumn("known", F.lit(1))
    return R.capped(hashed, "doc_id", "ord").join(stored, "hash", "left").groupBy("doc_id").agg(F.count("*").alias("capped"), F.count_if(F.col("known").isNull()).alias("planned"))


@query("existing_tags", LINES + "SELECT DISTINCT concat('para:', sha1(text)) AS tag FROM l WHERE length(text) >= 60")
def _(spark, d):
    return lines(spark, d).where(F.length("text") >= 60).select(F.concat(F.lit("para:"), T.content_hash(F.col("text"))).alias("tag")).distinct()


@query("json_audit", "SELECT event_type, count(*) FILTER (NOT json_valid(x)) AS invalid, count(*) FILTER (json_valid(x)) AS valid FROM (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN concat(props, '}') ELSE props END AS x FROM events) GROUP BY event_type")
def _(spark, d):
    x = F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    bad = ~T.is_json(x)
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(bad).alias("invalid"), F.count_if(~bad).alias("valid"))


@query("repair_first_match", LINES + ", p AS (SELECT sha1(text) AS tag, max(doc_id * 100000 + ord) AS value FROM l WHERE lang = 'en' GROUP BY 1), a AS (SELECT doc_id, ord, sha1(text) AS tag FROM l WHERE lang <> 'de') SELECT doc_id, arg_min(a.tag, ord) AS tag, arg_min(value, ord) AS value FROM a JOIN p USING (tag) GROUP BY doc_id")
def _(spark, d):
    hashed = lines(spark, d).withColumn("tag", T.content_hash(F.col("text")))
    place = (F.col("doc_id") * 100000 + F.col("ord")).alias("value")
    candidates = hashed.where("lang = 'en'").select("tag", place, place.alias("rank"))
    return R.first_match(hashed.where("lang <> 'de'").select("doc_id", "tag", F.col("ord").alias("tag_ord")), candidates, "doc_id", "tag", "rank")


@query("audit_missing", LINES + f", {STORED}, a AS (SELECT DISTINCT source, sha1(text) AS hash, length(text) BETWEEN 60 AND 1500 AS required FROM l WHERE length(text) <= 20000) SELECT source, count(*) FILTER (required) AS missing_filtered, count(*) AS missing_all FROM a WHERE hash NOT IN (SELECT hash FROM s) GROUP BY source")
def _(spark, d):
    wanted = lines(spark, d).where(F.length("text") <= 20000).select("source", T.content_hash(F.col("text")).alias("hash"), P.length_between(F.col("text")).alias("required")).distinct()
    return R.unseen(wanted, stored_hashes(spark, d)).groupBy("source").agg(F.count_if("required").alias("missing_filtered"), F.count("*").alias("missing_all"))


@query("completion_check", LINES + ", e AS (SELECT DISTINCT sha1(text) AS hash FROM l WHERE source = 'src0') SELECT doc_id, bool_and(sha1(text) IN (SELECT hash FROM e)) AS complete, count(*) AS required FROM l GROUP BY doc_id")
def _(spark, d):
    hashed = lines(spark, d).select("doc_id", "source", T.content_hash(F.col("text")).alias("hash"))
    stored = hashed.where("source = 'src0'").select("hash").distinct().withColumn("known", F.lit(True))
    return hashed.join(stored, "hash", "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("complete"), F.count("*").alias("required"))


@query("tag_transition", "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(tags, ['base-done'])), lambda t: NOT list_contains(gone, t))), ',') AS tags FROM (SELECT doc_id, CASE WHEN quality = 1 THEN ['to-translate', 'good'] ELSE ['to-translate'] END AS tags, CASE WHEN toxic = 1 THEN ['to-translate', 'base-done'] ELSE ['to-translate'] END AS gone FROM labels)")
def _(spark, d):
    have = F.when(F.col("quality") == 1, F.array(F.lit("to-translate"), F.lit("good"))).otherwise(F.array(F.lit("to-translate")))
    gone = F.when(F.col("toxic") == 1, F.array(F.lit("to-translate"), F.lit("base-done"))).otherwise(F.array(F.lit("to-translate")))
    return table(spark, d, "labels").select("doc_id", F.array_join(R.merged_tags(have, F.array(F.lit("base-done")), gone), ",").alias("tags"))


@query("para_tag_split", LINES + "SELECT doc_id, ord, regexp_matches(h, '^[0-9a-f]{40}$') AS valid FROM (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN upper(sha1(text)) ELSE sha1(text) END AS h FROM l) WHERE NOT (ord IS NULL)")
def _(spark, d):
    h = T.content_hash(F.col("text"))
    tag = F.concat(F.lit("para:"), F.when(F.col("ord") % 3 == 0, F.upper(h)).otherwise(h))
    good, _bad = R.split_para_tags(F.array(tag, F.lit("other")))
    return lines(spark, d).select("doc_id", "ord", (F.size(good) == 1).alias("valid"))


@query("context_window", "SELECT conv_id, turn, md5(coalesce(lag(text) OVER w, '')) AS prev_md5, md5(text) AS md5, md5(coalesce(lead(text) OVER w, '')) AS next_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    return P.with_context(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.md5("prev_text").alias("prev_md5"), F.md5("text").alias("md5"), F.md5("next_text").alias("next_md5"))


@query("source_snippet", LINES + "SELECT doc_id, ord, CASE WHEN length(text) <= 30 THEN text ELSE concat(rtrim(left(text, 10)), ' … ', ltrim(right(text, 10))) END AS snippet, CASE WHEN text = '' THEN '-' WHEN length(text) <= 24 THEN text ELSE concat(left(text, 23), '…') END AS short FROM l")
def _(spark, d):
    return lines(spark, d).select("doc_id", "ord", T.snippet(F.col("text")).alias("snippet"), T.truncate(F.col("text"), 24).alias("short"))


@query("note_position", "SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS page_index, round(l_quantity * 10 - 30, 6) AS x1, round(842.0::DOUBLE - (l_discount * 1000 + l_tax * 100) + 5, 6) AS y1, printf('%05d|000000|%05d', l_linenumber - 1, CAST(round_even(842.0::DOUBLE - (l_discount * 1000 + l_tax * 100), 0) AS BIGINT)) AS sort_index FROM lineitem")
def _(spark, d):
    coords = F.array(F.struct(F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y"), F.lit(1.0).alias("w"), (F.col("l_tax") * 100).alias("h")))
    p = pos.note_position(coords, F.lit(842.0), F.lit(595.0))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "p.page_index", F.round("p.x1", 6).alias("x1"), F.round("p.y1", 6).alias("y1"), "p.sort_index")


@query("dominant_size", "SELECT key, arg_max(w, (n, score, -first)) AS w, arg_max(h, (n, score, -first)) AS h, max(n) AS n FROM (SELECT p_brand AS key, CAST(p_size AS DOUBLE) AS w, CAST(p_size * 2 AS DOUBLE) AS h, count(*) AS n, sum(1 + p_partkey % 2) AS score, min(p_partkey) AS first FROM part WHERE p_size > 0 GROUP BY 1, 2, 3) GROUP BY key")
def _(spark, d):
    size = F.col("p_size").cast("double")
    boxes = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"), (1 + F.col("p_partkey") % 2).alias("score"), size.alias("w"), (size * 2).alias("h"))
    return pos.dominant_size(boxes, "key")


@query("page_size_lookup", "SELECT o.doc_id, o.page_index, coalesce(s.w, z.w) AS w, coalesce(s.h, z.h) AS h FROM (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_index FROM lineitem) o LEFT JOIN (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_index, l_quantity AS w, l_quantity * 2 AS h FROM lineitem WHERE l_linenumber <> 3) s USING (doc_id, page_index) LEFT JOIN (SELECT l_orderkey AS doc_id, l_quantity AS w, l_quantity * 2 AS h FROM lineitem WHERE l_linenumber = 1) z USING (doc_id)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_index"), "l_quantity")
    sizes = rows.where("page_index <> 2").select("doc_id", "page_index", F.col("l_quantity").alias("w"), (F.col("l_quantity") * 2).alias("h"))
    return pos.page_size(rows.select("doc_id", "page_index"), sizes)


@query("batch_assign", "SELECT source, batch, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 10) AS BIGINT) AS batch FROM documents) GROUP BY 1, 2")
def _(spark, d):
    return R.batches(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"]).groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


STATUS = "[400, 401, 402, 403, 429, 456, 500, 503][CAST(event_id % 8 AS INTEGER) + 1]"


@query("error_classify", f"SELECT event_id, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 402 THEN 'quota' WHEN regexp_matches(lower(event_type), 'quota|billing') THEN 'quota' WHEN s = 429 THEN 'rate_limit' ELSE 'temporary' END AS chat, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'rate_limit' WHEN s = 456 THEN 'quota' ELSE 'temporary' END AS deepl FROM (SELECT event_id, event_type, {STATUS} AS s FROM events)")
def _(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in (400, 401, 402, 403, 429, 456, 500, 503)]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.error_kind(s, F.col("event_type")).alias("chat"), T.error_kind(s, F.col("event_type"), "deepl").alias("deepl"))


@query("fail_fast_item", "WITH f AS (SELECT conv_id, turn, max(CASE WHEN length(text) % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS bad FROM conversations) SELECT conv_id, count(*) FILTER (bad = 0) AS written, count(*) AS total, max(bad) = 1 AS failed FROM f GROUP BY conv_id")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 11 == 0).alias("bad"))
    kept = R.until_first_error(rows, "conv_id", "turn", F.col("bad")).groupBy("conv_id").agg(F.count("*").alias("written"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("total"), F.bool_or("bad").alias("failed")).join(kept, "conv_id", "left").select("conv_id", F.coalesce("written", F.lit(0)).cast("long").alias("written"), "total", "failed")


@query("raw_page_text", r"SELECT page_id, length(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS chars, md5(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS md5 FROM pages")
def _(spark, d):
    clean = T.scrub(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(clean).alias("chars"), F.md5(clean).alias("md5"))


@query("answer_postprocess", r"SELECT conv_id, turn, nullif(trim(regexp_replace(text, '(?i)^(?:here is the translation|translation|translated(?:\s+text)?|output)\s*[:：]?\s*', '')), '') AS answer FROM conversations")
def _(spark, d):
    made = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Translation: "), F.col("text"))).otherwise(F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_answer(made).alias("answer"))


@query("layout_reconstruct")
def _(spark, d):
    from ..operators import layout

    return layout.paragraphs_of(layout.layout_of_texts(table(spark, d, "documents")))


@query("layout_document")
def _(spark, d):
    from ..operators import layout

    return layout.document_paragraphs(layout.layout_of_texts(table(spark, d, "documents")))
