"""Queries of the paragraph chain, the library, annotations and text providers over the driver tables, and their SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import adapter, blocks, enrich, library, providers
from ..operators import annotations as A
from ..operators import paragraphs as P
from ..operators import position as pos
from ..operators import reconcile as R
from ..sources import layout_json
from .catalogue import LETTERS, LINES, PROSE, SENTENCE, SIGNS, STORED, WORDS, _score_sql, injected, lines, query, stored_hashes, table
from .layout_queries import PARAS, marked_paragraphs

HEADING = rf"""(text <> '' AND length(text) <= 80 AND NOT regexp_matches(text, '[.!?][\x22\x27)\]]*\s*$') AND NOT regexp_matches(text, '[,;]') AND NOT regexp_matches(text, '[=∈→←{{}}\\_]') AND (
 (regexp_matches(text, '^\d{{1,2}}(?:\.\d{{1,2}})*\s+') AND {WORDS} BETWEEN 2 AND 18 AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[.:;]$'))
 OR (regexp_matches(text, '(?i)^[IVXLC]{{1,6}}\s+') AND {WORDS} BETWEEN 2 AND 12 AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[.:;]$'))
 OR (regexp_matches(text, '(?i)^(?:\d{{1,2}}(?:\.\d{{1,2}})*|[IVXLC]{{1,6}})\s+[A-Za-z][A-Za-z0-9-]*(?:\s+(?:[A-Za-z][A-Za-z0-9-]*|vs\.?))*$') AND {WORDS} <= 18)
 OR regexp_matches(text, '(?i)^(?:Abstract|Introduction|Background|Conclusions?|Related Work|References|Acknowledge?ments?)$')))"""
ENTRY = r"regexp_matches(text, '^\s*(?:\[\s*\d{1,4}\s*\]|\d{1,4}\.)\s+\S')"
MATHISH = rf"(text <> '' AND NOT {PROSE} AND (regexp_matches(text, '[=∈→←{{}}\\_^∇γθρ≈∼∞·]') OR regexp_matches(text, '\b(?:max|min|argmax|argmin|Es?|Q|Li)\b') OR (length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) >= 3 AND {LETTERS} <= 10)))"

# the paragraph chain


@query("mathish_lines", LINES + f", j AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN concat('x_', ord, ' = {{y}} \\') WHEN ord % 3 = 1 THEN left(text, 12) ELSE text END AS text FROM l), t AS (SELECT doc_id, ord, trim(text) AS text FROM j) SELECT doc_id, ord, {MATHISH} AS mathish, {SIGNS} AS signs FROM t")
def _(spark, d):
    t = F.expr(r"trim(case when ord % 3 = 0 then concat('x_', ord, ' = {y} \\') when ord % 3 = 1 then left(text, 12) else text end)")
    rows = lines(spark, d).withColumn("text", t)
    return rows.select("doc_id", "ord", T.is_mathish(F.col("text")).alias("mathish"), (F.length("text") - F.length(F.regexp_replace("text", T.MATH_SIGNS, ""))).alias("signs"))


@query("adapter_filters", PARAS + rf""", u AS (SELECT doc_id, 0.8 * list_sort(list(median_font))[CAST(round_even(0.75 * (count(*) - 1), 0) AS BIGINT) + 1] AS least FROM p WHERE median_font > 0 AND NOT caption GROUP BY doc_id),
q AS (SELECT p.*, coalesce(least, 0) AS least, max(CASE WHEN regexp_matches(text, '(?i)^\s*(?:References|Bibliography)\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS latch FROM p LEFT JOIN u USING (doc_id) WHERE NOT caption AND trim(text) <> '')
SELECT doc_id, ord, sha1(text) AS hash, page, page AS place, CAST(ord * 10 AS DOUBLE) AS x, CAST(CASE WHEN ord % 2 = 0 THEN 1 ELSE 2 END AS INT) AS places FROM q WHERE latch = 0 AND NOT {ENTRY} AND NOT {HEADING} AND NOT ({WORDS} >= 14 AND {_score_sql('%?')} >= 0.35) AND length(text) BETWEEN 60 AND 1500 AND NOT (least > 0 AND median_font > 0 AND median_font < least)""")
def _(spark, d):
    kept = adapter.filtered_paragraphs(marked_paragraphs(spark, d), Settings(skip_captions=True))
    return kept.select("doc_id", "ord", T.content_hash(F.col("text")).alias("hash"), "page", F.col("coords")[0]["page"].alias("place"), F.col("coords")[0]["x"].alias("x"), F.size("coords").alias("places"))


@query("table_rows_drop", PARAS + f" SELECT doc_id, count(*) AS kept FROM p WHERE caption OR NOT ({WORDS} >= 14 AND {_score_sql('%?')} >= 0.35) GROUP BY doc_id")
def _(spark, d):
    return adapter.without_table_rows(marked_paragraphs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("kept"))


FRAGMENTS = LINES.replace("string_split(text, chr(10))", r"regexp_split_to_array(text, ',\s|\n')").replace("WITH raw", "WITH RECURSIVE raw")
CAPTIONED = r"(regexp_matches(f.now, '(?i)^(?:Figure|Fig\.?|Table|Tbl\.?|図|表)\s*(?:\d+|[IVXLC]+)\s*[:.]') OR {})"
MORE = r"(trim({0}) <> '' AND length(trim({0})) <= 120 AND NOT regexp_matches(trim({0}), '^\p{{Ll}}') AND (contains({0}, ',') OR len(string_split(trim({0}), ' ')) <= 6))"


@query("continuation_merge_caption", FRAGMENTS + rf""", j AS (SELECT doc_id, ord, trim(CASE WHEN ord % 5 = 0 THEN concat('Figure ', ord, ': ', text) WHEN ord % 5 = 1 THEN concat('Table IV. ', text) WHEN ord % 5 = 2 THEN concat('[12] Smith, J. et al. 1999 ', text) WHEN ord % 5 = 3 THEN concat('7. Doe (2004) doi ', text) ELSE text END) AS text FROM l),
f AS (SELECT doc_id, ord, ord AS head, text AS now FROM j WHERE ord = 0 UNION ALL SELECT j.doc_id, j.ord, CASE WHEN m.joins THEN f.head ELSE j.ord END, CASE WHEN m.joins THEN trim(concat(rtrim(f.now), ' ', ltrim(j.text))) ELSE j.text END FROM f JOIN j ON j.doc_id = f.doc_id AND j.ord = f.ord + 1,
 LATERAL (SELECT CASE WHEN {CAPTIONED.format(MORE.format('f.now'))} THEN {MORE.format('j.text')} ELSE regexp_matches(ltrim(j.text), '^([a-z]|[,)\]])') AND NOT regexp_matches(f.now, '[.!?][\x22\x27)\]]*\s*$') END AS joins) m)
SELECT doc_id, head AS ord, sha1(arg_max(now, ord)) AS hash, arg_max(length(now), ord) AS chars FROM f GROUP BY doc_id, head""")
def _(spark, d):
    merged = P.merge_captions(injected(lines(spark, d, r",\s|\n")))
    return merged.select("doc_id", "ord", "hash", F.length("text").alias("chars"))


@query("heading_only_drop", LINES + r""", j AS (SELECT doc_id, lang, ord, trim(CASE WHEN ord % 4 = 0 THEN concat('3.1 ', left(text, 30)) WHEN ord % 4 = 1 THEN upper(left(text, 25)) WHEN ord % 4 = 2 THEN concat('Appendix ', left(text, 50)) ELSE text END) AS text, 1 + ord % 3 AS n FROM l),
b AS (SELECT *, regexp_replace(text, '^(?:[A-Z]?\d+(?:\.\d+)*)\s+', '') AS bare FROM j)
SELECT lang, count(*) AS kept FROM b WHERE NOT (text <> '' AND length(text) <= 90 AND n <= 2 AND NOT regexp_matches(text, '[.!?;:]\s*$') AND ((regexp_matches(text, '^\d{1,2}(?:\.\d{1,2})*\s+\S') AND len(string_split(text, ' ')) <= 14) OR (bare <> '' AND len(string_split(bare, ' ')) <= 10 AND len(list_filter(string_split(bare, ' '), lambda t: regexp_matches(t, '[A-Za-z]'))) > 0 AND len(list_filter(string_split(bare, ' '), lambda t: regexp_matches(t, '[A-Za-z]') AND t <> upper(t))) = 0) OR regexp_matches(text, '(?i)^(?:Abstract|Introduction|Conclusions?|References|Appendix)\b'))) GROUP BY lang""")
def _(spark, d):
    cut = F.expr("case when ord % 4 = 0 then concat('3.1 ', left(text, 30)) when ord % 4 = 1 then left(text, 25) when ord % 4 = 2 then concat('Appendix ', left(text, 50)) else text end")
    made = lines(spark, d).withColumn("text", cut)
    rows = made.withColumn("text", F.trim(F.when(F.col("ord") % 4 == 1, T.upper(F.col("text"))).otherwise(F.col("text")))).withColumn("n", F.expr("1 + ord % 3"))
    return rows.where(~blocks.is_heading_only(F.col("text"), F.col("n"))).groupBy("lang").agg(F.count("*").alias("kept"))


@query("tiny_noise_drop", LINES + r", j AS (SELECT doc_id, lang, trim(CASE WHEN ord % 3 = 0 THEN left(text, 7) WHEN ord % 3 = 1 THEN concat('[MATH]', left(text, 2)) ELSE left(text, 9) END) AS text FROM l) SELECT lang, count(*) AS kept FROM j WHERE NOT (text <> '' AND NOT starts_with(text, '[MATH]') AND length(text) <= 8 AND len(string_split(text, ' ')) <= 2 AND NOT regexp_matches(text, '^\d{1,2}(?:\.\d{1,2})*\s+\S')) GROUP BY lang")
def _(spark, d):
    rows = lines(spark, d).withColumn("text", F.expr("trim(case when ord % 3 = 0 then left(text, 7) when ord % 3 = 1 then concat('[MATH]', left(text, 2)) else left(text, 9) end)"))
    return rows.where(~blocks.is_tiny_noise(F.col("text"))).groupBy("lang").agg(F.count("*").alias("kept"))


@query("length_filter_summary", LINES + "SELECT source, count(*) AS total, count(*) FILTER (length(text) < 60) AS short, count(*) FILTER (length(text) > 1500) AS long, count(*) FILTER (length(text) BETWEEN 60 AND 1500) AS kept FROM l GROUP BY source")
def _(spark, d):
    n, keeps = F.length("text"), P.length_between(F.col("text"))
    return lines(spark, d).groupBy("source").agg(F.count("*").alias("total"), F.count_if(~keeps & (n < 60)).alias("short"), F.count_if(~keeps & (n > 60)).alias("long"), F.count_if(keeps).alias("kept"))


@query("source_suffix", LINES + "SELECT doc_id, ord, md5(CASE WHEN text = '' THEN md5(text) WHEN length(text) <= 30 THEN concat(md5(text), chr(10), chr(10), 'SRC: ', text) ELSE concat(md5(text), chr(10), chr(10), 'SRC: ', rtrim(left(text, 10)), ' … ', ltrim(right(text, 10))) END) AS md5 FROM l")
def _(spark, d):
    return lines(spark, d).select("doc_id", "ord", F.md5(T.with_source(F.md5("text"), F.col("text"))).alias("md5"))


# the library


@query("items_by_tag", "SELECT doc_id AS key, quality, toxic FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 25")
def _(spark, d):
    items = table(spark, d, "labels").withColumn("tags", F.expr("filter(array(if(toxic = 1, 'to-translate', ''), if(quality = 1, 'good', '')), t -> t <> '')")).withColumnRenamed("doc_id", "key")
    return library.items_by_tag(items, "to-translate", 25).select("key", "quality", "toxic")


@query("point_lookup", "SELECT o_custkey AS key, o_orderkey, c_name IS NOT NULL AS found, coalesce(c_name, '') AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def _(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    items = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return library.looked_up(keys, items).select("key", "o_orderkey", "found", F.coalesce("name", F.lit("")).alias("name"))


@query("item_selector", "SELECT CAST(pos AS BIGINT) AS pos, k AS c_custkey, coalesce(c_name, 'missing') AS c_name, c_name IS NOT NULL AS found FROM (SELECT k, row_number() OVER (ORDER BY i) - 1 AS pos FROM (SELECT k, min(i) AS i FROM (SELECT unnest([7, 3, 7, 11, 999999999, 5, 3]) AS k, unnest(range(0, 7)) AS i) GROUP BY k) ORDER BY i LIMIT 4) LEFT JOIN customer ON c_custkey = k")
def _(spark, d):
    found = library.selected_items(table(spark, d, "customer"), ["7", "3", "7", "11", "999999999", "5", "3"], most=4, key="c_custkey")
    return found.select("pos", "c_custkey", F.coalesce("c_name", F.lit("missing")).alias("c_name"), "found")


@query("children_scan", "SELECT o_orderpriority, count(*) AS children, count(*) FILTER (l_linestatus = 'F') AS finished FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, d):
    both = library.children_of(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), table(spark, d, "lineitem").select("l_orderkey", "l_linestatus"), "o_orderkey", "l_orderkey")
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("children"), F.count_if(F.col("l_linestatus") == "F").alias("finished"))


@query("annotation_scan", "SELECT o_orderkey, count(*) AS annotations, CAST(sum(l_partkey) AS BIGINT) AS keys FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' GROUP BY 1")
def _(spark, d):
    children = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "A", "annotation").otherwise("attachment").alias("item_type"))
    return library.annotations_of(table(spark, d, "orders").select("o_orderkey"), children, "o_orderkey", "l_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("annotations"), F.sum("l_partkey").alias("keys"))


@query("first_attachment", "SELECT l_orderkey AS parent, arg_min(l_partkey, l_linenumber) AS l_partkey, min(l_linenumber) AS ord FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey")
def _(spark, d):
    kind = F.when(F.col("l_returnflag") == "N", "application/PDF").otherwise("text/html")
    # line numbers occur several times in an order: of equal ones the first as stored
    stored = F.struct("_metadata.file_path", "_metadata.row_index").alias("stored")
    # as arg_min does, which takes no row without key or line number, while min takes the line numbers of all
    blank = (F.col("l_partkey").isNull() | F.col("l_linenumber").isNull()).alias("blank")
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_partkey", F.col("l_linenumber").alias("ord"), blank, stored, kind.alias("content_type"))
    pdfs = children.where("content_type = 'application/PDF'").withColumn("least", F.min("ord").over(Window.partitionBy("parent")))
    first = library.first_pdf(pdfs, order=("blank", "ord", "stored"))
    return first.select("parent", F.when(~F.col("blank"), F.col("l_partkey")).alias("l_partkey"), F.col("least").alias("ord"))


SEARCHED = "(SELECT user_id AS key, list_filter(['view', 'click', 'purchase', 'signup', 'search'], lambda t: list_contains(list(DISTINCT event_type), t)) AS tags, concat('Title of user ', user_id) AS title FROM events GROUP BY user_id)"


def user_items(spark, d: str) -> DataFrame:
    held = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.collect_set("event_type").alias("t"))
    tags = F.filter(F.array(*[F.lit(t) for t in ("view", "click", "purchase", "signup", "search")]), lambda t: F.array_contains("t", t))
    return held.select("key", tags.alias("tags"), F.concat(F.lit("Title of user "), F.col("key").cast("string")).alias("title"))


@query("tag_or_search", f"SELECT key, array_to_string(list_filter(['click', 'view'], lambda t: list_contains(tags, t)), ',') AS matched FROM {SEARCHED} WHERE list_contains(tags, 'click') OR list_contains(tags, 'view') ORDER BY list_contains(tags, 'click') DESC, key LIMIT 20")
def _(spark, d):
    return library.search(user_items(spark, d), ["click", "view", "click"], "click", 20).select("key", F.array_join("matched", ",").alias("matched"))


@query("console_table", f"SELECT CAST(row_number() OVER (ORDER BY key) AS INT) AS n, 'view' AS matched_tags, key, CASE WHEN length(title) <= 14 THEN title ELSE concat(left(title, 13), '…') END AS title, CASE WHEN length(array_to_string(tags, ', ')) <= 14 THEN array_to_string(tags, ', ') ELSE concat(left(array_to_string(tags, ', '), 13), '…') END AS tags FROM (SELECT * FROM {SEARCHED} WHERE list_contains(tags, 'view') ORDER BY key LIMIT 12)")
def _(spark, d):
    return library.console_table(library.search(user_items(spark, d), ["view"], "view", 12), 14)


@query("tag_names", "SELECT event_id, array_to_string(list_filter([event_type, CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN NULL ELSE 'x' END, props], lambda t: t IS NOT NULL AND trim(t) <> ''), '|') AS names FROM events")
def _(spark, d):
    middle = F.expr("case when event_id % 3 = 0 then ' ' when event_id % 3 = 1 then null else 'x' end")
    tags = F.array(*[F.struct(c.alias("tag")) for c in (F.col("event_type"), middle, F.col("props"))])
    return table(spark, d, "events").select("event_id", F.array_join(library.tag_names(tags), "|").alias("names"))


VERSIONED = "SELECT o_orderkey AS key, o_custkey % 5 AS version FROM orders"


def versioned(spark, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 5).alias("version"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("title"), "o_orderpriority").alias("data"), F.array(F.col("o_orderstatus")).alias("tags"))


def asked(spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    expected = F.expr("case when l_partkey % 4 = 0 then null else l_suppkey % 5 end")
    return rows.select((F.col("l_orderkey") + F.when(F.col("l_partkey") % 10 == 0, 100_000_000).otherwise(0)).alias("key"), expected.alias("expected"), F.create_map(F.lit("status"), F.lit("new")).alias("data"))


ASKED = "SELECT l_orderkey + CASE WHEN l_partkey % 10 = 0 THEN 100000000 ELSE 0 END AS key, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_suppkey % 5 END AS expected FROM (SELECT l_orderkey, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey)"
STATUS = f"i AS ({VERSIONED}), c AS ({ASKED}), s AS (SELECT c.key, CASE WHEN version IS NULL THEN 'missing' WHEN expected IS NULL OR expected = version THEN '{{0}}' ELSE 'conflict' END AS status FROM c LEFT JOIN i USING (key))"


@query("versioned_update", f"WITH {STATUS.format('updated')} SELECT o.o_orderkey AS key, o_custkey % 5 + CASE WHEN status = 'updated' THEN 1 ELSE 0 END AS version, CASE WHEN status = 'updated' THEN 'new' ELSE o_orderstatus END AS st, o_orderpriority AS title FROM orders o LEFT JOIN s ON s.key = o_orderkey")
def _(spark, d):
    after, _status = library.updated(versioned(spark, d), asked(spark, d))
    return after.select("key", "version", F.col("data")["status"].alias("st"), F.col("data")["title"].alias("title"))


@query("update_status", f"WITH {STATUS.format('updated')} SELECT status, count(*) AS n FROM s GROUP BY status")
def _(spark, d):
    return library.updated(versioned(spark, d), asked(spark, d))[1].groupBy("status").agg(F.count("*").alias("n"))


@query("versioned_delete", f"WITH {STATUS.format('deleted')} SELECT i.key, version FROM i LEFT JOIN s USING (key) WHERE coalesce(status, '') <> 'deleted'")
def _(spark, d):
    return library.deleted(versioned(spark, d), asked(spark, d))[0].select("key", "version")


@query("tag_update", "SELECT o_orderkey AS key, o_custkey % 5 + CASE WHEN o_custkey % 3 = 0 AND o_orderstatus <> 'P' THEN 1 ELSE 0 END AS version, CASE WHEN o_custkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS tags FROM orders")
def _(spark, d):
    changes = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.array(F.lit("P")).alias("add"), F.array(F.lit("O"), F.lit("F")).alias("remove"))
    return library.retagged(versioned(spark, d), changes).select("key", "version", F.array_join("tags", ",").alias("tags"))


# annotations

#: An annotation for each event: which fields it lacks, which text field it has, and its tags follow from its number.
HASHED = "sha1(CAST(user_id % 50 AS VARCHAR))"
ANNOTATIONS = f"""(SELECT event_id AS key, user_id % 20 AS pdf, event_id % 3 AS version, event_id % 4 = 0 AS no_sort, event_id % 5 = 0 AS no_label, event_id % 7 = 0 AS no_place,
CASE event_id % 4 WHEN 0 THEN 'annotationComment' WHEN 1 THEN 'note' WHEN 2 THEN 'annotationComment' ELSE 'annotationComment' END AS field, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN event_type ELSE '' END AS body,
event_id % 6 < 4 AS pending, event_id % 11 = 0 AS done, {HASHED} AS hash, event_id % 9 = 0 AS untagged, event_id % 8 = 0 AS odd FROM events)"""


def annotations(spark, d: str) -> DataFrame:
    n = F.col("event_id")
    has = lambda test, name, value: F.when(test, F.map_from_arrays(F.array(F.lit(name)), F.array(value))).otherwise(F.create_map().cast("map<string,string>"))
    data = [
        has(n % 4 != 0, A.SORT, F.lit("00000|000000|00100")),
        has(n % 5 != 0, A.LABEL, F.lit("1")),
        has(F.lit(True), A.PLACE, F.when(n % 7 == 0, "  ").otherwise('{"pageIndex": 0}')),
        has((n % 4 == 0) | (n % 4 == 2), A.COMMENT, F.when(n % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))),
        has(n % 4 <= 1, A.NOTE, F.col("event_type")),
    ]
    hash_ = F.sha1(F.encode((F.col("user_id") % 50).cast("string"), "UTF-8"))
    tags = F.array(F.when(n % 6 < 4, "za:translate"), F.when(n % 11 == 0, "za:translated"), F.when(n % 9 != 0, F.concat(F.lit("para:"), hash_)), F.when(n % 8 == 0, "para:odd"))
    return table(spark, d, "events").select(n.alias("key"), (F.col("user_id") % 20).alias("pdf"), (n % 3).alias("version"), F.map_concat(*data).alias("data"), F.filter(tags, lambda t: t.isNotNull()).alias("tags"))


BROKEN = "(no_sort OR no_label OR no_place)"


@query("body_fields", f"SELECT key, field, trim(body) AS body FROM {ANNOTATIONS}")
def _(spark, d):
    return annotations(spark, d).select("key", A.body_field(F.col("data")).alias("field"), A.body(F.col("data")).alias("body"))


@query("broken_counts", f"SELECT pdf, count(*) FILTER {BROKEN.replace('(', '(WHERE ', 1)} AS broken, count(*) FILTER (WHERE {BROKEN} AND (NOT untagged OR odd)) AS tagged FROM {ANNOTATIONS} GROUP BY pdf")
def _(spark, d):
    return A.broken_counts(annotations(spark, d))


@query("delete_broken", f"SELECT key, version FROM {ANNOTATIONS} WHERE NOT {BROKEN}")
def _(spark, d):
    return A.without_broken(annotations(spark, d))[0].select("key", "version")


@query("delete_all", f"SELECT pdf, count(*) AS n FROM {ANNOTATIONS} WHERE pdf % 3 <> 0 GROUP BY pdf")
def _(spark, d):
    held = annotations(spark, d)
    return A.without_all(held, held.where("pdf % 3 = 0").select("pdf"))[0].groupBy("pdf").agg(F.count("*").alias("n"))


def candidates(spark, d: str) -> DataFrame:
    """Orders as paragraphs: 30 of the 50 hashes, each on several places of a PDF; the last one counts."""
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 30).alias("h"), F.col("o_orderkey").alias("rank"), (F.col("o_custkey") % 20).alias("pdf"))
    coords = F.array(F.struct(F.lit(1).alias("page"), F.col("rank").cast("double").alias("x"), F.lit(50.0).alias("y"), F.lit(10.0).alias("w"), F.lit(12.0).alias("h")))
    fields = A.position_fields(coords, F.lit(842.0), F.lit(595.0))
    return rows.select("pdf", F.concat(F.lit("para:"), F.sha1(F.encode(F.col("h").cast("string"), "UTF-8"))).alias("tag"), fields.alias("fields"), "rank")


MATCHED = f"(SELECT a.*, c.rank FROM {ANNOTATIONS} a JOIN events u ON u.event_id = a.key LEFT JOIN (SELECT o_custkey % 20 AS pdf, o_orderkey % 30 AS h, max(o_orderkey) AS rank FROM orders GROUP BY ALL) c ON c.pdf = a.pdf AND c.h = u.user_id % 50)"


@query("repair_annotations", f"SELECT key, CASE WHEN untagged AND NOT odd THEN 'untagged' WHEN NOT {BROKEN} THEN 'sound' WHEN NOT untagged AND rank IS NOT NULL THEN 'repaired' ELSE 'unmatched' END AS outcome, CASE WHEN {BROKEN} AND NOT untagged AND rank IS NOT NULL THEN round(CAST(rank - 30 AS DOUBLE), 6) END AS x1 FROM {MATCHED}")
def _(spark, d):
    found = A.repaired(annotations(spark, d), candidates(spark, d))
    x1 = F.get_json_object(F.col("repair")[A.PLACE], "$.rects[0][0]").cast("double")
    return found.select("key", "outcome", F.round(x1, 6).alias("x1"))


@query("self_healing", f"SELECT pdf, count(*) FILTER (WHERE {BROKEN}) AS broken, count(*) FILTER (WHERE {BROKEN} AND (NOT untagged OR odd)) AS tagged, count(*) FILTER (WHERE {BROKEN} AND NOT untagged AND rank IS NOT NULL) AS repaired, count(*) FILTER (WHERE {BROKEN} AND (untagged OR rank IS NULL)) AS deleted FROM {MATCHED} GROUP BY pdf")
def _(spark, d):
    return A.self_healed(annotations(spark, d), candidates(spark, d))[1]


@query("self_healed_rows", f"SELECT pdf, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM {MATCHED} WHERE NOT ({BROKEN} AND (untagged OR rank IS NULL)) GROUP BY pdf")
def _(spark, d):
    return A.self_healed(annotations(spark, d), candidates(spark, d))[0].groupBy("pdf").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


TARGET = "(NOT done AND pending)"


@query("translation_targets", f"SELECT pdf, count(*) FILTER (WHERE done) AS already, count(*) FILTER (WHERE NOT done AND NOT pending) AS not_pending, count(*) FILTER (WHERE {TARGET}) AS targeted, count(*) FILTER (WHERE {TARGET} AND untagged) AS untagged, count(*) FILTER (WHERE {TARGET} AND odd) AS invalid, CAST(0 AS BIGINT) AS several, count(*) FILTER (WHERE {TARGET} AND body = '') AS blank FROM {ANNOTATIONS} GROUP BY pdf")
def _(spark, d):
    return A.target_counts(A.translation_targets(annotations(spark, d)))


def refuses_buy(_url: str, _headers: dict, body: bytes, _timeout: float) -> tuple[int, str]:
    """A chat service that answers in capitals, and has no quota for one kind of text."""
    text = json.loads(body)["messages"][1]["content"].split("TARGET:\n")[1].split("\n\nContext (next):")[0]
    if text == "purchase":
        return 402, json.dumps({"error": {"message": "quota"}})
    return 200, json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": text.upper()}]}}]})


@query("translate_pending", f"WITH a AS (SELECT *, max(CASE WHEN {TARGET} AND body = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY pdf ORDER BY key) AS bad FROM {ANNOTATIONS}) SELECT pdf, count(*) FILTER (WHERE {TARGET} AND body <> '' AND bad = 0) AS updated, CAST(coalesce(sum(length(body)) FILTER (WHERE {TARGET} AND body <> '' AND bad = 0), 0) AS BIGINT) AS chars, count(*) FILTER (WHERE pending AND NOT (NOT done AND body <> '' AND bad = 0)) AS pending FROM a GROUP BY pdf")
def _(spark, d):
    targets = A.translation_targets(annotations(spark, d))
    mine = F.col("match") == "target"
    settings = Settings(provider="openai", chat_key="k", chat_model="m")
    sent = targets.withColumn("whole", F.col("text")).withColumn("text", F.when(mine, F.col("text")).otherwise(""))
    answered = enrich.translated(sent, context=False, settings=settings, transport=refuses_buy, wait=lambda _s: None).withColumn("text", F.col("whole"))
    after = A.with_answers(answered)
    same = F.col("updated") & (F.try_element_at("data", F.col("field")) == F.upper("whole"))
    return after.groupBy("pdf").agg(F.count_if("updated").alias("updated"), F.coalesce(F.sum(F.when(same, F.length("whole"))), F.lit(0)).cast("long").alias("chars"), F.count_if(F.array_contains("tags", "za:translate")).alias("pending"))


def planned(spark, d: str, most: int | None = 5) -> DataFrame:
    hashed = lines(spark, d).withColumn("hash", T.content_hash(F.col("text")))
    place = F.struct(F.lit(1).alias("page"), (F.col("ord") * 10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(5.0).alias("w"), F.lit(12.0).alias("h"))
    rows = hashed.select("doc_id", "ord", "text", "hash", F.array("hash").alias("dedup_hashes"), F.array(place).alias("coords"), F.lit(1).alias("page"))
    stored = hashed.where("source = 'src0'").select("hash").distinct()
    # the stored tags of a document: those of its own paragraphs that the source has, and no product of documents and tags
    tags = hashed.where("doc_id % 2 = 0").join(stored, "hash", "left_semi").select("doc_id", F.concat(F.lit("para:"), F.col("hash")).alias("tag"))
    return A.planned(rows, tags, most=most)


PLANNED = LINES + ", e AS (SELECT DISTINCT sha1(text) AS hash FROM l WHERE source = 'src0'), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, doc_id % 2 = 0 AND sha1(text) IN (SELECT hash FROM e) AS dup FROM l)"


@query("payloads", PLANNED + " SELECT doc_id, ord, sha1(text) AS hash, 'note' AS kind, length(text) AS chars, round(ord * 10.0::DOUBLE - 30, 6) AS x1, '1' AS label, '00000|000000|00810' AS sort_index, concat('para:', sha1(text), ',za:translate') AS tags FROM c WHERE NOT dup")
def _(spark, d):
    p = F.col("payload")
    x1 = F.get_json_object(p[A.PLACE], "$.rects[0][0]").cast("double")
    return planned(spark, d, most=None).where("not duplicate").select("doc_id", "ord", "hash", p["annotationType"].alias("kind"), F.length(p[A.COMMENT]).alias("chars"), F.round(x1, 6).alias("x1"), p[A.LABEL].alias("label"), p[A.SORT].alias("sort_index"), F.array_join(F.transform(p["tags"], lambda t: t["tag"]), ",").alias("tags"))


@query("item_summary", PLANNED + " SELECT doc_id, count(*) AS total, count(*) FILTER (k <= 5) AS processed, count(*) FILTER (k <= 5 AND dup) AS duplicates, count(*) FILTER (k <= 5 AND NOT dup) AS planned FROM c GROUP BY doc_id")
def _(spark, d):
    return A.item_summary(planned(spark, d), lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("total")))


@query("paragraph_probe", PLANNED + " SELECT doc_id, CASE WHEN max(CASE WHEN ord = 3 THEN 1 ELSE 0 END) = 0 THEN 'error' WHEN max(CASE WHEN ord = 3 AND dup THEN 1 ELSE 0 END) = 1 THEN 'duplicate' ELSE 'created' END AS status FROM c GROUP BY doc_id")
def _(spark, d):
    hashed = lines(spark, d).withColumn("hash", T.content_hash(F.col("text")))
    place = F.struct(F.lit(1).alias("page"), F.lit(1.0).alias("x"), F.lit(20.0).alias("y"), F.lit(5.0).alias("w"), F.lit(12.0).alias("h"))
    rows = hashed.select("doc_id", "ord", "text", "hash", F.array("hash").alias("dedup_hashes"), F.array(place).alias("coords"), F.lit(1).alias("page"))
    known = hashed.where("source = 'src0'").select("hash").distinct()
    existing = rows.where("doc_id % 2 = 0").join(known, "hash", "left_semi").select("doc_id", F.concat(F.lit("para:"), F.col("hash")).alias("tag"))
    return A.probed(rows, existing, 3).select("doc_id", "status")


@query("completion_gate", LINES + ", e AS (SELECT DISTINCT sha1(text) AS hash FROM l WHERE source IN ('src0', 'src1', 'src2')) SELECT doc_id, bool_and(sha1(text) IN (SELECT hash FROM e)) AND count(*) <= 12 AS complete FROM l GROUP BY doc_id")
def _(spark, d):
    rows = lines(spark, d).select("doc_id", "source", F.concat(F.lit("para:"), T.content_hash(F.col("text"))).alias("tag"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"))
    known = rows.where("source in ('src0', 'src1', 'src2')").select("tag").distinct()
    available = rows.select("doc_id", "tag").join(known, "tag", "left_semi")
    return A.complete(rows.join(counts, "doc_id"), available, 12).select("doc_id", "complete")


RESPONSE = """CASE o_orderkey % 5 WHEN 0 THEN '[1, 2, 3]' WHEN 1 THEN '{"successful": {"0": {}, "1": {}}, "failed": {"2": {"code": 400}}}' WHEN 2 THEN '{"failed": {"0": 1, "1": 2, "2": 3, "3": 4}}' WHEN 3 THEN '{}' ELSE 'oops' END"""


@query("create_summary", "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 7 END AS BIGINT) AS created, CAST(CASE o_orderkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 0 END AS BIGINT) AS failed, CASE o_orderkey % 5 WHEN 1 THEN '2' WHEN 2 THEN '0,1,2' ELSE '' END AS samples, o_orderkey % 5 < 3 AS recognised FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(RESPONSE).alias("response"), F.lit(7).alias("planned"))
    return A.create_summary(rows).select("o_orderkey", "created", "failed", F.array_join("samples", ",").alias("samples"), "recognised")


@query("skipped_items", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'item_not_found' WHEN o_custkey % 5 = 0 THEN 'no_pdf' END AS skipped_reason FROM orders")
def _(spark, d):
    tests = [("item_not_found", F.col("o_custkey") % 3 == 0), ("no_pdf", F.col("o_custkey") % 5 == 0)]
    return A.with_errors(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", tests).select("o_orderkey", "skipped_reason")


# providers

ANSWER = """CASE event_id % 6 WHEN 0 THEN concat('{"choices": [{"message": {"content": "', event_type, '"}}]}') WHEN 1 THEN concat('{"choices": [{"message": {"content": [{"type": "text", "text": "a "}, {"text": "', event_type, '"}, {"text": ""}, {"x": 1}]}}]}') WHEN 2 THEN '{"choices": [{"message": {"content": null, "refusal": "no"}}]}' WHEN 3 THEN '{"choices": []}' WHEN 4 THEN 'oops' ELSE '{"choices": [{"message": {"content": 5}}]}' END"""


@query("message_text", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN concat('a ', event_type) END AS text FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.message_text(F.expr(ANSWER)).alias("text"))


def form_service(_url: str, headers: dict, body: bytes, _timeout: float) -> tuple[int, str]:
    """A form service that answers with a text's MD5; without a key it refuses."""
    from urllib.parse import parse_qs

    if "secret" not in headers["Authorization"]:
        return 403, "no"
    fields = parse_qs(body.decode())
    return 200, json.dumps({"translations": [{"text": hashlib.md5(fields["text"][0].encode()).hexdigest() + fields["target_lang"][0]}]})


@query("form_provider", "SELECT conv_id, turn, CASE WHEN text <> '' THEN concat(md5(text), 'JA') END AS answer FROM conversations")
def _(spark, d):
    rows = table(spark, d, "conversations")
    settings = Settings(provider="deepl", deepl_key="secret", target_lang="JA")
    return enrich.translated(rows, context=False, settings=settings, transport=form_service).select("conv_id", "turn", "answer")


def hashing_chat(_url: str, _headers: dict, body: bytes, _timeout: float) -> tuple[int, str]:
    """A chat service that answers with the MD5 of a text and of what stands around it, in parts."""
    before, rest = json.loads(body)["messages"][1]["content"].split("\n\nTARGET:\n", 1)
    text, after = rest.rsplit("\n\nContext (next):", 1)
    whole = "|".join([text, *(x.split("\n", 1)[-1] for x in (before, after))])
    digest = hashlib.md5(whole.encode()).hexdigest()
    return 200, json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": digest[:9]}, {"type": "text", "text": digest[9:]}]}}]})


@query("chat_provider", "SELECT conv_id, turn, CASE WHEN text <> '' THEN md5(concat(text, '|', coalesce(lag(text) OVER w, ''), '|', coalesce(lead(text) OVER w, ''))) END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    rows = P.with_context(table(spark, d, "conversations"), "conv_id", "turn")
    settings = Settings(provider=providers.provider_name("OpenAI"), chat_key="k", chat_model="m")
    return enrich.translated(rows, settings=settings, transport=hashing_chat).select("conv_id", "turn", "answer")


# sources and sinks


@query("page_box_scan", "SELECT p_partkey AS key, CAST(0 AS INT) AS page_index, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 2 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS w, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST(p_size * 2 AS DOUBLE) END AS h FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 1, 300.0, 400.0 FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 0, 500.0, 700.0 FROM part WHERE p_partkey % 3 = 0")
def _(spark, d):
    size = F.col("p_size").cast("string")
    turn = F.when(F.col("p_size") % 2 == 0, " /Rotate 90").otherwise(" /Rotate 180")
    plain = F.concat(F.lit("%PDF-1.4 1 0 obj <</Type /Pages /Count 2>> endobj 2 0 obj << /Type /Page /MediaBox [0 0 1 1] /CropBox [0 0 "), size, F.lit(" "), (F.col("p_size") * 2).cast("string"), F.lit("]"), turn, F.lit(" >> endobj 3 0 obj << /MediaBox [0 0 300 400] /Type/Page >> endobj"))
    content = F.when(F.col("p_partkey") % 3 != 0, plain).otherwise(F.lit("%PDF-1.5 /MediaBox [0 0 500 700] stream /MediaBox [0 0 500 700] /MediaBox [0 0 9 9]"))
    return pos.page_sizes(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.encode(content, "ISO-8859-1").alias("content")))


@query("page_text_totals", r"SELECT page_id % 10 AS doc_id, count(*) AS pages, CAST(sum(length(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'))) AS BIGINT) AS chars FROM pages GROUP BY 1")
def _(spark, d):
    return layout_json.page_totals(layout_json.page_texts(table(spark, d, "pages").select((F.col("page_id") % 10).alias("doc_id"), F.col("page_id").alias("page"), F.col("html").alias("text"))))


@query("binary_facts", "SELECT page_id, octet_length(encode(html)) AS len, sha1(html) AS sha1 FROM pages")
def _(spark, d):
    facts = layout_json.binary_facts(F.encode("html", "UTF-8"))
    return table(spark, d, "pages").select("page_id", facts.alias("f")).select("page_id", "f.len", "f.sha1")


@query("paragraph_preview", LINES + ", c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM l) SELECT doc_id, ord AS index, sha1(text) AS hash, 1 AS hashes FROM c WHERE k <= 3")
def _(spark, d):
    rows = lines(spark, d).withColumn("hash", T.content_hash(F.col("text")))
    rows = rows.select("doc_id", "ord", "text", "hash", F.array("hash").alias("dedup_hashes"), F.lit(1).alias("page"), F.array().cast("array<struct<page:int>>").alias("coords"))
    return layout_json.preview(rows, 3).select("doc_id", "index", "hash", F.size("dedup_hashes").alias("hashes"))


@query("xml_rows", LINES + "SELECT doc_id, ord AS _id, CAST(ord % 2 AS INT) AS _is_caption, md5(text) AS md5, concat(ord, ',', ord + 1) AS pages FROM l")
def _(spark, d):
    rows = lines(spark, d).withColumn("caption", F.col("ord") % 2 == 1).withColumn("pages", F.array("ord", F.col("ord") + 1))
    shown = layout_json.xml_rows(rows.withColumn("ord", F.struct("doc_id", "ord")))
    return shown.select("_id.doc_id", F.col("_id.ord").alias("_id"), "_is_caption", F.md5("text").alias("md5"), "pages")


@query("batched_create", "SELECT source, count(*) AS planned, count(*) FILTER (doc_id % 6 <> 5) AS created, count(*) FILTER (doc_id % 6 = 5) AS failed FROM documents GROUP BY source")
def _(spark, d):
    # what is refused in a batch is tried once more alone; every sixth is refused then too
    create = lambda batch: [r["doc_id"] % (6 if len(batch) == 1 else 3) != (5 if len(batch) == 1 else 2) for r in batch]
    return layout_json.write_batched(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], create)


@query("unseen_stored", LINES + f", {STORED} SELECT lang, count(*) AS fresh FROM l WHERE sha1(text) NOT IN (SELECT hash FROM s) GROUP BY lang")
def _(spark, d):
    return R.unseen(lines(spark, d).withColumn("hash", T.content_hash(F.col("text"))), stored_hashes(spark, d)).groupBy("lang").agg(F.count("*").alias("fresh"))
