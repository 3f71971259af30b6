"""Queries of what stands between tables and services: calls in order, the ledger of answers, writes, paged reading; and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import commands
from ..config import Settings
from ..functions import text as T
from ..operators import annotations as A
from ..operators import enrich, layout, open_items, pdf_geometry, writes
from ..sources import hash_store, layout_json, scratch, service
from ..sources.layout_json import ProviderError
from . import fake_pdf
from .catalogue import LINES, lines, query, table
from .fake_service import Cells, Shelf, Store
from .library_queries import ANNOTATIONS, BROKEN, MATCHED, TARGET, annotations, candidates, refuses_buy

# providers that fail


class Moody:
    """A provider that answers with the MD5 of a text. By the first digit of that it never has time (0), refuses (1), or has time when asked again (2)."""

    def __init__(self):
        self.seen = set()

    def __call__(self, _previous: str, text: str, _following: str) -> str:
        digest = hashlib.md5(text.encode()).hexdigest()
        if digest[0] == "1":
            raise ProviderError("auth")
        if digest[0] == "0" or (digest[0] == "2" and digest not in self.seen):
            self.seen.add(digest)
            raise ProviderError("temporary" if digest[0] == "0" else "rate_limit")
        self.seen.discard(digest)
        return digest


def moody(spark, d: str) -> tuple[DataFrame, dict]:
    enrich.PROVIDERS["moody"] = Moody()
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), {"wait": lambda _s: None, "breaks": ()}


CALLS = "CASE WHEN h = '0' THEN 3 WHEN h = '1' THEN 1 WHEN h = '2' THEN 2 ELSE 1 END"
TURNS = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS m, left(md5(coalesce(text, '')), 1) AS h FROM conversations)"


@query("ordered_calls", f"""WITH {TURNS}, b AS (SELECT *, text <> '' AND h IN ('0', '1') AS bad FROM t),
o AS (SELECT *, coalesce(max(bad) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM b)
SELECT conv_id, turn, CAST(CASE WHEN stopped OR text = '' THEN 0 ELSE {CALLS} END AS INT) AS calls, CASE WHEN NOT stopped AND bad THEN CASE h WHEN '0' THEN 'temporary' ELSE 'auth' END END AS error, CASE WHEN NOT stopped AND NOT bad AND text <> '' THEN m END AS answer FROM o""")
def _(spark, d):
    rows, how = moody(spark, d)
    return enrich.translated_in_order(rows, "conv_id", "turn", "moody", context=False, **how).select("conv_id", "turn", "calls", "error", "answer")


@query("answer_ledger", f"""WITH {TURNS}, b AS (SELECT *, text <> '' AND h IN ('0', '1') AS bad FROM t),
u AS (SELECT *, coalesce(max(bad) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM b WHERE role = 'user'),
s AS (SELECT DISTINCT text FROM u WHERE NOT stopped AND NOT bad AND text <> ''),
o AS (SELECT *, coalesce(max(bad) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM b)
SELECT conv_id, turn, CAST(CASE WHEN stopped OR text = '' OR text IN (SELECT text FROM s) THEN 0 ELSE {CALLS} END AS INT) AS calls, CASE WHEN NOT stopped AND NOT bad AND text <> '' THEN m END AS answer FROM o""")
def _(spark, d):
    # a first run asks for what users said; the second one, over all, pays only for the rest
    rows, how = moody(spark, d)
    path, settings = scratch.new_path(spark, "ledger"), Settings(provider="moody", target_lang="xx")
    enrich.translated_with_ledger(rows.where("role = 'user'"), "conv_id", "turn", path, settings, context=False, **how)
    return enrich.translated_with_ledger(rows, "conv_id", "turn", path, settings, context=False, **how).select("conv_id", "turn", "calls", "answer")


# the hash store


@query("hash_store_batches", LINES + "SELECT lang, count(*) AS fresh, CAST(sum(length(text)) AS BIGINT) AS chars FROM l WHERE sha1(text) NOT IN (SELECT sha1(text) FROM l WHERE source IN ('src0', 'src1')) GROUP BY lang")
def _(spark, d):
    # what one batch stored, the next one doesn't take again
    store = hash_store.HashStore(spark, scratch.new_path(spark, "store"))
    rows = lines(spark, d).withColumn("hash", T.content_hash(F.col("text")))
    store.add(rows.where("source in ('src0', 'src1')"), 0)
    return store.unseen(rows).groupBy("lang").agg(F.count("*").alias("fresh"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("hash_store_sizes", LINES + ", s AS (SELECT DISTINCT left(sha1(text), 1) AS prefix, sha1(text) AS hash, min(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END) OVER (PARTITION BY text) AS batch FROM l) SELECT prefix, CAST(batch AS BIGINT) AS batch, count(DISTINCT hash) AS hashes FROM s GROUP BY ALL")
def _(spark, d):
    store = hash_store.HashStore(spark, scratch.new_path(spark, "store"), buckets=4)
    rows = lines(spark, d).withColumn("hash", T.content_hash(F.col("text")))
    for batch, langs in enumerate((["en"], ["de"], ["en", "de", "fr", "es"])):
        store.add(rows.where(F.col("lang").isin(langs)), batch)
    return store.rows().groupBy("prefix", "batch").agg(F.count("*").alias("hashes"))


# a library behind a service


def customer_item(row: dict) -> dict:
    tags = [row["c_mktsegment"], *(["rich"] if row["c_acctbal"] > 5000 else [])]
    return {"key": str(row["c_custkey"]), "version": row["c_custkey"] % 7, "data": {"itemType": "annotation" if row["c_custkey"] % 3 else "attachment", "parentItem": str(row["c_nationkey"]), "title": row["c_name"], "tags": [{"tag": t} for t in tags]}}


def customers(spark, d: str, **how) -> DataFrame:
    return service.read_items(spark, Shelf(f"{d}/customer.parquet", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), customer_item), **how)


@query("paged_items", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 7 AS version, c_name AS title, c_acctbal > 5000 AS rich FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return customers(spark, d, page_rows=20, partition_pages=2).where("tag = 'BUILDING'").select("key", "version", "title", F.array_contains("tags", "rich").alias("rich"))


@query("paged_tags", "SELECT tag, count(*) AS items FROM (SELECT c_mktsegment AS tag FROM customer UNION ALL SELECT 'rich' FROM customer WHERE c_acctbal > 5000) GROUP BY tag")
def _(spark, d):
    return customers(spark, d).groupBy("tag").agg(F.count("*").alias("items"))


@query("paged_children", "SELECT CAST(n_nationkey AS VARCHAR) AS parent, count(*) AS annotations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_custkey % 3 <> 0 GROUP BY 1")
def _(spark, d):
    # the items of a run are few by their cap, and each of them is asked for its children
    asia = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    parents = [str(r[0]) for r in asia.select("n_nationkey").collect()]
    found = customers(spark, d, page_rows=30).where(F.col("parent").isin(parents) & (F.col("item_type") == "annotation"))
    return found.dropDuplicates(["key"]).groupBy("parent").agg(F.count("*").alias("annotations"))


@query("created_once", """WITH s AS (SELECT source, count(*) AS planned, count(*) FILTER (doc_id % 6 <> 5) AS created FROM documents GROUP BY source) SELECT source, planned, created, planned - created AS failed, CAST(sum(planned) OVER () AS BIGINT) AS all_planned, CAST(sum(created) OVER () AS BIGINT) AS all_created FROM s""")
def _(spark, d):
    # a third is refused in its batch, of which every other one passes alone; answers get lost; the run is made twice and creates nothing twice
    folder, rows = scratch.new_path(spark, "service"), table(spark, d, "documents").select("source", "doc_id")
    store = Store(folder, lambda row, n: row["doc_id"] % (6 if n == 1 else 3) == (5 if n == 1 else 2), lambda token: token[0] in "05a")
    for _ in range(2):
        figures = service.create_items(rows, "source", ["doc_id"], store, "run-1", wait=lambda _s: None)
    held = spark.read.schema("source string, doc_id long").json(f"{folder}/rows")
    counts = held.groupBy("source").agg(F.count("*").alias("created"))
    total = rows.groupBy("source").agg(F.count("*").alias("planned")).join(counts, "source", "left").withColumn("created", F.coalesce("created", F.lit(0)))
    return total.select("source", "planned", "created", (F.col("planned") - F.col("created")).alias("failed"), F.lit(figures["planned"]).cast("long").alias("all_planned"), F.lit(figures["created"]).cast("long").alias("all_created"))


# writes under a version


def cells(spark, rows: DataFrame, other) -> tuple[Cells, object]:
    """A store that holds ``rows(key, ...)``, and what reads it: of each key the last version."""
    folder = scratch.new_path(spark, "cells")
    store = Cells(folder, other)
    store.fill(rows.select(F.col("key").cast("string").alias("key"), F.to_json(F.struct(*[n for n in rows.columns if n != "key"])).alias("row")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "key") + ", key string, deleted boolean"

    def read() -> DataFrame:
        held = spark.read.schema(schema).json(f"{folder}/*")
        last = held.groupBy("key").agg(F.max_by(F.struct(*[n for n in held.columns if n != "key"]), "version").alias("r")).select("key", "r.*")
        return last.where("deleted is null").select(*[F.col(n).cast(rows.schema[n].dataType.simpleString()).alias(n) for n in rows.columns])

    return store, read


def mends_some(key: str, row: dict) -> dict | None:
    """Somebody who changes every fifth annotation, and mends every tenth."""
    if int(key) % 5:
        return None
    mended = {A.SORT: "00000|000000|00001", A.LABEL: "1", A.PLACE: "{}"} if int(key) % 10 == 0 else {"seen": "yes"}
    return row | {"data": row["data"] | mended}


MENDED = f"(SELECT *, NOT untagged AND rank IS NOT NULL AS known, {BROKEN} AS bad, key % 10 = 0 AS theirs FROM {MATCHED})"


@query("healed_in_place", f"SELECT pdf, count(*) FILTER (WHERE bad) AS broken, count(*) FILTER (WHERE bad AND (NOT untagged OR odd)) AS tagged, count(*) FILTER (WHERE bad AND known AND NOT theirs) AS repaired, count(*) FILTER (WHERE bad AND NOT known AND NOT theirs) AS deleted, count(*) FILTER (WHERE bad AND theirs) AS superseded, CAST(0 AS BIGINT) AS conflicts, count(*) FILTER (WHERE NOT (bad AND NOT known AND NOT theirs)) AS kept FROM {MENDED} GROUP BY pdf")
def _(spark, d):
    store, read = cells(spark, annotations(spark, d), mends_some)
    after, counts = writes.healed_in_place(read, store, candidates(spark, d))
    return counts.join(after.groupBy("pdf").agg(F.count("*").alias("kept")), "pdf")


@query("retagged_in_place", "SELECT CAST(doc_id AS VARCHAR) AS key, 'updated' AS status, CAST(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS INT) AS tries, concat_ws(',', 'done', CASE WHEN quality = 1 THEN 'good' END, CASE WHEN doc_id % 4 = 0 THEN 'seen' END) AS tags FROM labels WHERE toxic = 0")
def _(spark, d):
    tags = F.expr("filter(array(if(toxic = 0, 'pending', ''), if(quality = 1, 'good', '')), t -> t <> '')")
    items = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.lit(3).cast("long").alias("version"), tags.alias("tags"))
    store, read = cells(spark, items, lambda key, row: row | {"tags": [*row["tags"], "seen"]} if int(key) % 4 == 0 else None)
    changes = items.where("array_contains(tags, 'pending')").select("key", F.array(F.lit("done")).alias("add"), F.array(F.lit("pending")).alias("remove"))
    done = writes.retagged_in_place(items, changes, store)
    return done.join(read().select(F.col("key").cast("string").alias("key"), F.array_join(F.array_sort("tags"), ",").alias("tags")), "key")


# layout dumps, some of them spoilt


PAGES = "(SELECT doc_id, greatest(1, CAST(ceil(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) / 40.0) AS BIGINT)) AS pages FROM documents)"


@query("layout_scan", f"SELECT CASE WHEN doc_id % 10 = 3 THEN 'malformed' WHEN doc_id % 10 = 5 THEN 'wrong_types' WHEN doc_id % 10 = 7 THEN 'no_pages' ELSE 'sound' END AS outcome, count(*) AS documents, CAST(sum(CASE WHEN doc_id % 10 IN (3, 5, 7) THEN 0 ELSE pages END) AS BIGINT) AS pages FROM {PAGES} GROUP BY 1")
def _(spark, d):
    # a file of dumps in which a third is not what it should be
    dumps = layout.layout_of_texts(table(spark, d, "documents"))
    whole = F.to_json(F.struct("doc_id", "pages"))
    spoilt = F.when(F.col("doc_id") % 10 == 3, F.expr("left(whole, length(whole) - 2)")).when(F.col("doc_id") % 10 == 5, F.lit('{"doc_id": 1, "pages": "none"}')).when(F.col("doc_id") % 10 == 7, F.lit('{"doc_id": 1, "title": "x"}'))
    path = scratch.new_path(spark, "dumps")
    dumps.withColumn("whole", whole).select(F.coalesce(spoilt, F.col("whole")).alias("value")).write.text(path)
    good, rejected = layout_json.scan_layout(spark, path)
    sound = good.select(F.lit("sound").alias("outcome"), F.size("pages").cast("long").alias("pages"))
    both = sound.unionAll(rejected.select("reason", F.lit(0).cast("long")))
    return both.groupBy("outcome").agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"))


# page sizes of PDF files


@query("pdf_page_tree", """WITH k AS (SELECT l_orderkey AS key, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n, CAST(floor(l_quantity) AS INT) + 100 AS q, CAST(l_linenumber % 4 AS INT) AS kind FROM lineitem)
SELECT key, CAST(n - 1 AS INT) AS page_index, CAST(CASE kind WHEN 0 THEN q WHEN 1 THEN 700 WHEN 2 THEN 500 ELSE q * 2 END AS DOUBLE) AS w, CAST(CASE kind WHEN 0 THEN q * 2 WHEN 1 THEN 500 WHEN 2 THEN 700 ELSE q END AS DOUBLE) AS h FROM k""")
def _(spark, d):
    # an order is a file and its items are pages: a box of their own, an inherited one turned or not, or a crop box turned; every other file packs its objects in a stream
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") + 100).alias("q"))
    files = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("pages"))

    @F.pandas_udf("binary")
    def pdf(keys, pages):
        import pandas as pd

        return pd.Series([fake_pdf.made(k, [(int(p["l_linenumber"]) % 4, int(p["q"])) for p in mine], packed=bool(k % 2)) for k, mine in zip(keys, pages, strict=True)])

    return pdf_geometry.page_sizes(files.select(F.col("l_orderkey").alias("key"), pdf("l_orderkey", "pages").alias("content")))


# annotations of an open schema

OPEN = """(SELECT event_id, '{"annotationSortIndex": ' || CASE event_id % 5 WHEN 0 THEN '" "' WHEN 1 THEN '7' ELSE '"00000|000000|00001"' END || CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ', "annotationPageLabel": null' ELSE ', "annotationPageLabel": "1"' END
|| CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ', "annotationPosition": {"pageIndex": 0, "rects": [[1, 2, 3, 4]]}' WHEN 2 THEN ', "annotationPosition": "{}"' WHEN 3 THEN ', "annotationPosition": ""' WHEN 4 THEN ', "annotationPosition": [1]' ELSE ', "annotationPosition": null' END
|| CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ', "annotationComment": null, "note": "n"' WHEN 2 THEN ', "note": " ' || event_type || ' "' ELSE ', "annotationComment": "' || event_type || '"' END || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END AS data FROM events)"""


@query("annotations_of_open_schema", f"""WITH o AS (SELECT event_id, CASE WHEN json_valid(data) THEN data END AS data FROM {OPEN}),
f AS (SELECT *, CASE WHEN json_exists(data, '$.annotationComment') THEN 'annotationComment' WHEN json_exists(data, '$.note') THEN 'note' ELSE 'annotationComment' END AS field FROM o WHERE data IS NOT NULL)
SELECT event_id, field, trim(coalesce(json_extract_string(data, '$.' || field), '')) AS body, (json_type(data, '$.annotationSortIndex') <> 'VARCHAR' OR trim(json_extract_string(data, '$.annotationSortIndex')) = '' OR coalesce(json_type(data, '$.annotationPageLabel'), 'NULL') <> 'VARCHAR'
OR NOT (coalesce(json_type(data, '$.annotationPosition'), 'NULL') = 'OBJECT' OR (coalesce(json_type(data, '$.annotationPosition'), 'NULL') = 'VARCHAR' AND trim(json_extract_string(data, '$.annotationPosition')) <> ''))) AS broken FROM f""")
def _(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events_of_open_annotations")
    rows = spark.sql(OPEN.replace("FROM events)", "FROM events_of_open_annotations)").strip("()"))
    sound, _ = open_items.parsed(rows)
    return sound.select("event_id", open_items.body_field(F.col("data")).alias("field"), open_items.body(F.col("data")).alias("body"), open_items.is_broken(F.col("data")).alias("broken"))


# a command, from tables to tables


def busy_for_purchase(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, str]:
    """As the service that refuses one kind of text, but it says that it is busy: other items go on."""
    status, answer = refuses_buy(url, headers, body, timeout)
    return (503, "busy") if status == 402 else (status, answer)


@query("command_translate", f"""WITH a AS (SELECT *, max(CASE WHEN {TARGET} AND trim(body) = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY pdf ORDER BY key) AS bad FROM {ANNOTATIONS}),
p AS (SELECT pdf, count(*) FILTER (WHERE pending AND NOT ({TARGET} AND trim(body) <> '' AND bad = 0)) AS pending, count(*) FILTER (WHERE {TARGET} AND trim(body) <> '' AND bad = 0) AS updated FROM a GROUP BY pdf)
SELECT CAST(n_nationkey AS BIGINT) AS key, CASE WHEN coalesce(pending, 0) = 0 THEN 'translated' ELSE 'base-done' END AS tags, coalesce(updated, 0) AS updated FROM nation LEFT JOIN p ON pdf = n_nationkey""")
def _(spark, d):
    # nations are items with a file each; the annotations of the first twenty are events
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("title"))
    items = nations.select("key", F.lit(1).cast("long").alias("version"), F.array(F.lit("base-done")).alias("tags"), "title", F.create_map().cast("map<string,string>").alias("data"))
    files = nations.select("key", F.col("key").alias("parent"), F.lit(0).alias("ord"), F.lit("application/PDF").alias("content_type"))
    none = spark.createDataFrame([], layout.SCHEMA)
    settings = Settings(provider="openai", chat_key="k", chat_model="m")
    _, after, counts = commands.translate(commands.Library(items, files, none, annotations(spark, d)), settings, max_items=1000, transport=busy_for_purchase)
    done = counts.select(F.col("pdf").alias("key"), "updated")
    return after.join(done, "key", "left").select("key", F.array_join("tags", ",").alias("tags"), F.coalesce("updated", F.lit(0)).cast("long").alias("updated"))
