"""Calls in order, the ledger, the hash store, writes and paged reading."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.operators import annotations as A
from foliospark.operators import enrich, layout, open_items, pdf_geometry, writes
from foliospark.plans import fake_pdf
from foliospark.plans.fake_service import Cells, Shelf, Store
from foliospark.sources import layout_json, service
from foliospark.sources.hash_store import HashStore
from foliospark.streaming.incremental import store_unseen

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # transports are made here, and run elsewhere
CHAT = Settings(provider="chatgpt", chat_key="k", chat_model="m", target_lang="JA")


def counting(folder, bad=()):
    """A chat service that keeps a file of the texts it was sent."""

    def send(_url, _headers, body, _timeout):
        text = json.loads(body)["messages"][1]["content"].split("TARGET:\n")[1].split("\n\nContext (next):")[0]
        with open(f"{folder}/sent", "a") as file:
            file.write(text + "\n")
        if text in bad:
            return {"q": 402, "a": 401}.get(text[0], 500), "{}"
        return 200, json.dumps({"choices": [{"message": {"content": text.upper()}}]})

    return send


def sent(folder):
    try:
        with open(f"{folder}/sent") as file:
            return file.read().split("\n")[:-1]
    except FileNotFoundError:
        return []


def test_no_call_after_the_first_error_of_an_item(spark, tmp_path):
    rows = [(i, o, f"{'t' if (i + o) % 5 == 4 else 'x'}{i}-{o}") for i in range(6) for o in range(12)]
    bad = {t for _, _, t in rows if t[0] == "t"}
    df = spark.createDataFrame(rows, "item int, ord int, text string").orderBy(F.rand(1))
    out = enrich.translated_in_order(df, "item", "ord", context=False, settings=CHAT, transport=counting(tmp_path, bad), wait=lambda _s: None).collect()
    for i in range(6):
        mine = sorted((r.ord, r) for r in out if r.item == i)
        first = next(o for o, r in mine if r.text in bad)
        assert [r.calls for _, r in mine] == [1] * first + [3] + [0] * (11 - first)
        assert all(r.answer == r.text.upper() for o, r in mine if o < first) and all(r.answer is None and r.error is None for o, r in mine if o > first)
        assert mine[first][1].error == "temporary"
    assert len(sent(tmp_path)) == sum(r.calls for r in out)
    assert not set(sent(tmp_path)) & {r.text for r in out if not r.calls}


def test_quota_ends_the_calls_of_a_task(spark, tmp_path):
    rows = [(1, 0, "x"), (2, 0, "q"), (2, 1, "x"), (3, 0, "y"), (3, 1, "z"), (4, 0, "")]
    df = spark.createDataFrame(rows, "item int, ord int, text string")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        out = enrich.translated_in_order(df, "item", "ord", context=False, settings=CHAT, transport=counting(tmp_path, {"q"})).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {(r.item, r.ord): (r.error, r.calls) for r in out} == {(1, 0): (None, 1), (2, 0): ("quota", 1), (2, 1): (None, 0), (3, 0): ("quota", 0), (3, 1): (None, 0), (4, 0): (None, 0)}
    assert sent(tmp_path) == ["x", "q"]


def test_empty_answers_are_tried_again(spark, tmp_path):
    enrich.PROVIDERS["empty"] = lambda _p, _c, _n: "Translation: "
    out = enrich.translated_in_order(spark.createDataFrame([(1, 1, "a")], "item int, ord int, text string"), "item", "ord", "empty", context=False, wait=lambda _s: None).first()
    assert (out.answer, out.error, out.calls) == (None, "temporary", 3)
    enrich.PROVIDERS["fenced"] = lambda _p, c, _n: f"```text\nTranslation: {c}\n```"
    assert enrich.translated_in_order(spark.createDataFrame([(1, 1, "a")], "item int, ord int, text string"), "item", "ord", "fenced", context=False).first().answer == "a"


@pytest.mark.parametrize("wave_rows", [1_000_000, 7])
def test_a_second_run_makes_no_call(spark, tmp_path, wave_rows):
    rows = [(i, o, f"text {i}-{o}") for i in range(8) for o in range(5)]
    df = spark.createDataFrame(rows, "item int, ord int, text string")
    ask = lambda df, **how: enrich.translated_with_ledger(df, "item", "ord", str(tmp_path / "ledger"), CHAT, context=False, wave_rows=wave_rows, transport=counting(tmp_path, {"text 3-2"}), wait=lambda _s: None, **how)
    first = ask(df)
    assert {(r.item, r.ord) for r in first.collect() if r.answer} == {(i, o) for i, o, _ in rows if i != 3 or o < 2}
    assert len(sent(tmp_path)) == 40 - 2 + 2
    first.collect()  # what is lost is read again
    del first
    again = ask(df).collect()
    assert len(sent(tmp_path)) == 40 + 3 and {r.text for r in again if r.calls} == {"text 3-2"}
    # another text, model or language is asked for
    more = ask(df.unionAll(spark.createDataFrame([(9, 0, "new")], df.schema)).where("item <> 3")).collect()
    assert {r.text for r in more if r.calls} == {"new"} and len(more) == 36
    assert enrich.ledger(spark, str(tmp_path / "ledger"), Settings(provider="chatgpt", chat_key="k", chat_model="other", target_lang="JA")).count() == 0
    assert ask(df.limit(0)).count() == 0


def test_context_is_part_of_the_key(spark):
    rows = spark.createDataFrame([("a", "b", "c"), ("a", "b", None), ("a", "b", ""), ("x", "b", "c")], "prev_text string, text string, next_text string")
    assert rows.select(enrich.content_key(True)).distinct().count() == 3 and rows.select(enrich.content_key(False)).distinct().count() == 1


# running headers


def test_headers_of_a_long_document(spark):
    """50,000 pages of one document: a header on all pages, a footer on two of them, and a body text that is a header elsewhere."""
    line = lambda y, t: f"struct(array(50D, {y}D, 300D, {y + 12}D) as bbox, array(struct({t} as text, array(50D, {y}D, 300D, {y + 12}D) as bbox, 10D as size)) as spans)"
    body = ", ".join(line(100 + 60 * k, f"concat('body text number {k} of page ', id)") for k in range(10))
    page = f"struct(cast(id + 1 as int) as page, 595D as width, 842D as height, struct(array(struct(0 as type, array({line(2, repr('A header of this book'))}, {body}, {line(828, "if(id < 2, 'A rare footer of it', 'page')")}) as lines)) as blocks) as dict)"
    dumps = spark.range(50_000).repartition(16).select(F.lit("d").alias("doc_id"), F.array(F.expr(page)).alias("pages")).unionAll(spark.sql(f"select 'e' doc_id, array({page.replace('id', '0')}) pages"))
    kept = layout.filtered_pages(dumps)
    counts = kept.select("doc_id", F.explode("lines.text").alias("text")).groupBy("doc_id", F.regexp_replace("text", r"\d+", "").alias("kind")).count().collect()
    n = {(r.doc_id, r.kind): r["count"] for r in counts}
    assert ("d", "A header of this book") not in n and n["e", "A header of this book"] == 1
    assert n["d", "A rare footer of it"] == 2 and n["d", "page"] == 49_998 and n["d", "body text number  of page "] == 500_000


def test_headers_count_distinct_pages(spark):
    xs = [("d", p, 600.0, 800.0, o, 50.0, y, 300.0, y + 12, t, 10.0) for p, o, y, t in [(0, 0, 2.0, "twice on one page"), (0, 1, 20.0, "twice on one page"), (1, 0, 2.0, "twice on one page"), (0, 2, 2.5, "on three pages"), (1, 2, 2.5, "on three pages"), (2, 2, 2.5, "on three pages"), (2, 3, 400.0, "on three pages")]]
    rows = spark.createDataFrame(xs, "doc_id string, page_index int, page_w double, page_h double, ord long, x0 double, y0 double, x1 double, y1 double, text string, font_size double").withColumn("block_no", F.lit(0))
    rows = rows.select("doc_id", "page_index", "page_w", "page_h", *[F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in layout.blocks.LINE])
    pages = layout.with_metrics(layout.pages_from_lines(rows))
    assert [tuple(r) for r in layout.running_texts(pages).collect()] == [("d", "on three pages")]
    assert layout.without_running(pages).select(F.explode("lines.text").alias("t")).where("t = 'on three pages'").count() == 0


# the hash store


def hashes(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n int").withColumn("hash", F.sha1(F.encode(F.col("n").cast("string"), "UTF-8")))


def test_store_is_joined_where_it_stands(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "store"), buckets=4)
    store.add(hashes(spark, *range(500)), 0)
    store.add(hashes(spark, *range(400, 900)), 1)
    store.add(hashes(spark, *range(400, 900)), 1)
    assert store.rows().count() == 900 and {tuple(r) for r in store.rows().groupBy("batch").count().collect()} == {(0, 500), (1, 400)}
    asked = hashes(spark, 5, 899, 900, 900, 901).unionAll(spark.createDataFrame([(0, None)], "n int, hash string"))
    fresh = store.unseen(asked)
    assert sorted(r.n for r in fresh.collect()) == [0, 900, 900, 901]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString() + fresh._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.rindex(f"FileScan parquet spark_catalog.default.{store.name}") - 250 :] if f"default.{store.name}" in plan else plan[plan.rindex("FileScan parquet") - 250 :]
    assert "Bucketed: true" in side and "Exchange" not in side[: side.index("FileScan")]
    assert sorted(r.n for r in store.unseen(asked.where("hash is not null"), batch=1).collect()) == [899, 900, 900, 901]


def test_store_prunes_and_opens_again(spark, tmp_path):
    path = str(tmp_path / "store")
    store = HashStore(spark, path, buckets=2)
    store.add(hashes(spark, *range(300)), 0)
    few = hashes(spark, 7, 1000)
    pruned = store.unseen(few, prune=True)
    assert [r.n for r in pruned.collect()] == [1000]
    assert 1 <= len(store.prefixes(few)) <= 2 and "PartitionFilters: [isnotnull(prefix" in pruned._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [prefix" in pruned._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {store.name}")
    again = HashStore(spark, path, buckets=2)
    assert again.rows().count() == 300 and again.unseen(few).count() == 1


def test_stream_matches_the_store_alone(spark, tmp_path):
    path = {n: str(tmp_path / n) for n in ("in", "out", "mark", "store")}
    for wave in ([1, 2, 2], [2, 3], [3, 4, 4, 1]):
        hashes(spark, *wave).coalesce(1).write.mode("append").parquet(path["in"])
        stream = spark.readStream.schema("n int, hash string").parquet(path["in"])
        store_unseen(stream, path["out"], path["mark"], path["store"]).awaitTermination()
    out = spark.read.parquet(path["out"])
    assert sorted((r.batch, r.n) for r in out.collect()) == [(0, 1), (0, 2), (0, 2), (1, 3), (2, 4), (2, 4)]
    # a batch that is repeated after a failure replaces itself
    store = HashStore(spark, path["store"])
    assert sorted(r.n for r in store.unseen(hashes(spark, 3, 4, 4, 1), batch=2, prune=True).collect()) == [4, 4]


# a library behind a service


class Log:
    """A transport that writes down what it is asked, and passes it on."""

    def __init__(self, inner, file):
        self.inner, self.file = inner, str(file)

    def __call__(self, method, path, params, headers, body):
        with open(self.file, "a") as f:
            f.write(json.dumps([method, path, params]) + "\n")
        return self.inner(method, path, params, headers, body)

    def seen(self):
        with open(self.file) as f:
            return [json.loads(x) for x in f]


def shelf(spark, tmp_path, n=53, **how):
    spark.range(n).select("id").coalesce(1).write.parquet(str(tmp_path / "items"))
    item = lambda r: {"key": str(r["id"]), "version": 1, "data": {"itemType": "annotation" if r["id"] % 4 == 0 else "file", "parentItem": str(r["id"] % 3), "title": "t", "tags": [{"tag": "a"}, {"tag": "b"}, {"tag": " "}] if r["id"] % 2 else []}}
    return Log(Shelf(str(tmp_path / "items"), ("id",), item, **how), tmp_path / "log")


def test_pages_are_read_by_ranges_and_filters_reach_the_service(spark, tmp_path):
    log = shelf(spark, tmp_path)
    rows = service.read_items(spark, log, page_rows=5, partition_pages=2)
    assert rows.rdd.getNumPartitions() == 6
    assert sorted((int(r.key), r.tag or "") for r in rows.collect()) == sorted((i, t) for i in range(53) for t in ("ab" if i % 2 else [""]))
    one = rows.where("tag = 'a' and version > 0")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "= a)" not in plan and "> 0)" in plan  # the tag is in the scan, what the service can't test is not
    (tmp_path / "log").unlink()
    assert sorted(int(r.key) for r in one.collect()) == list(range(1, 53, 2))
    assert log.seen() and all(params["tag"] == "a" for _, _, params in log.seen())


def test_children_are_all_read_whatever_their_kind(spark, tmp_path):
    """Offsets go by what the service sent, not by what is left of it."""
    for total in (True, False):
        log = shelf(spark, tmp_path / str(total), with_total=total)
        rows = service.read_items(spark, log, page_rows=4, partition_pages=1).where("parent in ('0', '2') and item_type = 'annotation'")
        assert sorted(int(r.key) for r in rows.collect()) == [i for i in range(0, 53, 4) if i % 3 != 1]
        assert {p for _, p, _ in log.seen()} == {"/items/0/children", "/items/2/children"}


def test_a_lost_answer_or_a_second_run_creates_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k % 3}", k) for k in range(70)], "item string, n int")
    store = Store(str(tmp_path / "s"), lambda row, size: row["n"] == 11 or (size > 1 and row["n"] == 12), lambda token: token[0] in "0123456")
    figures = [service.create_items(rows, "item", ["n"], store, "r", batch_rows=5) for _ in range(2)]
    assert figures[0] == figures[1] == {"batches": 15, "planned": 70, "created": 69, "failed": 1, "samples": ["i2-0: {'code': 400}"]}
    held = [r.n for r in spark.read.schema("n int").json(str(tmp_path / "s" / "rows")).collect()]
    assert sorted(held) == [n for n in range(70) if n != 11]
    assert service.create_items(rows, "item", ["n"], store, "other", batch_rows=5)["created"] == 69  # another run is another thing


def test_a_failed_job_commits_nothing_and_goes_on_from_there(spark, tmp_path):
    rows = spark.createDataFrame([("a", k) for k in range(12)] + [("b", 99)], "item string, n int")
    store = Store(str(tmp_path / "s"))

    def down(method, path, params, headers, body):
        if method == "POST" and b"99" in body:
            raise RuntimeError("down")
        return store(method, path, params, headers, body)

    with pytest.raises(Exception, match="down"):
        service.create_items(rows, "item", ["n"], down, "r")
    assert json.loads((tmp_path / "s" / "runs" / "r").read_text()) == {"aborted": True}
    assert service.create_items(rows, "item", ["n"], store, "r") == {"batches": 3, "planned": 13, "created": 13, "failed": 0, "samples": []}
    assert spark.read.schema("n int").json(str(tmp_path / "s" / "rows")).count() == 13


# writes under a version


def cells_of(spark, tmp_path, rows, other=lambda _k, _r: None):
    store = Cells(str(tmp_path / "cells"), other)
    store.fill(spark.createDataFrame([(k, json.dumps(r)) for k, r in rows.items()], "key string, row string"))
    return store


def changes(spark, *rows):
    return spark.createDataFrame([(a, k, v, json.dumps(r)) for a, k, v, r in rows], "action string, key string, version long, row string")


def test_conflicts_are_read_back_and_decided_anew(spark, tmp_path):
    rows = {k: {"version": 4, "n": 1} for k in "abcdef"}
    store = cells_of(spark, tmp_path, rows, lambda key, row: {"n": 7 if key == "b" else 50} if key in "bc" else None)
    asked = changes(spark, *[("update", k, 4, {"n": 2}) for k in "abc"], ("update", "d", 3, {"n": 2}), ("delete", "e", 4, {}), ("delete", "x", 1, {}))

    def again(stale):
        now = stale.select("key", F.from_json("now", "version long, n int").alias("r")).where("r.n < 50")
        return now.select(F.lit("update").alias("action"), "key", "r.version", F.to_json(F.struct((F.col("r.n") + 1).alias("n"))).alias("row"))

    done = writes.written_back(asked, store, again)
    for _ in range(2):  # an action on the outcome writes nothing again
        assert {(r.key, r.status, r.tries) for r in done.collect()} == {("a", "updated", 1), ("b", "updated", 2), ("c", "superseded", 1), ("d", "updated", 2), ("e", "deleted", 1), ("x", "missing", 1)}
    now = {k: store._now(k) for k in "abcdef"}
    assert {k: (r["version"], r["n"]) for k, r in now.items()} == {"a": (5, 2), "b": (6, 8), "c": (5, 50), "d": (5, 2), "e": (5, 1), "f": (4, 1)} and now["e"]["deleted"]


def test_what_never_settles_stays_a_conflict(spark, tmp_path):
    store = cells_of(spark, tmp_path, {"a": {"version": 4}})
    stale = lambda found: found.select(F.lit("update").alias("action"), "key", F.lit(1).cast("long").alias("version"), F.lit("{}").alias("row"))
    done = writes.written_back(changes(spark, ("update", "a", 1, {})), store, stale, rounds=3)
    assert [tuple(r) for r in done.collect()] == [("a", "conflict", 3)]


def test_healing_ends_as_the_store_stands(spark, tmp_path):
    """One repaired, one deleted, one that somebody mended meanwhile, one somebody else spoilt further, and one that is sound."""
    sound = {A.SORT: "s", A.LABEL: "1", A.PLACE: "p"}
    rows = {k: {"pdf": "d", "version": 1, "data": dict(sound) if k == "ok" else {A.LABEL: "1"}, "tags": [f"para:{k}"]} for k in ("fix", "gone", "mended", "spoilt", "ok")}
    theirs = {"mended": {"data": dict(sound)}, "spoilt": {"data": {"x": "y"}}}
    store = cells_of(spark, tmp_path, rows, lambda key, row: row | theirs[key] if key in theirs else None)

    def read():
        held = spark.read.schema("key string, pdf string, version long, data map<string,string>, tags array<string>, deleted boolean").json(f"{tmp_path}/cells/*")
        return held.groupBy("key").agg(F.max_by(F.struct("pdf", "version", "data", "tags", "deleted"), "version").alias("r")).select("key", "r.*").where("deleted is null").drop("deleted")

    fields = F.struct(F.lit("P").alias(A.PLACE), F.lit("2").alias(A.LABEL), F.lit("S").alias(A.SORT))
    places = spark.createDataFrame([("d", f"para:{k}", 0) for k in ("fix", "mended", "spoilt")], "pdf string, tag string, rank int").withColumn("fields", fields)
    after, counts = writes.healed_in_place(read, store, places)
    assert [tuple(r) for r in counts.collect()] == [("d", 4, 4, 2, 1, 1, 0)]
    assert {r.key: (r.version, r.data.get(A.SORT)) for r in after.collect()} == {"fix": (2, "S"), "mended": (2, "s"), "spoilt": (3, "S"), "ok": (1, "s")}
    _, left = writes.healed_in_place(read, store, places)
    assert [tuple(r) for r in left.collect()] == [("d", 0, 0, 0, 0, 0, 0)]


# layout dumps


def test_one_bad_dump_leaves_the_rest(spark, tmp_path):
    sound = json.dumps({"doc_id": 1, "pages": [{"page": 1, "width": 1.0, "height": 2.0, "dict": {"blocks": []}}]})
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join([sound, "", sound[:-3], '{"doc_id": 2}', '{"doc_id": 3, "pages": {"page": 1}}', "[1]", '{"doc_id": 4, "pages": []}']))
    good, bad = layout_json.scan_layout(spark, str(tmp_path / "lines"))
    assert sorted((r.doc_id, len(r.pages)) for r in good.collect()) == [(1, 1), (4, 0)]
    assert sorted((r.reason, r["sample"][:9]) for r in bad.collect())[:2] == [("malformed", '{"doc_id"'), ("no_pages", '{"doc_id"')] and bad.count() == 4
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.json").write_text(json.dumps(json.loads(sound), indent=2))
    (tmp_path / "files" / "b.json").write_text("{\n")
    good, bad = layout_json.scan_layout(spark, str(tmp_path / "files"), whole_files=True)
    assert [r.doc_id for r in good.collect()] == [1]
    assert [(r.reason, r.file.rsplit("/", 1)[1]) for r in bad.collect()] == [("malformed", "b.json")]


# page sizes of PDF files


def sizes(spark, *files):
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "key int, content binary")
    return sorted((r.key, r.page_index, r.w, r.h) for r in pdf_geometry.page_sizes(rows).collect())


@pytest.mark.parametrize("packed", [False, True])
def test_boxes_come_down_the_tree(spark, packed):
    tree = {
        1: "<< /Type /Catalog /Pages 2 0 R >>",
        2: "<< /Type/Pages /Kids 9 0 R /Count 5 /MediaBox [0 0 595 842] /Rotate 8 0 R >>",
        3: "<< /Type/Page /Parent 2 0 R >>",
        4: "<< /Type/Pages /Parent 2 0 R /Kids[5 0 R 6 0 R 7 0 R] /Rotate 0 /CropBox [10 20 110.5 320] >>",
        5: "<< /Type/Page /Parent 4 0 R >>",
        6: "<< /Type/Page /Parent 4 0 R /CropBox 10 0 R /Rotate 270 >>",
        7: "<< /Type/Page /Parent 4 0 R /CropBox [0 0 0 0] >>",
        8: "90",
        9: "[3 0 R 4 0 R 11 0 R]",
        10: "[-5 -5 +95.25 45]",
        11: "<< /Type /Page /Parent 2 0 R /Annots [12 0 R] /Rotate -180 >>",
    }
    assert sizes(spark, fake_pdf.file_of(tree, packed)) == [(0, 0, 842.0, 595.0), (0, 1, 100.5, 300.0), (0, 2, 50.0, 100.25), (0, 4, 595.0, 842.0)]


def test_updates_streams_and_damaged_files(spark):
    tree = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] >>", 3: "<< /Type /Page /MediaBox [0 0 1 2] >>"}
    plain = fake_pdf.file_of(tree)
    updated = plain + b"\n3 0 obj\n<< /Type /Page /MediaBox [0 0 30 40] >>\nendobj\ntrailer\n<< /Root 1 0 R /Prev 9 >>\nstartxref\n0\n%%EOF"
    hidden = b"%PDF-1.4\n8 0 obj\n<< /Length 60 >>\nstream\n3 0 obj << /Type /Page /MediaBox [0 0 7 7] >> endobj          \nendstream\nendobj\n" + plain[9:]
    lost = plain.split(b"trailer")[0]
    other_root = fake_pdf.file_of({**tree, 5: "<< /Type /Catalog /Pages 6 0 R >>", 6: "<< /Type /Pages /Kids [7 0 R] >>", 7: "<< /Type /Page /MediaBox [0 0 5 6] >>"}, root=1)
    cycle = fake_pdf.file_of({**tree, 2: "<< /Type /Pages /Kids [2 0 R 3 0 R] >>"})
    damaged = b"%PDF-1.5 stream \x00\xff /MediaBox [0 0 500 700] /CropBox [0 0 500 700] /MediaBox [0 0 9 9]"
    got = sizes(spark, plain, updated, hidden, lost, other_root, damaged, b"", None)
    assert got == [(0, 0, 1.0, 2.0), (1, 0, 30.0, 40.0), (2, 0, 1.0, 2.0), (3, 0, 1.0, 2.0), (4, 0, 1.0, 2.0), (5, 0, 500.0, 700.0)]
    assert len(fake_pdf.made(3, [(0, 5)] * 4, True)) > 100 and cycle


def test_binary_files_are_read_from_a_folder(spark, tmp_path):
    for n, pages in (("a", [(2, 0)]), ("b", [(0, 30), (1, 0)])):
        (tmp_path / f"{n}.pdf").write_bytes(fake_pdf.made(1, pages, True))
    found = pdf_geometry.page_sizes(layout_json.read_binary(spark, str(tmp_path)))
    assert sorted((r.key[-5:], r.page_index, r.w, r.h) for r in found.collect()) == [("a.pdf", 0, 500.0, 700.0), ("b.pdf", 0, 30.0, 60.0), ("b.pdf", 1, 700.0, 500.0)]


# annotations of an open schema


def test_missing_null_text_and_object_are_four_things(spark):
    whole = {A.SORT: "s", A.LABEL: "1", A.PLACE: {"pageIndex": 0}}
    cases = [(whole, False), ({**whole, A.PLACE: "{}"}, False), ({**whole, A.PLACE: " "}, True), ({**whole, A.PLACE: None}, True), ({**whole, A.PLACE: [1]}, True), ({**whole, A.LABEL: 1}, True), ({**whole, A.SORT: None}, True), ({A.SORT: "s", A.LABEL: "1"}, True)]
    rows, bad = open_items.parsed(spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(90, "{"), (91, "[1]"), (92, None)], "i int, data string"))
    assert [r.b for r in rows.orderBy("i").select(open_items.is_broken(F.col("data")).alias("b")).collect()] == [b for _, b in cases]
    assert sorted(r.i for r in bad.collect()) == [90, 91, 92]
    bodies = [({A.COMMENT: None, "note": "n"}, (A.COMMENT, "")), ({"note": " n "}, ("note", "n")), ({}, (A.COMMENT, "")), ({A.COMMENT: 5}, (A.COMMENT, "5"))]
    rows, _ = open_items.parsed(spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(bodies)], "i int, data string"))
    assert [(r.f, r.b) for r in rows.orderBy("i").select(open_items.body_field(F.col("data")).alias("f"), open_items.body(F.col("data")).alias("b")).collect()] == [w for _, w in bodies]
    held = spark.createDataFrame([(json.dumps({"a": "x", "b": None, "c": {"d": [1]}, "e": 2}),)], "data string")
    assert open_items.parsed(held)[0].select(open_items.as_map(F.col("data")).alias("m")).first().m == {"a": "x", "b": "", "c": '{"d":[1]}', "e": "2"}
