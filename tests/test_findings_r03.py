"""What the third review found: each test fails without its repair."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.functions import plain
from foliospark.functions import text as T
from foliospark.operators import assembly, blocks, library, pdf_geometry
from foliospark.plans import fake_pdf, library_queries
from foliospark.plans.fake_service import Cells, Shelf, Store
from foliospark.sources import service

from test_operators import page_lines, values


def test_math_names_end_at_letters_beyond_ascii(spark):
    texts = ["SSBER!! PFÄE", "maxE", "éLi", "a9E"]
    assert values(spark, T.is_mathish, texts) == [True, False, True, False] == [plain.is_mathish(t) for t in texts]


def test_capitals_keep_a_text_as_long_as_it_is(spark):
    assert values(spark, T.upper, ["ßber ﬁn é", "plain", "ᾀŉ", "ß\U0001d11e"]) == ["ẞBER ﬁN É", "PLAIN", "ᾈŉ", "ẞ\U0001d11e"]
    heading = lambda c: blocks.is_heading_only(c, F.lit(1))
    assert values(spark, heading, ["Aﬁ RUNS", "TABLE 3: RUNS", "ẞ"]) == [True, True, False]


def test_a_window_ends_where_it_should(spark):
    # a line that ends exactly 0.55 of the page above the caption is outside of the window
    y = 654.3899999999994
    cell = (50.0, 202.38999999999942, 280.0, 202.38999999999942 + 12, "5 6 7", 10.0)
    caption = (50.0, y, 280.0, y + 12, "Table 2: results", 10.0)
    assert page_lines(spark, blocks.drop_table_bodies, [cell, caption]) == ["5 6 7", "Table 2: results"]


def test_of_equal_attachments_the_first_stored_counts(spark):
    rows = [(1, 2, n, "application/pdf", 50 - n) for n in range(40)]
    children = spark.createDataFrame(rows, "parent long, ord int, key long, content_type string, stored long").repartition(7, "key")
    assert [r["key"] for r in library.first_pdf(children, order=("ord", "stored")).collect()] == [39]


def test_stored_tags_are_no_product(spark, tmp_path):
    docs = [(i, f"line {i}\nshared", "src0" if i < 4 else "src1", "en", 1) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = library_queries.planned(spark, str(tmp_path))
    assert plan.where("duplicate").count() == 102  # each even document has the shared line, and two of the source their own
    assert "Product" not in plan._jdf.queryExecution().toString() and "half" not in plan._jdf.queryExecution().toString()


def test_documents_are_walked_through_whole_over_batches(spark):
    """Documents that end amid a batch, and pages by steps."""
    made = [(d, p, 0, False, [(p, 0, 50.0, 60.0, 250.0, 72.0, f"Words of document {d}.", 10.0)], 600.0, 800.0, 12.0) for d in range(700) for p in range(3)]
    rows = spark.createDataFrame(made, f"doc_id long, page_index int, ord long, caption boolean, lines array<{assembly.LINE_SQL}>, page_w double, page_h double, line_h double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = assembly.merged_documents(rows)
        assert found.groupBy("doc_id").count().where("count = 3").count() == 700
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = pa.RecordBatch.from_pylist([{**dict(zip(("doc_id", "page_index", "ord", "caption", "page_w", "page_h", "line_h"), (*r[:4], *r[5:]), strict=True)), "lines": [dict(zip(assembly.Line._fields, x, strict=True)) for x in r[4]]} for r in made], assembly._PARAGRAPHS)
    assert {b.num_rows <= assembly.STEP for b in assembly._documents(iter([whole]))} == {True}


def test_a_shelf_makes_items_of_what_is_asked_for(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "items"))
    calls = []
    item = lambda r: calls.append(1) or {"key": str(r["id"]), "version": 1, "data": {"tags": []}}
    shelf = Shelf(str(tmp_path / "items"), ("id",), lambda r: {"key": str(r["id"]), "version": 1, "data": {"tags": []}})
    shelf.as_item = item
    assert json.loads(shelf("GET", "/items", {"start": 4990, "limit": 100}, {}, b"")[2])[-1]["key"] == "4999" and len(calls) == 10
    reader = service.ItemsReader({"transport": service.pickled(lambda *_: (200, {"Total-Results": "900000"}, b"[]"))})
    reader.page, reader.pages = 20, 2
    parts = reader.partitions()
    assert len(parts) <= service.PARTITIONS and parts[-1].stop == 900000 and all(a.stop == b.start for a, b in zip(parts, parts[1:]))


def test_one_item_is_written_by_many_tasks_into_few_files(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    figures = service.create_items(spark.range(3000).select(F.lit("one").alias("item"), F.col("id").alias("n")), "item", ["n"], store, "r")
    assert figures["batches"] == 300 and figures["created"] == 3000
    assert len(list((tmp_path / "s" / "rows").glob("*.json"))) <= 256
    cells = Cells(str(tmp_path / "c"))
    cells.fill(spark.range(3000).select(F.col("id").cast("string").alias("key"), F.lit('{"version": 1}').alias("row")))
    assert len(list((tmp_path / "c").glob("*/*.json"))) <= 110 and cells._now("2999")["version"] == 1
    assert not cells._put("2999", {"version": 1, "late": True}) and cells._put("2999", {"version": 2}) and cells._now("2999")["version"] == 2


def test_page_trees_are_followed_without_a_shuffle(spark):
    flat = fake_pdf.made(1, [(k % 4, k + 20) for k in range(300)], True)
    files = spark.createDataFrame([(1, flat), (2, None)], "key long, content binary")
    assert "Exchange" not in pdf_geometry.page_tree(files)._jdf.queryExecution().executedPlan().toString()
    assert pdf_geometry.page_sizes(files).where("key = 1").count() == 300
    loop = fake_pdf.file_of({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: "<< /Type /Page /MediaBox [0 0 1 2] >>"})
    assert [r["page_index"] for r in pdf_geometry.page_sizes(spark.createDataFrame([(1, loop)], "key long, content binary")).collect()] == [0]
