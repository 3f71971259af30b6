import json

import pytest
from pyspark.sql import functions as F

from foliospark import commands
from foliospark.config import Settings, load
from foliospark.functions import plain
from foliospark.functions import text as T
from foliospark.operators import adapter, assembly, blocks, enrich, layout, library, position, providers
from foliospark.operators import annotations as A
from foliospark.operators import paragraphs as P
from foliospark.operators import reconcile as R
from foliospark.sources import layout_json
from foliospark.streaming.incremental import store_unseen


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_normalize_handles_every_white_space(spark):
    assert values(spark, T.normalize, [None, "", " a\t b 　c\x1cd ", "x"]) == ["", "", "a b c d", "x"]


def test_headings(spark):
    texts = ["6 Conclusion", "4.1 Preprocessing and Model", "IV Results", "References", "This is a sentence.", "a, b", "x = y", "", "civil war"]
    assert values(spark, T.is_heading, texts) == [True, True, True, True, False, False, False, False, True]


def test_captions_and_references(spark):
    assert values(spark, T.is_caption, ["Figure 1: x", "Table IV. y", "図 3: z", "Figure one"]) == [True, True, True, False]
    assert values(spark, T.reference_score, ["[1] Smith, J. 1999", "short", "7. Doe (2004) doi"]) == [3, 0, 4]


def test_table_score_is_bounded(spark):
    rows, prose, signed = values(spark, T.table_score, ["1 2 3 4 5 6 7 8 9 10 11 12", "This is a plain sentence of many words.", "12% 3% 4%"])
    assert rows == pytest.approx(0.92) and prose == 0.0 and signed > 0.5
    assert values(spark, lambda c: T.table_score(c, percent=False), ["12% 33% 44%"]) == [0.0]


def test_errors_and_answers(spark):
    df = spark.createDataFrame([(401, "quota"), (429, "billing"), (429, ""), (500, None), (456, "")], "s int, d string")
    assert [r[0] for r in df.select(T.error_kind(F.col("s"), F.col("d"))).collect()] == ["auth", "quota", "rate_limit", "temporary", "temporary"]
    assert [r[0] for r in df.select(T.error_kind(F.col("s"), F.col("d"), "deepl")).collect()] == ["auth", "rate_limit", "rate_limit", "temporary", "quota"]
    assert values(spark, T.clean_answer, ["Translation: a", "```x\nb\n```", "  ", "translation: translation: c"]) == ["a", "b", None, "translation: c"]


def test_json_must_be_one_value(spark):
    assert values(spark, T.is_json, ['{"a": 1}', '{"a": 1}}', "1,2", "{", "[1, 2]"]) == [True, False, False, False, True]


def chained(spark, texts, pages=None):
    rows = [(1, i, t, (pages or [1] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, ord int, text string, page int")


def test_continuations_keep_the_first_hash(spark):
    out = P.merge_continuations(chained(spark, ["One starts", "and goes on", "to the end.", "next one"])).orderBy("ord").collect()
    assert [r.text for r in out] == ["One starts and goes on to the end.", "next one"]
    assert len(out[0].hashes) == 3 and out[0].hash == out[0].hashes[0]


def test_continuations_stop_at_far_pages(spark):
    out = P.merge_continuations(chained(spark, ["One", "two", "three"], [1, 2, 4])).orderBy("ord").collect()
    assert [r.text for r in out] == ["One two", "three"]


def caption_merge(texts):
    """The fold in plain Python."""
    import re

    cap = re.compile(T.CAPTION)
    more = lambda s: bool(s.strip()) and len(s.strip()) <= 120 and not s.strip()[:1].islower() and ("," in s or len(s.split()) <= 6)
    out = []
    for t in texts:
        if out and (more(t) if cap.search(out[-1].strip()) or more(out[-1]) else re.match(T.CONTINUES, t.lstrip()) and not re.search(T.SENTENCE_END, out[-1])):
            out[-1] = f"{out[-1].rstrip()} {t.lstrip()}".strip()
        else:
            out.append(t)
    return out


def test_caption_merge_equals_the_fold(spark):
    import random

    r = random.Random(5)
    pool = ["Figure 1: Games of", "Seaquest, Beam Rider", "an experience of many words that goes on and on", "and more", "This is a full sentence with words.", "Short", ", then", ""]
    for _ in range(5):
        texts = [r.choice(pool) for _ in range(12)]
        out = P.merge_captions(chained(spark, texts)).orderBy("ord").collect()
        assert [x.text for x in out] == caption_merge(texts)


def test_caption_merge_walks_a_long_merge_in_linear_time(spark):
    import time

    def took(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.expr("if(id = 0, 'It begins here with more words than six and', 'and so it goes on and on')").alias("text"))
        began = time.perf_counter()
        out = P.merge_captions(rows).collect()
        assert len(out) == 1 and len(out[0].text) == 43 + 25 * (n - 1)
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 20


def test_references_are_cut_only_late_and_before_entries(spark):
    body = [f"Text number {i}." for i in range(6)]
    late = chained(spark, [*body, "References", "[1] Smith, J. 1999 Proc."])
    assert P.cut_references(late).count() == 6
    # its place is its page's: the first of eight is too early, whatever follows
    assert P.cut_references(chained(spark, ["References", "[1] Smith, J. 1999 Proc.", *body], list(range(1, 9)))).count() == 8
    assert P.cut_references(chained(spark, [*body[:3], "References", *body[:3]], [1, 2, 3, 4, 5, 6, 7])).count() == 7
    assert P.cut_references(chained(spark, [*body[:3], "4 References " + "x" * 120, *body[:3]], [1, 2, 3, 4, 5, 6, 7])).count() == 3
    assert P.cut_references(chained(spark, [*body[:3], "References", "plain"], [1, 2, 3, 9, 10])).count() == 3


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3)], "v double")
    assert P.nearest_rank(df, "v").first()[0] == 3.0  # 0.75 * 2 = 1.5, to even: 2


def test_tags_and_matching(spark):
    df = spark.createDataFrame([(["b", "a"],)], "t array<string>")
    assert df.select(R.merged_tags(F.col("t"), F.array(F.lit("c")), F.array(F.lit("a"), F.lit("c")))).first()[0] == ["b"]
    good, bad = R.split_para_tags(F.array(F.lit("para:" + "a" * 40), F.lit("para:" + "A" * 40), F.lit("x")))
    row = df.select(good, bad).first()
    assert (len(row[0]), len(row[1])) == (1, 1)


def test_equal_paragraphs_of_a_batch_all_stay_and_reruns_plan_none(spark):
    batch = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "hash string")
    stored = spark.createDataFrame([("h2",)], "hash string")
    assert R.unseen(batch, stored).count() == 2
    assert R.unseen(batch, stored.union(batch)).count() == 0


def test_note_position(spark):
    df = spark.createDataFrame([([(1, 100.0, 50.0, 10.0, 10.0), (1, 90.0, 80.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0)],), ([],), (None,)], "c array<struct<page:int,x:double,y:double,w:double,h:double>>")
    first, empty, null = (r[0] for r in df.select(position.note_position(F.col("c"), F.lit(842.0), F.lit(595.0))).collect())
    assert (first.page_index, first.x1, first.y1, first.sort_index) == (0, 60.0, 787.0, "00000|000000|00782")
    assert empty.sort_index == null.sort_index == "00000|000000|00758"


def test_dominant_size_prefers_crop_boxes(spark):
    raw = spark.createDataFrame([("a", bytearray(b"/MediaBox [0 0 595 842] /CropBox [0 0 500 700]"))], "key string, content binary")
    row = position.dominant_size(position.boxes_in(raw), "key").first()
    assert (row.w, row.h) == (500.0, 700.0)


def page(number, lines, size=10.0):
    rows = [{"bbox": [x, y, x + 250.0, y + 12.0], "spans": [{"text": t, "bbox": [x, y, x + 250.0, y + 12.0], "size": size}]} for x, y, t in lines]
    return {"page": number, "width": 595.0, "height": 842.0, "dict": {"blocks": [{"type": 0, "lines": rows}, {"type": 1, "lines": []}]}}


def test_layout_to_paragraphs(spark, tmp_path):
    body = [(50.0, 100.0 + 14 * i, f"Body line number {i} of this page contin-" if i == 0 else f"ues with words of line {i} and more") for i in range(10)]
    pages = [page(n, [(50.0, 5.0, "A Running Header Text"), *body, (172.5, 820.0, str(n))]) for n in (1, 2, 3)]
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": 1, "pages": pages}))
    got = layout.paragraphs_of(layout_json.read_layout(spark, str(tmp_path / "a.json"))).orderBy("page_index", "ord").collect()
    assert len(got) == 3
    assert got[0].text.startswith("Body line number 0 of this page continues with") and got[0].n_lines == 10
    assert not any("Running Header" in r.text for r in got)


def test_spans_are_joined_by_gap(spark):
    spans = [("b", [20.0, 0.0, 30.0, 1.0], 10.0), ("a", [0.0, 0.0, 10.0, 1.0], 10.0), ("c", [30.1, 0.0, 40.0, 1.0], 10.0), (" ", [50.0, 0.0, 51.0, 1.0], 10.0)]
    df = spark.createDataFrame([(spans,)], "s array<struct<text:string,bbox:array<double>,size:double>>")
    assert df.select(layout.span_text(F.col("s"))).first()[0] == "a bc"


def test_providers_fail_by_row(spark):
    calls = spark.createDataFrame([(1, 0, "ok"), (1, 1, "bad"), (1, 2, "ok"), (2, 0, "ok")], "item int, ord int, text string")

    def failing(_p, c, _n):
        if c == "bad":
            raise layout_json.ProviderError("auth")
        return c.upper()

    enrich.PROVIDERS["failing"] = failing
    out = enrich.translated(P.with_context(calls, "item", "ord"), "failing").cache()
    assert {(r.item, r.ord): r.error for r in out.collect()} == {(1, 0): None, (1, 1): "auth", (1, 2): None, (2, 0): None}
    assert enrich.all_or_nothing(out, "item").count() == 1
    assert enrich.up_to_error(out, "item", "ord").count() == 2
    with pytest.raises(RuntimeError):
        enrich.translated(calls, "none")


def test_retries_only_what_may_pass():
    seen = []

    def call(kind):
        def f():
            seen.append(kind)
            raise layout_json.ProviderError(kind)

        return f

    for kind, n in (("temporary", 3), ("auth", 1)):
        seen.clear()
        with pytest.raises(layout_json.ProviderError):
            layout_json.with_retry(call(kind), sleep=lambda _s: None)
        assert len(seen) == n


def test_waits_double_on_the_way_of_the_operator(spark, tmp_path):
    def down(*_):
        raise ConnectionError("down")

    def wait(seconds):
        with open(tmp_path / "waits", "a") as file:
            file.write(f"{seconds}\n")

    rows = spark.createDataFrame([("a", "", "")], "text string, prev_text string, next_text string")
    settings = Settings(provider="chatgpt", chat_key="k", chat_model="m")
    out = enrich.translated(rows, settings=settings, transport=down, wait=wait).collect()
    assert out[0].error == "temporary" and (tmp_path / "waits").read_text().split() == ["0.5", "1.0"]


def test_batched_sink_tries_failures_alone(spark):
    rows = spark.createDataFrame([("a", i) for i in range(23)] + [("b", 1)], "item string, n int")
    done = layout_json.write_batched(rows, "item", ["n"], lambda batch: [len(batch) == 1 or r["n"] % 5 != 0 for r in batch])
    assert {r.item: (r.planned, r.created, r.failed) for r in done.collect()} == {"a": (23, 23, 0), "b": (1, 1, 0)}


def test_stream_stores_each_hash_once(spark, tmp_path):
    schema = "hash string"
    for n in (1, 2):
        spark.createDataFrame([("x",), (f"y{n}",)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        store_unseen(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y1", "y2"]


def test_xml_sink(spark, tmp_path):
    df = spark.createDataFrame([(0, "a\x01b")], "ord int, text string")
    layout_json.write_paragraphs_xml(df, str(tmp_path / "x"))
    assert "a b" in "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))


def page_lines(spark, step, rows, **page):
    """Texts that a block step leaves of ``(x0, y0, x1, y1, text, size)`` lines, top to bottom."""
    known = {"page_w": 600.0, "page_h": 800.0, "line_h": 12.0, "font": 10.0, "bottom": 700.0, "band_h": 12.0} | page
    df = spark.createDataFrame([([(i, *r) for i, r in enumerate(rows)], *known.values())], f"lines {blocks.LINES_TYPE}, " + ", ".join(f"{k} double" for k in known))
    made = df.select(step(F.col("lines")).alias("lines")).first().lines
    return [x.text for x in sorted(made, key=lambda x: (x.y0, x.x0))]


PROSE = "This is a line of plain prose with many words in it."


def test_same_baseline_pairs(spark):
    rows = [(50.0, 10.0, 80.0, 22.0, "a", 10.0), (85.0, 11.0, 100.0, 22.0, "b", 10.0), (104.0, 12.0, 120.0, 22.0, "c", 10.0), (50.0, 40.0, 80.0, 52.0, "d", 10.0), (320.0, 40.0, 340.0, 52.0, "e", 10.0)]
    assert page_lines(spark, blocks.merge_same_baseline, rows) == ["a b", "c", "d", "e"]


def test_algorithm_blocks_go(spark):
    rows = [(50.0, 10.0, 280.0, 22.0, PROSE, 10.0), (50.0, 30.0, 280.0, 42.0, "Algorithm 1 Sort", 10.0), (50.0, 50.0, 280.0, 62.0, "for each x", 10.0), (50.0, 120.0, 280.0, 132.0, "after the gap", 10.0)]
    assert page_lines(spark, blocks.drop_algorithms, rows) == [PROSE, "after the gap"]


def test_table_bodies_go(spark):
    above = [(50.0, 100.0, 90.0, 112.0, "Method", 10.0), (50.0, 120.0, 250.0, 132.0, PROSE, 10.0)]
    cells = [(50.0, 200.0 + 14 * i, 250.0, 212.0 + 14 * i, f"{i} 2 3 4", 10.0) for i in range(3)]
    other = (350.0, 200.0, 380.0, 212.0, "5 6 7", 10.0)
    caption = (50.0, 160.0, 250.0, 172.0, "Table 2: results", 10.0)
    assert page_lines(spark, blocks.drop_table_bodies, [*above, caption, *cells, other]) == [PROSE, "Table 2: results", "5 6 7"]
    # two strong cells below are no cluster
    assert page_lines(spark, blocks.drop_table_bodies, [caption, *cells[:2]]) == ["Table 2: results", "0 2 3 4", "1 2 3 4"]


def test_footnotes_go(spark):
    rows = [(50.0, 600.0, 280.0, 612.0, "3 apples high on the page", 8.0), (50.0, 700.0, 280.0, 710.0, "1 A note", 8.0), (50.0, 712.0, 280.0, 722.0, "goes on here", 8.0), (320.0, 705.0, 500.0, 717.0, "body of the other column", 10.0), (50.0, 760.0, 280.0, 772.0, "far below", 8.0)]
    assert page_lines(spark, blocks.drop_footnotes, rows) == ["3 apples high on the page", "body of the other column", "far below"]


def test_numbered_math_is_one_line(spark):
    rows = [(50.0, 10.0, 280.0, 22.0, PROSE, 10.0), (100.0, 60.0, 200.0, 72.0, "E = mc^2", 10.0), (150.0, 85.0, 160.0, 97.0, "k", 6.0), (500.0, 61.0, 530.0, 73.0, "( 4 )", 10.0), (500.0, 300.0, 530.0, 312.0, "(5)", 10.0)]
    assert page_lines(spark, blocks.collapse_numbered_math, rows) == [PROSE, "[MATH](4)", "(5)"]


def test_heading_and_noise(spark):
    heading = lambda c: blocks.is_heading_only(c, F.lit(1))
    assert values(spark, heading, ["2 Method", "B.2 ATARI RUNS", "Appendix of proofs", "A plain line", "2 Method."]) == [True, True, True, False, False]
    assert values(spark, blocks.is_tiny_noise, ["x y", "[MATH]", "2 Method", "abc def gh"]) == [True, False, False, False]


def test_paragraphs_go_on_over_pages(spark):
    def para(page, ord_, text, first, last, x=50.0):
        return (1, page, ord_, text, 2, text.startswith("Figure"), x, x + 250, first, x, x + 250, last, 600.0, 800.0, 12.0)

    rows = [
        para(0, 1, "An opening paragraph that ends with a hyphen contin-", 700.0, 790.0),
        para(0, 2, "Another column ends here in the middle of", 700.0, 780.0, 320.0),
        para(1, 1, "ues on the next page with more words than that.", 10.0, 60.0),
        para(1, 2, "Figure 1: something", 100.0, 110.0, 320.0),
        para(1, 3, "the right column goes on below a caption of it.", 500.0, 560.0, 320.0),
        para(1, 4, "Upper case starts anew and is left alone here", 600.0, 650.0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, ord long, text string, n_lines long, caption boolean, first_x0 double, first_x1 double, first_y0 double, last_x0 double, last_x1 double, last_y1 double, page_w double, page_h double, line_h double")
    got = blocks.merge_across_pages(df).orderBy("ord").collect()
    assert [r.text.split()[0] for r in got] == ["An", "Another", "Figure", "Upper"]
    assert got[1].text.endswith("in the middle of the right column goes on below a caption of it.")
    assert "hyphen continues on" in got[0].text and got[0].last_page == 1 and got[0].n_lines == 4


# the walk over a page, by hand


PAGE = assembly.Page(600.0, 800.0, 12.0, median_w=250.0, page_font=10.0, font=10.0)


def at(y, text, x=50.0, w=250.0, size=10.0, h=12.0, page=0):
    return assembly.Line(page, int(y), x, y, x + w, y + h, text, size)


def texts(paras):
    return [("c" if p.caption else "p") + ":" + p.text for p in paras]


def test_assembly_breaks():
    lines = [at(100, "One line of a paragraph that"), at(113, "goes on."), at(126, "New sentence close by."), at(148, "After a gap."), at(180, "far away"), at(193, "larger type here", size=14.0), at(206, "3 Results"), at(219, "text", x=320.0)]
    got = texts(assembly.assemble(lines, PAGE))
    assert got == ["p:One line of a paragraph that goes on. New sentence close by.", "p:After a gap.", "p:far away", "p:larger type here", "p:3 Results", "p:text"]


def test_headings_and_their_numbers():
    assert texts(assembly.assemble([at(100, "2", w=8.0), at(100, "Method", x=70.0, size=13.0), at(130, "body text")], PAGE)) == ["p:2 Method", "p:body text"]
    assert PAGE.is_heading(at(0, "Method", size=13.0)) and not PAGE.is_heading(at(0, "Method:", size=13.0)) and not PAGE.is_heading(at(0, "12", size=13.0))
    assert PAGE.is_heading(at(0, "4.2 Related work")) and not PAGE.is_heading(at(0, "4.2 Related work.")) and not PAGE.is_heading(at(0, "4 " + "w " * 14))


def test_columns_go_on_only_where_lines_overlap():
    left, right = at(780, "the sentence goes on without an end", w=320.0), at(40, "in the other column", x=305.0)
    assert len(assembly.assemble([left, right], PAGE)) == 1
    assert len(assembly.assemble([left, right._replace(x0=400.0)], PAGE)) == 2
    assert len(assembly.assemble([left._replace(text="An end."), right], PAGE)) == 2


def test_captions():
    label, prose = at(100, "Table 1:"), "The upper table compares all of the methods here."
    assert texts(assembly.join_captions(assembly.assemble([label, at(140, prose)], PAGE), PAGE)) == [f"c:Table 1: {prose}"]
    assert len(assembly.join_captions(assembly.assemble([label, at(200, prose)], PAGE), PAGE)) == 2
    long = assembly.Paragraph([at(100, "Figure 2: What is shown."), at(113, "in the body of the text a sentence goes on and on here")], True)
    assert [p.caption for p in assembly.split_captions([long], PAGE)] == [True, False]
    assert PAGE.is_caption(at(0, "see Table 4", x=250.0, w=100.0)) and not PAGE.is_caption(at(0, "see the Table", x=250.0, w=100.0)) and not PAGE.is_caption(at(0, "see Table 4", x=50.0, w=100.0))


def test_formulas_of_a_page():
    number = at(101, "(3)", x=520.0, w=20.0)
    paras = [assembly.Paragraph([at(100, "E = mc^2", x=100.0)]), assembly.Paragraph([number])]
    joined = assembly.join_equation_numbers(paras, PAGE)
    assert len(joined) == 1 and texts(assembly.replace_display_math(joined, PAGE)) == ["p:[MATH](3)"]
    assert len(assembly.join_equation_numbers([paras[0], assembly.Paragraph([number._replace(y0=140.0, y1=152.0)])], PAGE)) == 2
    prose = "This is a line of plain prose with many words in it"
    run = [at(113, "x = y", size=7.0), at(126, "P(i)", size=7.0)]
    assert [x.text for x in assembly.collapse_unnumbered_math([at(100, prose), *run, at(139, "and so it goes on with words to the end.")], PAGE)] == [f"{prose} [MATH]", "and so it goes on with words to the end."]
    assert [x.text for x in assembly.collapse_unnumbered_math([at(100, prose), run[0]], PAGE)] == [prose, "x = y"]


def test_table_paragraphs_go():
    row = lambda y: assembly.Paragraph([at(y, "12 3.4 56 7 8")])
    caption = assembly.Paragraph([at(400, "Table 2: results")], True)
    prose = assembly.Paragraph([at(300, "This is a line of plain prose with many words in it.")])
    above = [row(100.0 + 20 * i) for i in range(8)] + [assembly.Paragraph([at(280, "Method")])]
    assert texts(assembly.drop_table_paragraphs([*above, prose, caption], PAGE)) == [f"p:{prose.text}", "c:Table 2: results"]
    assert len(assembly.drop_table_paragraphs([*above[:7], caption], PAGE)) == 8
    below = [row(420.0 + 20 * i) for i in range(4)]
    assert len(assembly.drop_table_paragraphs([caption, *below], PAGE)) == 1 and len(assembly.drop_table_paragraphs([caption, *below[:3]], PAGE)) == 4


def test_placeholders_join_prose_once():
    prose = "This is a line of plain prose with many words in it,"
    paras = [assembly.Paragraph([at(100, prose)]), assembly.Paragraph([at(113, "[MATH](1)")]), assembly.Paragraph([at(126, "[MATH]")]), assembly.Paragraph([at(139, "Upper case begins a new sentence of many words.")])]
    assert texts(assembly.join_math(paras)) == [f"p:{prose} [MATH](1)", "p:[MATH]", "p:Upper case begins a new sentence of many words."]
    alone = [assembly.Paragraph([at(100, prose[:-1] + ".")]), assembly.Paragraph([at(400, "[MATH](1)")])]
    assert len(assembly.join_math(alone)) == 2


def test_plain_predicates_equal_the_columns(spark):
    pool = ["This is a sentence of words.", "x = y", "12 3.4 5% 6", "Figure 1: x", "a b c d e f g h i j k l m n o p", "max of Q", "∑ {} __", "", "Table III. of Things and words and more", "A. B. C. 1 2 3 4 5 6 7 8 9 10 11 12", "1,234 +5 −6 7.8"]
    for column, one in ((T.is_sentence, plain.is_sentence), (T.is_prose, plain.is_prose), (T.is_mathish, plain.is_mathish), (lambda c: F.round(T.table_score(c, percent=False), 6), lambda s: round(plain.table_score(s), 6))):
        assert values(spark, column, pool) == [one(s) for s in pool]


def test_band_takes_two_passes(spark, tmp_path):
    body = [(50.0, 100.0 + 30 * i, f"Body line number {i} of this page with words") for i in range(20)]
    notes = [(50.0, 700.0 + 12 * i, f"small note line {i} at the foot of it") for i in range(6)]
    one = page(1, body)
    one["dict"]["blocks"] += page(1, notes, 7.0)["dict"]["blocks"]
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": 1, "pages": [one]}))
    row = layout.with_metrics(layout.pages_of(layout_json.read_layout(spark, str(tmp_path / "a.json")))).first()
    assert (row.font, row.line_h, row.page_font, row.band_h) == (10.0, 12.0, 10.0, 12.0)
    ys = [y for _, y, _ in body]
    assert row.top == pytest.approx(ys[0] + (ys[1] - ys[0]) * 0.06 * 19 - 24) and row.bottom == pytest.approx(ys[-2] + 12 + 30 * (0.94 * 19 - 18 + 0.0) + 24, abs=1e-6)


# the library


def held(spark):
    words = "plain words of a paragraph that is long enough to be kept by all of the filters"
    lines = [(50.0, 100.0 + 40 * i, f"Paragraph number {i} has {words}.") for i in range(4)]
    layout_ = spark.createDataFrame([json.dumps({"doc_id": d, "pages": [page(1, lines)]}) for d in (11, 12)], "string").select(F.from_json("value", layout.SCHEMA).alias("x")).select("x.*")
    items = spark.createDataFrame([(1, 1, ["to-translate"], "One"), (2, 1, ["to-translate", "x"], "Two"), (3, 1, ["to-translate"], "Three"), (4, 1, ["other"], "Four")], "key long, version int, tags array<string>, title string")
    files = spark.createDataFrame([(11, 1, 0, "application/pdf"), (12, 2, 1, "Application/PDF"), (13, 2, 0, "text/html")], "key long, parent long, ord int, content_type string")
    none = spark.createDataFrame([], "key long, pdf long, version int, data map<string,string>, tags array<string>")
    return commands.Library(items, files, layout_, none)


def test_base_run_creates_marks_and_repeats_to_nothing(spark):
    library_, settings = held(spark), Settings()
    done = commands.base(library_, settings)
    made = done.payloads.collect()
    assert len(made) == 8 and all(p.annotationType == "note" and p.tags[1].tag == "za:translate" for p in made)
    summary = {r.item: r for r in done.summary.collect()}
    assert (summary[1].total, summary[1].planned, summary[1].skipped_reason) == (4, 4, None) and summary[3].skipped_reason == "no_pdf"
    assert {r.key: r.tags for r in done.items.collect()} == {1: ["base-done"], 2: ["base-done", "x"], 3: ["to-translate"], 4: ["other"]}
    stored = done.payloads.select((F.col("doc_id") * 10 + F.col("ord")).alias("key"), F.col("doc_id").alias("pdf"), F.lit(1).alias("version"), F.create_map(*[x for n in (A.SORT, A.LABEL, A.PLACE, A.COMMENT) for x in (F.lit(n), F.col(n))]).alias("data"), F.transform("tags", lambda t: t["tag"]).alias("tags"))
    library_.annotations = spark.createDataFrame(stored.collect(), stored.schema)
    assert commands.base(library_, settings).payloads.count() == 0
    audit = commands.audit_annotations(library_, settings).collect()
    assert {(r.doc_id, r.missing_filtered, r.missing_all, r.annotations, r.invalid_position) for r in audit} == {(11, 0, 0, 4, 0), (12, 0, 0, 4, 0)}
    library_.items = spark.createDataFrame(done.items.collect(), done.items.schema)
    after, items, counts = commands.translate(library_, Settings(provider="upper"))
    assert {r.data[A.COMMENT].isupper() for r in after.collect()} == {True} and {tuple(r.tags) for r in after.select(F.filter("tags", lambda t: t.startswith("za:")).alias("tags")).collect()} == {("za:translated",)}
    assert {r.key: r.tags for r in items.collect()}[1] == ["translated"] and {r.updated for r in counts.collect()} == {4}
    assert commands.probe(library_, settings, spark.createDataFrame([(11,), (12,)], "doc_id long"), 2).select("status").distinct().collect()[0][0] == "duplicate"


def test_translated_run_voids_items_that_fail(spark):
    def service(_url, _headers, body, _timeout):
        text = json.loads(body)["messages"][1]["content"]
        assert "Context (previous):" in text
        if "TARGET:\nParagraph number 2" in text:
            return 401, "{}"
        return 200, json.dumps({"choices": [{"message": {"content": "Translation: done"}}]})

    settings = Settings(provider="openai", chat_key="k", chat_model="m")
    done = commands.run(held(spark), settings, item_keys=["2"], transport=service)
    assert done.payloads.count() == 0
    row = done.summary.first()
    assert (row.item, row.skipped_reason) == (2, "translation_failed")
    ok = commands.run(held(spark), settings, item_keys=["2"], transport=lambda *_: (200, json.dumps({"choices": [{"message": {"content": "done"}}]})))
    assert ok.payloads.count() == 4 and all(r[A.COMMENT].startswith("done\n\nSRC: ") for r in ok.payloads.collect())
    assert {r.key: r.tags for r in ok.items.collect()}[2] == ["translated", "x"]


def test_repair_and_deletes(spark):
    library_, settings = held(spark), Settings()
    rows = commands.paragraphs(library_, settings).where("doc_id = 11").orderBy("ord").collect()
    tags = [[f"para:{rows[0].hash}"], ["para:" + "0" * 40], [], [f"para:{rows[1].hash}"]]
    whole = {A.SORT: "s", A.LABEL: "1", A.PLACE: "{}"}
    data = [{}, {}, {}, whole]
    library_.annotations = spark.createDataFrame([(i, 11, 1, d, t) for i, (d, t) in enumerate(zip(data, tags, strict=True))], "key long, pdf long, version int, data map<string,string>, tags array<string>")
    after, counts = commands.repair_annotations(library_, settings)
    assert counts.first().asDict() == {"pdf": 11, "repaired": 1, "unmatched": 1, "untagged": 1, "sound": 1}
    assert {r.key: r.data.get(A.LABEL) for r in after.collect()} == {0: "1", 1: None, 2: None, 3: "1"}
    assert sorted(r.key for r in commands.delete_broken_annotations(library_)[0].collect()) == [3]
    assert commands.delete_broken_annotations(library_, read_only=True)[0].count() == 4
    assert commands.delete_all_annotations(library_, library_.annotations.select("pdf"))[0].count() == 0


def test_search_preview_dumps(spark, tmp_path):
    library_, settings = held(spark), Settings()
    assert [r.key for r in commands.search(library_, settings, ["x", "other"]).orderBy("n").collect()] == [2, 4]
    asked = spark.createDataFrame([(11,)], "doc_id long")
    assert commands.preview(library_, settings, asked, 2).count() == 2
    texts_, totals = commands.dump_page_texts(library_)
    assert totals.where("doc_id = 11").first().pages == 1 and texts_.first().chars == len(texts_.first().text)
    commands.dump_xml(library_, settings, asked, str(tmp_path / "x"))
    xml = "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    assert xml.count("<paragraph ") == 4 and "<bbox " in xml and "<pages>1</pages>" in xml
    commands.dump_layout(library_, str(tmp_path / "d"))
    assert layout_json.read_layout(spark, str(tmp_path / "d")).count() == 2
    assert commands.probe_translation(library_, Settings(provider="upper"), asked, 1).first().status == "ok"
    with pytest.raises(ValueError):
        commands.validated("t", ["k"])
    with pytest.raises(ValueError):
        commands.validated(delete_broken=True, keep_broken=True)


def test_settings_by_name(tmp_path):
    (tmp_path / "env").write_text('# c\nPARA_MIN_CHARS=10\nexport para_skip_captions = "true"\nUNKNOWN=1\nPARA_MIN_MEDIAN_COORD_H=7.5\n')
    found = load(str(tmp_path / "env"), {"para_min_chars": "20"})
    assert (found.min_chars, found.skip_captions, found.min_font) == (20, True, 7.5)
    with pytest.raises(ValueError):
        load(environ={"PARA_MIN_CHARS": "5000"})
    with pytest.raises(ValueError):
        load(environ={"Z_ID": "..."})
    with pytest.raises(RuntimeError):
        providers.provider(Settings(provider="deepl"))


def test_answers_and_errors_of_services():
    ok = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    assert providers.message_text(ok("a")) == "a" and providers.message_text(ok([{"text": "a"}, {"text": "b"}, 3])) == "ab"
    for bad in (ok(None), "[]", "{", json.dumps({"choices": []})):
        with pytest.raises(layout_json.ProviderError):
            providers.message_text(bad)
    assert plain.error_kind(400, providers.error_detail(json.dumps({"error": {"message": "x", "code": "insufficient_quota"}}))) == "quota"
    assert [plain.error_kind(s, "", "deepl") for s in (401, 429, 456, 500)] == ["auth", "rate_limit", "quota", "temporary"]


def test_filters_of_the_chain(spark):
    rows = [(1, 0, "Figure 1: a caption of many words that is long enough to be kept by the length.", True, 10.0), (1, 1, "A paragraph of many words that is long enough to be kept by all the filters.", False, 10.0), (1, 2, "Small print of many words that is long enough to be kept by all the filters.", False, 5.0), (1, 3, "short", False, 10.0), (1, 4, "[3] An entry of many words that is long enough to be kept by all the filters.", False, 10.0), (1, 5, "References", False, 12.0), (1, 6, "What follows of many words that is long enough to be kept by all the filters.", False, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, text string, caption boolean, median_font double")
    df = df.withColumn("pages", F.array(F.lit(2))).withColumn("bboxes", F.array(F.struct(F.lit(2).alias("page"), *[F.lit(float(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))).withColumn("anchor", F.lit(None).cast("struct<page:int,x0:double,y0:double,x1:double,y1:double>"))
    kept = adapter.kept_paragraphs(df).orderBy("ord").collect()
    assert [r.ord for r in kept] == [0, 1] and kept[0].coords[0].w == 2.0 and kept[0].page == 2
    assert [r.ord for r in adapter.filtered_paragraphs(df, Settings(skip_captions=True, skip_references=False, min_font=0.0)).orderBy("ord").collect()] == [1, 2, 4, 6]


def test_versions_guard_writes(spark):
    items = spark.createDataFrame([(1, 3, {"a": "x", "b": "y"}), (2, 4, {"a": "x"})], "key long, version int, data map<string,string>")
    changes = spark.createDataFrame([(1, 3, {"a": "z"}), (2, 1, {"a": "z"}), (9, None, {"a": "z"})], "key long, expected int, data map<string,string>")
    after, status = library.updated(items, changes)
    assert {r.key: (r.version, r.data) for r in after.collect()} == {1: (4, {"b": "y", "a": "z"}), 2: (4, {"a": "x"})}
    assert {r.key: r.status for r in status.collect()} == {1: "updated", 2: "conflict", 9: "missing"}
