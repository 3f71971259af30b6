"""The stages one after the other, each held against what it has to do with its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from foliospark.llm import common

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def test_stages(spark):
    docs = common.documents(spark, DIR)
    columns, seen = docs.columns, [("documents", docs)]
    for name, stage in cp.STAGES:
        docs = common.written(stage(spark, docs, DIR), "stage")
        seen.append((name, docs))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in seen[:-1]}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    gone = {i for i, _ in rows["documents"]} - {i for i, _ in rows["toxicity"]}
    assert all(labels.get(i, 1) for i in gone)
    assert sum(labels.get(i, 0) == 0 for i, _ in rows["toxicity"]) > 0.8 * len(rows["toxicity"])
    assert all(t for _, t in rows["line_dedup"])
    sets = [grams(t) for _, t in rows["ngram_jaccard_join"]]
    for a, x in enumerate(sets):
        for y in sets[:a]:
            both = len(x & y)
            assert not both or 100 * both < 85 * (len(x) + len(y) - both)
    ids = [i for i, _ in rows["mixing"]]
    assert set(ids) <= {i for i, _ in rows["ngram_jaccard_join"]} and max(map(ids.count, ids)) <= 2
    tokens = seen[-1][1].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in tokens} == set(ids)


def test_near_copies_by_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(100)]
    changed = lambda at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(1, changed(())), (2, changed((30, 60))), (3, changed((20, 50, 80))), (4, "a b c"), (5, "A b c"), (6, "a b d"), (7, "")]
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    # here no chain of links matters: a row goes where one with a lesser id is similar
    plain = [i for i in sets if not any(j < i and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.without_near_copies(spark, docs, DIR).collect()) == plain == [1, 3, 4, 6, 7]


def test_stages_keep_clashing_columns(spark):
    extra = ["score", "predicted", "n_hits", "n_deleted", "n_lines", "_id", "_hash", "_copy", "row", "hash", "copies", "s", "cut"]
    docs = common.documents(spark, DIR).withColumns({n: F.col("doc_id") for n in extra})
    for _, stage in cp.STAGES[:-1]:
        columns, docs = docs.columns, common.written(stage(spark, docs, DIR), "stage")
        assert docs.columns == columns
    assert all(r[n] == r.doc_id for r in docs.collect() for n in extra)


def test_run_and_registration(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert cp.run(spark, DIR).count()


def test_tables_without_rows(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
