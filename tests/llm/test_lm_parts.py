"""What op3 sends from texts to facts and back: packed, in blocks and parts of any size, and exact however long the texts before are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import lm_score


def test_op3_packs_what_it_sends():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    keys[100:200] = keys[100]
    columns = [keys, rng.integers(0, 1 << 13, 5000).astype(np.uint16), *[rng.normal(-20, 5, 5000).astype(np.float32) for _ in range(2)]]
    packed = lm_score._packed(lm_score.PAIR, columns)
    assert len(packed) < 18 * 5000  # rows of a join took 23 bytes each, compressed
    assert all((a == b).all() for a, b in zip(columns, lm_score._columns(lm_score.PAIR, packed), strict=True))
    ids = [np.array([7, 0], np.uint16), np.array([-5, 0]), np.array([True, False]), np.array([3, 0]), np.array([1.5, 0.0]), np.array([np.pi, 0.0])]
    assert [x.tolist() for x in lm_score._columns(lm_score.DOCUMENTS, lm_score._packed(lm_score.DOCUMENTS, ids))] == [x.tolist() for x in ids]


def fitted(spark, rows, rare_pairs=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return docs, lm_score.models(docs.select("text", (F.col("doc_id") % 2 == 0).alias("is_target")), rare_pairs=rare_pairs)


@pytest.mark.parametrize("rare_pairs", [True, False])
def test_op3_blocks_and_parts_of_any_size(spark, monkeypatch, rare_pairs):
    monkeypatch.setattr(lm_score, "HEAVY", 50)
    monkeypatch.setattr(lm_score, "HEAVY_PAIRS", 40)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["a", "bb", "Ccc", "dd,", "é"], [9, 5, 2, 1, 1], k=rng.randrange(12)))) for k in range(60)] + [(None, "bb a bb"), (60, None)]
    docs, found = fitted(spark, rows, rare_pairs)
    whole = lm_score.scored(docs, found).toPandas().sort_values("doc_id").reset_index(drop=True)
    for name, value in (("BLOCK", 4), ("HELD", 3), ("PART_WORDS", 8)):
        monkeypatch.setattr(lm_score, name, value)
    small = lm_score.scored(docs, found).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert len(small) == len(rows) and small["doc_id"].isna().sum() == 1
    for c in small:
        assert np.allclose(small[c].fillna(-1), whole[c].fillna(-1), rtol=1e-6, atol=1e-6)


def test_op3_losses_do_not_depend_on_texts_before(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(40_000))
    rows = [(0, long), *[(k, f"word {k} of a short text qzx") for k in range(1, 9)]]
    docs, found = fitted(spark, rows)
    after = {r.doc_id: r.ce_target for r in lm_score.scored(docs, found).collect()}
    alone = {r.doc_id: r.ce_target for r in lm_score.scored(docs.where("doc_id > 0"), found).collect()}
    assert all(after[k] == pytest.approx(alone[k], rel=1e-6) for k in alone)
