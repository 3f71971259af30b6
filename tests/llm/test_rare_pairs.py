"""Pairs of words of any rarity are in the vocabulary of op3: every loss of the query by plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from foliospark.llm import lm_score

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def plain(rows, is_target):
    """A function of a text: the loss by both models, and how many pairs the vocabulary has."""
    tables = []
    for mine in (False, True):
        words, pairs, grams = collections.Counter(), collections.Counter(), [collections.Counter() for _ in range(3)]
        for i, text in rows:
            if mine and not is_target(i):
                continue
            found = lowered(text)
            words.update(found)
            pairs.update(zip(found, found[1:], strict=False))
            raw = b"   " + (text or "").encode()
            for k in range(3, len(raw)):
                for table, key in zip(grams, (raw[k - 3 : k + 1], raw[k - 3 : k], raw[k - 1 : k + 1]), strict=True):
                    table[key] += 1
        tables.append((words, pairs, grams))
    target = tables[1]
    kept = {p for p, n in target[1].items() if n >= 2}
    totals = [sum(t[0].values()) for t in tables]
    scale = sum(tables[1][2][2].values()) / sum(tables[0][2][2].values())

    def loss(text, k):
        words, pairs, (four, head, pair) = tables[k]
        factor = 1 if k else scale
        spelled_share = 1 - 0.5 * sum(n for w, n in words.items() if target[0][w] >= 2) / totals[k]
        raw, out, before = b"   " + (text or "").encode(), 0.0, None
        for m in WORD.finditer(raw):
            w, spelled = m.group().lower(), spelled_share
            for i in range(m.start(), min(m.end() + 1, len(raw))):
                row = sum(n for key, n in pair.items() if key[0] == raw[i - 1]) * factor
                low = (pair[raw[i - 1 : i + 1]] * factor + 0.5) / (row + 128)
                spelled *= min(1.0, (four[raw[i - 3 : i + 1]] * factor + 20 * low) / (head[raw[i - 3 : i]] * factor + 20))
            alone = spelled + (0.5 * words[w] / totals[k] if target[0][w] >= 2 else 0)
            share = 0.5 * pairs[before, w] / words[before] if (before, w) in kept else 0
            left = 1 - sum(pairs[p] / words[before] for p in kept if p[0] == before)
            out -= np.log(share + ((0.5 + 0.5 * max(0, left)) if before else 1) * alone)
            before = w
        return out

    return loss, len(kept)


@pytest.mark.parametrize(("heavy", "heavy_pairs", "all_bits"), [(120, 100, False), (120, 100, True), (1, 0, False), (1 << 20, 1 << 19, True)])
def test_op3_takes_rare_pairs(spark, monkeypatch, tmp_path, heavy, heavy_pairs, all_bits):
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    monkeypatch.setattr(lm_score, "HEAVY_PAIRS", heavy_pairs)
    if all_bits:  # a table that rules nothing out
        monkeypatch.setattr(lm_score, "_bit_table", lambda keys: np.full(512, 255, np.uint8))
    rng = random.Random(7)
    known = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choices(known, [60 / (k + 1) for k in range(40)], k=rng.randrange(1, 40)))) for i in range(90)]
    rows += [(i, "some rare pair w39 w38 once w0") for i in range(90, 100)] + [(100, None), (101, ""), (102, "naïve W0 w1 unheard w39 W38"), (103, "often seen " * 9)]
    targets = {i for i, _ in rows if i % 3 == 0 and zlib.crc32(str(i).encode()) % 4 != 2}
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in lm_score.op3_lm_score(spark, str(tmp_path)).collect()}
    loss, n_pairs = plain(rows, targets.__contains__)
    assert n_pairs > 30 and len(got) == len(rows)
    for i, text in rows:
        n = len(lowered(text))
        assert got[i].n_tokens == n
        for k, c in ((0, "ce_background"), (1, "ce_target")):
            assert got[i][c] == pytest.approx(loss(text, k) / max(1, n), rel=1e-4, abs=1e-6)
