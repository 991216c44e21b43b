"""Postings against counting by hand: texts outside the first plane, short and absent ones, repeated ids."""

from collections import Counter

import numpy as np

from foliary.operators import search

TEXTS = [(1, "Banana BANANA"), (2, "ab"), (3, None), (4, "𝒜𝒜𝒜𝒜 漢字漢字"), (5, "aaa\x00\x00\x00"), (6, "é" * 5), (None, "null id")]


def counted(rows):
    want = Counter()
    for i, text in rows:
        low = (text or "").lower()
        for k in range(len(low) - 2):
            want[low[k : k + 3], i, len(low) - 2] += 1
    return want


def test_postings_are_those_counted_by_hand(spark, monkeypatch):
    for chars in (search.CHARS, 4):
        monkeypatch.setattr(search, "CHARS", chars)
        for rows in (TEXTS, [*TEXTS, (1, "banana banana"), (1, "other")]):
            found = search.postings(spark.createDataFrame(rows, "k long, t string"), "k", "t")
            assert found.columns == ["gram", "id", "doc_len", "tf"] and dict(found.dtypes)["tf"] == "bigint"
            got = {(r["gram"], r["id"], r["doc_len"]): r["tf"] for r in found.collect()}
            assert got == counted(rows) and found.count() == len(got)


def test_distinct_ids_need_no_shuffle_of_grams(spark):
    found = search.postings(spark.createDataFrame(TEXTS, "k long, t string"), "k", "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_alphabet_too_large_for_one_key_goes_text_by_text():
    points = np.arange(0xE000, 0xE000 + 900_000).astype("<u4")
    points = np.concatenate([points, points[:900_000]])
    sizes = np.full(100, 18_000)
    found = [(t, g, n) for t, g, n in search._counted(points, sizes)]
    assert sum(int(n.sum()) for _, _, n in found) == 100 * 17_998
    assert found[7][0][0] == 7 and found[7][1][0].tolist() == points[7 * 18_000 : 7 * 18_000 + 3].tolist()
