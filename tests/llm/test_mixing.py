"""Mixing: targets met closely although some documents are large, expectations kept, rows of one item dealt evenly."""

from collections import defaultdict

import numpy as np

from shiftgrid.llm import mixing, util


def taken_of(rows):
    got, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        got[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    return got, target, largest


def test_large_documents_settle_first(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for s, n in (("a", 120), ("b", 400), ("c", 60), ("d", 1500), (None, 200)):
        sizes = np.minimum(4000, (rng.pareto(1.1, n) * 20 + 1).astype(int))
        for k in sizes:
            rows.append((i, "w " * int(k), s))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, target, largest = taken_of(mixing.mix(df).collect())
    assert max(largest[s] / target[s] for s in got) > 0.05
    off = {s: abs(got[s] - target[s]) / target[s] for s in got}
    assert max(off.values()) < 0.01, off


def test_expectation_of_a_document(spark):
    """Over 150 sources alike, large and small documents come as often as their source's target over its size says."""
    rows = [(1000 * k + i, "w " * (40 if i < 2 else 1 + i % 9), f"s{k}") for k in range(150) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    large, small = [], []
    for r in mixing.mix(df, weights=(1,), volume=1.3).collect():
        (large if r["size"] == 40 else small).append(r.copies)
    assert abs(np.mean(large) - 1.3) < 4 * 0.46 / np.sqrt(len(large)) and abs(np.mean(small) - 1.3) < 0.03


def test_one_document_of_one_source(spark):
    df = spark.createDataFrame([(1, "w " * 50, "a"), (2, "w " * 7, "b"), (3, "w", "c")], "doc_id long, text string, source string")
    for r in mixing.mix(df).collect():
        assert r.taken in (0, r["size"], 2 * r["size"]) and abs(r.taken - r.target) < r["size"]


def test_rows_of_one_item_are_dealt_in_turn(spark, monkeypatch):
    """Rows as one in id, source and text, numbered in groups: their copies differ by one at most and add up."""
    monkeypatch.setattr(util, "CHUNK", 50)
    rows = [(7, "same words", "a", k) for k in range(700)] + [(None, "no id", None, 1000 + k) for k in range(130)] + [(9 + k, "other words here", "b", 2000 + k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag long")
    mixed = mixing.mix(df)
    want = {(r.doc_id, r.source): r.n for r in mixed.groupBy("doc_id", "source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    per = defaultdict(lambda: defaultdict(int))
    for r in mixing.sample(df).collect():
        per[r.doc_id, r.source][r.tag] += 1
    assert {k: sum(v.values()) for k, v in per.items()} == {k: n for k, n in want.items() if n}
    for key, n in ((7, "a"), 700), ((None, None), 130):
        counts = [per[key].get(t, 0) for t in (range(700) if n == 700 else range(1000, 1130))]
        assert max(counts) - min(counts) <= 1
