"""License scans: every template whole and edited; notices of a family keep apart."""

import random

import pytest

from shiftgrid.llm import license


def edited(words, rng):
    """One word put in; of 24 words and more one changed too; of 40 and more one left out, in places well apart."""
    n = len(words)
    out = list(words)
    if n >= 24:
        out[n - 3] = "changed"
    if n >= 14:
        out.insert(n // 2, "inserted")
    if n >= 40:
        del out[2]
    return out


def test_every_template(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for label, text in license.TEMPLATES.items():
        for whole in (True, False):
            words = text.split() if whole else edited(text.split(), rng)
            rows.append((len(rows), "Some words before. " + " ".join(words).upper() + " and some words after."))
            want[len(rows) - 1] = label
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in want.items():
        assert label in got[k].labels.split(","), (k, label, got[k])
        assert set(got[k].labels.split(",")) - set(got[k].base_labels.split(",")) <= {label}, got[k]


@pytest.mark.parametrize("family", ["lgpl", "lgpl-3", "agpl", "agpl-3"])
def test_family_is_not_gpl(spark, family):
    rng = random.Random(3)
    texts = [license.TEMPLATES[family], " ".join(edited(license.TEMPLATES[family].split(), rng)), license.TEMPLATES[family] + " " + license.TEMPLATES["gpl"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license.scan(rows).collect()}
    assert got[0] == family and got[1] == family and got[2] == ",".join(sorted({family, "gpl"}))


def test_order_counts(spark):
    """The same k-grams in another order, or one of them many times, are no notice."""
    words = license.TEMPLATES["mit"].split()
    grams = [" ".join(words[i : i + 3]) for i in range(0, len(words) - 2, 3)]
    rows = [(0, " x ".join(reversed(grams))), (1, ("permission is hereby granted " * 40)), (2, " ".join(words))]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "" and got[1].labels == "" and got[2].labels == "mit" and got[2].score == 1.0 and got[0].score < 0.7
