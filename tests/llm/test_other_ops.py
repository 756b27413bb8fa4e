"""Operators on vectors and pages, and the pipeline, against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from shiftgrid.llm import html, topk, vecdup
from shiftgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def odd_vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 6))
    rows = [(i, [float(x) for x in np.float32(base[i % 8] + 0.2 * rng.normal(size=6))], i) for i in range(300)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(40)]  # copies
    rows += [(2000, None, 1), (2001, [], 1), (2100, [0.0] * 6, 1), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2200, [math.nan] * 6, 1), (2005, [math.inf] + [0.0] * 5, 1)]
    rows += [(7, rows[7][1], 1), (None, rows[3][1], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [x * 4 for x in rows[9][1]], 1)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as score", "2 as rank", "3 as kept", "4 as y")


def usable(e):
    return e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e)


def brute_top(rows, k=10):
    rows = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if usable(e) and i is not None]
    best = {}
    for i, q in rows:
        if i % 100 == 0:
            best[i] = min(best.get(i, q), q)
    out = []
    for i, q in best.items():
        s = sorted((-min(max(sum(a * b for a, b in zip(q, c, strict=False)), -(2**63)), 2**63 - 1), j) for j, c in rows if j != i)
        out += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s[:k])]
    return sorted(out)


def test_top_k(spark, vectors, monkeypatch):
    want = brute_top([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == want
    for name, value in (("BLOCK", 16), ("BLOCKS", 2), ("QUERIES", 3), ("ROWS", 2)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == want
    assert topk.top_k(vectors.limit(0)).count() == 0
    few = vectors.where("vec_id in (0, 3)")
    assert [tuple(r)[:3] for r in topk.top_k(few).collect()] == [(0, 1, 3)]
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(map(tuple, QUERIES["op2_topk"](spark, SF).collect())) == brute_top([(r.vec_id, r.embedding) for r in emb.collect()])


def brute_links(rows, least=0.95):
    n = len(rows)
    ok = [usable(e) and any(e) and i is not None for i, e in rows]
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if o else None for o, (_, e) in zip(ok, rows, strict=True)]
    near = [[] for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                near[a].append(b)
                near[b].append(a)
    comp = [-1] * n
    for s in range(n):
        if comp[s] < 0:
            todo = [s]
            comp[s] = s
            while todo:
                for v in near[todo.pop()]:
                    if comp[v] < 0:
                        comp[v] = s
                        todo.append(v)
    least_id = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[comp[k]] = i if least_id[comp[k]] is None else min(i, least_id[comp[k]])
    return sorted(((i, len(near[k]), least_id[comp[k]], None if i is None else i == least_id[comp[k]]) for k, (i, _) in enumerate(rows)), key=str)


def test_vector_dedup(spark, vectors):
    want = brute_links([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert sorted(map(tuple, vecdup.near_duplicates(vectors).collect()), key=str) == want
    assert sorted(map(tuple, vecdup.near_duplicates(vectors, steps=(2, 4), tile=48 * 24, block=16).collect()), key=str) == want
    assert vecdup.near_duplicates(vectors.limit(0)).count() == 0
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op7_vector_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == brute_links([(r.vec_id, r.embedding) for r in emb.collect()])


def test_top_k_of_any_size(spark, monkeypatch):
    """Products beyond 2 ** 53, where doubles lose units, and beyond a long; components up to 1e30 and 1e300."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=5) * 10 ** rng.integers(0, 5)]) for i in range(300)]
    rows += [(300 + i, [float(x) for x in 1e5 + rng.integers(0, 3, 5) / 1024]) for i in range(60)]  # near ties above 2 ** 53
    rows += [(400, [1e30, 0.0, 0.0, 0.0, 1.0]), (401, [-1e30, 1e300, 0.0, 0.0, 0.0]), (500, [1e300, 1e300, -1e300, 0.0, 3.0]), (402, [1e308, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_top([r for r in rows if r[0] != 402])  # 1024 times that is no double
    assert sorted(map(tuple, topk.top_k(df).collect())) == want
    assert any(2**53 < w[3] < 2**63 - 1 for w in want) and any(w[3] == 2**63 - 1 for w in want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h2>Site name</h2><nav><ul><li><a href="/a">Home</a></li><li><a href='/b'>About us</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies. Accept them all, please do.</div><!-- <p>no</p> -->
<article><header><h1>The  title &amp; more</h1></header><p>First para<b>graph</b> is here, with\n<i>two</i> lines.<br>And a break.<p>Second &lt;one&gt; &#233;t&eacute;.
<ul><li>Point one is here.</li><li>Point two is there.</li></ul><form><label>Mail</label><input name=x><button>Send</button></form>
<div class="comments"><h3>Comments</h3><div class="comment"><p>Nice post, thank you for it.</p></div></div></article>
<aside class="sidebar"><h3>Related</h3><p>Other things that you may read. They are good.</p></aside>
<div class="ad">Buy this now. It is cheap.</div><footer>&copy; 2024 somebody. All rights.</footer></body></html>"""


def test_html_page(spark):
    weights = html.fit([PAGE] * 3)
    text = html.main_text(PAGE, weights)
    assert text == "The title & more First paragraph is here, with two lines. And a break. Second <one> été. Point one is here. Point two is there."
    plain = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div id=main><p>" + "This is a long sentence of content. " * 5 + "</p><p>And more of it, said well.</p></div>"
    assert html.main_text(plain, weights).startswith("This is a long") and "One" not in html.main_text(plain, weights)


def test_html_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" * 3000 + "deep"), (4, "x", "<div " + "a" * 50000), (5, "y", "no markup. At all, just a few words of text.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html.extract(df).collect()
    assert sorted(((r.page_id, r.url) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    assert all(r.n_chars == len(r.text) for r in got) and html.extract(df.limit(0)).count() == 0
    pages = QUERIES["op8_html"](spark, SF)
    assert pages.columns == ["page_id", "url", "text", "n_chars"]
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in pages.collect():
        body = sources[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text == " ".join(b.text for b in html.blocks(body))


def test_cut_is_the_optimum():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 8)
        gain = np.array([rng.uniform(-3, 3) for _ in range(n)])
        edges = [(i, j, rng.uniform(0, 3)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda x: -sum(g for g, v in zip(gain, x, strict=True) if v) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.cut(gain, edges)) - best) < 1e-6


def test_pipeline(spark):
    import corpus_pipeline as c
    from tests.llm.test_text_ops import brute_kept

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = c.quality_stage(spark, docs, SF)
    kept_ids = {r.doc_id for r in good.collect()}
    assert good.columns == list(c.COLUMNS) and len(kept_ids) < docs.count()
    least = set(brute_kept([(r.doc_id, r.text) for r in good.collect()])[0].values())
    one = c.written(c.near_dedup_stage(spark, c.written(good, "t"), SF), "t")
    kept = {r.doc_id for r in one.collect()}
    assert least <= kept and len(kept) <= 1.02 * len(least)
    out = c.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= kept
    counts = defaultdict(int)
    for r in out:
        counts[r.doc_id] += 1
    assert max(counts.values()) <= 2
    private = {r.doc_id: r.text for r in c.pii_stage(spark, one, SF).collect()}
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(private[r.doc_id].encode()).hexdigest()
    assert [s for s, _ in c.STAGES] == ["quality", "near_dedup", "pii", "mixing", "tokens"]


def test_pairs_in_waves(spark, monkeypatch):
    """More pairs of tiles, or of query blocks and shares, than meet at a time: the same results."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(120, 16))
    rows = [(i, (base[i % 120] + rng.normal(size=16) * 0.05).astype(float).tolist()) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = sorted(map(tuple, vecdup.near_duplicates(vectors, tile=16 * 8 * 40, block=16).collect()))
    top = sorted(map(tuple, topk.top_k(vectors).collect()))
    monkeypatch.setattr(vecdup, "MOST_TASKS", 3)
    monkeypatch.setattr(topk, "MOST_TASKS", 2)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "BLOCKS", 2)
    assert sorted(map(tuple, vecdup.near_duplicates(vectors, tile=16 * 8 * 40, block=16).collect())) == near and len(near) == 600
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == top and len(top) == 60
