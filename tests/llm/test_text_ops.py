"""Operators on documents against brute force, over fixtures with nulls, copies, ties and long texts."""

import hashlib
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest
import xxhash

from shiftgrid.llm import bpe, license, mixing, pii, quality, sharding, simhash
from shiftgrid.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    long = "alpha beta gamma delta " * 4000
    texts = [
        None, "", " ", "\n\t", "one", "it's we'll 'tis  two\n\n three 123 4.5 été \U0001f600  x", "Don't!!! 'sabc 's's ''s x's  ' s", long, long, long + "x",
        "under the MIT license, and Under the mit LICENSE; cc by nc", "Apache License, Version 2 apache license version 2", "call +1 (212) 555-1234 or a.b@c.de.fr or 4111 1111 1111 1111 at 10.0.0.256 10.0.0.25",
        "tel (212) 555-9876 now; 1.2.3.4.5.6.7.8 a@b.c_d@e.f", "mail john.doe [at] example [dot] com please", "same words here now", "same words here now", "same words here now", "x" * 30000, "9" * 5000, "@" * 3000, "1." * 4000,
        "İßﬃ   a　b",
    ]
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "null id text one two", None, None, None), (None, "null id text one two", "en", "s0", 3), (3, "\n\t", "en", "s0", 2)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), KINDS)
    return df.selectExpr("*", "'x' as score", "1 as size", "2 as fp", "3 as row", "4 as key", "5 as spans")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_is_the_library(spark, odd, docs):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary(), "rb") as f:
        ranks = bpe.ranks_of(f.read())
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r[0]].append(enc.encode_ordinary(r[1] or ""))
        for r in bpe.encode(df, vocabulary()).collect():
            assert r.ids in texts[r.doc_id]
            assert bytes(r.decoded) == enc.decode_bytes(r.ids) and r.offsets[-1] == len(r.decoded) and len(r.offsets) == len(r.ids) + 1
        for r in bpe.encode(df, vocabulary(), digest=True).collect():
            assert r.ids_sha256 in [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in texts[r.doc_id]]
            assert r.decoded_sha256 in [hashlib.sha256(enc.decode_bytes(i)).hexdigest() for i in texts[r.doc_id]]


def test_bpe_boundaries_of_drawn_texts():
    import random

    import numpy as np
    import regex
    from public_tokenizers import PATTERN

    codec = bpe._codec(vocabulary())
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 'stmrevld \n\t19!é  .") for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    assert codec.pieces(texts) == [regex.findall(PATTERN, t) for t in texts]
    s = np.array([rng.randrange(9) for _ in range(5000)], np.uint8)
    state, want = 0, []
    for x in s:
        want.append(state)
        state = int(bpe.STEP[x, state])
    assert bpe.scan(s, width=64).tolist() == want


def brute_print(text, width):
    w = (text or "").encode().lower().split()
    k = min(width, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_classes(prints, radius):
    """(id, fp) pairs to the smallest non-null id of each fp's component."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


def test_simhash_is_brute_force(odd, docs):
    for df in (odd, docs):
        got = simhash.near_duplicates(df).select("doc_id", simhash.hex_of(), "component_id").collect()
        prints = [(r.doc_id, brute_print(r.text, 4)) for r in df.collect()]
        comp = brute_classes(prints, 4)
        assert sorted(got, key=str) == sorted([(i, f"{f:016x}", comp[f]) for i, f in prints], key=str)


def test_simhash_tiles_and_masks(spark, monkeypatch):
    import random

    masks = [m & (2**64 - 1) for m in simhash.covering_masks(4)]
    rng = random.Random(2)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(not diff & m for m in masks)
    monkeypatch.setattr(simhash, "TILE", 5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(40)}
    rows = list(enumerate(fps))
    got = simhash.classes(spark.createDataFrame([(i, f.to_bytes(8)) for i, f in rows], "doc_id long, fp binary")).collect()
    assert {int.from_bytes(r.fp): r.component_id for r in got} == brute_classes(rows, 4)


def brute_kept(rows):
    """Ids that stay of (id, text): the smallest of each component by distances of wide fingerprints; and the pairs of shingle sets."""
    shingles = {i: simhash.shingle_hashes(t, 5) for i, t in rows}
    prints = [(i, int.from_bytes(simhash.fingerprint(h, simhash.WIDE_WORDS))) for i, h in shingles.items()]
    comp = brute_classes(prints, simhash.distance_of(0.775, 64 * simhash.WIDE_WORDS))
    return {i: comp[f] for i, f in prints}, {i: set(h) for i, h in shingles.items()}


def test_keep_one(spark, odd, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, sets = brute_kept(rows)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert set(want.values()) <= kept and len(kept) <= len(set(want.values())) * 1.02
    for i, a in sets.items():  # clear copies never stay side by side
        for j, b in sets.items():
            assert not (i < j and i in kept and j in kept and len(a & b) >= 0.9 * len(a | b) and len(a) > 20)
    assert docs.columns == simhash.keep_one(docs).columns
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_keep_one_of_edited_copies(spark, tmp_path):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(60):
        base = [word() for _ in range(300)]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 5):
            t = list(base)
            for _ in range(k):  # k edits: similarity about (296 - 5 k) / (296 + 5 k)
                t[rng.randrange(300)] = word()
            rows.append((10 * g + k, " ".join(t)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert kept == [10 * g for g in range(60)]


def test_graph(spark):
    from shiftgrid.llm.graph import components

    path = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(129, 50), (7, 7), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 50 for k in [50, *range(100, 130)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_targets(sizes):
    """Largest-remainder by repeated sharing, as the contract words it."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = 2 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def test_mixing(spark, odd, docs):
    for df in (odd, docs):
        rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in df.collect()]
        sizes = defaultdict(int)
        for _, s, n in rows:
            sizes[s] += n
        want = brute_targets(dict(sizes))
        got = mixing.mix(df).collect()
        assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(rows, key=str)
        taken, most = defaultdict(int), defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
            assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
            taken[r.source] += r.taken
            most[r.source] = max(most[r.source], r.size)
        for s in sizes:
            assert abs(taken[s] - want[s]) <= most[s] + 1e-6
        again = mixing.mix(df.repartition(3)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        names = df.columns
        made = mixing.sample(df)
        assert made.columns == names
        count = pd.Series([r.doc_id for r in made.collect()]).value_counts().to_dict()
        per = defaultdict(int)
        for r in got:
            per[r.doc_id] += r.copies
        assert count == {k: v for k, v in per.items() if v and k is not None}
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_is_fair(spark):
    """Over seeds, each document's mean copies come near its expectation."""
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 2}") for i in range(300)], "doc_id long, text string, source string")
    total = defaultdict(float)
    for seed in range(6):
        for r in mixing.mix(df, seed=100 * seed).collect():
            total[r.source] += r.copies * r.size / 6 / r.target
    assert all(abs(v - 1) < 0.02 for v in total.values())


def brute_base(text):
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(pats.items()) for m in re.finditer(p, text) if ok(kind, m.group())]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


def test_pii(odd, docs):
    for df in (odd, docs):
        texts = defaultdict(list)
        for r in df.collect():
            base = brute_base(r.text or "")
            texts[r.doc_id].append((hashlib.sha256(",".join(base).encode()).hexdigest(), base))
        for r in pii.find(df).collect():
            own = [b for h, b in texts[r.doc_id] if h == r.base_sha256]
            assert own, (r, texts[r.doc_id])
            assert set(own[0]) <= set(r.spans.split(",") if r.spans else [])
            for k in ("email", "ip", "card", "phone"):
                assert r[f"n_{k}"] == sum(x.startswith(k + ":") for x in own[0])
    spans = {r.doc_id: r.spans for r in pii.find(odd).collect()}
    assert "tel:" in spans[13] and "mail:" in spans[14]
    clean = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert clean[12].startswith("call [PHONE] or [EMAIL] or [CARD] at 10.0.0.256 [IP]") and clean[0] is None and clean[15] == "same words here now"
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd.limit(0)).count() == 0


def test_pii_adds_little_to_clean_texts(docs):
    rows = pii.find(docs).collect()
    base = sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    assert sum(len(r.spans.split(",")) if r.spans else 0 for r in rows) <= base * 2 + 5


def brute_license(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, lab) for p, lab in license.PHRASES.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i : i + n] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license(odd, docs):
    for df in (odd, docs):
        want = sorted(((r.doc_id, *brute_license(r.text)) for r in df.collect()), key=str)
        got = license.scan(df).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == want
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license.scan(odd.limit(0)).count() == 0


def test_license_tolerates_edits(spark):
    text = license.TEMPLATES["bsd"].replace("binary forms", "binary compiled forms")
    r = license.scan(spark.createDataFrame([(1, text), (2, "binary forms with or without")], "doc_id long, text string")).collect()
    assert {x.doc_id: x.labels for x in r} == {1: "bsd", 2: ""}


def test_quality(spark, odd, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 400
    got = {r.doc_id: r for r in quality.classify(docs, model).select("doc_id", "held_out", "score", "predicted").collect()}
    told = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(q == g.predicted for q, g in told) >= 0.95 * len(told)
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    out = quality.classify(odd, model)
    assert out.count() == odd.count() and all(0 <= r.score <= 1 for r in out.collect())
    empty = quality.fit(docs, labels.limit(0))
    assert empty.rules == () and quality.classify(odd.limit(0), empty).count() == 0


def test_sharding(spark, odd, docs):
    for law in ("bytes", "rows", "key"):
        for df in (odd, docs):
            rows = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect()), key=str)
            got = sharding.shard(df, law=law).collect()
            assert sorted([(r.doc_id, r["size"], r.text_crc32) for r in got], key=str) == rows
            by = defaultdict(list)
            for r in got:
                assert 0 <= r.shard < 40 and r.law == law
                by[r.shard].append(r)
            for own in by.values():
                assert sorted(r.slot for r in own) == list(range(len(own)))
            if law == "bytes":
                mean = sum(r[1] for r in rows) / 40
                assert all(abs(sum(r["size"] for r in own) - mean) <= max(r[1] for r in rows) for own in by.values())
            if law == "rows":
                counts = [len(by[k]) for k in range(40)]
                assert max(counts) - min(counts) <= 1
            if law == "key":
                assert all(r.grown_shard in (r.shard, 40) for r in got)
            again = sharding.shard(df.repartition(5), law=law).collect()
            assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd, law="other")


def test_sharding_subdivides(spark):
    df = spark.createDataFrame([(i % 3, "same") for i in range(500)] + [(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    got = sharding.shard(df, law="rows", shards=7, ranges=14).collect()
    counts = pd.Series([r.shard for r in got]).value_counts()
    assert counts.max() - counts.min() <= 1


def test_queries_have_the_contract_columns(spark):
    want = {
        "op1_quality": ["doc_id", "held_out", "score", "predicted"], "op3_license": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op9_simhash": ["doc_id", "fingerprint", "component_id"],
        "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, SF)
        assert df.columns == columns
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
