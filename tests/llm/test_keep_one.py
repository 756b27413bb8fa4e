"""Near-duplicates at the edge of the similarity that links."""

import random

from shiftgrid.llm import simhash


def kept(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(path))
    return {r.doc_id for r in simhash.keep_one(spark.read.parquet(str(path))).collect()}


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_every_pair_at_the_threshold_links(spark, tmp_path):
    rng, rows = random.Random(3), []
    for g in range(200):
        base = words(rng, 300)
        near, off = list(base), words(rng, 300)
        near[100:128] = words(rng, 28)  # 264 of 328 shingles: 0.805
        far = list(off)
        far[100:132] = words(rng, 32)  # 260 of 332: 0.783
        rows += [(4 * g + k, " ".join(t)) for k, t in enumerate((base, near, off, far))]
    assert kept(spark, tmp_path / "d", rows) == {i for i, _ in rows if i % 4 != 1}


def test_large_groups_link_across_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 2000)
    rng = random.Random(5)
    base, rows = words(rng, 200), [(0, "")]
    for k in range(1, 61):  # each a step from the last: only neighbours link
        base = [*base[18:], *words(rng, 18)]
        rows.append((k, " ".join(base)))
    assert kept(spark, tmp_path / "d", rows) == {0, 1}


def test_repeated_lines_count_once(spark, tmp_path):
    rng = random.Random(4)
    line, rows = words(rng, 14), []
    for g in range(40):  # a line of 10 shingles repeated 20 times in different texts, and texts with and without repeats
        rows.append((3 * g, " ".join(words(rng, 200) + line * 20)))
        text = words(rng, 200)
        once = line * 2 + text
        rows += [(3 * g + 1, " ".join(once)), (3 * g + 2, " ".join(line * 20 + text))]
    assert kept(spark, tmp_path / "d", rows) == {i for i, _ in rows if i % 3 != 2}


def test_simhash_brings_candidates(spark, tmp_path):
    """Near copies meet by SimHash links alone, where no band brings them together, and are still checked exactly."""
    base = [f"w{i * 7919 % 1000}x{i}" for i in range(3000)]
    near = [*base[:-1], "other"]
    texts = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(reversed(base)))]
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t, 5)) for i, t in texts}
    assert (int.from_bytes(prints[0]) ^ int.from_bytes(prints[1])).bit_count() <= 4
    groups = spark.createDataFrame([(i, [bytearray(f)], [i] * simhash.BANDS) for i, f in prints.items()], "node long, sims array<binary>, bands array<bigint>")
    roots = {r.id: r.root for r in simhash.candidates(groups).collect()}
    assert roots[0] == roots[1] and roots.get(2, 2) == 2
    assert kept(spark, tmp_path / "d", texts) == {0, 2}
