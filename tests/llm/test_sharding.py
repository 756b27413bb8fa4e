"""Sharding by bytes: groups of equal texts in one shard, hot groups cut evenly, items of many rows."""

from collections import defaultdict

from shiftgrid.llm import sharding, util


def shards_of(rows):
    sizes, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, groups


def test_groups_are_whole(spark, monkeypatch):
    monkeypatch.setattr(util, "CHUNK", 100)
    rows = [(i, f"text {i % 1500} " + "word " * (i % 7)) for i in range(6000)]  # groups of four
    rows += [(10_000 + i, "a middling group " * 3) for i in range(150)]
    rows += [(20_000 + i, "a hot group of copies " * 2) for i in range(3000)]
    rows += [(30_000, "one row many times")] * 250
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df).collect()
    sizes, groups = shards_of(got)
    mean = sum(sizes.values()) / 40
    hot = {k for k, v in groups.items() if len(v) > 1}
    assert len(got) == len(rows) and len(hot) == 1 and len(sizes) == 40
    assert all(abs(s - mean) <= 0.02 * mean + 600 for s in sizes.values()), (mean, sorted(sizes.values()))
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(df.repartition(7)).collect()))
    assert sharding.shard(df, law="key").count() == len(rows)


def test_level():
    assert sharding._level([0.0, 0.0], 10) == [5.0, 5.0] and sharding._level([4.0, 0.0, 100.0], 8) == [2.0, 6.0, 0.0] and sharding._level([3.0], 0) == [0.0]


def test_mostly_empty(spark, monkeypatch):
    """Nine in ten texts are empty: a group large by rows, not by bytes, of which no window holds all."""
    monkeypatch.setattr(sharding, "ROWS", 100)
    rows = [(i, "") for i in range(9000)] + [(10_000 + i, f"text {i} " + "word " * 2000) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df).collect()
    sizes, groups = shards_of(got)
    mean = sum(sizes.values()) / 40
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and all(len(v) == 1 for v in groups.values() if v)
    assert len(sizes) == 40 and all(abs(s - mean) <= 0.05 * mean for s in sizes.values())
