"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``radius + 1`` bits. A mask keeps the positions whose
vector has an odd product with the mask's own vector. The vectors of ``radius`` differing positions
span less than the whole space, so some mask is orthogonal to them all and keeps none of them: every
pair within the radius agrees under at least one of the ``2 ** (radius + 1) - 1`` masks.

Wider fingerprints, which tell lower similarities, are cut into slices that are covered each for itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.graph import components
from shiftgrid.llm.util import placed, written

SEED = 42
#: Distinct fingerprints of a bucket that are compared together; larger buckets are cut into tiles.
TILE = 2048


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words of the whole text; of all words if there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)]


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """Another 64 bits from each hash, by multiply and shift; ``j`` 0 gives the hash itself."""
    if j == 0:
        return h
    x = h + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: list[int], words: int = 1) -> bytes:
    """Bit by bit the majority of the hashes, ``words`` times 64 bits, big-endian. No hashes: zeros."""
    if not hashes:
        return bytes(8 * words)
    h = np.array(hashes, dtype=np.uint64)
    total = np.zeros((words, 64), np.int64)
    for k in range(0, len(h), 255):  # sums of 255 bits fit in bytes
        part = h[k : k + 255]
        for j in range(words):
            total[j] += np.unpackbits(_mixed(part, j).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(total.reshape(-1) * 2 > len(h)).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", keys: tuple[str, ...] = ("doc_id",), words: int = 1) -> DataFrame:
    """``keys`` and ``fp`` (8 * ``words`` bytes) for each row; a null text counts as empty."""
    names = list(keys)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), width), words) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(fps, pa.binary())], names=[*names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(hashed, f"{schema}, fp binary")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of words of ``bits``, as signed longs."""
    space = 2 ** (radius + 1)
    vectors = [1 + i % (space - 1) for i in range(bits)]
    masks = [sum(1 << i for i, v in enumerate(vectors) if (v & m).bit_count() % 2) for m in range(1, space)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words; unsigned, as bits of negative numbers would be counted of their absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (places in ``fps``, rows of words) of a spanning forest of their links: every link is within a tree."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = _distance(fps[left], fps[here]) <= radius
            if near.any():
                found = left[near].tolist()
                a += [here] * len(found)
                b += found
                queue += found
                left = left[~near]
    return a, b


def _link_groups(radius: int):
    """Rows (m, k, ci, cj, node, fp) sorted by group, streamed to (a, b): a group is held at a time, at most two tiles."""
    key = ["m", "k", "ci", "cj"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None

        def edges(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(fps)]
            two = starts[ends - starts == 2]
            two = two[_distance(fps[two], fps[two + 1]) <= radius]
            a, b = two.tolist(), (two + 1).tolist()
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2:
                    x, y = _forest(fps[s:e], radius)
                    a += [int(s) + i for i in x]
                    b += [int(s) + i for i in y]
            found = np.unique(np.stack([nodes[a], nodes[b]], axis=1).astype(np.int64), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">i8").astype(np.int64).reshape(batch.num_rows, -1)
            now = (keys, batch.column("node").to_numpy(), fps)
            rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            other = np.flatnonzero((rest[0] != rest[0][-1]).any(axis=1))
            if len(other):
                n = int(other[-1]) + 1
                yield edges(*(x[:n] for x in rest))
                rest = tuple(x[n:] for x in rest)
        if rest is not None:
            yield edges(*rest)

    return linked


#: Words of a wide fingerprint, and its slices that are covered each for itself: how many, bits, radius.
WIDE_WORDS, WIDE_SLICES = 16, (16, 42, 2)


def _masked_keys(fps: DataFrame, slices: tuple[int, int, int]) -> DataFrame:
    """``(node, fp)`` to ``(node, m, k)``: every slice under each of its masks, ``m`` numbering both."""
    n, bits, radius = slices
    masks = np.array([m & (2**64 - 1) for m in covering_masks(radius, bits)], np.uint64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(rows, -1) if rows else np.zeros((0, 8), np.uint8)
            each = np.unpackbits(raw, axis=1)[:, : n * bits].reshape(rows, n, bits)
            part = np.zeros((rows, n, 64), np.uint8)
            part[:, :, 64 - bits :] = each
            word = np.packbits(part, axis=2).view(">u8").astype(np.uint64).reshape(rows, n, 1)
            keys = (word & masks).reshape(rows, -1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))], names=["node", "keys"])

    return fps.mapInArrow(keyed, "node long, keys array<bigint>").select("node", F.posexplode("keys").alias("m", "k"))


def links(fps: DataFrame, radius: int = 4, slices: tuple[int, int, int] | None = None) -> DataFrame:
    """Distinct ``(node, fp)``, ``fp`` bytes, to ``(a, b)``: pairs of nodes within ``radius`` that join up all that are linked.

    Without ``slices`` the whole of a one-word fingerprint is covered for ``radius``: no link is lost.
    Only buckets of two or more are kept. A bucket of more than ``TILE`` values is dealt into chunks,
    and each pair of chunks compared in a task of its own, so that nothing is capped and no task grows
    with a bucket. Pairs within a bucket are never rows: a spanning forest of them is.
    """
    keyed = _masked_keys(fps, slices or (1, 64, radius))
    full = keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = written(full.select("m", "k", F.ceil(F.col("n") / TILE).cast("int").alias("chunks")), "buckets")
    rows = keyed.join(full, ["m", "k"]).withColumn("c", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
    rows = written(rows.select("m", "k", "node", "c", "chunks"), "collisions").join(fps.select("node", "fp"), "node")
    tiled = rows.select("m", "k", "node", "fp", "c", F.explode(F.expr("sequence(0, chunks - 1)")).alias("d"))
    tiled = tiled.select("m", "k", F.least("c", "d").alias("ci"), F.greatest("c", "d").alias("cj"), "node", "fp")
    placed = tiled.repartition("m", "k", "ci", "cj").sortWithinPartitions("m", "k", "ci", "cj", "node")
    return placed.mapInArrow(_link_groups(radius), "a long, b long").distinct()


def classes(prints: DataFrame, radius: int = 4, key: str = "doc_id", slices: tuple[int, int, int] | None = None) -> DataFrame:
    """``(fp, root, component_id)`` for every fingerprint of ``prints(key, fp)``; ``fp`` is bytes, ``root`` its component.

    ``component_id``: the smallest non-null key of a fingerprint's component (null if there is none).
    """
    groups = prints.groupBy("fp").agg(F.min(key).alias("low"))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    comp = written(components(links(groups.select("node", "fp"), radius, slices)), "components")
    rooted = groups.join(comp, groups.node == comp.id, "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    # Written, so that the join has plain exchanges on both sides and a large component's rows may be split.
    least = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    return written(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fp``, ``component_id``.

    Texts of fewer than ``width`` words are one shingle; texts without words (null ones too) have
    fingerprint 0 and link like any other. Repeated rows are repeated in the result.
    """
    prints = written(fingerprints(docs, width, keys=(key,)), "prints")
    return prints.join(classes(prints, radius, key), "fp").select(key, "fp", "component_id")


def distance_of(similarity: float, bits: int) -> int:
    """Differing bits expected of two sets of that Jaccard similarity: the angle of their indicator vectors."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


#: Bands of minima that bring candidates together, and minima a band: at a similarity s a pair meets with 1 - (1 - s ** 6) ** 40.
BANDS, MINIMA = 40, 6
#: Shingles of a chunk; larger groups of candidates are cut into pairs of chunks, as buckets are into tiles.
CHUNK = 2**17
_RNG = np.random.default_rng(SEED)
_FLIPS, _FACTORS, _FOLDS = (_RNG.integers(0, 2**64, BANDS * MINIMA, np.uint64) | np.uint64(1) for _ in range(3))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of ``shingle_hashes``, sorted."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A long a band: its minima of the set under that many orders, folded together."""
    low = np.full(BANDS * MINIMA, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(low, ((shingles[k : k + 512] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=low)
    return (low * _FOLDS).reshape(BANDS, MINIMA).sum(axis=1, dtype=np.uint64).view(np.int64)


def set_prints(docs: DataFrame, width: int, text: str, keys: tuple[str, ...]) -> DataFrame:
    """``keys``, ``fp`` (16 bytes that tell sets of shingles apart), ``sim`` (SimHash of all shingles), ``size`` of the set and its ``bands``."""
    names = list(keys)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, sizes, bands = [], [], [], [np.zeros(0, np.int64)]
            for t in b.column("_text"):
                hashes = shingle_hashes(t.as_py(), width)
                s = np.unique(np.array(hashes, np.uint64))
                sims.append(fingerprint(hashes))
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                bands.append(band_keys(s))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(fps, pa.binary()), pa.array(sims, pa.binary()), pa.array(sizes, pa.int64()), lists], names=[*names, "fp", "sim", "size", "bands"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(hashed, f"{schema}, fp binary, sim binary, size long, bands array<bigint>")


def _set_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """As ``_forest``, of sets whose Jaccard similarity is ``similarity`` or more."""
    sizes = np.array([len(x) for x in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    a, b, left = [], [], np.arange(len(sets))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            here = queue.pop()
            mark = np.zeros(len(values), bool)
            mark[ids[ends[here] - sizes[here] : ends[here]]] = True
            sums = np.r_[0, np.cumsum(mark[ids])]
            shared = (sums[ends] - sums[ends - sizes])[left]
            near = shared >= similarity * (sizes[left] + sizes[here] - shared) - 1e-9
            if near.any():
                found = left[near].tolist()
                a += [here] * len(found)
                b += found
                queue += found
                left = left[~near]
    return a, b


def _link_sets(similarity: float):
    """Rows (root, ci, cj, node, set) sorted by group, streamed to (a, b): a group is held at a time, at most two chunks."""
    key = ["root", "ci", "cj"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sets = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), []

        def edges(end: int) -> pa.RecordBatch:
            cut = np.flatnonzero((keys[1:end] != keys[: end - 1]).any(axis=1)) + 1
            a, b = [], []
            for s, e in zip(np.r_[0, cut], np.r_[cut, end], strict=True):
                x, y = _set_forest([np.frombuffer(v, np.uint64) for v in sets[s:e]], similarity)
                a += [int(s) + i for i in x]
                b += [int(s) + i for i in y]
            return pa.RecordBatch.from_arrays([pa.array(nodes[a].astype(np.int64)), pa.array(nodes[b].astype(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], axis=1)])
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            sets += batch.column("set").to_pylist()
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            if len(other):
                n = int(other[-1]) + 1
                yield edges(n)
                keys, nodes, sets = keys[n:], nodes[n:], sets[n:]
        if sets:
            yield edges(len(sets))

    return linked


def simhash_edges(groups: DataFrame, radius: int = 4) -> DataFrame:
    """``groups(node, sims)`` to ``(a, b)``: nodes joined up whose SimHash fingerprints are equal or within ``radius``, by
    the covering masks of ``links``. Texts of one set of shingles may have several, as repeats count in a fingerprint."""
    of = groups.select("node", F.explode("sims").alias("fp"))
    low = of.groupBy("fp").agg(F.min("node").alias("low"))
    low = written(low.withColumn("sim_node", F.monotonically_increasing_id()), "fingerprints")
    same = of.join(low, "fp").where("low <> node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = links(low.select(F.col("sim_node").alias("node"), "fp"), radius)
    for end in "ab":
        near = near.join(low.select(F.col("sim_node").alias(end), F.col("low").alias(f"_{end}")), end)
    return same.unionByName(near.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def candidates(groups: DataFrame) -> DataFrame:
    """``groups(node, sims, bands)`` to ``(id, root)``: nodes with SimHash fingerprints that link, or that share a band's key,
    directly or by way of others."""
    keyed = groups.select("node", F.posexplode("bands").alias("m", "k"))
    low = keyed.groupBy("m", "k").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    low = written(low.select("m", "k", "low"), "buckets")
    banded = keyed.join(low, ["m", "k"]).select(F.col("low").alias("a"), F.col("node").alias("b"))
    return written(components(banded.unionByName(simhash_edges(groups))), "candidates")


def set_links(rows: DataFrame, groups: DataFrame, width: int, similarity: float, text: str) -> DataFrame:
    """``(a, b)``: pairs of nodes of ``groups(node, size, b, sims, bands)`` that join up all candidates whose shingle
    sets, made again from the texts of ``rows(_row, text)``, have a Jaccard similarity of ``similarity`` or more."""
    near = candidates(groups)
    at = near.join(groups.select("node", "size", F.col("b.r").alias("_row")), near.id == groups.node).select("root", "node", "size", "_row")
    at = written(at, "placed")
    chunks = written(at.groupBy("root").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks")), "chunks")
    at = written(at.join(chunks, "root").select("_row", "root", "node", "chunks", F.expr("cast(pmod(xxhash64(node), chunks) as int)").alias("c")), "chunked")
    names = ["root", "node", "chunks", "c"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(sets, pa.binary())], names=[*names, "set"])

    met = rows.select("_row", F.col(text).alias("_text")).join(at.hint("merge"), "_row").select(*names, "_text")
    sets = met.mapInArrow(hashed, "root long, node long, chunks int, c int, set binary")
    tiled = sets.select("root", "node", "set", "c", F.explode(F.expr("sequence(0, chunks - 1)")).alias("d"))
    tiled = tiled.select("root", F.least("c", "d").alias("ci"), F.greatest("c", "d").alias("cj"), "node", "set")
    sorted_ = tiled.repartition("root", "ci", "cj").sortWithinPartitions("root", "ci", "cj", "node")
    return sorted_.mapInArrow(_link_sets(similarity), "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, of each component the one with the smallest key (nulls last), all columns kept.

    Links are texts whose sets of distinct shingles have a Jaccard similarity of ``similarity`` or more, counted
    exactly. Candidates are those whose SimHash fingerprints link as in ``near_duplicates`` (4 differing bits, none lost), and,
    as a similarity of 0.8 is beyond what 4 bits tell, those that share one of 40 bands of 6 minima: of pairs at 0.8 all but
    6 in a million do, at 0.85 and more fewer than one in 10 ** 8 does not. Equal sets always link.
    Of repeated rows with that key one stays. Rows are told apart by their place in their files; ``docs``
    that are not read from files are written first.
    """
    rows = placed(docs)
    prints = written(set_prints(rows, width, text, (key, "_row")), "prints")
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_row").alias("r")))
    groups = prints.groupBy("fp").agg(first.alias("b"), F.first("size").alias("size"), F.collect_set("sim").alias("sims"), F.first("bands").alias("bands"))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "sets")
    comp = written(components(set_links(rows, groups, width, similarity, text)), "components")
    best = groups.join(comp, groups.node == comp.id, "left").groupBy(F.coalesce("root", "node")).agg(F.min("b").alias("b")).select(F.col("b.r").alias("_row"))
    # The plan is the same at every size: ids are never broadcast.
    return rows.join(written(best, "kept").hint("merge"), "_row", "left_semi").drop("_row")


def hex_of(fp: str = "fp"):
    """A fingerprint's bytes as lowercase hex digits, 16 a word."""
    return F.lower(F.hex(F.col(fp)))
