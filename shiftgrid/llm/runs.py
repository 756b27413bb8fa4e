"""Periodic runs of words in texts: stretches that repeat a period at least four times.

Internal pattern matching, over many texts at once in numpy: prefix doubling names every stretch of 2^k
words and ends in a suffix array; each dyadic block that recurs in its text asks for its next occurrence
to the right and to the left, a range successor in the block's interval of the suffix array, answered by a
wavelet matrix over positions. Occurrences of a block inside a run are a progression whose difference is
the period, so the distances are the candidate periods; names of 2^k words then extend each to its run.

A run of period q and of 4q words or more is met by a block of the length L = 2^k with q <= L < 2q: one
begins within the run's first L words, and its occurrence q words on, or q words back, lies in the run;
no nearer one does, as a block of q words or more holds a primitive root. So distances in (L/2, L] are all
that level k asks for, and no run is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose texts are searched together; a longer text is searched alone, whole.
TOGETHER = 131_072
#: The least words of a run, and the least repeats of its period.
LEAST, REPEATS = 6, 4


class Names:
    """Ranks of stretches of 2^k words by level, and the suffix array that they end in.

    ``ids`` are word numbers of all texts after each other, ``first`` where each text begins. Ranks are
    places of groups in the suffix array, texts after each other, so a stretch is equal to another of its
    own text if and only if their ranks are.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, ends: np.ndarray):
        n = len(ids)
        self.n, self.levels, self.blocks = n, [], []
        text = np.repeat(np.arange(len(first)), ends - first)
        self.begin, end = first[text], ends[text]
        self.at = np.arange(n) - self.begin
        key = text * (int(ids.max()) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        active, rank[order] = self._groups(key[order], np.arange(n), order)
        step = 1
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))  # what follows the last word is like nothing
            if not len(active[0]):
                break
            who, size = active
            own = (self.at[who] % step == 0) & (who + step <= end[who])
            self.blocks.append((step, who[own], rank[who[own]], size[own]))
            after = who + step
            key = rank[who] * (n + 1) + np.where(after < end[who], rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            who, key = who[order], key[order]
            # Members of a group stay together, so a new group's rank is its group's and its place in it.
            old = rank[who]
            base = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            place = np.arange(len(who)) - np.repeat(base, np.diff(np.r_[base, len(who)]))
            active, rank[who] = self._groups(key, old + place, who)
            step *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    @staticmethod
    def _groups(key: np.ndarray, place: np.ndarray, who: np.ndarray):
        """Of sorted keys: members of groups of two or more with their group's size, and everyone's rank."""
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        rank, size = np.repeat(place[head], size), np.repeat(size, size)
        many = size > 1
        return (who[many], size[many]), rank

    def equal_right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from ``i`` on that are equal to those from ``j`` on, ``i`` before ``j`` in one text."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][np.minimum(i, self.n)] == self.levels[k][np.minimum(j, self.n)]
            i += same << k
            j += same << k
        return i - start

    def equal_left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before ``i`` that are equal to those before ``j``."""
        i, j, start, least = i.copy(), j.copy(), i, self.begin[i]
        for k in range(len(self.levels) - 1, -1, -1):
            back = 1 << k
            same = (i - back >= least) & (self.levels[k][np.maximum(i - back, 0)] == self.levels[k][np.maximum(j - back, 0)])
            i -= same << k
            j -= same << k
        return start - i


class Wavelet:
    """Wavelet matrix of non-negative integers: counts of smaller ones, and the r-th smallest, of many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.total = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            self.total.append(int(self.zeros[-1][-1]))
            values = np.r_[values[~one], values[one]]

    def smaller(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values in places ``lo`` to ``hi`` are smaller than ``x``."""
        count = np.zeros(len(lo), np.int64)
        for k, (zeros, total) in enumerate(zip(self.zeros, self.total, strict=True)):
            one = (x >> (self.bits - 1 - k) & 1).astype(bool)
            zl, zh = zeros[lo], zeros[hi]
            count += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, total + lo - zl, zl), np.where(one, total + hi - zh, zh)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The ``r``-th smallest, from 0, of the values in places ``lo`` to ``hi``."""
        value = np.zeros(len(lo), np.int64)
        for k, (zeros, total) in enumerate(zip(self.zeros, self.total, strict=True)):
            zl, zh = zeros[lo], zeros[hi]
            one = r >= zh - zl
            r = np.where(one, r - (zh - zl), r)
            value |= one.astype(np.int64) << (self.bits - 1 - k)
            lo, hi = np.where(one, total + lo - zl, zl), np.where(one, total + hi - zh, zh)
        return value


def runs_of(ids: np.ndarray, first: np.ndarray, ends: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs, places counted over all texts, by start and period.

    ``ids``: word numbers of the texts after each other; text k has those from ``first[k]`` to ``ends[k]``.
    """
    if repeats < 4:
        raise ValueError("repeats: blocks of one level meet runs of four repeats or more")
    none = np.empty((0, 3), np.int64)
    if not len(ids):
        return none
    names = Names(ids, first, ends)
    if not names.blocks:
        return none
    step, block, lo, size = (np.concatenate(c) for c in zip(*((np.full(len(b), s), b, r, n) for s, b, r, n in names.blocks), strict=True))
    hi, at = lo + size, names.at[block]
    tree = Wavelet(names.at[names.suffixes])
    mine = tree.smaller(lo, hi, at)
    found = []
    for side, has in ((1, mine + 1 < size), (-1, mine > 0)):
        k = np.flatnonzero(has)
        other = tree.smallest(lo[k], hi[k], mine[k] + side)
        far = (other - at[k]) * side
        k, far = k[near := (far <= step[k]) & (2 * far > step[k])], far[near]
        found.append((block[k] if side > 0 else block[k] - far, far))
    i, period = (np.concatenate(c) for c in zip(*found, strict=True))
    right, left = names.equal_right(i, i + period), names.equal_left(i, i + period)
    out = np.stack([i - left, left + right + period, period], 1)
    out = out[out[:, 1] >= np.maximum(least, repeats * period)]
    if not len(out):
        return none
    out = np.unique(out, axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``TOGETHER`` words or fewer, or of one longer text."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > TOGETHER:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Each row of ``docs``: the columns ``keep``, ``n_words``, ``runs`` (array of start, length, period, by
    start, then period) and ``collapsed``, the text's words that no run holds after its first period, joined by one space.

    Words are runs of anything but ASCII white space; they are compared by their bytes. A null or empty
    text has no words, no runs and an empty ``collapsed``. Rows are treated each for itself, repeated rows alike,
    without a shuffle; other columns, whatever their names, are neither read nor returned.
    """
    names = list(keep)
    source = docs.select(*names, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    fields = [(f.name, f.dataType.simpleString()) for f in source.select(*names).schema]
    added = [("n_words", "bigint"), ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("collapsed", "string")]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, whole = 0, batch.num_rows, batch.column("_text")
            while at < n:
                words, size, stop = [], 0, at
                while stop < n and size < 8_000_000:  # a bounded share at a time, whole texts
                    raw = whole[stop].as_py()
                    words.append(raw.split())
                    size += len(raw)
                    stop += 1
                sizes = [len(w) for w in words]
                rows, told = [], []
                for a, b in _pieces(sizes):
                    rows_of(words[a:b], sizes[a:b], least, repeats, rows, told)
                kept = batch.slice(at, stop - at).select(names).columns
                new = [pa.array(sizes, pa.int64()), pa.array(rows, kind), pa.array(told, pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*names, *(k for k, _ in added)])
                at = stop

    return source.mapInArrow(searched, ", ".join(f"`{k}` {t}" for k, t in [*fields, *added]))


def rows_of(words: list[list[bytes]], sizes: list[int], least: int, repeats: int, rows: list, told: list) -> None:
    """Runs and collapsed texts of some texts, appended to ``rows`` and ``told``."""
    number: dict[bytes, int] = {}
    name = number.setdefault
    ids = np.array([name(w, len(number)) for own in words for w in own], np.int64)
    ends = np.cumsum(sizes)
    first = ends - sizes
    found = runs_of(ids, first, ends, least, repeats)
    cut = np.searchsorted(found[:, 0], np.r_[first, ends[-1]])
    for k, own in enumerate(words):
        mine = found[cut[k] : cut[k + 1]]
        if not len(mine):
            rows.append([])
            told.append(b" ".join(own))
            continue
        start, length, period = (mine - [first[k], 0, 0]).T
        held = np.zeros(len(own) + 1, np.int64)
        np.add.at(held, start + period, 1)
        np.add.at(held, start + length, -1)
        rows.append([{"start": a, "length": b, "period": c} for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)])
        told.append(b" ".join([own[i] for i in np.flatnonzero(np.cumsum(held[:-1]) == 0).tolist()]))


def tallest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: smallest start, then period. Null if there is none."""
    taller = lambda a, x: (x["length"] * a["period"] > a["length"] * x["period"])
    empty = F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)")
    return F.aggregate(runs, empty, lambda a, x: F.when(a.isNull() | taller(a, x), x).otherwise(a))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    of = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, of), "")
