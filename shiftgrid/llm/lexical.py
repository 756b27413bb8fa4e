"""Ranked lexical search by bag deduplication.

Documents are restricted to the items' vocabulary: what an item's score reads of a document is how often each
of those terms stands in it, and ``m``, which its length sets. Documents that agree in both are one class:
they are hashed, met by the hash and held against each other in full. A class is scored once against all
items, and its members, by ascending ``doc_id``, take its score; a member after ``k`` others can't be among
an item's ``k`` best, so ``k`` of a class are kept.

Items come in blocks of bounded size, all of them in turn against all documents; what a block needs (its
vocabulary, weights and postings) is bounded by that size, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftgrid.llm.util import written

#: Bytes of terms: digits, A-Z (lower-cased), a-z and everything beyond ASCII. All others part terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: An item's id is any value; a block of items ends when it has so many items, or terms with repeats.
ITEMS, TERMS = 20_000, 1_000_000
#: Classes by items whose scores are held at a time.
CELLS = 4_000_000
#: Integers up to which doubles are exact.
EXACT = 2**53


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split()


@dataclass(frozen=True)
class Block:
    """Some items: their ids, the numbers of their terms, and how often each item has each term."""

    ids: list
    number: dict[bytes, int]
    item: np.ndarray  #: by term: items that have it, from begin[t] to begin[t + 1]
    often: np.ndarray
    begin: np.ndarray
    longest: int  #: terms of the longest item, with repeats


def _block(ids: list, counts: list[Counter]) -> Block:
    number: dict[bytes, int] = {}
    for c in counts:
        for t in c:
            number.setdefault(t, len(number))
    rows = sorted((number[t], k, n) for k, c in enumerate(counts) for t, n in c.items())
    term, item, often = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3
    return Block(ids, number, item, often, np.searchsorted(term, np.arange(len(number) + 1)), max((c.total() for c in counts), default=0))


def blocks(items: DataFrame, id: str, text: str) -> Iterator[Block]:
    """Items in blocks, read by the driver partition by partition, one block at a time."""
    ids, counts, total = [], [], 0
    for own, raw in items.select(id, F.coalesce(F.col(text), F.lit("")).cast("binary")).toLocalIterator():
        c = Counter(terms_of(bytes(raw)))
        if ids and (len(ids) >= ITEMS or total + c.total() > TERMS):
            yield _block(ids, counts)
            ids, counts, total = [], [], 0
        ids.append(own)
        counts.append(c)
        total += c.total()
    if ids:
        yield _block(ids, counts)


def bags(docs: DataFrame, number: dict[bytes, int], id: str, text: str) -> DataFrame:
    """``doc_id``, ``n`` (terms, with repeats) and ``bag``: pairs of a term's number and its count, by number, as bytes."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(number)  # of one block of items: at most TERMS terms

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        for batch in batches:
            n, bag = [], []
            for text in batch.column("_text"):
                terms = terms_of(text.as_py())
                n.append(len(terms))
                pairs = sorted((own[t], c) for t, c in Counter(filter(own.__contains__, terms)).items())
                bag.append(np.array(pairs, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(bag, pa.binary())], names=["doc_id", "n", "bag"])

    source = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    return source.mapInArrow(counted, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n bigint, bag binary")


def holding(bagged: DataFrame, terms: int) -> np.ndarray:
    """By term the number of documents that hold it, summed in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column("bag").to_pylist()), "<u4").reshape(-1, 2)
            df += np.bincount(pairs[:, 0], minlength=terms)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(df[has], pa.int64())], names=["term", "df"])

    df = np.zeros(terms, np.int64)
    for t, n in bagged.select("bag").mapInArrow(counted, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():  # a row a term of the block
        df[t] = n
    return df


def classes(bagged: DataFrame, k: int) -> DataFrame:
    """``(m, bag)`` of each class with ``members``: its ``k`` smallest ids, a null id after all others.

    Classes meet by a hash and are told apart by their whole bags. Each task keeps ``k`` members of a class before
    anything is shuffled, so a class of a third of all documents is no larger there than any other.
    """
    key = F.xxhash64("m", "bag").alias("h")
    first = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id")))
    few = bagged.where(F.octet_length("bag") > 0).select(key, "m", "bag", "doc_id").withColumn("_r", first).where(F.col("_r") <= k)
    return few.groupBy("h", "m", "bag").agg(F.sort_array(F.collect_list(F.struct("_r", "doc_id"))).alias("members"))


def scores(rows: list[bytes], m: np.ndarray, block: Block, weight: np.ndarray, of: slice) -> np.ndarray:
    """Scores of classes (rows) for the items ``of`` the block (columns), 64-bit integers."""
    pairs = np.frombuffer(b"".join(rows), "<u4").reshape(-1, 2).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(b) // 8 for b in rows])
    term, tf = pairs.T
    gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    out = np.zeros((len(rows), of.stop - of.start), np.int64)
    order = np.argsort(term, kind="stable")
    row, gain, term = row[order], gain[order], term[order]
    head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    for a, b in zip(head, np.r_[head[1:], len(term)], strict=True):
        lo, hi = block.begin[term[a]], block.begin[term[a] + 1]
        item, often = block.item[lo:hi], block.often[lo:hi]
        i, j = np.searchsorted(item, (of.start, of.stop))
        if i < j:
            out[row[a:b, None], item[None, i:j] - of.start] += gain[a:b, None] * often[None, i:j]
    return out


def _best(found: DataFrame, block: Block, weight: np.ndarray, k: int) -> DataFrame:
    """Of each task the ``k`` best documents of each item: ``(item, doc_id, score)``."""
    shared = found.sparkSession.sparkContext.broadcast((block.item, block.often, block.begin, weight))  # bounded by TERMS
    n_items = len(block.ids)
    kind = found.schema["members"].dataType.elementType["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, often, begin, weight = shared.value
        own = Block([], {}, item, often, begin, 0)
        kept: dict[int, list] = {}
        type_ = None
        for batch in batches:
            type_ = batch.schema.field("members").type.value_type.field("doc_id").type
            width = min(n_items, 2048)
            step = max(1, CELLS // width)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                bag, m, members = part.column("bag").to_pylist(), part.column("m").to_numpy(), part.column("members")
                for lo in range(0, n_items, width):
                    got = scores(bag, m, own, weight, slice(lo, min(lo + width, n_items)))
                    for j in range(got.shape[1]):
                        s = got[:, j]
                        top = np.flatnonzero(s > 0)
                        if len(top) > k:  # ties with the k-th best class stay
                            top = top[s[top] >= np.partition(s[top], len(top) - k)[len(top) - k]]
                        if len(top):
                            more = [(-int(s[i]), x["doc_id"] is None, x["doc_id"]) for i in top.tolist() for x in members[i].as_py()]
                            kept[lo + j] = sorted([*kept.get(lo + j, ()), *more], key=lambda x: x[:2] if x[1] else x)[:k]
        rows = [(j, x[2], -x[0]) for j, own in kept.items() for x in own]
        if rows:
            j, d, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int64()), pa.array(d, type_), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])

    return found.select("bag", "m", "members").mapInArrow(scored, f"item bigint, doc_id {kind}, score bigint")


def _searched(docs: DataFrame, block: Block, k: int, id: str, text: str, kind: str, item_id: str) -> DataFrame:
    spark = docs.sparkSession
    bagged = written(bags(docs, block.number, id, text), "bags")
    n_docs, terms = (int(x or 0) for x in bagged.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
    df = holding(bagged, len(block.number))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    if weight.size and int(weight.max()) * 1_000_000 * block.longest >= 2**63:
        raise OverflowError("an item has too many terms for 64-bit scores")
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {max(terms, 1)}L")
    found = classes(bagged.withColumn("m", m), k)
    best = _best(found, block, weight, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(block.ids)), f"item bigint, `{item_id}` {kind}")
    return best.join(ids, "item").select(item_id, "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (int, from 1), ``doc_id``, ``score`` (long).

    Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased. A null text
    has none. ``N`` documents have a term, ``L`` terms they have in all; a term in ``df`` documents weighs
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; a document of ``n`` terms has ``m = 25 + (75 n N) div L`` and scores
    the sum, over the item's terms and their repeats, of ``w ((10^9 tf) div (1000 tf + 8 m))``. Only scores above 0 are
    ranked, ties by ascending id, a null id last. Items without terms, or without documents that share one, have no rows;
    repeated rows of either table are ranked each for itself. No documents or no items give no rows. Other columns are not read.
    """
    kind = items.schema[item_id].dataType.simpleString()
    parts = [_searched(docs, b, k, id, text, kind, item_id) for b in blocks(items, item_id, item_text)]
    if parts:
        return reduce(DataFrame.unionByName, parts)
    of = docs.schema[id].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"`{item_id}` {kind}, rank int, doc_id {of}, score bigint")
