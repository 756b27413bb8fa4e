"""Byte-level BPE: pre-tokenisation by an automaton over code-point classes, merges cached by piece.

Boundaries are found without a regular expression: every code point becomes a symbol (its class, and
what the next two say about it), every symbol is a function from state to state, and functions are
composed by an associative scan, in blocks that are scanned side by side.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States: nothing open; a run of letters, numbers, other signs, white space; after a blank that goes
# with what follows; within a contraction that has two or one code points left.
FRESH, LETTERS, NUMBERS, SIGNS, SPACES, JOINED, TWO, ONE = range(8)
# Symbols: letter, number, other sign, sign that opens a contraction of one or two letters if it may,
# white space with white space or the text's end next, blank before something else, other white space
# before something else, and the text's first code point's mark, which is not one of the text.
L, N, S, C1, C2, W, B, X, END = range(9)
SYMBOLS = 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]``: the next state; ``opens[symbol, state]``: whether a piece starts here."""
    step = np.zeros((SYMBOLS, 8), np.uint8)
    opens = np.ones((SYMBOLS, 8), bool)
    run = {L: LETTERS, N: NUMBERS, S: SIGNS, C1: SIGNS, C2: SIGNS}
    for symbol, state in run.items():
        step[symbol, :] = state
        opens[symbol, [state, JOINED]] = False
    for symbol, left in ((C1, ONE), (C2, TWO)):  # a sign that starts a piece may open a contraction
        step[symbol, [FRESH, LETTERS, NUMBERS, SPACES]] = left
    step[W, :], opens[W, SPACES] = SPACES, False
    step[B, :] = JOINED
    step[X, :] = FRESH
    step[END, :] = FRESH
    for symbol in (L, N, S, C1, C2, W, B, X):
        step[symbol, TWO], opens[symbol, TWO] = ONE, False
        step[symbol, ONE], opens[symbol, ONE] = FRESH, False
    return step, opens


STEP, OPENS = _automaton()


def scan(symbols: np.ndarray, start: int = FRESH, width: int = 256) -> np.ndarray:
    """The state before each symbol: functions composed within blocks, over blocks, then applied."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint8)
    blocks = -(-n // width)
    padded = np.full(blocks * width, END, np.uint8)
    padded[:n] = symbols
    by_place = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat, eight = STEP.reshape(-1), np.arange(8, dtype=np.uint8)
    whole = np.broadcast_to(eight, (blocks, 8)).copy()
    for k in range(width):
        whole = flat[(by_place[k].astype(np.uint16) * 8)[:, None] + whole]
    # Over blocks: the same composition, doubled each time.
    reach = 1
    while reach < blocks:
        later = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:reach], later])
        reach *= 2
    state = np.concatenate([[start], whole[:-1, start]]).astype(np.uint8)
    out = np.empty((width, blocks), np.uint8)
    for k in range(width):
        out[k] = state
        state = flat[by_place[k].astype(np.uint16) * 8 + state]
    return out.T.reshape(-1)[:n]


def code_point_classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other sign, 3 white space.

    They are asked of the tokenizer library once, over all code points, so that its tables hold.
    """
    import tiktoken

    classes = np.full(0x110000, 2, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    for k, pattern in enumerate((r"\p{L}", r"\p{N}")):
        enc = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(enc.encode_ordinary(every)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), "<u4")] = k
    enc = tiktoken.Encoding("classes", pat_str=r"\s", mergeable_ranks=single, special_tokens={})
    classes[np.frombuffer(bytes(enc.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = 3
    return classes


def boundaries(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point of texts laid end to end; ``ends``: where each ends."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    kind = classes[points]
    last = np.zeros(n + 2, bool)
    last[ends[ends > 0] - 1] = True
    after = np.full(n + 2, 9, np.uint8)  # of the text's next code point, 9 past its end
    after[: n - 1] = kind[1:]
    after[:n][last[:n]] = 9
    nxt = np.zeros(n + 2, np.uint32)
    nxt[: n - 1] = points[1:]
    nxt[:n][last[:n]] = 0
    second = np.zeros(n, np.uint32)
    second[: n - 1] = nxt[1:n]
    second[last[:n]] = 0
    symbol = np.array([L, N, S, W], np.uint8)[kind]
    quote = points == ord("'")
    at = np.flatnonzero(quote)
    if len(at):
        one = np.isin(nxt[at], [ord(c) for c in "stmd"])
        symbol[at[one]] = C1
        a, b = nxt[at], second[at]
        two = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        symbol[at[two]] = C2
    before_word = (kind == 3) & (after[:n] != 3) & (after[:n] != 9)
    symbol[before_word] = np.where(points[before_word] == 32, B, X)
    # The mark of a text's end stands before each text, so that no run goes on into the next one.
    first = np.zeros(n, bool)
    first[0] = True
    first[ends[(ends > 0) & (ends < n)]] = True
    shift = np.cumsum(first)
    laid = np.full(n + int(shift[-1]), END, np.uint8)
    laid[np.arange(n) + shift] = symbol
    states = scan(laid)[np.arange(n) + shift]
    return OPENS[symbol, states]


#: A rank above all.
NONE = 1 << 60


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged until none is left, leftmost first.

    Short pieces, nearly all there are, keep the pairs' ranks in a list. Long ones keep pairs in a heap
    over a linked list, so that a piece of n bytes takes n log n steps.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= 40:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2], NONE) for i in range(n - 1)]
        while pairs and (least := min(pairs)) != NONE:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
        return [ranks[p] for p in parts]
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or not end[mid] or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Ranks from the content of a rank file: base64 of the bytes and the rank, a line each."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray, cached: int = 300_000):
        self.ranks, self.classes, self.cached = ranks, classes, cached
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def pieces(self, texts: list[str]) -> list[list[str]]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        starts = np.flatnonzero(boundaries(points, ends, self.classes))
        at = np.searchsorted(starts, np.r_[0, ends]).tolist()
        cuts = [*starts.tolist(), len(joined)]
        return [[joined[a:b] for a, b in zip(cuts[i:j], cuts[i + 1 : j + 1], strict=True)] for i, j in zip(at, at[1:], strict=False)]

    def _ids(self, piece: str) -> tuple[int, ...]:
        found = tuple(merge(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= 64:
            if len(self.cache) >= self.cached:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """For each text its ids, and for each piece the number of its ids."""
        out = []
        get = self.cache.get
        for own in self.pieces(texts):
            got = [get(p) or self._ids(p) for p in own]
            out.append(([i for x in got for i in x], [len(x) for x in got]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offsets at which each id's bytes start, and the end."""
        return np.cumsum([0, *(len(self.bytes_of[i]) for i in ids)])


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(ranks_of(f.read()), code_point_classes())


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Each row of ``docs``: the columns ``keep`` and what its whole text is in tokens.

    ``vocabulary`` is the path of a rank file that every worker has (part of the installation).
    ``digest=False``: ``ids`` array of int, ``offsets`` array of long (the byte at which each token
    starts, and the end) and ``decoded`` (bytes of the ids). ``digest=True``: ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256`` instead. A null text counts as empty: no tokens.
    """
    names = list(keep)
    source = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [(f.name, f.dataType.simpleString()) for f in source.select(*names).schema]
    added = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digest else [
        ("ids", "array<int>"), ("offsets", "array<bigint>"), ("decoded", "binary")]
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                texts, size, stop = [], 0, at
                while stop < n and size < 1_000_000:  # a bounded share at a time, whole texts
                    texts.append(batch.column("_text")[stop].as_py())
                    size += len(texts[-1])
                    stop += 1
                done = codec.encode(texts)
                kept = batch.slice(at, stop - at).select(names).columns
                if digest:
                    new = [
                        pa.array([len(ids) for ids, _ in done], pa.int64()),
                        pa.array([sha(" ".join(map(str, ids)).encode()) for ids, _ in done], pa.string()),
                        pa.array([sha(codec.decode(ids)) for ids, _ in done], pa.string()),
                    ]
                else:
                    new = [
                        pa.array([ids for ids, _ in done], pa.list_(pa.int32())),
                        pa.array([codec.offsets(ids).tolist() for ids, _ in done], pa.list_(pa.int64())),
                        pa.array([codec.decode(ids) for ids, _ in done], pa.binary()),
                    ]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*names, *(k for k, _ in added)])
                at = stop

    return source.mapInArrow(coded, ", ".join(f"`{k}` {t}" for k, t in [*fields, *added]))
