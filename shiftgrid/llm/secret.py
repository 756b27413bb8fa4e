"""Secrets in texts: base patterns, and candidates scored by automata inferred from labelled credentials.

An automaton a kind is inferred from labelled credentials of that kind (``grammar``), one more from tokens
that are none. Every candidate of a text, whatever it looks like, is scored: a kind's margin is the log of its
likelihood over that of no credential, less the kind's threshold, set on held-out tokens.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.grammar import Automaton

#: Base kinds in the order that breaks ties.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: A text without one of these, lower-cased, has no ``assign`` match.
_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
#: The least characters of a group or match that count.
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Characters of candidates; up to two signs of padding may follow. The least characters of one.
_TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-"
CANDIDATE = 16
#: Kinds that the method adds.
KINDS = ("aws_id", "aws_key", "github", "gitlab", "slack", "stripe", "google", "jwt", "npm", "sendgrid", "pypi")

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM = UPPER + LOWER + DIGIT


def labelled(n: int, seed: int) -> list[tuple[str, str]]:
    """Labelled tokens: (kind, credential), or (family after a "-", what is none), ``n`` a kind and 2 ``n`` a family.

    Formats are publicly documented; all other characters are drawn.
    """
    rng = np.random.default_rng(seed)
    chars = lambda of, k: "".join(of[i] for i in rng.integers(0, len(of), int(k)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    many = lambda a, b: int(rng.integers(a, b + 1))
    url64 = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    syllables = ["ba", "co", "der", "el", "fi", "ga", "hen", "in", "jo", "kel", "lo", "mi", "na", "or", "pre", "qui", "re", "sa", "ti", "un", "ver", "wa", "xi", "yo", "ze",
                 "tion", "ment", "sch", "ich", "ung", "eur", "que", "the", "and", "ing", "ble", "est", "ana", "ade", "os", "as", "en", "er", "on", "at", "th", "st", "au", "ei"]
    word = lambda a=2, b=4: "".join(pick(syllables) for _ in range(many(a, b)))
    cap = lambda: word().capitalize()
    claims = lambda: {pick(["sub", "iss", "aud", "name", "jti"]): word(), "iat": many(10**9, 2 * 10**9), "exp": many(10**9, 2 * 10**9)}
    made = {
        "aws_id": lambda: pick(["AKIA", "ASIA"]) + chars(UPPER + "234567", 16),
        "aws_key": lambda: chars(ALNUM + "+/", 40),
        "github": lambda: pick(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]) + chars(ALNUM, 36) if rng.random() < 0.8 else f"github_pat_{chars(ALNUM, 22)}_{chars(ALNUM, 59)}",
        "gitlab": lambda: "glpat-" + chars(ALNUM + "_-", 20),
        "slack": lambda: f"{pick(['xoxb', 'xoxp', 'xoxa'])}-{chars(DIGIT, many(10, 12))}-{chars(DIGIT, many(10, 12))}-{chars(ALNUM, 24)}",
        "stripe": lambda: pick(["sk_live_", "rk_live_", "sk_test_"]) + chars(ALNUM, pick([24, 24, 34, 99])),
        "google": lambda: "AIza" + chars(ALNUM + "_-", 35),
        "jwt": lambda: f"{url64({'alg': pick(['HS256', 'RS256', 'ES256']), 'typ': 'JWT'})}.{url64(claims())}.{chars(ALNUM + '_-', pick([43, 86]))}",
        "npm": lambda: "npm_" + chars(ALNUM, 36),
        "sendgrid": lambda: f"SG.{chars(ALNUM + '_-', 22)}.{chars(ALNUM + '_-', 43)}",
        "pypi": lambda: "pypi-AgEIcHlwaS5vcmc" + chars(ALNUM + "_-", many(120, 170)),
    }
    plain = {
        "word": [lambda: word(5, 9), lambda: word(5, 8).capitalize(), lambda: word(4, 8).upper(), lambda: word(4, 7) + pick([".", "...", "--", "-"]), lambda: chars(LOWER, many(16, 24)), lambda: pick("-_./+abcxZ0") * many(16, 40)],
        "code": [lambda: chars(UPPER, many(16, 40)), lambda: f"{word().upper()}-{chars(DIGIT, many(2, 6))}-{chars(UPPER, 3)}", lambda: f"{chars(UPPER, 2)}{chars(DIGIT, many(6, 10))}-{chars(UPPER, many(3, 8))}", lambda: f"{chars(UPPER, 4)}-{chars(UPPER, 4)}-{chars(UPPER, 4)}-{chars(UPPER, 4)}"],
        "name": [lambda: "-".join(word() for _ in range(many(2, 5))), lambda: "_".join(word() for _ in range(many(2, 6))), lambda: "_".join(word().upper() for _ in range(many(2, 5))), lambda: ".".join(word() for _ in range(many(2, 4))),
                 lambda: f"{word()}.{word()}{chars(DIGIT, 2)}.{word()}", lambda: f"{word()}_{word()}{chars(DIGIT, many(1, 3))}_{word()}"],
        "camel": [lambda: word(1, 2) + "".join(cap() for _ in range(many(2, 5))), lambda: "".join(cap() for _ in range(many(2, 5))) + pick(["", chars(DIGIT, many(1, 4))]), lambda: f"{cap()}{chars(DIGIT, many(1, 3))}{cap()}-{cap()}", lambda: f"{cap()}-{cap()}-{cap()}"],
        "place": [lambda: f"www.{word()}-{word()}.{pick(['com', 'org', 'de', 'fr', 'es'])}", lambda: f"{word()}{chars(DIGIT, many(1, 3))}.{word()}.{pick(['com', 'net'])}", lambda: "/" + "/".join(word(1, 3) for _ in range(many(2, 6))), lambda: f"//www.{word()}.com/{word()}/{word()}-{word()}{pick(['', '.html', '/'])}",
                  lambda: f"{word()}/{word()}_{chars(DIGIT, many(1, 5))}.{pick(['py', 'txt', 'csv', 'json'])}", lambda: f"/{cap()}/{cap()}{chars(DIGIT, 2)}/{word()}.{pick(['jpg', 'png', 'pdf'])}", lambda: f"{word()}-{many(0, 9)}.{many(0, 20)}.{many(0, 9)}-{pick(['linux', 'win', 'py3'])}-x86_64", lambda: f"v{many(0, 9)}.{many(0, 30)}.{many(0, 9)}-{pick(['alpha', 'beta', 'rc'])}.{many(1, 9)}"],
        "number": [lambda: chars(DIGIT, many(14, 24)), lambda: f"{chars(DIGIT, 4)}-{chars(DIGIT, 2)}-{chars(DIGIT, 2)}T{chars(DIGIT, 6)}", lambda: f"{chars(DIGIT, 4)}-{chars(DIGIT, 4)}-{chars(DIGIT, 4)}-{chars(DIGIT, 4)}", lambda: ".".join(chars(DIGIT, many(1, 4)) for _ in range(many(4, 7))),
                   lambda: f"+{chars(DIGIT, 2)}-{chars(DIGIT, 3)}-{chars(DIGIT, 3)}-{chars(DIGIT, 4)}", lambda: f"{chars(DIGIT, 3)}-{chars(DIGIT, 1)}-{chars(DIGIT, 2)}-{chars(DIGIT, 6)}-{chars(DIGIT, 1)}"],
        "digest": [lambda: chars("0123456789abcdef", pick([16, 20, 24, 28, 32, 40, 64])), lambda: "-".join(chars("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))],
        "DIGEST": [lambda: chars("0123456789ABCDEF", pick([16, 20, 24, 28, 32, 40, 64])), lambda: "-".join(chars("0123456789ABCDEF", k) for k in (8, 4, 4, 4, 12))],
    }
    out = [(kind, made[kind]()) for kind in KINDS for _ in range(n)]
    for family, of in plain.items():
        some = ((of[k % len(of)])() for k in range(100 * n))
        out += [(f"-{family}", s) for s, _ in zip((s for s in some if len(s) >= CANDIDATE - 4), range(2 * n), strict=False)]
    return out


def _packed(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(strings).encode("ascii"), np.uint8), np.array([len(s) for s in strings], np.int64)


@dataclass(frozen=True)
class Model:
    """An automaton a kind, one a family of what is no credential, and each kind's least log of likelihood over theirs."""

    kinds: dict[str, Automaton]
    none: tuple[Automaton, ...]
    least: dict[str, float]

    def ratios(self, chars: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        """By kind the log of each string's likelihood over the greatest that a family gives it."""
        none = np.max([a.likelihood(chars, lengths) for a in self.none], 0)
        return {k: a.likelihood(chars, lengths) - none for k, a in self.kinds.items()}

    def margins(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A column a kind: how far each string lies above the kind's threshold."""
        return np.stack([r - self.least[k] for k, r in self.ratios(chars, lengths).items()], 1)


@lru_cache(maxsize=1)
def fit(n: int = 200) -> Model:
    """Automata from ``n`` labelled credentials a kind and twice as many others a family; thresholds from as many again,
    halfway between the lowest twentieth of the kind's own and the highest of what is none, or 20 above the latter if that
    is less. A kind whose own do not lie above is left out."""
    own: dict[str, list[str]] = {}
    for kind, s in labelled(n, 11):
        own.setdefault(kind, []).append(s)
    made = {k: Automaton(v) for k, v in own.items()}
    model = Model({k: made[k] for k in KINDS}, tuple(a for k, a in made.items() if k not in KINDS), {})
    held = labelled(n, 12)
    names = np.array([k for k, _ in held])
    ratios = model.ratios(*_packed([s for _, s in held]))
    none = np.char.startswith(names, "-")
    least = {}
    for k, ratio in ratios.items():
        low, high = float(np.quantile(ratio[names == k], 0.05)), float(ratio[none].max())
        if low > high:
            least[k] = min((low + high) / 2, high + 20)
    return Model({k: model.kinds[k] for k in least}, model.none, least)


def _class_table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_IS_TOKEN, _IS_HEX = _class_table(_TOKEN), _class_table(b"0123456789abcdef")
_EDGE = _class_table(b"+/_.-")


def stretches(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values of ``least`` or more."""
    turn = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    start, end = turn[::2], turn[1::2]
    long = end - start >= least
    return start[long], end[long]


def candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal stretches of token characters, without signs at their edges, of ``CANDIDATE`` or more."""
    start, end = stretches(_IS_TOKEN[data], CANDIDATE)
    if not len(start):
        return start, end
    solid = np.flatnonzero(~_EDGE[data])  # where a stretch may begin or end
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    some = i <= j
    start, end = solid[i[some]], solid[j[some]] + 1
    long = end - start >= CANDIDATE
    return start[long], end[long]


def base_spans(data: bytes, flat: np.ndarray, texts: list[bytes], first: np.ndarray) -> list[tuple[int, str, int]]:
    """(start, kind, end) of base spans, in bytes of ``data``: ``texts`` after each other with a line feed between."""
    out = []
    for raw, at in zip(texts, first.tolist(), strict=True):
        low = raw.lower()
        if any(w in low for w in _WORDS):
            out += [(at + m.start(), "assign", at + m.end()) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= LEAST["assign"]]
    out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= LEAST["access"]]
    start, end = stretches(_IS_HEX[flat], LEAST["hex"])
    return out + [(a, "hex", b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def added_spans(data: np.ndarray, base: list[tuple[int, str, int]], model: Model) -> list[tuple[int, str, int]]:
    """Candidates that overlap no base span and lie above a kind's threshold, as the kind furthest above its own."""
    start, end = candidates(data)
    if len(start) and base:
        at = np.array([(a, b) for a, _, b in base], np.int64)
        at = at[np.argsort(at[:, 0], kind="stable")]
        reach = np.maximum.accumulate(at[:, 1])
        k = np.searchsorted(at[:, 0], end) - 1  # the last base span that begins before the candidate's end
        free = (k < 0) | (reach[np.maximum(k, 0)] <= start)
        start, end = start[free], end[free]
    if not len(start) or not model.kinds:
        return []
    size = end - start
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    margin = model.margins(data[np.repeat(start, size) + place], size)
    best = margin.argmax(1)
    names = list(model.kinds)
    out = []
    for i in np.flatnonzero(margin[np.arange(len(best)), best] >= 0).tolist():
        a, b = int(start[i]), int(end[i])
        pad = data[b : b + 2].tobytes()
        out.append((a, names[best[i]], b + (2 if pad == b"==" else 1 if pad[:1] == b"=" else 0)))
    return out


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of ``docs``: the columns ``keep`` and ``spans``, an array of (start, end, kind, base), by start, then
    kind as listed in ``BASE`` and ``KINDS``, then end; code points of the whole text, ends exclusive.

    Base spans always stand; those that the method adds overlap none of them. A null or empty text has none. Rows are
    treated each for itself, repeated rows alike, without a shuffle; other columns are neither read nor returned.
    """
    names = list(keep)
    source = docs.select(*names, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    fields = [(f.name, f.dataType.simpleString()) for f in source.select(*names).schema]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
    rank = {k: i for i, k in enumerate((*BASE, *KINDS))}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit()
        for batch in batches:
            at, n, whole = 0, batch.num_rows, batch.column("_text")
            while at < n:
                texts, size, stop = [], 0, at
                while stop < n and size < 4_000_000:  # a bounded share at a time, whole texts
                    texts.append(whole[stop].as_py())
                    size += len(texts[-1])
                    stop += 1
                data = b"\n".join(texts)
                flat = np.frombuffer(data, np.uint8)
                ends = np.cumsum([len(t) + 1 for t in texts])
                first = ends - [len(t) + 1 for t in texts]
                base = base_spans(data, flat, texts, first)
                every = [(*s, True) for s in base] + [(*s, False) for s in added_spans(flat, base, model)]
                rows: list[list] = [[] for _ in texts]
                for a, k, b, own in every:
                    rows[int(np.searchsorted(ends, a, side="right"))].append((a, rank[k], b, k, own))
                for i, spans in enumerate(rows):
                    if spans:
                        rows[i] = _placed(sorted(spans), flat[first[i] : ends[i]], int(first[i]))
                kept = batch.slice(at, stop - at).select(names).columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, kind)], names=[*names, "spans"])
                at = stop

    return source.mapInArrow(scanned, ", ".join(f"`{k}` {t}" for k, t in [*fields, ("spans", "array<struct<start:int,end:int,kind:string,base:boolean>>")]))


def _placed(spans: list[tuple], own: np.ndarray, first: int) -> list[dict]:
    """Spans by code points of their text: bytes less those that continue a character."""
    more = np.r_[0, np.cumsum((own & 0xC0) == 0x80)]
    return [{"start": a - first - int(more[a - first]), "end": b - first - int(more[b - first]), "kind": k, "base": is_base} for a, _, b, k, is_base in spans]


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap are replaced together,
    under the first one's kind. A null text stays null, and a row without spans as it is."""
    names = docs.columns
    own = [f"_{i}" for i in range(len(names))]
    found = scan(docs.toDF(*own), own[names.index(text)], tuple(own)).toDF(*names, "_spans")
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    end = lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t)))
    clean = F.when(t.isNull() | (F.size("_spans") == 0), t).otherwise(F.aggregate("_spans", start, step, end))
    return found.withColumn(text, clean).select(*names)
