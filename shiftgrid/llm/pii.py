"""Personal data by boosted trees over candidate spans, DataFrame functions only on the main path.

Patterns propose overlapping spans: the base ones, and looser ones with high recall. Trees trained on
the driver over composed examples score the looser ones by format and context; each kind has its own
threshold, calibrated on formats and words that the trees never saw. Base spans always stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.trees import Node, boost, predict
from shiftgrid.llm.util import text_of

#: Base kinds in the order that breaks ties. The patterns match what the contract's do: a run is only
#: entered where it begins or a match has ended, and repeats are possessive, so long runs take no
#: quadratic time and no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates by kind: what may be personal data, or a secret, in looser formats. Kinds overlap; the trees decide.
#: Repeats are possessive and begin where a run does, so a text takes time in proportion to its length.
LOOSE = {
    "mail": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+\s?(?:@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT)\s)\s?[A-Za-z0-9-]++(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]{2,}+)++",
    "tel": r"(?<![\w.+-])(?:\+\s?)?\(?[0-9]++\)?(?:[\x20./-]{1,2}\(?[0-9]++\)?)*+(?![\w-])",
    "pan": r"(?<![\w.+-])[0-9]{4,}+(?:[\x20-][0-9]{3,}+)*+(?![\w-])",
    "ssn": r"(?<![\w.+-])[0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "passport": r"(?<![\w.+-])[A-Z]{0,2}[0-9]{6,9}[A-Z]?(?![\w-])",
    "secret": r"(?<![\w./+-])[A-Za-z0-9_/+-]{12,}+={0,2}(?!\w)",
}
#: What a text has to match for a kind to be looked for at all.
NEED = {"mail": r"(?i)@|\bat\b", "tel": "[0-9]{2}", "pan": "[0-9]{4}", "ssn": "[0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4}", "iban": "[A-Z]{2}[0-9]{2}", "passport": "[0-9]{6}",
        "secret": "(?i)token|secret|passw|pwd|key|auth|bearer|credential"}
#: Words before a span that say what it is; groups are features.
HINTS = {
    "call": r"(?i)(?<!\p{L})(?:phone|tel|telephone|call|fax|mobile|cell|handy|whatsapp|sms|ring|dial|contact|téléphone|telefon|teléfono|numéro)(?!\p{L})",
    "pay": r"(?i)(?<!\p{L})(?:card|visa|mastercard|amex|credit|debit|account|iban|bank|konto|karte|carte|tarjeta|pay)(?!\p{L})",
    "social": r"(?i)(?<!\p{L})(?:ssn|social security|tax id|taxpayer|national id|insured|insurance no)(?!\p{L})",
    "travel": r"(?i)(?<!\p{L})(?:passport|reisepass|passeport|pasaporte|travel document)(?!\p{L})",
    "write": r"(?i)(?<!\p{L})(?:e-?mail|mail|write|reach|contact|address)(?!\p{L})",
    "key": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)",
    "order": r"(?i)(?:(?<!\p{L})(?:order|invoice|isbn|issn|version|build|ticket|part|model|page|vol|no|nr|serial|sku|id|ref|year|lat|lon|commit|hash|sha|checksum|flight|room|population)(?!\p{L})|[$€£%#])",
}
#: Characters before a span that the hints are looked for in.
CONTEXT = 32
FEATURES = (*(f"is_{k}" for k in LOOSE), "digits", "length", "groups", "longest", "first_group", "last_group", "letters", "plus", "paren", "slash", "dots", "dashes", "spaces", "at", "word_at", "word_dot",
            "luhn", "year", "zero", "fours", "mixed", "hex", *HINTS)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
        F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


#: Matches that are placed together; offsets of more are placed block by block, so time grows with their number.
BLOCK = 512
_SPANS = "array<struct<start:int,end:int,kind:string,s:string,before:string>>"


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of (start, end, kind, s, before): leftmost non-overlapping matches, with up to ``CONTEXT``
    characters of what lies between the match before and this one.

    Offsets are code points, from running lengths of what lies between matches and of the matches.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr(f"struct(0 as at, cast(array() as {_SPANS}) as out)")
    placed = lambda s, by: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["s"].alias("s"), s["before"].alias("before"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["before"].alias("before")))).alias("out"))

    def of(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), none, step))
        start = F.expr(f"struct(0 as at, cast(array() as array<{_SPANS}>) as out)")
        join = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(x["out"], lambda s: placed(s, acc["at"])))).alias("out"))
        return F.flatten(F.aggregate(blocks, start, join, lambda a: a["out"]))

    short = lambda g: F.when(F.length(g) > CONTEXT, F.right(g, F.lit(CONTEXT))).otherwise(g)
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), found, lambda g, s: F.struct(F.length(g).alias("g"), s.alias("s"), short(g).alias("before")))
    return F.when(F.size(pairs) > 0, F.transform(F.array(pairs), of)[0]).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def base_spans(text: Column) -> Column:
    """All base spans that pass their kind's check."""
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    bare = lambda p: F.ltrim(p, F.lit("0"))
    octet = lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.substring(bare(p), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    checks = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["s"], r"\."), octet),
        "card": lambda s: F.length(digits(s["s"])).between(14, 19) & luhn(digits(s["s"])),
        "phone": lambda s: F.length(digits(s["s"])).between(10, 15),
    }
    need = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    empty = F.expr(f"cast(array() as {_SPANS})")
    return F.concat(*(F.when(need[k], F.filter(spans(text, k, p), checks[k])).otherwise(empty) for k, p in BASE.items()))


def rank(kind: Column) -> Column:
    names = [*BASE, *LOOSE]
    return F.array_position(F.array(*(F.lit(k) for k in names)), kind)


def in_order(found: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("r"), s["end"].alias("end"), s["kind"].alias("kind"), s["s"].alias("s")))
    return F.sort_array(keyed)


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def feature_columns(kind: Column, s: Column, before: Column) -> dict[str, Column]:
    """The features of one candidate: ``s`` its text, ``before`` what stands before it."""
    num = lambda c: c.cast("double")
    digits = F.regexp_replace(s, "[^0-9]", "")
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    without = lambda marks: num(F.length(s) - F.length(F.translate(s, marks, "")))
    out = {f"is_{k}": num(kind == k) for k in LOOSE} | {
        "digits": num(F.length(digits)), "length": num(F.length(s)), "groups": num(F.size(groups)),
        "longest": num(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))),
        "first_group": num(F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0))), "last_group": num(F.coalesce(F.length(F.element_at(F.concat(F.array(F.lit("")), groups), -1)), F.lit(0))),
        "letters": num(F.length(F.regexp_replace(s, "[^A-Za-z]", ""))),
        "plus": num(s.contains("+")), "paren": num(s.contains("(")), "slash": num(s.contains("/")), "dots": without("."), "dashes": without("-"), "spaces": without(" "),
        "at": num(s.contains("@")), "word_at": num(s.rlike(r"(?i)[\[({<]\s?at\s?[\])}>]")), "word_dot": num(s.rlike(r"(?i)[\s\[({<]dot[\s\])}>]")),
        "luhn": num(luhn(digits) & (F.length(digits) > 0)), "year": num(s.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")), "zero": num(s.rlike(r"^\(?0")),
        "fours": num(s.rlike(r"^[0-9]{4}(?:[ -][0-9]{4})+$")), "mixed": num(s.rlike("[0-9]") & s.rlike("[A-Za-z]")), "hex": num(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
    }
    return out | {k: num(before.rlike(p)) for k, p in HINTS.items()}


def examples(n: int, seed: int, held_out: bool) -> list[tuple[str, str, str]]:
    """Composed examples: (kind or "" if not personal, text before, span), from formats with drawn digits and words.

    The formats and words of ``held_out`` are others than those that the trees learn from.
    """
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    sound = ("dfghjkmprvz", "aeiouy") if held_out else ("bcdfglmnprst", "aeiou")
    word = lambda: "".join(pick(list(sound[0])) + pick(list(sound[1])) for _ in range(int(rng.integers(2, 4))))
    chars = lambda k, of: "".join(pick(list(of)) for _ in range(k))
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def valid_luhn(k: int) -> str:
        body = num(k - 1)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    side = lambda learnt, other: other if held_out else learnt
    talk = lambda hints: f"{word()} {pick(hints)}{pick(side([' ', ' is ', ' no: ', ': '], [' ', ' number ', '. ', ' - ', ': ']))}"
    call, pay = side(["phone", "tel", "call", "mobile", "fax", "telefon"], ["telephone", "cell", "Tel", "dial", "contact", "téléphone"]), side(["card", "visa", "account"], ["credit card", "mastercard", "Konto", "amex"])
    social, travel = side(["ssn", "social security"], ["SSN", "national id", "tax id"]), side(["passport", "reisepass"], ["Passport", "passeport", "travel document"])
    write, key = side(["email", "mail", "contact"], ["e-mail", "write", "reach"]), side(["token =", 'secret: "', "api_key=", "password ="], ["access_key :", "auth token", "Bearer", "client_secret='", "apikey="])
    other = side(["order", "invoice", "isbn", "version", "ticket", "model", "page", "serial", "year", "ref"], ["order no", "build", "sku", "part", "vol", "id", "issn", "year"])
    ids = side(["commit", "hash"], ["sha", "checksum"])
    plain = lambda: f"{word()} {word()} "
    dot, at = side([" dot ", " [dot] ", "(dot)", "."], [" (dot) ", "[dot]", " dot ", "."]), side([" [at] ", "(at)", "[at]", " @ "], [" (at) ", " {at} ", " <at> ", "(AT)"])
    yes = side([
        lambda: ("tel", talk(call), f"({num(3)}) {num(3)}-{num(4)}"), lambda: ("tel", talk(call), f"{num(3)}-{num(3)}-{num(4)}"), lambda: ("tel", talk(call), f"{num(3)}.{num(3)}.{num(4)}"),
        lambda: ("tel", plain(), f"({num(3)}) {num(3)}-{num(4)}"), lambda: ("tel", talk(call), f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"), lambda: ("tel", talk(call), f"0{num(3)} {num(6)}"),
        lambda: ("tel", talk(call), f"0{num(3)}/{num(6)}"), lambda: ("tel", talk(call), num(10)), lambda: ("tel", talk(call), f"0{num(2)}-{num(8)}"), lambda: ("tel", talk(call), f"+{num(2)} {num(3)} {num(4)}"),
        lambda: ("ssn", talk(social), f"{num(3)}-{num(2)}-{num(4)}"), lambda: ("ssn", plain(), f"{num(3)}-{num(2)}-{num(4)}"), lambda: ("ssn", talk(social), num(9)), lambda: ("passport", talk(travel), num(9)), lambda: ("passport", talk(travel), f"{chars(1, 'ABCKLMNP')}{num(8)}"),
        lambda: ("pan", talk(pay), " ".join([num(4)] * 4)), lambda: ("pan", talk(pay), f"{num(4)} {num(4)} {num(4)} {num(4)}"), lambda: ("pan", talk(pay), valid_luhn(16)), lambda: ("pan", talk(pay), num(16)), lambda: ("pan", plain(), f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"),
        lambda: ("iban", plain(), f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}"), lambda: ("iban", talk(pay), f"FR{num(2)}{num(20)}"), lambda: ("iban", plain(), f"GB{num(2)} {chars(4, 'ABCDEHKMNW')} {num(4)} {num(4)} {num(4)} {num(2)}"),
        lambda: ("mail", plain(), f"{word()}.{word()}{pick(at)}{word()}{pick(dot)}{pick(['com', 'org', 'net', 'de'])}"), lambda: ("mail", talk(write), f"{word()}{pick([' at ', *at])}{word()}{pick([' dot ', ' [dot] '])}{pick(['com', 'org', 'net'])}"),
        lambda: ("secret", plain() + pick(key), chars(40, "0123456789abcdef")), lambda: ("secret", plain() + pick(key), chars(24, mixed)), lambda: ("secret", plain() + pick(key) + pick(["", " "]), chars(int(rng.integers(12, 22)), mixed)), lambda: ("secret", plain() + pick(key), f"sk_{chars(28, mixed)}"),
    ], [
        lambda: ("tel", talk(call), f"{num(3)} {num(3)} {num(4)}"), lambda: ("tel", talk(call), f"0{num(3)} {num(7)}"), lambda: ("tel", talk(call), f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}"), lambda: ("tel", talk(call), f"0{num(4)} {num(3)} {num(3)}"),
        lambda: ("tel", talk(call), f"1-{num(3)}-{num(3)}-{num(4)}"), lambda: ("tel", talk(call), f"0{num(2)} / {num(4)} {num(4)}"), lambda: ("tel", plain(), f"({num(3)}){num(3)}-{num(4)}"), lambda: ("tel", talk(call), f"0{num(9)}"),
        lambda: ("ssn", talk(social), f"{num(3)} {num(2)} {num(4)}"), lambda: ("ssn", talk(social), f"{num(3)}-{num(2)}-{num(4)}"), lambda: ("ssn", plain(), f"{num(3)}-{num(2)}-{num(4)}"), lambda: ("passport", talk(travel), f"{chars(2, 'ABXYZ')}{num(7)}"), lambda: ("passport", talk(travel), num(9)),
        lambda: ("pan", talk(pay), f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"), lambda: ("pan", talk(pay), f"{num(4)} {num(6)} {num(5)}"), lambda: ("pan", talk(pay), num(15)), lambda: ("pan", talk(pay), f"{num(4)} {num(4)} {num(4)} {num(4)}"),
        lambda: ("iban", talk(pay), f"NL{num(2)} {chars(4, 'ABINGR')} {num(4)} {num(4)} {num(2)}"), lambda: ("iban", plain(), f"ES{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(4)}"), lambda: ("iban", plain(), f"IT{num(2)}{chars(1, 'XKL')}{num(22)}"),
        lambda: ("mail", talk(write), f"{word()}_{word()}{pick(at)}{word()}{pick(dot)}{pick(['com', 'fr', 'io'])}"), lambda: ("mail", plain(), f"{word()}{num(2)}{pick(at)}{word()}{pick(dot)}{pick(['edu', 'es'])}"),
        lambda: ("secret", plain() + pick(key), chars(32, "0123456789abcdef")), lambda: ("secret", plain() + pick(key), f"ghp_{chars(36, mixed)}"), lambda: ("secret", plain() + pick(key), chars(20, mixed + "_-")),
    ])
    no = side([
        lambda: ("", plain(), f"{num(4)}-{num(2)}-{num(2)}"), lambda: ("", talk(other), f"{num(2)}.{num(2)}.{num(4)}"), lambda: ("", plain(), f"20{num(2)}/20{num(2)}"), lambda: ("", plain(), f"19{num(2)}-20{num(2)}"),
        lambda: ("", talk(other), num(int(rng.integers(6, 20)))), lambda: ("", plain(), num(int(rng.integers(6, 20)))), lambda: ("", talk(other), f"978-{num(2)}-{num(5)}-{num(2)}"), lambda: ("", plain(), f"{num(2)} {num(3)} {num(3)}"),
        lambda: ("", talk(other), f"{num(3)}-{num(3)}-{num(4)}"), lambda: ("", plain(), f"{num(2)}.{num(3)}.{num(3)}"), lambda: ("", plain(), f"{num(2)}/{num(2)}/{num(4)}"), lambda: ("", plain(), f"{num(3)} {num(2)}"), lambda: ("", plain(), f"{num(4)}.{num(4)}"),
        lambda: ("", plain(), f"{word()} at {word()}.{word()}"), lambda: ("", talk(other), f"{word()} at {word()}.{word()}"), lambda: ("", plain(), f"{num(4)} {num(4)}"), lambda: ("", talk(other), f"{num(2)}.{num(2)}.{num(2)}"),
        lambda: ("", plain(), f"AB{num(2)} {word().upper()[:4]} {word().upper()[:4]}"), lambda: ("", plain(), f"{num(3)}-{num(4)}"), lambda: ("", plain(), f"{num(2)}.{num(2)}"), lambda: ("", plain(), f"{word()} at {word()} dot{word()}.{word()}"),
        lambda: ("", plain(), f"{num(3)}.{num(3)}.{num(3)}.{num(3)}"), lambda: ("", plain(), f"{num(2)}.{num(2)}.{num(3)}.{num(2)}"), lambda: ("", plain(), f"{chars(2, 'ABCDEF')}{num(6)}"), lambda: ("", plain(), " ".join(num(int(rng.integers(1, 4))) for _ in range(5))),
        lambda: ("", f"{word()} {pick(ids)} ", chars(40, "0123456789abcdef")), lambda: ("", plain(), chars(32, "0123456789abcdef")), lambda: ("", plain(), "".join(word() for _ in range(4))), lambda: ("", plain() + "key ", "-".join(word() for _ in range(4))),
        lambda: ("", plain() + "$", f"{num(2)} {num(3)}"), lambda: ("", talk(call), num(3)), lambda: ("", talk(pay), num(4)), lambda: ("", talk(call), f"20{num(2)}"), lambda: ("", plain() + pick(key), "".join(word() for _ in range(4))),
    ], [
        lambda: ("", plain(), f"{num(2)}-{num(2)}-{num(4)}"), lambda: ("", talk(other), f"{num(4)}/{num(2)}/{num(2)}"), lambda: ("", plain(), f"{num(1)}.{num(2)}.{num(3)}"), lambda: ("", plain(), f"{num(2)}:{num(2)}"),
        lambda: ("", talk(other), f"{num(4)}-{num(4)}"), lambda: ("", plain(), f"{num(3)} {num(3)} {num(3)}"), lambda: ("", talk(other), num(int(rng.integers(7, 18)))), lambda: ("", plain(), num(int(rng.integers(7, 18)))),
        lambda: ("", plain() + "€", f"{num(3)} {num(3)}"), lambda: ("", talk(other), f"{num(1)}-{num(4)}-{num(4)}-{num(1)}"), lambda: ("", plain(), f"{num(2)}.{num(4)}, "), lambda: ("", plain(), f"19{num(2)} 20{num(2)}"),
        lambda: ("", plain(), f"{word()} at {word()}.{word()}"), lambda: ("", plain(), f"{word()} at {word()}.{pick(['then', 'there', 'when'])}"), lambda: ("", plain(), f"{chars(1, 'GHJK')}{num(7)}"), lambda: ("", talk(other), f"{chars(2, 'XYZ')}{num(6)}"),
        lambda: ("", f"{word()} {pick(ids)} ", chars(64, "0123456789abcdef")), lambda: ("", plain(), chars(24, "0123456789abcdef")), lambda: ("", plain() + "keyboard ", "".join(word() for _ in range(5))), lambda: ("", plain(), f"{num(1)} {num(1)} {num(2)} {num(2)}"),
        lambda: ("", plain(), f"CD{num(2)} {word().upper()[:4]} {word().upper()[:4]}"), lambda: ("", talk(call), num(2)), lambda: ("", talk(pay), f"20{num(2)}"), lambda: ("", plain() + "secret ", "".join(word() for _ in range(5))), lambda: ("", plain(), f"{num(3)}.{num(3)}.{num(3)}"),
    ])
    return [pick(yes if k % 2 else no)() for k in range(n)]


@dataclass(frozen=True)
class SpanModel:
    """Trees, and for each kind the logit from which a span is taken (none: never)."""

    base: float
    trees: tuple[Node, ...]
    least: dict[str, float]

    def logit(self, x: Column) -> Column:
        """``x``: an array of the features, in order."""
        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(x[node.feature] <= node.threshold, of(node.left)).otherwise(of(node.right))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total


_MODEL: list[SpanModel] = []


def _told(spark, rows: list[tuple[str, str, str]]):
    """Features of every kind's candidates in composed examples, by the expressions that scoring uses;
    whether each is of its example's kind; their kinds."""
    got = spark.createDataFrame(rows, "own string, before string, s string")
    whole = lambda k, p: F.struct(F.lit(k).alias("kind"), F.regexp_extract("s", p, 0).alias("s"))
    cands = got.select("own", "before", F.explode(F.array(*(whole(k, p) for k, p in LOOSE.items()))).alias("c")).where("c.s <> ''")
    x = F.array(*feature_columns(F.col("c.kind"), F.col("c.s"), F.col("before")).values())
    out = cands.select((F.col("own") == F.col("c.kind")).alias("y"), "c.kind", x.alias("x")).toPandas()
    return np.stack(out["x"].to_numpy()).astype(float), out["y"].to_numpy(float), out["kind"].to_numpy()


def fit(spark, precision: float = 0.98, against: float = 3.0) -> SpanModel:
    """Trees on composed examples; per kind the lowest logit whose precision from there on is at least
    ``precision`` on held-out formats, where what is not personal counts ``against`` times, as there is more
    of it in texts. The threshold lies halfway to the next example below. Fitted once a process."""
    if _MODEL:
        return _MODEL[0]
    x, y, _ = _told(spark, examples(9_000, 3, False))
    base, trees = boost(x, y, n_trees=40, depth=4, rate=0.3)
    x, y, kinds = _told(spark, examples(9_000, 4, True))
    z = predict(base, trees, x)
    least = {}
    for kind in LOOSE:
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(-z[own], kind="stable")]
        good = np.cumsum(y[own])
        ok = np.flatnonzero((good >= precision * (good + against * np.cumsum(1 - y[own]))) & (np.r_[z[own][1:], -np.inf] < z[own]))
        if len(ok) and good[ok[-1]] >= 10:
            k = ok[-1]
            least[kind] = float(z[own[k]] + (z[own[k + 1]] if k + 1 < len(own) else z[own[k]])) / 2
    _MODEL.append(SpanModel(base, tuple(trees), least))
    return _MODEL[0]


#: What a redacted span of a kind is called, other kinds by their own name.
CALLED = {"mail": "email", "tel": "phone", "pan": "card"}


_KEPT = "array<struct<start:int,end:int,kind:string,s:string>>"


def _apart(base: Column, loose: Column) -> Column:
    """Of candidates with margins those that overlap no base span and no candidate of a larger margin, by one
    sweep over all of them by start."""
    kind = "struct<start:int,m:double,end:int,kind:string,s:string>"
    as_ = lambda s, m: F.struct(s["start"].alias("start"), m.alias("m"), s["end"].alias("end"), s["kind"].alias("kind"), s["s"].alias("s"))
    every = F.sort_array(F.concat(F.transform(base, lambda s: as_(s, F.lit(float("inf")))), F.transform(loose, lambda s: as_(s, s["m"]))))
    start = F.expr(f"struct(cast(struct(-1, double('inf'), -1, '', '') as {kind}) as open, cast(array() as array<{kind}>) as out)")
    shut = lambda acc: F.when(acc["open"]["m"] < float("inf"), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        o = acc["open"]
        beyond, wins = x["start"] >= o["end"], x["m"] > o["m"]
        # Of base spans that overlap, the one that reaches further stands for both.
        longer = (x["m"] == o["m"]) & (x["end"] > o["end"])
        return F.struct(F.when(beyond | wins | longer, x).otherwise(o).alias("open"), F.when(beyond, shut(acc)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(loose) == 0, F.expr(f"cast(array() as {_KEPT})")).otherwise(
        F.transform(F.aggregate(every, start, step, shut), lambda s: F.struct(*(s[k].alias(k) for k in ("start", "end", "kind", "s")))))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_all``: arrays of (start, r, end, kind, s) in order.

    Spans that the model adds have kinds of their own (those of ``LOOSE``) and overlap neither base spans
    nor each other: of candidates that do, the one furthest above its kind's threshold is taken.
    """
    model = fit(docs.sparkSession)
    t = text_of(text)
    out = docs.withColumn("_base", in_order(base_spans(t)))
    empty = F.expr(f"cast(array() as {_SPANS})")
    loose = F.concat(*(F.when(t.rlike(NEED[k]), spans(t, k, p)).otherwise(empty) for k, p in LOOSE.items() if k in model.least))
    least = F.create_map(*(F.lit(v) for kv in model.least.items() for v in kv))

    def told(s: Column) -> Column:
        return F.struct(s.alias("s"), F.array(*feature_columns(s["kind"], s["s"], s["before"]).values()).alias("x"))

    def scored(e: Column) -> Column:
        m = model.logit(e["x"]) - F.element_at(least, e["s"]["kind"])
        return F.struct(m.alias("m"), *(e["s"][k].alias(k) for k in ("start", "end", "kind", "s")))

    # Features are computed once a candidate, not once a node. Runs of few or very many digits are never personal.
    digits = lambda s: F.length(F.regexp_replace(s["s"], "[^0-9]", ""))
    likely = F.filter(loose, lambda s: s["kind"].isin("mail", "secret", "iban") | digits(s).between(6, 19))
    out = out.withColumn("_loose", F.filter(F.transform(F.transform(likely, told), scored), lambda s: s["m"] >= 0))
    kept = _apart(F.col("_base"), F.col("_loose"))
    return out.withColumn("_all", in_order(F.concat(F.transform("_base", lambda b: F.struct(*(b[k].alias(k) for k in ("start", "end", "kind", "s")))), kept))).drop("_loose")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans by kind, base_sha256, spans.

    A null text is empty: no spans, the digest of an empty string. Rows are treated each for itself,
    without a shuffle; offsets are code points of the whole text, ends exclusive.
    """
    out = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, ``n_chars`` the new length.

    Overlapping spans are replaced together, under the first one's kind. A null text stays null.
    """
    out = with_spans(docs)
    t = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    called = F.create_map(*(F.lit(v) for kv in ({k: k for k in [*BASE, *LOOSE]} | CALLED).items() for v in kv))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(F.element_at(called, s["kind"])), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece, mark)).otherwise(acc["out"]).alias("out"))

    end = lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.greatest(F.length(t) - a["at"], F.lit(0))))
    clean = F.when(t.isNull() | (F.size("_all") == 0), t).otherwise(F.aggregate("_all", start, step, end))
    names = docs.columns
    out = out.withColumn("text", clean)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("_all") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)
