"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown over statistics of labelled texts; every path in them is a conjunctive rule;
a lasso logistic regression keeps few rules; these are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.trees import boost, paths
from shiftgrid.llm.util import hash_sample, text_of

#: Fixed: rows whose crc32(doc_id as text) mod this is 0 are held out.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is never learnt from. A null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _counts(text: Column) -> Column:
    """What is counted in a whole text, each thing in one scan, as a struct. All JVM-side.

    Characters of a class are counted by what is left without their runs: a scan pays for each match.
    """
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    chars = lambda run: F.length(text) - F.length(F.regexp_replace(text, run, ""))
    without = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))
    named = {
        "chars": F.length(text), "words": count(r"\S+"), "tokens": F.size(F.split(text, " ")), "kinds": F.size(F.array_distinct(F.split(text, " "))),
        "lines": F.size(F.split(text, "\n")), "line_kinds": F.size(F.array_distinct(F.split(text, "\n"))),
        "upper": chars(r"\p{Lu}+"), "letters": chars(r"\p{L}+"), "digits": chars(r"\p{Nd}+"), "symbols": chars(r"[^\p{L}\p{N}\s.,!?'\-]+"),
        "doubled": count(r"([^\p{L}\p{N}\s])\1"), "repeats": count(r"[!?*#%$&=_~.-]{2,}"), "bangs": without("!?"), "stops": without(".,"),
    }
    return F.struct(*(c.cast("double").alias(k) for k, c in named.items()))


def _statistics(n: Column) -> dict[str, Column]:
    """Statistics of a text from its counts; shares of nothing are 0."""
    share = lambda k, of: F.when(n[of] > 0, n[k] / n[of]).otherwise(0.0)
    return {"words": n["words"], "word_length": share("chars", "words")} | {k: share(k, "chars") for k in ("upper", "letters", "digits")} | {
        k: share(k, "words") for k in ("symbols", "doubled", "repeats", "bangs", "stops")} | {
        "distinct": share("kinds", "tokens"), "new_lines": share("line_kinds", "lines"), "line_words": share("words", "lines")}


#: The statistics by name, in the order of a model's features.
NAMES = ("words", "word_length", "upper", "letters", "digits", "symbols", "doubled", "repeats", "bangs", "stops", "distinct", "new_lines", "line_words")


def _once(counts: Column, f) -> Column:
    """``f`` of the counts, bound to a lambda's variable: however often ``f`` names them, and wherever a
    filter on the result is pushed to, a text is scanned once, and the generated code stays small."""
    return F.transform(F.array(counts), f)[0]


@dataclass(frozen=True)
class RuleModel:
    """``weights[i]`` belongs to ``rules[i]``, a tuple of (statistic, threshold, above)."""

    names: tuple[str, ...]
    bias: float
    rules: tuple[tuple[tuple[int, float, bool], ...], ...]
    weights: tuple[float, ...]

    def score(self, stats: dict[str, Column]) -> Column:
        """The ensemble over columns of statistics."""
        terms = [F.lit(self.bias)]
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [(stats[self.names[f]] > t) if above else (stats[self.names[f]] <= t) for f, t, above in rule]
            terms.append(F.when(reduce(and_, tests), weight).otherwise(0.0))
        while len(terms) > 1:  # in pairs: a sum of hundreds one after the other is a deep tree to plan
            terms = [reduce(add, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss plus ``penalty`` times the L1 norm, bias free."""
    n, y = len(y), y.astype(np.float32)
    step = 4 * n / max(float(np.linalg.eigvalsh((z.T @ z).astype(float))[-1]) + n, 1e-9)
    w, bias = np.zeros(z.shape[1], np.float32), 0.0
    v, v_bias, t = w, bias, 1.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(z @ v + v_bias, -30, 30))) - y
        new, new_bias = v - step * (z.T @ off) / n, v_bias - step * float(off.mean())
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        by = np.float32((t - 1) / t_new)
        v, v_bias = new + by * (new - w), new_bias + float(by) * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return bias, w


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], penalty: float = 2e-4) -> RuleModel:
    """Rules of boosted trees with lasso weights. Without both classes the model is a constant."""
    if len(y) == 0 or y.min() == y.max():
        mean = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(names, float(np.log(mean / (1 - mean))), (), ())
    _, trees = boost(x, y, n_trees=40, depth=3, rate=0.3)
    rules = list(dict.fromkeys(p for t in trees for p in paths(t)))
    z = np.empty((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        z[:, j] = True
        for f, t, above in rule:
            z[:, j] &= (x[:, f] > t) if above else (x[:, f] <= t)
    bits = np.packbits(z, axis=0)
    first = list({bits[:, j].tobytes(): j for j in reversed(range(len(rules)))}.values())[::-1]  # rules that hold on the same rows are one
    bias, w = _lasso(z[:, first].astype(np.float32), y, penalty)
    kept = [(rules[j], float(c)) for j, c in zip(first, w, strict=True) if abs(c) > 1e-6]
    return RuleModel(names, bias, tuple(r for r, _ in kept), tuple(c for _, c in kept))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> RuleModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold (those of smallest hash of id).

    That bound is the one sample in this operator; labels that are null are not used.
    """
    told = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    told = told.groupBy("doc_id").agg(F.max("quality").alias("_y"))
    told = hash_sample(told, ("doc_id",), max_rows, told.count())
    rows = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id")  # at most max_rows short rows
    # Statistics, not texts, are ordered and sent to the driver.
    named = _once(_counts(text_of()), lambda n: F.struct(*(c.alias(k) for k, c in _statistics(n).items())))
    rows = rows.select(named.alias("s"), F.col("_y").cast("double").alias("_y"), F.xxhash64("doc_id").alias("_a"), F.xxhash64("text").alias("_b"))
    got = rows.orderBy("_a", "_b").limit(max_rows).select("s.*", "_y").toPandas()
    x, y = got[list(NAMES)].to_numpy(float), got["_y"].to_numpy(float)
    return fit_rules(x, (y > 0.5).astype(float), NAMES)


def classify(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    One row for each row of ``docs``, whatever repeats or is null; a null text is scored as an empty
    one; other columns are kept (those named like a result are replaced). No shuffle, no Python.
    """
    score = _once(_counts(text_of()), lambda n: model.score(_statistics(n)))
    return docs.withColumn("score", score).withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
