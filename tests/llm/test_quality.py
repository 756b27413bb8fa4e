"""The quality score, recomputed from the rules and from statistics counted in Python."""

import math

import regex

from shiftgrid.llm import quality

SPACE = r" \t\n\x0B\f\r"


def statistics(text):
    text = text or ""
    n = lambda p: len(regex.findall(p, text))
    chars, words, tokens, lines = len(text), n(f"[^{SPACE}]+"), text.split(" "), text.split("\n")
    share = lambda a, b: a / b if b else 0.0
    return {
        "words": float(words), "word_length": share(chars, words), "upper": share(n(r"\p{Lu}"), chars), "letters": share(n(r"\p{L}"), chars), "digits": share(n(r"\p{Nd}"), chars),
        "symbols": share(n(rf"[^\p{{L}}\p{{N}}{SPACE}.,!?'\-]"), words), "doubled": share(n(rf"([^\p{{L}}\p{{N}}{SPACE}])\1"), words), "repeats": share(n(r"[!?*#%$&=_~.\-]{2,}"), words), "bangs": share(n(r"[!?]"), words), "stops": share(n(r"[.,]"), words),
        "distinct": share(len(set(tokens)), len(tokens)), "new_lines": share(len(set(lines)), len(lines)), "line_words": share(words, len(lines)),
    }


def score(model, text):
    s = statistics(text)
    total = model.bias
    for rule, weight in zip(model.rules, model.weights, strict=True):
        if all((s[model.names[f]] > t) if above else (s[model.names[f]] <= t) for f, t, above in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_score_is_that_of_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    odd = [None, "", " ", "\n\n", "ÄÖ!! ?? ¿¿ ١٢٣ 12.5 -- ''", "one two  three\nfour", "###!!!***", "x" * 50_000, "a b " * 20_000, "ǅ ª ² ½ \U0001d7d8"]
    got = quality.classify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    got += quality.classify(docs, model).select("doc_id", "text", "score").collect()
    assert model.rules
    for r in got:
        assert abs(r.score - score(model, r.text)) < 1e-5, r
