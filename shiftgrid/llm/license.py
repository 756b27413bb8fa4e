"""License scans by diagonal voting over word k-grams, DataFrame functions only.

The hashes of all rolling k-grams of a text's words meet those of license templates; a match at text
position p and template position t votes for the diagonal p - t; neighbouring diagonals are merged
into spans, which are verified: they count by the template's positions that they hold in order, and of
spans that overlap in the text only the one that holds most gives its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid.llm.util import ascii_lower, text_of

#: Words are runs of a-z, 0-9 and whatever is not ASCII, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a k-gram; the shortest phrase has as many.
K = 3

#: Phrases that decide the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Openings and notices of common licenses, as their texts have them.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation "
           "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                "with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
            "public license as published by the free software foundation",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
            "public license as published by the free software foundation",
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def template_grams(spark: SparkSession) -> DataFrame:
    """``(gram, h, template, t, grams, label, base)``: a row per template position, some hundreds in all."""
    rows = []
    for n, (words, label, base) in enumerate(
        [(p.split(), label, True) for p, label in PHRASES.items()] + [(x.split(), label, False) for label, x in TEMPLATES.items()]):
        grams = len(words) - K + 1
        rows += [(" ".join(words[t : t + K]), n, t, grams, label, base) for t in range(grams)]
    made = spark.createDataFrame(rows, "gram string, template int, t int, grams int, label string, base boolean")
    return made.withColumn("h", F.xxhash64("gram"))


def scan(docs: DataFrame, cover: float = 0.7, slack: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``cover``: the part of a template's k-grams that a span has to hold for its label; ``slack``: how
    far apart diagonals may be that are one span (words put in or left out). ``score`` is the largest
    cover of the templates that give a label (a base phrase: 1), or else of any met. A null text is empty: no words, no places, labels
    "" and score 0. Repeated rows are scanned each for itself. Texts are held as word arrays, one at a
    time; only k-grams whose hash is a template's become rows, and all votes are pre-aggregated.
    """
    spark = docs.sparkSession
    grams = template_grams(spark)
    hashes = [r[0] for r in grams.select("h").distinct().collect()]  # of the fixed templates
    lower = ascii_lower(text_of())
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    gram = lambda i: F.concat_ws(" ", *(F.get(F.col("w"), i + j) for j in range(K)))
    positions = F.when(n >= K, F.sequence(F.lit(0), n - K)).otherwise(F.expr("cast(array() as array<int>)"))
    kept = F.transform(
        F.filter(positions, lambda i: F.xxhash64(gram(i)).isin(hashes)),
        lambda i: F.struct(i.alias("p"), gram(i).alias("gram")))
    met = base.select("doc_id", "row", n.cast("long").alias("n_words"), F.explode_outer(kept).alias("k"))
    met = met.select("doc_id", "row", "n_words", "k.p", "k.gram").withColumn("h", F.xxhash64("gram"))
    # The join is on hash and words: the words verify the hash. Templates are a fixed table of some hundreds of rows.
    voted = met.join(F.broadcast(grams), ["h", "gram"], "left").withColumn("diag", F.col("p") - F.col("t"))
    first = lambda c: F.first(c).alias(c)
    diag = voted.groupBy("row", "template", "diag").agg(
        first("doc_id"), first("n_words"), first("grams"), first("label"), first("base"), F.sort_array(F.collect_set("t")).alias("ts"))
    # Neighbouring diagonals of a template in a text: a new span begins after a step over the slack.
    order = W.partitionBy("row", "template").orderBy("diag")
    step = (F.col("diag") - F.lag("diag").over(order) > slack).cast("int")
    span = diag.withColumn("span", F.sum(F.coalesce(step, F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # A base phrase's diagonal holds it whole if it has all positions; then it starts at the diagonal.
    places = F.col("base") & (F.size("ts") == F.col("grams"))
    spans = span.groupBy("row", "template", "span").agg(
        first("doc_id"), first("n_words"), first("grams"), first("label"), first("base"), F.collect_list(F.struct("diag", "ts")).alias("held"),
        F.sum(places.cast("long")).alias("places"),
        F.min(F.when(places, F.col("diag"))).alias("first"), F.max(F.when(places, F.col("diag"))).alias("last"))
    # Verified: template positions that are met in order, each once.
    points = F.sort_array(F.flatten(F.transform("held", lambda d: F.transform(d["ts"], lambda t: F.struct(t.alias("t"), (t + d["diag"]).alias("p"))))))
    none = F.expr("struct(-1 as t, -1 as p, 0 as n, cast(null as int) as start)")
    follow = lambda a, x: F.when((x["t"] > a["t"]) & (x["p"] > a["p"]), F.struct(x["t"].alias("t"), x["p"].alias("p"), (a["n"] + 1).alias("n"), F.coalesce(a["start"], x["p"]).alias("start"))).otherwise(a)
    spans = spans.withColumn("met", F.when(~F.col("base"), F.aggregate(points, none, follow)))
    spans = spans.withColumn("cover", F.when(F.col("base"), F.when(F.col("places") > 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.col("met.n") / F.col("grams"), F.lit(0.0))))
    has_base = F.col("base") & (F.col("places") > 0)
    named = F.when(~F.col("base") & (F.col("cover") >= cover), F.struct(
        F.col("met.start").alias("start"), (F.col("met.p") + K).alias("end"), F.col("met.n").alias("n"), "cover", "label"))
    rows = spans.groupBy("row").agg(
        first("doc_id"), first("n_words"), F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(has_base, F.col("label")))).alias("own"), F.sort_array(F.collect_list(named)).alias("named"),
        F.max(F.when(has_base, 1.0)).alias("whole"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("any"))
    kept = F.transform(F.array("named"), _longest)[0]
    rows = rows.withColumn("kept", kept)
    labels = F.sort_array(F.array_union("own", F.transform("kept", lambda x: x["label"])))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "own").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.coalesce("whole", F.array_max(F.transform("kept", lambda x: x["cover"])), "any").alias("score"))


def _longest(spans):
    """Of spans (start, end, n, cover, label) in order of start those that no overlapping one beats: by
    positions held, then by cover, then by label."""
    kind = "struct<start:int,end:int,n:int,cover:double,label:string>"
    start = F.expr(f"struct(cast(null as {kind}) as open, cast(array() as array<{kind}>) as out)")
    shut = lambda a: F.when(a["open"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["open"])))
    rank = lambda x: F.struct(x["n"], x["cover"], x["label"])

    def step(a, x):
        apart = a["open"].isNull() | (x["start"] >= a["open"]["end"])
        return F.struct(F.when(apart | (rank(x) > rank(a["open"])), x).otherwise(a["open"]).alias("open"), F.when(apart, shut(a)).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, start, step, shut)
