"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Every document's copies are a whole number and a fraction. Pairs of documents of a source trade the
mass of their fractions, in a random direction that keeps every expectation, until one of the two is
whole; what is left over meets other leftovers in the next level of a tree, until one is left a source.
Documents that are large against their source come before the tree, the largest first: each trades with
all smaller ones of its source at once, so what is open at the end is a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid.llm import util
from shiftgrid.llm.util import placed, repeated, text_of, written

#: Words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents a block of the tree holds on average.
BLOCK = 48
#: A document of more than this part of its source's open sizes is large; a source has no more than one over this.
LARGE = 1 / 512


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_n``, the place (from 0) of its source in code-point order, null last: ranges of sources
    are counted, so that no task orders all of them."""
    order = (F.col("source").isNull(), F.hex("source"))
    ranged = written(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    # A row a range, as many as the shuffle has partitions.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_n", own).join(F.broadcast(ahead), "_part").withColumn("_n", F.col("_n") + F.col("_ahead")).drop("_part", "_ahead")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size, ...)``, one row a source, with ``target`` added.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``volume`` times
    all sizes; none gets over ``most`` times its size, the excess being shared again by weight. That
    is one water level: a source is full if its limit over its weight is below the level. The level
    rises round by round, each taking the sources out that the last one filled; only sums reach the driver.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size").cast("double")
    t = written(_numbered(sizes).withColumns({"_w": w, "_cap": cap}).drop("_n"), "weighed")
    level, full = 0.0, -1
    while True:
        is_full = (F.col("_cap") / F.col("_w") < level) if full >= 0 else F.lit(False)
        n, caps, rest, every = t.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("_cap"))), F.sum(F.when(~is_full, F.col("_w"))), F.sum("source_size")).first()
        if n == full or not rest:
            break
        level, full = (volume * float(every or 0) - (caps or 0.0)) / rest, n
    target = F.col("_cap") if not rest else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return t.withColumn("target", target).drop("_w", "_cap")


_ITEM = "struct<p:double,mass:bigint,doc_id:bigint,crc:bigint,m:bigint,whole:bigint>"


def _draw(seed: int, *keys) -> Column:
    """From 0 to 1, by a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def _settle(items: Column, live: Column, share: Column, seed: int) -> Column:
    """Pivotal rounding of a source's large documents, largest first: struct(a, b, s, live, done).

    Each trades with the pool of all that come after it, large or not, whose sizes add up to ``live`` and whose
    fractions times sizes to ``share``. The pool's fractions move towards 0 or 1 together, so that of all of them
    is kept as ``a`` times what they were plus ``b``. Where the pool can carry both outcomes a draw decides, with the
    chances that keep every expectation; where it can carry one, that one is taken, and where none, the one that
    leaves the smaller rest: there, being near the target comes before being fair to a document of that size.
    """
    def trade(acc: Column, x: Column) -> Column:
        size = x["mass"].cast("double")
        p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc["a"] * x["p"] + acc["b"]))
        s, live_ = acc["s"] - x["p"] * size, acc["live"] - x["mass"]
        held = F.least(live_.cast("double"), F.greatest(F.lit(0.0), acc["a"] * s + acc["b"] * live_))
        room = live_ - held
        up, down = F.least((1 - p) * size, held), F.least(p * size, room)  # mass that may go from the pool, or to it
        keys = (x["doc_id"], x["crc"], x["mass"])
        rises, falls = (1 - p) * size <= held, p * size <= room  # what the pool can carry
        less = (1 - p) * size - held <= p * size - room
        take = F.when(rises & falls, _draw(seed, *keys) * (up + down) < down).when(rises | falls, rises).otherwise(less)
        left = F.when(take, F.when(held > 0, 1 - up / held).otherwise(1.0)).otherwise(F.when(room > 0, 1 - down / room).otherwise(1.0))
        return F.struct((acc["a"] * left).alias("a"), F.when(take, acc["b"] * left).otherwise(1 - (1 - acc["b"]) * left).alias("b"), s.alias("s"), live_.alias("live"),
                        F.concat(acc["done"], F.array(F.struct(take.cast("double").alias("p"), *(x[k].alias(k) for k in ("mass", "doc_id", "crc", "m", "whole"))))).alias("done"))

    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), share.alias("s"), live.alias("live"), F.expr(f"cast(array() as array<{_ITEM}>)").alias("done"))
    return F.aggregate(items, start, trade)


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding along an array of structs (p, mass, id...): all but the last become whole.

    The accumulator is the one still open and those decided. With masses a and b and fractions p and
    q, the mass p a + q b is kept: either the lighter pull ends at 0 or 1 on one side or the other.
    """

    def trade(acc: Column, x: Column) -> Column:
        o = acc["open"]
        a, b, p, q = o["mass"].cast("double"), x["mass"].cast("double"), o["p"], x["p"]
        up = F.least((1 - p) * a, q * b)  # mass that may go from x to the open one
        down = F.least(p * a, (1 - q) * b)
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), o["doc_id"], o["crc"], o["mass"], x["doc_id"], x["crc"], x["mass"]), 11) / float(1 << 53)
        take = draw * (up + down) < down
        moved = F.when(take, up).otherwise(-down)
        p2, q2 = p + moved / a, q - moved / b
        # One of the two is whole by construction; which one is told by the limit that was met.
        first_whole = F.when(take, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b)
        p3 = F.when(first_whole, F.when(take, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p2)))
        q3 = F.when(first_whole, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q2))).otherwise(F.when(take, 0.0).otherwise(1.0))
        set_p = lambda s, v: F.struct(v.alias("p"), *(s[k].alias(k) for k in ("mass", "doc_id", "crc", "m", "whole")))
        return F.struct(
            F.when(first_whole, set_p(x, q3)).otherwise(set_p(o, p3)).alias("open"),
            F.concat(acc["done"], F.array(F.when(first_whole, set_p(o, p3)).otherwise(set_p(x, q3)))).alias("done"),
        )

    start = F.struct(items[0].alias("open"), F.expr(f"cast(array() as array<{_ITEM}>)").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, trade)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), volume: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """Each row of ``docs``: doc_id, size (words), source_size, target (of its source), taken (words).

    ``taken`` is the size times 0, 1 or 2 copies (one more than the whole part of target over size, or
    that). A source's words taken miss its target by less than one document, and by one of over ``LARGE`` of
    the source only where the smaller ones could not carry it. Which documents are
    taken follows from hashes of ids, texts' checksums and ``seed`` alone, so reruns agree. Repeated
    rows are one item of their common size for the fraction's draw if they are as one in id, source
    and text; their copies are then dealt row by row. Documents without words take nothing. Null ids
    and sources are values like any other. Other columns are not read.
    """
    text = text_of()
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.crc32(text).alias("crc"))
    items = written(rows.groupBy("doc_id", "source", "size", "crc").agg(F.count(F.lit(1)).alias("m")), "items")
    # A row a source and number of repeats: open sizes follow from these without a second pass over items.
    masses = written(items.groupBy("source", "m").agg(F.sum("size").alias("mass"), F.count(F.lit(1)).alias("n")), "masses")
    sizes = masses.groupBy("source").agg(F.sum(F.col("mass") * F.col("m")).alias("source_size"), F.sum("n").alias("n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A row of an item takes floor(ratio) copies; the rest of the item's copies is m times the fraction.
    base = F.floor(ratio + 1e-12)
    extra = F.greatest(F.lit(0.0), ratio - base) * F.col("m")
    p = extra - F.floor(extra)
    aimed = written(source_targets(sizes, weights, volume, most), "aimed").withColumnRenamed("source", "src")
    left_open = masses.drop("n").join(aimed, masses["source"].eqNullSafe(aimed["src"])).where(p > 0)
    left_open = left_open.groupBy("source").agg(F.sum("mass").alias("live"), F.sum(p * F.col("mass")).alias("share"))
    told = written(aimed.join(left_open, F.col("src").eqNullSafe(F.col("source")), "left").drop("source"), "sources")
    most_docs = told.agg(F.max("n")).first()[0] or 0
    joined = items.join(told, items["source"].eqNullSafe(told["src"]))
    sourced = F.struct("source_size", "target", base.cast("long").alias("base")).alias("s")
    x = F.struct(p.alias("p"), F.col("size").alias("mass"), "doc_id", "crc", "m", F.floor(extra).cast("long").alias("whole")).alias("x")
    t = joined.select("source", "n", "live", "share", sourced, x)
    live = (F.col("x.mass") > 0) & (F.col("x.p") > 0)
    large = F.col("x.mass") > LARGE * F.col("live")
    of_item = ("source", "x.doc_id", "x.crc", F.col("x.mass").alias("size"), "x.m", "x.whole", "s")
    parts = [t.where(~live).select(*of_item, F.lit(0.0).alias("p"))]
    # At most 1 / LARGE rows a source.
    first = t.where(live & large).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("x.mass")).alias("down"), F.xxhash64("x.doc_id", "x.crc").alias("h"), "x"))).alias("xs"),
        F.first("live").alias("live"), F.first("share").alias("share"), F.first("s").alias("s"))
    settled = written(first.select("source", "s", _settle(F.transform("xs", lambda e: e["x"]), F.col("live"), F.col("share"), seed - 3).alias("f")), "large")
    parts.append(settled.select("source", "s", F.explode("f.done").alias("x")).select(*of_item, "x.p"))
    pools = settled.select(F.col("source").alias("src"), "f.a", "f.b")
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("a", F.lit(1.0)) * F.col("x.p") + F.coalesce("b", F.lit(0.0))))
    small = t.where(live & ~large).join(pools, F.col("source").eqNullSafe(F.col("src")), "left")
    small = written(small.select("source", "n", "s", F.col("x").withField("p", moved).alias("x")), "small")
    still = (F.col("x.p") > 0) & (F.col("x.p") < 1)
    parts.append(small.where(~still).select(*of_item, "x.p"))
    level_rows = small.where(still)
    level = 0
    while True:
        last = most_docs <= BLOCK
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / float(BLOCK) ** (level + 1))).cast("long")
        blocked = level_rows.withColumn("block", F.lit(0).cast("long") if last else F.pmod(F.xxhash64(F.lit(level), "x.doc_id", "x.crc", "x.mass"), blocks))
        got = blocked.groupBy("source", "block").agg(
            F.sort_array(F.collect_list(F.struct(F.xxhash64("x.doc_id", "x.crc").alias("h"), "x", "n", "s"))).alias("xs"))
        folded = written(got.select("source", F.element_at("xs", 1)["n"].alias("n"), F.element_at("xs", 1)["s"].alias("s"),
                                    _fold(F.transform("xs", lambda e: e["x"]), seed + level).alias("f")), f"level{level}")
        parts.append(folded.select("source", "s", F.explode("f.done").alias("x")).select(
            "source", "x.doc_id", "x.crc", F.col("x.mass").alias("size"), "x.m", "x.whole", "s", "x.p"))
        level_rows = folded.select("source", "n", "s", F.col("f.open").alias("x"))
        level, most_docs = level + 1, -(-most_docs // BLOCK)
        if last:
            break
    draw = _draw(seed - 1, "x.doc_id", "x.crc")
    parts.append(level_rows.select("source", "x.doc_id", "x.crc", F.col("x.mass").alias("size"), "x.m", "x.whole", "s",
                                   F.when(draw < F.col("x.p"), 1.0).otherwise(0.0).alias("p")))
    names = ["source", "doc_id", "crc", "size", "m", "whole", "s", "p"]
    whole = parts[0].select(*names)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*names))
    n_extra = F.col("whole") + F.round("p").cast("long")
    rowed = repeated(whole, "m")
    copies = F.col("s.base") + F.when(F.col("i") < n_extra, 1).otherwise(0)
    return rowed.select("doc_id", "source", "crc", "size", F.col("s.source_size").alias("source_size"),
                        F.col("s.target").alias("target"), (F.col("size") * copies).alias("taken"), copies.cast("long").alias("copies"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, all columns kept.

    Copies belong to (doc_id, source, text's checksum); repeated rows of one share them. Rows are told
    apart by their place in their files; ``docs`` that are not read from files are written first.
    """
    got = mix(docs, **options).groupBy("doc_id", "source", "crc").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_m")).where("_copies > 0")
    got = written(got.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("crc").alias("_c"), "_copies", "_m"), "taken")
    rows = placed(docs)
    narrow = rows.select("_row", "doc_id", "source", F.crc32(text_of()).alias("_crc"))
    met = narrow.join(got, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_crc") == F.col("_c")))
    # Of a repeated row's m, the copies are dealt in turn: one more for the first ones. All without the texts. Rows are
    # numbered in groups of about CHUNK, and a group goes on where those before it end, so that no task numbers all rows of one.
    groups = F.ceil(F.col("_m") / util.CHUNK).cast("long")
    met = written(met.select("_row", "_d", "_s", "_c", "_copies", "_m", F.pmod(F.xxhash64("_row"), groups).alias("_g")), "met")
    same = ["_d", "_s", "_c"]
    inner = W.partitionBy(*same, "_g").orderBy("_row")
    before = W.partitionBy(*same).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    counts = met.where(F.col("_m") > util.CHUNK).groupBy(*same, "_g").agg(F.count(F.lit(1)).alias("_held"))
    ahead = counts.select(*(F.col(k).alias(f"{k}2") for k in (*same, "_g")), F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_ahead"))
    numbered = met.withColumn("_i", F.row_number().over(inner))
    on = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in (*same, "_g")]
    met = numbered.join(ahead, on, "left").withColumn("_turn", F.col("_i") + F.coalesce("_ahead", F.lit(0)))
    met = met.withColumn("_own", F.expr("int(_copies div _m + if(_turn <= _copies % _m, 1, 0))"))
    dealt = written(met.where("_own > 0").select("_row", "_own"), "dealt")
    # Texts are shuffled once. The plan is the same at every size: ids are never broadcast.
    many = rows.join(dealt.hint("merge"), "_row").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_own"))))
    return many.select(*docs.columns)
