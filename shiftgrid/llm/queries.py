"""The operators' queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid.llm import bpe, html, lexical, license, mixing, pii, quality, runs, secret, sharding, simhash, topk, vecdup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the rank file that the queries use, part of an installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secret.BASE), F.sha2(secret.joined(base).cast("binary"), 256).alias("base_sha256"), secret.joined(F.col("spans")).alias("spans"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``: of documents whose checksum ends in 0 the words from ``a`` on repeat the first ``p`` of them."""
    white, h = r"[\x20\x09-\x0D]+", F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = lambda t: F.filter(F.split(t, white), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.expr("_h div 10")
        bound = lambda x, f: F.transform(F.array(x), f)[0]
        of = lambda a, p: F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")
        period = lambda a: F.floor((n - a) / (3 + g % 8)).cast("long") + 1
        return F.when(n > 0, bound(g % n, lambda a: bound(period(a), lambda p: of(a, p)))).otherwise(F.lit(""))

    made = F.transform(F.array(split(F.coalesce("text", F.lit("")))), repeated)[0]
    return docs.select("doc_id", "text", h.alias("_h")).select("doc_id", F.when(F.col("_h") % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_repeats(table(spark, sf_dir, "documents"))).withColumn("best", runs.tallest(F.col("runs")))
    best = [F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")]
    milli = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, digest(runs.listed(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_topk": op2_topk,
    "op3_license": op3_license,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_html": op8_html,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_secrets": op11_secrets,
    "op12_lexical": op12_lexical,
    "op13_runs": op13_runs,
    "pipeline": pipeline,
}
