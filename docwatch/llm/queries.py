"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwatch.llm import alignment, decontaminate, divergence, html_main, line_dedup, mixing, multi_index, ngram_join, pii, quality, sharding, topk, toxicity
from docwatch.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = quality.score(docs, model).drop("text")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")))
    return topk.search(vectors.select("vec_id", whole.alias("embedding")), F.col("vec_id") % 20 == 0, 20)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.containments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "shared", F.round("containment", 6).alias("containment"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "lines_deleted", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "pii_entities")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.sample(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality, op3_sharding, op4_html_extraction, op5_exact_topk, op6_decontamination,
        op7_ngram_jaccard_join, op8_line_dedup, op9_pii_surrogates, op10_mixing, op11_nearest_neighbours, op12_tokenizer_alignment, op13_source_divergence,
    )
}
