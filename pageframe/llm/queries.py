"""Registered queries of the operators in this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import decontam, frames, mixing_lm, ngram_join, packing, pii, pu_quality, quality_rules, source_mix, spelling, suffix_dedup, toxicity, whitening
from pageframe.llm.common import id_fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = quality_rules.base_failed()
    return quality_rules.measured(documents(spark, sf_dir).select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & quality_rules.verdict()).alias("kept"),
    )


ORACLES["op9_quality_rules"] = quality_rules.duckdb_sql()


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.annotated(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long")

    return found.select(
        "row.doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


@query
def op7_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.read(frames.write(documents(spark, sf_dir)), digest=True)


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(documents(spark, sf_dir)).drop("class_id")


ORACLES["op1_ngram_jaccard_join"] = ngram_join.duckdb_sql()


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("contaminated")


@query
def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pu_quality.trained(docs, labels, id_fold(F.col("id"), 4) != 2)
    return pu_quality.scored(docs, model).select(
        "doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query
def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has one toxicity label.  The chain's categories are: low quality at all, toxic
    (fed with the first), and toxic texts of low quality (fed with both)."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic",
        ((F.col("toxic") == 1) & (F.col("quality") == 0)).cast("int").alias("toxic_junk"),
    )
    chain = toxicity.trained(docs, labels, ["low_quality", "toxic", "toxic_junk"])
    return toxicity.scored(docs, chain).withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, sf_dir))


@query
def op4_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.scored(documents(spark, sf_dir), id_fold(F.col("doc_id"), 10) == 0)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.vocabulary(documents(spark, sf_dir)))


ORACLES["op12_spelling_variants"] = spelling.duckdb_sql()


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(documents(spark, sf_dir))


ORACLES["op13_source_mix"] = source_mix.duckdb_sql()
