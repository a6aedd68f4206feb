"""Registered queries of the text operators: thin digests of what each operator returns for its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import (
    chat,
    contamination,
    extraction,
    hard_negatives,
    language,
    language_model,
    mixing,
    neardup,
    pii,
    quality,
    secret_scan,
    spelling,
    toxicity,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    rotated = chat.rotate_perspectives(_table(spark, folder, "conversations"))
    return rotated.withColumn("mask", chat.mask_text(F.col("mask")))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_identifiers(_documents(spark, folder))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def _remainder(divisor: int) -> Column:
    """Fold of a document: crc32 of doc_id as text, by a divisor; null doc_ids have none."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = language.fit_languages(docs.where(_remainder(3) != 1))
    held_out = docs.select("doc_id", "text", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"))
    return held_out.withColumn("p", language.predict_language(F.col("text"), model)).select("doc_id", "held_out", "p.*")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    weights = secret_scan.fit_weights(secret_scan.labelled_samples(docs))
    found = secret_scan.find_secrets(docs.select("doc_id", "text"), weights)

    def count(kind: str) -> Column:
        of_kind = F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = toxicity.fit_toxicity(docs, _table(spark, folder, "labels").where(_remainder(5) != 0))
    held_out = docs.select("doc_id", "text", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"))
    return held_out.withColumn("p", toxicity.judge_toxicity(F.col("text"), model)).select("doc_id", "held_out", "p.*")


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, folder), width=3, threshold=(85, 100))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return quality.score_documents(docs, quality.fit_quality(docs, _table(spark, folder, "labels")))


def op9_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated_pairs(_documents(spark, folder), _table(spark, folder, "benchmark"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_pages(_table(spark, folder, "pages"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.spelling_variants(_documents(spark, folder))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.scaled_vectors(_table(spark, folder, "embeddings").withColumn("label", moved))
    return hard_negatives.mine_hard_negatives(vectors, F.col("id") % 100 == 0)


def op13_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = language_model.fit_model(docs.where(_remainder(5) != 1))
    held_out = docs.select("doc_id", "text", F.coalesce(_remainder(5) == 1, F.lit(False)).alias("held_out"))
    scored = language_model.score_texts(held_out, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_perspective_rotation,
        op3_personal_data,
        op4_language,
        op5_secret_scan,
        op6_toxicity,
        op7_near_duplicates,
        op8_quality_rules,
        op9_benchmark_leaks,
        op10_main_text,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_model_scores,
    )
}

SQL = {
    "op1_source_mix": mixing.SQL,
    "op2_perspective_rotation": chat.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
