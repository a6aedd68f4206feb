"""From raw documents to a training mix: every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import contamination, mixing, neardup, quality, secret_scan
from wavelake.llm.common import release_shuffles, word_count, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the fixed rules or that the model rejects."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = docs.select(*COLUMNS, quality.judge_quality(F.col("text"), model).alias("_quality"))
    return judged.where("_quality.kept").select(*COLUMNS)


def _row_key(docs: DataFrame) -> Column:
    """A text in the order of doc_id, null last, that differs for unlike texts of one doc_id."""
    order = F.col("doc_id")
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        order = F.lpad(F.hex(order.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    order = F.coalesce(F.concat(F.lit("0"), order.cast("string")), F.lit("1"))
    return F.concat_ws(":", order, F.hex(F.xxhash64("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates (five words, 0.8): one with the smallest doc_id, null last.

    Rows are told apart by doc_id and text, so repeated doc_ids and rows without one are classified like all others. Of
    rows that are equal in both, one stays. Rows without words are in no class and stay.
    """
    keyed = docs.select(*COLUMNS, _row_key(docs).alias("_key"))
    classes = neardup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    # The keys that go, or that several rows have, are far fewer than those that stay.
    marked = write_table(
        classes.groupBy(F.col("doc_id").alias("_marked"))
        .agg(F.max("kept").alias("_stays"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
        .where("not _stays or n > 1 and n_shingles > 0")
        .select("_marked", "_stays")
    )
    del classes
    release_shuffles(spark)
    single = keyed.join(marked, F.col("_key") == F.col("_marked"), "left_anti")
    repeated = keyed.join(marked.where("_stays"), F.col("_key") == F.col("_marked"), "left_semi")
    return single.unionByName(repeated.dropDuplicates(["_key"])).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, question and answer."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.clean_documents(docs.select(*COLUMNS), items)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text. Models learn from the documents of this stage."""
    weights = secret_scan.fit_weights(secret_scan.labelled_samples(docs))
    found = secret_scan.find_secrets(docs.select(*COLUMNS), weights)
    spans = F.array_sort(F.concat("base", "added"))
    return (
        found.withColumn("hit", F.size("base") + F.size("added") > 0)
        .withColumn("text", F.when(F.col("hit"), secret_scan.redacted(F.col("text"), spans)).otherwise(F.col("text")))
        .withColumn("n_chars", F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that enter the mix, with their text and how often each enters.

    Rows with the same doc_id, source and size are drawn alike, so these three find the copies of every row.
    """
    key = ["doc_id", "source", "size"]
    drawn = mixing.mix_sources(docs).where("copies > 0").dropDuplicates(key)
    drawn = drawn.select(*(F.col(k).alias(f"_{k}") for k in key), "source_size", "target", "copies", "taken")
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return sized.join(drawn, same).select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("scan_secrets", scan_secrets),
    ("mix", mix),
]

#: The stages train models and draw registers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as a table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
