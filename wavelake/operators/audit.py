"""Roll-ups over sample records and inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.plans.ordered import block_of, index_within, ordered_index
from wavelake.plans.totals import beside


def usage_counts(records: DataFrame, noises: DataFrame) -> DataFrame:
    """Use counts (kind, name, uses) per clean source, noise source and category; a null category counts as ``null``."""
    clean = records.select(F.lit("clean_source").alias("kind"), F.col("clean_source").cast("string").alias("name"))
    used = F.explode(
        F.array(
            F.struct(F.lit("noise_source").alias("kind"), F.col("source").cast("string").alias("name")),
            F.struct(F.lit("noise_category").alias("kind"), F.coalesce("category", F.lit("null")).alias("name")),
        )
    ).alias("u")
    both = clean.unionByName(noises.select(used).select("u.*"))
    return both.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("uses"))


def snr_stats(records: DataFrame) -> DataFrame:
    error = F.col("measured_snr_db") - F.col("target_snr_db")
    columns = {
        "snr_min": F.min("measured_snr_db"),
        "snr_max": F.max("measured_snr_db"),
        "snr_mean": F.avg("measured_snr_db"),
        "target_snr_min": F.min("target_snr_db"),
        "target_snr_max": F.max("target_snr_db"),
        "target_snr_mean": F.avg("target_snr_db"),
        "snr_error_mean_db": F.avg(error),
        "snr_error_max_abs_db": F.max(F.abs(error)),
    }
    return records.agg(*[F.round(column, 4).alias(name) for name, column in columns.items()])


def snr_histogram(records: DataFrame, width: float = 5.0) -> DataFrame:
    """Fixed-width bins with their lower edge and the label ``<lo>_to_<hi>``."""
    lower = F.floor(F.col("measured_snr_db") / width) * width
    counts = records.groupBy(lower.cast("double").alias("lower")).agg(F.count(F.lit(1)).alias("samples"))

    def text(value: Column) -> Column:
        return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))

    label = F.concat(text(F.col("lower")), F.lit("_to_"), text(F.col("lower") + width))
    return counts.select("lower", label.alias("label"), "samples")


def distinct_counts(records: DataFrame, noises: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: sources and categories available and used, and speakers (null if no record names one)."""
    speakers = F.count_distinct("clean_speaker_id")
    used = records.agg(
        F.count_distinct("clean_source").alias("clean_sources_used"),
        F.when(speakers > 0, speakers).alias("clean_speakers"),
    )
    noise = noises.agg(
        F.count_distinct("source").alias("noise_sources_used"), F.count_distinct("category").alias("noise_categories_used")
    )
    pool = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("category").alias("noise_categories"))
    return beside(beside(used, noise), pool)


def conditional_counts(records: DataFrame, noises: DataFrame) -> DataFrame:
    left = records.agg(F.count_if(F.coalesce("clipping_prevented", F.lit(False))).alias("clipping_gain_samples"))
    right = noises.agg(
        F.count_if(F.coalesce("looped", F.lit(False))).alias("looped_noises"),
        F.sum(F.coalesce("n_events", F.lit(0))).cast("bigint").alias("impulsive_events"),
    )
    return beside(left, right)


def split_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("duration_seconds") / 3600, 4).alias("hours")
    )


def noise_count_distribution(noises: DataFrame) -> DataFrame:
    per_sample = noises.groupBy("k").agg(F.count(F.lit(1)).alias("num_noises"))
    return per_sample.groupBy("num_noises").agg(F.count(F.lit(1)).alias("samples"))


def flag_frequencies(manifest: DataFrame) -> DataFrame:
    """Counts (kind, value, rows) by role, metadata status, audio status and each single flag, in one pass."""
    def items(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    everything = F.concat(
        items("role", F.array("role")),
        items("meta_status", F.array("meta_status")),
        items("audio_status", F.array("audio_status")),
        items("meta_flag", F.col("meta_flags")),
        items("audio_flag", F.col("audio_flags")),
    )
    rows = manifest.select(F.explode(everything).alias("i")).select("i.*").where(F.col("value") != "")
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows"))


def inventory_hash(sources: DataFrame, fan: int = 4096) -> DataFrame:
    """Digest of an inventory: a hash tree over its ordered ``rel|size`` lines.

    ``sources`` has (kind_ord, rel, size). The digests of the lines, in their total order, are joined ``fan`` at a time
    and hashed, level by level, until one is left; at least one level is built. The rule is the same for every size and
    no task holds more than ``fan`` digests. An empty inventory has the digest of the empty text.
    """
    numbered = ordered_index(sources.select("kind_ord", "rel", "size"), ["kind_ord", "rel"], "idx")
    line = F.concat("rel", F.lit("|"), F.col("size").cast("string"), F.lit("\n"))
    level = numbered.select("idx", F.sha2(line, 256).alias("digest"), F.lit(1).cast("bigint").alias("lines"))
    left = numbered.count()
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda s: s["digest"]), "")
        level = (
            level.groupBy(block_of(F.col("idx"), fan).alias("idx"))
            .agg(F.sha2(joined, 256).alias("digest"), F.sum("lines").cast("bigint").alias("lines"))
        )
        left = -(-left // fan)
        if left <= 1:
            break
    return level.agg(
        F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("inventory_hash"), F.coalesce(F.sum("lines"), F.lit(0)).alias("sources")
    )


def category_members(noises: DataFrame) -> DataFrame:
    """Members of every category as rows: (category, idx, rel), the index following the file order.

    A category may hold most of the library, so members stay rows and are never gathered into one list.
    """
    return index_within(noises.select("category", "rel"), ["category"], ["rel"], "idx")


def category_groups(noises: DataFrame) -> DataFrame:
    """One row per category: its rank (names ascending, null last) and its number of files."""
    counts = noises.groupBy("category").agg(F.count(F.lit(1)).alias("files"))
    return ordered_index(counts, [F.col("category").asc_nulls_last()], "category_idx")


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """Ids that occur more than once among rows that are not FAIL become FAIL and get a flag."""
    valid = rows.where(F.col("meta_status") != "FAIL")
    repeated = valid.groupBy("mixture_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    joined = rows.join(repeated, "mixture_id", "left")
    hit = (F.col("meta_status") != "FAIL") & F.col("_n").isNotNull()
    return (
        joined.withColumn(
            "meta_flags",
            F.when(hit, F.array_append("meta_flags", F.lit("duplicate mixture_id"))).otherwise(F.col("meta_flags")),
        )
        .withColumn("meta_status", F.when(hit, "FAIL").otherwise(F.col("meta_status")))
        .drop("_n")
    )


def duplicate_ids(records: DataFrame, key: str = "sample_id") -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def union_manifests(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with the side's name. One aggregate over both sides."""
    columns = left.columns
    sides = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    flags = sides.groupBy(*columns).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_l") == 1, "left").otherwise("right")
    return flags.where(F.col("_l") != F.col("_r")).select(*columns, side.alias("side"))


def leakage(train: DataFrame, val: DataFrame, forbidden_prefix: str | None = None) -> DataFrame:
    """Rows (issue, detail) that must not exist: ids on both sides, and training paths under a forbidden prefix."""
    shared = train.select("mixture_id").intersect(val.select("mixture_id"))
    issues = shared.select(F.lit("overlap").alias("issue"), F.col("mixture_id").cast("string").alias("detail"))
    if forbidden_prefix:
        bad = train.where(F.col("noisy_relpath").startswith(forbidden_prefix))
        issues = issues.unionByName(bad.select(F.lit("forbidden path").alias("issue"), F.col("noisy_relpath").alias("detail")))
    return issues


def frozen_union(lists: Sequence[DataFrame]) -> DataFrame:
    result = lists[0].select("mixture_id")
    for other in lists[1:]:
        result = result.union(other.select("mixture_id"))
    return result.distinct()


def releasable_sources(plan: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sources whose every planned use is resolved, with the last sample that used them."""
    uses = plan.join(resolved.select("sample_id").distinct().withColumn("_done", F.lit(True)), "sample_id", "left")
    per_source = uses.groupBy("source").agg(
        F.count_if(F.col("_done").isNull()).alias("open"), F.max("sample_id").alias("last_sample_id")
    )
    return per_source.where(F.col("open") == 0).select("source", "last_sample_id")
