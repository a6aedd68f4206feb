"""Reports over score tables: grouped means, deltas, pivots, issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.functions.scalars import snr_bin

# Quality targets (output SNR in dB, STOI, wide-band PESQ).
TARGETS = {"out SNR": ("output_snr_db", 15.0), "STOI": ("stoi", 0.85), "PESQ-WB": ("pesq_wb", 2.5)}


def metric_table(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Null-aware means and row counts per system, overall and by suite and input-SNR bin, in one pass."""
    rows = scores.withColumn("snr_bin", snr_bin(F.col("input_snr_db")))
    keys = [F.col("suite"), F.col("snr_bin"), F.col("system")]
    sets = [[F.col("system")], [F.col("suite"), F.col("system")], [F.col("snr_bin"), F.col("system")]]
    grouped = rows.groupingSets(sets, *keys).agg(
        F.grouping("suite").alias("_no_suite"),
        F.grouping("snr_bin").alias("_no_bin"),
        F.count(F.lit(1)).alias("n"),
        *[F.avg(m).alias(m) for m in metrics],
    )
    kind = F.when(F.col("_no_suite") == 0, "suite").when(F.col("_no_bin") == 0, "snr_bin").otherwise("ALL")
    label = F.when(F.col("_no_suite") == 0, F.col("suite")).when(F.col("_no_bin") == 0, F.col("snr_bin")).otherwise("ALL")
    return grouped.select(kind.alias("grouping_kind"), label.alias("label"), "system", "n", *metrics)


def stage_means(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric per stage; ``stage_ord`` carries the given order of the stages."""
    return scores.groupBy("stage", "stage_ord").agg(*[F.avg(m).alias(m) for m in metrics])


def stage_delta(means: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Difference from the previous stage. The input has one row per stage, so one task orders a handful of rows."""
    window = Window.orderBy("stage_ord")
    return means.select("*", *[(F.col(m) - F.lag(m).over(window)).alias(f"d_{m}") for m in metrics])


def improvement(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of enhanced minus noisy for every metric; rows that lack one side do not count."""
    return scores.agg(
        *[F.avg(F.col(f"{m}_enhanced") - F.col(f"{m}_noisy")).alias(f"{m}_improvement") for m in metrics]
    )


def per_file_pivot(scores: DataFrame, systems: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per mixture with the metrics of each system as columns. The systems are given, so no extra scan finds them."""
    wide = scores.groupBy("mixture_id").pivot("system", list(systems))
    return wide.agg(*[F.max(m).alias(m) for m in metrics])


def failed_targets(targets: dict[str, tuple[str, float]] = TARGETS) -> Column:
    """Ordered list of the targets a row misses; a missing score misses its target."""
    missed = [
        F.when(F.coalesce(F.col(column) < limit, F.lit(True)), F.lit(name)) for name, (column, limit) in targets.items()
    ]
    return F.array_compact(F.array(*missed))


def meets_targets(scores: DataFrame) -> DataFrame:
    missed = failed_targets()
    return scores.withColumn("missed", missed).withColumn("meets_all", F.size("missed") == 0)


def numerical_issues(scores: DataFrame, weights: Sequence[str] = (), tolerance: float = 1e-5) -> DataFrame:
    """One row per problem: weights that are not finite or do not sum to one, outputs not finite, peaks at full scale."""
    from wavelake.functions.scalars import finite

    checks = [
        F.when(~finite(F.col("output_value")), F.lit("non-finite output")),
        F.when(F.col("output_peak") >= 0.999, F.lit("output peak")),
    ]
    if weights:
        total = sum((F.col(w) for w in weights[1:]), F.col(weights[0]))
        ok = finite(total) & (F.abs(total - 1) <= tolerance)
        checks.insert(0, F.when(~ok, F.lit("weights non-finite or not summing to 1")))
    return scores.select("*", F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def expert_difference(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute mask difference over all frames and bands, and over flagged frames only (null if none)."""
    gap = F.abs(F.col("mask_1") - F.col("mask_2"))
    return masks.groupBy(*keys).agg(
        F.avg(gap).alias("mask_absdiff"), F.avg(F.when(F.col("flag"), gap)).alias("mask_absdiff_flagged")
    )


def validation_report(rows: DataFrame) -> DataFrame:
    """One row over a validation run; PESQ is averaged over the rows that have it."""
    return rows.agg(
        F.avg("loss").alias("val_loss"),
        F.count(F.lit(1)).alias("val_files"),
        F.avg("snr_improvement_db").alias("val_snr_improvement_db"),
        F.avg("stoi").alias("val_stoi"),
        F.avg("pesq").alias("val_pesq"),
        F.max("output_peak").alias("val_output_peak_max"),
        F.sum("output_clipping_samples").alias("val_clipping_samples"),
        F.sum("audio_sec").alias("val_audio_sec"),
    )


def latency_summary(runs: DataFrame) -> DataFrame:
    """Latency over the runs that succeeded, mean real-time factor, and the number of failures."""
    ok = F.col("error").isNull()
    latency = F.when(ok, F.col("latency_seconds"))
    return runs.agg(
        F.count_if(ok).alias("files"),
        F.count_if(~ok).alias("failures"),
        F.avg(latency).alias("latency_avg"),
        F.min(latency).alias("latency_min"),
        F.max(latency).alias("latency_max"),
        F.avg(F.when(ok & (F.col("audio_seconds") > 0), F.col("latency_seconds") / F.col("audio_seconds"))).alias("rtf_avg"),
    )


def status_rollup(files: DataFrame) -> DataFrame:
    """Converted, skipped and failed counts with the share of each."""
    counts = files.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    # Three statuses: the window sees a handful of rows.
    return counts.withColumn("share", F.col("files") / F.sum("files").over(Window.partitionBy()))


def failure_rollup(failures: DataFrame) -> DataFrame:
    return failures.groupBy("error_type").agg(F.count(F.lit(1)).alias("attempts"))
