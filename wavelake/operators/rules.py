"""Row-level rules: checks, guards, roles and eligibility, all as projections over explicit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.functions.scalars import finite
from wavelake.plans.ordered import join_on

# Noise categories of each tier.
TIERS = {"A": ["engine", "wind"], "B": ["vehicle", "helicopter", "siren"], "C": ["gunfire", "artillery", "explosion"]}


def tier_of(category: Column) -> Column:
    """Tier of a category; null for an unknown one."""
    result = F.lit(None).cast("string")
    for tier, categories in TIERS.items():
        result = F.when(category.isin(categories), F.lit(tier)).otherwise(result)
    return result


# The texts of the flags below are fixed values: other tools read them.


def _flags(*conditions: tuple[Column, Column]) -> Column:
    """The texts of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for test, text in conditions]))


def metadata_checks(rows: DataFrame, split: str) -> DataFrame:
    """Adds ``meta_status`` (FAIL, WARN or PASS) and ``meta_flags``: failures first, then warnings, then notes."""
    snr, measured = F.col("target_snr_db"), F.col("measured_snr_db")
    fatal = _flags(
        (~F.col("split").eqNullSafe(split), F.concat(F.lit("split="), F.coalesce("split", F.lit("None")))),
        (~tier_of(F.col("category")).eqNullSafe(F.col("tier")), F.lit("category/tier mismatch")),
        (~snr.between(-5.0, 20.0), F.lit("target SNR outside [-5, 20]")),
    )
    warnings = _flags(
        (F.col("clipping_flag"), F.lit("clipping_flag (noisy peak > 1.0 before PCM write)")),
        (F.abs(measured - snr) > 0.5, F.lit("measured vs target SNR > 0.5 dB")),
    )
    notes = _flags((measured.isNull(), F.lit("note: measured_snr_db empty")))
    status = F.when(F.size(fatal) > 0, "FAIL").when(F.size(warnings) > 0, "WARN").otherwise("PASS")
    return rows.withColumn("meta_status", status).withColumn("meta_flags", F.concat(fatal, warnings, notes))


def validate_pairs(measures: DataFrame) -> DataFrame:
    """Adds ``audio_status`` (PASS, WARN, FAIL or UNAVAILABLE) and ``audio_flags`` from per-pair measures.

    Format problems hide the content checks, as the content cannot be judged then. Missing files hide everything.
    """
    noisy_missing, clean_missing = ~F.col("noisy_found"), ~F.col("clean_found")
    unreadable = F.col("read_error").isNotNull()
    layout = _flags(
        ((F.col("sample_rate") != 48000) | (F.col("clean_sample_rate") != 48000), F.lit("not 48 kHz")),
        ((F.col("channels") != 1) | (F.col("clean_channels") != 1), F.lit("not mono")),
        (F.col("frames") != F.col("clean_frames"), F.lit("length mismatch")),
        (~F.col("all_finite"), F.lit("non-finite samples")),
    )
    lag = F.col("alignment_lag")
    content = _flags(
        (lag != 0, F.concat(F.lit("misaligned ("), lag.cast("string"), F.lit(" samples)"))),
        (F.col("rms_residual") <= 1e-8, F.lit("no residual noise")),
        (F.col("rms_clean") <= 1e-6, F.lit("silent clean")),
    )
    duration_gap = F.abs(F.col("duration_sec") - F.col("duration_sec_meta"))
    snr_gap = F.abs(F.col("measured_snr_db_audio") - F.col("measured_snr_db_meta"))
    soft = _flags(
        (F.col("peak_noisy") >= 0.999, F.lit("noisy clipped")),
        (F.col("peak_clean") >= 0.999, F.lit("clean clipped")),
        (duration_gap > 0.002, F.lit("duration != metadata")),
        (snr_gap > 1.0, F.lit("SNR differs from metadata by > 1 dB")),
    )
    status = (
        F.when(noisy_missing | clean_missing, "UNAVAILABLE")
        .when(unreadable | (F.size(layout) > 0) | (F.size(content) > 0), "FAIL")
        .when(F.size(soft) > 0, "WARN")
        .otherwise("PASS")
    )
    flags = (
        F.when(noisy_missing, F.array(F.lit("noisy missing")))
        .when(clean_missing, F.array(F.lit("clean missing")))
        .when(unreadable, F.array(F.concat(F.lit("unreadable: "), F.col("read_error"))))
        .when(F.size(layout) > 0, layout)
        .otherwise(F.concat(content, soft))
    )
    return measures.withColumn("audio_status", status).withColumn("audio_flags", flags)


def eligible() -> Column:
    """Usable rows: metadata not FAIL, audio PASS or WARN, not clipped by either source of flags."""
    clipped = F.coalesce("clipping_flag_meta", F.lit(False)) | F.array_join("audio_flags", ";").contains("clipped")
    return (F.col("meta_status") != "FAIL") & F.col("audio_status").isin("PASS", "WARN") & ~clipped


def usage_flags(rows: DataFrame) -> DataFrame:
    """Adds ``use_for_training`` and ``use_for_selection``."""
    return rows.withColumn("use_for_training", F.col("role").isin("train", "dev_train") & eligible()).withColumn(
        "use_for_selection", (F.col("role") == "val_select") & eligible()
    )


def select_rows(manifest: DataFrame, role: str, flag: str) -> DataFrame:
    """Rows of a role that pass ``flag``, in id order. ``metadata_no_clip`` needs no audio check.

    Use `require_rows` where an empty result is an error.
    """
    if flag == "metadata_no_clip":
        passes = (F.col("meta_status") != "FAIL") & ~F.coalesce("clipping_flag_meta", F.lit(False))
    else:
        passes = F.coalesce(F.col(flag), F.lit(False))
    return manifest.where((F.col("role") == role) & passes).orderBy("mixture_id")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no usable rows: {what}")
    return df


def finite_only(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of the signals without any NaN or infinite value.

    The bad signals are found by a filter and a distinct, which are few rows, and removed by an anti join; rows with a
    ``block`` meet the blocks of the bad signals, so that no task gets a whole signal.
    """
    bad = samples.where(~finite(F.col("x"))).select(*keys).distinct()
    if "block" not in samples.columns:
        return join_on(samples, bad, keys, "left_anti")
    blocks = join_on(samples.select(*keys, "block").distinct(), bad, keys)
    return join_on(samples, blocks, [*keys, "block"], "left_anti")


def duration_rule(rows: DataFrame, min_samples: int, max_samples: int | None, draw: Column) -> DataFrame:
    """Rejects short signals and gives ``clean_start_sample``, ``clean_end_sample`` and ``clean_cropped``."""
    length = F.col("length")
    kept = rows.where(length >= min_samples)
    if not max_samples:
        return kept.select("*", F.lit(0).cast("bigint").alias("clean_start_sample"), length.alias("clean_end_sample"),
                           F.lit(False).alias("clean_cropped"))
    cropped = length > max_samples
    start = F.when(cropped, draw % (length - max_samples + 1)).otherwise(F.lit(0)).cast("bigint")
    end = F.when(cropped, start + max_samples).otherwise(length).cast("bigint")
    return kept.select("*", start.alias("clean_start_sample"), end.alias("clean_end_sample"), cropped.alias("clean_cropped"))


def power_guards(rows: DataFrame, min_noise_rms: float = 1e-6, eps: float = 1e-12) -> DataFrame:
    """Adds ``rejection``: the reason a mixture cannot be made, or null."""
    reason = (
        F.when(F.col("noise_rms") < min_noise_rms, F.lit("noise segment is (near) silent"))
        .when(
            (F.col("clean_power") < eps) | (F.col("noise_power") < eps),
            F.lit("zero clean or noise power in measurement region"),
        )
    )
    return rows.withColumn("rejection", reason)


def clip_gain(peak: Column, limit: float = 0.99) -> Column:
    """One gain for clean and noisy that brings the mixture peak to the limit."""
    return F.when(peak > limit, F.lit(limit) / peak).otherwise(F.lit(1.0))


def clip_policy(rows: DataFrame, limit: float = 0.99, policy: str = "scale") -> DataFrame:
    if policy == "reject":
        return rows.where(F.col("peak") <= limit).withColumn("output_gain", F.lit(1.0))
    return rows.withColumn("output_gain", clip_gain(F.col("peak"), limit))


def assign_role(rows: DataFrame) -> DataFrame:
    """Role by priority: invalid, test, eval_frozen, calibration, val_pool."""
    role = (
        F.when(F.col("status") != "PASS", "invalid")
        .when(F.col("split") == "test", "test")
        .when(F.col("is_frozen"), "eval_frozen")
        .when(F.col("is_calibration"), "calibration")
        .otherwise("val_pool")
    )
    return rows.withColumn("role", role)


def truncate_log(log: DataFrame, step: int) -> DataFrame:
    """Rows kept on resume at ``step``: train rows before it, validation rows up to it."""
    return log.where(((F.col("kind") == "train") & (F.col("step") < step)) | ((F.col("kind") == "val") & (F.col("step") <= step)))


def run_differences(runs: DataFrame, before: str, now: str, ignored: list[str]) -> DataFrame:
    """One row per setting that differs between two config maps of a run; path-like settings can be ignored."""
    changed = F.map_filter(
        F.map_zip_with(before, now, lambda key, a, b: F.when(~a.eqNullSafe(b), F.struct(a.alias("before"), b.alias("now")))),
        lambda key, pair: pair.isNotNull() & (~key.isin(ignored) if ignored else F.lit(True)),
    )
    others = [c for c in runs.columns if c not in (before, now)]
    return runs.select(*others, F.explode(changed).alias("setting", "_pair")).select(
        *others, "setting", F.col("_pair.before").alias("before"), F.col("_pair.now").alias("now")
    )


def run_compatible(before: DataFrame, now: DataFrame) -> DataFrame:
    """Whether a stored run may be resumed: same generator version, config hash and inventory hash."""
    same = ["generator_version", "config_hash", "source_inventory_hash"]
    joined = before.alias("b").join(now.alias("n"), "run_id")
    ok = F.lit(True)
    for column in same:
        ok = ok & F.col(f"b.{column}").eqNullSafe(F.col(f"n.{column}"))
    return joined.select("run_id", ok.alias("compatible"))
