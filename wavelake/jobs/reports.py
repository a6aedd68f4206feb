"""Summary, manifests, evaluation, cleaning, recovery and scoring jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions import metrics as M
from wavelake.functions.scalars import finite, strip_prefix, trailing_index
from wavelake.operators import audit as A
from wavelake.operators import matching as J
from wavelake.operators import rules as R
from wavelake.operators import scores as C
from wavelake.operators import signals as S
from wavelake.operators.sequences import select_lowest_per_cell
from wavelake.plans.ordered import BLOCK, with_block
from wavelake.plans.totals import beside
from wavelake.schema import RESULT_FIELDS, SAMPLE_RATE
from wavelake.session import settled
from wavelake.sources.files import scan_files
from wavelake.sources.wav import read_wav_blocks, write_wav


def _side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables as one row."""
    return reduce(beside, parts)


def explode_noises(records: DataFrame) -> DataFrame:
    """The noises of nested records as rows: (k, source, category, looped, n_events)."""
    rows = records.select(F.col("sample_id").alias("k"), F.explode("noises").alias("n"))
    return rows.select(
        "k", F.col("n.source").alias("source"), F.col("n.noise_category").alias("category"), F.col("n.looped").alias("looped"),
        F.col("n.n_events").alias("n_events"),
    )


def dataset_summary(
    records: DataFrame, noises: DataFrame, sources: DataFrame, outputs: DataFrame | None = None, files: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Summary of a data set: one row of totals, and tables for everything that grows with the data.

    ``records`` has clean_source, clean_speaker_id, split, SNRs, duration_seconds, clipping_prevented; ``noises`` is
    `explode_noises`. With ``outputs`` (record paths) and ``files`` the totals include the integrity counts.
    """
    totals = records.agg(
        F.count(F.lit(1)).alias("total_samples"), F.round(F.sum("duration_seconds") / 3600, 4).alias("total_duration_hours")
    )
    parts = [totals, A.snr_stats(records), A.distinct_counts(records, noises, sources), A.conditional_counts(records, noises)]
    if outputs is not None and files is not None:
        parts.append(J.verify_output(outputs, files))
    return {
        "totals": _side_by_side(parts),
        "splits": A.split_totals(records),
        "usage": A.usage_counts(records, noises),
        "snr_distribution": A.snr_histogram(records),
        "noise_counts": A.noise_count_distribution(noises),
    }


def summary_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of `dataset_summary` in one result: (section, name, measure, value)."""
    names = {"splits": F.col("split"), "usage": F.concat_ws("/", "kind", "name"), "snr_distribution": F.col("label"), "noise_counts": F.col("num_noises")}
    hidden = {"split", "kind", "name", "label", "lower", "num_noises"}
    parts = []
    for section, table in tables.items():
        measures = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in table.columns if c not in hidden]
        name = names.get(section, F.lit("all")).cast("string").alias("name")
        rows = table.select(F.lit(section).alias("section"), name, F.explode(F.array(*measures)).alias("m"))
        parts.append(rows.select("section", "name", "m.*"))
    return reduce(DataFrame.unionByName, parts)


def build_manifests(
    metadata: dict[str, tuple[DataFrame, str]],
    audits: dict[str, DataFrame],
    frozen: Sequence[DataFrame],
    calibration: DataFrame,
    measures: DataFrame | None = None,
    drive_prefix: str = "",
) -> DataFrame:
    """One manifest table with a ``part`` column: checks, roles, duplicates, selection, usage flags - in this order.

    ``metadata`` maps a role to (rows, expected split); ``audits`` maps ``val`` and ``test`` to audited pairs.
    ``measures`` (per noisy path, see `validate_pairs`) gives the audio status; without it rows stay UNVERIFIED.
    """
    empty = F.array().cast("array<string>")
    parts = []
    for role, (rows, split) in metadata.items():
        checked = R.metadata_checks(rows, split)
        paths = {c: strip_prefix(F.col(c), drive_prefix) if drive_prefix else F.col(c) for c in ("noisy_path", "clean_path")}
        parts.append(
            checked.select(
                F.lit(role).alias("part"), "mixture_id", "split", F.lit(role).alias("role"), "category", "tier", "target_snr_db",
                F.col("measured_snr_db").alias("measured_snr_db_meta"), F.col("duration_sec").alias("duration_sec_meta"), "n_events",
                F.col("clipping_flag").alias("clipping_flag_meta"), paths["noisy_path"].alias("noisy_relpath"),
                paths["clean_path"].alias("clean_relpath"), "meta_status", "meta_flags", F.lit(None).cast("bigint").alias("index"),
            )
        )
    ids = A.frozen_union(frozen)
    for part, rows in audits.items():
        marked = J.mark_members(rows.withColumn("split", F.lit(part)), ids, "mixture_id", "is_frozen")
        marked = R.assign_role(J.mark_members(marked, calibration, "mixture_id", "is_calibration"))
        passed = F.col("status") == "PASS"
        parts.append(
            marked.select(
                F.lit(part).alias("part"), "mixture_id", "split", "role", "category",
                F.coalesce(R.tier_of(F.col("category")), F.lit("")).alias("tier"), F.col("snr_db").alias("target_snr_db"),
                F.concat(F.lit("mixtures/"), "noisy_member").alias("noisy_relpath"),
                F.concat(F.lit("mixtures/"), "clean_member").alias("clean_relpath"),
                F.when(passed, "PASS").otherwise("FAIL").alias("meta_status"),
                F.when(passed, empty).otherwise(F.array(F.concat(F.lit("zip audit: "), "reason"))).alias("meta_flags"),
                trailing_index(F.col("mixture_id")).alias("index"),
            )
        )
    rows = A.union_manifests(parts)
    unchecked = rows.withColumn("audio_status", F.lit("UNVERIFIED")).withColumn("audio_flags", empty)
    if measures is not None:
        status = R.validate_pairs(measures).select(
            "noisy_relpath", F.col("audio_status").alias("_status"), F.col("audio_flags").alias("_flags")
        )
        joined = unchecked.join(status, "noisy_relpath", "left")
        use = (F.col("meta_status") != "FAIL") & F.col("_status").isNotNull()
        unchecked = (
            joined.withColumn("audio_status", F.when(use, F.col("_status")).otherwise(F.col("audio_status")))
            .withColumn("audio_flags", F.when(use, F.col("_flags")).otherwise(F.col("audio_flags")))
            .drop("_status", "_flags")
        )
    # Ids are compared within a part; selection follows the duplicate check.
    unique = F.concat("part", F.lit("/"), F.col("mixture_id").cast("string"))
    keyed = unchecked.withColumn("_id", F.col("mixture_id")).withColumn("mixture_id", unique)
    keyed = select_lowest_per_cell(A.mark_duplicates(keyed))
    return R.usage_flags(keyed.withColumn("mixture_id", F.col("_id")).drop("_id", "index"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Counts per part by role, statuses and flags, and the number of usable rows: (part, kind, value, rows)."""
    def items(kind: str, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    used = F.array(F.when(F.col("use_for_training"), F.lit("use_for_training")), F.when(F.col("use_for_selection"), F.lit("use_for_selection")))
    everything = F.concat(
        items("role", F.array("role")), items("meta_status", F.array("meta_status")), items("audio_status", F.array("audio_status")),
        items("meta_flag", F.col("meta_flags")), items("audio_flag", F.col("audio_flags")), items("used", F.array_compact(used)),
    )
    rows = manifest.select("part", F.explode(everything).alias("i")).select("part", "i.*")
    return rows.groupBy("part", "kind", "value").agg(F.count(F.lit(1)).alias("rows"))


def evaluate_stages(
    clean: DataFrame, staged: DataFrame, stages: Sequence[str], max_shift: int = 1600, method: str = "phat", size: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Scores every stage against clean on the signals present in all stages: per file, and means with deltas.

    ``clean`` has (signal_id, t, x); ``staged`` adds ``stage``. All stages are aligned and gain-matched in one plan.
    """
    names = list(stages)
    present = staged.where(F.col("stage").isin(names)).select("signal_id", "stage").distinct()
    complete = present.groupBy("signal_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(names)).select("signal_id")
    complete = complete.join(clean.select("signal_id").distinct(), "signal_id", "left_semi")
    keys = ["signal_id", "stage"]
    rows = staged.where(F.col("stage").isin(names)).join(complete, "signal_id", "left_semi")
    every = F.explode(F.array(*[F.lit(n) for n in names])).alias("stage")
    reference = clean.join(complete, "signal_id", "left_semi").select("signal_id", "t", "x", every)
    scored = S.align_and_gain_match(
        with_block(reference, "t", size), with_block(rows.select(*keys, "t", "x"), "t", size), max_shift, method, keys, size
    )
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("stage")) - 1
    per_file = scored.withColumn("stage_ord", order)
    metrics = ["snr", "si_sdr"]
    return per_file, C.stage_delta(C.stage_means(per_file, metrics), metrics)


def evaluate_systems(pairs: DataFrame, systems: Sequence[str], keys: Sequence[str] = ("suite", "mixture_id")) -> dict[str, DataFrame]:
    """Per-file scores, group tables, one row per file, and numerical issues of several systems.

    ``pairs`` has (suite, mixture_id, t, clean, noisy) and one column of samples per system. All systems are measured
    in the same pass over the samples.
    """
    measures = [M.snr_rms_db("clean", "noisy").alias("input_snr_db"), M.si_sdr_centred_db("clean", "noisy").alias("_si_sdr_in")]
    for s in systems:
        measures.append(
            F.struct(
                F.lit(s).alias("system"),
                M.snr_rms_db("clean", s).alias("output_snr_db"),
                M.si_sdr_centred_db("clean", s).alias("si_sdr_db"),
                M.peak(s).alias("output_peak"),
                F.count_if(~finite(F.col(s))).alias("bad_samples"),
            ).alias(f"_{s}")
        )
    wide = pairs.groupBy(*keys).agg(*measures)
    rows = wide.select(*keys, "input_snr_db", "_si_sdr_in", F.explode(F.array(*[f"_{s}" for s in systems])).alias("s"))
    per_file = rows.select(
        *keys, "input_snr_db", "s.*",
        (F.col("s.output_snr_db") - F.col("input_snr_db")).alias("dsnr_db"),
        (F.col("s.si_sdr_db") - F.col("_si_sdr_in")).alias("si_sdr_improvement_db"),
    )
    metrics = ["output_snr_db", "dsnr_db", "si_sdr_db", "si_sdr_improvement_db"]
    checked = per_file.withColumn("output_value", F.when(F.col("bad_samples") > 0, float("nan")).otherwise(F.lit(0.0)))
    return {
        "per_file": per_file,
        "groups": C.metric_table(per_file, metrics),
        "per_file_wide": C.per_file_pivot(per_file, systems, ["dsnr_db", "si_sdr_db"]),
        "issues": C.numerical_issues(checked).select("mixture_id", "system", "issue"),
    }


def clean_batch(
    blocks: DataFrame,
    highpass: np.ndarray,
    bandlimit: np.ndarray,
    enhancer: Callable[[DataFrame], DataFrame] | None = None,
    size: int = BLOCK,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Cleans decoded files: (cleaned samples keyed by path, failed files with their error).

    ``blocks`` comes from `read_wav_blocks`; a file that could not be decoded does not stop the others.
    """
    failed = blocks.where(F.col("error").isNotNull()).select("path", "error")
    good = blocks.where(F.col("error").isNull()).select(F.col("path").alias("signal_id"), "block", "start", "samples")
    samples = with_block(S.samples_from_blocks(good).drop("block"), "t", size)
    return S.clean_chain(samples, highpass, bandlimit, enhancer, size=size, **options), failed


def clean_folder(
    spark: SparkSession,
    source: str,
    target: str,
    highpass: np.ndarray,
    bandlimit: np.ndarray,
    enhancer: Callable[[DataFrame], DataFrame] | None = None,
    subtype: str = "PCM_16",
    size: int = BLOCK,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Cleans every WAV file below ``source`` into a file of the same relative path below ``target``.

    Returns (report, totals): the report has a row for each file with its path, the frames written or the error that kept
    it from being read; the totals have the number of files and failures, the seconds of audio and of the run, and their
    ratio. A file that cannot be read does not stop the others.
    """
    began = time.perf_counter()
    files = scan_files(spark, source, "", [".wav"]).select("rel", "path")
    blocks = read_wav_blocks(files, size).withColumnRenamed("path", "_path")
    blocks = blocks.join(files.withColumnRenamed("path", "_at"), F.col("_path") == F.col("_at")).withColumn("path", F.col("rel"))
    cleaned, failed = clean_batch(settled(blocks.drop("_path", "_at", "rel")), highpass, bandlimit, enhancer, size, **options)
    out = S.blocks_from_samples(cleaned, size).withColumnRenamed("signal_id", "path")
    written = write_wav(out, target, subtype)
    report = written.select("path", "frames", F.lit(None).cast("string").alias("error"))
    report = settled(report.unionByName(failed.select("path", F.lit(None).cast("bigint").alias("frames"), "error").dropDuplicates(["path"])))
    spent = time.perf_counter() - began
    seconds = F.coalesce(F.sum("frames"), F.lit(0)) / float(SAMPLE_RATE)
    totals = report.agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("failed"), seconds.alias("audio_sec"))
    totals = totals.withColumn("processing_time_sec", F.lit(spent))
    return report, totals.withColumn("rtf", F.col("processing_time_sec") / F.nullif(F.col("audio_sec"), F.lit(0.0)))


def recover(records: DataFrame, outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Actions (action, path) that bring records and files together: fatal duplicates and missing files, orphans to delete."""
    doubled = A.duplicate_ids(records).select(F.lit("duplicate").alias("action"), F.col("sample_id").alias("path"))
    absent = J.missing(outputs, files).select(F.lit("missing").alias("action"), "path")
    orphan = J.orphans(outputs, files).select(F.lit("delete").alias("action"), "path")
    return doubled.unionByName(absent).unionByName(orphan)


def score_triplets(samples: DataFrame, pairs: DataFrame, experiment: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """Common result table of one output per pair; an exact copy of clean has an infinite output SNR.

    ``samples`` has (mixture_id, t, clean, noisy, output); ``pairs`` has the manifest columns and, where known,
    stoi, pesq, pesq_nb, their notes and processing_time_sec.
    """
    same = F.min(F.col("clean") == F.col("output"))
    scored = samples.groupBy("mixture_id").agg(
        M.snr_rms_db("clean", "noisy").alias("input_snr_db"),
        F.when(same, float("inf")).otherwise(M.snr_rms_db("clean", "output")).alias("output_snr_db"),
        (F.count(F.lit(1)) / F.lit(float(rate))).alias("duration_sec"),
        M.peak("output").alias("output_peak"),
        M.clipped_samples("output").alias("output_clipping_samples"),
    )
    rows = scored.join(pairs, "mixture_id")
    given = {
        "experiment": F.lit(experiment),
        "snr_improvement_db": F.col("output_snr_db") - F.col("input_snr_db"),
        "sample_rate": F.lit(rate),
        "rtf": F.col("processing_time_sec") / F.col("duration_sec") if "processing_time_sec" in rows.columns else F.lit(None).cast("double"),
    }
    texts = {"pesq_note", "pesq_nb_note", "tier", "category", "clean_path", "noisy_path", "output_path"}

    def column(name: str):
        if name in given:
            return given[name].alias(name)
        if name in rows.columns:
            return F.col(name)
        return F.lit(None).cast("string" if name in texts else "double").alias(name)

    return rows.select(*[column(name) for name in RESULT_FIELDS])
