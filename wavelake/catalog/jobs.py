"""Whole-job queries over the given tables."""

from pyspark.sql import functions as F

from wavelake.catalog import audit as _audit  # noqa: F401  (registers the twins of the summary first)
from wavelake.catalog.matching import OUTPUT_SQL, outputs
from wavelake.catalog.registry import ORACLES, Tables, query, rounded
from wavelake.catalog.rules import CATEGORIES, TIER_SQL
from wavelake.catalog.scores import BIN_SQL, METRIC_TABLE_SQL, snr_rms_sql
from wavelake.catalog.signals import ALIGNED_SQL, PHAT_SQL
from wavelake.catalog.views import RECORD_NOISES, RECORDS, SIG_PAIRS, SOURCES, sql
from wavelake.jobs import dataset as D
from wavelake.jobs import reports as R
from wavelake.operators.rules import tier_of

SUMMARY = sql(RECORDS, RECORD_NOISES, SOURCES)


@query(
    "job2_dataset_summary",
    SUMMARY
    + """SELECT (SELECT count(*) FROM records) AS total_samples, (SELECT round(sum(duration_seconds) / 3600, 4) + 0.0 FROM records) AS total_duration_hours,
    (SELECT round(min(measured_snr_db), 4) + 0.0 FROM records) AS snr_min, (SELECT round(max(measured_snr_db), 4) + 0.0 FROM records) AS snr_max,
    (SELECT round(avg(measured_snr_db), 4) + 0.0 FROM records) AS snr_mean, (SELECT round(avg(measured_snr_db - target_snr_db), 4) + 0.0 FROM records) AS snr_error_mean_db,
    (SELECT count(DISTINCT clean_source) FROM records) AS clean_sources_used, (SELECT count(DISTINCT source) FROM record_noises) AS noise_sources_used,
    (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM records WHERE clipping_prevented) AS clipping_gain_samples,
    (SELECT CAST(sum(n_events) AS BIGINT) FROM record_noises) AS impulsive_events""",
)
def dataset_summary(t: Tables):
    records = t.views.records.withColumn("clean_speaker_id", F.col("clean_source") % 40)
    totals = R.dataset_summary(records, t.views.record_noises, t.views.sources)["totals"]
    plain = ["total_samples", "clean_sources_used", "noise_sources_used", "sources", "clipping_gain_samples", "impulsive_events"]
    real = ["total_duration_hours", "snr_min", "snr_max", "snr_mean", "snr_error_mean_db"]
    return totals.select(*plain, *[(F.col(c) + F.lit(0.0)).alias(c) for c in real])


def _measures(section: str, name: str, source: str, *columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, CAST({name} AS VARCHAR) AS name, '{c}' AS measure, CAST({c} AS DOUBLE) AS value FROM ({source}) s" for c in columns)


@query(
    "job2_summary_tables",
    " UNION ALL ".join(
        [
            _measures("splits", "split", ORACLES["agg6_split_totals"], "samples", "hours"),
            _measures("usage", "concat(kind, '/', name)", ORACLES["agg1_usage_counts"], "uses"),
            _measures("snr_distribution", "label", ORACLES["agg3_snr_histogram"], "samples"),
            _measures("noise_counts", "num_noises", ORACLES["agg6_noise_count_distribution"], "samples"),
        ]
    ),
)
def summary_tables(t: Tables):
    """Everything of the summary but the totals, which `job2_dataset_summary` has."""
    records = t.views.records.withColumn("clean_speaker_id", F.col("clean_source") % 40)
    tables = R.dataset_summary(records, t.views.record_noises, t.views.sources)
    rows = R.summary_rows({name: table for name, table in tables.items() if name != "totals"})
    return rows.withColumn("value", F.col("value") + F.lit(0.0))


MANIFEST_SQL = (
    RECORDS
    + ", q AS (SELECT k, CAST(k AS VARCHAR) AS id, (['engine','wind','vehicle','helicopter','siren','gunfire','artillery','explosion','crowd'])[CAST(k % 9 AS INTEGER) + 1] AS category, * EXCLUDE (k) FROM records), "
    "tr AS (SELECT 'train' AS part, concat('mix_', CASE WHEN k % 100 = 12 THEN '00' ELSE id END) AS mixture_id, "
    "CASE WHEN split <> 'train' THEN 'FAIL' WHEN " + TIER_SQL.format(c="category") + " IS DISTINCT FROM CASE WHEN k % 29 = 0 THEN 'A' ELSE " + TIER_SQL.format(c="category") + " END THEN 'FAIL' "
    "WHEN target_snr_db * 0.6 NOT BETWEEN -5 AND 20 THEN 'FAIL' WHEN clipping_prevented AND k % 3 = 0 THEN 'WARN' ELSE 'PASS' END AS ms, clipping_prevented AND k % 3 = 0 AS clip, category, NULL AS cell, NULL AS idx, 'train' AS role FROM q), "
    "va AS (SELECT 'val' AS part, concat('val_', id) AS mixture_id, CASE WHEN k % 8 = 0 THEN 'FAIL' ELSE 'PASS' END AS ms, false AS clip, category, floor(target_snr_db) AS cell, k AS idx, "
    "CASE WHEN k % 8 = 0 THEN 'invalid' WHEN k % 14 = 1 THEN 'eval_frozen' WHEN k % 22 = 3 THEN 'calibration' ELSE 'val_pool' END AS role FROM q), "
    "te AS (SELECT 'test' AS part, concat('test_', id) AS mixture_id, CASE WHEN k % 8 = 0 THEN 'FAIL' ELSE 'PASS' END AS ms, false AS clip, category, floor(target_snr_db) AS cell, k AS idx, CASE WHEN k % 8 = 0 THEN 'invalid' ELSE 'test' END AS role FROM q), "
    "al AS (FROM tr UNION ALL FROM va UNION ALL FROM te), "
    "dp AS (SELECT *, CASE WHEN ms <> 'FAIL' AND count(*) FILTER (WHERE ms <> 'FAIL') OVER (PARTITION BY part, mixture_id) > 1 THEN 'FAIL' ELSE ms END AS status, "
    "CASE WHEN part = 'train' THEN CASE WHEN mixture_id LIKE '%7' THEN 'WARN' ELSE 'PASS' END ELSE CASE WHEN idx % 3 = 0 THEN 'UNAVAILABLE' ELSE 'PASS' END END AS au FROM al), "
    "el AS (SELECT *, status <> 'FAIL' AND au IN ('PASS', 'WARN') AND NOT clip AND NOT (au = 'WARN') AS ok FROM dp), "
    "sl AS (SELECT *, row_number() OVER (PARTITION BY part, category, cell ORDER BY idx) AS rn FROM el WHERE role = 'val_pool' AND ok), "
    "fin AS (SELECT el.part, el.mixture_id, el.status, el.ok, el.ms, el.au, CASE WHEN sl.rn = 1 THEN 'val_select' ELSE el.role END AS role FROM el LEFT JOIN sl ON sl.part = el.part AND sl.mixture_id = el.mixture_id AND sl.role = 'val_pool' AND sl.rn = 1) "
)


def manifests(t: Tables):
    rows = t.views.records
    k, text = F.col("k"), F.col("k").cast("string")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (k % 9 + 1).cast("int"))
    target = F.col("target_snr_db") * 0.6
    name = F.concat(F.lit("mix_"), F.when(k % 100 == 12, "00").otherwise(text))
    train = rows.select(
        name.alias("mixture_id"), "split", category.alias("category"),
        F.when(k % 29 == 0, "A").otherwise(tier_of(category)).alias("tier"),
        target.alias("target_snr_db"), target.alias("measured_snr_db"), F.col("duration_seconds").alias("duration_sec"), F.lit(1).alias("n_events"),
        (F.col("clipping_prevented") & (k % 3 == 0)).alias("clipping_flag"),
        F.concat(F.lit("n/"), name).alias("noisy_path"), F.concat(F.lit("c/"), name).alias("clean_path"),
    )

    def audit(prefix: str):
        ident = F.concat(F.lit(prefix), text)
        return rows.select(
            ident.alias("mixture_id"), category.alias("category"), F.floor("target_snr_db").alias("snr_db"),
            F.when(k % 8 == 0, "FAIL").otherwise("PASS").alias("status"), F.lit("length").alias("reason"),
            ident.alias("noisy_member"), ident.alias("clean_member"),
        )

    ids = rows.select(F.concat(F.lit("val_"), text).alias("mixture_id"), "k")
    paths = train.select("noisy_path", F.lit(True).alias("found"), F.col("mixture_id").endswith("7").alias("loud")).unionByName(
        audit("val_").unionByName(audit("test_")).select(
            F.concat(F.lit("mixtures/"), "noisy_member").alias("noisy_path"),
            (F.regexp_extract("mixture_id", r"(\d+)$", 1).cast("bigint") % 3 != 0).alias("found"), F.lit(False).alias("loud"),
        )
    ).distinct()
    measures = paths.select(
        F.col("noisy_path").alias("noisy_relpath"), F.col("found").alias("noisy_found"), F.lit(True).alias("clean_found"),
        F.lit(None).cast("string").alias("read_error"), *[F.lit(48000).alias(c) for c in ("sample_rate", "clean_sample_rate")],
        *[F.lit(1).alias(c) for c in ("channels", "clean_channels")], *[F.lit(10).alias(c) for c in ("frames", "clean_frames")],
        F.lit(True).alias("all_finite"), F.lit(0).alias("alignment_lag"), F.lit(0.1).alias("rms_residual"), F.lit(0.1).alias("rms_clean"),
        F.when(F.col("loud"), 1.0).otherwise(0.5).alias("peak_noisy"), F.lit(0.5).alias("peak_clean"),
        *[F.lit(1.0).alias(c) for c in ("duration_sec", "duration_sec_meta", "measured_snr_db_audio", "measured_snr_db_meta")],
    )
    return R.build_manifests(
        {"train": (train, "train")}, {"val": audit("val_"), "test": audit("test_")},
        [ids.where("k % 14 = 1"), ids.where("k % 28 = 1")], ids.where("k % 22 = 3"), measures,
    )


@query(
    "job3_build_manifests",
    sql(MANIFEST_SQL)
    + "SELECT part, mixture_id, role, status AS meta_status, role IN ('train', 'dev_train') AND ok AS use_for_training, role = 'val_select' AND ok AS use_for_selection FROM fin",
)
def build_manifests(t: Tables):
    return manifests(t).select("part", "mixture_id", "role", "meta_status", "use_for_training", "use_for_selection")


@query(
    "job3_manifest_summary",
    sql(MANIFEST_SQL)
    + ", st AS (SELECT *, CASE WHEN ms = 'FAIL' THEN 'UNVERIFIED' ELSE au END AS audio FROM fin) "
    + "SELECT part, 'role' AS kind, role AS value, count(*) AS rows FROM st GROUP BY part, role "
    + "UNION ALL SELECT part, 'meta_status', status, count(*) FROM st GROUP BY part, status UNION ALL SELECT part, 'audio_status', audio, count(*) FROM st GROUP BY part, audio "
    + "UNION ALL SELECT part, 'audio_flag', CASE audio WHEN 'WARN' THEN 'noisy clipped' ELSE 'noisy missing' END, count(*) FROM st WHERE audio IN ('WARN', 'UNAVAILABLE') GROUP BY 1, 2, 3 "
    + "UNION ALL SELECT part, 'used', 'use_for_training', count(*) FROM st WHERE role = 'train' AND ok GROUP BY part "
    + "UNION ALL SELECT part, 'used', 'use_for_selection', count(*) FROM st WHERE role = 'val_select' AND ok GROUP BY part",
)
def manifest_summary(t: Tables):
    """Counts of the flags of the metadata, whose texts `flt1_metadata_checks` has, are left out here alone."""
    return R.manifest_summary(manifests(t)).where("kind <> 'meta_flag'")


# Noisy and enhanced as signals of their own, numbered 2 * id and 2 * id + 1.
STAGED_SQL = (
    sql(SIG_PAIRS.replace("sig_pairs AS", "base_pairs AS"))
    + ", sig_pairs AS (SELECT signal_id * 2 AS signal_id, t, clean, noisy AS est FROM base_pairs WHERE signal_id % 9 <> 4 UNION ALL SELECT signal_id * 2 + 1, t, clean, est FROM base_pairs WHERE signal_id % 9 <> 4) "
    + PHAT_SQL + ALIGNED_SQL.format(lags="ph")
)


def stages_of_pairs(t: Tables):
    pairs = t.views.sig_pairs
    clean = pairs.select("signal_id", "t", F.col("clean").alias("x"))
    staged = pairs.where("signal_id % 9 <> 4").select("signal_id", "t", F.lit("noisy").alias("stage"), F.col("noisy").alias("x")).unionByName(
        pairs.select("signal_id", "t", F.lit("enhanced").alias("stage"), F.col("est").alias("x"))
    )
    return R.evaluate_stages(clean, staged, ["noisy", "enhanced"], 4)


@query(
    "job4_evaluate_stages",
    STAGED_SQL
    + ", me AS (SELECT signal_id % 2 AS stage_ord, avg(snr) AS snr, avg(si_sdr) AS si_sdr FROM al GROUP BY 1) "
    "SELECT CASE m.stage_ord WHEN 0 THEN 'noisy' ELSE 'enhanced' END AS stage, round(m.snr, 5) + 0.0 AS snr, round(m.si_sdr, 5) + 0.0 AS si_sdr, round(m.snr - p.snr, 5) + 0.0 AS d_snr, round(m.si_sdr - p.si_sdr, 5) + 0.0 AS d_si_sdr "
    "FROM me m LEFT JOIN me p ON p.stage_ord = m.stage_ord - 1",
)
def evaluate_stages(t: Tables):
    _, means = stages_of_pairs(t)
    return means.select("stage", *[rounded(F.col(c), 5).alias(c) for c in ("snr", "si_sdr", "d_snr", "d_si_sdr")])


@query(
    "job4_scores_per_file",
    STAGED_SQL
    + "SELECT signal_id // 2 AS signal_id, CASE signal_id % 2 WHEN 0 THEN 'noisy' ELSE 'enhanced' END AS stage, lag, round(gain, 5) + 0.0 AS gain, round(snr, 5) + 0.0 AS snr, round(si_sdr, 5) + 0.0 AS si_sdr FROM al JOIN ph USING (signal_id)",
)
def scores_per_file(t: Tables):
    per_file, _ = stages_of_pairs(t)
    return per_file.select("signal_id", "stage", "lag", *[rounded(F.col(c), 5).alias(c) for c in ("gain", "snr", "si_sdr")])


SYSTEM_SQL = (
    ", f AS (SELECT CASE WHEN signal_id % 3 = 0 THEN 'transient' ELSE 'continuous' END AS suite, signal_id AS mixture_id, "
    + snr_rms_sql("noisy") + " AS input_snr_db, " + snr_rms_sql("est") + " AS s1, "
    + snr_rms_sql("(0.5 * est + 0.5 * noisy)") + " AS s2 FROM sig_pairs GROUP BY signal_id), "
    "s AS (SELECT *, unnest(['est', 'half']) AS system, unnest([s1, s2]) AS output_snr_db FROM f), "
    "b AS (SELECT *, output_snr_db - input_snr_db AS dsnr_db, " + BIN_SQL.format(v="input_snr_db") + " AS snr_bin FROM s) "
)


def systems_of_pairs(t: Tables):
    suite = F.when(F.col("signal_id") % 3 == 0, "transient").otherwise("continuous").alias("suite")
    pairs = t.views.sig_pairs.select(
        suite, F.col("signal_id").alias("mixture_id"), "t", "clean", "noisy", "est", (0.5 * F.col("est") + 0.5 * F.col("noisy")).alias("half")
    )
    return R.evaluate_systems(pairs, ["est", "half"])


@query(
    "job5_evaluate_systems",
    sql(SIG_PAIRS) + SYSTEM_SQL
    + METRIC_TABLE_SQL.format(metrics="round(avg(output_snr_db), 6) + 0.0 AS output_snr_db, round(avg(dsnr_db), 6) + 0.0 AS dsnr_db"),
)
def evaluate_systems(t: Tables):
    groups = systems_of_pairs(t)["groups"]
    return groups.select("grouping_kind", "label", "system", "n", *[rounded(F.col(m)).alias(m) for m in ("output_snr_db", "dsnr_db")])


@query(
    "job5_scores_per_file",
    sql(SIG_PAIRS) + SYSTEM_SQL
    + "SELECT suite, mixture_id, system, round(input_snr_db, 6) + 0.0 AS input_snr_db, round(output_snr_db, 6) + 0.0 AS output_snr_db, round(dsnr_db, 6) + 0.0 AS dsnr_db FROM b",
)
def system_scores_per_file(t: Tables):
    per_file = systems_of_pairs(t)["per_file"]
    return per_file.select("suite", "mixture_id", "system", *[rounded(F.col(m)).alias(m) for m in ("input_snr_db", "output_snr_db", "dsnr_db")])


@query(
    "job5_per_file_pivot",
    sql(SIG_PAIRS) + SYSTEM_SQL
    + "SELECT mixture_id, round(max(dsnr_db) FILTER (WHERE system = 'est'), 6) + 0.0 AS est_dsnr_db, round(max(dsnr_db) FILTER (WHERE system = 'half'), 6) + 0.0 AS half_dsnr_db FROM b GROUP BY mixture_id",
)
def system_pivot(t: Tables):
    wide = systems_of_pairs(t)["per_file_wide"]
    return wide.select("mixture_id", *[rounded(F.col(c)).alias(c) for c in ("est_dsnr_db", "half_dsnr_db")])


@query(
    "job7_recover",
    sql(RECORDS) + OUTPUT_SQL
    + """, o AS (SELECT clean_output AS path FROM rec UNION ALL SELECT noisy_output FROM rec)
    SELECT 'duplicate' AS action, sample_id AS path FROM rec GROUP BY sample_id HAVING count(*) > 1 UNION ALL
    SELECT 'delete', path FROM disk WHERE path NOT IN (FROM o) UNION ALL SELECT 'missing', path FROM o WHERE path NOT IN (SELECT path FROM disk)""",
)
def recover(t: Tables):
    recs, files = outputs(t)
    return R.recover(recs, recs, files)


@query(
    "job8_score_triplets",
    sql(SIG_PAIRS)
    + ", p AS (SELECT signal_id, t, clean, noisy, CASE WHEN signal_id % 10 = 0 THEN clean ELSE est END AS est FROM sig_pairs) SELECT signal_id AS mixture_id, round("
    + snr_rms_sql("noisy") + ", 6) + 0.0 AS input_snr_db, signal_id % 10 = 0 AS exact, round(CASE WHEN signal_id % 10 <> 0 THEN " + snr_rms_sql("est")
    + " END, 6) + 0.0 AS output_snr_db, round(count(*) / 48000.0::DOUBLE, 9) + 0.0 AS duration_sec, round(0.01 / (count(*) / 48000.0::DOUBLE), 6) + 0.0 AS rtf, "
    + "round(max(abs(est)), 6) + 0.0 AS output_peak, count(*) FILTER (WHERE abs(est) >= 0.999) AS output_clipping_samples FROM p GROUP BY signal_id",
)
def score_triplets(t: Tables):
    out = F.when(F.col("signal_id") % 10 == 0, F.col("clean")).otherwise(F.col("est"))
    samples = t.views.sig_pairs.select(F.col("signal_id").alias("mixture_id"), "t", "clean", "noisy", out.alias("output"))
    pairs = samples.select("mixture_id").distinct().withColumn("processing_time_sec", F.lit(0.01))
    rows = R.score_triplets(samples, pairs, "exp")
    exact = F.col("output_snr_db") == float("inf")
    return rows.select(
        "mixture_id", rounded(F.col("input_snr_db")).alias("input_snr_db"), exact.alias("exact"),
        rounded(F.when(~exact, F.col("output_snr_db"))).alias("output_snr_db"), rounded(F.col("duration_sec"), 9).alias("duration_sec"),
        rounded(F.col("rtf")).alias("rtf"), rounded(F.col("output_peak")).alias("output_peak"), "output_clipping_samples",
    )


def generated(t: Tables):
    """A generation run whose sources are the event signals: half of the users are clean speech, half are noise."""
    samples = t.views.sig_samples.select(F.concat(F.lit("s/"), F.col("signal_id").cast("string")).alias("rel"), "signal_id", "t", "x")
    lengths = samples.groupBy("rel", "signal_id").agg(F.count(F.lit(1)).alias("length"))
    lengths = lengths.withColumn("sample_rate", F.lit(48000)).withColumn("channels", F.lit(1))
    nothing = F.lit(None).cast("string")
    clean = lengths.where("signal_id % 2 = 0").select(
        "rel", "length", "sample_rate", "channels", F.lit("events").alias("clean_dataset"), nothing.alias("clean_speaker_id"),
        nothing.alias("clean_language"), nothing.alias("clean_accent"),
    )
    noise = lengths.where("signal_id % 2 = 1").select(
        "rel", "length", "sample_rate", "channels", F.lit("events").alias("noise_dataset"),
        F.concat(F.lit("c"), (F.col("signal_id") % 7).cast("string")).alias("noise_category"),
    )
    source = samples.select(F.col("rel").alias("source"), "t", "x")
    # One planned sample per two signals, so the run grows with the table.
    plan = lengths.where("signal_id % 2 = 0").select(
        (F.col("signal_id") + 1).alias("k"), F.when(F.col("signal_id") % 10 == 0, "val").otherwise("train").alias("split")
    )
    config = D.DatasetConfig(
        num_noises=(1, 3), impulsive_categories=("c3",), impulsive_count=(1, 3), impulsive_duration=(5, 20), fade=2, frame=10, hop=4,
        below_p95=12.0, min_gap=3, min_region=8, min_clean=60, max_clean=64, random_start=True, max_attempts=6,
    )
    return D.generate_dataset(t.spark, config, clean, noise, source, source, plan=plan, size=4096), source


@query("job1_generate_dataset")
def generate(t: Tables):
    dataset, _ = generated(t)
    return dataset.records.select(
        "sample_id", "split", "clean_source", "num_noises", "target_snr_db", "measured_snr_db", "snr_error_db", "output_gain", "random_seed"
    )


@query("sig12_reconstruct_check")
def reconstruct(t: Tables):
    dataset, source = generated(t)
    return D.reconstruct_check(dataset.records, source, source, dataset.audio.select("sample_id", "t", "clean", "noisy"))
