"""Metric and score reports."""

from pyspark.sql import functions as F

from wavelake.catalog.registry import Tables, query, rounded
from wavelake.catalog.views import FRAME_BINS, SCORES, SIG_PAIRS, SIG_SAMPLES, sql
from wavelake.functions import metrics as M
from wavelake.functions.scalars import snr_bin
from wavelake.operators import scores as S

def snr_rms_sql(est: str) -> str:
    return (
        f"20 * log10(greatest(sqrt(avg(clean * clean)), 1e-12) / greatest(sqrt(avg(({est} - clean) * ({est} - clean))), 1e-12))"
    )


PAIR_METRICS = (
    "10 * log10(sum(clean * clean) / (sum((clean - est) * (clean - est)) + 1e-12))",
    snr_rms_sql("est"),
    "10 * log10(avg(clean * clean) FILTER (WHERE t % 3 <> 0) / avg((noisy - clean) * (noisy - clean)) FILTER (WHERE t % 3 <> 0))",
)


@query(
    "agg11_levels",
    sql(SIG_SAMPLES)
    + """SELECT signal_id, count(*) AS n, round(sqrt(avg(x * x)), 6) + 0.0 AS rms, round(avg(x * x), 6) + 0.0 AS power,
    round(max(abs(x)), 6) + 0.0 AS peak, round(20 * log10(sqrt(avg(x * x)) + 1e-12), 6) + 0.0 AS dbfs
    FROM sig_samples GROUP BY signal_id""",
)
def levels(t: Tables):
    return t.views.sig_samples.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(M.rms("x")).alias("rms"),
        rounded(M.mean_power("x")).alias("power"),
        rounded(M.peak("x")).alias("peak"),
        rounded(M.level_dbfs("x")).alias("dbfs"),
    )


@query(
    "agg12_snr_definitions",
    sql(SIG_PAIRS)
    + f"""SELECT signal_id, round({PAIR_METRICS[0]}, 6) + 0.0 AS snr_energy, round({PAIR_METRICS[1]}, 6) + 0.0 AS snr_rms,
    round({PAIR_METRICS[2]}, 6) + 0.0 AS snr_masked FROM sig_pairs GROUP BY signal_id""",
)
def snr_definitions(t: Tables):
    return t.views.sig_pairs.groupBy("signal_id").agg(
        rounded(M.snr_energy_db("clean", "est")).alias("snr_energy"),
        rounded(M.snr_rms_db("clean", "est")).alias("snr_rms"),
        rounded(M.snr_masked_db("clean", "noisy", F.col("t") % 3 != 0)).alias("snr_masked"),
    )


@query(
    "agg12_snr_decoded",
    sql(SIG_PAIRS)
    + """, de AS (SELECT signal_id, t, least(greatest(round_even(clean * 32768, 0), -32768), 32767) / 32768 AS c, least(greatest(round_even(noisy * 32768, 0), -32768), 32767) / 32768 AS n FROM sig_pairs)
    SELECT signal_id, round(10 * log10(avg(c * c) FILTER (WHERE t % 3 <> 0) / avg((n - c) * (n - c)) FILTER (WHERE t % 3 <> 0)), 6) + 0.0 AS snr_decoded FROM de GROUP BY signal_id""",
)
def snr_decoded(t: Tables):
    return t.views.sig_pairs.groupBy("signal_id").agg(rounded(M.snr_decoded_db("clean", "noisy", F.col("t") % 3 != 0)).alias("snr_decoded"))


@query(
    "agg13_si_sdr_definitions",
    sql(SIG_PAIRS)
    + """, m AS (SELECT *, avg(clean) OVER (PARTITION BY signal_id) AS mc, avg(est) OVER (PARTITION BY signal_id) AS me FROM sig_pairs),
    g AS (SELECT *, sum(clean * est) OVER w / (sum(clean * clean) OVER w + 1e-12) AS a,
      sum((clean - mc) * (est - me)) OVER w / greatest(sum((clean - mc) * (clean - mc)) OVER w, 1e-20) AS b
      FROM m WINDOW w AS (PARTITION BY signal_id))
    SELECT signal_id,
      round(10 * log10((sum(a * clean * a * clean) + 1e-12) / (sum((est - a * clean) * (est - a * clean)) + 1e-12)), 6) + 0.0 AS si_sdr,
      round(10 * log10(greatest(sum(b * (clean - mc) * b * (clean - mc)), 1e-20)
        / greatest(sum((est - me - b * (clean - mc)) * (est - me - b * (clean - mc))), 1e-20)), 6) + 0.0 AS si_sdr_centred
    FROM g GROUP BY signal_id""",
)
def si_sdr_definitions(t: Tables):
    return t.views.sig_pairs.groupBy("signal_id").agg(
        rounded(M.si_sdr_db("clean", "est")).alias("si_sdr"),
        rounded(M.si_sdr_centred_db("clean", "est")).alias("si_sdr_centred"),
    )


@query(
    "agg14_optimal_gain",
    sql(SIG_PAIRS)
    + "SELECT signal_id, round(sum(clean * est) / (sum(est * est) + 1e-12), 6) + 0.0 AS gain FROM sig_pairs GROUP BY signal_id",
)
def optimal_gain(t: Tables):
    return t.views.sig_pairs.groupBy("signal_id").agg(rounded(M.optimal_gain("clean", "est")).alias("gain"))


@query(
    "agg15_output_health",
    sql(SIG_PAIRS)
    + """SELECT signal_id, round(max(abs(est * 10)), 6) + 0.0 AS peak, count(*) FILTER (WHERE abs(est * 10) >= 0.999) AS clipped
    FROM sig_pairs GROUP BY signal_id""",
)
def output_health(t: Tables):
    return t.views.sig_pairs.withColumn("y", F.col("est") * 10).groupBy("signal_id").agg(
        rounded(M.peak("y")).alias("peak"), M.clipped_samples("y").alias("clipped")
    )


@query(
    "udf3_metric_aggregates",
    sql(SIG_PAIRS)
    + f"""SELECT signal_id % 10 AS bucket, round({PAIR_METRICS[0]}, 6) + 0.0 AS snr,
    round(sum(clean * est) / (sum(est * est) + 1e-12), 6) + 0.0 AS gain, round(sqrt(avg(est * est)), 6) + 0.0 AS rms
    FROM sig_pairs GROUP BY signal_id % 10""",
)
def metric_aggregates(t: Tables):
    return t.views.sig_pairs.groupBy((F.col("signal_id") % 10).alias("bucket")).agg(
        rounded(M.snr_energy_db("clean", "est")).alias("snr"),
        rounded(M.optimal_gain("clean", "est")).alias("gain"),
        rounded(M.rms("est")).alias("rms"),
    )


BIN_SQL = (
    "CASE WHEN {v} < 0 THEN '<0' WHEN {v} < 5 THEN '0-5' WHEN {v} < 10 THEN '5-10' WHEN {v} < 15 THEN '10-15' "
    "WHEN {v} < 20 THEN '15-20' ELSE '>=20' END"
)

METRIC_TABLE_SQL = """SELECT CASE WHEN grouping(suite) = 0 THEN 'suite' WHEN grouping(snr_bin) = 0 THEN 'snr_bin' ELSE 'ALL' END AS grouping_kind,
    CASE WHEN grouping(suite) = 0 THEN suite WHEN grouping(snr_bin) = 0 THEN snr_bin ELSE 'ALL' END AS label, system, count(*) AS n, {metrics}
    FROM b GROUP BY GROUPING SETS ((system), (suite, system), (snr_bin, system))"""


@query(
    "agg8_metric_table",
    sql(SCORES)
    + ", b AS (SELECT *, " + BIN_SQL.format(v="input_snr_db") + " AS snr_bin FROM scores) "
    + METRIC_TABLE_SQL.format(
        metrics="round(avg(output_snr_db), 6) + 0.0 AS output_snr_db, round(avg(pesq_wb), 6) + 0.0 AS pesq_wb, round(avg(stoi), 6) + 0.0 AS stoi"
    ),
)
def metric_table(t: Tables):
    metrics = ["output_snr_db", "pesq_wb", "stoi"]
    table = S.metric_table(t.views.scores, metrics)
    return table.select("grouping_kind", "label", "system", "n", *[rounded(F.col(m)).alias(m) for m in metrics])


@query(
    "job_quality_report",
    sql(SIG_PAIRS)
    + """, f AS (SELECT signal_id, CASE WHEN signal_id % 3 = 0 THEN 'transient' ELSE 'continuous' END AS suite,
      10 * log10(sum(clean * clean) / (sum((clean - noisy) * (clean - noisy)) + 1e-12)) AS input_snr_db,
      10 * log10(sum(clean * clean) / (sum((clean - est) * (clean - est)) + 1e-12)) AS est_snr FROM sig_pairs GROUP BY signal_id),
    s AS (SELECT *, unnest(['noisy', 'estimate']) AS system FROM f),
    b AS (SELECT suite, system, CASE WHEN system = 'noisy' THEN input_snr_db ELSE est_snr END AS output_snr_db, input_snr_db, """
    + BIN_SQL.format(v="input_snr_db")
    + " AS snr_bin FROM s) "
    + METRIC_TABLE_SQL.format(
        metrics="round(avg(output_snr_db), 6) + 0.0 AS output_snr_db, round(avg(output_snr_db - input_snr_db), 6) + 0.0 AS dsnr_db"
    ),
)
def quality_report(t: Tables):
    per_file = t.views.sig_pairs.groupBy("signal_id").agg(
        M.snr_energy_db("clean", "noisy").alias("input_snr_db"), M.snr_energy_db("clean", "est").alias("est_snr")
    )
    suite = F.when(F.col("signal_id") % 3 == 0, "transient").otherwise("continuous").alias("suite")
    systems = F.explode(
        F.array(
            F.struct(F.lit("noisy").alias("system"), F.col("input_snr_db").alias("snr")),
            F.struct(F.lit("estimate").alias("system"), F.col("est_snr").alias("snr")),
        )
    ).alias("s")
    scored = per_file.select("signal_id", suite, "input_snr_db", systems).select(
        suite.alias("suite"),
        "input_snr_db",
        "s.system",
        F.col("s.snr").alias("output_snr_db"),
        (F.col("s.snr") - F.col("input_snr_db")).alias("dsnr_db"),
    )
    metrics = ["output_snr_db", "dsnr_db"]
    table = S.metric_table(scored, metrics)
    return table.select("grouping_kind", "label", "system", "n", *[rounded(F.col(m)).alias(m) for m in metrics])


STAGES = (
    ", st AS (SELECT system AS stage, CASE system WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS stage_ord, "
    "output_snr_db, pesq_wb, stoi FROM scores), "
    "mn AS (SELECT stage, stage_ord, avg(output_snr_db) AS output_snr_db, avg(pesq_wb) AS pesq_wb, avg(stoi) AS stoi FROM st GROUP BY ALL) "
)
STAGE_METRICS = ["output_snr_db", "pesq_wb", "stoi"]


def stage_scores(t: Tables):
    order = F.when(F.col("system") == "N", 0).when(F.col("system") == "R", 1).otherwise(2)
    return t.views.scores.select(F.col("system").alias("stage"), order.alias("stage_ord"), *STAGE_METRICS)


@query(
    "agg9_stage_means",
    sql(SCORES) + STAGES
    + """SELECT stage, stage_ord, round(output_snr_db, 6) + 0.0 AS output_snr_db, round(pesq_wb, 6) + 0.0 AS pesq_wb,
    round(stoi, 6) + 0.0 AS stoi FROM mn""",
)
def stage_means(t: Tables):
    means = S.stage_means(stage_scores(t), STAGE_METRICS)
    return means.select("stage", "stage_ord", *[rounded(F.col(m)).alias(m) for m in STAGE_METRICS])


@query(
    "win2_stage_delta",
    sql(SCORES) + STAGES
    + """SELECT stage, stage_ord, round(output_snr_db - lag(output_snr_db) OVER w, 6) + 0.0 AS d_output_snr_db,
    round(pesq_wb - lag(pesq_wb) OVER w, 6) + 0.0 AS d_pesq_wb, round(stoi - lag(stoi) OVER w, 6) + 0.0 AS d_stoi
    FROM mn WINDOW w AS (ORDER BY stage_ord)""",
)
def stage_delta(t: Tables):
    delta = S.stage_delta(S.stage_means(stage_scores(t), STAGE_METRICS), STAGE_METRICS)
    return delta.select("stage", "stage_ord", *[rounded(F.col(f"d_{m}")).alias(f"d_{m}") for m in STAGE_METRICS])


@query(
    "agg10_improvement",
    sql(SCORES)
    + """SELECT round(avg(output_snr_db - input_snr_db), 6) + 0.0 AS snr_improvement,
    round(avg(pesq_wb - (1 + stoi)), 6) + 0.0 AS pesq_improvement FROM scores""",
)
def improvement(t: Tables):
    pairs = t.views.scores.select(
        F.col("output_snr_db").alias("snr_enhanced"),
        F.col("input_snr_db").alias("snr_noisy"),
        F.col("pesq_wb").alias("pesq_enhanced"),
        (1 + F.col("stoi")).alias("pesq_noisy"),
    )
    result = S.improvement(pairs, ["snr", "pesq"])
    return result.select(*[rounded(F.col(c)).alias(c) for c in result.columns])


@query(
    "agg18_per_file_pivot",
    sql(SCORES)
    + "SELECT mixture_id, "
    + ", ".join(
        f"round(max({m}) FILTER (WHERE system = '{s}'), 6) + 0.0 AS \"{s}_{m}\"" for s in "ANR" for m in ("output_snr_db", "pesq_wb")
    )
    + " FROM scores GROUP BY mixture_id",
)
def per_file_pivot(t: Tables):
    wide = S.per_file_pivot(t.views.scores, ["A", "N", "R"], ["output_snr_db", "pesq_wb"])
    return wide.select("mixture_id", *[rounded(F.col(c)).alias(c) for c in wide.columns if c != "mixture_id"])


@query(
    "agg22_validation_report",
    sql(SCORES)
    + """SELECT round(avg(1 - stoi), 6) + 0.0 AS val_loss, count(*) AS val_files,
    round(avg(output_snr_db - input_snr_db), 6) + 0.0 AS val_snr_improvement_db, round(avg(stoi), 6) + 0.0 AS val_stoi,
    round(avg(pesq_wb), 6) + 0.0 AS val_pesq, round(max(stoi), 6) + 0.0 AS val_output_peak_max,
    CAST(sum(j) AS BIGINT) AS val_clipping_samples, round(sum(input_snr_db + 5), 6) + 0.0 AS val_audio_sec FROM scores""",
)
def validation_report(t: Tables):
    rows = t.views.scores.select(
        (1 - F.col("stoi")).alias("loss"),
        (F.col("output_snr_db") - F.col("input_snr_db")).alias("snr_improvement_db"),
        "stoi",
        F.col("pesq_wb").alias("pesq"),
        F.col("stoi").alias("output_peak"),
        F.col("j").cast("bigint").alias("output_clipping_samples"),
        (F.col("input_snr_db") + 5).alias("audio_sec"),
    )
    report = S.validation_report(rows)
    whole = ("val_files", "val_clipping_samples")
    return report.select(*[F.col(c) if c in whole else rounded(F.col(c)).alias(c) for c in report.columns])


@query(
    "flt9_meets_targets",
    sql(SCORES)
    + """, m AS (SELECT system, list_filter([CASE WHEN coalesce(output_snr_db < 15, true) THEN 'out SNR' END,
      CASE WHEN coalesce(stoi < 0.85, true) THEN 'STOI' END, CASE WHEN coalesce(pesq_wb < 2.5, true) THEN 'PESQ-WB' END],
      lambda v: v IS NOT NULL) AS missed FROM scores)
    SELECT system, array_to_string(missed, ';') AS missed, count(*) AS files, count(*) FILTER (WHERE len(missed) = 0) AS met
    FROM m GROUP BY system, missed""",
)
def meets_targets(t: Tables):
    rows = S.meets_targets(t.views.scores)
    return rows.groupBy("system", F.array_join("missed", ";").alias("missed")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("meets_all").alias("met")
    )


@query(
    "flt10_numerical_issues",
    sql(SCORES)
    + """, w AS (SELECT mixture_id, j, stoi AS w0, CASE WHEN mixture_id % 17 = 0 THEN 1 - stoi + 0.001 ELSE 1 - stoi END AS w1,
      CASE WHEN pesq_wb IS NULL THEN CAST('nan' AS DOUBLE) ELSE pesq_wb END AS v, stoi AS p FROM scores),
    i AS (SELECT mixture_id, j, 'weights non-finite or not summing to 1' AS issue FROM w WHERE NOT abs(w0 + w1 - 1) <= 1e-5
      UNION ALL SELECT mixture_id, j, 'non-finite output' FROM w WHERE isnan(v)
      UNION ALL SELECT mixture_id, j, 'output peak' FROM w WHERE p >= 0.999)
    SELECT issue, mixture_id, count(*) AS n FROM i GROUP BY issue, mixture_id""",
)
def numerical_issues(t: Tables):
    rows = t.views.scores.select(
        "mixture_id",
        F.col("stoi").alias("w0"),
        (1 - F.col("stoi") + F.when(F.col("mixture_id") % 17 == 0, 0.001).otherwise(0.0)).alias("w1"),
        F.coalesce("pesq_wb", F.lit(float("nan"))).alias("output_value"),
        F.col("stoi").alias("output_peak"),
    )
    issues = S.numerical_issues(rows, ["w0", "w1"])
    return issues.groupBy("issue", "mixture_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sca9_snr_bin",
    sql(SCORES) + "SELECT " + BIN_SQL.format(v="output_snr_db") + " AS snr_bin, count(*) AS n FROM scores GROUP BY 1",
)
def snr_bins(t: Tables):
    return t.views.scores.groupBy(snr_bin(F.col("output_snr_db")).alias("snr_bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg19_expert_difference",
    sql(FRAME_BINS)
    + """SELECT signal_id, round(avg(abs(abs(v) - abs(v) * 0.5 - 0.01 * (bin % 3))), 6) + 0.0 AS mask_absdiff,
    round(avg(abs(abs(v) - abs(v) * 0.5 - 0.01 * (bin % 3))) FILTER (WHERE frame % 5 = 0), 6) + 0.0 AS mask_absdiff_flagged
    FROM frame_bins GROUP BY signal_id""",
)
def expert_difference(t: Tables):
    masks = t.views.frame_bins.select(
        "signal_id",
        F.abs("v").alias("mask_1"),
        (F.abs("v") * 0.5 + 0.01 * (F.col("bin") % 3)).alias("mask_2"),
        (F.col("frame") % 5 == 0).alias("flag"),
    )
    table = S.expert_difference(masks, ["signal_id"])
    return table.select("signal_id", *[rounded(F.col(c)).alias(c) for c in table.columns[1:]])


@query(
    "agg17_latency_summary",
    """SELECT count(*) FILTER (WHERE l_returnflag <> 'A') AS files, count(*) FILTER (WHERE l_returnflag = 'A') AS failures,
    round(avg(l_tax + 0.01) FILTER (WHERE l_returnflag <> 'A'), 6) + 0.0 AS latency_avg,
    round(min(l_tax + 0.01) FILTER (WHERE l_returnflag <> 'A'), 6) + 0.0 AS latency_min,
    round(max(l_tax + 0.01) FILTER (WHERE l_returnflag <> 'A'), 6) + 0.0 AS latency_max,
    round(avg((l_tax + 0.01) / l_quantity) FILTER (WHERE l_returnflag <> 'A'), 6) + 0.0 AS rtf_avg FROM lineitem""",
)
def latency_summary(t: Tables):
    runs = t.lineitem.select(
        F.when(F.col("l_returnflag") == "A", F.lit("failed")).alias("error"),
        (F.col("l_tax") + 0.01).alias("latency_seconds"),
        F.col("l_quantity").alias("audio_seconds"),
    )
    table = S.latency_summary(runs)
    return table.select("files", "failures", *[rounded(F.col(c)).alias(c) for c in table.columns[2:]])


@query(
    "agg24_status_rollup",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'converted' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status, count(*) AS files,
    round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM orders GROUP BY o_orderstatus""",
)
def status_rollup(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "converted").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    table = S.status_rollup(t.orders.select(status.alias("status")))
    return table.select("status", "files", rounded(F.col("share")).alias("share"))


@query(
    "agg32_failure_rollup",
    "SELECT event_type AS error_type, count(*) AS attempts FROM events GROUP BY event_type",
)
def failure_rollup(t: Tables):
    return S.failure_rollup(t.events.select(F.col("event_type").alias("error_type")))
