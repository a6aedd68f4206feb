"""Rule queries."""

from pyspark.sql import functions as F

from wavelake.catalog.registry import Tables, query, rounded
from wavelake.catalog.views import RECORDS, SCORES, SIG_PAIRS, SIG_SAMPLES, sql
from wavelake.operators import rules as R
from wavelake.plans.draws import draw

CATEGORIES = ["engine", "wind", "vehicle", "helicopter", "siren", "gunfire", "artillery", "explosion", "crowd"]
CATEGORY_SQL = "(['engine','wind','vehicle','helicopter','siren','gunfire','artillery','explosion','crowd'])[CAST(k % 9 AS INTEGER) + 1]"
TIER_SQL = (
    "CASE WHEN {c} IN ('engine','wind') THEN 'A' WHEN {c} IN ('vehicle','helicopter','siren') THEN 'B' "
    "WHEN {c} IN ('gunfire','artillery','explosion') THEN 'C' END"
)
MIX = (
    RECORDS
    + f""", mix0 AS (SELECT *, {CATEGORY_SQL} AS category FROM records),
    mix AS (SELECT k AS mixture_id, split, category, CASE WHEN k % 29 = 0 THEN 'A' ELSE """
    + TIER_SQL.format(c="category")
    + """ END AS tier, target_snr_db * 0.6 AS target_snr_db,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN target_snr_db * 0.6 + 0.75 ELSE target_snr_db * 0.6 END AS measured_snr_db,
    clipping_prevented AND k % 3 = 0 AS clipping_flag FROM mix0)"""
)
CHECKED = (
    MIX
    + ", flagged AS (SELECT *, "
    + "list_filter([CASE WHEN split <> 'train' THEN concat('split=', split) END, "
    + "CASE WHEN " + TIER_SQL.format(c="category") + " IS DISTINCT FROM tier THEN 'category/tier mismatch' END, "
    + "CASE WHEN target_snr_db NOT BETWEEN -5 AND 20 THEN 'target SNR outside [-5, 20]' END], lambda v: v IS NOT NULL) AS fatal, "
    + "list_filter([CASE WHEN clipping_flag THEN 'clipping_flag (noisy peak > 1.0 before PCM write)' END, "
    + "CASE WHEN abs(measured_snr_db - target_snr_db) > 0.5 THEN 'measured vs target SNR > 0.5 dB' END], lambda v: v IS NOT NULL) AS warns, "
    + "CASE WHEN measured_snr_db IS NULL THEN ['note: measured_snr_db empty'] ELSE [] END AS notes FROM mix), "
    + "checked AS (SELECT *, CASE WHEN len(fatal) > 0 THEN 'FAIL' WHEN len(warns) > 0 THEN 'WARN' ELSE 'PASS' END AS meta_status, "
    + "list_concat(list_concat(fatal, warns), notes) AS meta_flags FROM flagged)"
)
AUDITED = (
    CHECKED
    + """, audited AS (SELECT *, CASE WHEN mixture_id % 4 = 0 THEN 'train' WHEN mixture_id % 4 = 1 THEN 'dev_train' WHEN mixture_id % 4 = 2
      THEN 'val_select' ELSE 'test' END AS role, CASE WHEN mixture_id % 6 = 0 THEN 'UNVERIFIED' WHEN mixture_id % 11 = 0 THEN 'WARN' ELSE 'PASS' END
      AS audio_status, CASE WHEN mixture_id % 11 = 0 THEN ['noisy clipped', 'duration != metadata'] ELSE [] END AS audio_flags FROM checked),
    usable AS (SELECT *, meta_status <> 'FAIL' AND audio_status IN ('PASS', 'WARN') AND NOT (coalesce(clipping_flag, false)
      OR contains(array_to_string(audio_flags, ';'), 'clipped')) AS ok FROM audited)"""
)


def mixtures(t: Tables):
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    category = F.element_at(names, (F.col("k") % 9 + 1).cast("int"))
    target = F.col("target_snr_db") * 0.6
    measured = F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 7 == 0, target + 0.75).otherwise(target)
    return t.views.records.select(
        F.col("k").alias("mixture_id"),
        "split",
        category.alias("category"),
        F.when(F.col("k") % 29 == 0, "A").otherwise(R.tier_of(category)).alias("tier"),
        target.alias("target_snr_db"),
        measured.alias("measured_snr_db"),
        (F.col("clipping_prevented") & (F.col("k") % 3 == 0)).alias("clipping_flag"),
    )


def audited(t: Tables):
    rows = R.metadata_checks(mixtures(t), "train")
    m = F.col("mixture_id")
    role = F.when(m % 4 == 0, "train").when(m % 4 == 1, "dev_train").when(m % 4 == 2, "val_select").otherwise("test")
    status = F.when(m % 6 == 0, "UNVERIFIED").when(m % 11 == 0, "WARN").otherwise("PASS")
    flags = F.when(m % 11 == 0, F.array(F.lit("noisy clipped"), F.lit("duration != metadata"))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        rows.withColumn("role", role)
        .withColumn("audio_status", status)
        .withColumn("audio_flags", flags)
        .withColumnRenamed("clipping_flag", "clipping_flag_meta")
    )


@query(
    "flt1_metadata_checks",
    sql(CHECKED) + "SELECT mixture_id, meta_status, array_to_string(meta_flags, ';') AS meta_flags FROM checked",
)
def metadata_checks(t: Tables):
    rows = R.metadata_checks(mixtures(t), "train")
    return rows.select("mixture_id", "meta_status", F.array_join("meta_flags", ";").alias("meta_flags"))


@query(
    "flt2_validate_pairs",
    """WITH p AS (SELECT l_orderkey AS id, l_linenumber AS j, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
      l_partkey % 19 <> 0 AS nf, l_suppkey % 17 <> 0 AS cf, CASE WHEN l_partkey % 23 = 0 THEN 'IOError: short file' END AS err,
      CASE WHEN l_partkey % 13 = 0 THEN 44100 ELSE 48000 END AS sr, CASE WHEN l_partkey % 31 = 0 THEN 2 ELSE 1 END AS ch,
      CAST(l_quantity * 100 AS BIGINT) AS fr, CAST(l_quantity * 100 AS BIGINT) + CASE WHEN l_suppkey % 29 = 0 THEN 1 ELSE 0 END AS cfr,
      l_partkey % 37 <> 0 AS fin, CASE WHEN l_partkey % 7 = 0 THEN 3 ELSE 0 END AS lag, CASE WHEN l_suppkey % 23 = 0 THEN 1e-9 ELSE l_discount + 0.01 END AS rr,
      CASE WHEN l_partkey % 11 = 0 THEN 1e-7 ELSE 0.1 END AS rc, 0.9 + l_tax * 1.25 AS pn, 0.95 + l_discount / 2 AS pc FROM lineitem),
    f AS (SELECT *, list_filter([CASE WHEN sr <> 48000 THEN 'not 48 kHz' END, CASE WHEN ch <> 1 THEN 'not mono' END,
      CASE WHEN fr <> cfr THEN 'length mismatch' END, CASE WHEN NOT fin THEN 'non-finite samples' END], lambda v: v IS NOT NULL) AS layout,
      list_filter([CASE WHEN lag <> 0 THEN concat('misaligned (', lag, ' samples)') END, CASE WHEN rr <= 1e-8 THEN 'no residual noise' END,
      CASE WHEN rc <= 1e-6 THEN 'silent clean' END], lambda v: v IS NOT NULL) AS content,
      list_filter([CASE WHEN pn >= 0.999 THEN 'noisy clipped' END, CASE WHEN pc >= 0.999 THEN 'clean clipped' END,
      CASE WHEN abs(fr / 48000.0::DOUBLE - (fr / 48000.0::DOUBLE + CASE WHEN l_quantity = 7 THEN 0.01 ELSE 0 END)) > 0.002 THEN 'duration != metadata' END,
      CASE WHEN abs(l_quantity - (l_quantity + l_tax * 20)) > 1 THEN 'SNR differs from metadata by > 1 dB' END], lambda v: v IS NOT NULL) AS soft FROM p)
    SELECT id, j, l_suppkey AS s, l_partkey AS pk, CASE WHEN NOT nf OR NOT cf THEN 'UNAVAILABLE' WHEN err IS NOT NULL OR len(layout) > 0 OR len(content) > 0 THEN 'FAIL'
      WHEN len(soft) > 0 THEN 'WARN' ELSE 'PASS' END AS audio_status,
      CASE WHEN NOT nf THEN 'noisy missing' WHEN NOT cf THEN 'clean missing' WHEN err IS NOT NULL THEN concat('unreadable: ', err)
      WHEN len(layout) > 0 THEN array_to_string(layout, ';') ELSE array_to_string(list_concat(content, soft), ';') END AS audio_flags FROM f""",
)
def validate_pairs(t: Tables):
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    frames = (F.col("l_quantity") * 100).cast("bigint")
    measures = t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("j"),
        sk.alias("s"),
        pk.alias("pk"),
        (pk % 19 != 0).alias("noisy_found"),
        (sk % 17 != 0).alias("clean_found"),
        F.when(pk % 23 == 0, "IOError: short file").alias("read_error"),
        F.when(pk % 13 == 0, 44100).otherwise(48000).alias("sample_rate"),
        F.lit(48000).alias("clean_sample_rate"),
        F.when(pk % 31 == 0, 2).otherwise(1).alias("channels"),
        F.lit(1).alias("clean_channels"),
        frames.alias("frames"),
        (frames + F.when(sk % 29 == 0, 1).otherwise(0)).alias("clean_frames"),
        (pk % 37 != 0).alias("all_finite"),
        F.when(pk % 7 == 0, 3).otherwise(0).alias("alignment_lag"),
        F.when(sk % 23 == 0, 1e-9).otherwise(F.col("l_discount") + 0.01).alias("rms_residual"),
        F.when(pk % 11 == 0, 1e-7).otherwise(0.1).alias("rms_clean"),
        (0.9 + F.col("l_tax") * 1.25).alias("peak_noisy"),
        (0.95 + F.col("l_discount") / 2).alias("peak_clean"),
        (frames / 48000.0).alias("duration_sec"),
        (frames / 48000.0 + F.when(F.col("l_quantity") == 7, 0.01).otherwise(0.0)).alias("duration_sec_meta"),
        F.col("l_quantity").alias("measured_snr_db_audio"),
        (F.col("l_quantity") + F.col("l_tax") * 20).alias("measured_snr_db_meta"),
    )
    rows = R.validate_pairs(measures)
    return rows.select("id", "j", "s", "pk", "audio_status", F.array_join("audio_flags", ";").alias("audio_flags"))


@query(
    "flt3_eligible",
    sql(AUDITED)
    + """SELECT mixture_id, role IN ('train', 'dev_train') AND ok AS use_for_training, role = 'val_select' AND ok AS use_for_selection FROM usable""",
)
def usage(t: Tables):
    return R.usage_flags(audited(t)).select("mixture_id", "use_for_training", "use_for_selection")


@query(
    "flt4_select_rows",
    sql(AUDITED)
    + """SELECT mixture_id, 'checked' AS rule FROM usable WHERE role = 'val_select' AND ok UNION ALL
    SELECT mixture_id, 'metadata_no_clip' FROM usable WHERE role = 'train' AND meta_status <> 'FAIL' AND NOT coalesce(clipping_flag, false)""",
)
def select_rows(t: Tables):
    rows = R.usage_flags(audited(t))
    checked = R.select_rows(rows, "val_select", "use_for_selection").select("mixture_id", F.lit("checked").alias("rule"))
    loose = R.select_rows(rows, "train", "metadata_no_clip").select("mixture_id", F.lit("metadata_no_clip").alias("rule"))
    return checked.union(loose)


@query(
    "flt5_finite_only",
    sql(SIG_SAMPLES)
    + """, y AS (SELECT signal_id, t, CASE WHEN signal_id % 9 = 0 AND t = 5 THEN CAST('nan' AS DOUBLE) WHEN signal_id % 10 = 0 AND t = 7
      THEN CAST('inf' AS DOUBLE) ELSE x END AS x FROM sig_samples),
    g AS (SELECT signal_id FROM y GROUP BY signal_id HAVING bool_and(isfinite(x)))
    SELECT signal_id, count(*) AS n, round(sum(x), 6) + 0.0 AS total FROM y SEMI JOIN g USING (signal_id) GROUP BY signal_id""",
)
def finite_only(t: Tables):
    s, at = F.col("signal_id"), F.col("t")
    x = F.when((s % 9 == 0) & (at == 5), float("nan")).when((s % 10 == 0) & (at == 7), float("inf")).otherwise(F.col("x"))
    rows = R.finite_only(t.views.sig_samples.withColumn("x", x), ["signal_id"])
    return rows.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("total"))


DRAW_SQL = "('0x' || substr(md5(concat_ws(':', {0})), 1, 8))::BIGINT"


@query(
    "flt6_duration_filter",
    sql(RECORDS)
    + ", l AS (SELECT k, CAST(floor(duration_seconds * 1000) AS BIGINT) AS len, "
    + DRAW_SQL.format("'crop', k")
    + """ AS d FROM records)
    SELECT k, CASE WHEN len > 60000 THEN d % (len - 60000 + 1) ELSE 0 END AS clean_start_sample,
      CASE WHEN len > 60000 THEN d % (len - 60000 + 1) + 60000 ELSE len END AS clean_end_sample, len > 60000 AS clean_cropped FROM l WHERE len >= 10000""",
)
def duration_filter(t: Tables):
    rows = t.views.records.select("k", F.floor(F.col("duration_seconds") * 1000).cast("bigint").alias("length"))
    kept = R.duration_rule(rows, 10000, 60000, draw("crop", F.col("k")))
    return kept.select("k", "clean_start_sample", "clean_end_sample", "clean_cropped")


@query(
    "flt7_power_guards",
    sql(SIG_PAIRS)
    + """, g AS (SELECT signal_id, CASE WHEN signal_id % 5 = 0 THEN 0 ELSE sqrt(avg((noisy - clean) * (noisy - clean))) END AS r,
      CASE WHEN signal_id % 7 = 0 THEN 0 ELSE avg(clean * clean) END AS c, avg((noisy - clean) * (noisy - clean)) AS n FROM sig_pairs GROUP BY signal_id)
    SELECT signal_id, CASE WHEN r < 1e-6 THEN 'noise segment is (near) silent' WHEN c < 1e-12 OR n < 1e-12
      THEN 'zero clean or noise power in measurement region' END AS rejection FROM g""",
)
def power_guards(t: Tables):
    noise = F.col("noisy") - F.col("clean")
    s = F.col("signal_id")
    rows = t.views.sig_pairs.groupBy("signal_id").agg(F.avg(noise * noise).alias("n"), F.avg(F.col("clean") * F.col("clean")).alias("c"))
    rows = rows.select(
        "signal_id",
        F.when(s % 5 == 0, 0.0).otherwise(F.sqrt("n")).alias("noise_rms"),
        F.when(s % 7 == 0, 0.0).otherwise(F.col("c")).alias("clean_power"),
        F.col("n").alias("noise_power"),
    )
    return R.power_guards(rows).select("signal_id", "rejection")


@query(
    "flt8_clip_policy",
    sql(SIG_PAIRS)
    + """, p AS (SELECT signal_id, max(abs(noisy * 9)) AS peak FROM sig_pairs GROUP BY signal_id)
    SELECT signal_id, round(CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1.0 END, 6) + 0.0 AS output_gain, 'scale' AS policy FROM p
    UNION ALL SELECT signal_id, 1.0, 'reject' FROM p WHERE peak <= 0.99""",
)
def clip_policy(t: Tables):
    peaks = t.views.sig_pairs.groupBy("signal_id").agg(F.max(F.abs(F.col("noisy") * 9)).alias("peak"))
    scaled = R.clip_policy(peaks).select("signal_id", rounded(F.col("output_gain")).alias("output_gain"), F.lit("scale").alias("policy"))
    kept = R.clip_policy(peaks, policy="reject").select("signal_id", "output_gain", F.lit("reject").alias("policy"))
    return scaled.union(kept)


@query(
    "flt11_assign_role",
    sql(RECORDS)
    + """, a AS (SELECT k, CASE WHEN k % 10 = 3 THEN 'test' ELSE 'val' END AS split, CASE WHEN k % 8 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM records),
    fr AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 7),
    ca AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_tax = 0)
    SELECT k, CASE WHEN status <> 'PASS' THEN 'invalid' WHEN split = 'test' THEN 'test' WHEN k IN (FROM fr) THEN 'eval_frozen'
      WHEN k IN (FROM ca) THEN 'calibration' ELSE 'val_pool' END AS role FROM a""",
)
def assign_role(t: Tables):
    from wavelake.operators.matching import mark_members

    rows = t.views.records.select(
        "k",
        F.when(F.col("k") % 10 == 3, "test").otherwise("val").alias("split"),
        F.when(F.col("k") % 8 == 0, "FAIL").otherwise("PASS").alias("status"),
    )
    ids = t.lineitem.withColumnRenamed("l_orderkey", "k")
    rows = mark_members(rows, ids.where("l_linenumber = 7"), "k", "is_frozen")
    rows = mark_members(rows, ids.where("l_returnflag = 'N' AND l_tax = 0"), "k", "is_calibration")
    return R.assign_role(rows).select("k", "role")


@query(
    "flt12_truncate_log",
    """SELECT event_id AS step, user_id, CASE WHEN event_type = 'error' THEN 'val' ELSE 'train' END AS kind FROM events
    WHERE event_id < 4000 OR (event_type = 'error' AND event_id = 4000)""",
)
def truncate_log(t: Tables):
    kind = F.when(F.col("event_type") == "error", "val").otherwise("train")
    return R.truncate_log(t.events.select(F.col("event_id").alias("step"), "user_id", kind.alias("kind")), 4000)


@query(
    "flt13_run_differences",
    """WITH c AS (SELECT o_orderkey AS run_id, unnest(['priority', 'status', 'manifest', 'seed']) AS setting,
      unnest([o_orderpriority, o_orderstatus, concat('/a/', o_custkey), NULL]) AS before,
      unnest([CASE WHEN o_orderkey % 6 = 0 THEN '1-URGENT' ELSE o_orderpriority END, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END,
        concat('/b/', o_custkey), CASE WHEN o_orderkey % 9 = 0 THEN '7' END]) AS now FROM orders)
    SELECT run_id, setting, before, now FROM c WHERE before IS DISTINCT FROM now AND setting <> 'manifest'""",
)
def run_differences(t: Tables):
    k = F.col("o_orderkey")
    text = F.lit(None).cast("string")
    path = F.col("o_custkey").cast("string")
    before = F.create_map(
        F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"),
        F.lit("manifest"), F.concat(F.lit("/a/"), path),
    )
    now = F.create_map(
        F.lit("priority"), F.when(k % 6 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")),
        F.lit("status"), F.when(k % 4 == 0, text).otherwise(F.col("o_orderstatus")),
        F.lit("manifest"), F.concat(F.lit("/b/"), path),
        F.lit("seed"), F.when(k % 9 == 0, "7"),
    )
    runs = t.orders.select(k.alias("run_id"), before.alias("_before"), now.alias("_now"))
    return R.run_differences(runs, "_before", "_now", ["manifest"])


@query(
    "flt13_run_compatible",
    """SELECT o_orderkey AS run_id, o_orderkey % 5 <> 0 AND (o_orderkey % 7 <> 0) AS compatible FROM orders""",
)
def run_compatible(t: Tables):
    k = F.col("o_orderkey")
    base = [k.alias("run_id"), F.lit("1.0").alias("generator_version")]
    before = t.orders.select(*base, F.md5("o_orderpriority").alias("config_hash"), F.lit("h").alias("source_inventory_hash"))
    now = t.orders.select(
        *base,
        F.md5(F.when(k % 5 == 0, F.lit("other")).otherwise(F.col("o_orderpriority"))).alias("config_hash"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.lit("h")).alias("source_inventory_hash"),
    )
    return R.run_compatible(before, now)


@query(
    "jn4_tier_of",
    sql(MIX) + "SELECT category, " + TIER_SQL.format(c="category") + " AS tier, count(*) AS n FROM mix GROUP BY category",
)
def tier_of(t: Tables):
    rows = mixtures(t).withColumn("tier", R.tier_of(F.col("category")))
    return rows.groupBy("category", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg7_flag_frequencies",
    sql(AUDITED)
    + """, e AS (SELECT 'role' AS kind, role AS value FROM usable UNION ALL SELECT 'meta_status', meta_status FROM usable
      UNION ALL SELECT 'audio_status', audio_status FROM usable UNION ALL SELECT 'meta_flag', unnest(meta_flags) FROM usable
      UNION ALL SELECT 'audio_flag', unnest(audio_flags) FROM usable)
    SELECT kind, value, count(*) AS rows FROM e GROUP BY kind, value""",
)
def flag_frequencies(t: Tables):
    from wavelake.operators.audit import flag_frequencies as frequencies

    return frequencies(audited(t))


@query(
    "agg25_duplicates",
    sql(SCORES)
    + """, r AS (SELECT mixture_id, j, CASE WHEN pesq_wb IS NULL THEN 'FAIL' ELSE 'PASS' END AS s, output_snr_db, suite, system FROM scores),
    d AS (SELECT mixture_id FROM r WHERE s <> 'FAIL' GROUP BY mixture_id HAVING count(*) > 1)
    SELECT mixture_id, j, CASE WHEN s <> 'FAIL' AND mixture_id IN (FROM d) THEN 'FAIL' ELSE s END AS meta_status,
      CASE WHEN s <> 'FAIL' AND mixture_id IN (FROM d) THEN 'kept;duplicate mixture_id' ELSE 'kept' END AS meta_flags FROM r""",
)
def duplicates(t: Tables):
    from wavelake.operators.audit import mark_duplicates

    rows = t.views.scores.select(
        "mixture_id", "j",
        F.when(F.col("pesq_wb").isNull(), "FAIL").otherwise("PASS").alias("meta_status"),
        F.array(F.lit("kept")).alias("meta_flags"),
    )
    marked = mark_duplicates(rows)
    return marked.select("mixture_id", "j", "meta_status", F.array_join("meta_flags", ";").alias("meta_flags"))
