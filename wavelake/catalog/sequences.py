"""Ordered queries: selection, running values, ids, permutations."""

from pyspark.sql import functions as F

from wavelake.catalog.registry import Tables, query, rounded
from wavelake.catalog.rules import AUDITED, audited
from wavelake.catalog.views import FRAME_BINS, RECORDS, SIG_SAMPLES, SOURCES, sql, utc_instant
from wavelake.operators import sequences as Q
from wavelake.plans import ordered as O

ROWS_SQL = (
    ", m AS (SELECT CASE WHEN mixture_id % 3 = 0 THEN 'val_pool' ELSE role END AS role, category, target_snr_db, mixture_id AS id, meta_status, audio_status, ok FROM usable), "
    "p AS (SELECT *, floor(target_snr_db) AS cell, id * 7919 % 100003 AS index FROM m)"
)


@query(
    "win1_select_lowest_per_cell",
    sql(AUDITED) + ROWS_SQL
    + """, r AS (SELECT id, row_number() OVER (PARTITION BY category, cell ORDER BY index, id) AS rn FROM p WHERE role = 'val_pool' AND ok)
    SELECT id AS mixture_id, category, CASE WHEN rn = 1 THEN 'val_select' ELSE role END AS role FROM p LEFT JOIN r USING (id)""",
)
def select_lowest(t: Tables):
    m = F.col("mixture_id")
    rows = audited(t).withColumn("role", F.when(m % 3 == 0, "val_pool").otherwise(F.col("role")))
    rows = rows.withColumn("target_snr_db", F.floor("target_snr_db")).withColumn("index", m * 7919 % 100003)
    return Q.select_lowest_per_cell(rows).select("mixture_id", "category", "role")


@query(
    "win3_best_so_far",
    sql(SIG_SAMPLES)
    + """SELECT signal_id AS run, t AS step, coalesce(x < min(x) OVER (PARTITION BY signal_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS best FROM sig_samples""",
)
def best_so_far(t: Tables):
    log = t.views.sig_samples.select(F.col("signal_id").alias("run"), F.col("t").alias("step"), F.col("x").alias("loss"), "block")
    return Q.best_so_far(log, ["run"]).select("run", "step", "best")


RUNS_SQL = (
    ", tr AS (SELECT signal_id, t, t - row_number() OVER (PARTITION BY signal_id ORDER BY t) AS g FROM sig_samples WHERE x > -0.02), "
    "rn AS (SELECT signal_id, min(t) AS start_sample, max(t) + 1 AS end_sample FROM tr GROUP BY signal_id, g)"
)


@query(
    "win4_runs",
    sql(SIG_SAMPLES) + RUNS_SQL + "SELECT signal_id, start_sample, end_sample FROM rn WHERE end_sample - start_sample >= 3",
)
def runs(t: Tables):
    samples = t.views.sig_samples.withColumn("on", F.col("x") > -0.02)
    return O.true_runs(samples, ["signal_id"], "t", "on", 3)


@query(
    "win5_merge_gaps",
    sql(SIG_SAMPLES) + RUNS_SQL
    + """, l AS (SELECT *, max(end_sample) OVER (PARTITION BY signal_id ORDER BY start_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rn),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sample - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY start_sample) AS island FROM l)
    SELECT signal_id, min(start_sample) AS start_sample, max(end_sample) AS end_sample FROM i GROUP BY signal_id, island HAVING max(end_sample) - min(start_sample) >= 4""",
)
def merge_gaps(t: Tables):
    samples = t.views.sig_samples.withColumn("on", F.col("x") > -0.02)
    return O.merge_intervals(O.true_runs(samples, ["signal_id"], "t", "on"), ["signal_id"], 3, 4)


@query(
    "win6_analysis_frames",
    sql(FRAME_BINS)
    + """SELECT signal_id, frame, bin AS i, round(coalesce(lag(v) OVER (PARTITION BY signal_id, bin ORDER BY frame), 0.0), 6) + 0.0 AS x FROM frame_bins
    UNION ALL SELECT signal_id, frame, bin + 64, round(v, 6) + 0.0 FROM frame_bins""",
)
def analysis_frames(t: Tables):
    frames = Q.analysis_frames(t.views.frames, ["signal_id"])
    return frames.select("signal_id", "frame", F.posexplode("x").alias("i", "x")).select(
        "signal_id", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("x")).alias("x")
    )


@query(
    "win7_deep_filter",
    sql(FRAME_BINS)
    + """, z AS (SELECT signal_id, frame, bin, v AS re, v * 0.5 - 0.1 AS im FROM frame_bins),
    c AS (SELECT signal_id, frame, bin, unnest(range(5)) AS tap, re FROM z),
    d AS (SELECT *, re * (tap + 1) / 5 AS c_re, (bin - tap) / 20.0::DOUBLE AS c_im FROM c)
    SELECT d.signal_id, d.frame, d.bin, round(sum(z.re * c_re - z.im * c_im), 6) + 0.0 AS re, round(sum(z.re * c_im + z.im * c_re), 6) + 0.0 AS im
    FROM d JOIN z ON z.signal_id = d.signal_id AND z.bin = d.bin AND z.frame = d.frame - 2 + d.tap GROUP BY ALL""",
)
def deep_filter(t: Tables):
    bins = t.views.frame_bins.select(
        "signal_id", "frame", "bin", F.col("v").alias("re"), (F.col("v") * 0.5 - 0.1).alias("im")
    )
    taps = bins.select("signal_id", "frame", "bin", "re", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tap"))
    taps = taps.select(
        "signal_id", "frame", "bin", "tap",
        (F.col("re") * (F.col("tap") + 1) / 5).alias("c_re"),
        ((F.col("bin") - F.col("tap")) / 20.0).alias("c_im"),
    )
    out = Q.deep_filter(bins, taps)
    return out.select("signal_id", "frame", "bin", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


@query(
    "win8_previous_mask",
    sql(FRAME_BINS)
    + "SELECT signal_id, frame, bin, round(lag(abs(v), 1, 1.0) OVER (PARTITION BY signal_id, bin ORDER BY frame), 6) + 0.0 AS prev_mask FROM frame_bins",
)
def previous_mask(t: Tables):
    masks = t.views.frame_bins.withColumn("mask", F.abs("v"))
    rows = Q.previous_mask(masks, ["signal_id", "bin"])
    return rows.select("signal_id", "frame", "bin", rounded(F.col("prev_mask")).alias("prev_mask"))


NAME_SQL = (
    "WITH f AS (SELECT concat('in/', lang, '/', doc_id, '/a', doc_id % 9, CASE WHEN doc_id % 7 = 0 THEN concat('_', doc_id % 13 + 1) ELSE '' END, '.wav') AS path FROM documents), "
    "n AS (SELECT path, regexp_extract(path, '[^/]+$') AS name FROM f), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS r, replace(name, '.wav', '') AS base FROM n), "
    "tk AS (SELECT regexp_extract(base, '^(.*)_([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(base, '_([1-9][0-9]*)$', 1) AS BIGINT) AS num FROM r WHERE r = 0 AND regexp_matches(base, '_[1-9][0-9]*$')), "
    "tk2 AS (SELECT base, num - row_number() OVER (PARTITION BY base ORDER BY num) + 1 AS g FROM tk) "
)


@query(
    "win9_collision_free_names",
    NAME_SQL
    + """SELECT path, CASE WHEN r = 0 THEN name ELSE concat(base, '_', r + (SELECT count(*) FROM tk2 WHERE tk2.base = r.base AND g <= r.r), '.wav') END AS target FROM r""",
)
def collision_free_names(t: Tables):
    doc = F.col("doc_id")
    tail = F.when(doc % 7 == 0, F.concat(F.lit("_"), (doc % 13 + 1).cast("string"))).otherwise("")
    path = F.concat(
        F.lit("in/"), "lang", F.lit("/"), doc.cast("string"), F.lit("/a"), (doc % 9).cast("string"), tail, F.lit(".wav")
    )
    return Q.collision_free_names(t.documents.select(path.alias("path")))


@query(
    "win10_sequential_ids",
    """WITH s AS (SELECT user_id AS split, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT split, CAST(before + unnest(range(1, n + 1)) AS BIGINT) AS k FROM b""",
)
def sequential_ids(t: Tables):
    splits = t.events.groupBy(F.col("user_id").alias("split")).agg(F.count(F.lit(1)).alias("count"))
    return Q.sequential_ids(splits.withColumn("split_ord", F.col("split")))


@query(
    "win11_epoch_order",
    sql(RECORDS)
    + """, e AS (SELECT k, unnest([0, 1]) AS epoch FROM records), o AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', 7301, epoch, k)), k) - 1 AS within FROM e),
    p AS (SELECT *, epoch * (SELECT count(*) FROM records) + within AS position FROM o) SELECT k, epoch, within, position, position // 16 AS step FROM p""",
)
def epoch_order(t: Tables):
    return Q.epoch_order(t.views.records.select("k"), "k", 7301, 2, 16)


@query(
    "win12_weight_smoothness",
    sql(FRAME_BINS)
    + """, d AS (SELECT signal_id, abs(v) - lag(abs(v)) OVER (PARTITION BY signal_id, bin ORDER BY frame) AS d FROM frame_bins)
    SELECT signal_id, round(avg(d * d), 6) + 0.0 AS smoothness FROM d GROUP BY signal_id""",
)
def weight_smoothness(t: Tables):
    weights = t.views.frame_bins.withColumn("w", F.abs("v"))
    rows = Q.weight_smoothness(weights, ["signal_id", "bin"], ["signal_id"])
    return rows.select("signal_id", rounded(F.col("smoothness")).alias("smoothness"))


@query(
    "win13_bad_step_budget",
    sql(SIG_SAMPLES)
    + """, b AS (SELECT signal_id, t, sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY t) AS upto, flag FROM sig_samples)
    SELECT signal_id AS run, count(*) FILTER (WHERE flag) AS bad_steps, min(t) FILTER (WHERE upto > 5) AS stop_step FROM b GROUP BY signal_id""",
)
def bad_step_budget(t: Tables):
    loss = F.when(F.col("flag"), F.lit(float("nan"))).otherwise(F.col("x"))
    log = t.views.sig_samples.select(F.col("signal_id").alias("run"), F.col("t").alias("step"), loss.alias("loss"), "block")
    return Q.bad_step_budget(log, ["run"], 5)


@query(
    "win14_progress",
    """WITH c AS (SELECT user_id AS run, event_id AS commit_id, epoch_us(ts) // 1000000 AS sec, count(*) OVER (PARTITION BY user_id) + 50 AS total FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY sec, commit_id) AS done, sec - min(sec) OVER (PARTITION BY run) AS el FROM c)
    SELECT run, commit_id, total, done, round(CASE WHEN el > 0 THEN done / el END, 6) + 0.0 AS rate, round((total - done) / (CASE WHEN el > 0 THEN done / el END), 3) + 0.0 AS eta_seconds FROM d""",
)
def progress(t: Tables):
    seconds = F.unix_micros(utc_instant("ts"))
    totals = t.events.groupBy(F.col("user_id").alias("run")).agg((F.count(F.lit(1)) + 50).alias("total"))
    rows = t.events.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("commit_id"), F.floor(seconds / 1000000).alias("at_seconds")
    ).withColumn("block", F.floor(F.col("at_seconds") / 3600))
    out = Q.progress(O.attach(rows, totals, ["run"]), ["run"])
    return out.select("run", "commit_id", "total", "done", rounded(F.col("rate")).alias("rate"), rounded(F.col("eta_seconds"), 3).alias("eta_seconds"))


@query(
    "win15_softmax_weights",
    sql(FRAME_BINS)
    + """, l AS (SELECT signal_id, frame, bin % 32 AS band, bin // 32 AS expert, v * 10 AS logit FROM frame_bins), e AS (SELECT *, exp(logit - max(logit) OVER w) AS e FROM l WINDOW w AS (PARTITION BY signal_id, frame, band))
    SELECT signal_id, frame, band, expert, round(e / sum(e) OVER (PARTITION BY signal_id, frame, band), 6) + 0.0 AS w FROM e""",
)
def softmax_weights(t: Tables):
    logits = t.views.frame_bins.select(
        "signal_id", "frame", (F.col("bin") % 32).alias("band"), F.floor(F.col("bin") / 32).alias("expert"), (F.col("v") * 10).alias("logit")
    )
    rows = Q.softmax_weights(logits, ["signal_id", "frame", "band"])
    return rows.select("signal_id", "frame", "band", "expert", rounded(F.col("w")).alias("w"))


@query(
    "win16_mask_disagreement",
    sql(FRAME_BINS)
    + "SELECT signal_id, frame, bin % 32 AS band, round(stddev_pop(abs(v)), 6) + 0.0 AS disagreement FROM frame_bins GROUP BY ALL",
)
def mask_disagreement(t: Tables):
    masks = t.views.frame_bins.select("signal_id", "frame", (F.col("bin") % 32).alias("band"), F.abs("v").alias("mask"))
    rows = Q.mask_disagreement(masks, ["signal_id", "frame", "band"])
    return rows.select("signal_id", "frame", "band", rounded(F.col("disagreement")).alias("disagreement"))


@query("srt1_deterministic_order", sql(SOURCES) + "SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS idx FROM sources")
def deterministic_order(t: Tables):
    return Q.deterministic_order(t.views.sources.select("rel"))


@query("srt2_limit_first", sql(SOURCES) + "SELECT rel, size FROM sources ORDER BY rel LIMIT 300")
def limit_first(t: Tables):
    return Q.limit_first(t.views.sources.select("rel", "size"), ["rel"], 300)


@query(
    "srt8_oversample",
    sql(AUDITED) + "SELECT mixture_id, unnest(range(CASE WHEN tier = 'C' AND role = 'train' THEN 3 ELSE 1 END)) AS copy FROM usable",
)
def oversample(t: Tables):
    rare = (F.col("tier") == "C") & (F.col("role") == "train")
    return Q.oversample(audited(t), rare, 3).select("mixture_id", F.col("copy").cast("bigint").alias("copy"))
