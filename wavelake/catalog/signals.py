"""Signal queries."""

from pyspark.sql import functions as F

from wavelake.catalog.matching import PLAN_SQL, REGION_SQL, placement_plan, view_regions
from wavelake.catalog.planning import d
from wavelake.catalog.registry import Tables, query, rounded
from wavelake.catalog.views import FRAME_BINS, RECORDS, SIG_PAIRS, SIG_SAMPLES, sql
from wavelake.functions import metrics as M
from wavelake.operators import planning as P
from wavelake.operators import sequences as Q
from wavelake.operators import filters as FB
from wavelake.operators import signals as S
from wavelake.operators.matching import mask_from_regions, place_segments
from wavelake.plans.draws import draw
from wavelake.plans.ordered import exact_percentile, with_block

BAND = S.zero_phase_taps(80, 400, 2000, half=12)
HIGH = S.zero_phase_taps(70, None, 2000, half=12)
RESAMPLE = S.resample_taps(2, 3)


def taps_sql(name, taps) -> str:
    half = (len(taps) - 1) // 2
    rows = ", ".join(f"({i - half}, {float(w)!r}::DOUBLE)" for i, w in enumerate(taps))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(k, w))"


def six(df, *values, keep=()):
    return df.select(*keep, *[rounded(F.col(v)).alias(v) for v in values])


@query(
    "sig1_downmix",
    sql(SIG_PAIRS) + "SELECT signal_id, t, round((clean + noisy + est) / 3, 6) + 0.0 AS x FROM sig_pairs",
)
def downmix(t: Tables):
    channels = t.views.sig_pairs.select("signal_id", "t", F.posexplode(F.array("clean", "noisy", "est")).alias("channel", "x"))
    return six(S.downmix(channels), "x", keep=("signal_id", "t"))


@query(
    "sig2_resample",
    sql(SIG_SAMPLES, taps_sql("h", RESAMPLE))
    + """, n AS (SELECT signal_id, count(*) AS n FROM sig_samples GROUP BY signal_id), o AS (SELECT signal_id, unnest(range((n * 2 + 2) // 3)) AS m FROM n)
    SELECT o.signal_id, m AS t, round(sum(x * w), 6) + 0.0 AS x FROM o JOIN sig_samples s ON s.signal_id = o.signal_id JOIN h ON k = m * 3 - t * 2 GROUP BY o.signal_id, m""",
)
def resample(t: Tables):
    return six(S.resample(t.views.sig_samples, 2, 3), "x", keep=("signal_id", "t"))


@query(
    "sig3_slice",
    sql(SIG_SAMPLES)
    + """, c AS (SELECT * FROM sig_samples WHERE t >= 20 AND t < 65) SELECT signal_id, count(*) AS got, round(sum(x), 6) + 0.0 AS total, count(*) <> 45 AS short FROM c GROUP BY signal_id""",
)
def slice_signal(t: Tables):
    sliced = S.slice_signal(t.views.sig_samples, 20, 65, 4096)
    short = S.short_reads(sliced, 20, 65).select("signal_id", F.lit(True).alias("short"))
    totals = sliced.groupBy("signal_id").agg(F.count(F.lit(1)).alias("got"), rounded(F.sum("x")).alias("total"))
    return totals.join(short, "signal_id", "left").withColumn("short", F.coalesce("short", F.lit(False)))


ENERGY_SQL = (
    ", n AS (SELECT signal_id, count(*) AS n FROM sig_samples GROUP BY signal_id), "
    "fr AS (SELECT signal_id, n, unnest(range(CASE WHEN n < 10 THEN 1 ELSE (n - 10) // 4 + 1 END)) AS frame FROM n), "
    "en AS (SELECT fr.signal_id, frame, any_value(n) AS n, avg(x * x) AS energy, count(*) AS samples FROM fr JOIN sig_samples s ON s.signal_id = fr.signal_id AND t >= frame * 4 AND t < frame * 4 + 10 GROUP BY fr.signal_id, frame), "
    "db AS (SELECT *, 10 * log10(energy + 1e-24) AS db FROM en)"
)


@query(
    "agg28_frame_energy",
    sql(SIG_SAMPLES) + ENERGY_SQL + "SELECT signal_id, frame, samples, round(energy, 6) + 0.0 AS energy FROM en",
)
def frame_energy(t: Tables):
    return six(S.frame_energies(t.views.sig_samples, 10, 4), "energy", keep=("signal_id", "frame", "samples"))


@query(
    "agg28_frame_energy_of_bins",
    sql(FRAME_BINS) + "SELECT signal_id, frame, round(avg(v * v), 6) + 0.0 AS energy FROM frame_bins GROUP BY signal_id, frame",
)
def frame_energy_of_bins(t: Tables):
    energy = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x")
    return t.views.frames.select("signal_id", "frame", rounded(energy).alias("energy"))


@query(
    "stf8_sliding_frames",
    sql(SIG_SAMPLES) + ENERGY_SQL + "SELECT signal_id, count(*) AS frames, CAST(sum(samples) AS BIGINT) AS covered FROM en GROUP BY signal_id",
)
def sliding_frames(t: Tables):
    frames = S.frame_energies(t.views.sig_samples, 10, 4)
    return frames.groupBy("signal_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("samples").alias("covered"))


@query(
    "agg16_p95_level",
    sql(SIG_SAMPLES) + ENERGY_SQL + "SELECT signal_id, round(quantile_cont(db, 0.95), 6) + 0.0 AS p95 FROM db GROUP BY signal_id",
)
def p95_level(t: Tables):
    frames = S.frame_energies(t.views.sig_samples, 10, 4)
    frames = frames.withColumn("db", F.lit(10.0) * F.log10(F.col("energy") + F.lit(1e-24)))
    return six(exact_percentile(frames, ["signal_id"], "db", 0.95, "p95"), "p95", keep=("signal_id",))


@query(
    "sig7_detect_active_regions",
    sql(SIG_SAMPLES) + ENERGY_SQL
    + """, th AS (SELECT signal_id, greatest(quantile_cont(db, 0.95) - 2.5, -70) AS thr FROM db GROUP BY signal_id),
    ac AS (SELECT db.signal_id, frame, n, frame - row_number() OVER (PARTITION BY db.signal_id ORDER BY frame) AS g FROM db JOIN th ON th.signal_id = db.signal_id WHERE db > thr),
    rn AS (SELECT signal_id, min(frame) * 4 AS a, max(frame) * 4 + least(10, max(n)) AS b FROM ac GROUP BY signal_id, g),
    l AS (SELECT *, max(b) OVER (PARTITION BY signal_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rn),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY a) AS island FROM l)
    SELECT signal_id, min(a) AS start_sample, max(b) AS end_sample FROM i GROUP BY signal_id, island HAVING max(b) - min(a) >= 12""",
)
def detect_active_regions(t: Tables):
    return S.detect_active_regions(t.views.sig_samples, 10, 4, 2.5, -70.0, 3, 12)


MASKED_SQL = REGION_SQL.format("sig_pairs") + (
    ", m AS (SELECT *, noisy - clean AS noise, EXISTS (SELECT 1 FROM reg r WHERE r.signal_id = s.signal_id AND s.t >= r.start_sample AND s.t < r.end_sample) AS mask FROM sig_pairs s), "
    "pw AS (SELECT signal_id, avg(clean * clean) FILTER (WHERE mask) AS pc, avg(noise * noise) FILTER (WHERE mask) AS pn FROM m GROUP BY signal_id), "
    "sc AS (SELECT signal_id, sqrt(pc / (pn * pow(10, (signal_id % 20 - 10) / 10))) AS noise_scale FROM pw WHERE pc >= 1e-12 AND pn >= 1e-12), "
    "mx AS (SELECT m.*, noise_scale, clean * 4 AS c4, clean * 4 + noise * noise_scale * 4 AS mix FROM m JOIN sc USING (signal_id)), "
    "pk AS (SELECT signal_id, CASE WHEN max(abs(mix)) > 0.99 THEN 0.99 / max(abs(mix)) ELSE 1.0 END AS g FROM mx GROUP BY signal_id), "
    "ou AS (SELECT mx.signal_id, t, mask, noise_scale, g, c4 * g AS clean_out, mix * g AS noisy_out FROM mx JOIN pk USING (signal_id)) "
)


def mixed(t: Tables):
    pairs = t.views.sig_pairs
    rows = mask_from_regions(pairs, view_regions(pairs), ["signal_id"])
    rows = rows.select(
        "signal_id", "t", "block", "mask", (F.col("clean") * 4).alias("clean"), ((F.col("noisy") - F.col("clean")) * 4).alias("noise")
    )
    return S.mix_at_snr(rows, F.col("signal_id") % 20 - 10)


@query(
    "sig8_mix_at_snr",
    sql(SIG_PAIRS) + MASKED_SQL
    + "SELECT signal_id, t, round(noise_scale, 6) + 0.0 AS noise_scale, round(g, 6) + 0.0 AS output_gain, round(clean_out, 6) + 0.0 AS clean_out, round(noisy_out, 6) + 0.0 AS noisy_out FROM ou",
)
def mix_at_snr(t: Tables):
    return six(mixed(t), "noise_scale", "output_gain", "clean_out", "noisy_out", keep=("signal_id", "t"))


@query(
    "sig10_measured_snr",
    sql(SIG_PAIRS) + MASKED_SQL
    + """, de AS (SELECT signal_id, mask, least(greatest(round_even(clean_out * 32768, 0), -32768), 32767) / 32768 AS c, least(greatest(round_even(noisy_out * 32768, 0), -32768), 32767) / 32768 AS n FROM ou)
    SELECT signal_id, round(10 * log10(avg(c * c) FILTER (WHERE mask) / avg((n - c) * (n - c)) FILTER (WHERE mask)), 6) + 0.0 AS measured_snr_db,
    round(max(abs(n)), 6) + 0.0 AS peak_amplitude, CAST(NULL AS VARCHAR) AS rejection FROM de GROUP BY signal_id""",
)
def measured_snr(t: Tables):
    return six(S.measured_snr(mixed(t)), "measured_snr_db", "peak_amplitude", keep=("signal_id", "rejection"))


COMPOSITE_SQL = (
    PLAN_SQL
    + ", pl AS (SELECT sample_id, pick, t - a AS i, b - a AS n, least(CASE WHEN pick % 2 = 1 THEN 3 ELSE 0 END, (b - a) // 2) AS f, t - a + d AS t, x FROM plan JOIN sig_samples ON signal_id = source AND t >= a AND t < b), "
    "fd AS (SELECT sample_id, pick, t, x * CASE WHEN f = 0 THEN 1 ELSE least(1.0::DOUBLE, i / f, (n - 1 - i) / f) END AS x FROM pl), "
    "rm AS (SELECT sample_id, pick, sqrt(avg(x * x)) AS rms FROM fd GROUP BY sample_id, pick) "
)


@query(
    "sig9_composite_noise",
    sql(RECORDS, SIG_SAMPLES) + COMPOSITE_SQL
    + "SELECT sample_id, t, round(sum(x * pow(10, -2.5 * pick / 20) / rms), 6) + 0.0 AS x FROM fd JOIN rm USING (sample_id, pick) GROUP BY sample_id, t",
)
def composite_noise(t: Tables):
    plan = placement_plan(t)
    plan = plan.withColumn("event_length", F.col("source_end_sample") - F.col("source_start_sample"))
    plan = plan.withColumn("fade", F.when(F.col("pick") % 2 == 1, 3).otherwise(0)).withColumn("relative_gain_db", F.col("pick") * -2.5)
    source = t.views.sig_samples.select(F.col("signal_id").alias("source"), "t", "x")
    composite, _ = S.composite_noise(place_segments(source, plan))
    return six(composite, "x", keep=("sample_id", "t"))


@query(
    "sig11_remix",
    sql(SIG_PAIRS)
    + ", p AS (SELECT signal_id, avg(clean * clean) AS ps, avg((noisy - clean) * (noisy - clean)) AS pn FROM sig_pairs GROUP BY signal_id), "
    + "g AS (SELECT signal_id, CASE WHEN ps < 1e-10 OR pn < 1e-12 THEN 1 ELSE sqrt(ps / (pn * pow(10, (-10 + 10 * (" + d("7301", "'remix'", "signal_id") + " / 4294967296.0::DOUBLE)) / 10))) END AS g FROM p), "
    + """m AS (SELECT s.signal_id, t, clean * 3 AS clean, clean * 3 + g * (noisy - clean) * 3 AS noisy FROM sig_pairs s JOIN g ON g.signal_id = s.signal_id),
    k AS (SELECT signal_id, CASE WHEN max(abs(noisy)) > 0.99 THEN 0.99 / max(abs(noisy)) ELSE 1 END AS k FROM m GROUP BY signal_id)
    SELECT m.signal_id, t, round(clean * k, 6) + 0.0 AS clean, round(noisy * k, 6) + 0.0 AS noisy FROM m JOIN k ON k.signal_id = m.signal_id""",
)
def remix(t: Tables):
    pairs = t.views.sig_pairs.withColumn("clean", F.col("clean") * 3).withColumn("noisy", F.col("noisy") * 3)
    rows = S.remix(pairs, draw(7301, "remix", F.col("signal_id")), -10.0, 0.0)
    return six(rows, "clean", "noisy", keep=("signal_id", "t"))


@query(
    "sig12_reconstruct_difference",
    sql(SIG_PAIRS)
    + """, c AS (SELECT signal_id, CASE WHEN t % 50 = 0 THEN 1 ELSE 0 END AS dc, CASE WHEN signal_id % 7 = 0 AND t % 9 = 0 THEN 3 ELSE 0 END AS dn, signal_id % 11 = 0 AND t = 4 AS gone FROM sig_pairs)
    SELECT signal_id, CAST(max(dc) FILTER (WHERE NOT gone) AS BIGINT) AS clean_difference, CAST(max(dn) FILTER (WHERE NOT gone) AS BIGINT) AS noisy_difference, count(*) FILTER (WHERE gone) AS unmatched,
    max(dc) FILTER (WHERE NOT gone) <= 1 AND max(dn) FILTER (WHERE NOT gone) <= 1 AND count(*) FILTER (WHERE gone) = 0 AS reproduced FROM c GROUP BY signal_id""",
)
def reconstruct_difference(t: Tables):
    from wavelake.functions.scalars import pcm_encode

    at, s = F.col("t"), F.col("signal_id")
    rebuilt = t.views.sig_pairs.select("signal_id", "t", "clean", "noisy")
    stored = rebuilt.where(~((s % 11 == 0) & (at == 4))).select(
        "signal_id", "t",
        (pcm_encode(F.col("clean"), "PCM_16") + F.when(at % 50 == 0, 1).otherwise(0)).alias("clean"),
        (pcm_encode(F.col("noisy"), "PCM_16") - F.when((s % 7 == 0) & (at % 9 == 0), 3).otherwise(0)).alias("noisy"),
    )
    return S.reconstruct_difference(rebuilt, stored, "PCM_16", ["signal_id"])


@query(
    "sig13_remove_dc",
    sql(SIG_SAMPLES) + "SELECT signal_id, t, round(x - avg(x) OVER (PARTITION BY signal_id), 12) + 0.0 AS x FROM sig_samples",
)
def remove_dc(t: Tables):
    return S.remove_dc(t.views.sig_samples).select("signal_id", "t", rounded(F.col("x"), 12).alias("x"))


FILTERED = "SELECT a.signal_id, a.t, sum(b.x * w) AS x FROM {s} a JOIN {taps} ON true JOIN {s} b ON b.signal_id = a.signal_id AND b.t = a.t + k GROUP BY a.signal_id, a.t"


# A fourth-order Butterworth high-pass as two closed-form sections, run sample by sample in both directions.
HIGHPASS_SQL = (
    sql(SIG_SAMPLES).replace("WITH ", "WITH RECURSIVE ")
    + """, k AS (SELECT tan(pi() * 70 / 2000) AS k, 2 * sin(pi() / 8) AS q1, 2 * sin(3 * pi() / 8) AS q2),
    co AS (SELECT 1 / (1 + k * q1 + k * k) AS n1, 2 * (k * k - 1) / (1 + k * q1 + k * k) AS a1, (1 - k * q1 + k * k) / (1 + k * q1 + k * k) AS a2,
      1 / (1 + k * q2 + k * k) AS n2, 2 * (k * k - 1) / (1 + k * q2 + k * k) AS d1, (1 - k * q2 + k * k) / (1 + k * q2 + k * k) AS d2 FROM k),
    le AS (SELECT signal_id, count(*) AS n, least(15, count(*) - 1) AS pad, arg_min(x, t) AS x0, arg_max(x, t) AS xn FROM sig_samples GROUP BY signal_id),
    ex AS (SELECT signal_id, t + pad AS i, x FROM sig_samples JOIN le USING (signal_id)
      UNION ALL SELECT signal_id, pad - t, 2 * x0 - x FROM sig_samples JOIN le USING (signal_id) WHERE t BETWEEN 1 AND pad
      UNION ALL SELECT signal_id, 2 * (n - 1) - t + pad, 2 * xn - x FROM sig_samples JOIN le USING (signal_id) WHERE t BETWEEN n - 1 - pad AND n - 2),
    fw AS (
      SELECT signal_id, -1::BIGINT AS i, -n1 * x AS s1, n1 * x AS s2, 0::DOUBLE AS s3, 0::DOUBLE AS s4, 0::DOUBLE AS y FROM ex, co WHERE i = 0
      UNION ALL
      SELECT signal_id, i, -2 * n1 * x - a1 * y1 + s2, n1 * x - a2 * y1, -2 * n2 * y1 - d1 * y2 + s4, n2 * y1 - d2 * y2, y2
      FROM (SELECT *, n2 * y1 + s3 AS y2 FROM (SELECT f.signal_id, e.i, e.x, f.s2, f.s3, f.s4, co.*, n1 * e.x + f.s1 AS y1 FROM fw f JOIN ex e ON e.signal_id = f.signal_id AND e.i = f.i + 1, co) g) h),
    rv AS (SELECT f.signal_id, n + 2 * pad - 1 - i AS i, y AS x FROM fw f JOIN le USING (signal_id) WHERE i >= 0),
    bw AS (
      SELECT signal_id, -1::BIGINT AS i, -n1 * x AS s1, n1 * x AS s2, 0::DOUBLE AS s3, 0::DOUBLE AS s4, 0::DOUBLE AS y FROM rv, co WHERE i = 0
      UNION ALL
      SELECT signal_id, i, -2 * n1 * x - a1 * y1 + s2, n1 * x - a2 * y1, -2 * n2 * y1 - d1 * y2 + s4, n2 * y1 - d2 * y2, y2
      FROM (SELECT *, n2 * y1 + s3 AS y2 FROM (SELECT f.signal_id, e.i, e.x, f.s2, f.s3, f.s4, co.*, n1 * e.x + f.s1 AS y1 FROM bw f JOIN rv e ON e.signal_id = f.signal_id AND e.i = f.i + 1, co) g) h)
    SELECT b.signal_id, n + pad - 1 - i AS t, round(y, 6) + 0.0 AS x FROM bw b JOIN le USING (signal_id) WHERE i BETWEEN pad AND n + pad - 1"""
)


@query("sig14_forward_backward", HIGHPASS_SQL)
def forward_backward(t: Tables):
    """The recursion with reflected ends, block by block."""
    rows = FB.forward_backward(t.views.sig_samples, FB.butterworth(70, None, 2000))
    return six(rows, "x", keep=("signal_id", "t"))


@query(
    "sig14_bandlimit",
    sql(SIG_SAMPLES, taps_sql("h", BAND)) + ", f AS (" + FILTERED.format(s="sig_samples", taps="h") + ") SELECT signal_id, t, round(x, 6) + 0.0 AS x FROM f",
)
def bandlimit(t: Tables):
    return six(S.zero_phase_filter(t.views.sig_samples, BAND), "x", keep=("signal_id", "t"))


@query(
    "sig14_highpass",
    sql(SIG_SAMPLES, taps_sql("h", HIGH)) + ", f AS (" + FILTERED.format(s="sig_samples", taps="h") + ") SELECT signal_id, t, round(x, 6) + 0.0 AS x FROM f",
)
def highpass(t: Tables):
    return six(S.zero_phase_filter(t.views.sig_samples, HIGH), "x", keep=("signal_id", "t"))


NORMALIZED = (
    "SELECT s.signal_id, s.t, s.x * CASE WHEN p * g + 1e-12 > 0.99 THEN g * 0.99 / (p * g + 1e-12) ELSE g END AS x FROM {s} s JOIN "
    "(SELECT signal_id, max(abs(x)) AS p, pow(10, {db} / 20) / (sqrt(avg(x * x)) + 1e-12) AS g FROM {s} GROUP BY signal_id) l ON l.signal_id = s.signal_id"
)


@query(
    "sig15_rms_normalize",
    sql(SIG_SAMPLES) + ", n AS (" + NORMALIZED.format(s="sig_samples", db="-4.0") + ") SELECT signal_id, t, round(x, 6) + 0.0 AS x FROM n",
)
def rms_normalize(t: Tables):
    return six(S.rms_normalize(t.views.sig_samples, -4.0), "x", keep=("signal_id", "t"))


@query(
    "sig15_rms_normalize_reversible",
    sql(SIG_SAMPLES)
    + """, q AS (SELECT signal_id, t, CASE WHEN signal_id % 9 = 0 THEN x * 1e-5 WHEN signal_id % 4 = 0 THEN x * 1e-3 ELSE x END AS x FROM sig_samples),
    l AS (SELECT signal_id, 20 * log10(sqrt(avg(x * x)) + 1e-12) AS lv, max(abs(x)) AS p FROM q GROUP BY signal_id),
    g AS (SELECT signal_id, lv <= -80 AS silent, CASE WHEN lv <= -80 THEN 1 ELSE least(pow(10, greatest(least(-25 - lv, 30), -30) / 20), 0.98 / (p + 1e-12)) END AS gain FROM l)
    SELECT q.signal_id, t, silent, round(gain, 6) + 0.0 AS gain, round(x * gain, 6) + 0.0 AS x, round(x, 8) + 0.0 AS undone FROM q JOIN g USING (signal_id)""",
)
def rms_normalize_reversible(t: Tables):
    s = F.col("signal_id")
    factor = F.when(s % 9 == 0, 1e-5).when(s % 4 == 0, 1e-3).otherwise(1.0)
    rows = S.rms_normalize_reversible(t.views.sig_samples.withColumn("x", F.col("x") * factor))
    rows = rows.withColumn("y", F.col("x"))
    undone = S.undo_gain(rows)
    return undone.select(
        "signal_id", "t", "silent", rounded(F.col("gain")).alias("gain"), rounded(F.col("y")).alias("x"), rounded(F.col("x"), 8).alias("undone")
    )


@query(
    "sig16_blend",
    sql(SIG_PAIRS) + "SELECT signal_id, t, round(0.7 * est + 0.3 * noisy, 6) + 0.0 AS x FROM sig_pairs",
)
def blend(t: Tables):
    pairs = t.views.sig_pairs
    enhanced = pairs.select("signal_id", "t", "block", F.col("est").alias("x"))
    return six(S.blend(enhanced, pairs.select("signal_id", "t", F.col("noisy").alias("x")), 0.7), "x", keep=("signal_id", "t"))


@query(
    "sig17_peak_limit",
    sql(SIG_SAMPLES)
    + """, p AS (SELECT signal_id, t, x * 9.5 AS x, max(abs(x * 9.5)) OVER (PARTITION BY signal_id) + 1e-12 AS p FROM sig_samples)
    SELECT signal_id, t, round(x * CASE WHEN p > 0.99 THEN 0.99 / p ELSE 1 END, 6) + 0.0 AS x FROM p""",
)
def peak_limit(t: Tables):
    return six(S.peak_limit(t.views.sig_samples.withColumn("x", F.col("x") * 9.5)), "x", keep=("signal_id", "t"))


@query(
    "sig18_declip_runs",
    sql(SIG_SAMPLES)
    + """, q AS (SELECT signal_id, t, greatest(least(x, 0.06), -0.06) AS x FROM sig_samples), sg AS (SELECT signal_id, t, unnest([1, -1]) AS sign, x FROM q),
    y AS (SELECT *, x * sign AS y, max(x * sign) OVER (PARTITION BY signal_id, sign) AS level FROM sg),
    nr AS (SELECT signal_id, sign, level, t, t - row_number() OVER (PARTITION BY signal_id, sign ORDER BY t) AS g FROM y WHERE level >= 1e-3 AND y >= level - greatest(1e-4 * level, 1.5 / 32768)),
    r AS (SELECT signal_id, sign, max(level) AS level, min(t) AS start_sample, max(t) + 1 AS end_sample FROM nr GROUP BY signal_id, sign, g HAVING count(*) >= 2),
    k AS (SELECT *, count(*) OVER (PARTITION BY signal_id, sign) AS runs FROM r), v AS (SELECT *, sum(end_sample - start_sample) OVER (PARTITION BY signal_id) AS c FROM k WHERE runs >= 2),
    n AS (SELECT signal_id, count(*) AS n FROM q GROUP BY signal_id)
    SELECT v.signal_id, CAST(sign AS BIGINT) AS sign, start_sample, end_sample, round(level, 6) + 0.0 AS level, round(c / n, 6) + 0.0 AS clipped_share FROM v JOIN n ON n.signal_id = v.signal_id WHERE c / n BETWEEN 5e-4 AND 0.3""",
)
def declip_runs(t: Tables):
    rows = t.views.sig_samples.withColumn("x", F.greatest(F.least("x", F.lit(0.06)), F.lit(-0.06)))
    runs = S.declip_runs(rows, min_run=2, most=0.3).withColumn("sign", F.col("sign").cast("bigint"))
    return six(runs, "level", "clipped_share", keep=("signal_id", "sign", "start_sample", "end_sample"))


CLIPPED_SQL = (
    sql(SIG_SAMPLES)
    + """, q AS (SELECT signal_id, t, greatest(least(x, 0.06), -0.06) AS x FROM sig_samples), sg AS (SELECT signal_id, t, unnest([1, -1]) AS sign, x FROM q),
    y AS (SELECT *, x * sign AS y, max(x * sign) OVER (PARTITION BY signal_id, sign) AS level FROM sg),
    nr AS (SELECT signal_id, sign, level, t, t - row_number() OVER (PARTITION BY signal_id, sign ORDER BY t) AS g FROM y WHERE level >= 1e-3 AND y >= level - greatest(1e-4 * level, 1.5 / 32768)),
    r AS (SELECT signal_id, sign, max(level) AS level, min(t) AS a, max(t) + 1 AS b FROM nr GROUP BY signal_id, sign, g HAVING count(*) >= 2),
    k AS (SELECT *, count(*) OVER (PARTITION BY signal_id, sign) AS runs FROM r), v AS (SELECT *, sum(b - a) OVER (PARTITION BY signal_id) AS c FROM k WHERE runs >= 2),
    n AS (SELECT signal_id, count(*) AS n FROM q GROUP BY signal_id),
    ru AS (SELECT v.signal_id, sign, level, a, b, CASE WHEN b - a > 3 THEN 'long run' WHEN a < 2 OR b + 2 > n THEN 'at an end' END AS kept FROM v JOIN n USING (signal_id) WHERE c / n BETWEEN 5e-4 AND 0.3)
    """
)


def clipped(t: Tables):
    return t.views.sig_samples.withColumn("x", F.greatest(F.least("x", F.lit(0.06)), F.lit(-0.06)))


@query(
    "sig18_repairable_runs",
    CLIPPED_SQL + "SELECT signal_id, CAST(sign AS BIGINT) AS sign, a AS start_sample, b AS end_sample, kept AS \"left\" FROM ru",
)
def repairable_runs(t: Tables):
    runs = S.repairable_runs(clipped(t), max_run=3, context=2, min_run=2, most=0.3)
    return runs.select("signal_id", F.col("sign").cast("bigint").alias("sign"), "start_sample", "end_sample", "left")


@query(
    "sig18_declip_two_neighbours",
    CLIPPED_SQL
    + """, kn AS (SELECT ru.*, u.t AS at, u.x AS v FROM ru JOIN q u ON u.signal_id = ru.signal_id AND (u.t BETWEEN a - 2 AND a - 1 OR u.t BETWEEN b AND b + 1) WHERE kept IS NULL),
    ga AS (SELECT DISTINCT signal_id, sign, level, a, b FROM kn), ti AS (SELECT *, unnest(range(a, b)) AS t FROM ga),
    la AS (SELECT ti.signal_id, ti.sign, ti.level, ti.t, sum(p.v * (SELECT product((ti.t - o.at) / CAST(p.at - o.at AS DOUBLE)) FROM kn o WHERE o.signal_id = p.signal_id AND o.sign = p.sign AND o.a = p.a AND o.at <> p.at)) AS y
      FROM ti JOIN kn p ON p.signal_id = ti.signal_id AND p.sign = ti.sign AND p.a = ti.a GROUP BY ti.signal_id, ti.sign, ti.level, ti.t)
    SELECT q.signal_id, q.t, round(coalesce(la.sign * least(greatest(la.sign * la.y, la.level), 1.3 * la.level), q.x), 6) + 0.0 AS x FROM q LEFT JOIN la ON la.signal_id = q.signal_id AND la.t = q.t""",
)
def declip_two_neighbours(t: Tables):
    """With two samples on each side the spline is the one cubic through four points."""
    return six(S.declip(clipped(t), min_run=2, most=0.3, max_run=3, context=2), "x", keep=("signal_id", "t"))


@query("sig18_declip")
def declip(t: Tables):
    rows = t.views.sig_samples.withColumn("x", F.greatest(F.least("x", F.lit(0.06)), F.lit(-0.06)))
    return S.declip(rows, min_run=2, most=0.3, context=4).select("signal_id", "t", "x")


@query(
    "sig19_apply_delay",
    sql(SIG_SAMPLES)
    + """, m AS (SELECT signal_id, t - (signal_id % 7 - 3) AS t, x FROM sig_samples UNION ALL SELECT signal_id, unnest(range(3 - signal_id % 7)), 0.0 FROM (SELECT DISTINCT signal_id FROM sig_samples) WHERE signal_id % 7 < 3)
    SELECT signal_id, t, round(x, 6) + 0.0 AS x FROM m WHERE t >= 0""",
)
def apply_delay(t: Tables):
    samples = t.views.sig_samples
    lags = samples.groupBy("signal_id").agg(F.lit(1)).select("signal_id", (F.col("signal_id") % 7 - 3).alias("lag"))
    return six(S.apply_delay(samples, lags), "x", keep=("signal_id", "t"))


CORRELATION_SQL = (
    ", lg AS (SELECT unnest(range(-4, 5)) AS lag), co AS (SELECT a.signal_id, lag, sum(a.clean * b.{o}) AS c FROM sig_pairs a JOIN lg ON true JOIN sig_pairs b ON b.signal_id = a.signal_id AND b.t = a.t + lag GROUP BY a.signal_id, lag), "
    "bl AS (SELECT signal_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY abs(c) DESC, lag) AS rn FROM co) WHERE rn = 1) "
)


@query("srt9_best_lag", sql(SIG_PAIRS) + CORRELATION_SQL.format(o="noisy") + "SELECT signal_id, lag FROM bl")
def best_lag(t: Tables):
    return S.best_lag(t.views.sig_pairs, 4)


PHAT_SQL = (
    ", st AS (SELECT signal_id, avg(clean) AS mr, avg(est) AS md, CAST(pow(2, ceil(log2(2 * count(*) - 1))) AS BIGINT) AS n FROM sig_pairs GROUP BY signal_id), "
    "ce AS (SELECT s.signal_id, t, n, clean - mr AS r, est - md AS d FROM sig_pairs s JOIN st USING (signal_id)), "
    "kk AS (SELECT signal_id, unnest(range(n)) AS k FROM st), "
    "ft AS (SELECT ce.signal_id, k, any_value(n) AS n, sum(r * cos(2 * pi() * (k * t % n) / n)) AS rr, -sum(r * sin(2 * pi() * (k * t % n) / n)) AS ri, sum(d * cos(2 * pi() * (k * t % n) / n)) AS dr, -sum(d * sin(2 * pi() * (k * t % n) / n)) AS di "
    "FROM ce JOIN kk USING (signal_id) GROUP BY ce.signal_id, k), "
    "cr AS (SELECT signal_id, k, n, dr * rr + di * ri AS re, di * rr - dr * ri AS im FROM ft), wh AS (SELECT signal_id, k, n, re / (sqrt(re * re + im * im) + 1e-12) AS re, im / (sqrt(re * re + im * im) + 1e-12) AS im FROM cr), "
    "cc AS (SELECT signal_id, lag, sum(re * cos(2 * pi() * (k * lag) / n) - im * sin(2 * pi() * (k * lag) / n)) / any_value(n) AS v FROM wh CROSS JOIN (SELECT unnest(range(-4, 5)) AS lag) GROUP BY signal_id, lag), "
    "ph AS (SELECT signal_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY v DESC, lag) AS rn FROM cc) WHERE rn = 1) "
)


@query("srt9_phat_lag", sql(SIG_PAIRS) + PHAT_SQL + "SELECT signal_id, lag FROM ph")
def phat_lag(t: Tables):
    return S.phat_lag(t.views.sig_pairs, 4, "clean", "est")


ALIGNED_SQL = (
    ", sh AS (SELECT s.signal_id, s.t - lag AS t, est FROM sig_pairs s JOIN {lags} l ON l.signal_id = s.signal_id WHERE s.t >= lag UNION ALL SELECT signal_id, unnest(range(-lag)), 0.0 FROM {lags} WHERE lag < 0), "
    "pr AS (SELECT c.signal_id, clean, sh.est FROM sig_pairs c JOIN sh ON sh.signal_id = c.signal_id AND sh.t = c.t), "
    "ga AS (SELECT signal_id, sum(clean * est) / (sum(est * est) + 1e-12) AS gain FROM pr GROUP BY signal_id), "
    "sm AS (SELECT signal_id, gain, clean, est * gain AS e FROM pr JOIN ga USING (signal_id)), "
    "pj AS (SELECT signal_id, sum(clean * e) / (sum(clean * clean) + 1e-12) AS a FROM sm GROUP BY signal_id), "
    "al AS (SELECT sm.signal_id, any_value(gain) AS gain, 10 * log10(sum(clean * clean) / (sum((clean - e) * (clean - e)) + 1e-12)) AS snr, "
    "10 * log10((sum(a * clean * a * clean) + 1e-12) / (sum((e - a * clean) * (e - a * clean)) + 1e-12)) AS si_sdr FROM sm JOIN pj USING (signal_id) GROUP BY sm.signal_id) "
)


@query(
    "sig20_align_and_gain_match",
    sql(SIG_PAIRS) + CORRELATION_SQL.format(o="est") + ALIGNED_SQL.format(lags="bl")
    + "SELECT signal_id, lag, round(gain, 6) + 0.0 AS gain, round(snr, 6) + 0.0 AS snr, round(si_sdr, 5) + 0.0 AS si_sdr FROM al JOIN bl USING (signal_id)",
)
def align_and_gain_match(t: Tables):
    pairs = t.views.sig_pairs
    clean = pairs.select("signal_id", "t", "block", F.col("clean").alias("x"))
    estimate = pairs.select("signal_id", "t", "block", F.col("est").alias("x"))
    scored = S.align_and_gain_match(clean, estimate, 4, "plain")
    return scored.select(
        "signal_id", "lag", rounded(F.col("gain")).alias("gain"), rounded(F.col("snr")).alias("snr"), rounded(F.col("si_sdr"), 5).alias("si_sdr")
    )


CROP_SQL = (
    ", ln AS (SELECT signal_id, count(*) AS n, unnest([0, 1]) AS item FROM sig_pairs GROUP BY signal_id), "
    "stt AS (SELECT *, CASE WHEN n > 64 THEN " + d("7", "'crop'", "signal_id", "item") + " % (n - 63) ELSE 0 END AS start FROM ln) "
)


@query(
    "sig21_crop_pad_pairs",
    sql(SIG_PAIRS) + CROP_SQL
    + """, sg AS (SELECT signal_id, item, start, unnest(range(64)) AS t FROM stt)
    SELECT sg.signal_id, item, sg.t, round(coalesce(noisy, 0), 6) + 0.0 AS noisy, round(coalesce(clean, 0), 6) + 0.0 AS clean FROM sg LEFT JOIN sig_pairs p ON p.signal_id = sg.signal_id AND p.t = sg.start + sg.t""",
)
def crop_pad_pairs(t: Tables):
    pairs = t.views.sig_pairs
    lengths = pairs.groupBy("signal_id").agg(F.count(F.lit(1)).alias("length"))
    lengths = lengths.withColumn("item", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    starts = S.crop_starts(lengths, draw(7, "crop", F.col("signal_id"), F.col("item")), 64)
    return six(S.crop_pad_pairs(pairs, starts, 64, ["noisy", "clean"]), "noisy", "clean", keep=("signal_id", "item", "t"))


@query(
    "sig22_batches",
    sql(RECORDS)
    + """, o AS (SELECT k, target_snr_db, row_number() OVER (ORDER BY md5(concat_ws(':', 5, 0, k)), k) - 1 AS position FROM records)
    SELECT position // 16 AS step, count(*) AS items, string_agg(CAST(k AS VARCHAR), ';' ORDER BY position) AS ids, round(max(target_snr_db), 6) + 0.0 AS top FROM o GROUP BY 1""",
)
def batches(t: Tables):
    ordered = Q.epoch_order(t.views.records.select("k", "target_snr_db"), "k", 5, 1, 16)
    rows = S.batches(ordered, ["k", "target_snr_db"])
    return rows.select(
        "step",
        F.size("items").cast("bigint").alias("items"),
        F.array_join(F.transform("items", lambda i: i["k"].cast("string")), ";").alias("ids"),
        rounded(F.array_max(F.transform("items", lambda i: i["target_snr_db"]))).alias("top"),
    )


def chain_sql(source: str) -> str:
    """SQL of the clean chain (half gain as enhancer, 0.8 wet) over a CTE of samples."""
    return (
        f", dc AS (SELECT signal_id, t, x - avg(x) OVER (PARTITION BY signal_id) AS x FROM {source}), f1 AS ("
        + FILTERED.format(s="dc", taps="hp") + "), n1 AS (" + NORMALIZED.format(s="f1", db="-26.0")
        + "), en AS (SELECT signal_id, t, x * 0.5 AS x FROM n1), bl AS (SELECT en.signal_id, en.t, 0.8 * en.x + 0.2 * n1.x AS x FROM en JOIN n1 ON n1.signal_id = en.signal_id AND n1.t = en.t), f2 AS ("
        + FILTERED.format(s="bl", taps="bp") + "), n2 AS (" + NORMALIZED.format(s="f2", db="-26.0")
        + "), p AS (SELECT signal_id, t, x, max(abs(x)) OVER (PARTITION BY signal_id) + 1e-12 AS p FROM n2) SELECT {signal} AS signal_id, t, round(x * CASE WHEN p > 0.99 THEN 0.99 / p ELSE 1 END, 6) + 0.0 AS x FROM p"
    )


def half_gain(rows):
    return rows.withColumn("x", F.col("x") * 0.5)


@query(
    "sig32_clean_chain",
    sql(SIG_SAMPLES, taps_sql("hp", HIGH), taps_sql("bp", BAND)) + chain_sql("sig_samples").replace("{signal}", "signal_id"),
)
def clean_chain(t: Tables):
    samples = t.views.sig_samples.select("signal_id", "t", "block", "x")
    rows = S.clean_chain(samples, HIGH, BAND, half_gain, wet=0.8, normalize_after=True)
    return six(rows, "x", keep=("signal_id", "t"))


@query(
    "agg30_hop_clip_flag",
    sql(SIG_SAMPLES) + "SELECT signal_id, t // 12 AS hop, max(abs(x * 10.2)) >= 0.999 AS clipped FROM sig_samples GROUP BY signal_id, t // 12",
)
def hop_clip_flag(t: Tables):
    return S.hop_clip_flags(t.views.sig_samples.withColumn("x", F.col("x") * 10.2), 12)


@query(
    "stf7_tumbling_hops",
    sql(SIG_SAMPLES)
    + "SELECT signal_id, t // 12 AS hop, count(*) AS n, round(sqrt(avg(x * x)), 6) + 0.0 AS rms FROM sig_samples GROUP BY signal_id, t // 12",
)
def tumbling_hops(t: Tables):
    return t.views.sig_samples.groupBy("signal_id", F.floor(F.col("t") / 12).alias("hop")).agg(
        F.count(F.lit(1)).alias("n"), rounded(M.rms("x")).alias("rms")
    )
