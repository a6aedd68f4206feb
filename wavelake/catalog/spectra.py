"""Frame, bin and causal-state queries."""

import numpy as np
from pyspark.sql import functions as F

from wavelake.catalog.registry import Tables, query, rounded
from wavelake.catalog.views import FRAME_BINS, SIG_SAMPLES, sql
from wavelake.operators import spectra as Z
from wavelake.operators import stateful as K
from wavelake.operators.sequences import softmax_weights

# Eight bands over the 33 bins of a 64-point spectrum, and over 64 positions.
WIDTHS = [1, 1, 2, 2, 4, 6, 8, 9]
WIDE = [2, 2, 4, 4, 8, 12, 16, 16]


def band_sql(name: str, widths) -> str:
    case = " ".join(f"WHEN {name} < {sum(widths[: i + 1])} THEN {i}" for i in range(len(widths)))
    return f"CASE {case} END"


SPEC = (
    FRAME_BINS
    + ", wn AS (SELECT signal_id, frame, bin, v * sin(pi() / 2 * pow(sin(pi() * (bin + 0.5) / 64), 2)) AS v FROM frame_bins), "
    "kk AS (SELECT unnest(range(33)) AS k), "
    "spec AS (SELECT signal_id, frame, k AS bin, sum(v * cos(2 * pi() * (k * bin % 64) / 64)) / 64 AS re, -sum(v * sin(2 * pi() * (k * bin % 64) / 64)) / 64 AS im FROM wn CROSS JOIN kk GROUP BY signal_id, frame, k)"
)
NORM = 1.0 / 64


def spec_frames(t: Tables):
    return t.views.frames.select("signal_id", "frame", "block", Z.spectrum("x", Z.window_values(64), NORM).alias("spec"))


def spec_bins(t: Tables):
    return Z.bins_of(spec_frames(t))


def bin_output(df, *names, keep=("signal_id", "frame", "bin")):
    return df.select(*keep, *[rounded(F.col(n)).alias(n) for n in names])


@query("sig24_spectrum", sql(SPEC) + "SELECT signal_id, frame, bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM spec")
def spectrum(t: Tables):
    return bin_output(spec_bins(t), "re", "im")


@query(
    "sig24_inverse_spectrum",
    sql(FRAME_BINS)
    + "SELECT signal_id, frame, bin AS i, round(v * pow(sin(pi() / 2 * pow(sin(pi() * (bin + 0.5) / 64), 2)), 2), 6) + 0.0 AS x FROM frame_bins",
)
def inverse_spectrum(t: Tables):
    frames = spec_frames(t).select("signal_id", "frame", Z.inverse_spectrum("spec", Z.window_values(64), 64.0).alias("y"))
    rows = frames.select("signal_id", "frame", F.posexplode("y").alias("i", "x"))
    return rows.select("signal_id", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("x")).alias("x"))


@query(
    "udf2_transform_spectrum",
    sql(SPEC) + "SELECT signal_id, frame, bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(-im * 2, 6) + 0.0 AS turned FROM spec",
)
def transform_spectrum(t: Tables):
    frames = spec_frames(t).withColumn("same", Z.transform_spectrum(lambda spec: spec))
    frames = frames.withColumn("turn", Z.transform_spectrum(lambda spec: spec * 2j))
    zipped = F.arrays_zip(F.col("same.re").alias("re"), F.col("same.im").alias("im"), F.col("turn.re").alias("turned"))
    rows = frames.select("signal_id", "frame", F.posexplode(zipped).alias("bin", "z"))
    rows = rows.select("signal_id", "frame", F.col("bin").cast("bigint").alias("bin"), "z.*")
    return bin_output(rows, "re", "im", "turned")


def smoothing_model():
    """A caller's model for the query: each bin as the mean of itself and the bin below, halved at the edge."""

    def predict(spec):
        below = np.concatenate([np.zeros((len(spec), 1)), spec[:, :-1]], axis=1)
        return (spec + below) / 2

    return predict


@query(
    "udf1_enhance",
    sql(SPEC)
    + "SELECT signal_id, frame, bin, round((re + coalesce(lag(re) OVER w, 0)) / 2, 6) + 0.0 AS re, round((im + coalesce(lag(im) OVER w, 0)) / 2, 6) + 0.0 AS im "
    "FROM spec WINDOW w AS (PARTITION BY signal_id, frame ORDER BY bin)",
)
def enhance(t: Tables):
    return bin_output(Z.bins_of(Z.enhance(spec_frames(t), smoothing_model)), "re", "im")


@query(
    "sca22_window_and_filterbank",
    sql(FRAME_BINS)
    + f""", b AS (SELECT *, {band_sql('bin', WIDE)} AS band FROM frame_bins), w AS (SELECT *, ({WIDE})[CAST(band AS INTEGER) + 1] AS width FROM b)
    SELECT signal_id, frame, band, round(sum(v * sin(pi() / 2 * pow(sin(pi() * (bin + 0.5) / 64), 2)) / width), 6) + 0.0 AS mean, count(*) AS bins FROM w GROUP BY signal_id, frame, band""",
)
def window_and_filterbank(t: Tables):
    rows = Z.filterbank(t.views.frame_bins, WIDE)
    value = F.col("v") * Z.analysis_window(F.col("bin"), 64) * F.col("forward")
    return rows.groupBy("signal_id", "frame", "band").agg(
        rounded(F.sum(value)).alias("mean"), F.sum("inverse").cast("bigint").alias("bins")
    )


@query(
    "sig23_to_hops",
    sql(SIG_SAMPLES)
    + """, n AS (SELECT signal_id, count(*) AS n FROM sig_samples GROUP BY signal_id), h AS (SELECT signal_id, n, unnest(range((n + 7) // 8 + 2)) AS frame FROM n),
    f AS (SELECT signal_id, n, frame, unnest(range(8)) AS i FROM h)
    SELECT f.signal_id, f.n AS length, frame, i, round(coalesce(x, 0), 6) + 0.0 AS x FROM f LEFT JOIN sig_samples s ON s.signal_id = f.signal_id AND s.t = frame * 8 + i""",
)
def to_hops(t: Tables):
    hops = Z.to_hops(t.views.sig_samples, 8, 16)
    rows = hops.select("signal_id", "length", "frame", F.posexplode("x").alias("i", "x"))
    return rows.select("signal_id", "length", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("x")).alias("x"))


@query(
    "sig23_round_trip",
    sql(SIG_SAMPLES) + "SELECT signal_id, t, round(x, 6) + 0.0 AS x FROM sig_samples",
)
def round_trip(t: Tables):
    """Hops, frames, spectrum, inverse, overlap-add and trim give the signal back."""
    from wavelake.operators.sequences import analysis_frames

    hops = Z.to_hops(t.views.sig_samples, 8, 16)
    frames = analysis_frames(hops, ["signal_id"])
    window = Z.window_values(16)
    frames = frames.select("signal_id", "length", "frame", Z.spectrum("x", window).alias("spec"))
    frames = frames.select("signal_id", "length", "frame", Z.inverse_spectrum("spec", window).alias("x"))
    samples = Z.trim(Z.overlap_add(frames, 8, keys=("signal_id", "length")), 8)
    return samples.select("signal_id", "t", rounded(F.col("x")).alias("x"))


@query(
    "sig25_overlap_add",
    sql(FRAME_BINS) + "SELECT signal_id, frame * 32 + bin AS t, round(sum(v), 6) + 0.0 AS x FROM frame_bins GROUP BY 1, 2",
)
def overlap_add(t: Tables):
    return Z.overlap_add(t.views.frames, 32).select("signal_id", "t", rounded(F.col("x")).alias("x"))


ERB = SPEC + f", erb AS (SELECT signal_id, frame, {band_sql('bin', WIDTHS)} AS band, 10 * log10(avg(re * re + im * im) + 1e-10) AS erb FROM spec GROUP BY ALL)"


@query("sig26_erb_features", sql(ERB) + "SELECT signal_id, frame, band, round(erb, 6) + 0.0 AS erb FROM erb")
def erb_features(t: Tables):
    return bin_output(Z.erb_features(spec_bins(t), WIDTHS), "erb", keep=("signal_id", "frame", "band"))


@query(
    "jn13_band_to_bins",
    sql(ERB) + f"SELECT s.signal_id, s.frame, s.bin, e.band, round(erb, 6) + 0.0 AS erb FROM spec s JOIN erb e ON e.signal_id = s.signal_id AND e.frame = s.frame AND e.band = {band_sql('s.bin', WIDTHS)}",
)
def band_to_bins(t: Tables):
    bins = spec_bins(t)
    rows = Z.band_to_bins(bins, Z.erb_features(bins, WIDTHS), WIDTHS)
    return bin_output(rows, "erb", keep=("signal_id", "frame", "bin", "band"))


@query(
    "sig27_apply_band_gain",
    sql(ERB)
    + f"""SELECT s.signal_id, s.frame, s.bin, round(re * (1 + erb / 100), 6) + 0.0 AS re, round(im * (1 + erb / 100), 6) + 0.0 AS im
    FROM spec s JOIN erb e ON e.signal_id = s.signal_id AND e.frame = s.frame AND e.band = {band_sql('s.bin', WIDTHS)}""",
)
def apply_band_gain(t: Tables):
    bins = spec_bins(t)
    gains = Z.erb_features(bins, WIDTHS).withColumn("gain", 1 + F.col("erb") / 100)
    return bin_output(Z.apply_band_gain(bins, gains, WIDTHS), "re", "im")


@query(
    "sig28_attenuation_limit",
    sql(FRAME_BINS)
    + """, e AS (SELECT signal_id, frame, bin, v * 0.5 AS re, v * v AS im, coalesce(lag(v) OVER w, 0) AS nr, coalesce(lag(1 - v) OVER w, 0) AS ni FROM frame_bins WINDOW w AS (PARTITION BY signal_id, bin ORDER BY frame))
    SELECT signal_id, frame, bin, round(re + pow(10, -12.0 / 20) * (nr - re), 6) + 0.0 AS re, round(im + pow(10, -12.0 / 20) * (ni - im), 6) + 0.0 AS im FROM e""",
)
def attenuation_limit(t: Tables):
    v = F.col("v")
    bins = t.views.frame_bins.select(
        "signal_id", "frame", "bin", (v * 0.5).alias("re"), (v * v).alias("im"), v.alias("noisy_re"), (1 - v).alias("noisy_im")
    )
    return bin_output(Z.attenuation_limit(bins, 12.0), "re", "im")


@query(
    "agg33_silence_flag",
    sql(FRAME_BINS) + "SELECT signal_id, frame, avg(v * v * CASE WHEN frame % 3 = 0 THEN 1e-6 ELSE 1 END) < 1e-7 AS silent FROM frame_bins GROUP BY signal_id, frame",
)
def silence_flag(t: Tables):
    quiet = F.transform("x", lambda v: v * F.when(F.col("frame") % 3 == 0, 1e-3).otherwise(1.0))
    return t.views.frames.withColumn("x", quiet).select("signal_id", "frame", Z.silence_flag().alias("silent"))


@query(
    "sig29_silence_bypass",
    sql(FRAME_BINS) + "SELECT signal_id, frame, bin AS i, round(CASE WHEN frame % 3 = 0 THEN 0 ELSE v * 2 END, 6) + 0.0 AS y FROM frame_bins",
)
def silence_bypass(t: Tables):
    quiet = F.transform("x", lambda v: v * F.when(F.col("frame") % 3 == 0, 1e-3).otherwise(1.0))
    frames = t.views.frames.withColumn("y", F.transform("x", lambda v: v * 2)).withColumn("x", quiet)
    rows = Z.silence_bypass(frames).select("signal_id", "frame", F.posexplode("y").alias("i", "y"))
    return rows.select("signal_id", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("y")).alias("y"))


@query(
    "sig29_state_over_silence",
    sql(FRAME_BINS).replace("WITH ", "WITH RECURSIVE ")
    + """, q AS (SELECT *, frame % 3 = 0 AS silent FROM frame_bins), h AS (SELECT signal_id, frame, bin, abs(v) AS v, row_number() OVER (PARTITION BY signal_id, bin ORDER BY frame) - 1 AS n FROM q WHERE NOT silent),
    r AS (SELECT signal_id, bin, n, frame, v, 0.99 * (1e-3 - 9e-4 * bin / 63.0::DOUBLE) + (1 - 0.99::DOUBLE) * v AS s FROM h WHERE n = 0 UNION ALL
      SELECT h.signal_id, h.bin, h.n, h.frame, h.v, 0.99 * r.s + (1 - 0.99::DOUBLE) * h.v FROM r JOIN h ON h.signal_id = r.signal_id AND h.bin = r.bin AND h.n = r.n + 1)
    SELECT q.signal_id, q.frame, q.bin AS i, round(CASE WHEN q.silent THEN 0 ELSE r.v / sqrt(r.s) END, 6) + 0.0 AS y FROM q LEFT JOIN r ON r.signal_id = q.signal_id AND r.frame = q.frame AND r.bin = q.bin""",
)
def state_over_silence(t: Tables):
    """Magnitudes over the root of their running mean; every third frame is silent and leaves the mean as it is."""
    quiet = F.transform("x", lambda v: v * F.when(F.col("frame") % 3 == 0, 1e-5).otherwise(1.0))

    def normalised(frames):
        bins = frames.select("signal_id", "frame", F.posexplode("x").alias("bin", "v"))
        rows = K.unit_norm(bins.select("signal_id", "frame", "bin", F.abs("v").alias("re"), F.lit(0.0).alias("im")), count=64)
        packed = rows.groupBy("signal_id", "frame").agg(F.array_sort(F.collect_list(F.struct("bin", "re"))).alias("p"))
        return packed.select("signal_id", "frame", F.transform("p", lambda p: p["re"]).alias("y"))

    rows = Z.over_silence(t.views.frames.withColumn("x", quiet), normalised, ["y"])
    rows = rows.select("signal_id", "frame", F.posexplode("y").alias("i", "y"))
    return rows.select("signal_id", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("y")).alias("y"))


@query(
    "agg31_dead_reference",
    sql(SPEC) + "SELECT signal_id, frame, avg(re * re + im * im) * CASE WHEN frame % 4 = 0 THEN 1e-10 ELSE 1 END < 1e-12 AS dead FROM spec GROUP BY signal_id, frame",
)
def dead_reference(t: Tables):
    factor = F.when(F.col("frame") % 4 == 0, 1e-5).otherwise(1.0)
    bins = spec_bins(t).withColumn("re", F.col("re") * factor).withColumn("im", F.col("im") * factor)
    return Z.dead_reference(bins)


# Two experts: positions 0 .. 31 and 32 .. 63 of a frame, eight bands of four bins.
EXPERTS = (
    FRAME_BINS
    + ", ex AS (SELECT signal_id, frame, bin % 32 AS bin, bin // 32 AS expert, bin % 32 // 4 AS band, v AS re, v * 0.5 AS im FROM frame_bins), "
    "mk AS (SELECT signal_id, frame, band, expert, avg(abs(re)) AS mask FROM ex GROUP BY ALL), "
    "lx AS (SELECT *, exp(mask * 10 - max(mask * 10) OVER w) AS e FROM mk WINDOW w AS (PARTITION BY signal_id, frame, band)), "
    "wt AS (SELECT signal_id, frame, band, expert, e / sum(e) OVER (PARTITION BY signal_id, frame, band) AS w FROM lx)"
)
EVEN = [4] * 8


def experts(t: Tables):
    return t.views.frame_bins.select(
        "signal_id", "frame", (F.col("bin") % 32).alias("bin"), F.floor(F.col("bin") / 32).alias("expert"),
        F.col("v").alias("re"), (F.col("v") * 0.5).alias("im"),
    )


def expert_masks(t: Tables):
    rows = experts(t).withColumn("band", Z.band_of(F.col("bin"), EVEN))
    return rows.groupBy("signal_id", "frame", "band", "expert").agg(F.avg(F.abs("re")).alias("mask"))


def learned_weights(t: Tables):
    return softmax_weights(expert_masks(t).withColumn("logit", F.col("mask") * 10), ["signal_id", "frame", "band"]).select(
        "signal_id", "frame", "band", "expert", "w"
    )


@query(
    "sig30_fuse_learned",
    sql(EXPERTS)
    + "SELECT ex.signal_id, ex.frame, bin, round(sum(w * re), 6) + 0.0 AS re, round(sum(w * im), 6) + 0.0 AS im FROM ex JOIN wt ON wt.signal_id = ex.signal_id AND wt.frame = ex.frame AND wt.band = ex.band AND wt.expert = ex.expert GROUP BY ex.signal_id, ex.frame, bin",
)
def fuse_learned(t: Tables):
    return bin_output(Z.fuse(experts(t), learned_weights(t), EVEN), "re", "im")


@query(
    "sig30_fuse_uniform_and_rule",
    sql(EXPERTS)
    + "SELECT signal_id, frame, bin, round(avg(re), 6) + 0.0 AS uniform, round(max(re) FILTER (WHERE expert = CASE WHEN frame % 3 = 1 THEN 1 ELSE 0 END), 6) + 0.0 AS rule FROM ex GROUP BY signal_id, frame, bin",
)
def fuse_uniform_and_rule(t: Tables):
    rows = experts(t)
    uniform = Z.fuse(rows, None).select("signal_id", "frame", "bin", F.col("re").alias("uniform"))
    pairs = t.views.frames.select("signal_id", "frame", F.posexplode(Z.rule_weights(F.col("frame") % 3 == 1)).alias("expert", "w"))
    weights = pairs.withColumn("expert", F.col("expert").cast("bigint")).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("band"))
    rule = Z.fuse(rows, weights.withColumn("band", F.col("band").cast("bigint")), EVEN).select("signal_id", "frame", "bin", F.col("re").alias("rule"))
    return bin_output(uniform.join(rule, ["signal_id", "frame", "bin"]), "uniform", "rule")


@query(
    "agg21_mean_gate_weights",
    sql(EXPERTS) + "SELECT signal_id, expert, round(avg(w), 6) + 0.0 AS mean_weight FROM wt GROUP BY signal_id, expert",
)
def mean_gate_weights(t: Tables):
    return Z.mean_gate_weights(learned_weights(t)).select("signal_id", "expert", rounded(F.col("mean_weight")).alias("mean_weight"))


@query(
    "sig31_gate_features",
    sql(EXPERTS)
    + """, fe AS (SELECT signal_id, frame, 'a' AS part, band AS o, 10 * log10(avg(re * re) + 1e-10) AS v FROM ex WHERE expert = 0 GROUP BY signal_id, frame, band
      UNION ALL SELECT signal_id, frame, 'b', expert * 8 + band, mask FROM mk UNION ALL SELECT signal_id, frame, 'c', expert, avg(mask) * 20 FROM mk GROUP BY signal_id, frame, expert
      UNION ALL SELECT DISTINCT signal_id, frame, 'd', 0, CASE WHEN frame % 3 = 1 THEN 1 ELSE 0 END FROM mk UNION ALL SELECT DISTINCT signal_id, frame, 'd', 1, CAST(frame % 5 AS DOUBLE) / 5 FROM mk
      UNION ALL SELECT signal_id, frame, 'e', band, stddev_pop(mask) FROM mk GROUP BY signal_id, frame, band)
    SELECT signal_id, frame, row_number() OVER (PARTITION BY signal_id, frame ORDER BY part, o) - 1 AS i, round(v, 6) + 0.0 AS v FROM fe""",
)
def gate_features(t: Tables):
    rows, masks = experts(t), expert_masks(t)
    erb = Z.erb_features(rows.where("expert = 0").withColumn("im", F.lit(0.0)), EVEN)
    lsnr = masks.groupBy("signal_id", "frame", "expert").agg((F.avg("mask") * 20).alias("lsnr"))
    frame = F.col("frame")
    impulse = t.views.frames.select(
        "signal_id", "frame", F.when(frame % 3 == 1, 1.0).otherwise(0.0).alias("flag"), ((frame % 5) / 5).alias("severity")
    )
    features = Z.gate_features(erb, masks, lsnr, impulse)
    rows = features.select("signal_id", "frame", F.posexplode("features").alias("i", "v"))
    return rows.select("signal_id", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("v")).alias("v"))


# Causal state ---------------------------------------------------------------------------------------------------


@query(
    "stf1_impulse_flags",
    sql(SIG_SAMPLES).replace("WITH ", "WITH RECURSIVE ")
    + """, e AS (SELECT signal_id, t AS frame, greatest(pow(x, 4) * 1000, 1e-12) AS e FROM sig_samples),
    r AS (SELECT signal_id, frame, e AS floor, 0 AS held, false AS flag, 0.0::DOUBLE AS severity FROM e WHERE frame = 0 UNION ALL
      SELECT signal_id, frame, CASE WHEN h = 0 THEN 0.98 * floor + (1.0 - 0.98::DOUBLE) * e ELSE floor END, h, h > 0, least(greatest(jump, 0) / 40, 1) FROM (
        SELECT r.signal_id, e.frame, e.e, r.floor, 10 * log10(e.e / r.floor) AS jump, CASE WHEN 10 * log10(e.e / r.floor) > 13 THEN 3 ELSE greatest(r.held - 1, 0) END AS h FROM r JOIN e ON e.signal_id = r.signal_id AND e.frame = r.frame + 1))
    SELECT signal_id, frame, flag, round(severity, 6) + 0.0 AS severity FROM r""",
)
def impulse_flags(t: Tables):
    energies = t.views.sig_samples.select("signal_id", F.col("t").alias("frame"), (F.pow("x", F.lit(4)) * 1000).alias("energy"))
    return K.impulse_flags(energies).select("signal_id", "frame", "flag", rounded(F.col("severity")).alias("severity"))


@query(
    "stf2_erb_mean_norm",
    sql(ERB).replace("WITH ", "WITH RECURSIVE ")
    + """, r AS (SELECT signal_id, band, frame, 0.99 * (-60 - 30 * band / 7.0::DOUBLE) + (1 - 0.99::DOUBLE) * erb AS s, erb FROM erb WHERE frame = 0 UNION ALL
      SELECT e.signal_id, e.band, e.frame, 0.99 * r.s + (1 - 0.99::DOUBLE) * e.erb, e.erb FROM r JOIN erb e ON e.signal_id = r.signal_id AND e.band = r.band AND e.frame = r.frame + 1)
    SELECT signal_id, frame, band, round((erb - s) / 40, 6) + 0.0 AS erb_norm FROM r""",
)
def erb_mean_norm(t: Tables):
    rows = K.erb_mean_norm(Z.erb_features(spec_bins(t), WIDTHS), count=8)
    return bin_output(rows, "erb_norm", keep=("signal_id", "frame", "band"))


@query(
    "stf3_unit_norm",
    sql(SPEC).replace("WITH ", "WITH RECURSIVE ")
    + """, r AS (SELECT signal_id, bin, frame, 0.99 * (1e-3 - 9e-4 * bin / 32.0::DOUBLE) + (1 - 0.99::DOUBLE) * sqrt(re * re + im * im) AS s, re, im FROM spec WHERE frame = 0 UNION ALL
      SELECT e.signal_id, e.bin, e.frame, 0.99 * r.s + (1 - 0.99::DOUBLE) * sqrt(e.re * e.re + e.im * e.im), e.re, e.im FROM r JOIN spec e ON e.signal_id = r.signal_id AND e.bin = r.bin AND e.frame = r.frame + 1)
    SELECT signal_id, frame, bin, round(re / sqrt(s), 6) + 0.0 AS re, round(im / sqrt(s), 6) + 0.0 AS im FROM r""",
)
def unit_norm(t: Tables):
    return bin_output(K.unit_norm(spec_bins(t), count=33), "re", "im")


# The canceller frame by frame, with plain numbers: w is the filter before a frame.
CANCEL_SQL = (
    sql(SPEC).replace("WITH ", "WITH RECURSIVE ")
    + """, pair AS (SELECT a.signal_id, a.frame, a.bin, a.re AS yr, a.im AS yi, 0.8::DOUBLE * a.re AS sr, 0.8::DOUBLE * a.im AS si,
      CASE WHEN a.frame % 11 = 0 THEN 0 ELSE n.im END AS xr, CASE WHEN a.frame % 11 = 0 THEN 0 ELSE n.re END AS xi,
      least(abs(a.re) * 100, 1) AS mask, a.frame % 13 = 5 AS frozen, a.frame % 17 = 3 AS clipped
      FROM spec a JOIN spec n ON n.signal_id = a.signal_id AND n.frame = a.frame AND n.bin = a.bin + 1),
    marked AS (SELECT *, avg(xr * xr + xi * xi) OVER (PARTITION BY signal_id, frame) < 1e-12 AS dead,
      coalesce(lag(mask) OVER (PARTITION BY signal_id, bin ORDER BY frame), 1) < 0.3 AS open FROM pair),
    gains AS (SELECT *, clipped OR dead AS bypass, NOT (clipped OR dead) AND NOT frozen AND open AS learned,
      (sr * (yr + 1e-8) + si * yi) / (pow(yr + 1e-8, 2) + yi * yi) AS gr, (si * (yr + 1e-8) - sr * yi) / (pow(yr + 1e-8, 2) + yi * yi) AS gi FROM marked),
    capped AS (SELECT *, least(1, 1.5::DOUBLE / greatest(sqrt(gr * gr + gi * gi), 1e-30)) AS cap,
      CASE WHEN learned THEN 0.5::DOUBLE / (xr * xr + xi * xi + 1e-8) ELSE 0 END AS rate FROM gains),
    steps AS MATERIALIZED (SELECT signal_id, frame, bin, sr, si, bypass, clipped, dead, learned, (xr * gr - xi * gi) * cap AS rr, (xr * gi + xi * gr) * cap AS ri,
      1 - rate * (xr * xr + xi * xi) AS keep, rate * (xr * yr + xi * yi) AS ar, rate * (xr * yi - xi * yr) AS ai, sqrt(sr * sr + si * si) AS loud FROM capped),
    run AS (
      SELECT signal_id, bin, 0::BIGINT AS frame, 0::DOUBLE AS wr, 0::DOUBLE AS wi FROM steps WHERE frame = 0
      UNION ALL
      SELECT signal_id, bin, frame + 1, CASE WHEN bypass THEN wr WHEN worse THEN 0 ELSE keep * wr + ar END, CASE WHEN bypass THEN wi WHEN worse THEN 0 ELSE keep * wi + ai END
      FROM (SELECT *, loud > 1e-6 AND sqrt(er * er + ei * ei) > 1e-6 AND sqrt(pow(sr - er, 2) + pow(si - ei, 2)) > loud AS worse
        FROM (SELECT r.signal_id, r.bin, r.frame, r.wr, r.wi, s.* EXCLUDE (signal_id, frame, bin), r.wr * s.rr - r.wi * s.ri AS er, r.wr * s.ri + r.wi * s.rr AS ei
          FROM run r JOIN steps s ON s.signal_id = r.signal_id AND s.bin = r.bin AND s.frame = r.frame) g) h),
    told AS (SELECT *, NOT bypass AND NOT skip AND sqrt(pow(sr - er, 2) + pow(si - ei, 2)) > loud AS worse
      FROM (SELECT *, NOT bypass AND (loud <= 1e-6 OR sqrt(er * er + ei * ei) <= 1e-6) AS skip
        FROM (SELECT s.*, r.wr * s.rr - r.wi * s.ri AS er, r.wr * s.ri + r.wi * s.rr AS ei
          FROM run r JOIN steps s ON s.signal_id = r.signal_id AND s.bin = r.bin AND s.frame = r.frame) g) h),
    bins AS (SELECT *, CASE WHEN bypass OR skip OR worse THEN sr ELSE sr - er END AS zr, CASE WHEN bypass OR skip OR worse THEN si ELSE si - ei END AS zi FROM told),
    frames_done AS (SELECT signal_id, frame, sum(zr * zr + zi * zi) > sum(sr * sr + si * si) * (1 + 1e-12::DOUBLE) AS frame_guard, count(*) FILTER (WHERE worse) AS bin_guard,
      count(*) FILTER (WHERE skip) AS floor_skip, count(*) FILTER (WHERE learned) AS adapted, bool_or(clipped) AS by_clip, bool_or(dead AND NOT clipped) AS by_dead
      FROM bins GROUP BY signal_id, frame)
    """
)


def cancelled(t: Tables):
    half = F.lit(32)
    s = F.col("spec")
    heard = F.when(F.col("frame") % 11 == 0, 0.0).otherwise(1.0)
    frames = spec_frames(t).select(
        "signal_id", "frame",
        F.slice(s["re"], 1, half).alias("y_re"), F.slice(s["im"], 1, half).alias("y_im"),
        F.transform(F.slice(s["re"], 1, half), lambda v: v * 0.8).alias("s_re"),
        F.transform(F.slice(s["im"], 1, half), lambda v: v * 0.8).alias("s_im"),
        F.transform(F.slice(s["im"], 2, half), lambda v: v * heard).alias("x_re"),
        F.transform(F.slice(s["re"], 2, half), lambda v: v * heard).alias("x_im"),
        F.transform(F.slice(s["re"], 1, half), lambda v: F.least(F.abs(v) * 100, F.lit(1.0))).alias("mask"),
        (F.col("frame") % 13 == 5).alias("impulse"), F.lit(False).alias("impulse_tail"), (F.col("frame") % 17 == 3).alias("ref_clipped"),
    )
    return K.nlms_cancel(frames)


@query(
    "stf4_nlms_cancel",
    CANCEL_SQL
    + "SELECT signal_id, frame, bin, round(CASE WHEN frame_guard THEN sr ELSE zr END, 6) + 0.0 AS z_re, round(CASE WHEN frame_guard THEN si ELSE zi END, 6) + 0.0 AS z_im, bin_guard, adapted "
    "FROM bins JOIN frames_done USING (signal_id, frame)",
)
def nlms_cancel(t: Tables):
    rows = cancelled(t).select("signal_id", "frame", F.posexplode(F.arrays_zip("z_re", "z_im")).alias("bin", "z"), "bin_guard", "adapted")
    rows = rows.withColumn("bin", F.col("bin").cast("bigint"))
    return rows.select("signal_id", "frame", "bin", *[rounded(F.col("z")[n]).alias(n) for n in ("z_re", "z_im")], "bin_guard", "adapted")


@query(
    "agg23_canceller_telemetry",
    CANCEL_SQL
    + """SELECT signal_id, count(*) AS frames, CAST(sum(bin_guard) AS BIGINT) AS bin_guard, count(*) FILTER (WHERE frame_guard) AS frame_guard, count(*) FILTER (WHERE by_clip OR by_dead) AS ref_bypass,
    count(*) FILTER (WHERE by_clip) AS ref_bypass_clipped, count(*) FILTER (WHERE by_dead) AS ref_bypass_dead, CAST(sum(floor_skip) AS BIGINT) AS low_y_skip_bins, CAST(sum(adapted) AS BIGINT) AS adaptation_bins
    FROM frames_done GROUP BY signal_id""",
)
def canceller_telemetry(t: Tables):
    return K.canceller_telemetry(cancelled(t))
