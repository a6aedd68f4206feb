"""Operators on sample tables (signal_id, t, block, values).

``t`` counts samples from 0; ``block`` is ``t`` divided by a block length. Rows of one signal are spread over its
blocks everywhere. Filters and correlations get their neighbourhood through a halo: each sample is also copied into the
few blocks whose outputs need it, so one task works on one block plus its halo, whatever the length of the signal.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.functions import metrics as M
from wavelake.functions.scalars import db_to_amplitude, fade_gain, pcm_decode, pcm_encode
from wavelake.operators.filters import forward_backward
from wavelake.operators.matching import to_buckets
from wavelake.operators.rules import clip_gain
from wavelake.plans.batches import plain
from wavelake.plans.draws import unit
from wavelake.plans.ordered import (
    BLOCK,
    attach,
    block_of,
    block_totals,
    exact_percentile,
    join_on,
    merge_intervals,
    packed_groups,
    spread_groups,
    true_runs,
    with_block,
)
from wavelake.session import settled

SIGNAL = ["signal_id"]
EPS = 1e-12


# Layout ---------------------------------------------------------------------------------------------------------


def samples_from_blocks(blocks: DataFrame) -> DataFrame:
    """Stored blocks (signal_id, block, start, samples) to one row per sample."""
    rows = blocks.select("signal_id", "block", "start", F.posexplode("samples").alias("_i", "x"))
    return rows.select("signal_id", (F.col("start") + F.col("_i")).alias("t"), "block", F.col("x").cast("double").alias("x"))


def blocks_from_samples(samples: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per (signal, block) with its samples as an array; an array holds at most ``size`` samples."""
    rows = with_block(samples, "t", size)
    ordered = F.array_sort(F.collect_list(F.struct("t", F.col("x").cast("float").alias("x"))))
    packed = rows.groupBy("signal_id", "block").agg(F.min("t").alias("start"), ordered.alias("_s"))
    return packed.select("signal_id", "block", "start", F.transform("_s", lambda s: s["x"]).alias("samples"))


def with_halo(df: DataFrame, before: int, after: int, size: int, position: str = "t") -> DataFrame:
    """Copies every row into all blocks whose outputs need it and marks the rows of the block itself as ``own``.

    Outputs of a block need ``before`` positions to its left and ``after`` to its right.
    """
    at = F.col(position)
    first = F.greatest(F.floor((at - after) / size), F.lit(0))
    last = F.floor((at + before) / size)
    rows = df.drop("block").withColumn("block", F.explode(F.sequence(first, last)))
    return rows.withColumn("own", F.col("block") == F.floor(at / size))


def per_block(df: DataFrame, keys: Sequence[str], function, output: str) -> DataFrame:
    """Runs a NumPy function on every (keys, block) group of a haloed table. Groups have a fixed maximum size.

    ``function(block, own, rows)`` gets the columns as arrays, in one order that is not fixed, and returns a dict of
    arrays named like the columns of ``output`` without keys. Groups are rows of batches, so short ones cost no call each.
    """
    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(output).fields)
    names = [f.name for f in T.StructType.fromDDL(output).fields]
    values = [c for c in df.columns if c not in (*keys, "block")]

    def frame(heads: list[tuple], results: list[dict]) -> pd.DataFrame:
        sizes = [len(r[names[0]]) for r in results]
        columns = {}
        for i, k in enumerate(keys):
            columns[k] = pd.Series(np.repeat(np.array([*(h[i] for h in heads), None], dtype=object)[:-1], sizes), dtype=object)
        return plain(pd.DataFrame({**columns, **{n: np.concatenate([r[n] for r in results]) for n in names}}))

    def run(batches):
        for batch in batches:
            heads, results, size = [], [], 0
            columns = [batch[c] for c in (*keys, "block", *values)]
            for row in zip(*columns):
                rows = dict(zip(values, row[len(keys) + 1 :]))
                own = rows["own"] = np.asarray(rows["own"], dtype=bool)
                if not own.any():
                    continue
                heads.append(tuple(None if v is None or v != v else v for v in row[: len(keys)]))
                results.append(function(int(row[len(keys)]), own, rows))
                size += len(results[-1][names[0]])
                if size >= BLOCK:
                    yield frame(heads, results)
                    heads, results, size = [], [], 0
            if results:
                yield frame(heads, results)

    return packed_groups(df, [*keys, "block"], values).mapInPandas(run, schema)


def _dense(t: np.ndarray, values: np.ndarray, first: int, length: int) -> np.ndarray:
    """Values at positions ``first`` .. ``first + length - 1``, zeros where there is no sample."""
    field = np.zeros(length)
    field[t - first] = values
    return field


def _fast_length(n: int) -> int:
    return 1 << max(n - 1, 1).bit_length()


def slice_signal(samples: DataFrame, start: int, stop: int, size: int = BLOCK) -> DataFrame:
    """Samples of the half-open range. The block filter comes first, so stored blocks outside it are never read."""
    first, last = start // size, (stop - 1) // size
    return samples.where(F.col("block").between(first, last) & (F.col("t") >= start) & (F.col("t") < stop))


def short_reads(sliced: DataFrame, start: int, stop: int, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """Signals that do not fill the requested range."""
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
    return counts.where(F.col("got") != stop - start)


def downmix(channels: DataFrame, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """Channel mean per sample."""
    return channels.groupBy(*keys, "t").agg(F.avg("x").alias("x"))


# Filters --------------------------------------------------------------------------------------------------------


def zero_phase_taps(low_hz: float | None, high_hz: float | None, rate: int, order: int = 4, half: int = 8192) -> np.ndarray:
    """Symmetric taps of a Butterworth filter run forward and backward: its squared magnitude, back in time.

    ``low_hz`` alone is a high-pass, ``high_hz`` alone a low-pass, both a band-pass. ``half`` taps lie on each side.
    """
    n = 1 << (2 * half + 1).bit_length()
    warped = np.tan(np.pi * np.arange(n // 2 + 1) / n)
    edge = lambda hz: np.tan(np.pi * hz / rate)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if low_hz and high_hz:
            a, b = edge(low_hz), edge(high_hz)
            ratio = (warped**2 - a * b) / ((b - a) * warped)
        elif low_hz:
            ratio = edge(low_hz) / warped
        else:
            ratio = warped / edge(high_hz)
        response = 1.0 / (1.0 + ratio ** (2 * order))
    response = np.nan_to_num(response, nan=0.0)
    kernel = np.fft.irfft(response, n)
    return np.concatenate([kernel[-half:], kernel[: half + 1]])


def zero_phase_filter(
    samples: DataFrame, taps: np.ndarray, column: str = "x", keys: Sequence[str] = SIGNAL, size: int = BLOCK
) -> DataFrame:
    """Symmetric FIR; outside the signal there are zeros. One FFT product per block with its halo."""
    half = (len(taps) - 1) // 2

    def run(block, own, rows):
        t, x = rows["t"], np.asarray(rows[column], dtype=np.float64)
        mine = np.sort(t[own])
        first, length = int(mine[0]) - half, int(mine[-1] - mine[0]) + 1 + 2 * half
        near = (t >= first) & (t < first + length)
        n = _fast_length(length + 2 * half)
        product = np.fft.rfft(_dense(t[near], x[near], first, length), n) * np.fft.rfft(taps, n)
        y = np.fft.irfft(product, n)[2 * half :]
        return {"t": mine, "block": np.full(len(mine), block), column: y[mine - mine[0]]}

    haloed = with_halo(samples.select(*keys, "t", column), half, half, size)
    return per_block(haloed, keys, run, f"t BIGINT, block BIGINT, {column} DOUBLE")


def resample_taps(up: int, down: int) -> np.ndarray:
    """Low-pass taps of the polyphase resampler: a Kaiser window with beta 5 and ten lobes per side."""
    top = max(up, down)
    half = 10 * top
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / top) / top * np.kaiser(2 * half + 1, 5.0)
    return taps / taps.sum() * up


def resample(
    samples: DataFrame, up: int, down: int, column: str = "x", keys: Sequence[str] = SIGNAL, size: int = BLOCK
) -> DataFrame:
    """Rational-rate polyphase resampling. Each block makes the outputs that fall on its own input samples.

    A signal of n samples gives the ceiling of n * up / down samples.
    """
    common = gcd(up, down)
    up, down = up // common, down // common
    taps = resample_taps(up, down)
    half = (len(taps) - 1) // 2
    reach = ceil(half / up) + 1
    per_side = half // up + 1

    def run(block, own, rows):
        t, x = rows["t"], np.asarray(rows[column], dtype=np.float64)
        base, end = int(t.min()), int(t[own].max()) + 1
        field = _dense(t, x, base, int(t.max()) - base + 1)
        out = np.arange(-(-block * size * up // down), -(-end * up // down), dtype=np.int64)
        centre = out * down // up
        total = np.zeros(len(out))
        for shift in range(-per_side, per_side + 1):
            source = centre + shift
            tap = out * down - source * up + half
            inside = (tap >= 0) & (tap < len(taps)) & (source - base >= 0) & (source - base < len(field))
            total[inside] += field[source[inside] - base] * taps[tap[inside]]
        return {"t": out, column: total}

    haloed = with_halo(samples.select(*keys, "t", column), reach, reach, size)
    return with_block(per_block(haloed, keys, run, f"t BIGINT, {column} DOUBLE"), "t", size)


# Levels ---------------------------------------------------------------------------------------------------------


def remove_dc(samples: DataFrame, keys: Sequence[str] = SIGNAL) -> DataFrame:
    rows = block_totals(samples, keys, {"_sum": F.col("x")})
    return rows.withColumn("x", F.col("x") - F.col("_sum") / F.col("_n")).drop("_sum", "_n")


def peak_limit(samples: DataFrame, limit: float = 0.99, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """Scales to the limit only where the peak is above it."""
    rows = block_totals(samples, keys, maxima={"_peak": F.abs("x")})
    return rows.withColumn("x", F.col("x") * clip_gain(F.col("_peak") + F.lit(EPS), limit)).drop("_peak", "_n")


def rms_normalize(samples: DataFrame, target_dbfs: float = -26.0, limit: float = 0.99, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """Gain to a target RMS level, then a peak limit; both gains come from one pass over the signal."""
    rows = block_totals(samples, keys, {"_power": F.col("x") * F.col("x")}, {"_peak": F.abs("x")})
    gain = F.lit(10 ** (target_dbfs / 20)) / (F.sqrt(F.col("_power") / F.col("_n")) + F.lit(EPS))
    top = F.col("_peak") * gain + F.lit(EPS)
    gain = F.when(top > limit, gain * (F.lit(limit) / top)).otherwise(gain)
    return rows.withColumn("x", F.col("x") * gain).drop("_power", "_peak", "_n")


def rms_normalize_reversible(
    samples: DataFrame,
    target_dbfs: float = -25.0,
    max_gain_db: float = 30.0,
    silent_dbfs: float = -80.0,
    limit: float = 0.98,
    keys: Sequence[str] = SIGNAL,
) -> DataFrame:
    """Level change that keeps its ``gain`` for `undo_gain`; silent signals are left alone and marked ``silent``."""
    rows = block_totals(samples, keys, {"_power": F.col("x") * F.col("x")}, {"_peak": F.abs("x")})
    rows = rows.withColumn("_level", M.to_dbfs(F.sqrt(F.col("_power") / F.col("_n"))))
    silent = F.col("_level") <= silent_dbfs
    wanted = F.greatest(F.least(F.lit(target_dbfs) - F.col("_level"), F.lit(max_gain_db)), F.lit(-max_gain_db))
    gain = F.least(db_to_amplitude(wanted), F.lit(limit) / (F.col("_peak") + F.lit(EPS)))
    rows = rows.withColumn("silent", silent).withColumn("gain", F.when(silent, F.lit(1.0)).otherwise(gain))
    return rows.withColumn("x", F.col("x") * F.col("gain")).drop("_level", "_power", "_peak", "_n")


def undo_gain(samples: DataFrame) -> DataFrame:
    return samples.withColumn("x", F.col("x") / F.col("gain"))


def blend(enhanced: DataFrame, dry: DataFrame, wet: float, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """Weighted sum of two signals, cut to the shorter one."""
    other = dry.select(*keys, "t", F.col("x").alias("_dry"))
    joined = enhanced.join(other, [*keys, "t"])
    return joined.withColumn("x", F.lit(wet) * F.col("x") + F.lit(1.0 - wet) * F.col("_dry")).drop("_dry")


# Activity -------------------------------------------------------------------------------------------------------


def frame_energies(samples: DataFrame, length: int, hop: int, keys: Sequence[str] = SIGNAL, column: str = "x") -> DataFrame:
    """Mean square of every full frame, and of one short frame for a signal shorter than a frame.

    Samples first collapse into chunks of the greatest common divisor of length and hop; only chunk sums reach the
    frames, so the shuffle after the first aggregate carries one row per chunk, not one per sample.
    """
    unit_size = gcd(length, hop)
    value = F.col(column)
    chunks = samples.groupBy(*keys, F.floor(F.col("t") / unit_size).alias("_chunk")).agg(
        F.sum(value * value).alias("_energy"), F.count(F.lit(1)).alias("_n")
    )
    per_frame, per_hop = length // unit_size, hop // unit_size
    first = F.greatest(F.floor((F.col("_chunk") - per_frame) / per_hop) + 1, F.lit(0))
    spread = chunks.withColumn("frame", F.explode(F.sequence(first, F.floor(F.col("_chunk") / per_hop))))
    frames = spread.groupBy(*keys, "frame").agg(F.sum("_energy").alias("_energy"), F.sum("_n").alias("samples"))
    frames = frames.where((F.col("samples") == length) | ((F.col("frame") == 0) & (F.col("samples") < length)))
    return frames.select(*keys, "frame", "samples", (F.col("_energy") / F.col("samples")).alias("energy"))


def detect_active_regions(
    samples: DataFrame,
    frame: int = 1200,
    hop: int = 480,
    below_p95: float = 25.0,
    floor_dbfs: float = -70.0,
    min_gap: int = 9600,
    min_region: int = 4800,
    keys: Sequence[str] = SIGNAL,
    size: int = BLOCK,
) -> DataFrame:
    """Active regions of every signal as half-open sample ranges.

    A frame is active above the larger of (95th percentile of frame levels - below_p95) and an absolute floor. Runs of
    active frames become regions; regions closer than ``min_gap`` merge; short ones are dropped.
    """
    # A frame table has one row per hop; it is read several times below.
    frames = settled(frame_energies(samples, frame, hop, keys))
    frames = frames.withColumn("db", F.lit(10.0) * F.log10(F.col("energy") + F.lit(1e-24)))
    p95 = exact_percentile(frames, keys, "db", 0.95, "_p95")
    threshold = p95.withColumn("_threshold", F.greatest(F.col("_p95") - below_p95, F.lit(floor_dbfs))).drop("_p95")
    marked = attach(with_block(frames, "frame", size), threshold, keys).withColumn("_on", F.col("db") > F.col("_threshold"))
    runs = true_runs(marked, keys, "frame", "_on")
    lengths = frames.groupBy(*keys).agg(F.max(F.when(F.col("frame") == 0, F.col("samples"))).alias("_first"))
    # Only full frames exist beyond the first one, so a run ends where its last frame ends.
    joined = attach(runs.withColumn("block", block_of(F.col("start_sample"), size)), lengths, keys)
    end = (F.col("end_sample") - 1) * hop + F.least(F.lit(frame), F.col("_first"))
    regions = joined.select(*keys, (F.col("start_sample") * hop).alias("start_sample"), end.alias("end_sample"))
    return merge_intervals(regions, keys, min_gap, min_region)


def active_fraction(masked: DataFrame, keys: Sequence[str] = SIGNAL) -> DataFrame:
    return masked.groupBy(*keys).agg(F.round(F.avg(F.col("mask").cast("int")), 4).alias("active_fraction"))


def hop_clip_flags(samples: DataFrame, hop: int = 480, level: float = 0.999, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """Per hop: whether any sample is at full scale."""
    return samples.groupBy(*keys, F.floor(F.col("t") / hop).alias("hop")).agg((M.peak("x") >= level).alias("clipped"))


# Mixing ---------------------------------------------------------------------------------------------------------


def overlay_sum(placed: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Sum of placed segments on the timeline of each sample."""
    return placed.groupBy(*keys, "t").agg(F.sum(F.col("x") * F.col("gain")).alias("x"))


def composite_noise(
    placed: DataFrame, min_rms: float = 1e-6, keys: Sequence[str] = ("sample_id",), size: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Overlays the picks of each sample: fade events, bring each pick to unit RMS, apply its relative gain, add.

    ``placed`` has (keys, pick, t, x, event_index, event_length, fade, relative_gain_db). Returns the composite
    (keys, t, x) and one row per pick with its RMS and whether it is (near) silent.
    """
    faded = F.col("x") * fade_gain(F.col("event_index"), F.col("event_length"), F.col("fade"))
    # Read once for the level of each pick and once for the sum.
    rows = settled(with_block(placed.withColumn("x", faded), "t", size))
    picks = rows.groupBy(*keys, "pick").agg(M.rms("x").alias("normalization_rms"))
    picks = picks.withColumn("silent", F.col("normalization_rms") < min_rms)
    rows = attach(rows, picks.where(~F.col("silent")), [*keys, "pick"])
    gain = db_to_amplitude(F.col("relative_gain_db")) / F.col("normalization_rms")
    return overlay_sum(rows.withColumn("gain", gain), keys), picks


def mix_at_snr(rows: DataFrame, target: Column, limit: float = 0.99, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """Mixes ``clean`` and ``noise`` at a target SNR over the samples with a true ``mask``.

    One gain on both outputs keeps the mixture peak at the limit. Adds noise_scale, output_gain, peak, clean_out and
    noisy_out; signals without clean or noise power in the mask are left out (see `power_guards` for the reason rows).
    """
    clean, noise, mask = F.col("clean"), F.col("noise"), F.col("mask")
    rows = block_totals(
        rows,
        keys,
        {
            "_pc": F.when(mask, clean * clean),
            "_pn": F.when(mask, noise * noise),
            "_active": F.when(mask, F.lit(1)).otherwise(F.lit(0)),
        },
    )
    pc, pn = F.col("_pc") / F.col("_active"), F.col("_pn") / F.col("_active")
    scale = F.sqrt(pc / (pn * F.pow(F.lit(10.0), target / 10)))
    audible = rows.where((F.col("_active") > 0) & (pc >= EPS) & (pn >= EPS)).withColumn("noise_scale", scale)
    mixed = audible.withColumn("_mix", clean + noise * F.col("noise_scale")).drop("_pc", "_pn", "_active", "_n")
    mixed = block_totals(settled(mixed), keys, maxima={"peak": F.abs("_mix")}).drop("_n")
    mixed = mixed.withColumn("output_gain", clip_gain(F.col("peak"), limit))
    return (
        mixed.withColumn("clean_out", clean * F.col("output_gain"))
        .withColumn("noisy_out", F.col("_mix") * F.col("output_gain"))
        .drop("_mix")
    )


def measured_snr(rows: DataFrame, subtype: str = "PCM_16", keys: Sequence[str] = SIGNAL) -> DataFrame:
    """SNR over the mask after encoding and decoding both outputs; the peak of the decoded mixture; rejections."""
    decoded = rows.withColumn("_c", pcm_decode(pcm_encode(F.col("clean_out"), subtype), subtype)).withColumn(
        "_n", pcm_decode(pcm_encode(F.col("noisy_out"), subtype), subtype)
    )
    c, r, mask = F.col("_c"), F.col("_n") - F.col("_c"), F.col("mask")
    stats = decoded.groupBy(*keys).agg(
        F.avg(F.when(mask, c * c)).alias("_pc"), F.avg(F.when(mask, r * r)).alias("_pr"), M.peak("_n").alias("peak_amplitude")
    )
    reason = F.when(F.col("peak_amplitude") >= 1.0, "clipping detected in written file").when(
        (F.col("_pc") < EPS) | (F.col("_pr") < EPS), "degenerate measured power"
    )
    snr = F.when(reason.isNull(), F.lit(10.0) * F.log10(F.col("_pc") / F.col("_pr")))
    return stats.select(*keys, snr.alias("measured_snr_db"), "peak_amplitude", reason.alias("rejection"))


def remix(pairs: DataFrame, draw: Column, low: float, high: float, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """New mixtures clean + g * (noisy - clean) at a drawn SNR, peak-safe on both; silent pairs stay as they are.

    The draw is per signal. Which batches are remixed is up to the caller (a draw per batch against a probability).
    """
    clean, noise = F.col("clean"), F.col("noisy") - F.col("clean")
    rows = block_totals(pairs, keys, {"_clean": clean * clean, "_noise": noise * noise})
    ps, pn = F.col("_clean") / F.col("_n"), F.col("_noise") / F.col("_n")
    silent = (ps < 1e-10) | (pn < 1e-12)
    snr = F.lit(low) + F.lit(high - low) * unit(draw)
    g = F.when(silent, F.lit(1.0)).otherwise(F.sqrt(ps / (pn * F.pow(F.lit(10.0), snr / 10))))
    rows = rows.withColumn("_silent", silent).withColumn("noisy", clean + g * noise).drop("_clean", "_noise", "_n")
    rows = block_totals(settled(rows), keys, maxima={"_peak": F.abs("noisy")})
    scale = F.when(F.col("_silent"), F.lit(1.0)).otherwise(clip_gain(F.col("_peak"), 0.99))
    return rows.withColumn("clean", clean * scale).withColumn("noisy", F.col("noisy") * scale).drop("_silent", "_peak", "_n")


def reconstruct_difference(rebuilt: DataFrame, stored: DataFrame, subtype: str, keys: Sequence[str]) -> DataFrame:
    """Largest absolute difference in integer steps between rebuilt signals and stored codes, per sample.

    Both sides have (keys, t, clean, noisy): floats on the rebuilt side, codes on the stored side.
    """
    codes = rebuilt.select(*keys, "t", *[pcm_encode(F.col(c), subtype).cast("bigint").alias(f"_{c}") for c in ("clean", "noisy")])
    joined = codes.join(stored, [*keys, "t"], "full_outer")
    gap = {c: F.max(F.abs(F.col(f"_{c}") - F.col(c).cast("bigint"))).alias(f"{c}_difference") for c in ("clean", "noisy")}
    one_sided = F.count_if(F.col("_clean").isNull() | F.col("clean").isNull())
    result = joined.groupBy(*keys).agg(*gap.values(), one_sided.alias("unmatched"))
    ok = (F.col("clean_difference") <= 1) & (F.col("noisy_difference") <= 1) & (F.col("unmatched") == 0)
    return result.withColumn("reproduced", ok)


# Alignment ------------------------------------------------------------------------------------------------------


def apply_delay(samples: DataFrame, lags: DataFrame, keys: Sequence[str] = SIGNAL, size: int = BLOCK) -> DataFrame:
    """A positive lag drops the head of the signal; a negative one puts zeros in front."""
    lag = F.col("lag")
    rows = attach(samples, lags, keys)
    moved = rows.where(F.col("t") >= lag).select(*keys, (F.col("t") - lag).alias("t"), "x")
    zeros = lags.where(lag < 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), -lag - 1)).alias("t"), F.lit(0.0).alias("x"))
    return with_block(moved.unionByName(zeros), "t", size)


def cross_correlation(
    pairs: DataFrame, max_lag: int, ref: str, other: str, keys: Sequence[str] = SIGNAL, size: int = BLOCK
) -> DataFrame:
    """Correlation at every lag within +-max_lag: (keys, lag, correlation). Each block gives partial sums by FFT."""
    def run(block, own, rows):
        t = rows["t"]
        mine = t[own]
        first, length = int(mine.min()), int(mine.max() - mine.min()) + 1
        left = _dense(mine, np.asarray(rows[ref], dtype=np.float64)[own], first, length)
        near = (t >= first - max_lag) & (t < first + length + max_lag)
        right = _dense(t[near], np.asarray(rows[other], dtype=np.float64)[near], first - max_lag, length + 2 * max_lag)
        n = _fast_length(len(left) + len(right))
        full = np.fft.irfft(np.fft.rfft(right, n) * np.conj(np.fft.rfft(left, n)), n)
        return {"lag": np.arange(-max_lag, max_lag + 1), "part": full[: 2 * max_lag + 1]}

    haloed = with_halo(pairs.select(*keys, "t", ref, other), max_lag, max_lag, size)
    parts = per_block(haloed, keys, run, "lag BIGINT, part DOUBLE")
    return parts.groupBy(*keys, "lag").agg(F.sum("part").alias("correlation"))


def best_lag(
    pairs: DataFrame,
    max_lag: int = 2400,
    ref: str = "clean",
    other: str = "noisy",
    keys: Sequence[str] = SIGNAL,
    size: int = BLOCK,
) -> DataFrame:
    """Lag with the largest absolute correlation over the whole signal, the smallest such lag on ties."""
    table = cross_correlation(pairs, max_lag, ref, other, keys, size)
    top = F.max(F.struct(F.abs("correlation").alias("size"), (-F.col("lag")).alias("minus_lag"))).alias("_top")
    return table.groupBy(*keys).agg(top).select(*keys, (-F.col("_top.minus_lag")).alias("lag"))


def _whiten(ref: np.ndarray, other: np.ndarray) -> np.ndarray:
    cross = other * np.conj(ref)
    return cross / (np.abs(cross) + 1e-12)


def phat_lag(
    pairs: DataFrame,
    max_shift: int,
    ref: str = "clean",
    other: str = "noisy",
    keys: Sequence[str] = SIGNAL,
    size: int = BLOCK,
    whole_bits: int = 16,
) -> DataFrame:
    """Lag of ``other`` against ``ref`` by the phase transform, within +-max_shift; the smallest lag on ties.

    The transform needs the spectrum of the whole signal. Signals of up to 2 ** ``whole_bits`` points are one row each, and
    the rows of a batch are transformed together. Of a longer one the FFT is split over the cluster: N = N1 * N2 points as
    N2 transforms of N1 points, a twiddle, and N1 transforms of N2 points, with a shuffle in between, so no row exceeds
    about the root of N. The rows of a step are as many as there are signals or roots, never one task call for each.
    """
    r, d = F.col(ref), F.col(other)
    bits = F.ceil(F.log2(F.greatest(F.lit(2) * F.col("_n") - 1, F.lit(1)).cast("double"))).cast("int")
    rows = pairs.select(*keys, "t", "block", r.cast("double").alias("_r"), d.cast("double").alias("_d"))
    rows = block_totals(rows, keys, {"_sr": F.col("_r"), "_sd": F.col("_d")}).withColumn("_bits", bits)
    rows = rows.withColumn("_r", F.col("_r") - F.col("_sr") / F.col("_n")).withColumn("_d", F.col("_d") - F.col("_sd") / F.col("_n"))
    # N1 points per first transform, N2 per second one; t = N2 * n1 + n2. A short signal has N2 = 1.
    short = F.col("_bits") <= whole_bits
    bits2 = F.when(short, 0).otherwise(F.col("_bits") - F.ceil(F.col("_bits") / 2)).cast("int")
    n2_count = F.pow(F.lit(2.0), bits2).cast("bigint")
    rows = rows.select(
        *keys, "_bits", F.floor(F.col("t") / n2_count).cast("bigint").alias("_n1"), (F.col("t") % n2_count).alias("_n2"), "_r", "_d"
    )
    packed = settled(packed_groups(rows, [*keys, "_bits", "_n2"], ["_n1", "_r", "_d"]))
    key_fields = [pairs.schema[k] for k in keys]

    def best(batches):
        for batch in batches:
            for total, part in batch.groupby("_bits"):
                n = 1 << int(total)
                reach = min(max_shift, n // 2)
                lags = np.arange(-reach, reach + 1)
                step = max(1, (1 << 20) // n)
                for i in range(0, len(part), step):
                    some = part.iloc[i : i + step]
                    at = np.repeat(np.arange(len(some)), [len(x) for x in some["_n1"]]), np.concatenate(list(some["_n1"]))
                    a, b = np.zeros((len(some), n)), np.zeros((len(some), n))
                    a[at], b[at] = np.concatenate(list(some["_r"])), np.concatenate(list(some["_d"]))
                    back = np.fft.ifft(_whiten(np.fft.fft(a), np.fft.fft(b))).real
                    found = lags[np.argmax(back[:, lags % n], axis=1)]
                    yield plain(some[list(keys)].assign(lag=found))

    def first(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                total, n2 = int(row["_bits"]), int(row["_n2"])
                n, n1 = 1 << total, 1 << ((total + 1) // 2)
                a, b = np.zeros(n1), np.zeros(n1)
                a[row["_n1"]], b[row["_n1"]] = row["_r"], row["_d"]
                k1 = np.arange(n1)
                twiddle = np.exp(-2j * np.pi * n2 * k1 / n)
                fa, fb = np.fft.fft(a) * twiddle, np.fft.fft(b) * twiddle
                head = {k: [row[k]] * n1 for k in keys}
                parts = {"ar": fa.real, "ai": fa.imag, "br": fb.real, "bi": fb.imag}
                yield plain(pd.DataFrame({**head, "_bits": total, "_k1": k1, "_n2": n2, **parts}))

    middle = T.StructType(
        [*key_fields, *T.StructType.fromDDL("_bits INT, _k1 BIGINT, _n2 BIGINT, ar DOUBLE, ai DOUBLE, br DOUBLE, bi DOUBLE").fields]
    )

    def second(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                total, k1 = int(row["_bits"]), int(row["_k1"])
                n, n2 = 1 << total, 1 << (total - (total + 1) // 2)
                a, b = np.zeros(n2, dtype=complex), np.zeros(n2, dtype=complex)
                a[row["_n2"]] = row["ar"] + 1j * row["ai"]
                b[row["_n2"]] = row["br"] + 1j * row["bi"]
                back = np.fft.ifft(_whiten(np.fft.fft(a), np.fft.fft(b)))
                reach = min(max_shift, n // 2)
                lags = np.arange(-reach, reach + 1)
                part = (back[lags % n2] * np.exp(2j * np.pi * k1 * lags / n)).real
                yield plain(pd.DataFrame({**{k: [row[k]] * len(lags) for k in keys}, "lag": lags, "part": part}))

    lag = T.StructField("lag", T.LongType())
    whole = packed.where(short).mapInPandas(best, T.StructType([*key_fields, lag]))
    staged = packed.where(~short).mapInPandas(first, middle)
    staged = packed_groups(staged, [*keys, "_bits", "_k1"], ["_n2", "ar", "ai", "br", "bi"])
    parts = staged.mapInPandas(second, T.StructType([*key_fields, lag, T.StructField("part", T.DoubleType())]))
    table = parts.groupBy(*keys, "lag").agg(F.sum("part").alias("value"))
    top = F.max(F.struct("value", (-F.col("lag")).alias("minus_lag"))).alias("_top")
    split = table.groupBy(*keys).agg(top).select(*keys, (-F.col("_top.minus_lag")).alias("lag"))
    return whole.unionByName(split)


def align_and_gain_match(
    clean: DataFrame, estimate: DataFrame, max_shift: int, method: str = "phat", keys: Sequence[str] = SIGNAL, size: int = BLOCK
) -> DataFrame:
    """Lag, gain, SNR and SI-SDR of an estimate against clean: shift, cut to the shorter, match the gain, measure.

    After the shift one pass of sums is enough: the metrics of the scaled estimate follow from them in closed form.
    """
    left = clean.select(*keys, "t", F.col("x").alias("clean"))
    right = estimate.select(*keys, "t", F.col("x").alias("est"))
    c, e = F.col("clean"), F.col("est")
    lags = None
    if method == "none":
        aligned = left.join(right, [*keys, "t"])
    else:
        # Both signals side by side, written once; the search, the shift and the sums all read this table.
        both = settled(with_block(left.join(right, [*keys, "t"], "full_outer"), "t", size))
        find = phat_lag if method == "phat" else best_lag
        common = both.where(c.isNotNull() & e.isNotNull())
        lags = settled(find(common, max_shift, ref="clean", other="est", keys=keys, size=size))
        shifted = apply_delay(both.where(e.isNotNull()).select(*keys, "t", "block", e.alias("x")), lags, keys, size)
        aligned = both.where(c.isNotNull()).select(*keys, "t", "clean").join(
            shifted.select(*keys, "t", F.col("x").alias("est")), [*keys, "t"]
        )
    sums = aligned.groupBy(*keys).agg(F.sum(c * c).alias("_cc"), F.sum(e * e).alias("_ee"), F.sum(c * e).alias("_ce"))
    cc, ee, ce, eps = F.col("_cc"), F.col("_ee"), F.col("_ce"), F.lit(EPS)
    gain = ce / (ee + eps)
    sums = sums.withColumn("gain", gain).withColumn("_se", F.col("gain") * F.col("gain") * ee).withColumn("_sc", F.col("gain") * ce)
    error = F.greatest(cc - 2 * F.col("_sc") + F.col("_se"), F.lit(0.0))
    scale = F.col("_sc") / (cc + eps)
    target = scale * scale * cc
    noise = F.greatest(F.col("_se") - 2 * scale * F.col("_sc") + target, F.lit(0.0))
    scored = sums.select(
        *keys,
        "gain",
        (F.lit(10.0) * F.log10(cc / (error + eps))).alias("snr"),
        (F.lit(10.0) * F.log10((target + eps) / (noise + eps))).alias("si_sdr"),
    )
    return scored if lags is None else lags.join(scored, list(keys))


# Segments -------------------------------------------------------------------------------------------------------


def crop_pad_pairs(
    pairs: DataFrame, starts: DataFrame, segment: int, values: Sequence[str], keys: Sequence[str] = SIGNAL, bucket: int = 4096
) -> DataFrame:
    """Fixed-length segments from one offset per (signal, item) for all value columns; zeros after a short signal.

    ``starts`` has (keys, item, start, length).
    """
    wanted = to_buckets(starts.withColumn("_end", F.col("start") + segment), "start", "_end", bucket)
    rows = pairs.withColumn("_bucket", F.floor(F.col("t") / bucket)).join(wanted, [*keys, "_bucket"])
    rows = rows.where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("_end")))
    found = rows.select(*keys, "item", (F.col("t") - F.col("start")).alias("t"), *values)
    missing = starts.where(F.col("length") - F.col("start") < segment)
    zeros = missing.select(
        *keys, "item", F.explode(F.sequence(F.col("length") - F.col("start"), F.lit(segment - 1).cast("bigint"))).alias("t"),
        *[F.lit(0.0).alias(v) for v in values],
    )
    return found.unionByName(zeros)


def crop_starts(lengths: DataFrame, draw: Column, segment: int) -> DataFrame:
    """Adds ``start``: a drawn offset for signals longer than the segment, else 0."""
    room = F.col("length") - segment
    return lengths.withColumn("start", F.when(room > 0, draw % (room + 1)).otherwise(F.lit(0)).cast("bigint"))


def batches(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per step with its items as a list ordered by position; a list holds one batch."""
    entry = F.array_sort(F.collect_list(F.struct("position", *columns)))
    return items.groupBy("step").agg(entry.alias("items"))


# Clipping repair ------------------------------------------------------------------------------------------------


def declip_runs(
    samples: DataFrame, min_run: int = 3, trigger: float = 5e-4, most: float = 0.05, keys: Sequence[str] = SIGNAL
) -> DataFrame:
    """Runs of samples at the clipping level of either polarity: (keys, sign, start_sample, end_sample, level).

    A polarity counts only with a peak of at least 1e-3 and two or more runs; a signal only when the clipped share of
    its samples lies between ``trigger`` and ``most``.
    """
    rows = samples.select(*keys, "t", "block", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), "x")
    rows = rows.withColumn("y", F.col("x") * F.col("sign"))
    rows = block_totals(rows, [*keys, "sign"], maxima={"level": F.col("y")})
    margin = F.greatest(F.col("level") * 1e-4, F.lit(1.5 / 32768))
    near = rows.withColumn("_near", (F.col("level") >= 1e-3) & (F.col("y") >= F.col("level") - margin))
    runs = settled(true_runs(near, [*keys, "sign"], "t", "_near", min_run))
    counts = runs.groupBy(*keys, "sign").agg(
        F.count(F.lit(1)).alias("_runs"), F.sum(F.col("end_sample") - F.col("start_sample")).alias("_clipped")
    )
    totals = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("x").alias("_up"), F.max(-F.col("x")).alias("_down"))
    valid = counts.where(F.col("_runs") >= 2)
    share = valid.groupBy(*keys).agg(F.sum("_clipped").alias("_clipped")).join(totals, list(keys))
    share = share.withColumn("clipped_share", F.col("_clipped") / F.col("_n"))
    share = share.where((F.col("clipped_share") >= trigger) & (F.col("clipped_share") <= most))
    kept = valid.select(*keys, "sign").join(share.select(*keys, "clipped_share", "_up", "_down"), list(keys))
    level = F.when(F.col("sign") == 1, F.col("_up")).otherwise(F.col("_down"))
    joined = runs.join(kept, [*keys, "sign"])
    return joined.select(*keys, "sign", "start_sample", "end_sample", level.alias("level"), "clipped_share")


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) with continuous third derivative at the second and last but one knot."""
    h, n = np.diff(x), len(x)
    slope = np.diff(y) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, right = at - x[i], x[i + 1] - at
    return (
        m[i] * right**3 / (6 * h[i])
        + m[i + 1] * left**3 / (6 * h[i])
        + (y[i] / h[i] - m[i] * h[i] / 6) * right
        + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * left
    )


@lru_cache(maxsize=4096)
def _bridge(length: int, context: int) -> np.ndarray:
    """The spline over a gap is linear in the samples around it: one row for each missing sample."""
    at = np.arange(length + 2 * context, dtype=float)
    outside = (at < context) | (at >= context + length)
    return np.array([_spline(at[outside], unit, at[~outside]) for unit in np.eye(2 * context)]).T


def repairable_runs(
    samples: DataFrame, max_run: int | None = 40, context: int = 8, keys: Sequence[str] = SIGNAL, **detection
) -> DataFrame:
    """The runs of `declip_runs` with ``left``: why a run is not repaired, null where it is.

    A run of more than ``max_run`` samples is left (none is, where that is null), and one whose context reaches over an
    end of the signal.
    """
    runs = settled(declip_runs(samples, keys=keys, **detection))
    ends = samples.groupBy(*keys).agg((F.max("t") + 1).alias("_length"))
    length = F.col("end_sample") - F.col("start_sample")
    long = F.lit(False) if max_run is None else length > max_run
    at_end = (F.col("start_sample") < context) | (F.col("end_sample") + context > F.col("_length"))
    left = F.when(long, F.lit("long run")).when(at_end, F.lit("at an end"))
    return join_on(runs, ends, keys).withColumn("left", left).drop("_length")


def declip(
    samples: DataFrame,
    max_run: int | None = 40,
    context: int = 8,
    overshoot: float = 1.3,
    keys: Sequence[str] = SIGNAL,
    bucket: int = 4096,
    **detection,
) -> DataFrame:
    """Repairs clipped runs by a cubic spline through the samples on both sides, held between the level and 1.3 times it.

    Only the ``2 * context`` samples around a run are gathered, whatever its length; all runs of a length in a batch are
    solved by one matrix product. `repairable_runs` tells which runs are left as they are.
    """
    runs = repairable_runs(samples, max_run, context, keys, **detection).where("left is null").drop("left")
    sides = F.array(
        F.struct((F.col("start_sample") - context).alias("from"), F.col("start_sample").alias("to")),
        F.struct(F.col("end_sample").alias("from"), (F.col("end_sample") + context).alias("to")),
    )
    wide = runs.select("*", F.explode(sides).alias("_side"))
    first, last = F.floor(F.col("_side.from") / bucket), F.floor((F.col("_side.to") - 1) / bucket)
    pieces = wide.withColumn("_bucket", F.explode(F.sequence(first, last)))
    near = samples.select(*keys, "t", "x", F.floor(F.col("t") / bucket).alias("_bucket"))
    inside = (F.col("t") >= F.col("_side.from")) & (F.col("t") < F.col("_side.to"))
    rows = pieces.join(near, [*keys, "_bucket"]).where(inside)
    packed = rows.groupBy(*keys, "sign", "start_sample", "end_sample", "level").agg(
        F.array_sort(F.collect_list(F.struct("t", F.col("x").cast("double").alias("x")))).alias("_s")
    )
    # A run next to missing samples is left alone.
    packed = packed.where(F.size("_s") == 2 * context)

    @F.pandas_udf("array<double>")
    def repair(values: pd.Series, size: pd.Series, sign: pd.Series, level: pd.Series) -> pd.Series:
        fixed = pd.Series([None] * len(size), dtype=object)
        for n in size.unique():
            at = np.flatnonzero(size == n)
            around = np.stack(values.iloc[at].to_numpy())
            s, top = sign.iloc[at].to_numpy()[:, None], level.iloc[at].to_numpy()[:, None]
            y = s * np.clip(s * (around @ _bridge(int(n), context).T), top, overshoot * top)
            for i, row in zip(at, y):
                fixed.iloc[i] = row
        return fixed

    values = F.transform("_s", lambda p: p["x"])
    length = (F.col("end_sample") - F.col("start_sample")).cast("int")
    runs_fixed = packed.select(*keys, "start_sample", F.posexplode(repair(values, length, "sign", "level")).alias("_i", "fixed"))
    fixed = runs_fixed.select(*keys, (F.col("start_sample") + F.col("_i")).alias("t"), "fixed")
    return samples.join(fixed, [*keys, "t"], "left").withColumn("x", F.coalesce("fixed", "x")).drop("fixed")


# Chain ----------------------------------------------------------------------------------------------------------


def clean_chain(
    samples: DataFrame,
    highpass: np.ndarray | None,
    bandlimit: np.ndarray | None,
    enhancer=None,
    wet: float = 1.0,
    dc: bool = True,
    normalize_before: bool = True,
    normalize_after: bool = False,
    target_dbfs: float = -26.0,
    keys: Sequence[str] = SIGNAL,
    size: int = BLOCK,
) -> DataFrame:
    """DC removal, high-pass, level, enhancer, dry/wet blend, band limit, optional level, peak limit; each step optional.

    ``enhancer`` maps a sample DataFrame to one of the same shape. A filter is given by its sections (`butterworth`), run
    forward and backward with the rule for the ends, or by symmetric taps with zeros outside the signal.
    """
    def filtered(part: DataFrame, how: np.ndarray) -> DataFrame:
        run = forward_backward if np.ndim(how) == 2 else zero_phase_filter
        return run(part, how, "x", keys, size)

    rows = remove_dc(samples, keys) if dc else samples
    if highpass is not None:
        # The filtered signal is read twice by the level step, so it is written once instead of filtered twice.
        rows = settled(filtered(rows, highpass))
    before = rms_normalize(rows, target_dbfs, keys=keys) if normalize_before else rows
    after = enhancer(before) if enhancer else before
    if wet < 1.0:
        after = blend(after, before, wet, keys)
    if bandlimit is not None:
        after = settled(filtered(after, bandlimit))
    if normalize_after:
        after = rms_normalize(after, target_dbfs, keys=keys)
    return peak_limit(after, keys=keys)
