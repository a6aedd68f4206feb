"""Operators on frames and bins: hops, spectra, bands, gains, expert fusion.

Frames are rows (signal_id, frame, x ARRAY<DOUBLE>); bins are rows (signal_id, frame, bin, re, im); an expert adds a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.plans.batches import plain
from wavelake.plans.ordered import BLOCK, attach, with_block
from wavelake.schema import FFT_SIZE, HOP_SIZE

FRAME = ["signal_id", "frame"]

# Widths of the 32 perceptual bands over 481 bins.
BAND_WIDTHS = [2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 5, 5, 7, 7, 8, 10, 12, 13, 15, 18, 20, 24, 28, 31, 37, 42, 50, 56, 67]


def band_of(bin_column: Column, widths: Sequence[int] = BAND_WIDTHS) -> Column:
    """Band of a bin, looked up in a literal array; no join is needed to map bins to bands."""
    bands = [band for band, width in enumerate(widths) for _ in range(width)]
    return F.get(F.array(*[F.lit(b) for b in bands]), bin_column.cast("int")).cast("bigint")


def band_width(band: Column, widths: Sequence[int] = BAND_WIDTHS) -> Column:
    return F.get(F.array(*[F.lit(w) for w in widths]), band.cast("int"))


def filterbank(bins: DataFrame, widths: Sequence[int] = BAND_WIDTHS) -> DataFrame:
    """Adds the band of each bin with its forward (mean) and inverse (copy) weight."""
    band = band_of(F.col("bin"), widths)
    return bins.withColumn("band", band).withColumn("forward", F.lit(1.0) / band_width(F.col("band"), widths)).withColumn(
        "inverse", F.lit(1.0)
    )


def analysis_window(i: Column, size: int = FFT_SIZE) -> Column:
    """Power-complementary window sin(pi/2 * sin^2(pi * (i + 0.5) / size))."""
    inner = F.sin(F.lit(np.pi) * (i + 0.5) / F.lit(float(size)))
    return F.sin(F.lit(np.pi / 2) * inner * inner)


def window_values(size: int = FFT_SIZE) -> np.ndarray:
    inner = np.sin(np.pi * (np.arange(size) + 0.5) / size)
    return np.sin(np.pi / 2 * inner * inner)


def spectrum_norm(size: int = FFT_SIZE, hop: int = HOP_SIZE) -> float:
    return 2.0 * hop / size**2


# Framing --------------------------------------------------------------------------------------------------------


def to_hops(samples: DataFrame, hop: int = HOP_SIZE, fft: int = FFT_SIZE, keys: Sequence[str] = ("signal_id",), size: int = BLOCK) -> DataFrame:
    """Signal to hops: zero-padded to a whole number of hops, then ``fft`` zeros so the synthesis tail has room.

    Adds ``length`` (samples of the signal) for `trim`. A hop holds ``hop`` samples, so its list is bounded.
    """
    rows = samples.withColumn("frame", F.floor(F.col("t") / hop))
    entry = F.map_from_entries(F.collect_list(F.struct((F.col("t") % hop).cast("int").alias("i"), F.col("x").cast("double").alias("x"))))
    packed = rows.groupBy(*keys, "frame").agg(entry.alias("_x"), F.max("t").alias("_last"))
    full = F.transform(F.sequence(F.lit(0), F.lit(hop - 1)), lambda i: F.coalesce(F.element_at(F.col("_x"), i), F.lit(0.0)))
    hops = packed.select(*keys, "frame", full.alias("x"))
    lengths = samples.groupBy(*keys).agg((F.max("t") + 1).alias("length"))
    first = F.ceil(F.col("length") / hop)
    tail = lengths.select(*keys, F.explode(F.sequence(first, first + fft // hop - 1)).alias("frame"), F.array_repeat(F.lit(0.0), hop).alias("x"))
    both = with_block(hops.unionByName(tail), "frame", size)
    return attach(both, lengths, keys)


def trim(samples: DataFrame, delay: int) -> DataFrame:
    """Drops the synthesis delay and everything behind the original length."""
    moved = samples.withColumn("t", F.col("t") - delay)
    return moved.where((F.col("t") >= 0) & (F.col("t") < F.col("length")))


SPECTRUM_TYPE = "struct<re: array<double>, im: array<double>>"


def spectrum(column: str = "x", window: np.ndarray | None = None, norm: float = 1.0) -> Column:
    """Windowed real DFT of a frame column; NumPy transforms a whole Arrow batch of frames at once."""

    @F.pandas_udf(SPECTRUM_TYPE)
    def transform(frames: pd.Series) -> pd.DataFrame:
        stacked = np.stack(frames.to_numpy()) if len(frames) else np.zeros((0, 2))
        spec = np.fft.rfft(stacked * window if window is not None else stacked, axis=1) * norm
        return pd.DataFrame({"re": list(spec.real), "im": list(spec.imag)})

    return transform(F.col(column))


def inverse_spectrum(column: str = "spec", window: np.ndarray | None = None, gain: float = 1.0) -> Column:
    """Inverse of `spectrum` (before overlap-add): real inverse DFT, times the window and a gain."""

    @F.pandas_udf("array<double>")
    def transform(spec: pd.DataFrame) -> pd.Series:
        if not len(spec):
            return pd.Series([], dtype=object)
        stacked = np.stack(spec["re"].to_numpy()) + 1j * np.stack(spec["im"].to_numpy())
        frames = np.fft.irfft(stacked, axis=1) * gain
        return pd.Series(list(frames * window if window is not None else frames))

    return transform(F.col(column))


def bins_of(frames: DataFrame, column: str = "spec", keep: Sequence[str] = FRAME) -> DataFrame:
    """A spectrum column to one row per bin."""
    zipped = F.arrays_zip(F.col(f"{column}.re").alias("re"), F.col(f"{column}.im").alias("im"))
    rows = frames.select(*keep, F.posexplode(zipped).alias("bin", "_z"))
    return rows.select(*keep, F.col("bin").cast("bigint").alias("bin"), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def spectrum_of(bins: DataFrame, keep: Sequence[str] = FRAME) -> DataFrame:
    """Bins back to one spectrum column per frame; a frame has a fixed number of bins."""
    packed = bins.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("bin", "re", "im"))).alias("_b"))
    spec = F.struct(F.transform("_b", lambda b: b["re"]).alias("re"), F.transform("_b", lambda b: b["im"]).alias("im"))
    return packed.select(*keep, spec.alias("spec"))


def overlap_add(frames: DataFrame, hop: int, column: str = "x", keys: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Sum of overlapping frames on the timeline of the signal; partial sums come before the shuffle."""
    rows = frames.select(*keys, "frame", F.posexplode(column).alias("_i", "x"))
    return rows.groupBy(*keys, (F.col("frame") * hop + F.col("_i")).alias("t")).agg(F.sum("x").alias("x"))


# Bands ----------------------------------------------------------------------------------------------------------


def band_to_bins(bins: DataFrame, band_values: DataFrame, widths: Sequence[int] = BAND_WIDTHS, keys: Sequence[str] = FRAME) -> DataFrame:
    """Gives every bin the values of its band."""
    return bins.withColumn("band", band_of(F.col("bin"), widths)).join(band_values, [*keys, "band"])


def erb_features(bins: DataFrame, widths: Sequence[int] = BAND_WIDTHS, keys: Sequence[str] = FRAME) -> DataFrame:
    """Mean power of each band in dB."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    bands = bins.groupBy(*keys, band_of(F.col("bin"), widths).alias("band")).agg(F.avg(power).alias("_power"))
    return bands.select(*keys, "band", (F.lit(10.0) * F.log10(F.col("_power") + F.lit(1e-10))).alias("erb"))


def apply_band_gain(bins: DataFrame, gains: DataFrame, widths: Sequence[int] = BAND_WIDTHS) -> DataFrame:
    rows = band_to_bins(bins, gains.select(*FRAME, "band", "gain"), widths)
    return rows.select(*FRAME, "bin", (F.col("re") * F.col("gain")).alias("re"), (F.col("im") * F.col("gain")).alias("im"))


def attenuation_limit(bins: DataFrame, limit_db: float, frames_back: int = 1) -> DataFrame:
    """Blends a share 10^(-|dB|/20) of an earlier noisy frame into the enhanced one; zero dB changes nothing.

    ``bins`` has re, im (enhanced) and noisy_re, noisy_im. The noisy frame is the one ``frames_back`` before; it is met
    by an equi-join on its number, so no bin has to be ordered in one task.
    """
    if not limit_db:
        return bins.select(*FRAME, "bin", "re", "im")
    share = F.lit(10 ** (-abs(limit_db) / 20))
    earlier = bins.select("signal_id", (F.col("frame") + frames_back).alias("frame"), "bin", F.col("noisy_re").alias("_re"), F.col("noisy_im").alias("_im"))
    joined = bins.join(earlier, [*FRAME, "bin"], "left")

    def mixed(name: str) -> Column:
        return (F.col(name) + share * (F.coalesce(f"_{name}", F.lit(0.0)) - F.col(name))).alias(name)

    return joined.select(*FRAME, "bin", mixed("re"), mixed("im"))


def mean_square(column: str = "x") -> Column:
    return F.aggregate(column, F.lit(0.0), lambda total, v: total + v * v) / F.size(column)


def silence_flag(threshold: float = 1e-7, column: str = "x") -> Column:
    return mean_square(column) < threshold


def silence_bypass(frames: DataFrame, output: str = "y", threshold: float = 1e-7) -> DataFrame:
    """Silent input frames give zeros. See `over_silence` for operators with a state."""
    silent = silence_flag(threshold)
    zeros = F.transform(output, lambda v: v * F.lit(0.0))
    return frames.withColumn("silent", silent).withColumn(output, F.when(F.col("silent"), zeros).otherwise(F.col(output)))


def over_silence(
    frames: DataFrame, operator: Callable[[DataFrame], DataFrame], outputs: Sequence[str], threshold: float = 1e-7
) -> DataFrame:
    """Runs a stateful operator on the frames that are not silent: its state stays as it is over silent ones.

    ``frames`` has (signal_id, frame, x ARRAY); ``operator`` maps such frames to (signal_id, frame, ``outputs``), arrays
    as long as x. Silent frames come back with zeros. The operator has to go from frame to frame in order, not by frame
    numbers, as `exponential_mean` and the streaming processors do.
    """
    silent = silence_flag(threshold)
    heard = operator(frames.where(~silent)).select(*FRAME, *outputs)
    zeros = F.transform("x", lambda _: F.lit(0.0))
    quiet = frames.where(silent).select(*FRAME, *(zeros.alias(o) for o in outputs))
    return heard.unionByName(quiet)


def dead_reference(bins: DataFrame, threshold: float = 1e-12) -> DataFrame:
    """Per frame: whether the mean power of the reference is below the threshold."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return bins.groupBy(*FRAME).agg((F.avg(power) < threshold).alias("dead"))


# Experts --------------------------------------------------------------------------------------------------------


def rule_weights(flag: Column) -> Column:
    """Weights of two experts: the second one where the impulse flag is set."""
    on = F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.array(F.lit(1.0) - on, on)


def fuse(experts: DataFrame, weights: DataFrame | None, widths: Sequence[int] = BAND_WIDTHS) -> DataFrame:
    """Weighted sum of the experts per bin. ``experts`` has an ``expert`` key; ``weights`` has (frame, band, expert, w).

    Without weights every expert counts the same, so a single expert passes through.
    """
    if weights is None:
        return experts.groupBy(*FRAME, "bin").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    rows = experts.withColumn("band", band_of(F.col("bin"), widths)).join(weights, [*FRAME, "band", "expert"])
    w = F.col("w")
    return rows.groupBy(*FRAME, "bin").agg(F.sum(w * F.col("re")).alias("re"), F.sum(w * F.col("im")).alias("im"))


def gate_mask(weights: DataFrame, masks: DataFrame) -> DataFrame:
    """Band mask of the fused signal: sum over experts of weight times mask."""
    rows = weights.join(masks, [*FRAME, "band", "expert"])
    return rows.groupBy(*FRAME, "band").agg(F.sum(F.col("w") * F.col("mask")).alias("mask"))


def mean_gate_weights(weights: DataFrame) -> DataFrame:
    return weights.groupBy("signal_id", "expert").agg(F.avg("w").alias("mean_weight"))


def gate_features(erb: DataFrame, masks: DataFrame, lsnr: DataFrame, impulse: DataFrame) -> DataFrame:
    """One vector per frame: band features, masks expert by expert, local SNRs, impulse pair, mask disagreement.

    All lists are per frame, with one entry per band or per band and expert.
    """
    def ordered(name: str, value: str, *order: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias(name)

    spread = masks.groupBy(*FRAME, "band").agg(F.stddev_pop("mask").alias("_d"))
    parts = [
        erb.groupBy(*FRAME).agg(ordered("_erb", "erb", "band")),
        masks.groupBy(*FRAME).agg(ordered("_masks", "mask", "expert", "band")),
        lsnr.groupBy(*FRAME).agg(ordered("_lsnr", "lsnr", "expert")),
        impulse.select(*FRAME, F.array("flag", "severity").alias("_impulse")),
        spread.groupBy(*FRAME).agg(ordered("_spread", "_d", "band")),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, FRAME)
    return joined.select(*FRAME, F.concat("_erb", "_masks", "_lsnr", "_impulse", "_spread").alias("features"))


# Callables ------------------------------------------------------------------------------------------------------


def transform_spectrum(function, column: str = "spec") -> Column:
    """Caller's transform of a batch of spectra (complex matrix in, complex matrix out) as a column hook."""

    @F.pandas_udf(SPECTRUM_TYPE)
    def transform(spec: pd.DataFrame) -> pd.DataFrame:
        if not len(spec):
            return pd.DataFrame({"re": [], "im": []})
        out = function(np.stack(spec["re"].to_numpy()) + 1j * np.stack(spec["im"].to_numpy()))
        return pd.DataFrame({"re": list(out.real), "im": list(out.imag)})

    return transform(F.col(column))


def enhance(frames: DataFrame, load, column: str = "spec") -> DataFrame:
    """Runs a model over spectra. ``load`` is called once per task and returns the predict function.

    Several models over one spectrum are several calls on the same ``frames``.
    """

    def run(batches):
        predict = load()
        for batch in batches:
            spec = np.stack([np.asarray(s["re"]) for s in batch[column]]) + 1j * np.stack([np.asarray(s["im"]) for s in batch[column]])
            out = predict(spec)
            batch[column] = [{"re": r, "im": i} for r, i in zip(out.real, out.imag)]
            yield plain(batch)

    return frames.mapInPandas(run, frames.schema)


