"""Measures of pairs of decoded files, on block arrays: one row for each block of a pair, never one for each sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.plans.batches import plain
from wavelake.plans.ordered import BLOCK, spread_groups
from wavelake.schema import SAMPLE_RATE
from wavelake.sources.wav import probe_wav, read_wav_blocks

# The lag is searched in the first ten seconds, up to 50 ms to either side.
LAG_SECONDS, MAX_LAG = 10, 2400
NOT_FINITE = "non-finite samples"


def correlation_lag(clean: np.ndarray, noisy: np.ndarray, max_lag: int = MAX_LAG) -> int:
    """Lag of the largest absolute correlation of two equally long signals, the smallest such lag on ties."""
    size = 1 << (2 * len(clean) - 1).bit_length()
    product = np.fft.rfft(noisy, size) * np.conj(np.fft.rfft(clean, size))
    reach = min(max_lag, len(clean) - 1)
    lags = np.arange(-reach, reach + 1)
    return int(lags[np.argmax(np.abs(np.fft.irfft(product, size)[lags]))])


def _decoded(pairs: DataFrame, block: int, stop: int | None = None) -> DataFrame:
    """(pair, block, noisy, clean, error): both sides of each block in one row; errors are rows of block -1."""
    sides = []
    for name, other in (("noisy", "clean"), ("clean", "noisy")):
        paths = pairs.select("pair", F.col(f"{name}_path").alias("_at"))
        read = read_wav_blocks(paths.select(F.col("_at").alias("path")).distinct(), block, stop=stop)
        none = F.lit(None).cast("array<float>").alias(other)
        rows = paths.join(read, F.col("_at") == F.col("path"))
        sides.append(rows.select("pair", F.coalesce("block", F.lit(-1)).alias("block"), F.col("samples").alias(name), none, "error"))
    only = lambda c: F.first(c, ignorenulls=True).alias(c)
    return sides[0].unionByName(sides[1]).groupBy("pair", "block").agg(only("noisy"), only("clean"), F.min("error").alias("error"))


def _start_lags(pairs: DataFrame, limit: int, max_lag: int, block: int) -> DataFrame:
    """(pair, alignment_lag) from the first ``limit`` samples of both sides: a group of fixed size at most."""

    def lag(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        noisy, clean = (np.concatenate([np.asarray(x, float) for x in group[c]]) for c in ("noisy", "clean"))
        return plain(pd.DataFrame({"pair": [group["pair"].iloc[0]], "alignment_lag": [correlation_lag(clean, noisy, max_lag)]}))

    whole = _decoded(pairs, block, limit).where("noisy is not null and clean is not null")
    return spread_groups(whole, "pair").groupBy("pair").applyInPandas(lag, "pair STRING, alignment_lag BIGINT")


def _sums(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in blocks:
        rows = []
        for pair, noisy, clean, error in zip(batch["pair"], batch["noisy"], batch["clean"], batch["error"]):
            if noisy is None or clean is None:
                rows.append((pair, 0, 0.0, 0.0, None, None, error))
                continue
            n, c = np.asarray(noisy, float), np.asarray(clean, float)
            rows.append((pair, len(c), (c * c).sum(), ((n - c) ** 2).sum(), np.abs(n).max(initial=0), np.abs(c).max(initial=0), error))
        yield plain(pd.DataFrame(rows, columns=["pair", "n", "cc", "rr", "pn", "pc", "decode_error"]))


def measure_pairs(pairs: DataFrame, max_lag: int = MAX_LAG, block: int = BLOCK) -> DataFrame:
    """What `rules.validate_pairs` judges, taken from the files of each pair.

    ``pairs`` has noisy_relpath (unique), noisy_path and clean_path (null where a file was not found), duration_sec_meta
    and measured_snr_db_meta. Heads are read first; only pairs of equal length, rate and one channel are decoded. Sums
    are taken per block and added up; the lag comes from the first ten seconds. Rows without noisy_relpath are left out.
    """
    pairs = pairs.where("noisy_relpath is not null").select(
        "noisy_relpath", "noisy_path", "clean_path", "duration_sec_meta", "measured_snr_db_meta"
    )
    both = pairs.select(F.explode(F.array("noisy_path", "clean_path")).alias("path")).where("path is not null").distinct()
    probes = probe_wav(both)

    def side(name: str) -> DataFrame:
        head = "" if name == "noisy" else "clean_"
        return probes.select(
            F.col("path").alias(f"_{name}"),
            F.col("error").alias(f"{name}_error"),
            *(F.col(c).alias(f"{head}{c}") for c in ("sample_rate", "channels", "frames")),
        )

    rows = pairs.join(side("noisy"), F.col("noisy_path") == F.col("_noisy"), "left")
    rows = rows.join(side("clean"), F.col("clean_path") == F.col("_clean"), "left").drop("_noisy", "_clean")
    same = (F.col("sample_rate") == F.col("clean_sample_rate")) & (F.col("frames") == F.col("clean_frames"))
    fit = same & (F.col("channels") == 1) & (F.col("clean_channels") == 1)
    fitting = rows.where(fit).select(F.col("noisy_relpath").alias("pair"), "noisy_path", "clean_path")

    blocks = _decoded(fitting, block)
    sums = blocks.mapInPandas(_sums, "pair STRING, n BIGINT, cc DOUBLE, rr DOUBLE, pn DOUBLE, pc DOUBLE, decode_error STRING")
    sums = sums.groupBy("pair").agg(
        *(F.sum(c).alias(c) for c in ("n", "cc", "rr")), *(F.max(c).alias(c) for c in ("pn", "pc")), F.min("decode_error").alias("decode_error")
    )
    lags = _start_lags(fitting, LAG_SECONDS * SAMPLE_RATE, max_lag, block)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("pair", name)

    rows = rows.join(keyed(sums, "_s"), F.col("noisy_relpath") == F.col("_s"), "left")
    rows = rows.join(keyed(lags, "_l"), F.col("noisy_relpath") == F.col("_l"), "left")

    def rms(total: str) -> Column:
        return F.sqrt(F.col(total) / F.col("n"))

    def level(column: Column) -> Column:
        return F.greatest(column, F.lit(1e-12))

    decode = F.when(F.col("decode_error") != NOT_FINITE, F.col("decode_error"))
    return rows.select(
        "noisy_relpath",
        F.col("noisy_path").isNotNull().alias("noisy_found"),
        F.col("clean_path").isNotNull().alias("clean_found"),
        F.coalesce("noisy_error", "clean_error", decode).alias("read_error"),
        *("sample_rate", "clean_sample_rate", "channels", "clean_channels", "frames", "clean_frames"),
        (~F.col("decode_error").eqNullSafe(NOT_FINITE)).alias("all_finite"),
        "alignment_lag",
        rms("rr").alias("rms_residual"),
        rms("cc").alias("rms_clean"),
        F.col("pn").alias("peak_noisy"),
        F.col("pc").alias("peak_clean"),
        (F.col("frames") / F.col("sample_rate")).alias("duration_sec"),
        "duration_sec_meta",
        (F.lit(20.0) * F.log10(level(rms("cc")) / level(rms("rr")))).alias("measured_snr_db_audio"),
        "measured_snr_db_meta",
    )
