"""Signal metrics as aggregate Columns, usable in any ``groupBy().agg()``.

All are built from sums, counts and maxima, so Spark pre-aggregates them before the shuffle and one signal of any
length never has to sit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelake.functions.scalars import pcm_decode, pcm_encode
from wavelake.schema import CLIP_LEVEL


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def mean_power(x) -> Column:
    return F.avg(_c(x) * _c(x))


def rms(x) -> Column:
    return F.sqrt(mean_power(x))


def peak(x) -> Column:
    return F.max(F.abs(_c(x)))


def to_dbfs(level: Column) -> Column:
    return F.lit(20.0) * F.log10(level + F.lit(1e-12))


def level_dbfs(x) -> Column:
    return to_dbfs(rms(x))


def clipped_samples(x, level: float = CLIP_LEVEL) -> Column:
    return F.count_if(F.abs(_c(x)) >= level)


def snr_energy_db(clean, est) -> Column:
    """Energy ratio; 1e-12 is added to the error energy."""
    c, e = _c(clean), _c(est)
    return F.lit(10.0) * F.log10(F.sum(c * c) / (F.sum((c - e) * (c - e)) + F.lit(1e-12)))


def snr_rms_db(clean, est) -> Column:
    """RMS ratio; both sides are held at or above 1e-12."""
    c, e = _c(clean), _c(est)
    floor = F.lit(1e-12)
    error = F.sqrt(F.avg((e - c) * (e - c)))
    return F.lit(20.0) * F.log10(F.greatest(rms(c), floor) / F.greatest(error, floor))


def snr_masked_db(clean, noisy, mask) -> Column:
    """Power ratio over the samples with a true mask."""
    c, n, m = _c(clean), _c(noisy), _c(mask)
    signal = F.avg(F.when(m, c * c))
    noise = F.avg(F.when(m, (n - c) * (n - c)))
    return F.lit(10.0) * F.log10(signal / noise)


def snr_decoded_db(clean, noisy, mask, subtype: str = "PCM_16") -> Column:
    """Power ratio over the mask of what a file of the subtype gives back, not of the exact samples."""
    decoded = [pcm_decode(pcm_encode(_c(x), subtype), subtype) for x in (clean, noisy)]
    return snr_masked_db(*decoded, mask)


def si_sdr_db(ref, est) -> Column:
    """Scale-invariant ratio that keeps the mean; every energy gets 1e-12 added."""
    r, e = _c(ref), _c(est)
    eps = F.lit(1e-12)
    rr, ee, re = F.sum(r * r), F.sum(e * e), F.sum(r * e)
    scale = re / (rr + eps)
    target = scale * scale * rr
    noise = F.greatest(ee - F.lit(2.0) * scale * re + target, F.lit(0.0))
    return F.lit(10.0) * F.log10((target + eps) / (noise + eps))


def si_sdr_centred_db(ref, est) -> Column:
    """Scale-invariant ratio of the mean-free signals; energies are held at or above 1e-20."""
    r, e = _c(ref), _c(est)
    floor, n = F.lit(1e-20), F.count(r)
    rr = F.sum(r * r) - F.sum(r) * F.sum(r) / n
    ee = F.sum(e * e) - F.sum(e) * F.sum(e) / n
    re = F.sum(r * e) - F.sum(r) * F.sum(e) / n
    scale = re / F.greatest(rr, floor)
    target = scale * scale * rr
    noise = ee - F.lit(2.0) * scale * re + target
    return F.lit(10.0) * F.log10(F.greatest(target, floor) / F.greatest(noise, floor))


def optimal_gain(ref, est) -> Column:
    """Least-squares scalar that maps ``est`` onto ``ref``."""
    r, e = _c(ref), _c(est)
    return F.sum(r * e) / (F.sum(e * e) + F.lit(1e-12))
