"""Scalar column functions: levels, PCM codes, labels, paths, complex numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelake.schema import SAMPLE_RATE

# Labels and lower bounds of the input-SNR bins.
SNR_BINS = [("<0", None), ("0-5", 0), ("5-10", 5), ("10-15", 10), ("15-20", 15), (">=20", 20)]

# Integer scale and stored factor of the PCM encodings.
PCM = {"PCM_16": (32768.0, 1), "PCM_24": (8388608.0, 256)}


def power_db(ratio: Column) -> Column:
    return F.lit(10.0) * F.log10(ratio)


def amplitude_db(ratio: Column) -> Column:
    return F.lit(20.0) * F.log10(ratio)


def db_to_amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def pcm_encode(x: Column, subtype: str) -> Column:
    """Integer code (half-even rounding, clamped), or FLOAT for the float subtype."""
    if subtype == "FLOAT":
        return x.cast("float")
    scale, factor = PCM[subtype]
    code = F.least(F.greatest(F.rint(x * F.lit(scale)), F.lit(-scale)), F.lit(scale - 1))
    return code.cast("int") * F.lit(factor)


def pcm_decode(code: Column, subtype: str) -> Column:
    if subtype == "FLOAT":
        return code.cast("double")
    scale, factor = PCM[subtype]
    return code.cast("double") / F.lit(scale * factor)


def fade_gain(i: Column, n: Column, fade: Column) -> Column:
    """Gain of sample ``i`` of ``n`` under a linear ramp without end point at both ends."""
    width = F.greatest(F.least(fade, F.floor(n / F.lit(2))), F.lit(0))
    ramp = F.least(F.lit(1.0), i / width, (n - F.lit(1) - i) / width)
    return F.when(width == 0, F.lit(1.0)).otherwise(ramp)


def snr_bin(value: Column) -> Column:
    label = F.lit(SNR_BINS[0][0])
    for name, lower in SNR_BINS[1:]:
        label = F.when(value >= lower, F.lit(name)).otherwise(label)
    return label


def snr_bin_order(label: Column) -> Column:
    names = F.array(*[F.lit(name) for name, _ in SNR_BINS])
    return F.array_position(names, label)


def sample_id(k: Column) -> Column:
    """Six digits with leading zeros; longer numbers keep all digits."""
    text = k.cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def seconds(samples: Column) -> Column:
    return F.round(samples / F.lit(float(SAMPLE_RATE)), 6)


def std_length(rate: Column, frames: Column) -> Column:
    """Length after resampling to 48 kHz: the ceiling of frames * 48000 / rate, in integers."""
    ahead = frames.cast("bigint") * F.lit(SAMPLE_RATE).cast("bigint") + rate - 1
    return ((ahead - ahead % rate) / rate).cast("bigint")


def trailing_index(identifier: Column) -> Column:
    digits = F.regexp_extract(identifier, r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def strip_prefix(path: Column, prefix: str) -> Column:
    """The path without its required prefix; null where the prefix is absent."""
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path)))


def optional_prefix(path: Column, prefix: str) -> Column:
    return F.coalesce(strip_prefix(path, prefix), path)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot, or the empty text."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))


def path_template(path: Column, template: str) -> dict[str, Column]:
    """Maps whole path components to the placeholders of ``template``; one Column per placeholder.

    Every Column is null where the depth differs or a literal component does not match. ``*`` and ``{file}`` match
    anything and give nothing.
    """
    parts = F.split(path, "/")
    wanted = template.strip("/").split("/")
    fits = F.size(parts) == len(wanted)
    found = {}
    for i, piece in enumerate(wanted, start=1):
        if piece in ("*", "{file}"):
            continue
        if piece.startswith("{") and piece.endswith("}"):
            found[piece[1:-1]] = i
        else:
            fits = fits & (F.get(parts, F.lit(i - 1)) == piece)
    return {name: F.when(fits, F.get(parts, F.lit(i - 1))) for name, i in found.items()}


def category_from_path(path: Column, level: str = "parent") -> Column:
    """First directory (``top``) or the one that holds the file (``parent``); null for a file without directories."""
    parts = F.split(path, "/")
    at = F.lit(0) if level == "top" else F.size(parts) - 2
    return F.when(F.size(parts) > 1, F.get(parts, at))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nan_to_num(x: Column) -> Column:
    """NaN becomes 0 and infinities become the largest 32-bit float of their sign."""
    largest = 3.4028234663852886e38
    return (
        F.when(F.isnan(x), F.lit(0.0))
        .when(x == float("inf"), F.lit(largest))
        .when(x == float("-inf"), F.lit(-largest))
        .otherwise(x)
    )


def lr_at(step: Column, lr: float, warmup: int) -> Column:
    """Linear warm-up, then constant."""
    return F.lit(lr) * F.least(F.lit(1.0), (step + F.lit(1)) / F.lit(float(max(warmup, 1))))


def lsnr_gates(lsnr: Column, low: float = -10.0, high_gain: float = 30.0, high_filter: float = 20.0) -> dict[str, Column]:
    return {
        "apply_gains": (lsnr >= low) & (lsnr <= high_gain),
        "apply_filter": (lsnr >= low) & (lsnr <= high_filter),
        "zero_mask": lsnr <= low,
    }


# Complex numbers are structs of two doubles named re and im.


def cplx(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def c_mul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_conj(a: Column) -> Column:
    return cplx(a["re"], -a["im"])


def c_power(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def c_abs(a: Column) -> Column:
    return F.sqrt(c_power(a))


def c_scale(a: Column, factor: Column) -> Column:
    return cplx(a["re"] * factor, a["im"] * factor)


def clamped_ratio(s: Column, y: Column, eps: float = 1e-8, limit: float = 1.5) -> Column:
    """s / (y + eps) with its magnitude held at or below ``limit``; the phase is kept."""
    shifted = cplx(y["re"] + F.lit(eps), y["im"])
    power = c_power(shifted)
    product = c_mul(s, c_conj(shifted))
    ratio = c_scale(product, F.when(power > 0, F.lit(1.0) / power).otherwise(F.lit(0.0)))
    size = c_abs(ratio)
    return c_scale(ratio, F.when(size > limit, F.lit(limit) / size).otherwise(F.lit(1.0)))


def config_hash(config: Column, ignored: list[str]) -> Column:
    """SHA-256 over the key-sorted JSON object of a map, without the ignored keys. Values may be nested."""
    kept = F.map_filter(config, lambda key, _: ~key.isin(ignored)) if ignored else config
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256)
