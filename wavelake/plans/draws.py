"""Seeded draws. A draw depends only on its named inputs, never on row order, partition or executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """An unsigned 32-bit draw (BIGINT) from the colon-joined text of its parts."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def derive_seed(base: int, k: Column, attempt: Column | int) -> Column:
    """The 32-bit seed of attempt ``attempt`` of sample ``k``."""
    return draw(base, k, attempt if isinstance(attempt, Column) else F.lit(attempt))


def below(value: Column, n: Column | int) -> Column:
    """Reduces a draw to 0 .. n-1."""
    return value % (n if isinstance(n, Column) else F.lit(n))


def unit(value: Column) -> Column:
    """Maps a draw to [0, 1)."""
    return value / F.lit(4294967296.0)


def between(value: Column, lo: Column, hi: Column) -> Column:
    """Reduces a draw to the integers lo .. hi, both included."""
    return lo + value % (hi - lo + F.lit(1))


def draw_dist(spec: dict, value: Column) -> Column:
    """A draw from a tagged distribution: fixed, choice, or uniform rounded to two decimals."""
    kind = spec["type"]
    if kind == "fixed":
        return F.lit(float(spec["value"]))
    if kind == "choice":
        values = F.array(*[F.lit(float(v)) for v in spec["values"]])
        return F.element_at(values, (below(value, len(spec["values"])) + 1).cast("int"))
    if kind == "uniform":
        lo, hi = float(spec["min"]), float(spec["max"])
        return F.round(F.lit(lo) + F.lit(hi - lo) * unit(value), 2)
    raise ValueError(f"unknown distribution type: {kind}")


def distinct_indices(n: Column, k: Column, *parts: Column | str | int) -> Column:
    """``min(k, n)`` distinct indices out of 0 .. n-1 as an array, without listing the n candidates.

    Each step i of n-k .. n-1 draws r in 0 .. i and adds r, or i when r is already there. The set is uniform over all
    sets of that size; the caller orders it by another draw where order matters.
    """
    n = n.cast("bigint")
    take = F.least(k.cast("bigint"), n)
    steps = F.when(take > 0, F.sequence(n - take, n - F.lit(1))).otherwise(F.array().cast("array<bigint>"))

    # Each draw is made once, before the fold that reads it twice.
    drawn = F.transform(steps, lambda i: F.struct(i.alias("i"), below(draw(*parts, i), i + F.lit(1)).alias("r")))

    def step(taken: Column, d: Column) -> Column:
        return F.array_append(taken, F.when(F.array_contains(taken, d["r"]), d["i"]).otherwise(d["r"]))

    return F.aggregate(drawn, F.array().cast("array<bigint>"), step)
