"""Causal operators in batch form. The streaming forms are in wavelake.streaming.

Recursions run in parallel over blocks of a signal wherever the recursion allows it exactly: a linear recurrence splits
into block parts plus a carried term; the impulse detector is solved block by block until the carried states agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.plans.batches import plain
from wavelake.plans.ordered import fold_blocks, join_on, ordered_rank, spread_groups, with_block
from wavelake.session import settled

# Fixed values of the impulse detector.
JUMP_DB, FLOOR_ALPHA, HOLD_FRAMES = 13.0, 0.98, 3

EMA_BLOCK = 2048


def exponential_mean(
    df: DataFrame, keys: Sequence[str], column: str, alpha: float, initial: Column, name: str, block: int = EMA_BLOCK
) -> DataFrame:
    """s = alpha * s + (1 - alpha) * x over the frames of a key in order, starting from ``initial``.

    The recurrence goes from row to row, so the mean holds over frames that are missing, as it does in a stream.

    Inside a block the recurrence is a scaled running sum, a plain window sum. The value at the end of a block decays
    by alpha^block over the next one, so the carried term needs only the few earlier blocks that are above the
    resolution of a double, and the initial state. No task sees more than a block of frames of a key.
    """
    while -block * log(alpha) > 570.0:
        block //= 2
    placed = ordered_rank(with_block(df, "frame", block), keys, ["frame"], "_pos").drop("block")
    rows = with_block(placed, "_pos", block)
    k = F.col("_pos") - F.col("block") * block
    x = F.col(column)
    grown = x * F.pow(F.lit(alpha), -k)
    local = Window.partitionBy(*keys, "block").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "block").agg(
        (F.lit(1 - alpha) * F.sum(x * F.pow(F.lit(alpha), F.lit(block - 1) - k))).alias("_end"), F.first(initial).alias("_initial")
    )
    back = max(1, ceil(log(1e-40) / (block * log(alpha))))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(-back, -1)
    carried = F.aggregate(
        F.collect_list(F.struct("block", "_end")).over(earlier),
        F.lit(0.0),
        lambda total, e: total + e["_end"] * F.pow(F.lit(alpha), (F.col("block") - F.lit(1) - e["block"]) * block),
    )
    state = carried + F.col("_initial") * F.pow(F.lit(alpha), F.col("block") * block)
    states = ends.select(*keys, "block", state.alias("_state"))
    joined = rows.withColumn("_local", F.lit(1 - alpha) * F.sum(grown).over(local))
    joined = join_on(joined, states, [*keys, "block"])
    value = F.pow(F.lit(alpha), k) * (F.col("_local") + F.lit(alpha) * F.col("_state"))
    return joined.withColumn(name, value).drop("_local", "_state", "_pos", "block")


def linspace(position: Column, start: float, stop: float, count: int) -> Column:
    return F.lit(start) + position * F.lit((stop - start) / (count - 1))


def erb_mean_norm(bands: DataFrame, alpha: float = 0.99, count: int = 32) -> DataFrame:
    """Band features minus their running mean, over 40. The mean starts at -60 to -90 dB from the first to the last band."""
    initial = linspace(F.col("band"), -60.0, -90.0, count)
    rows = exponential_mean(bands, ["signal_id", "band"], "erb", alpha, initial, "_mean")
    return rows.withColumn("erb_norm", (F.col("erb") - F.col("_mean")) / 40.0).drop("_mean")


def unit_norm(bins: DataFrame, alpha: float = 0.99, count: int = 96) -> DataFrame:
    """Bins over the square root of the running mean of their magnitude, which starts at 1e-3 to 1e-4 by bin."""
    rows = bins.withColumn("_size", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    initial = linspace(F.col("bin"), 1e-3, 1e-4, count)
    rows = exponential_mean(rows, ["signal_id", "bin"], "_size", alpha, initial, "_mean")
    scale = F.sqrt("_mean")
    return rows.withColumn("re", F.col("re") / scale).withColumn("im", F.col("im") / scale).drop("_size", "_mean")


def following_floor(level: np.ndarray, floor: float, alpha: float) -> np.ndarray:
    """The floor before each of some consecutive frames that it follows, and after the last one."""
    k = np.arange(1, len(level) + 1)
    return np.concatenate([[floor], alpha**k * (floor + (1 - alpha) * np.cumsum(level / alpha**k))])


def impulse_scan(
    energy: np.ndarray,
    floor: float | None,
    held: int,
    jump_db: float = JUMP_DB,
    alpha: float = FLOOR_ALPHA,
    hold: int = HOLD_FRAMES,
    stretch: int = 512,
):
    """Flags and severities of consecutive frames from a carried state; returns (flags, severities, floor, held).

    Time falls into two kinds of stretches, each solved as a whole. While the flag is down the floor is a linear
    recurrence of the energy, so a scaled sum gives it for a stretch and a comparison the first jump in it. While the
    flag is up the floor stands still, so the jumps ahead are known at once, and the flag ends ``hold`` frames after
    the first jump that no other one follows within ``hold`` frames.
    """
    level = np.maximum(np.asarray(energy, dtype=np.float64), 1e-12)
    n = len(level)
    if not n:
        return np.zeros(0, dtype=bool), np.zeros(0), floor, int(held)
    floor = float(level[0]) if floor is None else floor
    ratio = 10.0 ** (jump_db / 10.0)
    active, before = np.zeros(n, dtype=bool), np.empty(n)
    at, jump = 0, int(held) - hold - 1  # the carried flag comes from a jump at this place
    end = jump + hold if held else 0
    while at < n:
        if at >= end:
            floors = following_floor(level[at : at + stretch], floor, alpha)
            jumps = np.flatnonzero(level[at : at + stretch] > ratio * floors[:-1])
            if not len(jumps):
                before[at : at + stretch] = floors[:-1]
                at, floor = at + len(floors) - 1, float(floors[-1])
                continue
            calm = int(jumps[0])
            before[at : at + calm] = floors[:calm]
            at, floor, jump = at + calm, float(floors[calm]), at + calm
        ahead = np.concatenate([[jump], np.flatnonzero(level[max(at, jump + 1) :] > ratio * floor) + max(at, jump + 1)])
        gaps = np.flatnonzero(np.diff(ahead) > hold)
        jump = int(ahead[gaps[0]] if len(gaps) else ahead[-1])
        end = jump + hold
        active[at:end] = True
        before[at:end] = floor
        at = end
    severity = np.clip(10.0 * np.log10(level / before) / 40.0, 0.0, 1.0)
    return active, severity, floor, max(0, end - n + 1) if end > n - 1 and active[-1] else 0


def raised_through(block, floor: float, held: int, jump_db: float = JUMP_DB, hold: int = HOLD_FRAMES) -> int | None:
    """The carried hold after a block that keeps the flag up from end to end for this state, else None.

    Then the floor stays as it is. ``block`` is the summary of `block_summary`: the flag stays up if the first jump comes
    before the carried flag ends and every ``hold`` frames in a row have a jump.
    """
    bar = 10.0 ** (jump_db / 10.0) * floor
    first = held if held > 1 else 1
    if block.frames < hold or not min(block.least, block.head[first - 1]) > bar:
        return None
    return 1 + max(i for i, level in enumerate(block.tail) if level > bar)


def block_summary(energy: np.ndarray, hold: int = HOLD_FRAMES) -> dict:
    """What `raised_through` needs of a block: running maxima of its first frames, its last frames, and the least of the
    maxima of all runs of ``hold`` frames."""
    level = np.maximum(np.asarray(energy, dtype=np.float64), 1e-12)
    n = len(level)
    runs = np.lib.stride_tricks.sliding_window_view(level, hold).max(axis=1) if n >= hold else np.array([0.0])
    return {
        "frames": n,
        "least": float(runs.min()),
        "head": np.maximum.accumulate(level[:hold]).tolist(),
        "tail": level[-hold:].tolist(),
    }


def impulse_flags(energies: DataFrame, keys: Sequence[str] = ("signal_id",), block: int = 65_536) -> DataFrame:
    """Impulse flag and severity of every frame: (keys, frame, energy, flag, severity).

    The floor freezes while the flag is held, so the state cannot be summed over blocks. Every block is first run from an
    assumed state. A pass over one row for each block then carries the true state on: a block that the flag is up in from
    end to end, for the state that reaches it, hands it on by its summary alone; any other block hands on what its run
    ended in, and runs again if it was run from another state. The floor forgets quickly where the flag is down, so few
    rounds are needed, however long the flag stays up. The result is that of one run over the whole signal.
    """
    keys = list(keys)
    rows = with_block(energies.select(*keys, "frame", "energy"), "frame", block)
    key_fields = [energies.schema[k] for k in keys]
    edge = T.StructType(
        [*key_fields, *T.StructType.fromDDL(
            "block long, in_floor double, in_held int, out_floor double, out_held int, "
            "frames int, least double, head array<double>, tail array<double>").fields]
    )
    flagged = T.StructType(
        [*key_fields, *(T.StructField(n, t) for n, t in (
            ("frame", T.LongType()), ("energy", T.DoubleType()), ("flag", T.BooleanType()), ("severity", T.DoubleType())))]
    )

    def start(group):
        floor = group["in_floor"].iloc[0]
        return None if pd.isna(floor) else float(floor), int(group["in_held"].iloc[0])

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame")
        floor, held = start(group)
        energy = group["energy"].to_numpy()
        _, _, out_floor, out_held = impulse_scan(energy, floor, held)
        head = {k: [group[k].iloc[0]] for k in keys}
        edges = {"in_floor": [floor], "in_held": [held], "out_floor": [out_floor], "out_held": [out_held]}
        edges |= {name: [value] for name, value in block_summary(energy).items()}
        return plain(pd.DataFrame({**head, "block": [group["block"].iloc[0]], **edges}).astype({"in_floor": "float64"}))

    def flags(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame")
        flag, severity, _, _ = impulse_scan(group["energy"].to_numpy(), *start(group))
        return plain(group[[*keys, "frame", "energy"]].assign(flag=flag, severity=severity))

    def carry(state, row):
        floor, held = state
        run_from = (None if pd.isna(row.in_floor) else row.in_floor, row.in_held)
        after, again = (row.out_floor, int(row.out_held)), False
        if (floor, held) != run_from:
            still = None if floor is None else raised_through(row, floor, held)
            after, again = ((floor, still), False) if still is not None else (after, True)
        return after, (floor, held, again)

    on = [*keys, "block"]
    states = rows.select(*on).distinct().select(
        *on, F.lit(None).cast("double").alias("in_floor"), F.lit(0).alias("in_held")
    )
    if not rows.where("block > 0").isEmpty():
        solved = settled(spread_groups(join_on(rows, states, on), *on).groupBy(*on).applyInPandas(ends, edge))
        while True:
            states = settled(
                fold_blocks(solved, keys, lambda: (None, 0), carry, "in_floor double, in_held int, again boolean")
            )
            again = states.where("again").drop("again")
            if again.isEmpty():
                break
            redone = spread_groups(join_on(rows, again, on), *on).groupBy(*on).applyInPandas(ends, edge)
            solved = settled(join_on(solved, again.select(*on), on, "left_anti").unionByName(redone))
        states = states.drop("again")
    return spread_groups(join_on(rows, states, on), *on).groupBy(*on).applyInPandas(flags, flagged)


# Residual canceller ---------------------------------------------------------------------------------------------


def cancel_frames(state: dict, frames: dict[str, np.ndarray], p: dict) -> dict[str, np.ndarray]:
    """Canceller over consecutive frames of some bins: arrays (frames, bins) in and out; updates ``state``.

    The filter w of a bin changes by an affine map from frame to frame, w <- keep w + add, whose factors depend on the
    input only and are formed for all frames at once, as is the share of the reference that a unit filter explains
    (``reach``). What is left to a loop over frames is the map itself and its reset where the output would be louder.
    ``frames``: complex s, y, x; mask, erased (frames, bins); frozen, bypass (frames). ``kept`` is the factor of the map
    of all frames together: what remains of the first w in the last, none after a reset.
    """
    s, y, x = frames["s"], frames["y"], frames["x"]
    mask = frames["mask"]
    earlier = np.concatenate([state["mask"][None], mask[:-1]])
    used = ~frames["bypass"][:, None]
    learned = used & ~frames["frozen"][:, None] & ~frames["erased"] & (earlier < p["mask_threshold"])
    rate = np.where(learned, p["mu"] / (np.abs(x) ** 2 + p["delta"]), 0)
    keep = 1 - rate * np.abs(x) ** 2
    add = rate * np.conj(x) * y
    noisy = y + p["eps"]
    gain = s / np.where(noisy == 0, 1, noisy)
    reach = x * gain * np.minimum(1, p["g_max"] / np.maximum(np.abs(gain), 1e-30))
    loud = np.abs(s)
    quiet = loud <= p["noise_floor"]
    w = state["w"]
    kept = np.ones(s.shape[1])
    explained, diverged, skipped = np.zeros_like(s), np.zeros(s.shape, bool), np.zeros(s.shape, bool)
    for t in np.flatnonzero(used):
        guess = w * reach[t]
        skipped[t] = quiet[t] | (np.abs(guess) <= p["noise_floor"])
        diverged[t] = ~skipped[t] & (np.abs(s[t] - guess) > loud[t])
        explained[t] = np.where(skipped[t] | diverged[t], 0, guess)
        w = np.where(diverged[t], 0, keep[t] * w + add[t])
        kept = np.where(diverged[t], 0, keep[t] * kept)
    state["w"], state["mask"] = w, mask[-1]
    return {"z": s - explained, "diverged": diverged, "skipped": skipped, "learned": learned, "kept": kept}


def frame_arrays(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """Columns of canceller rows as arrays (frames, bins)."""
    stack = lambda name: np.stack(rows[name].to_numpy()).astype(np.float64)
    out = {c: stack(f"{c}_re") + 1j * stack(f"{c}_im") for c in "syx"}
    out["mask"] = stack("mask")
    out["erased"] = (
        np.stack(rows["erased"].to_numpy()).astype(bool) if "erased" in rows else np.zeros(out["mask"].shape, bool)
    )
    out["frozen"] = (rows["impulse"] | rows["impulse_tail"]).to_numpy(dtype=bool)
    return out


def initial_filter(bins: int) -> dict:
    return {"w": np.zeros(bins, np.complex128), "mask": np.ones(bins)}


# Fixed values of the canceller.
CANCELLER = {"mu": 0.5, "delta": 1e-8, "eps": 1e-8, "g_max": 1.5, "mask_threshold": 0.3, "noise_floor": 1e-6}
DEAD_POWER = 1e-12

SPECTRA = ["s_re", "s_im", "y_re", "y_im", "x_re", "x_im", "mask"]
CANCEL_BLOCK = 512
#: Filters that differ by no more than this share of the larger one, at least of 1, count as equal.
SAME_FILTER = 1e-12

_BLOCK_MAP = "w_re array<double>, w_im array<double>, keep array<double>, add_re array<double>, add_im array<double>"
_FRAME_RESULT = (
    "z_re array<double>, z_im array<double>, frame_guard boolean, bin_guard long, floor_skip long, adapted long, "
    "by_clip boolean, by_dead boolean"
)


def _cancelled_block(group: pd.DataFrame, start: pd.DataFrame, params: dict):
    """Runs one block from its start; returns (frames, result, map): map is what the block does to the filter."""
    group = group.sort_values("frame")
    frames = frame_arrays(group)
    state = initial_filter(frames["mask"].shape[1])
    begin = start.iloc[0]
    if begin["mask_in"] is not None:
        state["mask"] = np.asarray(begin["mask_in"], np.float64)
    if begin["w_re"] is not None:
        state["w"] = np.asarray(begin["w_re"]) + 1j * np.asarray(begin["w_im"])
    w = state["w"]
    frames["bypass"] = (group["ref_clipped"] | group["dead"]).to_numpy(dtype=bool)
    done = cancel_frames(state, frames, params)
    add = state["w"] - done["kept"] * w
    return group, frames["s"], done, {
        "w_re": w.real, "w_im": w.imag, "keep": done["kept"], "add_re": add.real, "add_im": add.imag
    }


def nlms_cancel(frames: DataFrame, block: int = CANCEL_BLOCK, **overrides: float) -> DataFrame:
    """Adaptive residual canceller per bin: removes what the reference explains from the enhanced spectrum.

    ``frames`` has (signal_id, frame), equally long arrays s_re, s_im (enhanced), y_re, y_im (noisy), x_re, x_im
    (reference), mask, and flags impulse, impulse_tail, ref_clipped; an optional array ``erased``.

    A signal is cut into blocks of frames that run in tasks of their own. Between resets the filter of a bin changes by
    an affine map, so a block does so too, and the filter at the start of every block follows from the maps of the blocks
    before it, one row each. The maps come from a first run with empty filters. Where a reset falls depends on the filter,
    so every run hands its map on as it was, and blocks whose start turns out to differ run again. Learning forgets the
    start of a block within some dozen frames, and a reset at once, so that few blocks do.

    Returns per frame z_re, z_im and the counts behind `canceller_telemetry`.
    """
    params = {**CANCELLER, **overrides}
    power = F.aggregate(
        F.zip_with("x_re", "x_im", lambda a, b: a * a + b * b), F.lit(0.0), lambda total, v: total + v
    ) / F.size("x_re")
    rows = frames.withColumn("dead", power < DEAD_POWER)
    if "erased" not in frames.columns:
        rows = rows.withColumn("erased", F.transform("mask", lambda _: F.lit(False)))
    rows = with_block(rows, "frame", block).select(
        "signal_id", "block", "frame", *SPECTRA, "erased", "impulse", "impulse_tail", "ref_clipped", "dead"
    )
    on = ["signal_id", "block"]
    head = [frames.schema["signal_id"], T.StructField("block", T.LongType())]
    mapped = T.StructType([*head, *T.StructType.fromDDL(_BLOCK_MAP).fields])
    framed = T.StructType([*head, frames.schema["frame"], *T.StructType.fromDDL(f"{_FRAME_RESULT}, {_BLOCK_MAP}").fields])

    def only_map(group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(start):
            return pd.DataFrame({f.name: [] for f in mapped.fields})
        group, _, _, change = _cancelled_block(group, start, params)
        first = group.iloc[0]
        return plain(pd.DataFrame({"signal_id": [first["signal_id"]], "block": [first["block"]], **{k: [v] for k, v in change.items()}}))

    def full(group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(start):
            return pd.DataFrame({f.name: [] for f in framed.fields})
        group, s, done, change = _cancelled_block(group, start, params)
        clipped, dead = group["ref_clipped"].to_numpy(dtype=bool), group["dead"].to_numpy(dtype=bool)
        z = done["z"]
        louder = (np.abs(z) ** 2).sum(axis=1) > (np.abs(s) ** 2).sum(axis=1)
        z = np.where(louder[:, None], s, z)
        none = [None] * (len(group) - 1)
        return plain(
            pd.DataFrame(
                {
                    **{c: group[c].to_numpy() for c in ("signal_id", "block", "frame")},
                    "z_re": list(z.real), "z_im": list(z.imag), "frame_guard": louder,
                    "bin_guard": done["diverged"].sum(axis=1), "floor_skip": done["skipped"].sum(axis=1),
                    "adapted": done["learned"].sum(axis=1), "by_clip": clipped, "by_dead": dead & ~clipped,
                    # The map of the block goes with its last frame.
                    **{k: [*none, v] for k, v in change.items()},
                }
            )
        )

    def run(part: DataFrame, starts: DataFrame, function, schema) -> DataFrame:
        return spread_groups(part, *on).groupBy(*on).cogroup(starts.groupBy(*on)).applyInPandas(function, schema)

    def follow(w, row):
        ran = np.asarray(row.w_re) + 1j * np.asarray(row.w_im)
        w = np.zeros(len(ran), complex) if w is None else w
        again = bool((np.abs(w - ran) > SAME_FILTER * np.maximum(1.0, np.abs(w))).any())
        after = np.asarray(row.keep) * w + np.asarray(row.add_re) + 1j * np.asarray(row.add_im)
        return after, (w.real.tolist(), w.imag.tolist(), again)

    def followed(maps: DataFrame) -> DataFrame:
        return settled(fold_blocks(maps, ["signal_id"], lambda: None, follow, "w_re array<double>, w_im array<double>, again boolean"))

    last = rows.groupBy(*on).agg(F.max_by("mask", "frame").alias("mask"))
    previous = F.lag("mask").over(Window.partitionBy("signal_id").orderBy("block"))
    masks = settled(last.select(*on, previous.cast("array<double>").alias("mask_in")))
    nothing = F.lit(None).cast("array<double>")
    maps = settled(run(rows, masks.withColumns({"w_re": nothing, "w_im": nothing}), only_map, mapped))
    starts = followed(maps)
    result = settled(run(rows, join_on(masks, starts.drop("again"), on), full, framed))
    while True:
        starts = followed(result.where("w_re is not null").select(*on, "w_re", "w_im", "keep", "add_re", "add_im"))
        again = starts.where("again").drop("again")
        if again.isEmpty():
            break
        redone = run(join_on(rows, again.select(*on), on, "left_semi"), join_on(masks, again, on), full, framed)
        result = settled(join_on(result, again.select(*on), on, "left_anti").unionByName(redone))
    names = [f.name for f in T.StructType.fromDDL(_FRAME_RESULT).fields]
    return result.select("signal_id", "frame", *names)


def canceller_telemetry(cancelled: DataFrame) -> DataFrame:
    return cancelled.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum("bin_guard").alias("bin_guard"),
        F.count_if("frame_guard").alias("frame_guard"),
        F.count_if(F.col("by_clip") | F.col("by_dead")).alias("ref_bypass"),
        F.count_if("by_clip").alias("ref_bypass_clipped"),
        F.count_if("by_dead").alias("ref_bypass_dead"),
        F.sum("floor_skip").alias("low_y_skip_bins"),
        F.sum("adapted").alias("adaptation_bins"),
    )
