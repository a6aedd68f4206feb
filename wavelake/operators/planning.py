"""Seeded plans: noise picks, source chunks, impulsive events, attempts. No candidate list is ever crossed with samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.plans.draws import below, between, distinct_indices, draw
from wavelake.plans.ordered import ordered_index
from wavelake.plans.totals import beside
from wavelake.session import settled


def noise_pool(noises: DataFrame) -> DataFrame:
    """Numbers the files by (category, path), null category last: adds ``idx``."""
    return ordered_index(noises, [F.col("category").asc_nulls_last(), "rel"], "idx")


def pool_groups(pool: DataFrame) -> DataFrame:
    """One row per category of a numbered pool: its rank, first index and size."""
    groups = pool.groupBy("category").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("files"))
    return ordered_index(groups, ["start"], "group_idx")


def num_noises(draw_value: Column, lo: int, hi: int) -> Column:
    return between(draw_value, F.lit(lo), F.lit(hi))


def pick_any(samples: DataFrame, pool: DataFrame, seed: int, count: str = "n") -> DataFrame:
    """``n`` distinct files per sample, at most the pool size: rows (k, slot, idx)."""
    total = pool.agg(F.count(F.lit(1)).alias("_files"))
    rows = beside(samples.select("k", F.col(count).alias("_n")), total)
    chosen = distinct_indices(F.col("_files"), F.col("_n"), seed, "any", F.col("k"))
    return rows.select("k", F.posexplode(chosen).alias("slot", "idx"))


def pick_distinct_categories(
    samples: DataFrame, groups: DataFrame, seed: int, mode: str = "prefer_different", count: str = "n", base: int = 0
) -> DataFrame:
    """One file from each of ``n`` distinct categories: rows (k, slot, idx).

    With fewer categories than ``n``, ``require_different`` gives no rows for the sample, and ``prefer_different``
    takes every category once and fills up from the remaining files. ``groups`` is `pool_groups`.
    """
    totals = groups.agg(F.count(F.lit(1)).alias("_groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("_files"))
    rows = beside(samples.select("k", F.col(count).alias("_n")), totals)
    rows = rows.withColumn("_n", F.least("_n", "_files")).where(F.col("_n") > 0)
    if mode == "require_different":
        rows = rows.where(F.col("_groups") >= F.col("_n"))
    chosen = distinct_indices(F.col("_groups"), F.col("_n"), seed, "category", F.col("k"))
    slots = rows.select("k", "_n", "_groups", "_files", F.posexplode(chosen).alias("slot", "group_idx"))
    numbered = groups.select("group_idx", F.col("start").alias("_start"), F.col("files").alias("_size"))
    within = below(draw(seed, "file", F.col("k"), F.col("group_idx")), F.col("_size"))
    first = slots.join(numbered, "group_idx").withColumn("idx", F.col("_start") + within)
    picks = first.select("k", F.col("slot").cast("int").alias("slot"), "idx")
    if mode != "prefer_different":
        return picks
    # Only samples with more picks than categories get here, so the gathered lists are shorter than n.
    short = first.where(F.col("_groups") < F.col("_n"))
    taken = short.groupBy("k", "_n", "_groups", "_files").agg(F.sort_array(F.collect_list("idx")).alias("_taken"))
    free = distinct_indices(
        F.col("_files") - F.col("_groups"), F.col("_n") - F.col("_groups"), seed, "rest", F.col("k")
    )

    def skip(position: Column) -> Column:
        return F.aggregate("_taken", position, lambda at, used: F.when(at >= used, at + 1).otherwise(at))

    rest = taken.select("k", "_groups", F.posexplode(F.transform(free, skip)).alias("_slot", "idx"))
    return picks.unionByName(rest.select("k", (F.col("_groups") + F.col("_slot")).cast("int").alias("slot"), "idx"))


def shuffle_picks(picks: DataFrame, seed: int) -> DataFrame:
    """Reorders the picks of each sample by a draw and numbers them: (k, j, idx). Pick 0 is the 0 dB reference."""
    order = F.struct(draw(seed, "order", F.col("k"), F.col("idx")).alias("draw"), F.col("idx"))
    lists = picks.groupBy("k").agg(F.sort_array(F.collect_list(order)).alias("_picks"))
    return lists.select("k", F.posexplode("_picks").alias("j", "_pick")).select("k", "j", F.col("_pick.idx").alias("idx"))


def pick_noises(
    samples: DataFrame, pool: DataFrame, seed: int, mode: str, required: Sequence[str] = (), count: str = "n"
) -> DataFrame:
    """Noise picks of every sample, (k, j, idx) over a numbered pool.

    One file per required category; the others come only from the remaining categories, by ``mode``.
    """
    if not required:
        if mode == "any":
            return shuffle_picks(pick_any(samples, pool, seed, count), seed)
        return shuffle_picks(pick_distinct_categories(samples, pool_groups(pool), seed, mode, count), seed)
    groups = pool_groups(pool)
    is_required = F.coalesce(F.col("category").isin(list(required)), F.lit(False))
    wanted = groups.where(is_required)
    # The wanted categories are named in the configuration, so this list is as short as the configuration.
    listed = wanted.agg(F.collect_list(F.struct("start", "files", "group_idx")).alias("_wanted"))
    rows = beside(samples.select("k", F.col(count).alias("n")), listed)
    first = rows.select("k", F.explode("_wanted").alias("g")).select(
        "k", (F.col("g.start") + below(draw(seed, "file", F.col("k"), F.col("g.group_idx")), F.col("g.files"))).alias("idx")
    )
    others = pool.where(~is_required).withColumnRenamed("idx", "pool_idx")
    others = ordered_index(others, ["pool_idx"], "idx")
    extra = rows.select("k", (F.col("n") - F.size("_wanted")).alias("n")).where(F.col("n") > 0)
    if mode == "any":
        more = pick_any(extra, others, seed)
    else:
        more = pick_distinct_categories(extra, pool_groups(others), seed, mode)
        if mode == "require_different":
            complete = more.groupBy("k").agg(F.count(F.lit(1)).alias("got")).join(extra, "k").where("got = n").select("k")
            first = first.join(extra.join(complete, "k", "left_anti"), "k", "left_anti")
    more = more.join(others.select("idx", "pool_idx"), "idx").select("k", F.col("pool_idx").alias("idx"))
    return shuffle_picks(first.unionByName(more), seed)


def plan_noise_chunks(rows: DataFrame, seed: int, policy: str = "loop") -> DataFrame:
    """Source ranges that cover ``need`` samples of a source with ``length`` samples, exploded.

    A long source gives one random range; a short one is looped from a random start, or rejected by the policy.
    Adds source_start_sample, source_end_sample, destination_start_sample and looped.
    """
    length, need = F.col("length"), F.col("need")
    value = draw(seed, "chunk", F.col("k"), F.col("j"))
    if policy == "reject":
        rows = rows.where(length >= need)
    first = F.when(length >= need, value % F.greatest(length - need + 1, F.lit(1))).otherwise(value % length)
    staged = rows.where(length > 0).withColumn("_first", first).withColumn("_head", F.least(length - F.col("_first"), need))
    more = F.when(length >= need, F.lit(0)).otherwise(F.ceil((need - F.col("_head")) / length))
    staged = staged.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), more.cast("bigint"))))
    is_head = F.col("_i") == 0
    offset = F.when(is_head, F.lit(0)).otherwise(F.col("_head") + (F.col("_i") - 1) * length).cast("bigint")
    start = F.when(is_head, F.col("_first")).otherwise(F.lit(0)).cast("bigint")
    size = F.when(is_head, F.col("_head")).otherwise(F.least(length, need - F.col("_offset")))
    return (
        staged.withColumn("_offset", offset)
        .withColumn("source_start_sample", start)
        .withColumn("source_end_sample", (start + size).cast("bigint"))
        .withColumn("destination_start_sample", (F.col("start_sample") + F.col("_offset")).cast("bigint"))
        .withColumn("looped", length < need)
        .drop("_first", "_head", "_i", "_offset")
    )


def plan_impulsive_events(rows: DataFrame, seed: int, count: tuple[int, int], duration: tuple[int, int]) -> DataFrame:
    """Short events of a source scattered over ``sample_length`` samples, one row per event; events may overlap.

    The length of an event is clamped to what the source and the sample offer.
    """
    k, j = F.col("k"), F.col("j")
    n = between(draw(seed, "events", k, j), F.lit(count[0]), F.lit(count[1]))
    events = rows.withColumn("event", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))
    e = F.col("event")
    wanted = between(draw(seed, "duration", k, j, e), F.lit(duration[0]), F.lit(duration[1]))
    size = F.greatest(F.lit(1), F.least(wanted, F.col("length"), F.col("sample_length")))
    events = events.withColumn("_size", size.cast("bigint"))
    source = draw(seed, "source", k, j, e) % (F.col("length") - F.col("_size") + 1)
    target = draw(seed, "target", k, j, e) % (F.col("sample_length") - F.col("_size") + 1)
    return (
        events.withColumn("source_start_sample", source.cast("bigint"))
        .withColumn("source_end_sample", (source + F.col("_size")).cast("bigint"))
        .withColumn("destination_start_sample", target.cast("bigint"))
        .drop("_size")
    )


def first_valid_attempt(
    plan: DataFrame, evaluate: Callable[[DataFrame], DataFrame], max_attempts: int
) -> tuple[DataFrame, DataFrame]:
    """Attempts in waves: only samples without a valid attempt go into the next one.

    ``evaluate`` gets the samples with an ``attempt`` column and returns them with ``rejection`` (null when valid).
    Every wave is checkpointed, so the lineage stays flat and a lost executor does not redo earlier waves. Returns the
    winners and the log of all rejected attempts; a sample that never wins is only in the log.
    """
    winners, failures, rest = None, None, plan
    for attempt in range(max_attempts):
        wave = settled(evaluate(rest.withColumn("attempt", F.lit(attempt))))
        won, lost = wave.where(F.col("rejection").isNull()).drop("rejection"), wave.where(F.col("rejection").isNotNull())
        winners = won if winners is None else winners.unionByName(won)
        failures = lost if failures is None else failures.unionByName(lost)
        if lost.isEmpty():
            break
        rest = lost.select(*plan.columns)
    return winners, failures
