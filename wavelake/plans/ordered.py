"""Ordered work inside groups of any size.

A signal, category or user may hold a large share of all rows, so no window here puts a whole group of raw rows into
one task. Rows are split by (key, block), where ``block`` grows with the order; a small table with one row per
(key, block) carries what crosses a block boundary. Results are exact: blocks change the plan, never the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.session import settled

BLOCK = 65_536


def block_of(position: Column, size: int = BLOCK) -> Column:
    """Block number of an integer position."""
    return F.floor(position / F.lit(size)).cast("bigint")


def with_block(df: DataFrame, position: str = "t", size: int = BLOCK) -> DataFrame:
    return df.withColumn("block", block_of(F.col(position), size))


def _row_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "block").orderBy(*order)


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named columns in which null matches null; keeps the columns of ``left`` once."""
    names = {c: f"_on{i}" for i, c in enumerate(on)}
    renamed = right.withColumnsRenamed(names)
    return left.join(renamed, null_safe(list(names), list(names.values())), how).drop(*names.values())


def _earlier_blocks(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions the groups of a NumPy step over all shuffle partitions.

    Such steps are heavy for their size in bytes, and a given partition count keeps adaptive execution from joining
    them into a few tasks. The following ``groupBy`` on the same keys needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def packed_groups(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each group with its ``values`` as arrays in one order that is not fixed; groups have a bounded size.

    A NumPy step reads such rows in batches; a call for each group would cost far more than the work on a short one.
    """
    rows = spread_groups(df, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("_s"))
    return rows.select(*keys, *[F.col(f"_s.{name}").alias(name) for name in values])


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row inside its key. ``df`` has a ``block`` column that grows with the order."""
    starts = (
        df.groupBy(*keys, "block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "block", F.coalesce(F.sum("_rows").over(_earlier_blocks(keys)), F.lit(0)).alias("_before"))
    )
    placed = join_on(df.withColumn("_at", F.row_number().over(_row_window(keys, order))), starts, [*keys, "block"])
    return placed.withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("bigint")).drop("_at", "_before")


def ordered_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], first: dict[str, Column] | None = None
) -> DataFrame:
    """Adds the value of the previous row of the key: ``values`` maps new column names to source columns."""
    first = first or {}
    last_rows = df.groupBy(*keys, "block").agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), F.struct(*order)).alias("_last")
    )
    carried = last_rows.select(
        *keys, "block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("block")).alias("_carried")
    )
    window = _row_window(keys, order)
    staged = df.withColumn("_at", F.row_number().over(window))
    for name, source in values.items():
        staged = staged.withColumn(name, F.lag(source).over(window))
    joined = join_on(staged, carried, [*keys, "block"])
    for name in values:
        edge = F.col("_carried")[name]
        if name in first:
            edge = F.when(F.col("_carried").isNull(), first[name]).otherwise(edge)
        joined = joined.withColumn(name, F.when(F.col("_at") == 1, edge).otherwise(F.col(name)))
    return joined.drop("_at", "_carried")


def ordered_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    how: str,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``max``, ``min`` or ``sum`` of ``column`` over the rows of the key up to (or before) this one."""
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    frame = _row_window(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    carried = (
        df.groupBy(*keys, "block")
        .agg(agg(column).alias("_total"))
        .select(*keys, "block", agg("_total").over(_earlier_blocks(keys)).alias("_carried"))
    )
    joined = join_on(df.withColumn("_local", agg(column).over(frame)), carried, [*keys, "block"])
    if how == "sum":
        merged = F.coalesce(F.col("_local") + F.col("_carried"), F.col("_local"), F.col("_carried"))
    else:
        merged = {"max": F.greatest, "min": F.least}[how]("_local", "_carried")
    return joined.withColumn(name, merged).drop("_local", "_carried")


def fold_blocks(
    blocks: DataFrame, keys: Sequence[str], begin: Callable, step: Callable, columns: str, backward: bool = False
) -> DataFrame:
    """Carries a state over the blocks of each key in order, or in reverse: rows (keys, block, ``columns``).

    ``blocks`` has one row for each (key, block). ``begin()`` is the state before a key's first block, and
    ``step(state, row)`` gives the state after a block and the values of ``columns``. The rows of a key stream through one
    task with nothing but the state in memory; they are as many as the key has blocks.
    """
    head = [blocks.schema[c] for c in (*keys, "block")]
    schema = T.StructType([*head, *T.StructType.fromDDL(columns).fields])
    whole = {f.name for f in head if isinstance(f.dataType, T.IntegralType)}

    def plain_value(name: str, value):
        if value is None or value != value:  # a null of a numeric column arrives as NaN
            return None
        return int(value) if name in whole else value

    def run(batches):
        last, state = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                key = tuple(plain_value(k, getattr(row, k)) for k in keys)
                if (key,) != last:
                    last, state = (key,), begin()
                state, values = step(state, row)
                rows.append((*key, int(row.block), *values))
            yield pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(schema.fields)})

    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys, F.desc("block") if backward else "block")
    return ordered.mapInPandas(run, schema)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gives every row the per-key columns of ``stats`` (one row per key), in two joins.

    ``stats`` first spreads over the distinct (key, block) pairs, then meets the rows on (key, block), so a key with a
    large share of all rows is spread over its blocks instead of landing in one join task.
    """
    spread = join_on(df.select(*keys, "block").distinct(), stats, keys)
    return join_on(df, spread, [*keys, "block"])


def block_totals(
    df: DataFrame, keys: Sequence[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None
) -> DataFrame:
    """Attaches per-key sums and maxima to every row, and the row count of the key as ``_n``.

    One pass makes partial results per (key, block); those few rows are totalled per key and meet the rows again on
    (key, block), so neither step puts a whole key into one task.
    """
    sums, maxima = sums or {}, maxima or {}
    partial = df.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(column).alias(name) for name, column in sums.items()],
        *[F.max(column).alias(name) for name, column in maxima.items()],
    )
    whole = Window.partitionBy(*keys)
    totals = partial.select(
        *keys,
        "block",
        *[F.sum(name).over(whole).alias(name) for name in ["_n", *sums]],
        *[F.max(name).over(whole).alias(name) for name in maxima],
    )
    return join_on(df, totals, [*keys, "block"])


def ordered_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """0-based index of every row in one total order over the whole table.

    Rows are range-partitioned and sorted, and written with their partition and their number in it, so that both refer
    to the same split as the number of rows of all earlier partitions. The offsets table has one row
    per partition.
    """
    parts = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33))
    )
    parts = settled(parts)
    offsets = (
        parts.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
        )
    )
    # One row per partition of the sort, so the size of the broadcast side is bounded by the partition count.
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_part", "_at", "_before")
    )


def ordered_prefix(df: DataFrame, order: Sequence[str | Column], column: str, name: str) -> DataFrame:
    """Sum of ``column`` over all earlier rows of one total order over the whole table; see `ordered_index`."""
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.sum(column).alias("_total")).select(
        "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("_at", F.coalesce(F.sum(column).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_part", "_at", "_before")
    )


def index_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """0-based index of every row inside its key, for orders that offer no natural block column.

    Uses the total order (keys, order); a key that fills many partitions stays spread over them.
    """
    total = ordered_index(df, [*keys, *order], "_total")
    rows = total.withColumn("block", block_of(F.col("_total")))
    names = [f"_key{i}" for i in range(len(keys))]
    starts = rows.groupBy(*keys).agg(F.min("_total").alias("_start"))
    blocks = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("block").alias("_block")).distinct()
    placed = blocks.join(starts, null_safe(names, keys)).select(*names, "_block", "_start")
    joined = rows.join(placed, null_safe(names, keys) & (F.col("block") == F.col("_block")))
    return joined.select(*df.columns, (F.col("_total") - F.col("_start")).alias(name))


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equi-join condition over differently named columns that also matches null with null."""
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def merge_intervals(
    intervals: DataFrame, keys: Sequence[str], gap: int, min_length: int = 0, block_size: int = BLOCK
) -> DataFrame:
    """Joins half-open intervals (``start_sample``, ``end_sample``) of a key whose gap is strictly below ``gap``.

    Merged intervals shorter than ``min_length`` are dropped. The number of merged intervals of a key is not bounded.
    """
    order = ["start_sample", "end_sample"]
    # Intervals are far fewer than the rows they come from, and the steps below read them several times.
    rows = with_block(settled(intervals.select(*keys, *order)), "start_sample", block_size)
    rows = ordered_running(rows, keys, order, "end_sample", "max", "_reach", inclusive=False)
    opens = F.col("_reach").isNull() | (F.col("start_sample") - F.col("_reach") >= gap)
    rows = rows.withColumn("_opening", F.when(opens, F.col("start_sample")))
    rows = ordered_running(rows, keys, order, "_opening", "max", "_island")
    return (
        rows.groupBy(*keys, "_island")
        .agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"))
        .drop("_island")
        .where(F.col("end_sample") - F.col("start_sample") >= min_length)
    )


def true_runs(df: DataFrame, keys: Sequence[str], position: str, flag: str, min_run: int = 1) -> DataFrame:
    """Maximal runs of rows with a true ``flag`` at consecutive integer positions, as half-open intervals.

    Runs are found inside each block first; runs that touch across a block boundary are then merged.
    """
    marked = df.where(F.col(flag))
    local = marked.withColumn(
        "_group", F.col(position) - F.row_number().over(Window.partitionBy(*keys, "block").orderBy(position))
    )
    pieces = local.groupBy(*keys, "block", "_group").agg(
        F.min(position).alias("start_sample"), (F.max(position) + 1).alias("end_sample")
    )
    return merge_intervals(pieces, keys, 1, min_run)


#: Accuracy of the quantile sketch: the rank of a splitter is off by one in ACCURACY of the rows at most.
ACCURACY = 10_000


def exact_percentile(df: DataFrame, keys: Sequence[str], column: str, q: float, name: str) -> DataFrame:
    """Exact percentile with linear interpolation, one row per key, for groups of any size and any distribution.

    A mergeable quantile sketch gives each key a ladder of splitters around the wanted rank, from the least value to the
    largest; one pass counts the rows below and up to each splitter exactly. The two wanted order statistics lie between
    the closest splitters that enclose them, so only the distinct values between these two - a small share of the rows,
    whatever outliers there are - are ranked by their counts. Null keys form a group; null values and NaN are left out.
    All three steps have to see the same bits, and a sum after a shuffle may differ in its last one each time it is taken,
    so the values are written once.
    """
    values = df.select(*keys, F.col(column).cast("double").alias("_value"))
    values = settled(values.where(F.col("_value").isNotNull() & ~F.isnan("_value")))
    near, far = 3.0 / ACCURACY, 300.0 / ACCURACY
    steps = [0.0, *(min(max(q + d, 0.0), 1.0) for d in (-far, -near, near, far)), 1.0]
    ladder = values.groupBy(*keys).agg(
        F.percentile_approx("_value", steps, ACCURACY).alias("_inner"),
        F.min("_value").alias("_least"),
        F.max("_value").alias("_most"),
        F.count(F.lit(1)).alias("_n"),
    )
    splitters = F.concat(F.array("_least"), "_inner", F.array("_most"))
    target = F.lit(q) * (F.col("_n") - 1)
    ladder = ladder.select(*keys, splitters.alias("_s"), target.alias("_target"))
    laid = join_on(values, ladder, keys)
    places = range(len(steps) + 2)
    below = [F.count_if(F.col("_value") < F.col("_s")[i]).alias(f"_b{i}") for i in places]
    upto = [F.count_if(F.col("_value") <= F.col("_s")[i]).alias(f"_u{i}") for i in places]
    counts = laid.groupBy(*keys).agg(F.first("_s").alias("_s"), F.first("_target").alias("_target"), *below, *upto)
    low, high = F.floor("_target"), F.ceil("_target")
    # The tightest splitters with the lower order statistic not below and the upper one not above them.
    start = F.greatest(*[F.when(F.col(f"_b{i}") <= low, F.struct(F.col("_s")[i].alias("v"), F.col(f"_b{i}").alias("n"))) for i in places])
    end = F.least(*[F.when(F.col(f"_u{i}") > high, F.col("_s")[i]) for i in places])
    bounds = counts.select(*keys, "_target", start.alias("_start"), end.alias("_end"))
    between = join_on(values, bounds, keys).where(F.col("_value").between(F.col("_start.v"), F.col("_end")))
    ranked = between.groupBy(*keys, "_value").agg(
        F.count(F.lit(1)).alias("_times"), F.first("_target").alias("_target"), F.first("_start.n").alias("_before")
    )
    running = F.sum("_times").over(Window.partitionBy(*keys).orderBy("_value"))
    ranked = ranked.withColumn("_upto", F.col("_before") + running)
    lo = F.min(F.when(F.col("_upto") > low, F.col("_value")))
    hi = F.min(F.when(F.col("_upto") > high, F.col("_value")))
    share = F.max(F.col("_target") - low)
    return ranked.groupBy(*keys).agg(F.when(share > 0, lo + (hi - lo) * share).otherwise(lo).alias(name))
