"""Ordered operators: selection, running values, ids, permutations, naming. Groups of any size; see plans.ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelake.operators.rules import eligible
from wavelake.plans.ordered import (
    BLOCK,
    block_of,
    block_totals,
    index_within,
    ordered_index,
    ordered_lag,
    ordered_prefix,
    ordered_rank,
    ordered_running,
)
from wavelake.plans.totals import beside


def select_lowest_per_cell(rows: DataFrame) -> DataFrame:
    """Per (category, target SNR) the usable ``val_pool`` row with the lowest index becomes ``val_select``."""
    candidates = rows.where((F.col("role") == "val_pool") & eligible())
    chosen = (
        candidates.groupBy("category", "target_snr_db")
        .agg(F.min(F.struct("index", "mixture_id")).alias("_first"))
        .select(F.col("_first.mixture_id").alias("mixture_id"), F.lit(True).alias("_chosen"))
    )
    joined = rows.join(chosen, "mixture_id", "left")
    hit = F.col("_chosen").isNotNull() & (F.col("role") == "val_pool") & eligible()
    return joined.withColumn("role", F.when(hit, "val_select").otherwise(F.col("role"))).drop("_chosen")


def best_so_far(log: DataFrame, keys: Sequence[str], order: str = "step") -> DataFrame:
    """Adds ``best``: the loss is below every earlier loss of the run. The first row of a run is its baseline."""
    rows = ordered_running(log, keys, [order], "loss", "min", "_least", inclusive=False)
    return rows.withColumn("best", F.coalesce(F.col("loss") < F.col("_least"), F.lit(False))).drop("_least")


def analysis_frames(hops: DataFrame, keys: Sequence[str], column: str = "x") -> DataFrame:
    """Frame = previous hop followed by the current hop; before the first hop there are zeros."""
    zeros = F.transform(F.col(column), lambda v: v * F.lit(0.0))
    rows = ordered_lag(hops.withColumn("_zeros", zeros), keys, ["frame"], {"_previous": column})
    previous = F.coalesce("_previous", "_zeros")
    return rows.withColumn(column, F.concat(previous, F.col(column))).drop("_previous", "_zeros")


def previous_mask(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``prev_mask``: the mask of the previous frame, 1 before the first frame."""
    return ordered_lag(masks, keys, ["frame"], {"prev_mask": "mask"}, {"prev_mask": F.lit(1.0)})


def deep_filter(bins: DataFrame, taps: DataFrame, order: int = 5, lookahead: int = 2) -> DataFrame:
    """Complex FIR over the frames of each bin: tap ``o`` of a frame weighs frame - (order - 1 - lookahead) + o.

    ``taps`` has (signal_id, frame, bin, tap, c_re, c_im). Frames outside the signal weigh as zero, so an inner join is
    exact; the sum pre-aggregates. Bins of a frame without taps pass through unchanged.
    """
    reach = taps.withColumn("_source", F.col("frame") - (order - 1 - lookahead) + F.col("tap"))
    source = bins.select("signal_id", F.col("frame").alias("_source"), "bin", "re", "im")
    joined = reach.join(source, ["signal_id", "_source", "bin"])
    re = F.col("re") * F.col("c_re") - F.col("im") * F.col("c_im")
    im = F.col("re") * F.col("c_im") + F.col("im") * F.col("c_re")
    filtered = joined.groupBy("signal_id", "frame", "bin").agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))
    at = ["signal_id", "frame", "bin"]
    # Where a frame has taps but all of them reach outside the signal, the output is zero, not the input.
    tapped = taps.select(*at).distinct().withColumn("_tapped", F.lit(True))
    rows = bins.select(*at, "re", "im").join(tapped, at, "left").join(filtered, at, "left")
    value = lambda part: F.when(F.col("_tapped"), F.coalesce(f"_{part}", F.lit(0.0))).otherwise(F.col(part)).alias(part)
    return rows.select(*at, value("re"), value("im"))


def collision_free_names(files: DataFrame) -> DataFrame:
    """Flat target names: the first file of a name keeps it, later ones get ``_1``, ``_2`` and so on, in path order.

    Numbers whose name some file already carries are left out, so no two targets are equal. The r-th repeat takes the
    r-th free number, found by a running count of the taken numbers below it.
    """
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    base = F.expr("substring(name, 1, length(name) - length(ext))")
    named = files.select("path", name.alias("name")).withColumn("ext", ext).withColumn("base", base)
    ranked = index_within(named, ["name"], ["path"], "repeat")
    first, repeats = ranked.where("repeat = 0"), ranked.where("repeat > 0")

    number = F.regexp_extract("base", r"^(?s:.*)_([1-9][0-9]{0,17})$", 1)
    shorter = F.expr("substring(base, 1, length(base) - length(number) - 1)")
    numbered = first.withColumn("number", number).where(F.col("number") != "")
    numbered = numbered.select(shorter.alias("base"), "ext", F.col("number").cast("bigint").alias("number"))
    taken = numbered.join(repeats.select("base", "ext").distinct(), ["base", "ext"], "left_semi")
    taken = index_within(taken, ["base", "ext"], ["number"], "ahead")

    # A taken number with `ahead` taken numbers below it shifts every repeat from number - ahead on.
    events = repeats.select("base", "ext", F.col("repeat").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("taken"), "path", "repeat").unionByName(
        taken.select("base", "ext", (F.col("number") - F.col("ahead")).alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("taken")),
        allowMissingColumns=True,
    )
    counted = ordered_running(
        events.withColumn("block", block_of(F.col("at"))), ["base", "ext"], ["at", "kind", "taken", "path"], "taken", "sum", "shift"
    ).where("kind = 1")
    suffix = (F.col("repeat") + F.col("shift")).cast("bigint").cast("string")
    renamed = counted.select("path", F.concat("base", F.lit("_"), suffix, "ext").alias("target"))
    return first.select("path", F.col("name").alias("target")).unionByName(renamed)


def sequential_ids(splits: DataFrame, chunk: int = BLOCK) -> DataFrame:
    """Global 1-based ids across ordered splits: (k, split). ``splits`` has (split, split_ord, count).

    A split is first cut into chunks of ids, which are spread over tasks, and only then unrolled.
    """
    ranges = ordered_prefix(splits.where(F.col("count") > 0), ["split_ord"], "count", "_earlier")
    ranges = ranges.withColumn("_start", F.col("_earlier") + 1)
    ranges = ranges.withColumn("_end", (F.col("_start") + F.col("count") - 1).cast("bigint"))
    chunks = ranges.select("split", "_end", F.explode(F.sequence("_start", "_end", F.lit(chunk).cast("bigint"))).alias("_at"))
    chunks = chunks.repartition("split", "_at")
    return chunks.select("split", F.explode(F.sequence("_at", F.least("_end", F.col("_at") + chunk - 1))).alias("k"))


def planned_ids(spark: SparkSession, splits: dict[str, int]) -> DataFrame:
    """`sequential_ids` for splits given as a dict, from a distributed range."""
    total = sum(int(n) for n in splits.values())
    label, upto = F.lit(None).cast("string"), total
    for split, count in reversed(list(splits.items())):
        label = F.when(F.col("k") <= upto, F.lit(split)).otherwise(label)
        upto -= int(count)
    return spark.range(1, total + 1).toDF("k").withColumn("split", label)


def epoch_order(rows: DataFrame, key: str, seed: int, epochs: int, batch_size: int) -> DataFrame:
    """A seeded permutation per epoch: adds epoch, within, position and step (batch number).

    Rows are ordered by the MD5 of seed, epoch and id. The leading hex digits of the MD5 are the block, and they are
    even by construction, so no task sorts a whole epoch.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string"))
    spread = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_draw", F.md5(text))
    spread = spread.withColumn("block", F.conv(F.substring("_draw", 1, 4), 16, 10).cast("bigint"))
    ranked = ordered_rank(spread, ["epoch"], ["_draw", key], "within").drop("_draw", "block")
    placed = beside(ranked, rows.agg(F.count(F.lit(1)).alias("_n")))
    placed = placed.withColumn("position", F.col("epoch") * F.col("_n") + F.col("within")).drop("_n")
    return placed.withColumn("step", F.floor(F.col("position") / batch_size).cast("bigint"))


def weight_smoothness(weights: DataFrame, keys: Sequence[str], per: Sequence[str]) -> DataFrame:
    """Mean squared frame-to-frame change of the weight of each (signal, band, expert), averaged per ``per``."""
    rows = ordered_lag(weights, keys, ["frame"], {"_previous": "w"})
    change = F.col("w") - F.col("_previous")
    return rows.groupBy(*per).agg(F.avg(change * change).alias("smoothness"))


def bad_step_budget(log: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """Per run the number of non-finite steps and the first step at which they exceed the budget (null if never)."""
    loss = F.col("loss")
    bad = (F.isnan(loss) | (F.abs(loss) == float("inf"))).cast("int")
    rows = ordered_running(log.withColumn("_bad", bad), keys, ["step"], "_bad", "sum", "_upto")
    return rows.groupBy(*keys).agg(
        F.sum("_bad").alias("bad_steps"), F.min(F.when(F.col("_upto") > budget, F.col("step"))).alias("stop_step")
    )


def progress(commits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At each commit: done so far, rate per second since the first commit, and seconds left (null before a rate exists).

    ``commits`` has (keys, commit_id, at_seconds, total, block).
    """
    rows = ordered_rank(commits, keys, ["at_seconds", "commit_id"], "_rank")
    # The largest negated time is the first commit of the run.
    rows = block_totals(rows, keys, maxima={"_began": -F.col("at_seconds")})
    done = (F.col("_rank") + 1).alias("done")
    elapsed = F.col("at_seconds") + F.col("_began")
    rows = rows.select(*keys, "commit_id", "total", done, F.when(elapsed > 0, (F.col("_rank") + 1) / elapsed).alias("rate"))
    return rows.withColumn("eta_seconds", (F.col("total") - F.col("done")) / F.col("rate"))


def softmax_weights(logits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Softmax over the experts of each group. A group holds one row per expert, so its size is the expert count."""
    window = Window.partitionBy(*keys)
    raised = F.exp(F.col("logit") - F.max("logit").over(window))
    rows = logits.withColumn("_raised", raised)
    return rows.withColumn("w", F.col("_raised") / F.sum("_raised").over(window)).drop("_raised")


def mask_disagreement(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population standard deviation of the expert masks of each (frame, band)."""
    return masks.groupBy(*keys).agg(F.stddev_pop("mask").alias("disagreement"))


def deterministic_order(files: DataFrame, path: str = "rel") -> DataFrame:
    """Stable 0-based index of every file by its path in byte order."""
    return ordered_index(files, [path], "idx")


def limit_first(rows: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in order; 0 means all. The limit is the feature; it plans as a top-n without a full sort."""
    ordered = rows.orderBy(*order)
    return ordered.limit(n) if n else ordered


def oversample(rows: DataFrame, condition: Column, times: int) -> DataFrame:
    """Repeats the matching rows; ``copy`` numbers the copies from 0."""
    copies = F.when(F.coalesce(condition, F.lit(False)), times).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
