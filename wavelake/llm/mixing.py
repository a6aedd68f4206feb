"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import uniform_draw, word_count
from wavelake.session import cut_lineage

SALTS = 32


def source_targets(
    sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2
) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, take the weights in turn and divide ``share`` of all sizes. A target stops
    at ``most`` times its source's size and the excess goes to the others by weight, until none is above: target =
    min(cap, weight x level), where the level is the largest one that any number of capped sources leaves to the rest.
    The windows hold one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1)
    caps = sizes.withColumn("weight", turn.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    tightest_first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(tightest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(tightest_first.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - before) / left
    return (
        caps.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def _same_source(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _attach(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Joins one row for each source to rows that carry a salt; a hot source spreads over the salts."""
    spread = per_source.withColumnRenamed("source", "_source").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    on = (F.col("salt") == F.col("_salt")) & _same_source(F.col("source"), F.col("_source"))
    return rows.join(spread, on, how).drop("_source", "_salt")


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    most: int = 2,
    power: float = 0.5,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often each document enters the mix.

    A source with target t and size s first takes floor(t / s) whole copies of every document. The rest, r words, is a
    Pareto order sample of fixed size in words: document i has the inclusion odds p / (1 - p) of p = min(1, c x
    size^power), where c makes the expected words equal r, and documents enter in the order of (random odds) /
    (inclusion odds), as long as they fit into r. Then the one document left whose size is nearest to the words still
    open enters, if it brings the total nearer. Longer documents come earlier, so what remains open is small.

    Scale: texts are read once, to (doc_id, source, size). The order is never sorted as a whole: each source has about
    sqrt(n) cells of the odds ratio; sums of cells find the cell with the cut and only that cell is ranked. Windows
    hold one row for each source, each distinct size or cell of a source, or the rows of one cell.

    Null or empty texts have size 0, are taken with the certain copies and never sampled. Null sources form a source.
    The draw depends on the seed and doc_id, so reruns agree, and rows that repeat a doc_id are drawn alike; ties go to
    the lower doc_id. An empty table gives an empty result. Other columns are ignored.
    """
    sized = cut_lineage(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = histogram.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    targets = source_targets(sizes.select("source", "source_size"), share, weights, most)
    targets = targets.withColumn(
        "whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = cut_lineage(
        targets.alias("t")
        .join(sizes.alias("z"), _same_source(F.col("t.source"), F.col("z.source")))
        .select("t.*", "z.n_docs")
    )

    # c: the largest level that any number of certain (largest) sizes leaves to the smaller ones.
    largest_first = Window.partitionBy("source").orderBy(F.desc("size"))
    bulk = F.col("n") * F.col("size")
    lean = bulk * F.pow(F.col("size").cast("double"), F.lit(power))
    levels = (
        histogram.alias("h")
        .where("size > 0")
        .join(targets.alias("t"), _same_source(F.col("h.source"), F.col("t.source")))
        .select("h.*", "t.rest")
        .withColumn(
            "certain", F.coalesce(F.sum(bulk).over(largest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        .withColumn("leaning", F.sum(lean).over(largest_first.rowsBetween(0, Window.unboundedFollowing)))
        .groupBy("source")
        .agg(F.max((F.col("rest") - F.col("certain")) / F.col("leaning")).alias("c"))
    )
    params = (
        targets.alias("t")
        .join(levels.alias("v"), _same_source(F.col("t.source"), F.col("v.source")), "left")
        .select("t.*", F.coalesce("v.c", F.lit(0.0)).alias("c"))
    )
    odds = lambda p: p / (1 - p)
    p = F.least(F.lit(1.0), F.col("c") * F.pow(F.col("size").cast("double"), F.lit(power)))
    u = uniform_draw(seed, F.col("doc_id"))
    rank = F.when(F.col("p") >= 1, 0.0).when((F.col("p") > 0), odds(u) / odds(F.col("p")))
    middle = (F.col("source_size") - F.col("rest")) / F.col("rest")  # inverse odds of the mean rate
    cells = F.ceil(F.sqrt("n_docs"))
    keyed = cut_lineage(
        _attach(sized, params)
        .withColumn("p", F.when((F.col("rest") > 0) & (F.col("size") > 0), p).otherwise(0.0))
        .withColumn("q", rank)
        .withColumn("cell", F.least(F.floor(F.col("q") / (F.col("q") + middle) * cells), cells - 1))
        .select("doc_id", "source", "size", "salt", "source_size", "target", "whole", "rest", "q", "cell")
    )
    drawn = keyed.where(F.col("q").isNotNull())

    in_order = Window.partitionBy("source").orderBy("cell")
    filled = drawn.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    cut_cells = (
        filled.withColumn("upto", F.sum("words").over(in_order))
        .where("upto > rest")
        .groupBy("source")
        .agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), "cell").alias("cut"))
    )
    ranked = Window.partitionBy("source").orderBy("q", "doc_id")
    last_in = (
        _attach(drawn, cut_cells)
        .where(F.col("cell") == F.col("cut.cell"))
        .withColumn("upto", F.col("cut.before") + F.sum("size").over(ranked))
        .groupBy("source")
        .agg(
            F.first("cut").alias("cut"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("q", "doc_id"))).alias("last"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("upto"),
        )
        .select(
            "source",
            F.col("cut.cell").alias("cut_cell"),
            F.col("last.q").alias("last_q"),
            F.col("last.doc_id").alias("last_id"),
            F.coalesce("upto", "cut.before").alias("got"),
        )
    )
    before_last = (F.col("q") < F.col("last_q")) | (
        (F.col("q") == F.col("last_q"))
        & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("last_id"), F.lit(False)))
    )
    entered = F.coalesce(
        F.col("q").isNotNull()
        & (
            F.col("cut_cell").isNull()  # the whole source fits
            | (F.col("cell") < F.col("cut_cell"))
            | ((F.col("cell") == F.col("cut_cell")) & F.coalesce(before_last, F.lit(False)))
        ),
        F.lit(False),
    )
    marked = _attach(keyed, last_in, "left").withColumn("entered", entered)
    gap = F.col("rest") - F.col("got")
    fits = (
        marked.where(~F.col("entered") & F.col("q").isNotNull() & (F.abs(F.col("size") - gap) < gap))
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("miss"), "q", "doc_id")).alias("fit"))
    )
    is_fit = F.coalesce(
        ~F.col("entered") & (F.col("q") == F.col("fit.q")) & F.col("doc_id").eqNullSafe(F.col("fit.doc_id")), F.lit(False)
    )
    copies = F.col("whole") + (F.col("entered") | is_fit).cast("long")
    return (
        _attach(marked, fits, "left")
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.col("copies").cast("long").alias("copies"),
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        )
    )


#: DuckDB SQL for the rows of ``mix_sources`` with its default parameters.
SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), caps AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight,
    CAST(2 * source_size AS DOUBLE) AS cap
  FROM sizes
), levels AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps
), targets AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels
), shares AS (
  SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM targets
), rests AS (
  SELECT *, target - whole * source_size AS rest FROM shares
), histogram AS (
  SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size
), inclusion AS (
  SELECT h.source, r.rest,
    coalesce(sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
    sum(n * size * sqrt(size)) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS leaning
  FROM histogram h JOIN rests r ON h.source IS NOT DISTINCT FROM r.source
), leads AS (
  SELECT source, max((rest - certain) / leaning) AS c FROM inclusion GROUP BY source
), drawn AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.whole, r.rest,
    CASE WHEN r.rest > 0 AND s.size > 0 THEN least(1.0, l.c * sqrt(s.size)) ELSE 0 END AS p,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN leads l ON s.source IS NOT DISTINCT FROM l.source
), ordered AS (
  SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN (CAST(u AS DOUBLE) / (1 - u)) / (p / (1 - p)) END AS q FROM drawn
), prefix AS (
  SELECT *, coalesce(q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id) <= rest, false) AS entered
  FROM ordered
), open AS (
  SELECT *, rest - sum(CASE WHEN entered THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM prefix
), fits AS (
  SELECT *, NOT entered AND q IS NOT NULL AND abs(size - gap) < gap AS can FROM open
), chosen AS (
  SELECT *, can AND rank() OVER (PARTITION BY source, can ORDER BY abs(size - gap), q, doc_id) = 1 AS fit FROM fits
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST((whole + CASE WHEN entered OR fit THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM chosen
"""
