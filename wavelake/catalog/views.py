"""Views of the given tables in the shapes the operators work on, in Spark and as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.plans.ordered import ordered_rank, with_block

SIG_SAMPLES = (
    "sig_samples AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, "
    "(value - 50) / 500 AS x, event_type = 'error' AS flag FROM events)"
)
SIG_PAIRS = (
    "sig_pairs AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, "
    "(value - 50) / 500 AS clean, "
    "(value - 50) / 500 + ((event_id * 7919) % 101 - 50) / CAST(1000 AS DOUBLE) AS noisy, "
    "(value - 50) / 500 + ((event_id * 104729) % 61 - 30) / CAST(2000 AS DOUBLE) AS est FROM events)"
)
FRAMES = (
    "frames AS (SELECT label AS signal_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, "
    "embedding AS x FROM embeddings)"
)
# One row per (frame, bin): 64 values as positions 0 .. 63.
FRAME_BINS = (
    FRAMES + ", frame_bins AS (SELECT signal_id, frame, i - 1 AS bin, CAST(x[i] AS DOUBLE) AS v "
    "FROM (SELECT signal_id, frame, x, unnest(range(1, 65)) AS i FROM frames))"
)
SOURCES = (
    "sources AS (SELECT concat('wav/', source, '/', lang, '/', doc_id, '.wav') AS rel, n_chars AS size, "
    "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS category, doc_id FROM documents)"
)
RECORDS = (
    "records AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, "
    "o_custkey AS clean_source, o_totalprice / 10000 - 5 AS target_snr_db, "
    "o_totalprice / 10000 - 5 + ((o_orderkey * 7919) % 101 - 50) / CAST(10000 AS DOUBLE) AS measured_snr_db, "
    "o_totalprice / 5000 AS duration_seconds, o_orderstatus = 'F' AS clipping_prevented FROM orders)"
)
RECORD_NOISES = (
    "record_noises AS (SELECT l_orderkey AS k, l_linenumber AS j, l_partkey AS source, "
    "CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_brand END AS category, -l_discount * 100 AS relative_gain_db, "
    "l_returnflag = 'R' AS looped, CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END AS n_events "
    "FROM lineitem JOIN part ON p_partkey = l_partkey)"
)
SCORES = (
    "scores AS (SELECT l_orderkey AS mixture_id, l_linenumber AS j, l_returnflag AS system, l_linestatus AS suite, "
    "l_quantity - 5 AS input_snr_db, l_quantity - 5 + l_discount * 100 AS output_snr_db, "
    "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 1 + l_tax * 40 END AS pesq_wb, 1 - l_discount AS stoi FROM lineitem)"
)

# Block length of the position-ordered views.
VIEW_BLOCK = 4096


def utc_instant(column: str):
    """A time without zone, read as UTC, whatever the zone of the session."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp")


def sql(*views: str) -> str:
    """The WITH clause of the named views."""
    return "WITH " + ", ".join(views) + " "


class Views:
    def __init__(self, tables):
        self.tables = tables

    @cached_property
    def _positions(self) -> DataFrame:
        """Events with their position in time inside the user; the hour of the event is the block of the ranking."""
        hour = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("bigint") * 24 + F.hour("ts")
        rows = self.tables.events.select("user_id", "event_id", "ts", "event_type", "value", hour.alias("block"))
        ranked = ordered_rank(rows, ["user_id"], ["ts", "event_id"], "t")
        return with_block(ranked.drop("block").withColumnRenamed("user_id", "signal_id"), "t", VIEW_BLOCK)

    @cached_property
    def sig_samples(self) -> DataFrame:
        x = ((F.col("value") - 50) / 500).alias("x")
        return self._positions.select("signal_id", "t", "block", x, (F.col("event_type") == "error").alias("flag"))

    @cached_property
    def sig_pairs(self) -> DataFrame:
        clean = (F.col("value") - 50) / 500
        noise = ((F.col("event_id") * 7919) % 101 - 50) / F.lit(1000.0)
        error = ((F.col("event_id") * 104729) % 61 - 30) / F.lit(2000.0)
        return self._positions.select(
            "signal_id", "t", "block", clean.alias("clean"), (clean + noise).alias("noisy"), (clean + error).alias("est")
        )

    @cached_property
    def frames(self) -> DataFrame:
        rows = self.tables.embeddings.withColumn("block", F.floor(F.col("vec_id") / VIEW_BLOCK).cast("bigint"))
        ranked = ordered_rank(rows, ["label"], ["vec_id"], "frame")
        return ranked.select(
            F.col("label").cast("bigint").alias("signal_id"),
            "frame",
            F.floor(F.col("frame") / VIEW_BLOCK).cast("bigint").alias("block"),
            F.col("embedding").cast("array<double>").alias("x"),
        )

    @cached_property
    def frame_bins(self) -> DataFrame:
        return self.frames.select(
            "signal_id", "frame", "block", F.posexplode("x").alias("bin", "v")
        ).withColumn("bin", F.col("bin").cast("bigint"))

    @cached_property
    def sources(self) -> DataFrame:
        rel = F.concat(F.lit("wav/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
        return self.tables.documents.select(
            rel.alias("rel"),
            F.col("n_chars").alias("size"),
            F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("category"),
            "doc_id",
        )

    @cached_property
    def records(self) -> DataFrame:
        target = F.col("o_totalprice") / 10000 - 5
        return self.tables.orders.select(
            F.col("o_orderkey").alias("k"),
            F.when(F.col("o_orderkey") % 10 == 0, "val").otherwise("train").alias("split"),
            F.col("o_custkey").alias("clean_source"),
            target.alias("target_snr_db"),
            (target + ((F.col("o_orderkey") * 7919) % 101 - 50) / F.lit(10000.0)).alias("measured_snr_db"),
            (F.col("o_totalprice") / 5000).alias("duration_seconds"),
            (F.col("o_orderstatus") == "F").alias("clipping_prevented"),
        )

    @cached_property
    def record_noises(self) -> DataFrame:
        joined = self.tables.lineitem.join(self.tables.part, F.col("p_partkey") == F.col("l_partkey"))
        return joined.select(
            F.col("l_orderkey").alias("k"),
            F.col("l_linenumber").alias("j"),
            F.col("l_partkey").alias("source"),
            F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("category"),
            (-F.col("l_discount") * 100).alias("relative_gain_db"),
            (F.col("l_returnflag") == "R").alias("looped"),
            F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).otherwise(0).alias("n_events"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        return self.tables.lineitem.select(
            F.col("l_orderkey").alias("mixture_id"),
            F.col("l_linenumber").alias("j"),
            F.col("l_returnflag").alias("system"),
            F.col("l_linestatus").alias("suite"),
            (F.col("l_quantity") - 5).alias("input_snr_db"),
            (F.col("l_quantity") - 5 + F.col("l_discount") * 100).alias("output_snr_db"),
            F.when(F.col("l_partkey") % 13 != 0, 1 + F.col("l_tax") * 40).alias("pesq_wb"),
            (1 - F.col("l_discount")).alias("stoi"),
        )
