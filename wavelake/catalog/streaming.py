"""Event-time windows, streams and table functions."""

import uuid

from pyspark.sql import functions as F

from wavelake.catalog.registry import ORACLES, Tables, query, rounded
from wavelake.catalog.spectra import impulse_flags as _batch  # noqa: F401  (registers the batch twin first)
from wavelake.catalog.planning import CHUNK_ROWS, SEED, chunk_rows, d
from wavelake.catalog.views import FRAME_BINS, SIG_SAMPLES, sql, utc_instant
from wavelake.operators.tablefunctions import register_table_functions
from wavelake.plans.draws import between, draw
from wavelake.session import ensure_checkpoint_dir
from wavelake.streaming import processors as P
from wavelake.streaming import windows as W


def activity(t: Tables):
    return t.events.select(F.col("user_id").alias("signal_id"), utc_instant("ts").alias("ts"), "value", "event_id")


@query(
    "stf7_tumbling_event_time",
    """SELECT user_id AS signal_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000000 AS start, count(*) AS n, round(max(abs(value)), 6) + 0.0 AS peak FROM events GROUP BY 1, 2""",
)
def tumbling(t: Tables):
    rows = W.tumbling(activity(t), "6 hours", [F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("peak")])
    return rows.select("signal_id", F.unix_seconds("start").alias("start"), "n", rounded(F.col("peak")).alias("peak"))


@query(
    "stf8_sliding_event_time",
    """WITH e AS (SELECT user_id, value, epoch_us(ts) // 1000000 // 7200 - unnest([0, 1, 2]) AS w FROM events)
    SELECT user_id AS signal_id, w * 7200 AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM e GROUP BY 1, 2""",
)
def sliding(t: Tables):
    rows = W.sliding(activity(t), "6 hours", "2 hours", [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")])
    return rows.select("signal_id", F.unix_seconds("start").alias("start"), "n", rounded(F.col("mean")).alias("mean"))


@query(
    "stf9_activity_sessions",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 60000000 * (1 + event_id % 90) AS b FROM events),
    l AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a) AS g FROM l)
    SELECT user_id AS signal_id, min(a) AS start_us, max(b) AS end_us, count(*) AS stretches FROM i GROUP BY user_id, g""",
)
def sessions(t: Tables):
    length = F.lit(60_000_000) * (1 + F.col("event_id") % 90)
    rows = W.activity_sessions(activity(t), length, 21_600_000_000)
    return rows.select("signal_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "stretches")


def streamed_windows(t: Tables, apply):
    """Events as a stream that is stopped and resumed: one in five arrives a part late, within the watermark; the last part
    is one row far ahead, which closes all windows before it."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = activity(t)
    first, last = rows.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    half = (last - first) // 2 + 1
    late = F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    part = F.floor((F.unix_seconds("ts") - first) / half) + late
    closing = rows.limit(1).select(
        F.lit(-1).cast(rows.schema["signal_id"].dataType).alias("signal_id"),
        F.timestamp_seconds(F.lit(last + 4 * half + 2_000_000)).alias("ts"), "value", "event_id",
    )
    for new in (rows.where(part == 0), rows.where(part == 1), rows.where(part == 2), closing):
        new.write.mode("append").parquet(f"{folder}/in")
        stream = W.read_frames(t.spark, f"{folder}/in", rows.schema).withWatermark("ts", f"{2 * half} seconds")
        result = W.run_available(apply(stream), folder)
    return result


@query("stf7_tumbling_stream", ORACLES["stf7_tumbling_event_time"])
def tumbling_stream(t: Tables):
    rows = streamed_windows(t, lambda s: W.tumbling(s, "6 hours", [F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("peak")]))
    return rows.select("signal_id", F.unix_seconds("start").alias("start"), "n", rounded(F.col("peak")).alias("peak"))


@query("stf8_sliding_stream", ORACLES["stf8_sliding_event_time"])
def sliding_stream(t: Tables):
    rows = streamed_windows(t, lambda s: W.sliding(s, "6 hours", "2 hours", [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")]))
    return rows.select("signal_id", F.unix_seconds("start").alias("start"), "n", rounded(F.col("mean")).alias("mean"))


@query("stf9_sessions_stream", ORACLES["stf9_activity_sessions"])
def sessions_stream(t: Tables):
    length = F.lit(60_000_000) * (1 + F.col("event_id") % 90)
    rows = streamed_windows(t, lambda s: W.activity_sessions(s, length, 21_600_000_000))
    return rows.select("signal_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "stretches")


@query("stf1_stf6_impulse_flags_stream", ORACLES["stf1_impulse_flags"])
def impulse_stream(t: Tables):
    """The detector as a stream that stops and resumes twice; equal to one batch run, as its state is carried."""
    P.use_rocksdb(t.spark)
    folder = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    energies = t.views.sig_samples.select("signal_id", F.col("t").alias("frame"), (F.pow("x", F.lit(4)) * 1000).alias("energy"))
    part = F.least(F.floor(F.col("frame") / 30), F.lit(2))
    for i in range(3):
        energies.where(part == i).write.mode("append").parquet(f"{folder}/in")
        flags = W.run_available(P.impulse_flags(W.read_frames(t.spark, f"{folder}/in", energies.schema)), folder)
    return flags.select("signal_id", "frame", "flag", rounded(F.col("severity")).alias("severity"))


@query(
    "stf5_overlap_add_stream",
    sql(FRAME_BINS)
    + "SELECT a.signal_id, a.frame, a.bin AS i, round(a.v + coalesce(b.v, 0), 6) + 0.0 AS y FROM frame_bins a LEFT JOIN frame_bins b ON b.signal_id = a.signal_id AND b.frame = a.frame - 1 AND b.bin = a.bin + 32 WHERE a.bin < 32",
)
def overlap_stream(t: Tables):
    """The half-frame memory is carried from one run of the stream to the next."""
    P.use_rocksdb(t.spark)
    folder = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    frames = t.views.frames.select("signal_id", "frame", "x")
    part = F.least(F.floor(F.col("frame") / 20), F.lit(1))
    for i in range(2):
        frames.where(part == i).write.mode("append").parquet(f"{folder}/in")
        hops = W.run_available(P.overlap_add(W.read_frames(t.spark, f"{folder}/in", frames.schema), 32), folder)
    rows = hops.select("signal_id", "frame", F.posexplode("y").alias("i", "y"))
    return rows.select("signal_id", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("y")).alias("y"))


@query("stf5_stf6_late_frames", ORACLES["stf5_overlap_add_stream"])
def late_frames(t: Tables):
    """Frames arrive in any order over three runs of the stream; those that are early wait for the ones before them."""
    P.use_rocksdb(t.spark)
    folder = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    frames = t.views.frames.select("signal_id", "frame", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("frame") * 10).alias("ts"), "x")
    part = F.pmod(F.xxhash64("signal_id", "frame"), F.lit(3))
    for i in range(3):
        frames.where(part == i).write.mode("append").parquet(f"{folder}/in")
        stream = W.read_frames(t.spark, f"{folder}/in", frames.schema).withWatermark("ts", "1 hour")
        hops = W.run_available(P.overlap_add(stream, 32), folder)
    rows = hops.select("signal_id", "frame", F.posexplode("y").alias("i", "y"))
    return rows.select("signal_id", "frame", F.col("i").cast("bigint").alias("i"), rounded(F.col("y")).alias("y"))


@query(
    "udf4_table_functions",
    sql(CHUNK_ROWS)
    + ", v AS (SELECT *, " + d("12345", "'loop'", "k") + " % length AS first FROM need), h AS (SELECT *, least(length - first, need) AS head FROM v), "
    + """e AS (SELECT *, unnest(range(1 + CAST(ceil((need - head) / length) AS BIGINT))) AS i FROM h),
    o AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE head + (i - 1) * length END AS off, CASE WHEN i = 0 THEN first ELSE 0 END AS src FROM e)
    SELECT k, src AS source_start_sample, src + CASE WHEN i = 0 THEN head ELSE least(length, need - off) END AS source_end_sample, off AS destination_start_sample FROM o""",
)
def table_functions(t: Tables):
    register_table_functions(t.spark)
    chunk_rows(t).withColumn("first", draw(SEED, "loop", F.col("k")) % F.col("length")).createOrReplaceTempView("chunk_needs")
    return t.spark.sql(
        "SELECT k, c.source_start_sample, c.source_end_sample, c.destination_start_sample "
        "FROM chunk_needs, LATERAL loop_chunks(length, need, first) c"
    )


@query("udf4_impulsive_events", ORACLES["sig5_plan_impulsive_events"])
def impulsive_events(t: Tables):
    """The events of each pick from an array of its draws."""
    register_table_functions(t.spark)
    k, j = F.col("k"), F.col("j")
    count = between(draw(SEED, "events", k, j), F.lit(1), F.lit(4))
    three = lambda e: F.array(*(draw(SEED, name, k, j, e) for name in ("duration", "source", "target")))
    draws = F.flatten(F.transform(F.sequence(F.lit(1).cast("bigint"), count), three))
    chunk_rows(t).withColumn("draws", draws).createOrReplaceTempView("event_needs")
    return t.spark.sql(
        "SELECT k, e.event, e.source_start_sample, e.source_end_sample, e.destination_start_sample "
        "FROM event_needs, LATERAL impulsive_events(length, need, 7, 72, draws) e"
    )


@query(
    "udf4_frame_ranges",
    sql(SIG_SAMPLES)
    + """, n AS (SELECT signal_id, count(*) AS n FROM sig_samples GROUP BY signal_id), f AS (SELECT signal_id, n, unnest(range(CASE WHEN n < 10 THEN 1 ELSE (n - 10) // 4 + 1 END)) AS frame FROM n)
    SELECT signal_id, frame, frame * 4 AS start_sample, frame * 4 + least(10, n) AS end_sample FROM f""",
)
def frame_ranges(t: Tables):
    register_table_functions(t.spark)
    t.views.sig_samples.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n")).createOrReplaceTempView("signal_lengths")
    return t.spark.sql("SELECT signal_id, f.* FROM signal_lengths, LATERAL frame_ranges(n, 10, 4) f")
