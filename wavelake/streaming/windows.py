"""Event-time windows. The same functions take streams and tables; on a stream, set the watermark before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _window_rows(df: DataFrame, window: Column, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    grouped = df.groupBy(*keys, window.alias("w")).agg(*aggregates)
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *grouped.columns[len(keys) + 1 :])


def tumbling(df: DataFrame, duration: str, aggregates: Sequence[Column], keys: Sequence[str] = ("signal_id",)) -> DataFrame:
    return _window_rows(df, F.window("ts", duration), keys, aggregates)


def sliding(df: DataFrame, length: str, hop: str, aggregates: Sequence[Column], keys: Sequence[str] = ("signal_id",)) -> DataFrame:
    return _window_rows(df, F.window("ts", length, hop), keys, aggregates)


def activity_sessions(
    df: DataFrame, length_us: Column, gap_us: int, aggregates: Sequence[Column] = (), keys: Sequence[str] = ("signal_id",)
) -> DataFrame:
    """Merges active stretches (``ts`` plus a length) whose gap is strictly below ``gap_us`` microseconds.

    The built-in session window also merges at equality, so the gap is shortened by one microsecond. The returned end
    is the end of the last stretch.
    """
    reach = length_us + F.lit(gap_us - 1)
    gap = F.concat(reach.cast("string"), F.lit(" microseconds"))
    grouped = df.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("stretches"), *aggregates)
    end = F.timestamp_micros(F.unix_micros(F.col("w.end")) - F.lit(gap_us - 1))
    return grouped.select(*keys, F.col("w.start").alias("start"), end.alias("end"), *grouped.columns[len(keys) + 1 :])


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now, appending to Parquet under ``folder``, and returns the written table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def read_frames(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet frame files as a stream, oldest files first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
