"""Writers. Everything goes through Spark's commit protocol, so a failed job leaves no half-written output behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.plans.ordered import ordered_index


def write_mode(overwrite: bool = False, resume: bool = False) -> str:
    """Existing output is an error unless it is to be replaced or continued."""
    return "overwrite" if overwrite else "append" if resume else "errorifexists"


def _refuse_nan(df: DataFrame) -> None:
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = F.lit(False)
    for name in numbers:
        bad = bad | F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
    if numbers and not df.where(bad).isEmpty():
        raise ValueError("records hold NaN or infinite numbers")


def append_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line per record; nulls are written, NaN is refused."""
    _refuse_nan(records)
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_failures(failures: DataFrame, path: str) -> None:
    columns = ["sample_id", "attempt", "random_seed", "error_type", "error"]
    failures.select(*columns).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_inventory(sources: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """Inventory lines with a stable index. A file of lines grows with the inventory; one document would not."""
    indexed = ordered_index(sources, ["rel"], "idx")
    rows = indexed.withColumn("kind", F.lit(kind)).withColumnRenamed("rel", "path").withColumnRenamed("size", "size_bytes")
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_document(row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row table as one JSON document (run configuration, summary totals). More or fewer rows are an error."""
    if len(row.take(2)) != 1:
        raise ValueError("a document is written from exactly one row")
    row.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], mode: str = "errorifexists") -> None:
    """CSV with a fixed column list; other columns are left out, list columns are joined with semicolons."""
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    columns = [F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in fields]
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def output_path(split, kind: str, sample_id, extension: str = "wav"):
    """``<split>/<kind>/<sample id>.<extension>``"""
    return F.concat(split, F.lit(f"/{kind}/"), sample_id, F.lit(f".{extension}"))


def write_blocks(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Audio blocks as Parquet under ``split=/kind=`` folders, so later reads of one split or kind skip the others."""
    blocks.write.mode(mode).partitionBy("split", "kind").parquet(path)
