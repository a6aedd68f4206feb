"""Inventories, sidecars, records, manifests, archives and stages."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.functions.scalars import category_from_path, extension, path_template
from wavelake.operators.matching import apply_sidecar
from wavelake.plans.batches import plain
from wavelake.plans.ordered import spread_groups
from wavelake.schema import CLEAN_FIELDS, INVENTORY, MANIFEST, NOISE_FIELDS, SAMPLE_RECORD
from wavelake.session import settled
from wavelake.sources.stores import list_tree, open_store
from wavelake.sources.wav import read_files

# Fixed value: audio extensions taken by default.
AUDIO_EXTENSIONS = [".wav", ".flac"]


def _plain(path: Column) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def scan_files(spark: SparkSession, root: str, subdir: str, extensions: Sequence[str] = AUDIO_EXTENSIONS) -> DataFrame:
    """Recursive listing (rel, path, size, mtime) ordered by the path below the root.

    Names that start with a dot are skipped, also as folders, and linked folders are not followed. Folders are listed in
    parallel and no file content is read.
    """
    rows = list_tree(spark, root, subdir)
    return rows.where(extension(F.col("rel")).isin([e.lower() for e in extensions])).orderBy("rel")


def with_attributes(
    files: DataFrame,
    kind: str,
    subdir: str,
    dataset: str | None = None,
    template: str | None = None,
    level: str = "parent",
    sidecar: DataFrame | None = None,
) -> DataFrame:
    """Provenance columns of clean or noise files: defaults, then path, then sidecar. Nothing is guessed."""
    below = F.col("rel").substr(F.lit(len(subdir) + 2), F.length("rel"))
    fields = CLEAN_FIELDS if kind == "clean" else NOISE_FIELDS
    values = {f: F.lit(None).cast("string") for f in fields}
    values[f"{kind}_dataset"] = F.lit(dataset).cast("string")
    if kind == "clean" and template:
        for name, value in path_template(below, template).items():
            if name in fields:
                values[name] = F.coalesce(value, values[name])
    if kind == "noise":
        values["noise_category"] = category_from_path(below, level)
    rows = files.select("*", *[v.alias(f) for f, v in values.items()])
    return rows if sidecar is None else apply_sidecar(rows, sidecar, fields)


def _line_order() -> Column:
    """Order of a text row inside its file, whatever the split it came from."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_sidecar(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """CSV with a ``path`` column: back-slashes become slashes, values are trimmed, empty is null, the last row of a path wins."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.option("header", True).schema(schema).csv(path)
    clean = F.replace(F.trim("path"), F.lit("\\"), F.lit("/"))
    kept = [f for f in fields if f in header]
    values = [F.nullif(F.trim(f), F.lit("")).alias(f) for f in kept]
    rows = rows.select(clean.alias("path"), _line_order().alias("_at"), *values).where(F.col("path") != "")
    last = F.max_by(F.struct(*kept), "_at").alias("_last") if kept else F.max("_at").alias("_last")
    grouped = rows.groupBy("path").agg(last)
    return grouped.select("path", *[F.col(f"_last.{f}").alias(f) for f in kept])


def read_records(spark: SparkSession, path: str, schema: str = SAMPLE_RECORD, repair: bool = False) -> DataFrame:
    """JSON lines. With ``repair`` a broken last line of a file is dropped; a broken line anywhere else is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), _line_order().alias("_at"))
    typed = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    parsed = lines.withColumn("_r", F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    report = (
        parsed.groupBy("_file")
        .agg(F.count_if(broken).alias("broken"), F.max(F.struct("_at", broken.alias("bad")))["bad"].alias("last_bad"))
        .where(F.col("broken") > F.when(F.col("last_bad") & F.lit(repair), 1).otherwise(0))
        .limit(1)
        .collect()
    )
    if report:
        raise RuntimeError(f"corrupt metadata in {report[0]['_file']}: {report[0]['broken']} broken line(s)")
    return parsed.where(~broken).select("_r.*").drop("_corrupt")


def read_inventory(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Sources of a stored inventory with their original index: a single JSON document, or the lines of `write_inventory`."""
    if "," not in path and path.endswith(".json"):
        document = spark.read.option("multiLine", True).schema(INVENTORY).json(path)
        rows = document.select(F.posexplode(F.col(kind)).alias("idx", "s")).select(F.col("idx").cast("bigint").alias("idx"), "s.*")
    else:
        fields = CLEAN_FIELDS if kind == "clean" else NOISE_FIELDS
        schema = "idx BIGINT, path STRING, size_bytes BIGINT, kind STRING, " + ", ".join(f"{f} STRING" for f in fields)
        rows = spark.read.schema(schema).json(path).where(F.col("kind") == kind).drop("kind")
    return rows.withColumnRenamed("path", "rel").withColumnRenamed("size_bytes", "size")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Training manifest: text columns as stored, typed where they are used."""
    return spark.read.option("header", True).schema(MANIFEST).csv(path)


class _Archive:
    """A ZIP archive read by ranges: its directory, then only the members that are asked for."""

    def __init__(self, path: str):
        store, inside, _ = open_store(path)
        self.file = store.open_input_file(inside)
        self.zip = zipfile.ZipFile(self.file)

    def __enter__(self) -> zipfile.ZipFile:
        return self.zip

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()


_MEMBERS = "archive_ord INT, archive STRING, member STRING, size BIGINT"


def _members(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Members of all archives, one task for each archive; only their directories are read."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for order, path in zip(batch["archive_ord"], batch["archive"]):
                with _Archive(path) as archive:
                    infos = {i.filename: i.file_size for i in archive.infolist() if not i.is_dir()}
                rows = {"archive_ord": order, "archive": path, "member": list(infos), "size": list(infos.values())}
                yield plain(pd.DataFrame(rows).astype({"archive_ord": "int32", "size": "int64"}))

    archives = spark.createDataFrame(list(enumerate(paths)), "archive_ord INT, archive STRING")
    return spread_groups(archives, "archive").mapInPandas(listed, _MEMBERS)


def scan_archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Members of ZIP archives (archive_ord, archive, member, size); the first archive that has a name wins."""
    first = F.min(F.struct("archive_ord", "archive", "size")).alias("_f")
    return _members(spark, paths).groupBy("member").agg(first).select("_f.archive_ord", "_f.archive", "member", "_f.size")


def read_members(spark: SparkSession, paths: Sequence[str], members: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Content of archive members as (path, content), addressable like files; the first archive that has a name wins.

    ``members`` are names, a table with a ``member`` column, or all if not given. The winning members are dealt over the
    tasks; a task reads its members from the archive by ranges, one at a time.
    """
    chosen = scan_archives(spark, paths)
    if isinstance(members, DataFrame):
        chosen = chosen.join(members.select("member").distinct(), "member", "left_semi")
    elif members is not None:
        chosen = chosen.where(F.col("member").isin(list(members)))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, group in batch.groupby("archive"):
                with _Archive(path) as archive:
                    for member in group["member"]:
                        yield plain(pd.DataFrame({"path": [f"zip:{member}"], "content": [archive.read(member)]}))

    dealt = spread_groups(chosen.select("archive", "member"), "archive", "member")
    return dealt.mapInPandas(extract, "path STRING, content BINARY")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """One ZIP archive under ``folder`` for each ``archive`` with its members (archive, member, content): rows (archive, members).

    The members of an archive stream through one task. An archive appears under its name when it is complete, so a
    repeated task is harmless; one of that name is replaced.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top, _ = open_store(folder)
        store.create_dir(top, recursive=True)
        current, out, archive, part, count = None, None, None, None, 0

        def finish() -> pd.DataFrame:
            archive.close()
            out.close()
            store.move(part, f"{top}/{current}")
            return plain(pd.DataFrame({"archive": [current], "members": [count]}))

        for batch in batches:
            for name, member, content in zip(batch["archive"], batch["member"], batch["content"]):
                if name != current:
                    if archive:
                        yield finish()
                    current, count, part = name, 0, f"{top}/.{name}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(member, content)
                count += 1
        if archive:
            yield finish()

    ordered = spread_groups(rows.select("archive", "member", "content"), "archive").sortWithinPartitions("archive", "member")
    return settled(ordered.mapInPandas(write, "archive STRING, members BIGINT"))


def scan_stages(spark: SparkSession, stages: dict[str, str], extensions: Sequence[str] = (".wav", ".mp3")) -> DataFrame:
    """Files of several named folders: (stage, stage_ord, path, size), stages in the given order."""
    parts = [
        read_files(spark, folder)
        .select(F.lit(name).alias("stage"), F.lit(i).alias("stage_ord"), _plain(F.col("path")).alias("path"), F.col("length").alias("size"))
        .where(extension(F.col("path")).isin(list(extensions)))
        for i, (name, folder) in enumerate(stages.items())
    ]
    return reduce(DataFrame.unionByName, parts)
