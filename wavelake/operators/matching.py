"""Joins: pairing, membership, integrity, coverage, interval placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.functions.scalars import extension, stem
from wavelake.plans.ordered import merge_intervals
from wavelake.plans.totals import beside


def with_stem(files: DataFrame) -> DataFrame:
    return files.withColumn("stem", stem(F.col("path"))).withColumn("ext", extension(F.col("path")))


def preference() -> Column:
    """Order of files with one stem: WAV before MP3, then by path."""
    rank = F.when(F.col("ext") == ".wav", 0).when(F.col("ext") == ".mp3", 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.col("path"))


def one_per_stem(files: DataFrame, *keys: str) -> DataFrame:
    """The preferred file per (keys, stem). An aggregate, so copies shrink before the shuffle."""
    return files.groupBy(*keys, "stem").agg(F.min(preference()).alias("_first")).select(
        *keys, "stem", F.col("_first.path").alias("path")
    )


def pair_by_stem(clean: DataFrame, estimates: DataFrame) -> DataFrame:
    left = one_per_stem(with_stem(clean)).withColumnRenamed("path", "clean_path")
    right = one_per_stem(with_stem(estimates)).withColumnRenamed("path", "estimate_path")
    return left.join(right, "stem")


def match_all_stages(clean: DataFrame, staged: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Files of the stems present in clean and in every stage: (stem, stage, path). One aggregation by stem."""
    every = with_stem(clean).select("stem", "ext", "path", F.lit(None).cast("string").alias("stage")).unionByName(
        with_stem(staged.where(F.col("stage").isin(list(stages)))).select("stem", "ext", "path", "stage")
    )
    paths = [F.min(F.when(F.col("stage") == s, preference()))["path"] for s in stages]
    by_stem = every.groupBy("stem").agg(
        F.count_if(F.col("stage").isNull()).alias("_clean"),
        F.array(*[F.struct(F.lit(s).alias("stage"), p.alias("path")) for s, p in zip(stages, paths)]).alias("_files"),
    )
    complete = (F.col("_clean") > 0) & F.forall("_files", lambda f: f["path"].isNotNull())
    return by_stem.where(complete).select("stem", F.explode("_files").alias("_f")).select("stem", "_f.stage", "_f.path")


def skip_report(clean: DataFrame, staged: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Clean stems that some stage lacks, with those stages in the given order."""
    wanted = F.array(*[F.lit(s) for s in stages])
    present = with_stem(staged.where(F.col("stage").isin(list(stages)))).groupBy("stem").agg(F.collect_set("stage").alias("present"))
    stems = with_stem(clean).select("stem").distinct()
    missing = F.array_except(wanted, F.coalesce("present", F.array().cast("array<string>")))
    return stems.join(present, "stem", "left").select("stem", missing.alias("missing")).where(F.size("missing") > 0)


def apply_sidecar(sources: DataFrame, sidecar: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sidecar values that are not null win over inferred ones, column by column."""
    side = sidecar.select(F.col("path").alias("rel"), *[F.col(f).alias(f"_side_{f}") for f in fields if f in sidecar.columns])
    joined = sources.join(side, "rel", "left")
    for field in fields:
        if field in sidecar.columns:
            joined = joined.withColumn(field, F.coalesce(f"_side_{field}", field))
    return joined.drop(*[f"_side_{f}" for f in fields])


def mark_members(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds a boolean: whether the key occurs in ``ids``."""
    members = ids.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(members, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def todo(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select("sample_id"), "sample_id", "left_anti")


def misfits(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Finished samples that the plan does not have, or has in another split."""
    planned = plan.select("sample_id", F.col("split").alias("planned_split"))
    return done.join(planned, "sample_id", "left").where(~F.col("split").eqNullSafe(F.col("planned_split")))


def _output_paths(records: DataFrame) -> DataFrame:
    pairs = F.array(
        F.struct(F.lit("clean").alias("kind"), F.col("clean_output").alias("path")),
        F.struct(F.lit("noisy").alias("kind"), F.col("noisy_output").alias("path")),
    )
    return records.select("sample_id", F.explode(pairs).alias("_p")).select("sample_id", "_p.kind", "_p.path")


def verify_output(records: DataFrame, files: DataFrame) -> DataFrame:
    """One row: record and file counts, mismatches of each kind, and whether all three sides are one to one."""
    expected = _output_paths(records)
    sides = expected.select("kind", "path", F.lit(1).alias("wanted"), F.lit(0).alias("stored")).unionByName(
        files.select("kind", "path", F.lit(0).alias("wanted"), F.lit(1).alias("stored"))
    )
    per_path = sides.groupBy("kind", "path").agg(F.max("wanted").alias("wanted"), F.max("stored").alias("stored"))

    def of(kind: str, test: Column) -> Column:
        return F.count_if((F.col("kind") == kind) & test)

    stored, unlike = F.col("stored") == 1, F.col("wanted") != F.col("stored")
    paths = per_path.agg(
        of("clean", stored).alias("clean_files"),
        of("noisy", stored).alias("noisy_files"),
        of("clean", unlike).alias("clean_mismatches"),
        of("noisy", unlike).alias("noisy_mismatches"),
    )
    per_id = records.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((stem(F.col("clean_output")) != F.col("sample_id")) | (stem(F.col("noisy_output")) != F.col("sample_id"))).alias("bad"),
    )
    ids = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("metadata_records"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("name_mismatches"),
    )
    both = beside(ids, paths)
    clean = F.lit(True)
    for problem in ("duplicate_ids", "name_mismatches", "clean_mismatches", "noisy_mismatches"):
        clean = clean & (F.col(problem) == 0)
    equal = (F.col("metadata_records") == F.col("clean_files")) & (F.col("metadata_records") == F.col("noisy_files"))
    return both.withColumn("one_to_one", clean & equal)


def orphans(records: DataFrame, files: DataFrame) -> DataFrame:
    """Files without a record."""
    return files.join(_output_paths(records).select("path"), "path", "left_anti")


def missing(records: DataFrame, files: DataFrame) -> DataFrame:
    """Record paths without a file."""
    return _output_paths(records).join(files.select("path"), "path", "left_anti")


def locate(wanted: DataFrame, root_files: DataFrame, members: DataFrame, prefix: str = "mixtures/") -> DataFrame:
    """Where each relative path is: the first root that has it, else the first archive member, else null.

    ``root_files`` has (root_ord, root, relpath); ``members`` has (archive_ord, member).
    """
    in_roots = root_files.groupBy("relpath").agg(F.min_by("root", "root_ord").alias("root"))
    in_archives = members.groupBy("member").agg(F.min("archive_ord").alias("archive_ord"))
    member = F.when(F.col("relpath").startswith(prefix), F.col("relpath").substr(F.lit(len(prefix) + 1), F.length("relpath"))).otherwise(F.col("relpath"))
    rows = wanted.select("relpath").distinct().withColumn("member", member)
    joined = rows.join(in_roots, "relpath", "left").join(in_archives, "member", "left")
    location = F.when(F.col("root").isNotNull(), F.concat("root", F.lit("/"), "relpath")).when(
        F.col("archive_ord").isNotNull(), F.concat(F.lit("zip:"), "member")
    )
    return joined.select("relpath", location.alias("location"))


def to_buckets(intervals: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """One row per fixed position bucket that a half-open interval touches."""
    first, last = F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size)
    return intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(first, last)))


def mask_from_regions(samples: DataFrame, regions: DataFrame, keys: Sequence[str], bucket: int = 4096) -> DataFrame:
    """Adds ``mask``: whether the sample lies in a region of its signal.

    Regions are merged first, so a sample meets at most one; they are then cut to fixed position buckets, which turns
    the range condition into an equi-join on (signal, bucket) with a residual.
    """
    disjoint = merge_intervals(regions, keys, 1)
    pieces = to_buckets(disjoint, "start_sample", "end_sample", bucket)
    rows = samples.withColumn("_bucket", F.floor(F.col("t") / bucket))
    inside = (F.col("s.t") >= F.col("r.start_sample")) & (F.col("s.t") < F.col("r.end_sample"))
    on = F.col("s._bucket") == F.col("r._bucket")
    for key in keys:
        on = on & (F.col(f"s.{key}") == F.col(f"r.{key}"))
    joined = rows.alias("s").join(pieces.alias("r"), on & inside, "left")
    return joined.select(*[F.col(f"s.{c}") for c in samples.columns], F.col("r.start_sample").isNotNull().alias("mask"))


def place_segments(source_samples: DataFrame, plan: DataFrame, bucket: int = 4096) -> DataFrame:
    """Copies source ranges onto the timeline of the sample.

    ``source_samples`` has (source, t, x); ``plan`` has (sample_id, pick, source, source_start_sample,
    source_end_sample, destination_start_sample) and any other columns. The equi-join key is (source, bucket).
    """
    pieces = to_buckets(plan, "source_start_sample", "source_end_sample", bucket)
    rows = source_samples.select("source", "t", "x", F.floor(F.col("t") / bucket).alias("_bucket"))
    inside = (F.col("t") >= F.col("source_start_sample")) & (F.col("t") < F.col("source_end_sample"))
    joined = pieces.join(rows, ["source", "_bucket"]).where(inside)
    at = F.col("t") - F.col("source_start_sample")
    return joined.select(
        *[c for c in plan.columns if c != "t"],
        at.alias("event_index"),
        (at + F.col("destination_start_sample")).alias("t"),
        "x",
    )


def verify_checksums(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """OK, MISSING or HASH MISMATCH per manifest row. ``files`` has (path, content) with binary content."""
    hashed = files.select("path", F.sha2("content", 256).alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("sha256"), "OK").otherwise("HASH MISMATCH")
    )
    return manifest.join(hashed, "path", "left").select("path", status.alias("status"))


def category_coverage(
    required: Sequence[str], impulsive: Sequence[str], available: DataFrame, mode: str, max_noises: int
) -> DataFrame:
    """Issue rows (severity, issue, detail) where the noise library cannot satisfy a configuration."""
    per_category = available.groupBy("category").agg(F.count(F.lit(1)).alias("files"))
    is_required = F.coalesce(F.col("category").isin(list(required)) if required else F.lit(False), F.lit(False))
    found = per_category.agg(
        F.count_if(~is_required).alias("others"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        # Only names that the configuration lists are collected, so the set is bounded by the configuration.
        F.collect_set(F.when(F.col("category").isin([*required, *impulsive, ""]), F.col("category"))).alias("known"),
    )

    def absent(names: Sequence[str]) -> Column:
        return F.array_except(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("known"))

    def issue(severity: str, name: str, detail: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue"), detail.cast("string").alias("detail"))

    extra = max_noises - len(required)
    issues = [
        F.when(F.size(absent(required)) > 0, issue("error", "missing required", F.array_join(absent(required), ","))),
        F.when(F.lit(bool(required)) & (F.col("others") == 0), issue("error", "nothing but required", F.col("others"))),
        F.when(F.lit(mode == "require_different") & (F.col("others") < extra), issue("error", "too few categories", F.col("others"))),
        F.when(F.col("files") < max_noises, issue("warning", "fewer files than noises", F.col("files"))),
        F.when(F.size(absent(impulsive)) > 0, issue("warning", "unmatched impulsive", F.array_join(absent(impulsive), ","))),
    ]
    return found.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")


def skip_converted(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs whose non-empty output does not exist yet."""
    finished = with_stem(outputs.where(F.col("size") > 0)).select("stem").distinct()
    return with_stem(inputs).join(finished, "stem", "left_anti").select(*inputs.columns)


def attach_reference(primary: DataFrame, reference: DataFrame) -> DataFrame:
    """Companion signal by file name. ``accepted`` is false where lengths differ; no companion is accepted."""
    other = reference.select("name", F.col("path").alias("reference_path"), F.col("frames").alias("reference_frames"))
    joined = primary.join(other, "name", "left")
    return joined.withColumn(
        "accepted", F.col("reference_path").isNull() | F.coalesce(F.col("frames") == F.col("reference_frames"), F.lit(False))
    )


def draw_by_index(samples: DataFrame, indexed_pool: DataFrame, draw: str, idx: str = "idx") -> DataFrame:
    """Uniform pick: each sample takes the pool row whose index is ``draw mod n``. A plain equi-join on the index."""
    size = indexed_pool.agg(F.count(F.lit(1))).scalar()
    return samples.withColumn(idx, F.col(draw) % size).join(indexed_pool, idx)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The lowest row of every key by ``order``; a min aggregate, so it pre-aggregates before the shuffle."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *others)).alias("_first")
    return rows.groupBy(*keys).agg(packed).select(*keys, "_first.*").select(*rows.columns)


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys and c not in order]
    packed = F.max(F.struct(*order, *others)).alias("_last")
    return rows.groupBy(*keys).agg(packed).select(*keys, "_last.*").select(*rows.columns)


