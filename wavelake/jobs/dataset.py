"""Data set generation: plan, picks, placement, mix, guards with retries, nested records, audio blocks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake import __version__
from wavelake.functions.scalars import amplitude_db, pcm_decode, pcm_encode, sample_id, seconds
from wavelake.operators import matching as J
from wavelake.operators import planning as P
from wavelake.operators import signals as S
from wavelake.operators.rules import clip_policy
from wavelake.operators.sequences import planned_ids
from wavelake.plans.draws import between, draw, draw_dist
from wavelake.plans.ordered import BLOCK, attach, ordered_index, with_block
from wavelake.schema import CLEAN_FIELDS, NOISE_FIELDS, SAMPLE_RATE
from wavelake.session import settled
from wavelake.sources.files import read_records, scan_files, with_attributes
from wavelake.sources.sinks import append_failures, append_records, output_path
from wavelake.sources.stores import exists
from wavelake.sources.wav import probe_wav, read_wav_blocks, write_wav


@dataclass
class DatasetConfig:
    """Settings of a run. Lengths are in samples of 48 kHz."""

    splits: dict[str, int] = field(default_factory=lambda: {"train": 50_000})
    base_seed: int = 12345
    num_noises: tuple[int, int] = (1, 3)
    required_categories: tuple[str, ...] = ()
    category_mode: str = "prefer_different"
    short_noise_policy: str = "loop"
    random_start: bool = False
    max_start_fraction: float = 0.5
    relative_gain_db: dict = field(default_factory=lambda: {"type": "uniform", "min": -10.0, "max": 0.0})
    min_noise_rms: float = 1e-6
    impulsive_categories: tuple[str, ...] = ()
    impulsive_count: tuple[int, int] = (1, 4)
    impulsive_duration: tuple[int, int] = (7_200, 72_000)
    fade: int = 240
    snr_db: dict = field(default_factory=lambda: {"type": "uniform", "min": 5.0, "max": 20.0})
    active_snr: bool = True
    frame: int = 1200
    hop: int = 480
    below_p95: float = 25.0
    floor_dbfs: float = -70.0
    min_gap: int = 9_600
    min_region: int = 4_800
    min_clean: int = 48_000
    max_clean: int | None = None
    peak_limit: float = 0.99
    clipping_policy: str = "scale"
    output_subtype: str = "PCM_16"
    max_attempts: int = 20


@dataclass
class GeneratedDataset:
    records: DataFrame  # nested sample records
    failures: DataFrame  # every rejected attempt
    audio: DataFrame  # (sample_id, split, t, clean, noisy) as PCM codes
    unresolved: DataFrame  # samples without a valid attempt


KEY = ["sample_id"]


def _positions(source: str, start: str, end: str, target: str) -> Column:
    """One placement entry of a record."""
    return F.struct(
        F.col(start).alias("source_start_sample"),
        F.col(end).alias("source_end_sample"),
        F.col(target).alias("destination_start_sample"),
        (F.col(target) + F.col(end) - F.col(start)).alias("destination_end_sample"),
    )


class _Waves:
    """Evaluates one attempt of many samples at once. Samples are keyed by ``<k>:<attempt>``, so draws differ by attempt."""

    def __init__(self, config: DatasetConfig, cleans, noises, clean_samples, noise_samples, size: int):
        self.c, self.size = config, size
        self.cleans = ordered_index(cleans, ["rel"], "clean_idx")
        self.pool = P.noise_pool(noises.withColumnRenamed("noise_category", "category"))
        self.clean_samples, self.noise_samples = clean_samples, noise_samples
        self.noises, self.regions, self.audio = [], [], []

    def __call__(self, rest: DataFrame) -> DataFrame:
        c = self.c
        key = F.concat_ws(":", F.col("k").cast("string"), F.col("attempt").cast("string"))
        rows = rest.withColumn("sample_id", key).withColumn("random_seed", draw(c.base_seed, F.col("k"), F.col("attempt")))
        seed = F.col("random_seed")
        drawn = J.draw_by_index(rows.withColumn("_pick", draw("clean", seed)), self.cleans, "_pick", "clean_idx")
        longer = F.lit(bool(c.max_clean)) & (F.col("length") > F.lit(c.max_clean or 0))
        room = F.greatest(F.col("length") - F.lit(c.max_clean or 0) + 1, F.lit(1))
        start = F.when(longer, draw("crop", seed) % room).otherwise(F.lit(0)).cast("bigint")
        end = F.when(longer, start + F.lit(c.max_clean or 0)).otherwise(F.col("length")).cast("bigint")
        drawn = (
            drawn.withColumn("clean_start_sample", start)
            .withColumn("clean_end_sample", end)
            .withColumn("clean_cropped", longer)
            .withColumn("samples", end - start)
            .withColumn("target_snr_db", draw_dist(c.snr_db, draw("snr", seed)))
            .withColumn("n", between(draw("n", seed), F.lit(c.num_noises[0]), F.lit(c.num_noises[1])))
        )
        drawn = settled(drawn.drop("_pick", "clean_idx"))
        usable = drawn.where(F.col("length") >= c.min_clean)

        clean = settled(self._clean(usable))
        regions = settled(self._regions(usable, clean))
        picks = settled(self._picks(usable))
        segments = settled(self._segments(usable, picks))
        placed = J.place_segments(self.noise_samples, segments)
        composite, levels = S.composite_noise(placed, c.min_noise_rms, KEY, self.size)
        levels = settled(levels)
        silent = levels.where("silent").select(*KEY).distinct().withColumn("_silent", F.lit(True))
        covered = segments.select(*KEY, F.col("pick").alias("j")).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("_placed"))
        chosen = picks.groupBy(F.col("k").alias("sample_id")).agg(F.count(F.lit(1)).alias("num_noises"))

        noise = composite.select(*KEY, "t", F.col("x").alias("noise"))
        rows = clean.join(noise, [*KEY, "t"], "left").select(*KEY, "t", F.col("x").alias("clean"), F.coalesce("noise", F.lit(0.0)).alias("noise"))
        rows = J.mask_from_regions(rows, regions, KEY)
        rows = attach(with_block(rows, "t", self.size), usable.select(*KEY, "target_snr_db"), KEY)
        mixed = S.mix_at_snr(rows, F.col("target_snr_db"), c.peak_limit, KEY)
        mixed = settled(mixed)
        measured = S.measured_snr(mixed, c.output_subtype, KEY).withColumnRenamed("rejection", "_measured")
        stats = mixed.groupBy(*KEY).agg(
            F.max("noise_scale").alias("composite_noise_scale"),
            F.max("output_gain").alias("output_gain"),
            F.max("peak").alias("peak"),
            F.round(F.avg(F.col("mask").cast("int")), 4).alias("active_fraction"),
        )
        active = regions.select(*KEY).distinct().withColumn("_active", F.lit(True))
        result = drawn
        for part in (active, silent, covered, chosen, stats, measured):
            result = result.join(part, KEY, "left")
        kept = clip_policy(stats, c.peak_limit, c.clipping_policy).select(*KEY, F.lit(True).alias("_kept"))
        result = result.join(kept, KEY, "left")

        def because(text: str) -> Column:
            return F.concat(F.lit(text + " ("), F.col("rel"), F.lit(")"))

        reason = (
            F.when(F.col("length") < c.min_clean, because("clean shorter than min_duration_seconds"))
            .when(F.col("_active").isNull(), because("no active speech detected"))
            .when(F.col("num_noises").isNull(), F.lit("require_different but not enough categories"))
            .when(F.coalesce("_placed", F.lit(0)) < F.col("num_noises"), F.lit("noise shorter than required and short_noise_policy=reject"))
            .when(F.col("_silent"), F.lit("noise segment is (near) silent"))
            .when(F.col("composite_noise_scale").isNull(), F.lit("zero clean or noise power in measurement region"))
            .when(F.col("_kept").isNull(), F.lit("mixture peak exceeds peak_limit"))
            .otherwise(F.col("_measured"))
        )
        self.noises.append(self._noise_structs(picks, segments, levels))
        self.regions.append(regions)
        self.audio.append(mixed.select(*KEY, "t", "clean_out", "noisy_out"))
        return result.withColumn("rejection", reason).drop("_active", "_silent", "_placed", "_kept", "_measured")

    def _clean(self, rows: DataFrame) -> DataFrame:
        plan = rows.select(
            *KEY, F.lit(0).alias("pick"), F.col("rel").alias("source"), F.col("clean_start_sample").alias("source_start_sample"),
            F.col("clean_end_sample").alias("source_end_sample"), F.lit(0).cast("bigint").alias("destination_start_sample"),
        )
        return with_block(J.place_segments(self.clean_samples, plan).select(*KEY, "t", "x"), "t", self.size)

    def _regions(self, rows: DataFrame, clean: DataFrame) -> DataFrame:
        c = self.c
        if not c.active_snr:
            return rows.select(*KEY, F.lit(0).cast("bigint").alias("start_sample"), F.col("samples").alias("end_sample"))
        return S.detect_active_regions(
            clean, c.frame, c.hop, c.below_p95, c.floor_dbfs, c.min_gap, c.min_region, KEY, self.size
        )

    def _picks(self, rows: DataFrame) -> DataFrame:
        wanted = rows.select(F.col("sample_id").alias("k"), "n", "samples", "random_seed")
        picks = P.pick_noises(wanted, self.pool, self.c.base_seed, self.c.category_mode, self.c.required_categories)
        picks = picks.join(self.pool, "idx").join(wanted.drop("n"), "k")
        gain = F.when(F.col("j") == 0, F.lit(0.0)).otherwise(draw_dist(self.c.relative_gain_db, draw("gain", F.col("random_seed"), F.col("j"))))
        impulsive = F.coalesce(F.col("category").isin(list(self.c.impulsive_categories)), F.lit(False)) if self.c.impulsive_categories else F.lit(False)
        begin = F.lit(0).cast("bigint")
        if self.c.random_start:
            begin = draw("start", F.col("random_seed"), F.col("j")) % (F.floor(F.col("samples") * self.c.max_start_fraction) + 1)
        return (
            picks.withColumn("relative_gain_db", gain)
            .withColumn("impulsive", impulsive)
            .withColumn("start_sample", F.when(F.col("impulsive"), F.lit(0)).otherwise(begin).cast("bigint"))
            .withColumnRenamed("length", "source_length")
        )

    def _segments(self, rows: DataFrame, picks: DataFrame) -> DataFrame:
        c = self.c
        base = picks.withColumn("length", F.col("source_length"))
        steady = base.where(~F.col("impulsive")).withColumn("need", F.col("samples") - F.col("start_sample"))
        steady = P.plan_noise_chunks(steady, c.base_seed, c.short_noise_policy).withColumn("fade", F.lit(0))
        events = base.where("impulsive").withColumn("sample_length", F.col("samples"))
        events = P.plan_impulsive_events(events, c.base_seed, c.impulsive_count, c.impulsive_duration)
        events = events.withColumn("fade", F.lit(c.fade)).withColumn("looped", F.lit(None).cast("boolean"))
        columns = [
            F.col("k").alias("sample_id"), F.col("j").alias("pick"), F.col("rel").alias("source"), "source_start_sample",
            "source_end_sample", "destination_start_sample", "fade", "looped", "relative_gain_db", "impulsive",
            (F.col("source_end_sample") - F.col("source_start_sample")).alias("event_length"),
        ]
        return steady.select(*columns).unionByName(events.select(*columns))

    def _noise_structs(self, picks: DataFrame, segments: DataFrame, levels: DataFrame) -> DataFrame:
        entry = _positions("source", "source_start_sample", "source_end_sample", "destination_start_sample")
        # The segments of one pick cover one sample once (or are a few events), so the list is bounded by its length.
        parts = segments.groupBy(*KEY, "pick").agg(
            F.sort_array(F.collect_list(F.struct("destination_start_sample", entry.alias("p")))).alias("_p"), F.max("looped").alias("looped")
        )
        parts = parts.withColumn("_p", F.transform("_p", lambda s: s["p"])).join(levels, [*KEY, "pick"])
        rows = picks.withColumnRenamed("k", "sample_id").withColumnRenamed("j", "pick").join(parts, [*KEY, "pick"])
        steady = ~F.col("impulsive")
        single = steady & ~F.coalesce("looped", F.lit(False))
        first = F.get("_p", F.lit(0))
        noise = F.struct(
            F.col("rel").alias("source"),
            "noise_dataset",
            F.col("category").alias("noise_category"),
            F.when(steady, "continuous").otherwise("impulsive").alias("placement"),
            "relative_gain_db",
            "normalization_rms",
            F.when(~steady, F.size("_p")).alias("n_events"),
            F.when(~steady, F.lit(self.c.fade)).alias("fade_samples"),
            F.when(~steady, F.col("_p")).alias("events"),
            F.when(steady, F.col("start_sample")).alias("start_sample"),
            F.when(steady, seconds(F.col("start_sample"))).alias("start_time_seconds"),
            F.when(steady, F.col("samples")).alias("end_sample"),
            F.when(steady, F.col("looped")).alias("looped"),
            F.when(single, first["source_start_sample"]).alias("source_start_sample"),
            F.when(single, first["source_end_sample"]).alias("source_end_sample"),
            F.when(steady, F.col("_p")).alias("chunks"),
            F.col("sample_rate").alias("source_original_sample_rate"),
            F.col("channels").alias("source_original_channels"),
            F.col("source_length").alias("source_standardized_num_samples"),
        )
        lists = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pick", noise.alias("noise")))).alias("_n"))
        return settled(lists.select(*KEY, F.transform("_n", lambda s: s["noise"]).alias("noises")))


def generate_dataset(
    spark: SparkSession,
    config: DatasetConfig,
    cleans: DataFrame,
    noises: DataFrame,
    clean_samples: DataFrame,
    noise_samples: DataFrame,
    done: DataFrame | None = None,
    plan: DataFrame | None = None,
    size: int = BLOCK,
) -> GeneratedDataset:
    """Generates every planned sample that is not in ``done``.

    ``cleans`` has (rel, length, sample_rate, channels, clean_*); ``noises`` has (rel, length, sample_rate, channels,
    noise_*); the sample tables have (source, t, x) at 48 kHz. The same seed, id and attempt give the same sample on any
    cluster. Samples that fail every attempt do not stop the others; they are in ``unresolved``.
    """
    rows = plan if plan is not None else planned_ids(spark, config.splits)
    if done is not None:
        rows = rows.withColumn("sample_id", sample_id(F.col("k")))
        rows = J.todo(rows, done).drop("sample_id")
    waves = _Waves(config, cleans, noises, clean_samples, noise_samples, size)
    winners, failures = P.first_valid_attempt(rows.select("k", "split"), waves, config.max_attempts)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    won = winners.select(*KEY)
    regions = union(waves.regions).join(won, KEY, "left_semi")
    # The active regions of one sample; their number is bounded by its length over the shortest region.
    lists = regions.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start_sample", "end_sample"))).alias("active_regions"))
    records = winners.join(union(waves.noises), KEY).join(lists, KEY)
    audio = attach(with_block(union(waves.audio), "t", size), winners.select(*KEY, "k", "split"), KEY)
    audio = audio.select(
        sample_id(F.col("k")).alias("sample_id"), "split", "t",
        pcm_encode(F.col("clean_out"), config.output_subtype).alias("clean"),
        pcm_encode(F.col("noisy_out"), config.output_subtype).alias("noisy"),
    )
    failed = failures.select(
        sample_id(F.col("k")).alias("sample_id"), "attempt", "random_seed", F.lit("SampleRejected").alias("error_type"),
        F.col("rejection").alias("error"),
    )
    unresolved = failures.select("k", "split").distinct().join(winners.select("k"), "k", "left_anti")
    return GeneratedDataset(_records(records, config), failed, audio, unresolved)


def _library(spark: SparkSession, root: str, kind: str, subdir: str, size: int, **attributes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, samples at 48 kHz, unreadable files) of one kind below ``root``/``subdir``.

    Heads are probed first; only readable files are decoded. Files of another rate are resampled, all of one rate together.
    """
    files = with_attributes(scan_files(spark, root, subdir, [".wav"]), kind, subdir, **attributes)
    probed = settled(files.join(probe_wav(files).withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left").drop("_path"))
    good, bad = probed.where("error is null"), probed.where("error is not null").select("rel", "error")
    blocks = read_wav_blocks(good.select("path"), size).where("error is null")
    named = good.select(F.col("path").alias("_path"), "rel")
    blocks = blocks.join(named, F.col("path") == F.col("_path")).withColumnRenamed("rel", "signal_id")
    parts = []
    # A library has few rates, whatever its size.
    for rate in sorted(r.sample_rate for r in good.select("sample_rate").distinct().collect()):
        samples = with_block(S.samples_from_blocks(blocks.where(F.col("sample_rate") == rate)).drop("block"), "t", size)
        parts.append(samples if rate == SAMPLE_RATE else S.resample(samples, SAMPLE_RATE, rate, size=size))
    if not parts:
        raise ValueError(f"no readable WAV files below {root}/{subdir}")
    samples = settled(reduce(DataFrame.unionByName, [p.select(F.col("signal_id").alias("source"), "t", "x") for p in parts]))
    fields = CLEAN_FIELDS if kind == "clean" else NOISE_FIELDS
    length = F.ceil(F.col("frames") * SAMPLE_RATE / F.col("sample_rate")).cast("bigint").alias("length")
    return good.select("rel", length, "sample_rate", "channels", *fields), samples, bad


def generate_files(
    spark: SparkSession,
    config: DatasetConfig,
    root: str,
    target: str,
    clean: tuple[str, dict] = ("wav", {}),
    noise: tuple[str, dict] = ("noise", {}),
    plan: DataFrame | None = None,
    resume: bool = False,
    size: int = BLOCK,
) -> GeneratedDataset:
    """The whole run over folders: scan, probe, generate, and write records, failures and audio below ``target``.

    ``clean`` and ``noise`` are a folder below ``root`` and the options of `with_attributes`. Audio goes to
    <split>/clean and <split>/noisy, one file for each sample; records and failures are appended as JSON lines below
    ``metadata``, after the audio, so a record stands for files that are there. An existing target is an error unless
    ``resume`` is set, which makes only the samples that have no record. The result holds what was written.
    """
    records_at, failures_at = f"{target}/metadata/records", f"{target}/metadata/failed"
    there = exists(records_at)
    if there and not resume:
        raise FileExistsError(f"{target} has records; resume or choose another folder")
    done = read_records(spark, records_at).select("sample_id", "split") if there else None
    cleans, clean_samples, bad_clean = _library(spark, root, "clean", clean[0], size, **clean[1])
    noises, noise_samples, bad_noise = _library(spark, root, "noise", noise[0], size, **noise[1])
    made = generate_dataset(spark, config, cleans, noises, clean_samples, noise_samples, done, plan, size)
    records, failures, audio = settled(made.records), settled(made.failures), settled(made.audio)
    for kind in ("clean", "noisy"):
        name = output_path(F.col("split"), kind, F.col("sample_id"))
        rows = audio.select(name.alias("signal_id"), "t", pcm_decode(F.col(kind), config.output_subtype).alias("x"))
        write_wav(S.blocks_from_samples(rows, size).withColumnRenamed("signal_id", "path"), target, config.output_subtype)
    unreadable = bad_clean.unionByName(bad_noise)
    if not unreadable.isEmpty():
        unreadable.write.mode("append").json(f"{target}/metadata/unreadable")
    append_failures(failures, failures_at)
    append_records(records, records_at)
    return GeneratedDataset(records, failures, audio, made.unresolved)


def _records(rows: DataFrame, c: DatasetConfig) -> DataFrame:
    sid = sample_id(F.col("k"))
    required = F.array(*[F.lit(r) for r in c.required_categories]).cast("array<string>")
    detector = F.to_json(
        F.struct(*[F.lit(getattr(c, n)).alias(n) for n in ("frame", "hop", "below_p95", "floor_dbfs", "min_gap", "min_region")])
    )
    peak = F.round("peak_amplitude", 6)
    return rows.select(
        sid.alias("sample_id"),
        "split",
        F.col("rel").alias("clean_source"),
        output_path(F.col("split"), "clean", sid).alias("clean_output"),
        *CLEAN_FIELDS,
        F.col("sample_rate").alias("clean_original_sample_rate"),
        F.col("channels").alias("clean_original_channels"),
        F.col("length").alias("clean_source_standardized_num_samples"),
        "clean_cropped",
        "clean_start_sample",
        "clean_end_sample",
        seconds(F.col("clean_start_sample")).alias("clean_start_time_seconds"),
        seconds(F.col("samples")).alias("clean_duration_seconds"),
        output_path(F.col("split"), "noisy", sid).alias("noisy_output"),
        "noises",
        F.size("noises").alias("num_noises"),
        F.lit(c.category_mode).alias("category_mode"),
        required.alias("required_noise_categories"),
        "target_snr_db",
        F.round("measured_snr_db", 4).alias("measured_snr_db"),
        F.round(F.col("measured_snr_db") - F.col("target_snr_db"), 4).alias("snr_error_db"),
        F.struct(
            F.lit("active_rms" if c.active_snr else "full_rms").alias("method"),
            F.lit("decoded_output_files").alias("measured_on"),
            "active_regions",
            "active_fraction",
            (detector if c.active_snr else F.lit(None).cast("string")).alias("detector"),
        ).alias("snr_measurement"),
        "composite_noise_scale",
        amplitude_db(F.col("composite_noise_scale")).alias("composite_noise_scale_db"),
        "output_gain",
        amplitude_db(F.col("output_gain")).alias("output_gain_db"),
        (F.col("output_gain") < 1.0).alias("clipping_prevented"),
        peak.alias("peak_amplitude"),
        peak.alias("final_peak_amplitude"),
        seconds(F.col("samples")).alias("duration_seconds"),
        F.lit(SAMPLE_RATE).alias("sample_rate"),
        F.lit(1).alias("channels"),
        F.lit(c.output_subtype).alias("output_subtype"),
        F.lit("wav").alias("output_container"),
        F.lit(None).cast("double").alias("mp3_compression_level"),
        "random_seed",
        F.lit(__version__).alias("generator_version"),
    )


def rebuild(records: DataFrame, clean_samples: DataFrame, noise_samples: DataFrame, size: int = BLOCK) -> DataFrame:
    """Both signals of every record from the record and the sources alone: (sample_id, t, clean, noisy) as floats."""
    def plan(rows: DataFrame, entry: str) -> DataFrame:
        return rows.select(
            "*", F.col(f"{entry}.source_start_sample").alias("source_start_sample"),
            F.col(f"{entry}.source_end_sample").alias("source_end_sample"),
            F.col(f"{entry}.destination_start_sample").alias("destination_start_sample"),
        )

    clean_plan = records.select(
        *KEY, "output_gain", F.lit(0).alias("pick"), F.col("clean_source").alias("source"),
        F.col("clean_start_sample").alias("source_start_sample"), F.col("clean_end_sample").alias("source_end_sample"),
        F.lit(0).cast("bigint").alias("destination_start_sample"),
    )
    clean = J.place_segments(clean_samples, clean_plan).select(*KEY, "t", "output_gain", F.col("x").alias("clean"))
    noises = records.select(*KEY, "composite_noise_scale", F.posexplode("noises").alias("pick", "n"))
    entries = noises.select("*", F.explode(F.coalesce("n.chunks", "n.events")).alias("e"))
    segments = plan(entries, "e").select(
        *KEY, "pick", F.col("n.source").alias("source"), "source_start_sample", "source_end_sample", "destination_start_sample",
        F.coalesce("n.fade_samples", F.lit(0)).alias("fade"), "composite_noise_scale",
        (F.pow(F.lit(10.0), F.col("n.relative_gain_db") / 20) / F.col("n.normalization_rms")).alias("pick_gain"),
        (F.col("source_end_sample") - F.col("source_start_sample")).alias("event_length"),
    )
    from wavelake.functions.scalars import fade_gain

    placed = J.place_segments(noise_samples, segments)
    gain = F.col("pick_gain") * F.col("composite_noise_scale") * fade_gain(F.col("event_index"), F.col("event_length"), F.col("fade"))
    noise = S.overlay_sum(placed.withColumn("gain", gain), KEY).select(*KEY, "t", F.col("x").alias("noise"))
    joined = clean.join(noise, [*KEY, "t"], "left")
    g = F.col("output_gain")
    total = F.col("clean") + F.coalesce("noise", F.lit(0.0))
    return joined.select(*KEY, "t", (F.col("clean") * g).alias("clean"), (total * g).alias("noisy"))


def reconstruct_check(records: DataFrame, clean_samples: DataFrame, noise_samples: DataFrame, stored: DataFrame, subtype: str = "PCM_16") -> DataFrame:
    """Rebuilds every record and compares it with the stored codes; at most one step apart is reproduced."""
    return S.reconstruct_difference(rebuild(records, clean_samples, noise_samples), stored, subtype, KEY)
