"""Generation on a small library: targets met, reproducible, rebuilt from records alone; cleaning keeps failures apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.jobs import dataset as D
from wavelake.jobs import reports as R
from wavelake.operators import signals as S
from wavelake.operators.scores import stage_delta  # noqa: F401
from wavelake.schema import SAMPLE_RECORD
from wavelake.sources import wav as WV


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(20)
    clean = {f"wav/{i}.wav": rng.normal(size=900 + 50 * i) * 0.2 * (np.sin(np.arange(900 + 50 * i) / 60) > -0.5) for i in range(4)}
    noise = {f"noise/{c}/{i}.wav": rng.normal(size=n) * 0.1 for c, n in (("wind", 1500), ("rain", 200), ("shot", 90)) for i in range(2)}
    clean["wav/9.wav"] = rng.normal(size=20)  # too short: rejected and tried again

    def samples(files):
        rows = [(k, t, float(v)) for k, x in files.items() for t, v in enumerate(x)]
        return spark.createDataFrame(rows, "source string, t bigint, x double").repartition(4)

    head = "rel string, length bigint, sample_rate int, channels int, "
    cleans = spark.createDataFrame(
        [(k, len(x), 48000, 1, "lib", None, None, None) for k, x in clean.items()],
        head + "clean_dataset string, clean_speaker_id string, clean_language string, clean_accent string",
    )
    noises = spark.createDataFrame(
        [(k, len(x), 48000, 1, None, k.split("/")[1]) for k, x in noise.items()], head + "noise_dataset string, noise_category string"
    )
    return cleans, noises, samples(clean), samples(noise)


CONFIG = D.DatasetConfig(
    splits={"train": 5, "val": 2}, num_noises=(2, 3), required_categories=("shot",), impulsive_categories=("shot",), impulsive_count=(2, 3),
    impulsive_duration=(20, 60), fade=4, frame=40, hop=16, below_p95=20.0, min_gap=20, min_region=30, min_clean=100, max_clean=800,
    random_start=True, snr_db={"type": "choice", "values": [0, 5, 10]}, max_attempts=4,
)


@pytest.fixture(scope="module")
def made(spark, library):
    return D.generate_dataset(spark, CONFIG, *library, size=64)


def test_records(made):
    rows = made.records.orderBy("sample_id").collect()
    lost = {r.k for r in made.unresolved.collect()}
    assert [r.sample_id for r in rows] == [f"{k:06d}" for k in range(1, 8) if k not in lost]
    assert set(made.records.columns) == {f.split(" ")[0] for f in SAMPLE_RECORD.split(", ") if f and f.split(" ")[0] in made.records.columns}
    for r in rows:
        assert r.split == ("train" if int(r.sample_id) <= 5 else "val")
        assert abs(r.snr_error_db) < 0.05 and r.peak_amplitude < 1.0
        assert 2 <= r.num_noises <= 3 and len(r.noises) == r.num_noises
        assert sum(n.noise_category == "shot" for n in r.noises) == 1
        assert len({n.noise_category for n in r.noises}) == r.num_noises
        assert r.noises[0].relative_gain_db == 0.0
        for n in r.noises:
            assert (n.placement == "impulsive") == (n.noise_category == "shot")
            assert (n.chunks is None) != (n.events is None)
            if n.chunks:
                ends = sorted((c.destination_start_sample, c.destination_end_sample) for c in n.chunks)
                assert ends[0][0] == n.start_sample and ends[-1][1] == n.end_sample
                assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_failures_are_logged(made):
    for f in made.failures.collect():
        assert f.error and f.error_type == "SampleRejected"


def test_rebuild_from_records(made, library):
    check = D.reconstruct_check(made.records, library[2], library[3], made.audio.select("sample_id", "t", "clean", "noisy"))
    rows = check.collect()
    assert rows and all(r.reproduced for r in rows)


def test_same_seed_same_samples(spark, library, made):
    cleans, noises, a, b = library
    again = D.generate_dataset(spark, CONFIG, cleans.repartition(7), noises.repartition(3), a.repartition(9), b.coalesce(1), size=500)
    columns = ["sample_id", "clean_source", "target_snr_db", "measured_snr_db", "random_seed", "num_noises"]
    assert again.records.select(columns).orderBy("sample_id").collect() == made.records.select(columns).orderBy("sample_id").collect()


def test_resume_makes_only_the_rest(spark, library, made):
    done = made.records.select("sample_id", "split").orderBy("sample_id").limit(6)
    rest = D.generate_dataset(spark, CONFIG, *library, done=done, size=64)
    ids = {r.sample_id for r in rest.records.collect()}
    assert ids.isdisjoint({r.sample_id for r in done.collect()})


def test_summary_of_nested_records(made, library):
    noises = R.explode_noises(made.records)
    sources = library[1].withColumnRenamed("noise_category", "category")
    totals = R.dataset_summary(made.records, noises, sources)["totals"].first()
    assert totals.total_samples == made.records.count() and totals.clean_speakers is None
    assert totals.impulsive_events == sum(n.n_events or 0 for r in made.records.collect() for n in r.noises)


def test_clean_batch_keeps_failures_apart(spark, tmp_path):
    rng = np.random.default_rng(21)
    (tmp_path / "a.wav").write_bytes(WV.wav_bytes(rng.normal(size=700) * 0.2 + 0.1))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    blocks = WV.read_wav_blocks(WV.read_files(spark, str(tmp_path)), 128)
    high, band = S.zero_phase_taps(70, None, 2000, half=32), S.zero_phase_taps(80, 800, 2000, half=32)
    cleaned, failed = R.clean_batch(blocks, high, band, size=128)
    assert cleaned.count() == 700 and failed.count() == 1
    assert cleaned.selectExpr("max(abs(x))").first()[0] <= 0.9901


def test_stage_evaluation(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=400)
    clean = [("f", t, float(v)) for t, v in enumerate(x)] + [("g", t, float(v)) for t, v in enumerate(x)]
    staged = [("f", s, t, float(v)) for s, y in (("noisy", x + rng.normal(size=400)), ("done", x * 0.5)) for t, v in enumerate(y)]
    staged += [("g", "noisy", 0, 1.0)]
    c = spark.createDataFrame(clean, "signal_id string, t bigint, x double")
    s = spark.createDataFrame(staged, "signal_id string, stage string, t bigint, x double")
    per_file, summary = R.evaluate_stages(c, s, ["noisy", "done"], 10, size=64)
    assert {(r.signal_id, r.stage) for r in per_file.collect()} == {("f", "noisy"), ("f", "done")}
    rows = summary.orderBy("stage_ord").collect()
    assert rows[0].d_snr is None and rows[1].d_snr == pytest.approx(rows[1].snr - rows[0].snr) and rows[1].snr > 50


def test_score_triplets_of_a_copy(spark):
    rows = [("m", t, float(t % 5) / 10, float(t % 7) / 10) for t in range(50)]
    df = spark.createDataFrame(rows, "mixture_id string, t bigint, clean double, noisy double").withColumn("output", F.col("clean"))
    pairs = spark.createDataFrame([("m", "wind", 5.0)], "mixture_id string, category string, target_snr_db double")
    row = R.score_triplets(df, pairs, "copy").first()
    assert row.output_snr_db == float("inf") and row.category == "wind" and row.rtf is None


def test_clean_folder_writes_and_reports(spark, tmp_path):
    from wavelake.operators.filters import butterworth

    rng = np.random.default_rng(23)
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    (source / "a.wav").write_bytes(WV.wav_bytes(rng.normal(size=700) * 0.2 + 0.1))
    (source / "deep/b.wav").write_bytes(WV.wav_bytes(rng.normal(size=90) * 0.2))
    (source / "bad.wav").write_bytes(b"nothing")
    report, totals = R.clean_folder(spark, str(source), str(tmp_path / "out"), butterworth(70, None, 2000), butterworth(80, 400, 2000), size=128)
    assert {(r.path, r.frames, r.error) for r in report.collect()} == {
        ("a.wav", 700, None), ("deep/b.wav", 90, None), ("bad.wav", None, "not a RIFF/WAVE file"),
    }
    row = totals.first()
    assert (row.files, row.failed) == (3, 1) and row.audio_sec == pytest.approx(790 / 48000) and row.rtf > 0
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.wav")) == ["a.wav", "deep/b.wav"]


def test_measured_pairs(spark, tmp_path):
    from wavelake.operators.pairs import measure_pairs
    from wavelake.operators.rules import validate_pairs

    rng = np.random.default_rng(24)
    clean = rng.normal(size=5000) * 0.1
    noise = rng.normal(size=5000) * 0.01
    late = np.concatenate([np.zeros(7), clean[:-7]]) + noise
    signals = {"good": clean + noise, "late": late, "same": clean, "short": clean[:-1], "loud": np.clip(clean * 30, -1, 1)}
    for name, x in {**signals, "clean": clean, "silent": clean * 0}.items():
        (tmp_path / f"{name}.wav").write_bytes(WV.wav_bytes(x))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    at = lambda name: f"file:{tmp_path}/{name}.wav"
    rows = [(n, at(n), at("clean"), 5000 / 48000, 20.0) for n in [*signals, "bad"]]
    rows += [("quiet", at("good"), at("silent"), 5000 / 48000, 20.0), ("gone", None, at("clean"), 1.0, 1.0), (None, at("good"), at("clean"), 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "noisy_relpath string, noisy_path string, clean_path string, duration_sec_meta double, measured_snr_db_meta double")
    measured = measure_pairs(pairs, block=512)
    got = {r.noisy_relpath: r for r in validate_pairs(measured).collect()}
    assert len(got) == 8
    assert (got["good"].audio_status, got["good"].audio_flags, got["good"].alignment_lag) == ("PASS", [], 0)
    quantised = lambda x: np.rint(x * 32768) / 32768
    residual = quantised(clean + noise) - quantised(clean)
    assert got["good"].rms_residual == pytest.approx(np.sqrt(np.mean(residual**2)), rel=1e-6)
    assert got["good"].peak_noisy == pytest.approx(np.abs(quantised(clean + noise)).max())
    assert got["late"].audio_flags[0] == "misaligned (7 samples)"
    assert "no residual noise" in got["same"].audio_flags
    assert got["short"].audio_flags == ["length mismatch"]
    assert "noisy clipped" in got["loud"].audio_flags
    assert "silent clean" in got["quiet"].audio_flags
    assert got["bad"].audio_flags[0].startswith("unreadable") and got["gone"].audio_flags == ["noisy missing"]


def test_summary_rows_hold_every_table(made, library):
    tables = R.dataset_summary(made.records, R.explode_noises(made.records), library[1].withColumnRenamed("noise_category", "category"))
    rows = R.summary_rows(tables).collect()
    assert {r.section for r in rows} == set(tables)
    assert sum(r.value for r in rows if r.section == "splits" and r.measure == "samples") == made.records.count()


def test_generation_from_folder_to_folder(spark, tmp_path):
    """Files in, files out: one source of half the rate, one damaged, a name with an underscore; then a resumed run."""
    rng = np.random.default_rng(25)
    root, target = tmp_path / "lib", str(tmp_path / "out")
    files = {"wav/_s1/a.wav": (900, 48000), "wav/s2/b.wav": (500, 24000), "noise/wind/w.wav": (1500, 48000), "noise/_rain/r.wav": (300, 48000)}
    for rel, (n, rate) in files.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(WV.wav_bytes(rng.normal(size=n) * 0.1, rate))
    (root / "wav/s2/bad.wav").write_bytes(b"RIFF")
    config = D.DatasetConfig(
        splits={"train": 3}, num_noises=(1, 2), frame=40, hop=16, below_p95=20.0, min_gap=20, min_region=30, min_clean=100, max_clean=600, max_attempts=3
    )
    options = dict(clean=("wav", {"template": "{clean_speaker_id}/{file}"}), noise=("noise", {}), size=256)
    made = D.generate_files(spark, config, str(root), target, **options)
    records = {r.sample_id: r for r in made.records.collect()}
    assert records and {r.clean_source for r in records.values()} <= {"wav/_s1/a.wav", "wav/s2/b.wav"}
    for r in records.values():
        assert r.clean_speaker_id in ("_s1", "s2")
        assert r.clean_source_standardized_num_samples == (900 if r.clean_speaker_id == "_s1" else 1000)
        for name in (r.clean_output, r.noisy_output):
            layout = WV.wav_layout((tmp_path / "out" / name).read_bytes())
            assert layout["rate"] == 48000 and layout["frames"] == made.audio.where(F.col("sample_id") == r.sample_id).count()
    assert spark.read.json(f"{target}/metadata/unreadable").first().rel == "wav/s2/bad.wav"
    with pytest.raises(FileExistsError):
        D.generate_files(spark, config, str(root), target, **options)
    again = D.generate_files(spark, config, str(root), target, resume=True, **options)
    assert {r.sample_id for r in again.records.collect()}.isdisjoint(records)
