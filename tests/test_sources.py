"""Readers and writers on small generated files."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import signals as S
from wavelake.sources import files as FI
from wavelake.sources import sinks as SK
from wavelake.sources import wav as WV


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(0)
    files = [("wav/hi/s1/a.wav", 500), ("wav/hi/s2/b.WAV", 130), ("noise/wind/w.wav", 300), ("noise/top.wav", 90), ("wav/.hid/c.wav", 5)]
    for rel, n in [*files, ("named/_city/a.wav", 20), ("named/_x.wav", 30), ("named/deep/er/é b.wav", 40)]:
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(WV.wav_bytes(rng.normal(size=n) * 0.1))
    (root / "wav/hi/s1/note.txt").write_text("x")
    (root / "wav/hi/s1/bad.wav").write_bytes(b"RIFFjunk")
    (root / "wav/hi/s1/empty.wav").write_bytes(WV.wav_bytes(np.zeros(0)))
    return root


def test_scan_is_ordered_and_reads_no_content(spark, tree):
    scan = FI.scan_files(spark, str(tree), "wav")
    assert [r.rel for r in scan.collect()] == ["wav/hi/s1/a.wav", "wav/hi/s1/bad.wav", "wav/hi/s1/empty.wav", "wav/hi/s2/b.WAV"]
    assert "content" not in scan._jdf.queryExecution().executedPlan().toString()


def test_attributes_from_path_and_sidecar(spark, tree, tmp_path):
    side = tmp_path / "side.csv"
    side.write_text('path,clean_accent,clean_dataset\nwav\\hi\\s1\\a.wav,x,\nwav/hi/s1/a.wav, south ,lib\n,y,\nwav/hi/s2/b.WAV,,\n')
    sidecar = FI.read_sidecar(spark, str(side), ["clean_accent", "clean_dataset"])
    scan = FI.scan_files(spark, str(tree), "wav")
    rows = FI.with_attributes(scan, "clean", "wav", "base", "{clean_language}/{clean_speaker_id}/{file}", sidecar=sidecar)
    got = {r.rel: r for r in rows.collect()}
    a, b = got["wav/hi/s1/a.wav"], got["wav/hi/s2/b.WAV"]
    assert (a.clean_language, a.clean_speaker_id, a.clean_accent, a.clean_dataset) == ("hi", "s1", "south", "lib")
    assert (b.clean_accent, b.clean_dataset) == (None, "base")
    noise = FI.with_attributes(FI.scan_files(spark, str(tree), "noise"), "noise", "noise", level="top")
    assert {r.rel: r.noise_category for r in noise.collect()} == {"noise/top.wav": None, "noise/wind/w.wav": "wind"}


def test_probe_and_quarantine(spark, tree):
    good, bad = WV.quarantine(WV.probe_wav(WV.read_files(spark, str(tree / "wav"), "*.wav")))
    assert {r.path.rsplit("/", 1)[1]: (r.sample_rate, r.channels, r.frames) for r in good.collect()} == {"a.wav": (48000, 1, 500)}
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"bad.wav", "empty.wav"}


def test_wav_round_trip(spark, tree, tmp_path):
    files = WV.read_files(spark, str(tree / "wav/hi/s1"), "a.wav")
    blocks = WV.read_wav_blocks(files, 64)
    assert blocks.count() == 8 and blocks.selectExpr("max(size(samples))").first()[0] == 64
    part = WV.read_wav_blocks(files, 64, 100, 200).selectExpr("sum(size(samples))", "min(start)").first()
    assert tuple(part) == (100, 100)
    named = blocks.withColumn("path", F.lit("train/clean/x.wav"))
    for subtype, step in (("PCM_16", 1 / 32768), ("PCM_24", 1 / 8388608)):
        out = tmp_path / subtype
        written = WV.write_wav(named, str(out), subtype).collect()
        assert [(r.path, r.frames) for r in written] == [("train/clean/x.wav", 500)]
        back = WV.read_wav_blocks(WV.read_files(spark, str(out)), 64)
        pair = [S.samples_from_blocks(b.withColumn("signal_id", F.lit("x"))).select("t", F.col("x").alias(n)) for b, n in ((blocks, "a"), (back, "b"))]
        gap = pair[0].join(pair[1], "t").selectExpr("max(abs(a - b))", "count(*)").first()
        assert gap[0] <= step and gap[1] == 500


def test_stereo_and_float(tmp_path):
    import struct

    body = np.array([[0.5, -0.5], [1.0, 0.0]], dtype="<f4").tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 2, 16000, 128000, 8, 32)
    content = head + b"data" + struct.pack("<I", len(body)) + body
    layout = WV.wav_layout(content)
    assert (layout["rate"], layout["channels"], layout["frames"]) == (16000, 2, 2)
    assert WV.wav_samples(content, layout, 0, 2).tolist() == [0.0, 0.5]


RECORD = "sample_id STRING, x DOUBLE"


def test_records_repair_only_the_torn_tail(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    good = "".join(json.dumps({"sample_id": f"{i:06d}", "x": i / 2}) + "\n" for i in range(50))
    path.write_text(good + '{"sample_id": "0000')
    assert FI.read_records(spark, str(path), RECORD, repair=True).count() == 50
    with pytest.raises(RuntimeError):
        FI.read_records(spark, str(path), RECORD)
    path2 = tmp_path / "m.jsonl"
    path2.write_text(good + "{broken\n" + good)
    with pytest.raises(RuntimeError):
        FI.read_records(spark, str(path2), RECORD, repair=True)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, None, ["p", "q"])], "sample_id string, x double, note string, flags array<string>")
    SK.append_records(rows, str(tmp_path / "rec"))
    SK.append_records(rows, str(tmp_path / "rec"))
    assert FI.read_records(spark, str(tmp_path / "rec"), RECORD).count() == 2
    assert '"note":null' in spark.read.text(str(tmp_path / "rec")).first().value
    with pytest.raises(ValueError):
        SK.append_records(rows.withColumn("x", F.lit(float("nan"))), str(tmp_path / "bad"))
    SK.write_csv(rows, str(tmp_path / "csv"), ["sample_id", "flags"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"sample_id": "a", "flags": "p;q"}
    with pytest.raises(Exception, match="(?i)exist"):
        SK.write_csv(rows, str(tmp_path / "csv"), ["sample_id"], SK.write_mode())
    SK.write_csv(rows, str(tmp_path / "csv"), ["sample_id"], SK.write_mode(overwrite=True))
    SK.write_document(rows, str(tmp_path / "doc"))
    blocks = rows.select(F.lit("train").alias("split"), F.lit("clean").alias("kind"), "sample_id")
    SK.write_blocks(blocks, str(tmp_path / "audio"))
    assert (tmp_path / "audio/split=train/kind=clean").is_dir()
    failures = rows.select("sample_id", F.lit(0).alias("attempt"), F.lit(1).alias("random_seed"), F.lit("E").alias("error_type"), F.lit("m").alias("error"))
    SK.append_failures(failures, str(tmp_path / "fail"))


def test_inventory_keeps_indices(spark, tree, tmp_path):
    scan = FI.scan_files(spark, str(tree), "wav").select("rel", "size")
    SK.write_inventory(scan, "clean", str(tmp_path / "inv"))
    back = FI.read_inventory(spark, str(tmp_path / "inv"), "clean").orderBy("idx").collect()
    assert [(r.idx, r.rel) for r in back] == list(enumerate(r.rel for r in scan.collect()))
    doc = tmp_path / "inventory.json"
    doc.write_text(json.dumps({"clean": [{"path": "wav/z.wav", "size_bytes": 3}, {"path": "wav/a.wav", "size_bytes": 4}], "noise": []}, indent=1))
    rows = FI.read_inventory(spark, str(doc), "clean").orderBy("idx").collect()
    assert [(r.idx, r.rel, r.size) for r in rows] == [(0, "wav/z.wav", 3), (1, "wav/a.wav", 4)]


def test_archives_first_wins(spark, tmp_path):
    for name, files in (("one.zip", {"a/x.wav": b"1", "b.wav": b"22"}), ("two.zip", {"b.wav": b"333", "c.wav": b"4"})):
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            for member, content in files.items():
                archive.writestr(member, content)
    paths = [str(tmp_path / "one.zip"), str(tmp_path / "two.zip")]
    got = {r.member: (r.archive_ord, r.size) for r in FI.scan_archives(spark, paths).collect()}
    assert got == {"a/x.wav": (0, 1), "b.wav": (0, 2), "c.wav": (1, 1)}
    assert {(r.path, bytes(r.content)) for r in FI.read_members(spark, paths[1:], ["c.wav"]).collect()} == {("zip:c.wav", b"4")}


def test_stages_keep_their_order(spark, tree):
    rows = FI.scan_stages(spark, {"noisy": str(tree / "wav/hi"), "enhanced": str(tree / "noise")})
    assert {(r.stage, r.stage_ord) for r in rows.collect()} == {("noisy", 0), ("enhanced", 1)}


def test_manifest_is_text(spark, tmp_path):
    from wavelake.schema import MANIFEST_FIELDS

    path = tmp_path / "m.csv"
    path.write_text(",".join(MANIFEST_FIELDS) + "\n" + ",".join(["1"] * len(MANIFEST_FIELDS)) + "\n")
    assert FI.read_manifest(spark, str(path)).first().role == "1"


def test_listing_keeps_underscores_and_leaves_links(spark, tree):
    (tree / "named/linked").symlink_to(tree / "wav")
    scan = FI.scan_files(spark, str(tree), "named").collect()
    assert [(r.rel, r.size) for r in scan] == [("named/_city/a.wav", 84), ("named/_x.wav", 104), ("named/deep/er/é b.wav", 124)]
    assert all(r.path == f"file:{tree}/{r.rel}" and r.mtime for r in scan)
    probed = WV.probe_wav(FI.scan_files(spark, str(tree), "named"))
    assert sorted(r.frames for r in probed.collect()) == [20, 30, 40]


def test_probe_reads_the_head_alone(tmp_path, monkeypatch):
    """A long file with a chunk before the audio: a few ranges of a few bytes, never the samples."""
    import struct

    from wavelake.sources.stores import RangedFile

    content = WV.wav_bytes(np.zeros(200_000))
    junk = b"LIST" + struct.pack("<I", 9000) + b"x" * 9000
    path = tmp_path / "long.wav"
    path.write_bytes(content[:12] + junk + content[12:])
    file = RangedFile(str(path))
    asked = []
    read = file.read
    monkeypatch.setattr(file, "read", lambda start, length: (asked.append(length), read(start, length))[1])
    layout = WV.wav_layout(file)
    assert (layout["frames"], layout["data"]) == (200_000, 44 + len(junk))
    assert sum(asked) < 200


def test_long_file_is_read_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=50_000) * 0.1
    (tmp_path / "long.wav").write_bytes(WV.wav_bytes(x))
    files = spark.createDataFrame([(f"file:{tmp_path}/long.wav",)], "path string")
    blocks = WV.read_wav_blocks(files, 1000, range_bytes=4000).withColumn("task", F.spark_partition_id())
    rows = blocks.orderBy("block").collect()
    assert len(rows) == 50 and len({r.task for r in rows}) > 1
    assert np.allclose(np.concatenate([r.samples for r in rows]), np.rint(x * 32768) / 32768)
    part = WV.read_wav_blocks(files, 1000, 1500, 3200, 4000).orderBy("block").collect()
    assert [(r.block, r.start, len(r.samples)) for r in part] == [(1, 1500, 500), (2, 2000, 1000), (3, 3000, 200)]
    assert WV.read_wav_blocks(files, 1000, 60_000).count() == 0
    missing = spark.createDataFrame([(f"file:{tmp_path}/none.wav",)], "path string")
    assert WV.read_wav_blocks(missing).first().error


def test_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", 0, [0.1] * 10), ("b.wav", 0, [0.2] * 10)], "path string, block bigint, samples array<float>")
    out = tmp_path / "out"
    broken = rows.withColumn("samples", F.when(F.col("path") == "b.wav", F.array(F.raise_error(F.lit("stop")).cast("float"))).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="stop"):
        WV.write_wav(broken, str(out))
    assert not [p for p in out.rglob("*") if p.is_file()]
    short = rows.select("path", F.lit(11).cast("bigint").alias("frames"), "samples")
    spark.dataSource.register(WV.WavSink)
    with pytest.raises(Exception, match="missing"):
        short.write.format("wav_files").mode("append").save(str(out))
    assert not [p for p in out.rglob("*") if p.is_file()]
    WV.write_wav(rows, f"file:{out}")
    WV.write_wav(rows.where("path = 'b.wav'").withColumn("samples", F.array(F.lit(0.5).cast("float"))), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["a.wav", "b.wav"]
    assert WV.wav_layout((out / "b.wav").read_bytes())["frames"] == 1


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x.zip", "a/1.txt", b"one"), ("x.zip", "2.txt", b"two"), ("y.zip", "2.txt", b"other"), ("y.zip", "3.txt", b"")], "archive string, member string, content binary")
    made = FI.write_archives(rows, str(tmp_path / "zips"))
    assert {tuple(r) for r in made.collect()} == {("x.zip", 2), ("y.zip", 2)}
    paths = [str(tmp_path / "zips/y.zip"), str(tmp_path / "zips/x.zip")]
    got = {r.path: bytes(r.content) for r in FI.read_members(spark, paths).collect()}
    assert got == {"zip:2.txt": b"other", "zip:3.txt": b"", "zip:a/1.txt": b"one"}
    some = spark.createDataFrame([("3.txt",), ("none",)], "member string")
    assert [r.path for r in FI.read_members(spark, paths, some).collect()] == ["zip:3.txt"]


def test_files_of_floats_hold_what_codes_clip(spark, tmp_path):
    rows = [("a.wav", 0, [0.5, 1.25, -3.0]), ("b.wav", 0, [0.1])]
    blocks = spark.createDataFrame(rows, "path string, block bigint, samples array<float>")
    for subtype, want in (("PCM_16", [0.5, 32767 / 32768, -1.0]), ("FLOAT", [0.5, 1.25, -3.0])):
        WV.write_wav(blocks, str(tmp_path / subtype), subtype)
        read = WV.read_wav_blocks(WV.read_files(spark, str(tmp_path / subtype), "a.wav")).first()
        assert read.samples == want and read.error is None


def test_a_signal_beyond_full_scale_comes_back_in_16_bit_steps(spark, tmp_path):
    from wavelake.catalog.files import write_unclipped

    rows = [("a.wav", 0, [0.5, 1.02041, -3.0]), ("b.wav", 0, [0.1])]
    write_unclipped(spark.createDataFrame(rows, "path string, block bigint, samples array<float>"), str(tmp_path))
    read = WV.read_wav_blocks(WV.read_files(spark, str(tmp_path), "*.wav"))
    found = {r.path[-5:]: r.samples for r in read.collect()}
    assert found == {"a.wav": [0.5, round(1.02041 * 32768) / 32768, -3.0], "b.wav": [round(0.1 * 32768) / 32768]}


def test_measured_pairs_of_a_signal_beyond_full_scale(spark, tmp_path):
    from wavelake.catalog.files import measured_pairs
    from wavelake.catalog.registry import Tables

    rows = [(i, 1, i % 7, 560.21 if i == 21 else 50.0 + 13 * i % 97) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, h int, value double")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(event_id AS INT), 0)")
    events.select("event_id", ts.alias("ts"), "user_id", F.lit("x").alias("event_type"), "value").write.parquet(str(tmp_path / "events.parquet"))
    peak = measured_pairs(Tables(spark, str(tmp_path))).first().peak_noisy
    assert peak > 1.0


def long_numbers(spark, folder):
    """Orders and their lines with keys of five to seven digits."""
    source = "/root/testdata/sf0.001"
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{source}/{name}.parquet").where(F.col(key) < 60).withColumn(key, F.col(key) * 51_111)
        rows.write.parquet(f"{folder}/{name}.parquet")
    spark.read.parquet(f"{source}/part.parquet").write.parquet(f"{folder}/part.parquet")


@pytest.mark.parametrize("name", ["src6_snk1_records_round_trip", "sca14_sample_record"])
def test_records_of_long_numbers_match_their_twins(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    long_numbers(spark, str(tmp_path))
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(tmp_path)).select(*names).collect()
    assert len(got) == 60 and sorted(map(tuple, got)) == sorted(want.fetchall())
