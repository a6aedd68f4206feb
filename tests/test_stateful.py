"""Causal operators: blocks against one long loop, streams against batches, canceller properties."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import spectra as Z
from wavelake.operators import stateful as K
from wavelake.streaming import processors as P
from wavelake.streaming import windows as W


def energies(n=400):
    rng = np.random.default_rng(7)
    e = rng.gamma(2.0, 1.0, n)
    e[50:53] *= 500
    e[200:] *= 3000  # a step that stays: the floor is frozen from here on
    e[300:] /= 1e5
    return e


@pytest.fixture(scope="module")
def energy_table(spark):
    rows = [(k, t, float(v)) for k in (1, 2) for t, v in enumerate(energies() * k)]
    return spark.createDataFrame(rows, "signal_id bigint, frame bigint, energy double").repartition(5)


def detector_by_definition(e):
    """A frame is up within three frames of a jump of 13 dB over the floor, which averages the frames that are down."""
    floor, last_jump, out = e[0], -99, []
    for t in range(len(e)):
        rise = 10 * np.log10(e[t] / floor)
        if rise > 13:
            last_jump = t
        up = t < last_jump + 3
        out.append((up, min(max(rise / 40, 0), 1)))
        if not up:
            floor = 0.98 * floor + 0.02 * e[t]
    return out


@pytest.mark.parametrize("block", [16, 100_000])
def test_impulse_flags_by_definition(energy_table, block):
    got = K.impulse_flags(energy_table, block=block).orderBy("signal_id", "frame").collect()
    for k in (1, 2):
        want = detector_by_definition(energies() * k)
        mine = [r for r in got if r.signal_id == k]
        assert [r.flag for r in mine] == [up for up, _ in want]
        assert [r.severity for r in mine] == pytest.approx([s for _, s in want], abs=1e-9)


def test_impulse_scan_goes_on_from_its_state():
    e = energies()
    want = detector_by_definition(e)
    floor, held, flags = None, 0, []
    for at in range(0, 400, 7):
        up, _, floor, held = K.impulse_scan(e[at : at + 7], floor, held, stretch=4)
        flags += up.tolist()
    assert flags == [up for up, _ in want]


def test_exponential_mean_holds_over_gaps(spark):
    rows = spark.createDataFrame([("a", t, 1.0) for t in (0, 1, 5)] + [(None, 3, 1.0)], "k string, frame bigint, x double")
    got = K.exponential_mean(rows, ["k"], "x", 0.5, F.lit(1.0), "s", 2).collect()
    assert len(got) == 4 and all(r.s == pytest.approx(1.0) for r in got)


def ema(values, alpha, start):
    out, s = [], start
    for v in values:
        s = alpha * s + (1 - alpha) * v
        out.append(s)
    return np.array(out)


@pytest.mark.parametrize("alpha", [0.99, 0.5])
@pytest.mark.parametrize("block", [8, 2048])
def test_exponential_mean_over_blocks(energy_table, alpha, block):
    df = K.exponential_mean(energy_table, ["signal_id"], "energy", alpha, F.lit(5.0), "s", block)
    for k in (1, 2):
        got = [r.s for r in df.where(F.col("signal_id") == k).orderBy("frame").collect()]
        assert np.allclose(got, ema(energies() * k, alpha, 5.0), rtol=1e-10)


def streamed(spark, df, apply, batches=3):
    from wavelake.session import ensure_checkpoint_dir

    P.use_rocksdb(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    top = df.selectExpr("max(frame)").first()[0] + 1
    for i in range(batches):
        df.where(F.floor(F.col("frame") * batches / top) == i).write.mode("append").parquet(f"{folder}/in")
        out = W.run_available(apply(W.read_frames(spark, f"{folder}/in", df.schema)), folder)
    return out


def test_impulse_stream_equals_batch(spark, energy_table):
    want = {(r.signal_id, r.frame): (r.flag, r.severity) for r in K.impulse_flags(energy_table).collect()}
    got = {(r.signal_id, r.frame): (r.flag, r.severity) for r in streamed(spark, energy_table, P.impulse_flags).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_norm_streams_equal_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(k, f, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for k in (1, 2) for f in range(30)]
    frames = spark.createDataFrame(rows, "signal_id bigint, frame bigint, re array<double>, im array<double>")
    bins = frames.select("signal_id", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select(
        "signal_id", "frame", "bin", "z.re", "z.im"
    )
    want = {(r.signal_id, r.frame, r.bin): (r.re, r.im) for r in K.unit_norm(bins, count=4).collect()}
    for r in streamed(spark, frames, P.unit_norm).collect():
        for i in range(4):
            assert (r.re[i], r.im[i]) == pytest.approx(want[r.signal_id, r.frame, i])
    bands = bins.select("signal_id", "frame", F.col("bin").alias("band"), F.col("re").alias("erb"))
    want = {(r.signal_id, r.frame, r.band): r.erb_norm for r in K.erb_mean_norm(bands, count=4).collect()}
    erb = frames.select("signal_id", "frame", F.col("re").alias("erb"))
    for r in streamed(spark, erb, P.erb_mean_norm).collect():
        assert r.erb_norm == pytest.approx([want[r.signal_id, r.frame, i] for i in range(4)])


def test_overlap_add_stream_equals_batch(spark):
    rng = np.random.default_rng(9)
    rows = [(k, f, rng.normal(size=8).tolist()) for k in (1, 2) for f in range(12)]
    frames = spark.createDataFrame(rows, "signal_id bigint, frame bigint, x array<double>")
    want = {(r.signal_id, r.t): r.x for r in Z.overlap_add(frames, 4).collect()}
    for r in streamed(spark, frames, lambda s: P.overlap_add(s, 4)).collect():
        assert r.y == pytest.approx([want[r.signal_id, r.frame * 4 + i] for i in range(4)])


# Canceller ------------------------------------------------------------------------------------------------------


def canceller_frames(spark, s, y, x, mask, clipped=()):
    rows = [
        ("a", t, *[v.tolist() for v in (s[t].real, s[t].imag, y[t].real, y[t].imag, x[t].real, x[t].imag, mask[t])], False, False, t in clipped)
        for t in range(len(s))
    ]
    names = "s_re s_im y_re y_im x_re x_im mask".split()
    schema = "signal_id string, frame bigint, " + ", ".join(f"{n} array<double>" for n in names)
    return spark.createDataFrame(rows, schema + ", impulse boolean, impulse_tail boolean, ref_clipped boolean").repartition(3)


def noise(rng, t, f):
    return rng.normal(size=(t, f)) + 1j * rng.normal(size=(t, f))


def canceller_by_definition(s, y, x, mask, clipped):
    """Bin by bin with plain numbers: normalised step of half size, output kept where it would be louder."""
    z = s.copy()
    for f in range(s.shape[1]):
        w, before = 0j, 1.0
        for t in range(len(s)):
            a, b, c = complex(s[t, f]), complex(y[t, f]), complex(x[t, f])
            if t not in clipped:
                gain = a / (b + 1e-8)
                gain *= min(1, 1.5 / abs(gain))
                leak = w * gain * c
                worse = abs(a - leak) > abs(a) and abs(leak) > 1e-6 and abs(a) > 1e-6
                if abs(a) > 1e-6 and abs(leak) > 1e-6 and not worse:
                    z[t, f] = a - leak
                learnt = w + 0.5 * c.conjugate() * (b - w * c) / (abs(c) ** 2 + 1e-8) if before < 0.3 else w
                w = 0j if worse else learnt
            before = mask[t, f]
    louder = (np.abs(z) ** 2).sum(axis=1) > (np.abs(s) ** 2).sum(axis=1)
    return np.where(louder[:, None], s, z)


def test_canceller_groups_and_stream_by_definition(spark):
    rng = np.random.default_rng(10)
    x = noise(rng, 40, 12)
    y = 0.1 * noise(rng, 40, 12) + (0.5 - 0.3j) * x
    s, mask = 0.9 * y, rng.random((40, 12)) * 0.5
    frames = canceller_frames(spark, s, y, x, mask, clipped={5, 6})
    want = canceller_by_definition(s, y, x, mask, {5, 6})
    got = K.nlms_cancel(frames, block=7).orderBy("frame").collect()
    z = np.array([np.array(r.z_re) + 1j * np.array(r.z_im) for r in got])
    assert np.allclose(z, want, atol=1e-6)
    tele = K.canceller_telemetry(K.nlms_cancel(frames, block=7)).first()
    assert tele.frames == 40 and tele.ref_bypass_clipped == 2 and tele.ref_bypass_dead == 0
    flow = {r.frame: np.array(r.z_re) + 1j * np.array(r.z_im) for r in streamed(spark, frames, P.nlms_cancel).collect()}
    assert np.allclose(np.array([flow[t] for t in range(40)]), want, atol=1e-6)


def test_canceller_reduces_leakage(spark):
    rng = np.random.default_rng(11)
    x = noise(rng, 300, 6)
    y = (0.4 + 0.2j) * x
    frames = canceller_frames(spark, y, y, x, np.zeros((300, 6)))
    z = K.nlms_cancel(frames).where("frame >= 250").collect()
    left = sum(np.sum(np.array(r.z_re) ** 2 + np.array(r.z_im) ** 2) for r in z)
    assert 10 * np.log10(np.sum(np.abs(y[250:]) ** 2) / left) > 20


def test_canceller_without_adaptation_changes_nothing(spark):
    rng = np.random.default_rng(12)
    x, y = noise(rng, 20, 6), noise(rng, 20, 6)
    frames = canceller_frames(spark, y * 0.7, y, x, np.ones((20, 6)))
    dead = canceller_frames(spark, y * 0.7, y, x * 0, np.zeros((20, 6)))
    for rows in (K.nlms_cancel(frames).collect(), K.nlms_cancel(dead).collect()):
        for r in rows:
            assert np.allclose(np.array(r.z_re) + 1j * np.array(r.z_im), (y * 0.7)[r.frame], atol=1e-6)


@pytest.mark.parametrize("block", [3, 64, 512])
def test_canceller_blocks_by_definition(spark, block):
    """Resets that depend on the filter carried in, stretches without learning, and a whole signal in one block."""
    rng = np.random.default_rng(13)
    n = 150
    x = noise(rng, n, 5)
    y = 0.3 * noise(rng, n, 5) + np.where(np.arange(n)[:, None] < 70, 0.9, -0.9) * x
    s, mask = 0.8 * y, np.where((np.arange(n)[:, None] // 40) % 2 == 1, 1.0, 0.1) * np.ones((n, 5))
    frames = canceller_frames(spark, s, y, x, mask, clipped={60, 61, 62})
    got = K.nlms_cancel(frames, block=block).orderBy("frame").collect()
    z = np.array([np.array(r.z_re) + 1j * np.array(r.z_im) for r in got])
    want = canceller_by_definition(s, y, x, mask, {60, 61, 62})
    assert np.allclose(z, want, atol=1e-9)
    assert sum(r.bin_guard for r in got) > 0


def test_long_raised_stretch_needs_few_rounds(spark, monkeypatch):
    """A flag that stays up over many blocks: its floor goes on by the summaries, not by running block after block."""
    rng = np.random.default_rng(14)
    e = rng.gamma(2.0, 1.0, 1200)
    e[40:1100] *= 1e5
    rows = spark.createDataFrame([(None if k else 1, t, float(v)) for k in (0, 1) for t, v in enumerate(e)], "signal_id bigint, frame bigint, energy double")
    rounds = []
    kept = K.settled
    monkeypatch.setattr(K, "settled", lambda df: (rounds.append(1), kept(df))[1])
    got = K.impulse_flags(rows.repartition(4), block=20).orderBy("frame").collect()
    want = detector_by_definition(e)
    for k in (1, None):
        mine = [r for r in got if r.signal_id == k]
        assert [r.flag for r in mine] == [up for up, _ in want]
        assert [r.severity for r in mine] == pytest.approx([s for _, s in want], abs=1e-9)
    assert len(rounds) < 16  # 53 blocks lie in the stretch


# Frames in any order ----------------------------------------------------------------------------------------------


def arriving(spark, df, apply, parts, delay="1 hour"):
    """Runs the stream over each part in turn; every run goes on from the state of the one before."""
    from wavelake.session import ensure_checkpoint_dir

    P.use_rocksdb(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    for part in parts:
        df.where(part).write.mode("append").parquet(f"{folder}/in")
        out = W.run_available(apply(W.read_frames(spark, f"{folder}/in", df.schema).withWatermark("ts", delay)), folder)
    return out


BEGIN = 1_700_000_040  # a full minute; a stream takes rows at the epoch itself for late


def timed(df):
    return df.withColumn("ts", F.timestamp_millis(F.lit(BEGIN * 1000) + F.col("frame") * 10))


def test_late_frames_give_the_batch_result(spark, energy_table):
    want = {(r.signal_id, r.frame): (r.flag, r.severity) for r in K.impulse_flags(energy_table).collect()}
    part = F.pmod(F.xxhash64("signal_id", "frame"), F.lit(3))
    out = arriving(spark, timed(energy_table), P.impulse_flags, [part == i for i in (2, 0, 1)]).collect()
    assert len(out) == len(want)
    for r in out:
        assert r.flag == want[r.signal_id, r.frame][0]
        assert r.severity == pytest.approx(want[r.signal_id, r.frame][1], abs=1e-9)


def test_missing_frames_are_given_up_at_the_watermark(spark, energy_table):
    """Frame 100 never comes, frame 300 comes too late and a second frame 5 comes: the others are worked on without them."""
    rows = timed(energy_table).where("signal_id = 1 and frame <> 100")
    parts = [F.col("frame").between(0, 250), (F.col("frame") > 250) & (F.col("frame") != 300), F.col("frame").isin(5, 300)]
    out = arriving(spark, rows, P.impulse_flags, parts, "10 milliseconds").orderBy("frame").collect()
    frames = [r.frame for r in out]
    assert len(frames) == len(set(frames)) and set(frames) <= set(range(400)) - {100, 300}
    assert set(range(397)) - {100, 300} <= set(frames)
    used = [f for f in range(400) if f in set(frames)]
    want = detector_by_definition(energies()[used])
    assert [r.flag for r in out] == [up for up, _ in want]


def test_windows_on_a_stream_drop_only_what_is_behind_the_watermark(spark):
    rows = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 50, 2.0), ("a", 130, 3.0), ("a", 20, 4.0), ("a", 400, 5.0), ("a", 10, 100.0), ("a", 900, 6.0)],
        "signal_id string, frame bigint, value double",
    ).withColumn("ts", F.timestamp_seconds(F.col("frame") + BEGIN))
    apply = lambda s: W.tumbling(s, "1 minute", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")])
    parts = [F.col("value").isin(1.0, 2.0, 3.0), F.col("value") == 4.0, F.col("value") == 5.0, F.col("value") == 100.0, F.col("value") == 6.0]
    out = arriving(spark, rows, apply, parts, "3 minutes").select((F.unix_seconds("start") - BEGIN).alias("s"), "n", "v").collect()
    # The row of second 20 is late but within the watermark; that of second 10 comes when its window is closed.
    assert {tuple(r) for r in out} == {(0, 3, 7.0), (120, 1, 3.0), (360, 1, 5.0)}
