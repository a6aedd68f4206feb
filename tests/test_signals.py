"""Signal operators against NumPy, with blocks far shorter than the signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import filters as FB
from wavelake.operators import signals as S
from wavelake.plans.ordered import with_block


def table(spark, signals, block=64, **columns):
    rows = [(k, t, float(v)) for k, x in signals.items() for t, v in enumerate(x)]
    return with_block(spark.createDataFrame(rows, "signal_id string, t bigint, x double").repartition(6), "t", block)


def arrays(df, column="x"):
    out = {}
    for r in df.select("signal_id", "t", column).collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(2)
    return {"long": rng.normal(size=1000) * 0.2, "short": rng.normal(size=5)}


def test_zero_phase_filter_is_a_convolution(spark, signals):
    taps = S.zero_phase_taps(80, 400, 2000, half=40)
    got = arrays(S.zero_phase_filter(table(spark, signals), taps, size=64))
    for k, x in signals.items():
        want = np.convolve(x, taps)[40 : 40 + len(x)]
        assert np.allclose(got[k], want, atol=1e-12)


def test_filter_response():
    taps = S.zero_phase_taps(70, None, 48000)
    t = np.arange(len(taps)) - (len(taps) - 1) // 2
    gain = lambda hz: abs(np.sum(taps * np.exp(-2j * np.pi * hz * t / 48000)))
    assert gain(0.0) < 1e-3 and gain(70) == pytest.approx(0.5, abs=1e-3) and gain(1000) == pytest.approx(1, abs=1e-4)
    band = S.zero_phase_taps(80, 8000, 48000)
    gain = lambda hz: abs(np.sum(band * np.exp(-2j * np.pi * hz * t / 48000)))
    assert gain(10) < 1e-2 and gain(1000) == pytest.approx(1, abs=1e-3) and gain(20000) < 1e-3


@pytest.mark.parametrize("up,down", [(3, 2), (2, 3), (160, 147), (1, 3)])
def test_resample_matches_direct_formula(spark, signals, up, down):
    taps = S.resample_taps(up, down)
    half = (len(taps) - 1) // 2
    got = arrays(S.resample(table(spark, signals), up, down, size=64))
    for k, x in signals.items():
        raised = np.zeros(len(x) * up)
        raised[::up] = x
        want = np.convolve(raised, taps)[half:][: len(x) * up : down]
        assert len(got[k]) == -(-len(x) * up // down)
        assert np.allclose(got[k], want[: len(got[k])], atol=1e-9)


@pytest.mark.parametrize("lag", [-17, 0, 9])
def test_lag_over_blocks(spark, lag):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    moved = np.roll(np.r_[x, np.zeros(40)], lag)[:600] if lag > 0 else np.r_[x[-lag:], np.zeros(-lag)]
    rows = [("a", t, float(x[t]), float(moved[t])) for t in range(600)]
    pairs = with_block(spark.createDataFrame(rows, "signal_id string, t bigint, clean double, noisy double"), "t", 64)
    assert S.best_lag(pairs, 30, size=64).first().lag == lag
    assert S.phat_lag(pairs, 30, size=64).first().lag == lag
    # The FFT that is split over groups gives the same answer as the one in a single group.


def test_align_none_and_plain(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    clean = table(spark, {"a": x})
    estimate = table(spark, {"a": np.r_[np.zeros(5), x * 0.5]})
    r = S.align_and_gain_match(clean, estimate, 10, "phat", size=64).first()
    assert r.lag == 5 and r.gain == pytest.approx(2.0) and r.snr > 90
    assert S.align_and_gain_match(clean, clean, 10, "none", size=64).first().gain == pytest.approx(1.0)


def regions_by_mask(x, fl, hop, below, floor, gap, least):
    """Samples of loud frames as a mask; short holes between them are filled, short runs are dropped."""
    n = len(x)
    starts = np.arange(0, max(n - fl, 0) + 1, hop)
    db = np.array([10 * np.log10(np.mean(x[s : s + fl] ** 2) + 1e-24) for s in starts])
    mask = np.zeros(n + 2, dtype=bool)
    for s in starts[db > max(np.percentile(db, 95) - below, floor)]:
        mask[1 + s : 1 + min(n, s + fl)] = True
    edges = lambda m: list(zip(*np.flatnonzero(np.diff(m.astype(int))).reshape(-1, 2).T))
    runs = edges(mask)
    for (_, a), (b, _) in zip(runs, runs[1:]):
        if b - a < gap:
            mask[a + 1 : b + 1] = True
    return {(int(a), int(b)) for a, b in edges(mask) if b - a >= least}


def test_active_regions(spark):
    rng = np.random.default_rng(5)
    gate = (np.sin(np.arange(3000) / 120) > 0).astype(float)
    signals = {"gated": rng.normal(size=3000) * gate * 0.3 + rng.normal(size=3000) * 1e-4, "tiny": rng.normal(size=7)}
    got = S.detect_active_regions(table(spark, signals), 50, 20, 25.0, -70.0, 30, 40, size=64)
    for k, x in signals.items():
        want = regions_by_mask(x, 50, 20, 25.0, -70.0, 30, 40)
        assert {(r.start_sample, r.end_sample) for r in got.where(F.col("signal_id") == k).collect()} == want


def test_lag_is_found_behind_a_long_silence(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([np.zeros(481_000), rng.normal(size=2000)])
    y = np.concatenate([np.zeros(20), x[:-20]])
    rows = spark.range(len(x)).toPandas().rename(columns={"id": "t"}).assign(signal_id="a", clean=x, noisy=y)
    pairs = with_block(spark.createDataFrame(rows).repartition(8), "t")
    assert abs(S.best_lag(pairs, 50).first().lag) == 20


def test_mix_hits_the_target(spark):
    rng = np.random.default_rng(6)
    clean, noise = rng.normal(size=500) * 0.4, rng.normal(size=500) * 0.01
    rows = [("a", t, float(clean[t]), float(noise[t]), bool(t % 4)) for t in range(500)]
    df = with_block(spark.createDataFrame(rows, "signal_id string, t bigint, clean double, noise double, mask boolean"), "t", 64)
    mixed = S.mix_at_snr(df, F.lit(7.5))
    r = S.measured_snr(mixed).first()
    assert r.measured_snr_db == pytest.approx(7.5, abs=0.01) and r.peak_amplitude <= 0.991 and r.rejection is None


def test_declip_brings_the_sine_back(spark):
    t = np.arange(4000)
    x = np.sin(2 * np.pi * t / 200)
    clipped = np.clip(x, -0.97, 0.97)
    df = table(spark, {"a": clipped, "clean": x * 0.5})
    got = arrays(S.declip(df, most=0.2))
    assert np.abs(got["a"] - x).max() < np.abs(clipped - x).max() / 5
    assert np.array_equal(got["clean"], x * 0.5)


def test_delay_and_levels(spark, signals):
    lags = spark.createDataFrame([("long", 7), ("short", -3)], "signal_id string, lag bigint")
    got = arrays(S.apply_delay(table(spark, signals), lags, size=64))
    assert np.array_equal(got["long"], signals["long"][7:])
    assert np.array_equal(got["short"], np.r_[np.zeros(3), signals["short"]])
    level = arrays(S.rms_normalize(table(spark, signals), -26.0))
    assert 20 * np.log10(np.sqrt(np.mean(level["long"] ** 2))) == pytest.approx(-26.0)
    assert np.mean(arrays(S.remove_dc(table(spark, signals)))["long"]) == pytest.approx(0, abs=1e-12)


def test_blocks_round_trip(spark, signals):
    blocks = S.blocks_from_samples(table(spark, signals), 64)
    assert blocks.selectExpr("max(size(samples))").first()[0] <= 64
    got = arrays(S.samples_from_blocks(blocks))
    assert np.allclose(got["long"], signals["long"].astype(np.float32))


# Forward and backward -------------------------------------------------------------------------------------------


def sections_by_definition(low, high, rate, n=4):
    """Numerator and denominator from the poles of the analogue low-pass, as whole polynomials."""
    p = np.exp(1j * np.pi * (2 * np.arange(n) + n + 1) / (2 * n))
    w = [2 * rate * np.tan(np.pi * f / rate) for f in (low, high) if f]
    if low and high:
        band, middle = w[1] - w[0], np.sqrt(w[0] * w[1])
        poles = np.concatenate([np.roots([1, -q * band, middle**2]) for q in p])
        zeros, gain = np.zeros(n), band**n
    elif low:
        poles, zeros, gain = w[0] / p, np.zeros(n), 1.0
    else:
        poles, zeros, gain = w[0] * p, np.zeros(0), w[0] ** n
    turn = lambda s: (2 * rate + s) / (2 * rate - s)
    gain = gain * np.real(np.prod(2 * rate - zeros) / np.prod(2 * rate - poles))
    zeros = np.concatenate([turn(zeros), -np.ones(len(poles) - len(zeros))])
    return gain * np.real(np.poly(zeros)), np.real(np.poly(turn(poles)))


def both_ways_by_definition(x, b, a, pad):
    """A plain difference equation over the reflected signal, from the state of rest, there and back."""
    reach = min(pad, len(x) - 1)
    whole = np.concatenate([2 * x[0] - x[1 : reach + 1][::-1], x, 2 * x[-1] - x[-reach - 1 : -1][::-1]]) if reach else x

    def once(u):
        level = u[0] * b.sum() / a.sum()
        y = []
        for i in range(len(u)):
            past_u = [u[i - k] if i >= k else u[0] for k in range(len(b))]
            past_y = [y[i - k] if i >= k else level for k in range(1, len(a))]
            y.append(np.dot(b, past_u) - np.dot(a[1:], past_y))
        return np.array(y)

    y = once(once(whole)[::-1])[::-1]
    return y[reach : len(y) - reach] if reach else y


@pytest.mark.parametrize("low, high", [(70, None), (80, 400), (None, 300)])
def test_forward_backward_by_definition(spark, low, high):
    rng = np.random.default_rng(21)
    signals = {"a": rng.normal(size=700).cumsum(), "b": rng.normal(size=20), "c": rng.normal(size=1), "d": np.ones(130)}
    sections = FB.butterworth(low, high, 2000)
    b, a = sections_by_definition(low, high, 2000)
    assert np.allclose(np.polymul(sections[0, :3], sections[1, :3]) if not (low and high) else b, b)
    for size in (64, 100_000) if low == 70 else (100,):
        got = arrays(FB.forward_backward(table(spark, signals), sections, size=size))
        for name, x in signals.items():
            assert np.allclose(got[name], both_ways_by_definition(x, b, a, FB.reach_beyond(sections)), atol=1e-6), (name, size)


def test_forward_backward_of_nothing(spark):
    assert FB.forward_backward(table(spark, {"a": np.ones(3)}).where("false"), FB.butterworth(70, None, 2000)).count() == 0


def test_phase_lag_of_many_short_signals_is_no_call_for_each(spark):
    rng = np.random.default_rng(9)
    shape = rng.normal(size=(300, 40)).tolist()
    rows = [(k, t, shape[k][t], shape[k][t - k % 5] if t >= k % 5 else 0.0) for k in range(300) for t in range(40)]
    pairs = with_block(spark.createDataFrame(rows, "signal_id int, t bigint, clean double, noisy double"), "t", 64)
    lags = S.phat_lag(pairs, 6, size=64)
    assert "FlatMapGroupsInPandas" not in lags._jdf.queryExecution().optimizedPlan().toString()
    found = {r.signal_id: r.lag for r in lags.collect()}
    assert found == {k: k % 5 for k in range(300)}
    assert {r.signal_id: r.lag for r in S.phat_lag(pairs.where("signal_id < 9"), 6, size=64, whole_bits=3).collect()} == {k: k % 5 for k in range(9)}


def test_blocks_of_many_signals_are_no_call_for_each(spark, signals):
    taps = S.zero_phase_taps(80, 400, 2000, half=40)
    rows = table(spark, signals).withColumn("signal_id", F.when(F.col("signal_id") == "long", "long"))
    done = S.zero_phase_filter(rows, taps, size=64)
    assert "FlatMapGroupsInPandas" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = arrays(done)
    for k, x in ((None, signals["short"]), ("long", signals["long"])):
        assert np.allclose(got[k], np.convolve(x, taps)[40 : 40 + len(x)], atol=1e-12)
