import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filter_design as D
from pulsegrid.operators import blocks as K
from pulsegrid.operators import kernels as C
from pulsegrid.operators import normalise as N
from pulsegrid.operators import recursive as I
from pulsegrid.operators import repair as R
from pulsegrid.operators import windows as W
from pulsegrid.plans import preprocess as P
from tests.helpers import both_ways, collect, despike, frame, recursion, resampled

rng = np.random.default_rng(0)
NAN = float("nan")


def blocks_of(spark, signals, block):
    return K.to_blocks(frame(spark, signals), block)


def assert_same(got, want, tol=1e-9):
    assert set(got) == set(want)
    for k in want:
        assert len(got[k]) == len(want[k]), k
        np.testing.assert_allclose(got[k], want[k], atol=tol, rtol=0)


def test_gaps(spark):
    long_gap = [1.0] + [NAN] * 40 + [42.0]
    signals = {"start": [NAN, NAN, 3, 4], "mid": [1, NAN, NAN, 4], "end": [1, 2, NAN, NAN],
               "all": [NAN] * 9, "none": [5.0, 6.0], "long": long_gap, "tail": [2.0] + [NAN] * 20}
    got = collect(R.fill_gaps(blocks_of(spark, signals, 4), 4))
    want = {}
    for k, v in signals.items():
        x = np.array(v, float)
        bad = np.isnan(x)
        if bad.any() and not bad.all():
            x[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), x[~bad])
        want[k] = x
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-12)


def test_gaps_across_runs_of_blocks(spark):
    x = np.full(3000, NAN)
    x[0], x[-1] = 0.0, 2999.0
    got = collect(R.fill_gaps(blocks_of(spark, {"r": list(x)}, 1), 1))
    np.testing.assert_allclose(got["r"], np.arange(3000.0), atol=1e-9)


def test_normalisers(spark):
    signals = {"a": list(rng.normal(size=50) * 3 + 1), "flat": [7.0] * 10, "one": [2.0]}
    b = blocks_of(spark, signals, 8)
    x = {k: np.array(v) for k, v in signals.items()}

    def peak(v):
        c = v - v.mean()
        return np.clip(c / np.abs(c).max(), -1, 1) if np.abs(c).max() > 0 else c

    assert_same(collect(N.abs_max(b)), {k: peak(v) for k, v in x.items()})
    assert_same(collect(N.min_max(b)), {k: (np.zeros_like(v) if np.ptp(v) == 0 else
                                            (v - v.min()) / np.ptp(v) * 2 - 1) for k, v in x.items()})
    assert_same(collect(N.z_score(b)), {k: (v - v.mean()) / (v.std() + 1e-8) for k, v in x.items()}, 1e-6)

    def kp(v, k=3):
        s = np.sort(v)
        lo, hi = s[:k].mean(), s[-k:].mean()
        return np.zeros_like(v) if hi <= lo else -1 + (v - lo) / (hi - lo) * 2

    assert_same(collect(N.k_peak(b)), {k: kp(v) for k, v in x.items()})
    got = collect(N.min_max(b))["a"]
    assert got.min() == -1.0 and got.max() == 1.0


def test_despike_matches_round_by_round(spark):
    win = 10
    signals = {}
    for i in range(12):
        x = np.sin(np.arange(203) * (0.3 + 0.05 * i)) + 0.2 * rng.normal(size=203)
        for at in rng.integers(0, 203, size=i):
            x[at] += rng.choice([-1, 1]) * rng.uniform(5, 60)
        signals[f"r{i:02d}"] = list(x)
    signals["short"] = [1.0, 50.0, 1.0]
    signals["zero"] = [0.0] * 40
    tone = np.sin(2 * np.pi * 40 * np.arange(3000) / 1000.0)
    tone[1500] = 50.0
    b = blocks_of(spark, signals, win)
    out = R.remove_spikes(b, win)
    assert_same(collect(out), {k: despike(v, win) for k, v in signals.items()})
    clean = collect(R.remove_spikes(blocks_of(spark, {"t": list(tone)}, 500), 500))["t"]
    assert np.abs(clean).max() < 5


def test_despike_with_more_windows_than_rounds(spark):
    """Only the loudest windows and those near the middle rank reach the task."""
    win, rounds = 4, 6
    x = rng.normal(size=400)
    x[rng.integers(0, 400, size=12)] *= 40
    b = blocks_of(spark, {"r": list(x), "s": list(x[::-1])}, win)
    got = collect(R.remove_spikes(b, win, rounds=rounds))
    assert_same(got, {"r": despike(x, win, rounds=rounds), "s": despike(x[::-1], win, rounds=rounds)})


def test_despike_marks_spikes_it_cannot_flatten(spark):
    x = [0.1, -0.1] * 50
    x[19] = 30.0  # last sample of its window: the range to flatten ends before it
    rows = R.remove_spikes(blocks_of(spark, {"r": x}, 20), 20).collect()
    assert any(r["unresolved"] for r in rows)
    np.testing.assert_allclose(collect(R.remove_spikes(blocks_of(spark, {"r": x}, 20), 20))["r"],
                               despike(x, 20))


@pytest.mark.parametrize("block", [8, 64])
def test_causal_filters(spark, block):
    signals = {"a": list(rng.normal(size=100)), "b": list(rng.normal(size=17)), "c": [1.0]}
    sos = D.band_sections(100.0, 450.0, 1000.0)
    got = collect(I.band(blocks_of(spark, signals, block), block, 1000.0, 100.0, 450.0))
    assert_same(got, {k: recursion(v, sos) for k, v in signals.items()})


@pytest.mark.parametrize("kind,edges,order", [("low", [80.0], 4), ("high", [100.0], 3),
                                              ("band", [90.0, 200.0], 2), ("stop", [90.0, 200.0], 2)])
def test_zero_phase(spark, kind, edges, order):
    signals = {"a": list(rng.normal(size=130)), "b": list(rng.normal(size=33)), "c": list(rng.normal(size=64))}
    sos = D.butterworth(order, [e / 500 for e in edges], kind)
    edge = D.edge_length(sos)
    got = collect(I.butter_zero_phase(blocks_of(spark, signals, 32), 32, 1000.0, edges, kind, order))
    assert_same(got, {k: both_ways(v, sos, edge) for k, v in signals.items()}, 1e-7)


def test_band_pass_passes_and_blocks(spark):
    t = np.arange(3000) / 1000
    tones = {"in": list(np.sin(2 * np.pi * 90 * t)), "low": list(np.sin(2 * np.pi * 5 * t)),
             "high": list(np.sin(2 * np.pi * 480 * t))}
    got = collect(I.butter_zero_phase(blocks_of(spark, tones, 512), 512, 1000.0, [25.0, 400.0], "band"))
    power = {k: np.mean(v ** 2) for k, v in got.items()}
    assert power["in"] > 0.3 and power["low"] < 0.05 and power["high"] < 0.05


def test_unstable_filter_is_refused():
    with pytest.raises(ValueError):
        I.reach(np.array([[1.0, 0, 0, 1.0, -2.1, 1.2]]), 8)


def test_convolution_and_bands(spark):
    signals = {"a": list(rng.normal(size=90)), "b": list(rng.normal(size=33))}
    h = rng.normal(size=9)
    got = collect(C.convolve(blocks_of(spark, signals, 16), h))
    assert_same(got, {k: np.convolve(v, h, "same") for k, v in signals.items()})
    kernels = D.four_bands(1000.0, 15)
    out = C.split_bands(blocks_of(spark, signals, 16), kernels)
    for band, k in enumerate(kernels):
        full = np.convolve(k, k[::-1])
        want = {n: np.convolve(np.pad(v, 14, mode="reflect", reflect_type="odd"), full, "valid")
                for n, v in signals.items()}
        assert_same(collect(out.where(F.col("band") == band)), want)


@pytest.mark.parametrize("fs_in,fs_out", [(2000, 4125), (1000, 1500), (2000, 1000)])
def test_resampling(spark, fs_in, fs_out):
    signals = {"a": list(rng.normal(size=200)), "b": list(rng.normal(size=31))}
    up, down, taps = D.resample_kernel(fs_in, fs_out)
    got = collect(C.resample(blocks_of(spark, signals, 64), 64, fs_in, fs_out))
    assert_same(got, {k: resampled(v, up, down, taps) for k, v in signals.items()})
    for k, v in signals.items():
        assert abs(len(got[k]) - len(v) * fs_out / fs_in) <= 1


def test_window_counts_and_edges(spark):
    start, win, hop = 3, 16, 12
    lengths = [1, 3, 4, 16, 18, 19, 20, 30, 31, 43, 44, 100]
    signals = {f"n{n:03d}": list(np.arange(n, dtype=float) + 1) for n in lengths}
    rows = W.windows(blocks_of(spark, signals, 8), 8, start, win, hop).collect()
    for n in lengths:
        mine = sorted((r for r in rows if r["record_id"] == f"n{n:03d}"), key=lambda r: r["win_no"])
        starts = [] if n <= start else list(range(start, max(start, n - win) + 1, hop))
        assert [r["start_idx"] for r in mine] == starts
        for r, s in zip(mine, starts):
            chunk = np.arange(n, dtype=float)[s:s + win] + 1
            assert r["valid_len"] == len(chunk)
            np.testing.assert_allclose(r["waveform"], np.pad(chunk, (0, win - len(chunk))))
    spec = W.WindowSpec(2.0)
    assert spec.samples(1000) == (300, 2000, 1750)


def test_chains_are_finite_and_bounded(spark):
    x = np.sin(np.arange(2400) * 0.2) + 0.1 * rng.normal(size=2400)
    x[700] = 90.0
    x[5] = NAN
    rows = frame(spark, {"r": list(x)})
    for chain in (P.pcg, P.ecg):
        y = collect(chain(rows, 1024, 1000, 1500))["r"]
        assert len(y) == 3600 and np.isfinite(y).all() and np.abs(y).max() <= 1 + 1e-6


def test_pcg_chain_against_plain_steps(spark):
    x = np.sin(np.arange(1800) * 0.2) + 0.1 * rng.normal(size=1800)
    x[[250, 900, 901]] = [80.0, -70.0, 60.0]
    x[10:14] = NAN
    got = collect(P.pcg(frame(spark, {"r": list(x)}), 256, 1000, 1500))["r"]
    bad = np.isnan(x)
    v = x.copy()
    v[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), x[~bad])
    v = resampled(v, *D.resample_kernel(1000, 1500))
    v = recursion(despike(v, 750), D.band_sections(25.0, 450.0, 1500.0))
    v = v - v.mean()
    np.testing.assert_allclose(got, v / np.abs(v).max(), atol=1e-9)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_partitioning_does_not_matter(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        x = {"a": list(np.sin(np.arange(90) * 0.7) * np.arange(90)), "b": list(np.cos(np.arange(40.0)))}
        b = K.to_blocks(frame(spark, x).repartition(parts), 16)
        got = collect(N.abs_max(I.band(b, 16, 1000.0, 100.0, 450.0)))
        for k, v in x.items():
            y = recursion(v, D.band_sections(100.0, 450.0, 1000.0))
            y = y - y.mean()
            np.testing.assert_allclose(got[k], y / np.abs(y).max(), atol=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_gap_does_not_reach_the_other_samples(spark):
    nan, rng_ = float("nan"), np.random.default_rng(4)
    x = {k: rng_.normal(size=50) for k in ("start", "middle", "end", "none")}
    for k, at in (("start", [0, 1]), ("middle", [20, 21, 33]), ("end", [48, 49])):
        x[k][at] = nan
    x["all"] = np.full(50, nan)
    blocks = K.to_blocks(frame(spark, {k: list(v) for k, v in x.items()}), 16)
    filled, plain = collect(N.abs_max(blocks, block=16)), collect(N.abs_max(blocks))
    for k, v in x.items():
        bad = np.isnan(v)
        if bad.all():
            assert np.isnan(filled[k]).all()
            continue
        y = v.copy()
        y[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), v[~bad])
        y -= y.mean()
        np.testing.assert_allclose(filled[k], y / np.abs(y).max(), atol=1e-12)
        z = v - np.nanmean(v)
        np.testing.assert_allclose(plain[k], z / np.nanmax(np.abs(z)), atol=1e-12)


def test_blocks_shorter_than_the_kernel_are_refused(spark):
    x = np.random.default_rng(5).normal(size=200)
    kernel = np.hanning(63)[1:-1]
    for block in (5, 16, 64):
        blocks = K.to_blocks(frame(spark, {"r": list(x)}), block)
        if block < 30:
            with pytest.raises(Exception, match="shorter than the 30"):
                C.convolve(blocks, kernel).collect()
        else:
            np.testing.assert_allclose(collect(C.convolve(blocks, kernel))["r"], np.convolve(x, kernel, "same"), atol=1e-12)


def test_the_plan_of_a_notch_chain_does_not_grow(spark):
    blocks = K.to_blocks(frame(spark, {"r": list(np.random.default_rng(6).normal(size=300))}), 64)
    sizes = [I.notch_chain(blocks, 64, 1000, list(range(100, 100 + 50 * n, 50)))._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (2, 4)]
    assert sizes[1] == sizes[0]


def test_recordings_of_many_rates_resample_as_each_would_alone(spark):
    rates = {"a": 1000, "b": 1500, "c": 4125, "d": 2000, "e": 2000}
    signals = {k: list(rng.normal(size=n)) for k, n in zip(rates, (300, 257, 700, 31, 512))}
    table = blocks_of(spark, signals, 64)
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col("record_id")]
    got = collect(C.resample_mixed(table.withColumn("fs", rate), 64, 1500))
    alone = {}
    for fs in set(rates.values()):
        alone |= collect(C.resample(table.where(rate == fs), 64, fs, 1500))
    assert_same(got, alone)
    assert C.resample_mixed(table.withColumn("fs", rate).limit(0), 64, 1500).count() == 0
    for bad in (F.lit(None).cast("int"), F.lit(0)):
        with pytest.raises(ValueError, match="rate"):
            C.resample_mixed(table.withColumn("fs", bad), 64, 1500)


def test_chain_takes_each_recording_from_its_own_rate(spark):
    signals = {k: list(np.sin(np.arange(n) * 0.2) + 0.1 * rng.normal(size=n)) for k, n in (("a", 900), ("b", 1200))}
    table = blocks_of(spark, signals, 256)
    rate = F.when(F.col("record_id") == "a", 1000).otherwise(2000)
    got = collect(P.by_kind_blocks(table.withColumn("fs", rate), 256, None, 1500))
    want = collect(P.by_kind_blocks(table.where("record_id = 'a'"), 256, 1000, 1500)) | collect(P.by_kind_blocks(table.where("record_id = 'b'"), 256, 2000, 1500))
    assert_same(got, want)
