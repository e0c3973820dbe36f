"""Whole recordings in blocks: augmentation and recorded noise against the array forms, for several block lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators import corpus as N
from pulsegrid.operators import noise as Z
from pulsegrid.operators.blocks import cut_arrays
from pulsegrid.operators.equaliser import band_draws, coloured, coloured_blocks
from pulsegrid.operators.windows import windows
from pulsegrid.plans import augment as G
from pulsegrid.plans import augment_blocks as R

KEYS = ["record_id", "copy_no"]
ALWAYS = G.Odds(noise=4.0, stretch=1.0, volume=1.0, eq=1.0, wander=1.0, recorded=1.0)
SIZES = {"a": 300, "b": 97, "c": 31, "d": 64, "e": 1}


def signals(spark, seed=1, sizes=SIZES):
    rng = np.random.default_rng(seed)
    data = [(k, c, (np.sin(np.arange(n) / 5) + 0.3 * rng.normal(size=n)).tolist()) for k, n in sizes.items() for c in (1, 2)]
    data.append(("flat", 1, [0.5] * 50))
    return spark.createDataFrame(data, "record_id string, copy_no int, x array<double>")


def whole(blocks, block):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["record_id"], r["copy_no"], r["block"])):
        parts = out.setdefault((r["record_id"], r["copy_no"]), [])
        assert r["block"] == len(parts) and all(len(p) == block for p in parts)
        parts.append(np.array(r["values"], float))
    return {k: np.concatenate(v) for k, v in out.items()}


def arrays(frame, col="x"):
    return {(r["record_id"], r["copy_no"]): np.array(r[col], float) for r in frame.collect()}


def same(got, want, atol=1e-9):
    assert set(got) == set(want)
    for k in want:
        assert got[k].shape == want[k].shape, k
        np.testing.assert_allclose(got[k], want[k], atol=atol, err_msg=str(k))


def steps(block, fs=1000.0):
    return R.BlockSteps(block, fs, 3, KEYS, KEYS)


def cols():
    return [F.col(k) for k in KEYS]


@pytest.mark.parametrize("block", [16, 75, 512])
@pytest.mark.parametrize("rates", [(0.8, 1.2), (0.31, 0.32), (2.5, 3.5)])
def test_time_scaling_by_block(spark, block, rates):
    rate = R.between(*rates, 3, "s", "rate", *cols())
    frame = signals(spark)
    got = whole(R.time_scaled(cut_arrays(frame, "x", block, KEYS), block, rate, KEYS), block)
    same(got, arrays(frame.withColumn("x", A.stretch(F.col("x"), rate))))


@pytest.mark.parametrize("block", [16, 75, 512])
def test_random_filters_pass_their_states_on(spark, block):
    frame = signals(spark)
    draws = band_draws(3, "eq", *cols())
    blocks = cut_arrays(frame, "x", block, KEYS)
    left = blocks.join(blocks.groupBy(*KEYS).agg(F.max("block").alias("__most")), KEYS).withColumn("__left", F.col("__most") - F.col("block"))
    got = coloured_blocks(left, block, draws, 1000.0, 2.0, 400.0, KEYS, "__left")
    same(whole(got.withColumn("values", F.col("tinted")), block), arrays(frame.withColumn("x", coloured(F.col("x"), draws, 1000.0, 2.0, 400.0))))
    same(whole(got, block), arrays(frame), 0)


@pytest.mark.parametrize("block,odds", [(16, ALWAYS), (75, ALWAYS), (512, G.Odds())])
def test_heart_sounds_equal_the_array_form(spark, block, odds):
    frame = signals(spark)
    got = whole(R.augment_pcg_blocks(cut_arrays(frame, "x", block, KEYS), steps(block), odds), block)
    same(got, arrays(G.augment_pcg(frame, "x", 1000.0, 3, cols(), odds)), 1e-8)


def test_ecg_and_pairs_equal_the_array_form(spark):
    frame, other = signals(spark), signals(spark, 2, {k: n + 40 for k, n in SIZES.items()})
    got = whole(R.augment_ecg_blocks(cut_arrays(frame, "x", 50, KEYS), steps(50), ALWAYS), 50)
    same(got, arrays(G.augment_ecg(frame, "x", 1000.0, 3, cols(), ALWAYS)), 1e-8)
    both = G.augment_pair(frame.join(other.withColumnRenamed("x", "y"), KEYS), "x", "y", 1000.0, 3, cols(), ALWAYS)
    p, e = R.augment_pair_blocks(cut_arrays(frame, "x", 50, KEYS), cut_arrays(other, "x", 50, KEYS), steps(50), ALWAYS)
    same(whole(p, 50), arrays(both, "x"), 1e-8)
    same(whole(e, 50), arrays(both, "y"), 1e-8)


def noise_rows(spark, sizes, parts, seed=4, fs=1000):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(k, p, fs, rng.normal(size=n + 3 * i).tolist()) for k, n in sizes.items() for i, p in enumerate(parts)],
                                 "noise_id int, part string, fs int, x array<double>")


@pytest.mark.parametrize("block", [16, 100])
@pytest.mark.parametrize("kind", ["heart", "ecg"])
def test_noise_from_blocks_equals_the_array_form(spark, block, kind):
    parts, sizes = {"heart": (N.HEART_PARTS, {1: 400, 2: 90, 3: 20}), "ecg": (N.ECG_PARTS, {1: 500, 2: 33})}[kind]
    rows, frame = noise_rows(spark, sizes, parts), signals(spark)
    corpus = N.build_corpus(cut_arrays(rows, "x", block, ["noise_id", "part", "fs"]), list(parts), block, 1000)
    assert corpus.count == len(sizes)
    n = frame.select(*KEYS, F.size("x").cast("long").alias("n"))
    noise = N.noise_blocks(n, corpus, KEYS, parts, 3, cols(), kind == "heart")
    got = whole(N.add_noise(cut_arrays(frame, "x", block, KEYS), noise, KEYS), block)
    wide = rows.groupBy("noise_id").pivot("part", list(parts)).agg(F.first("x"))
    asked = Z.pick_noise(frame, wide, "noise_id", list(parts), 3, cols())
    made = (Z.heart_noise(F.col("aux1"), F.col("aux2"), F.size("x"), 3, cols()) if kind == "heart"
            else Z.ecg_noise({p: F.col(p) for p in parts}, F.size("x"), 3, cols()))
    same(got, arrays(asked.withColumn("x", Z.padded_add(F.col("x"), made))))


def test_corpus_of_many_rates_gaps_and_missing_parts(spark):
    parts = list(N.HEART_PARTS)
    rows = noise_rows(spark, {1: 100, 2: 200}, parts).unionByName(noise_rows(spark, {3: 100}, parts, fs=500)).unionByName(noise_rows(spark, {4: 50}, parts[:1]))
    rows = rows.withColumn("x", F.transform("x", lambda v, i: F.when((i == 5) & (F.col("noise_id") == 1), F.lit(float("nan"))).otherwise(v)))
    blocks = cut_arrays(rows, "x", 64, ["noise_id", "part", "fs"])
    corpus = N.build_corpus(blocks, parts, 64, 1000)
    sizes = {(r["noise_id"], r["part"]): r["size"] for r in corpus.sizes.collect()}
    assert sizes == {(1, "aux1"): 100, (1, "aux2"): 103, (2, "aux1"): 200, (2, "aux2"): 203, (3, "aux1"): 200, (3, "aux2"): 206}
    assert all(np.isfinite(r["values"]).all() for r in corpus.blocks.collect())
    assert [(r["noise_id"], r["missing"]) for r in N.unusable(rows, parts).collect()] == [(4, ["aux2"])]
    empty = N.build_corpus(blocks.where("noise_id = 4"), parts, 64, 1000)
    frame = signals(spark)
    noise = N.noise_blocks(frame.select(*KEYS, F.size("x").cast("long").alias("n")), empty, KEYS, N.HEART_PARTS, 3, cols(), True)
    assert empty.count == 0 and noise.count() == 0
    same(whole(N.add_noise(cut_arrays(frame, "x", 64, KEYS), noise, KEYS), 64), arrays(frame), 0)


def test_copies_are_balanced_by_record_and_cut_afterwards(spark):
    rng = np.random.default_rng(3)
    sizes = {f"r{i}": 200 + 40 * i for i in range(6)}
    frame = spark.createDataFrame([(k, "1", rng.normal(size=n).tolist()) for k, n in sizes.items()], "record_id string, channel string, x array<double>")
    splits = spark.createDataFrame([("r0", 0, "train"), ("r1", 0, "train"), ("r2", 0, "train"), ("r3", 1, "train"), ("r4", 1, "test"), ("r5", None, "train")],
                                   "record_id string, label int, subset string")
    blocks = cut_arrays(frame, "x", 64)
    every = R.with_record_copies(blocks, splits, 2, 64, 1000.0, 9, odds=G.Odds(eq=0.0))
    copies = {(r["record_id"], r["copy_no"]): r["n"] for r in every.groupBy("record_id", "copy_no").agg(F.sum(F.size("values")).alias("n")).collect()}
    assert {k for k in copies if k[1]} == {(r, c) for r in ("r0", "r1", "r2") for c in (1, 2)} | {("r3", c) for c in range(1, 7)}
    assert {k[0]: n for k, n in copies.items() if not k[1]} == sizes
    cut = windows(every, 64, 0, 100, 100, ["record_id", "channel", "copy_no"])
    assert cut.where("copy_no = 0").count() == sum(max(0, n - 100) // 100 + 1 for n in sizes.values())
    again = R.with_record_copies(blocks.repartition(5), splits, 2, 64, 1000.0, 9, odds=G.Odds(eq=0.0))
    order = lambda df: sorted((r["record_id"], r["copy_no"], r["block"], np.round(r["values"], 9).tolist()) for r in df.collect())
    assert order(every) == order(again)
