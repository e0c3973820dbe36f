"""Sample windows out of streams of blocks, against the batch windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.blocks import cut_arrays
from pulsegrid.operators.windows import windows
from pulsegrid.streaming import operators as X
from pulsegrid.streaming.blocks import Tail, block_windows

START, WIN, HOP, BLOCK = 3, 16, 12, 8
SIZES = [1, 3, 4, 16, 18, 19, 20, 31, 100, 160]


def signals(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(f"r{n}", c, rng.normal(size=n).tolist()) for n in SIZES for c in ("1", "E")], "record_id string, channel string, x array<double>")


def rows(df):
    return sorted((r["record_id"], r["channel"], r["win_no"], r["start_idx"], r["valid_len"], tuple(r["waveform"])) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_any_order_of_blocks_and_batches_gives_the_batch_windows(spark, tmp_path, seed):
    blocks = cut_arrays(signals(spark), "x", BLOCK)
    want = rows(windows(blocks, BLOCK, START, WIN, HOP))
    src = str(tmp_path / "src")
    held = blocks.collect()
    order = np.random.default_rng(seed).permutation(len(held))
    for part in np.array_split(order, 4):
        # Some blocks come again in a later batch.
        again = [held[i] for i in part] + ([held[order[0]]] if seed else [])
        spark.createDataFrame(again, blocks.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    X.write_updates(block_windows(stream, START, WIN, HOP), out, str(tmp_path / "state")).awaitTermination()
    assert rows(X.latest_updates(spark, out, ["record_id", "channel", "win_no"])) == want


def test_a_tail_survives_its_state_and_stays_short():
    x = np.arange(400.0)
    tail, seen = Tail(START, WIN, HOP), {}
    for i in range(0, 400, BLOCK):
        for k, at, n, w in tail.add([(i // BLOCK, x[i:i + BLOCK])]):
            seen[k] = (at, n, w.tolist())
        tail = Tail(START, WIN, HOP, tail.state())
        assert len(tail.tail) <= WIN + HOP and not tail.early
    assert [v[0] for v in seen.values()] == list(range(START, 400 - WIN + 1, HOP)) and all(v[2] == x[v[0]:v[0] + WIN].tolist() for v in seen.values())


def test_blocks_without_a_place_are_left_out_and_hops_may_skip(spark, tmp_path):
    src = str(tmp_path / "src")
    odd = spark.createDataFrame([("a", "1", 0, [1.0] * 8), ("a", "1", 1, [2.0] * 8), (None, "1", 0, [1.0]), ("a", None, 0, [1.0]), ("a", "1", None, [1.0]), ("b", "1", 0, None),
                                 ("c", "1", 1, [1.0] * 8)], "record_id string, channel string, block long, values array<double>")
    odd.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(odd.schema).parquet(src)
    out = str(tmp_path / "out")
    X.write_updates(block_windows(stream, 0, 4, 10), out, str(tmp_path / "state")).awaitTermination()
    got = rows(X.latest_updates(spark, out, ["record_id", "channel", "win_no"]))
    assert got == [("a", "1", 0, 0, 4, (1.0,) * 4), ("a", "1", 1, 10, 4, (2.0,) * 4)]
