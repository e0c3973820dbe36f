import numpy as np
import pytest

from pulsegrid.operators.recursive import CELLS, bounded
from pulsegrid.operators.spectra import running_median
from pulsegrid.plans import fragments as B


@pytest.mark.parametrize("size", [1, 2, 5, 9, 30])
def test_running_median_mirrors_its_ends(size):
    x = np.random.default_rng(size).normal(size=(7, 3))
    half = size // 2
    mirrored = np.pad(x, ((half, size), (0, 0)), mode="symmetric")
    want = [[sorted(mirrored[i:i + size, j])[half] for j in range(3)] for i in range(7)]
    assert np.array_equal(running_median(x, size), want)


def test_rows_are_filtered_in_bounded_groups():
    sizes = [3, -1, CELLS, 5, CELLS // 2, CELLS // 2, 1, 0]
    groups = bounded(sizes)
    assert sorted(i for g in groups for i in g) == [0, 2, 3, 4, 5, 6, 7]
    assert all(len(g) == 1 or len(g) * max(sizes[i] for i in g) <= CELLS for g in groups)
    assert bounded([]) == [] and bounded([-1]) == []


def test_channels_are_named_and_stacked_in_order(spark):
    blocks = spark.createDataFrame([(1, 7, 0, [1.0]), (1, 0, 0, [2.0]), (1, 99, 0, [3.0])], "record_id int, channel int, block int, values array<double>")
    assert sorted(r.channel for r in B.named_channels(blocks).collect()) == ["1", "E"]
    rows = spark.createDataFrame([(1, 0, "E", [1.0], 1), (1, 0, "1", [2.0], 1), (1, 1, "E", [3.0], 1), (2, 0, "9", [4.0], 1)],
                                 "record_id int, win_no int, channel string, waveform array<double>, valid_len int")
    got = B.stacked(rows, ["1", "E"]).orderBy("win_no").collect()
    assert [(r.record_id, r.win_no, r.waveforms, r.present) for r in got] == [(1, 0, [[2.0], [1.0]], ["1", "E"]), (1, 1, [[3.0]], ["E"])]
    assert [(r.record_id, r.missing) for r in B.lacking(rows, ["1", "E", "9"]).orderBy("record_id").collect()] == [(1, ["9"]), (2, ["1", "E"])]
