import importlib
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import pieces as P
from pulsegrid.functions.pieces import PIECE_ROWS, pieces_udf
from pulsegrid.operators import spectra as S
from pulsegrid.plans import models as M
from pulsegrid.sources import wav as W

LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def large_batches(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "10000")
    yield spark
    spark.conf.set(LIMIT, before)


def test_a_function_sees_bounded_pieces_of_a_large_batch(large_batches):
    @pieces_udf("struct<id: bigint, seen: int>")
    def seen(ids: pd.Series, twice: pd.Series) -> pd.DataFrame:
        assert list(ids.index) == list(range(len(ids)))
        return pd.DataFrame({"id": twice - ids, "seen": len(ids)})

    one = large_batches.range(0, 1300, 1, 1)
    rows = one.select("id", seen("id", F.col("id") * 2).alias("s")).select("id", F.col("s.id").alias("same"), "s.seen").collect()
    assert [(r.id, r.same) for r in rows] == [(i, i) for i in range(1300)]
    assert {r.seen for r in rows} == {PIECE_ROWS, 1300 - 2 * PIECE_ROWS}
    assert one.where("id < 0").select(seen("id", "id")).collect() == []


def test_magnitudes_of_every_fragment_of_a_large_batch(large_batches):
    x = np.random.default_rng(1).normal(size=(1100, 24))
    rows = large_batches.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k INT, x ARRAY<DOUBLE>").coalesce(1)
    got = rows.select("k", S.magnitudes(F.col("x"), 8, 4, np.ones(8)).alias("m")).collect()
    for r in got:
        assert np.allclose(r.m, np.abs(np.fft.rfft(S._frames(x[r.k], 8, 4))))
    assert sorted(r.k for r in got) == list(range(1100))


@pytest.mark.parametrize("name", ["plans.models", "plans.store", "plans.augment_blocks", "operators.equaliser", "operators.kernels", "operators.cycles",
                                  "operators.spectra", "operators.repair", "operators.recursive"])
def test_functions_of_arrays_go_piece_by_piece(name):
    """A whole batch of arrays is never in Python objects at once."""
    module = importlib.import_module(f"pulsegrid.{name}")
    assert module.pieces_udf is pieces_udf and not hasattr(module, "pandas_udf")


def test_short_recordings_are_handed_on_before_a_batch_ends():
    class Files:
        select = lambda self, *_: self
        mapInPandas = lambda self, run, schema: run

    content = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 100, 200, 2, 16) + b"data" + struct.pack("<Ihh", 4, 1, 2)
    batch = pd.DataFrame({"path": [f"r{i}" for i in range(1300)], "content": [content] * 1300})
    made = list(W.decode(Files())(iter([batch])))
    assert [len(m) for m in made] == [PIECE_ROWS, PIECE_ROWS, 1300 - 2 * PIECE_ROWS]
    assert [p for m in made for p in m["path"]] == list(batch["path"])


def test_kernel_features_of_a_piece_are_bounded_by_their_numbers(large_batches, monkeypatch):
    class Every:
        setFeaturesCol = lambda self, _: self
        transform = lambda self, rows: rows.withColumn("selected", F.col("features"))

    asked = []
    monkeypatch.setattr(M, "pieces_udf", lambda returns, *rows: (asked.append(rows[0] if rows else PIECE_ROWS), pieces_udf(returns, *rows))[1])
    rng = np.random.default_rng(2)
    x, w, b = rng.normal(size=(300, 5)), rng.normal(size=(5, 1024)), rng.uniform(0, 6, 1024)
    rows = M.as_vectors(large_batches.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k INT, x ARRAY<DOUBLE>").coalesce(1))
    got = M.KernelProbe(Every(), w, b).mapped(rows).select("k", "kernel_features").collect()
    assert [n * 1024 <= 1 << 17 for n in asked] == [True]
    assert [r.k for r in got] == list(range(300))
    assert np.allclose([r.kernel_features.toArray() for r in got], np.sqrt(2 / 1024) * np.cos(x @ w + b))
    assert [P.piece_rows(n) for n in (0, 1, 1024, 1 << 20)] == [PIECE_ROWS, PIECE_ROWS, 128, 1]
