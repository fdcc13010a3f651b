"""Golden values taken from the reference's unit tests (see FIXTURES.md §2)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from errorlab.operators import sequences as X
from errorlab.operators import windows as W


def _win(spark, sent, position, size, nonce=None):
    df = spark.createDataFrame([(sent, position)], "sent array<int>, position int")
    return df.select(W.word_window(F.col("sent"), F.col("position"), size, nonce).alias("w")).first()["w"]


def test_word_window_start(spark):
    assert _win(spark, list(range(1, 12)), 0, 7) == [0, 0, 0, 1, 2, 3, 4]


def test_word_window_end_with_nonce(spark):
    assert _win(spark, list(range(1, 12)), 10, 7, 99) == [8, 9, 10, 99, 0, 0, 0]


@pytest.mark.parametrize("pos", [-1, 12])
def test_word_window_out_of_range_raises(spark, pos):
    with pytest.raises(Exception):
        _win(spark, list(range(1, 12)), pos, 7)


def test_temporal_difference_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 7))
    rows = [(s, t, float(x[s, t])) for s in range(2) for t in range(7)]
    df = spark.createDataFrame(rows, "seq_id int, t int, v double")
    got = {(r.seq_id, r.t): r.d for r in X.temporal_difference(df).collect()}
    want = x[:, 1:] - x[:, :-1]
    assert len(got) == 12
    for (s, t), d in got.items():
        assert abs(d - want[s, t]) < 1e-12


def test_split_by_filter_blocks(spark):
    vec = list(range(12))
    df = spark.createDataFrame([(0, vec)], "id int, v array<int>")
    out = X.split_by_filter(df, "id", "v", 3, 4).collect()
    for r in out:
        assert r.v == 4 * r.block + r.j


def test_max_energy_window_finds_block(spark):
    # sequence with a block of growing values starting at t=3
    vals = [0.0] * 9
    for k in range(3):
        vals[3 + k] = 1.0 + k
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(vals)], "seq_id int, t int, v double")
    out = X.max_energy_window(df, 3).collect()
    assert {r.t for r in out} == {3, 4, 5}
    assert out[0].start == 3


def test_zero_diagonal(spark):
    cells = spark.createDataFrame([(i, j, float(4 * i + j)) for i in range(4) for j in range(4)], "i int, j int, v double")
    for r in X.zero_diagonal(cells).collect():
        assert r.v == (0.0 if r.i == r.j else 4 * r.i + r.j)
