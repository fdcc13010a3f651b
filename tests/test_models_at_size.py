"""Models and masks rewritten for size."""

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorlab.operators import bayes, noise
from errorlab.operators import models as L
from errorlab.operators import windows as W
from test_bayes import plain, sample


def test_counts_reach_the_driver_packed(spark, monkeypatch):
    """No table of counts as rows on the driver, and steps of few postings in the tasks."""
    train, asked = sample(11, 60)
    model = bayes.fit(spark.createDataFrame(train, "y int, f array<string>"), "y", "f")

    def refused(self):
        raise AssertionError("collected as rows")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    got = bayes.predict(model, spark.createDataFrame(asked, "k int, f array<string>"), "k", "f", (0.1, 1.0)).collect()
    for i, alpha in enumerate((0.1, 1.0)):
        assert {r["k"]: r[f"prediction_{i}"] for r in got} == plain(train, asked, alpha)
    packed = bayes._packed(model.counts.select(bayes.ONE, "feature", "label", F.col("n").cast("bigint").alias("_w0")), [bayes.ONE], 1)
    want = Counter(f for _, feats in train for f in feats)
    assert {r["feature"]: sum(memoryview(bytes(r["_w0"])).cast("i")) for r in packed.collect()} == want


def test_steps_hold_few_postings(monkeypatch):
    import numpy as np

    sizes = []
    real = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: sizes.append(len(x)) or real(x, *a))
    monkeypatch.setattr(bayes, "CELLS", 20)
    starts, posts = np.array([0, 9, 10]), np.array([*range(9), 3], np.int32)  # a feature of nine classes, one of one
    found, ends = np.array([0, 0, -1, 1, 0, 0, 0, 1]), np.array([0, 1, 2, 3, 4, 8, 8])
    told = bayes._answer(np.arange(9), (np.zeros(9, np.int64), np.zeros(9, np.int64)), starts, posts,
                         np.array([5] * 9 + [7], np.int32), found, np.diff(ends), ends)
    assert told.tolist() == [0, 0, 0, 3, 3, 0]
    assert max(sizes) == 28 and len(sizes) > 2  # the one row with more than CELLS goes alone


def test_masks_are_plain_expressions(spark):
    sents = [[], [1], [1, 2], [1, 0, 3, 4, 5, 6, 7], None]
    rows = [(s, p) for s in sents for p in range(max(len(s or [0]), 1))]
    df = spark.createDataFrame(rows, "sent array<int>, pos int").withColumn("win", W.word_window(F.col("sent"), F.col("pos"), 5, checked=False))
    plain = df.withColumn("old", F.col("sent")).withColumn("was", F.col("win"))
    masked = W.mask_positions(plain, "win", "sent", "pos", 5)
    assert "lambda" not in masked.select("win", "sent")._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0].split("Generate")[0]
    scenarios = W.mask_scenarios(5)
    out = masked.collect()
    assert len(out) == 16 * len(rows)
    for r in out:
        mask = scenarios[r.scenario]
        assert r.win == (None if r.was is None else [0 if i in mask else v for i, v in enumerate(r.was)])
        assert r.sent == (None if r.old is None else [0 if i - r.pos + 2 in mask else v for i, v in enumerate(r.old)])


def test_rows_are_hashed_once_for_all_fits(spark):
    df = spark.createDataFrame([([1, 2, i % 9, 3, i % 4], i % 4 % 3, "train" if i % 5 else "valid") for i in range(200)],
                               "win array<int>, code int, split string")
    rows = L.preposition_rows(df, "win", "code", "split")
    assert rows.columns == ["label", "split", "features"]  # no sentence, no terms
    train, valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'")
    old = L.train_preposition(df.filter("split = 'train'"), "win", "code")
    assert old.stages[-1].coefficientMatrix == L.fit_prepositions(train).coefficientMatrix or \
        abs(old.stages[-1].coefficientMatrix.toArray() - L.fit_prepositions(train).coefficientMatrix.toArray()).max() < 1e-6
    assert [r for r, a in L.grid_search(train, valid) if a > 0.9][0] == 0.0


def test_distances_and_places_are_worked_out_once(monkeypatch):
    model = noise.EditModel([("match", "a", "a", 9), ("match", "b", "b", 9), ("replace", "a", "b", 3), ("insert", "b", "a", 2), ("delete", "b", "", 1)])
    calls = Counter()
    for name in ("_distance", "_places"):
        real = getattr(model, name)
        monkeypatch.setattr(model, name, lambda x, real=real, name=name: calls.update([name]) or real(x))
    first = [(w := model.corrupt("abba", str(k % 40), 1, 17), model.distance("abba", w)) for k in range(400)]
    assert calls["_places"] == 1 and calls["_distance"] == len({w for w, _ in first}) < 20
    model._pairs.clear()
    monkeypatch.setattr(noise, "REMEMBERED", 1)  # a full memory is emptied, with equal answers
    assert [(w := model.corrupt("abba", str(k % 40), 1, 17), model.distance("abba", w)) for k in range(400)] == first
    assert len(model._pairs) == 1
