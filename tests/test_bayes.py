"""Naive Bayes over count tables against a plain version that looks at every class."""

import math
import random
from collections import Counter

import pytest

from errorlab.operators import bayes


def plain(train, asked, alpha):
    """Scores of all classes, in the same whole millionths."""
    def log(x):
        return round(math.log(x) * 1_000_000)

    docs, counts = Counter(), {}
    for label, feats in train:
        docs[label] += 1
        counts.setdefault(label, Counter()).update(feats)
    vocabulary = len({f for c in counts.values() for f in c})
    out = {}
    for key, feats in asked:
        best = []
        for label, n in docs.items():
            total = sum(counts[label].values())
            s = log(n / sum(docs.values())) + len(feats) * log(alpha / (total + alpha * vocabulary))
            s += sum(log(1 + counts[label][f] / alpha) for f in feats if counts[label][f])
            best.append((-s, label))
        out[key] = min(best)[1]
    return out


def sample(seed, n_classes):
    rng = random.Random(seed)
    train = [(rng.randrange(n_classes) ** 2 % n_classes, [f"f{rng.randrange(30)}" for _ in range(rng.randrange(6))]) for _ in range(400)]
    asked = [(i, [f"f{rng.randrange(40)}" for _ in range(rng.randrange(8))]) for i in range(200)]
    return train, asked


@pytest.mark.parametrize("n_classes", [1, 3, 60])
def test_answers_equal_the_plain_version(spark, n_classes):
    train, asked = sample(n_classes, n_classes)
    rows = spark.createDataFrame(train, "y int, f array<string>")
    model = bayes.fit(rows, "y", "f")
    got = bayes.predict(model, spark.createDataFrame(asked, "k int, f array<string>"), "k", "f", (0.1, 1.0)).collect()
    for i, alpha in enumerate((0.1, 1.0)):
        assert {r["k"]: r[f"prediction_{i}"] for r in got} == plain(train, asked, alpha)


def test_weights_and_several_models(spark, tmp_path):
    sets = {"a": sample(5, 7), "b": sample(6, 4)}
    train = [(m, y, f, w) for m, (rows, _) in sets.items() for y, f in rows for w in (1, 2)]
    model = bayes.fit(spark.createDataFrame(train, "m string, y int, f array<string>, w int"), "y", "f", ["m"], "w")
    model.save(str(tmp_path / "model"))
    model = bayes.NaiveBayes.load(spark, str(tmp_path / "model"), ["m"])
    asked = spark.createDataFrame([(m, k, f) for m, (_, q) in sets.items() for k, f in q], "m string, k int, f array<string>")
    got = {(r["m"], r["k"]): r["prediction_0"] for r in bayes.predict(model, asked, "k", "f").collect()}
    for m, (rows, q) in sets.items():
        want = plain([x for x in rows for _ in range(3)], q, 1.0)
        assert {k: v for (n, k), v in got.items() if n == m} == want


def test_nothing_to_learn_or_to_answer(spark):
    none = spark.createDataFrame([], "y int, f array<string>")
    asked = spark.createDataFrame([(1, ["x"])], "k int, f array<string>")
    assert [r["prediction_0"] for r in bayes.predict(bayes.fit(none, "y", "f"), asked, "k", "f").collect()] == [None]
    some = spark.createDataFrame([(3, ["x"])], "y int, f array<string>")
    assert bayes.predict(bayes.fit(some, "y", "f"), asked.limit(0), "k", "f").count() == 0
