"""Exact group split, covariance determinant, p-values, generated words, encoding."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from errorlab.functions.text import u32_sql  # noqa: F401
from errorlab.operators import agreement as A
from errorlab.operators import examples as D
from errorlab.operators import outliers as O
from errorlab.operators import text as T
from errorlab.sources import io as S


def test_exact_split_fills_quotas_with_whole_groups(spark):
    rng = random.Random(3)
    rows = [(g, i) for g in range(500) for i in range(rng.choice([1, 1, 2, 5]))] + [(1000, i) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(6)
    got = D.exact_group_split(df, ["g"], 0.7, 0.5).collect()
    assert len(got) == len(rows)
    split = {}
    for r in got:
        assert split.setdefault(r["g"], r["split"]) == r["split"]
    n = {s: sum(r["split"] == s for r in got) for s in ("train", "valid", "test")}
    largest = 90
    assert len(rows) * 0.7 - largest <= n["train"] <= len(rows) * 0.7
    assert n["train"] + n["valid"] <= len(rows) * 0.85
    single = D.exact_group_split(df.select("i").distinct().withColumn("g", F.col("i")), ["g"], 0.7, 0.5)
    assert sorted(r["count"] for r in single.groupBy("split").count().collect()) == [13, 14, 63]
    assert D.exact_group_split(df.limit(0), ["g"]).count() == 0


def plain_mcd(x, h, starts):
    best = None
    for idx in starts:
        mean, cov = x[idx].mean(axis=0), np.cov(x[idx].T, bias=True) + 1e-9 * np.eye(x.shape[1])
        for _ in range(30):
            mean, cov = plain_step(x, h, mean, cov)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best


def plain_step(x, h, mean, cov):
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
    near = np.argsort(d, kind="stable")[:h]
    return x[near].mean(axis=0), np.cov(x[near].T, bias=True)


def test_minimum_covariance_finds_planted_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4)) @ np.diag([1, 2, 0.5, 1])
    x[:150] += [30, -20, 25, 40]           # a far cluster that masks itself classically
    x[150] = 1e12                          # one row that no linear bucket survives
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, x array<double>").repartition(5)
    shape = O.minimum_covariance(df, "x", "k")
    h = (500 + 4 + 1) // 2
    mean, cov = plain_step(x, h, shape.mean, shape.cov)  # nothing changes any more
    assert np.allclose(shape.mean, mean, atol=1e-6) and np.allclose(shape.cov, cov, atol=1e-6)
    det, _, _ = plain_mcd(x, h, [rng.choice(500, 8, replace=False) for _ in range(20)] + [np.arange(151, 500)])
    assert abs(shape.log_det - det) < 0.05  # another local minimum at most
    far = {r.k for r in O.robust_mahalanobis(df, "x", "k").where("robust_distance > 100").collect()}
    assert far == set(range(151))


def test_cut_takes_exactly_h_rows_also_among_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300 + i, [float(i), -1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x array<double>").repartition(4)
    shapes = [O.Shape(np.array([1.0, 2.0]), np.eye(2)), O.Shape(np.zeros(2), np.eye(2))]
    x = np.array([r[1] for r in rows])
    import pandas as pd
    for h in (1, 7, 170, 299, 320, 340, 400):
        cuts = O._cuts(df, "x", "k", shapes, h, 1)
        ranks = O._ranks(x, pd.Series(range(340)), shapes, 1)
        for i, cut in enumerate(cuts):
            assert O._inside(ranks[i], cut).sum() == min(h, 340)


def student_two_sided(t, df):
    """Numerical integral of the density (trapezoid)."""
    xs = np.linspace(0, abs(t), 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * np.trapezoid(c * (1 + xs ** 2 / df) ** (-(df + 1) / 2), xs)


def test_p_values(spark):
    rows = [(rho, n) for rho in (-0.99, -0.6, -0.1, 0.0, 0.05, 0.3, 0.8, 0.999) for n in (3, 4, 5, 8, 20, 60, 200)]
    df = spark.createDataFrame(rows + [(1.0, 5), (-1.0, 4), (0.5, 2)], "rho double, n long")
    got = {(r.rho, r.n): r.p for r in df.withColumn("p", A.correlation_p(F.col("rho"), F.col("n"))).collect()}
    for rho, n in rows:
        t = rho * math.sqrt((n - 2) / (1 - rho * rho))
        assert abs(got[rho, n] - student_two_sided(t, n - 2)) < 1e-6
    assert got[1.0, 5] == got[-1.0, 4] == 0.0 and got[0.5, 2] is None


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 2.0, 7.25, 40.0, 500.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.withColumn("g", A.log_gamma(F.col("x"))).collect():
        assert math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-10, abs_tol=1e-10)


def test_generated_words_follow_the_model(spark):
    words = spark.createDataFrame([("abab",), ("abc",), ("ab",)] * 10, "term string")
    counts = T.all_ngram_counts(words)
    table = T.sampler(counts)
    assert table["^"][1] == ["a"] and table["ab"][1] == ["$", "a", "c"] and table["ab"][0].tolist() == [20, 30, 40]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "term string")
    got = T.generate_words(keys, counts).collect()
    assert all(set(r.word) <= set("abc") and r.word.startswith("ab") for r in got)
    assert {r.word for r in got} >= {"ab", "abc", "abab"}
    again = {r.term: r.word for r in T.generate_words(keys.repartition(7), counts).collect()}
    assert again == {r.term: r.word for r in got}
    assert all(r.word == "" for r in T.generate_words(keys, counts.limit(0)).collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_encoding_of_any_text(spark, parts):
    chars = T.char_vocab(spark.createDataFrame([("añ漢😀",)], "token string"))
    ids = {r.ch: r.char_id for r in chars.collect()}
    texts = ["a", "", None, "ñ漢😀x", "unknown € here and longer than the width", "\x00\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(parts)
    got = {r.k: list(r.codes) for r in T.encode_chars(df, "t", "codes", 8, chars).collect()}
    for k, t in enumerate(texts):
        padded = (t or "")[:8].ljust(8)
        assert got[k] == [ids.get(c, ids[" "]) for c in padded]


def test_scores_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = [(i, f"row {i}", 0.5, 0, "test" if i % 5 == 0 else "train") for i in range(100)]
    S.save_scores(spark.createDataFrame(rows, "k long, other string, prob double, pred int, split string"), path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "scores" / "split=train").iterdir()}
    fresh = spark.createDataFrame([(k, 0.9, 1) for k in (0, 5, 10, 999)], "k long, prob double, pred int")
    S.replace_scores(spark, path, fresh, "k")
    got = {r.k: (r.other, r.prob, r.pred, r.split) for r in spark.read.parquet(path).collect()}
    assert got == {i: (o, 0.9 if i in (0, 5, 10) else p, 1 if i in (0, 5, 10) else q, s) for i, o, p, q, s in rows}
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "scores" / "split=train").iterdir()} == before
    S.replace_scores(spark, path, fresh.filter("k = 999"), "k")
    assert spark.read.parquet(path).count() == 100
