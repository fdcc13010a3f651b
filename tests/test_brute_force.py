"""Operators without SQL oracles checked against direct computations on small
fixtures (nearest words by brute force, outliers by NumPy)."""

import numpy as np
from pyspark.sql import functions as F

from errorlab.operators import nearest as N
from errorlab.operators import outliers as O

from test_properties import _lev


def test_candidates_match_brute_force(spark, fx):
    from errorlab.plans.error_queries import dictionary, short_vocab

    terms = [r.term for r in short_vocab(fx).limit(60).collect()]
    dic = [r.term for r in dictionary(fx).collect()]
    t = spark.createDataFrame([(w,) for w in terms], "term string")
    got = {(r.term, r.cand, r.distance) for r in N.candidates(t, dictionary(fx), 2).collect()}
    want = {(a, b, _lev(a, b)) for a in terms for b in dic if _lev(a, b) <= 2}
    assert got == want


def test_mahalanobis_matches_numpy(spark, fx):
    emb = fx.t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = emb.orderBy("vec_id").collect()
    x = np.array([r.x for r in rows])
    mu = x.mean(axis=0)
    cov = np.cov(x, rowvar=False, bias=True)
    inv = np.linalg.pinv(cov)
    want = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
    got = {r.vec_id: r.distance for r in O.mahalanobis(emb, "x").collect()}
    for r, w in zip(rows, want):
        assert abs(got[r.vec_id] - w) < 1e-6 * max(1.0, abs(w))


def test_robust_mahalanobis_runs_and_is_finite(spark, fx):
    emb = fx.t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = O.robust_mahalanobis(emb, "x", "vec_id", iterations=2).collect()
    assert len(out) == emb.count()
    assert all(np.isfinite(r.robust_distance) for r in out)
