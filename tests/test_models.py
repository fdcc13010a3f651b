"""Model jobs and pooled vectors: no example and no token is lost."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from support import SF_SMALL
from errorlab.operators import sequences as X
from errorlab.plans import io_model_queries as Q
from errorlab.plans.fixtures import Fx


def test_pair_ranker_answers_every_test_example(spark):
    got = E.queries()["L2_train_pair_ranker"](spark, SF_SMALL).select(
        "example_id", "n_candidates", F.col("correct").cast("int").alias("correct")).collect()
    ids = Q._split(Q.spellings(Fx(spark, SF_SMALL)).select("example_id", "context_id"), "context_id") \
        .filter("split = 'test'").select("example_id").collect()
    assert sorted(r.example_id for r in got) == sorted(r.example_id for r in ids)
    assert all(r.correct == 0 for r in got if r.n_candidates == 0)
    assert sum(r.correct for r in got) / len(got) > 0.4


def test_corrector_answers_every_test_example(spark):
    got = E.queries()["L3_train_corrector"](spark, SF_SMALL).select("example_id", "label", "prediction").collect()
    ids = Q._split(Q.spellings(Fx(spark, SF_SMALL)).select("example_id", "context_id"), "context_id") \
        .filter("split = 'test'").select("example_id").collect()
    assert sorted(r.example_id for r in got) == sorted(r.example_id for r in ids)
    assert len({r.label for r in got}) > 500
    assert sum(r.label == r.prediction for r in got) / len(got) > 0.5  # among a thousand words


def test_grid_search_repeats(spark):
    first, again = (sorted(map(tuple, E.queries()["L5_grid_search"](spark, SF_SMALL).collect())) for _ in range(2))
    assert [r for r, _ in first] == [0.0, 0.01, 0.1]
    assert min(a for _, a in first) > 1 / 9  # better than a guess among nine words
    assert first == again


def test_tokens_without_a_vector_stay(spark):
    tokens = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (1, 2, 9), (2, 0, 9)], "doc_id long, pos int, vec_id long")
    vectors = spark.createDataFrame([(5, [1.0, -2.0]), (0, [9.0, 9.0])], "vec_id long, embedding array<double>")
    out = X.embed(tokens, vectors)
    assert {(r.doc_id, r.pos): r.embedding for r in out.collect()} == {
        (1, 0): [1.0, -2.0], (1, 1): None, (1, 2): None, (2, 0): None}
    pooled = X.max_pool(out, "doc_id", 2).collect()
    assert {(r.doc_id, r.dim): r.max_v for r in pooled} == {(1, 0): 1.0, (1, 1): -2.0, (2, 0): None, (2, 1): None}


def test_detector_answers_every_test_example(spark):
    got = E.queries()["L1_train_detector"](spark, SF_SMALL)
    fx = Fx(spark, SF_SMALL)
    ex = Q._split(Q.spellings(fx).select("example_id", "context_id", "corrupt_token"), "context_id").filter("split = 'test'")
    words = {r.term for r in Q.dictionary(fx).collect()}
    want = sorted((r.example_id, float(r.corrupt_token in words)) for r in ex.collect())
    rows = got.collect()
    assert sorted((r.example_id, r.label) for r in rows) == want
    assert sum(r.label == r.prediction for r in rows) / len(rows) > 0.7
    # equal spellings get one answer, made once: scores are joined to the examples
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString().split("UDF")[0]
