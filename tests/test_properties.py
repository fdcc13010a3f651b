"""Property tests of the random operators and the scale patterns."""

from pyspark.sql import functions as F

from errorlab.operators import corrupt as C
from errorlab.operators import examples as D
from errorlab.operators import sampling as B
from errorlab.operators import scale
from errorlab.functions import rng


def _words(spark):
    words = ["spark", "token", "window", "aa", "preposition", "ab", "zzzz", "data"]
    return spark.createDataFrame([(i, 0, w) for i, w in enumerate(words)], "doc_id long, pos int, token string")


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_insert_adds_letters(spark):
    out = C.insert_chars(_words(spark), n=2).collect()
    for r in out:
        assert len(r.corrupted) == len(r.token) + 2
        assert _lev(r.token, r.corrupted) <= 2


def test_delete_keeps_last_char_and_caps(spark):
    out = C.delete_chars(_words(spark), n=3).collect()
    for r in out:
        assert len(r.corrupted) == len(r.token) - min(3, len(r.token) - 1)
        assert r.corrupted[-1] == r.token[-1]


def test_replace_and_transpose_keep_length(spark):
    for fn in (C.replace_chars, C.transpose_chars):
        for r in fn(_words(spark), n=2).collect():
            assert len(r.corrupted) == len(r.token)
            assert _lev(r.token, r.corrupted) <= 4
    for r in C.transpose_chars(_words(spark), n=2).collect():
        assert sorted(r.corrupted) == sorted(r.token)
        if r.token == "zzzz":
            assert r.corrupted == "zzzz"


def test_n_zero_leaves_token(spark):
    df = _words(spark).withColumn("copy", F.lit(1))
    out = C.corrupt_context(df.withColumn("lead", F.col("token")).withColumn("trail", F.col("token"))
                            .withColumn("error_type", F.lit("insert")), n_errors=(0,)).collect()
    for r in out:
        assert r.lead_c == r.token and r.trail_c == r.token


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(2000).select((F.col("id") % 97).alias("g"), F.col("id"))
    s = D.group_split(df, ["g"], 0.6, 0.5)
    assert s.groupBy("g").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0


def test_histogram_cut_exact_and_partition_independent(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id"))
    df = df.withColumn("h", rng.u32(17, "t", F.col("id")))
    want = {}
    for r in df.collect():
        want.setdefault(r.g, []).append((r.h, r.id))
    want = {g: sorted(v)[:100] for g, v in want.items()}
    for parts in (1, 4, 32):
        got = scale.histogram_cut(df.repartition(parts), ["g"], "h", 100, tie_cols=["id"]).collect()
        by = {}
        for r in got:
            by.setdefault(r.g, []).append((r.h, r.id))
        assert {g: sorted(v) for g, v in by.items()} == want


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(3000).select((F.col("id") * 7 + 3).alias("k"))
    out = sorted((r.k, r.idx) for r in scale.dense_index_by_range(df, "k", 64).collect())
    assert [i for _, i in out] == list(range(3000))


def test_balance_pairs_equal_classes_and_whole_pairs(spark):
    rows = [(p, e, p % 3 if p % 5 else 0) for p in range(300) for e in (False, True)]
    df = spark.createDataFrame(rows, "pair_id long, is_error boolean, c int")
    out = B.balance_pairs(df, "c").collect()
    per = {}
    for r in out:
        per.setdefault(r.c, set()).add((r.pair_id, r.is_error))
    sizes = {c: len(v) for c, v in per.items()}
    assert len(set(sizes.values())) == 1
    for v in per.values():
        assert all((p, not e) in v for p, e in v)
