"""Steps rewritten for size give what the plain ones give."""

from pyspark.sql import functions as F

from errorlab.functions import rng
from errorlab.functions.text import OPERATORS, any_step_sql, draw_sql, prep_levels
from errorlab.operators import corrupt as C
from errorlab.operators import nearest as N
from errorlab.operators import text as T


def test_codes_come_joined_from_the_arrow_step(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "zé{~")], "k int, w string")
    chars = T.char_vocab(spark.createDataFrame([("aé",)], "token string"))
    plain = T.encode_chars(rows, "w", "c", 6, chars).select("k", F.array_join(F.col("c").cast("array<string>"), ",").alias("c"))
    out = T.encode_columns(rows, chars, {"c": ("w", 6)}, keep=["k"], joined=True)
    assert out.columns == ["k", "c"]
    assert sorted(out.collect()) == sorted(plain.collect())


def test_joined_keys_give_the_draws_of_the_keys(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None), (None, None)], "a int, b int") \
        .withColumn("k", C.joined_keys(["a", "b"]))
    got = df.select(rng.u32(17, "op", F.col("k")).alias("x"), rng.u32(17, "op", F.col("a"), F.col("b")).alias("y")).collect()
    assert len(got) == 4 and all(r.x == r.y for r in got)


def test_one_edit_is_the_step_of_each_operator(spark):
    words = ["", "a", "aa", "ab", "aab", "über", "context"]
    df = spark.createDataFrame([(w, op, k, n) for w in words for op in OPERATORS for k in range(12) for n in (0, 1)],
                               "w string, op string, k int, n int")
    got = C.apply_errors(df, "w", "out", "op", "n", 1, 17, "token", ["k"])
    plain = df.withColumns({name: F.expr(e) for name, e in draw_sql("spark", 17, "token", ["k"], 1)})
    for level in prep_levels("w", "token", 1):
        plain = plain.withColumns({name: F.expr(e) for name, e in level})
    plain = plain.withColumn("out", F.expr(f"CASE WHEN n = 0 OR op = 'delete' AND n > length(w) THEN w ELSE {any_step_sql('op', 'w', 'token', 1)} END"))
    cols = ["w", "op", "k", "n", "out"]
    assert sorted(got.select(*cols).collect()) == sorted(plain.select(*cols).collect())
    # the steps stay in generated code: no lambda over the corrupted string itself
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("concat(" not in p.split("lambda")[0] for p in plan.split("transform(array(")[1:])


def test_variant_index_finds_what_the_join_finds(spark, monkeypatch):
    words = ["", "a", "ab", "ba", "aab", "abc", "abcd", "context", "contexts", "cntext", "tontexc", "über", "uber", "ubre", "😀b", "a" * 9]
    terms = spark.createDataFrame([(w,) for w in [*words, None, "cnotext", "contxet", "b", "aaaaaaa", "z" * 40]], "term string")
    dic = spark.createDataFrame([(w,) for w in [*words, None]], "term string")
    plain = sorted(N.candidates(terms, dic, 2).collect())
    assert len(plain) > len(words)
    for entries in (N.ENTRIES, 30):  # one index, and several
        monkeypatch.setattr(N, "ENTRIES", entries)
        got = N.candidates(terms, dic, 2, many=True)
        assert got.columns == ["term", "cand", "distance"] and sorted(got.collect()) == plain
    monkeypatch.setattr(N, "WORDS", 3)
    assert sorted(N.candidates(terms, dic, 2, many=True).collect()) == plain
    assert sorted(N.candidates(terms, dic, 2, max_term_len=7, many=True).collect()) == sorted(N.candidates(terms, dic, 2, max_term_len=7).collect())
    assert N.candidates(terms, dic.limit(0), 2, many=True).count() == 0
