"""Steps that several queries share: each input is read once where it was read many times,
and lines, windows and scores are made without moving tokens between tasks."""

import pytest
from pyspark.sql import functions as F

from errorlab.functions.text import method_end
from errorlab.operators import bayes
from errorlab.operators import corrupt as C
from errorlab.operators import windows as W
from errorlab.plans import error_queries as Q
from errorlab.plans.fixtures import SENT_FACTOR, Fx
from errorlab.sources import io as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def corpus(spark, tmp_path):
    def make(rows):
        path = tmp_path / "tables"
        spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(path / "documents.parquet"))
        return Fx(spark, str(path))
    return make


WORDS = "the cat of the hat of the cat in the hat in the end of it"


def test_words_are_counted_once(corpus):
    fx = corpus([(i, "en", WORDS) for i in range(5)])
    assert "documents" not in _plan(fx.vocab()) and "documents" not in _plan(Q.dictionary(fx))
    assert {r["term"]: r["freq"] for r in fx.freq().collect()}["the"] == 25


def test_lines_move_no_tokens(corpus):
    fx = corpus([(i, "en", WORDS + "\n\nOf it\nzzz") for i in range(5)])
    assert "collect_list" not in _plan(fx.sents())
    ids = {r["term"]: r["term_id"] + 1 for r in fx.vocab().collect()}
    rows = {r["sent_id"]: r for r in fx.sents().collect()}
    assert sorted(rows) == sorted(i * SENT_FACTOR + k for i in range(5) for k in (0, 2, 3))
    for r in rows.values():
        assert r["sent"] == [ids.get(t, 0) for t in r["toks"]] and r["len"] == len(r["toks"])


def test_lines_with_one_key_stay_one_line(corpus):
    fx = corpus([(1, "en", "of it"), (1, "en", "the cat"), (1, "de", "in it"), (2, "en", "of"),
                 (None, "en", "in"), (None, "en", "the"), (7, None, None)])
    got = sorted((r["sent_id"] or -1, r["lang"], sorted(r["toks"])) for r in fx.sents().collect())
    assert got == [(-1, "en", ["in", "the"]), (SENT_FACTOR, "de", ["in", "it"]), (SENT_FACTOR, "en", ["cat", "it", "of", "the"]),
                   (2 * SENT_FACTOR, "en", ["of"])]


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(1, "A b."), (2, ""), (3, None)], "doc_id long, text string")
    for df in (W.contexts_from_text(docs), W.char_window(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and "lambda" not in plan
    assert [r["token"] for r in W.contexts_from_text(docs).orderBy("pos").collect()] == ["a", "b", "."]


def test_hashes_only_where_used(spark):
    df = spark.createDataFrame([(1, 2, "delete", 1, "word")], "doc_id long, pos int, op string, n int, w string")
    out = C.apply_errors(df, "w", "c", "op", "n", 2, 17, "token", ["doc_id", "pos"])
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "(op#" in plan and "= transpose)" in plan and plan.count("md5(") == 6
    assert spark.range(1).select(method_end(F.lit("x")).alias("v")).first()["v"] == "x"


@pytest.mark.parametrize("position", [0, 1, 3, 5])
def test_masked_sentence_equals_the_plain_one(spark, position):
    sent = [5, 0, 7, 8, 9, 4]
    df = spark.createDataFrame([(sent, position)], "sent array<int>, position int") \
        .withColumn("win", W.word_window(F.col("sent"), F.col("position"), 5))
    masks = dict(enumerate(W.mask_scenarios(5)))
    for r in W.mask_positions(df, "win", "sent", "position", 5).collect():
        hidden = {m - 2 + position for m in masks[r["scenario"]]}
        assert r["sent"] == [0 if i in hidden else v for i, v in enumerate(sent)]


def test_small_models_are_looked_up_in_the_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 3, [f"f{i % 7}", f"g{i % 2}"]) for i in range(40)], "y int, f array<string>")
    asked = spark.createDataFrame([(i, i * 2, [f"f{i}", "g1", "g1", None]) for i in range(9)] + [(10, 0, [])],
                                  "k int, extra int, f array<string>")
    model = bayes.fit(rows, "y", "f")
    small = bayes.predict(model, asked, "k", "f", (0.1, 1.0), carry=["extra"])
    assert "MapInArrow" in _plan(small) and "Join" not in _plan(small)
    monkeypatch.setattr(bayes, "SMALL", 0)
    joined = bayes.predict(model, asked, "k", "f", (0.1, 1.0), carry=["extra"])
    assert small.columns == joined.columns and sorted(small.collect()) == sorted(joined.collect())


def test_bulk_tokenize_of_more_files_than_writers(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / "in" / f"{i}.txt").write_text("Of it\n\n" + "a " * i)
    S.bulk_tokenize(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 80 + sum(range(40)) and got.select("source_file").distinct().count() == 40
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


