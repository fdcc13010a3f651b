"""Round trips of the writers and readers."""

import os
import tempfile

from pyspark.sql import functions as F

from errorlab.sources import io as S


def _tmp():
    return tempfile.mkdtemp(prefix="errorlab-io-")


def test_targets_round_trip(spark, fx):
    d = _tmp()
    S.save_targets(fx.vocab(), os.path.join(d, "targets"))
    back = S.load_targets(spark, os.path.join(d, "targets"))
    v = {r.term_id: r.term for r in fx.vocab().collect()}
    got = {r.class_id: (r.name, r.weight) for r in back.collect()}
    assert got == {k: (t, 1.0) for k, t in v.items()}


def test_split_files_shards(spark):
    d = _tmp()
    df = spark.range(250).select((F.col("id") * 3).alias("k"))
    S.split_files(df, "k", 100, os.path.join(d, "shards"))
    back = spark.read.parquet(os.path.join(d, "shards"))
    counts = {r.shard: r["count"] for r in back.groupBy("shard").count().collect()}
    assert counts == {0: 100, 1: 100, 2: 50}


def test_text_corpus_and_bulk_tokenize(spark):
    d = _tmp()
    for i, txt in enumerate(["Hello world.\nSecond line", "Another file here"]):
        with open(os.path.join(d, f"f{i}.txt"), "w") as f:
            f.write(txt)
    corpus = S.read_corpus(spark, d).collect()
    assert all("\n" not in r.text for r in corpus)
    S.bulk_tokenize(spark, d, os.path.join(d, "out"))
    back = spark.read.parquet(os.path.join(d, "out"))
    assert back.count() == 8   # hello world . second line | another file here


def test_csv_readers(spark):
    d = _tmp()
    with open(os.path.join(d, "j.tsv"), "w") as f:
        f.write("Sentence id\tSentence\tCorrect Preposition\tConfidence\tSentence Quality\n2\tb\tof\thigh\tok\n1\ta\tin\tlow\tbad\n")
    j = S.read_judgements(spark, os.path.join(d, "j.tsv")).collect()
    assert [r.sent_id for r in j] == [1, 2]
    with open(os.path.join(d, "p.csv"), "w") as f:
        f.write("1.0,2.0\n3.0,4.0\n")
    assert [r.x for r in S.read_points(spark, os.path.join(d, "p.csv"), 2).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with open(os.path.join(d, "w.tsv"), "w") as f:
        f.write("word\tfreq\nthe\t1\nof\t2\nthe\t3\n")
    assert sorted(r.word for r in S.read_word_list(spark, os.path.join(d, "w.tsv")).collect()) == ["of", "the"]


def test_run_log_parse(spark):
    lines = spark.createDataFrame([("r1", "Epoch 1 - loss: 1.2 - acc: 0.5 - val_loss: 1.1 - val_acc: 0.6"),
                                   ("r1", "no metrics here")], "run_id string, value string")
    out = S.parse_run_logs(lines).collect()
    assert len(out) == 1 and out[0].val_acc == 0.6
