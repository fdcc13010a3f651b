"""Registered round trips of readers and writers (S2, S6, S8-S15): each query writes files
that Spark derives from the given tables to the shared folder and reads them back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import text as T
from ..session import checkpoint_dir
from ..sources import io as S
from .catalog import register
from .fixtures import P, register_fixture_sql, with_fixtures
from .io_model_queries import _pairs_win, _split
from .score_queries import r6
from ..functions.text import u32_sql


def _folder(fx, name: str) -> str:
    return os.path.join(checkpoint_dir(fx.spark), "files", f"{name}-{uuid.uuid4().hex}")


@register("S2_bulk_tokenize", with_fixtures("""
    SELECT d.lang, t.token, count(*) AS n FROM tokens t JOIN documents d USING (doc_id) GROUP BY d.lang, t.token""",
    "tokens"))
def s2(fx):
    """Text files per language, tokenised file by file: token counts of each language."""
    path = _folder(fx, "s2")
    fx.t("documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(f"{path}/in")
    S.bulk_tokenize(fx.spark, f"{path}/in", f"{path}/out")
    return fx.spark.read.parquet(f"{path}/out").select(
        F.regexp_extract(F.url_decode(F.col("source_file").cast("string")), "lang=([^/]*)/", 1).alias("lang"),
        "token").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


@register("S6_split_files", """
    SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS INT) AS shard FROM documents""")
def s6(fx):
    path = _folder(fx, "s6")
    S.split_files(fx.t("documents").select("doc_id", "n_chars"), "doc_id", 100, path)
    return fx.spark.read.parquet(path).select("doc_id", F.col("shard").cast("int").alias("shard"))


@register("S8_save_vocab", with_fixtures("""
    SELECT 'term' AS kind, CAST(term_id AS INT) AS id, term AS value FROM vocab
    UNION ALL SELECT 'char', char_id, ch FROM char_vocab""", "vocab", "char_vocab"))
def s8(fx):
    path = _folder(fx, "s8")
    S.save_vocab(fx.vocab(), T.char_vocab(fx.words()), f"{path}/")
    terms, chars = (fx.spark.read.parquet(f"{path}/{n}") for n in ("vocab", "chars"))
    return terms.select(F.lit("term").alias("kind"), F.col("id").cast("int").alias("id"), "value") \
        .unionByName(chars.select(F.lit("char").alias("kind"), "id", "value"))


@register("S10_load_targets", with_fixtures("""
    SELECT 'y' AS target, CAST(term_id AS INT) AS class_id, term AS name, CAST(1.0 AS DOUBLE) AS weight FROM vocab""", "vocab"))
def s10(fx):
    """Class names and weights, saved (S9) and loaded again."""
    path = _folder(fx, "s9")
    S.save_targets(fx.vocab(), path)
    return S.load_targets(fx.spark, path)


@register("S11_replace_scores", """
    SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN CAST(0.05 + 0.9 * quality AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS prob,
           CAST(CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN toxic ELSE 0 END AS INT) AS pred,
           CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM labels""")
def s11(fx):
    """A prediction table whose test rows with even keys are scored anew."""
    path = _folder(fx, "s11")
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    S.save_scores(fx.t("labels").withColumn("prob", F.lit(0.5)).withColumn("pred", F.lit(0)).withColumn("split", split), path)
    fresh = fx.t("labels").filter((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 2 == 0)) \
        .select("doc_id", (F.lit(0.05) + 0.9 * F.col("quality")).alias("prob"), F.col("toxic").cast("int").alias("pred"))
    S.replace_scores(fx.spark, path, fresh, "doc_id")
    return fx.spark.read.parquet(path).select("doc_id", "quality", "toxic", r6(F.col("prob")).alias("prob"), "pred", "split")


_TRAINED = f"{u32_sql('duck', P.seed, 'split', 'pair_id')} % 1000000 < 800000"
register_fixture_sql("scored_pairs", ("pairs",), f"""
    WITH t AS MATERIALIZED (
      SELECT pair_id, is_error, original_code AS label, {_TRAINED} AS train, unnest(range(5)) AS i,
             unnest(list_slice(list_concat([0, 0], sent, [0, 0]), position + 1, position + 5)) AS x FROM pairs),
    f AS MATERIALIZED (SELECT pair_id, is_error, label, train, i || ':' || x AS f FROM t WHERE i <> 2),
    n AS MATERIALIZED (SELECT f, label, count(*) AS n FROM f WHERE train GROUP BY f, label),
    size AS (SELECT count(DISTINCT f) AS v FROM n),
    c AS MATERIALIZED (
      SELECT label, ln(docs + 1) - ln(sum(docs) OVER () + count(*) OVER ()) AS pi, ln(total + (SELECT v FROM size)) AS norm FROM (
        SELECT label, count(DISTINCT (pair_id, is_error)) AS docs, count(*) AS total FROM f WHERE train GROUP BY label)),
    w AS MATERIALIZED (
      SELECT k.f, c.label, ln(coalesce(n.n, 0) + 1) - c.norm AS w
      FROM (SELECT DISTINCT f FROM n) k CROSS JOIN c LEFT JOIN n ON n.f = k.f AND n.label = c.label),
    s AS (
      SELECT p.pair_id, p.is_error, c.label, any_value(c.pi) + coalesce(sum(w.w), 0) AS s
      FROM (SELECT pair_id, is_error, unnest(range(5)) AS i,
                   unnest(list_slice(list_concat([0, 0], sent, [0, 0]), position + 1, position + 5)) AS x FROM pairs) p
      CROSS JOIN c LEFT JOIN w ON w.f = p.i || ':' || p.x AND w.label = c.label AND p.i <> 2
      GROUP BY p.pair_id, p.is_error, c.label),
    m AS (SELECT *, max(s) OVER (PARTITION BY pair_id, is_error) AS top FROM s)
    SELECT pair_id, is_error, CAST(arg_max(label, s) AS INT) AS pred, round(1 / sum(exp(s - top)), 6) AS prob
    FROM m GROUP BY pair_id, is_error""")


@register("S12_score_file", with_fixtures("SELECT pair_id, is_error, pred, prob FROM scored_pairs", "scored_pairs"))
def s12(fx):
    """A model fitted here, saved, and loaded by another session that scores a whole table."""
    path = _folder(fx, "s12")
    _pairs_win(fx).select("pair_id", "is_error", "original_code", "win5").write.parquet(f"{path}/table")
    table = fx.spark.read.parquet(f"{path}/table")
    S.save_model(L.train_counts(_split(table, "pair_id").filter(F.col("split") == "train"), "win5", "original_code"),
                 f"{path}/model")
    table.withColumn("terms", L.window_terms(F.col("win5"), 2)).write.parquet(f"{path}/data")
    S.score_file(fx.spark.newSession(), f"{path}/model", f"{path}/data", f"{path}/out")
    return fx.spark.read.parquet(f"{path}/out/predictions").select(
        "pair_id", "is_error", "pred", r6(F.array_max("prob")).alias("prob"))


def _line(*cols):
    return F.concat_ws("\t", *[F.regexp_replace(c.cast("string"), r"[\x00-\x1f]", " ") for c in cols])


_CLEAN = r"regexp_replace({}, '[\x00-\x1f]', ' ', 'g')"


@register("S13_read_judgements", rf"""
    SELECT doc_id AS sent_id, nullif({_CLEAN.format('text')}, '') AS sentence, lang AS correct_preposition,
           CAST(quality AS VARCHAR) AS confidence, CAST(toxic AS VARCHAR) AS sentence_quality, false AS damaged
    FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0
    UNION ALL
    SELECT doc_id, lang, NULL, NULL, NULL, true FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 = 0""")
def s13(fx):
    """Judgement files with some short lines, which stay as damaged lines."""
    path = _folder(fx, "s13")
    rows = fx.t("documents").join(fx.t("labels"), "doc_id")
    whole = _line(*[F.col(c) for c in ("doc_id", "text", "lang", "quality", "toxic")])
    rows.select(F.when(F.col("doc_id") % 7 == 0, _line(F.col("doc_id"), F.col("lang"))).otherwise(whole).alias("value")) \
        .write.text(path)
    return S.read_judgements(fx.spark, path, header=False, corrupt="broken") \
        .withColumn("damaged", F.col("broken").isNotNull()).drop("broken")


@register("S14_read_points", """
    SELECT array_to_string(list_transform(embedding, lambda v: CAST(CAST(round(CAST(v AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',') AS x,
           count(*) AS n FROM embeddings GROUP BY 1""")
def s14(fx):
    path = _folder(fx, "s14")
    emb = fx.t("embeddings")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    emb.select(*[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(dims)]).write.csv(path)
    points = S.read_points(fx.spark, path, dims)
    text = F.array_join(F.transform("x", lambda v: F.round(v * 1000000).cast("bigint").cast("string")), ",")
    return points.groupBy(text.alias("x")).agg(F.count(F.lit(1)).alias("n"))


@register("S15_read_word_list", with_fixtures("SELECT term AS word FROM kept", "kept"))
def s15(fx):
    """A compressed dictionary file, each word twice, read back as a set."""
    path = _folder(fx, "s15")
    words = T.prune_rare(T.term_freq(fx.words()), P.min_freq).select(F.col("term").alias("word"), "freq")
    words.unionByName(words).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return S.read_word_list(fx.spark, path)
