"""Registered queries for annotator agreement.

Judgements are derived from ``documents``: four simulated annotators guess a
document's language by counting hits of different stop-word subsets (an
annotator judges only documents where its words occur), the corpus annotator
(5) is the gold ``lang`` and the model annotator (6) uses every stop word and
reports the winning share as its probability.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import metrics as M
from ..operators import sizing
from .catalog import register
from .fixtures import register_fixture_sql, with_fixtures
from .score_queries import _rows, r6

# Stop words per language (rank = position in the list).
STOPWORDS = {
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "es"],
    "fr": ["le", "la", "les", "de", "des", "et", "est", "un"],
}
HUMANS = (1, 2, 3, 4)
CORPUS, MODEL = 5, 6
ALL = HUMANS + (CORPUS, MODEL)


def _sw_rows():
    return [(lang, w, r) for lang, ws in STOPWORDS.items() for r, w in enumerate(ws)]


def judgements(fx):
    """``(sent_id, annotator_id, label, confidence, probability)`` for 1-4 and 6."""
    def build():
        sw = fx.spark.createDataFrame(_sw_rows(), "lang string, word string, rnk int")
        hits = fx.tokens().join(F.broadcast(sw), F.col("token") == F.col("word")).select("doc_id", "lang", "rnk")
        ann = hits.withColumn("annotator_id", F.explode(F.array(*[F.lit(a) for a in HUMANS + (MODEL,)])))
        ann = ann.filter((F.col("annotator_id") == MODEL) | (F.pmod(F.col("rnk") + F.col("annotator_id"), F.lit(4)) != 0))
        counts = ann.groupBy("doc_id", "annotator_id", "lang").agg(F.count(F.lit(1)).alias("cnt"))
        per = counts.groupBy("doc_id", "annotator_id").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("nc"), "lang"))).alias("_s"),
            F.sum("cnt").alias("tot"))
        best_n = -F.element_at("_s", 1)["nc"]
        second_n = F.coalesce(-F.get(F.col("_s"), 1)["nc"], F.lit(0))
        return per.select(
            F.col("doc_id").alias("sent_id"), F.col("annotator_id").cast("int").alias("annotator_id"),
            F.element_at("_s", 1)["lang"].alias("label"),
            F.when(best_n >= 2 * second_n, "high").otherwise("low").alias("confidence"),
            F.when(F.col("annotator_id") == MODEL, r6(best_n / F.col("tot"))).cast("double").alias("probability"))
    return fx._get("judgements", build)


def humans(fx):
    return judgements(fx).filter(F.col("annotator_id").isin(*HUMANS))


def model_rows(fx):
    return judgements(fx).filter(F.col("annotator_id") == MODEL)


def corpus_rows(fx):
    gold = fx.t("documents").select(F.col("doc_id").alias("sent_id"), F.col("lang").alias("label"))
    return A.corpus_annotator(gold, humans(fx), CORPUS).select(
        "sent_id", F.col("annotator_id").cast("int"), "label")


def targets(fx):
    langs = fx.t("documents").select(F.col("lang").alias("name")).distinct()
    return langs.withColumn("label_code", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))


def all_j(fx):
    return fx._get("all_j", lambda: A.annotator(
        A.all_judgements(humans(fx), corpus_rows(fx), model_rows(fx)), targets(fx)))


_SW_SQL = ", ".join(f"('{lang}', '{w}', {r})" for lang, w, r in _sw_rows())
register_fixture_sql("judgements", ("tokens",), f"""
    SELECT r1.doc_id AS sent_id, CAST(r1.annotator_id AS INT) AS annotator_id, r1.lang AS label,
           CASE WHEN r1.cnt >= 2 * coalesce(r2.cnt, 0) THEN 'high' ELSE 'low' END AS confidence,
           CASE WHEN r1.annotator_id = {MODEL} THEN round(r1.cnt / r1.tot, 6) END AS probability
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, annotator_id ORDER BY cnt DESC, lang) AS rk,
                 sum(cnt) OVER (PARTITION BY doc_id, annotator_id) AS tot FROM (
            SELECT t.doc_id, a.annotator_id, s.lang, count(*) AS cnt
            FROM tokens t JOIN (VALUES {_SW_SQL}) s(lang, word, rnk) ON t.token = s.word,
                 (VALUES {', '.join(f'({a})' for a in HUMANS + (MODEL,))}) a(annotator_id)
            WHERE a.annotator_id = {MODEL} OR (s.rnk + a.annotator_id) % 4 <> 0
            GROUP BY 1, 2, 3)) r1
    LEFT JOIN (SELECT doc_id, annotator_id, cnt FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, annotator_id ORDER BY cnt DESC, lang) AS rk FROM (
          SELECT t.doc_id, a.annotator_id, s.lang, count(*) AS cnt
          FROM tokens t JOIN (VALUES {_SW_SQL}) s(lang, word, rnk) ON t.token = s.word,
               (VALUES {', '.join(f'({a})' for a in HUMANS + (MODEL,))}) a(annotator_id)
          WHERE a.annotator_id = {MODEL} OR (s.rnk + a.annotator_id) % 4 <> 0
          GROUP BY 1, 2, 3)) WHERE rk = 2) r2 ON r2.doc_id = r1.doc_id AND r2.annotator_id = r1.annotator_id
    WHERE r1.rk = 1""")
register_fixture_sql("targets", (), """
    SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS label_code
    FROM (SELECT DISTINCT lang AS name FROM documents)""")
register_fixture_sql("corpus_rows", ("judgements",), f"""
    SELECT doc_id AS sent_id, {CORPUS} AS annotator_id, lang AS label FROM documents
    WHERE doc_id IN (SELECT sent_id FROM judgements WHERE annotator_id IN {HUMANS})""")
register_fixture_sql("all_j", ("judgements", "corpus_rows", "targets"), f"""
    SELECT j.*, t.label_code FROM (
      SELECT sent_id, annotator_id, label, confidence, probability FROM judgements WHERE annotator_id IN {HUMANS}
      UNION ALL SELECT sent_id, CAST(annotator_id AS INT), label, NULL, NULL FROM corpus_rows
      UNION ALL SELECT sent_id, annotator_id, label, confidence, probability FROM judgements
                WHERE annotator_id = {MODEL}) j
    LEFT JOIN targets t ON t.name = j.label""")
register_fixture_sql("kappa", ("all_j",), """
    WITH cells AS (SELECT a.annotator_id AS a, b.annotator_id AS b, a.label AS la, b.label AS lb, count(*) AS n
                   FROM all_j a JOIN all_j b ON a.sent_id = b.sent_id AND a.annotator_id < b.annotator_id
                   GROUP BY 1, 2, 3, 4),
         tot AS (SELECT a, b, sum(n) AS nn, sum(CASE WHEN la = lb THEN n ELSE 0 END) AS agree FROM cells GROUP BY 1, 2),
         pe AS (SELECT x.a, x.b, sum(x.na * y.nb) AS ee FROM
                  (SELECT a, b, la AS l, sum(n) AS na FROM cells GROUP BY 1, 2, 3) x
                  JOIN (SELECT a, b, lb AS l, sum(n) AS nb FROM cells GROUP BY 1, 2, 3) y
                  ON x.a = y.a AND x.b = y.b AND x.l = y.l GROUP BY 1, 2),
         k AS (SELECT t.a, t.b, t.nn, t.agree / t.nn AS po, coalesce(pe.ee, 0) / (t.nn * t.nn) AS pexp
               FROM tot t LEFT JOIN pe ON pe.a = t.a AND pe.b = t.b)
    SELECT a AS annotator_a, b AS annotator_b, CASE WHEN pexp < 1 THEN (po - pexp) / (1 - pexp) ELSE 1.0 END AS kappa,
           nn AS n FROM k
    UNION ALL
    SELECT b, a, CASE WHEN pexp < 1 THEN (po - pexp) / (1 - pexp) ELSE 1.0 END, nn FROM k""")


@register("A1_annotator", with_fixtures(
    f"SELECT sent_id, annotator_id, label, label_code FROM all_j WHERE annotator_id IN {HUMANS}", "all_j"))
def a1(fx):
    return A.annotator(humans(fx), targets(fx)).select("sent_id", "annotator_id", "label", "label_code")


@register("A2_corpus_model_annotators", with_fixtures(
    f"SELECT sent_id, annotator_id, label, probability FROM all_j WHERE annotator_id IN ({CORPUS}, {MODEL})", "all_j"))
def a2(fx):
    return A.all_judgements(corpus_rows(fx), model_rows(fx)).select("sent_id", "annotator_id", "label", "probability")


@register("A3_pick_variant", with_fixtures("""
    SELECT r.row_key, p.pair_id, p.is_error, p.current FROM
      (SELECT pair_id * 2 + CAST(is_error AS INT) AS row_key FROM pairs) r
    JOIN pairs p ON p.pair_id = r.row_key // 2 AND p.is_error = (r.row_key % 2 = 1)""", "pairs"))
def a3(fx):
    return A.pick_variant(_rows(fx), fx.pairs()).select("row_key", "pair_id", "is_error", "current")


@register("A4_all_judgements", with_fixtures(
    "SELECT sent_id, annotator_id, label, confidence, probability FROM all_j", "all_j"))
def a4(fx):
    return all_j(fx).select("sent_id", "annotator_id", "label", "confidence", "probability")


@register("A5_kappa_pairs", with_fixtures(
    "SELECT annotator_a, annotator_b, round(kappa, 6) AS kappa, n FROM kappa", "kappa"))
def a5(fx):
    return A.kappa_pairs(all_j(fx)).select("annotator_a", "annotator_b", r6(F.col("kappa")).alias("kappa"), "n")


@register("A6_kappa_matrix", with_fixtures(
    "SELECT a.annotator_a, " + ", ".join(
        f"max(CASE WHEN a.annotator_b = {b} THEN a.cell END) AS \"{b}\"" for b in ALL) +
    " FROM (SELECT annotator_a, annotator_b, printf('%.3f (%d)', kappa, n) AS cell FROM kappa "
    "UNION ALL SELECT a, a, '.' FROM (VALUES " + ", ".join(f"({a})" for a in ALL) + ") v(a)) a "
    "GROUP BY a.annotator_a", "kappa"))
def a6(fx):
    return A.kappa_matrix(A.kappa_pairs(all_j(fx)), ALL)


_A7_SQL = f"""
    SELECT coalesce(t.annotator_id, pr.annotator_id) AS annotator_id, coalesce(t.class_id, pr.class_id) AS class_id,
           CASE WHEN coalesce(pr.predicted, 0) > 0 THEN coalesce(t.tp, 0) / pr.predicted ELSE 0.0 END AS precision,
           CASE WHEN coalesce(t.support, 0) > 0 THEN t.tp / t.support ELSE 0.0 END AS recall,
           CAST(coalesce(t.support, 0) AS BIGINT) AS support
    FROM (SELECT annotator_id, y AS class_id, count(*) AS support, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS tp
          FROM av GROUP BY 1, 2) t
    FULL OUTER JOIN (SELECT annotator_id, p AS class_id, count(*) AS predicted FROM av GROUP BY 1, 2) pr
      ON t.annotator_id = pr.annotator_id AND t.class_id = pr.class_id"""
register_fixture_sql("av", ("all_j",), f"""
    SELECT o.annotator_id, tr.label_code AS y, o.label_code AS p FROM all_j o
    JOIN all_j tr ON tr.sent_id = o.sent_id AND tr.annotator_id = {CORPUS} WHERE o.annotator_id <> {CORPUS}""")
register_fixture_sql("a7", ("av",), f"""
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS fscore
    FROM ({_A7_SQL})""")


def _a7(fx):
    return A.prf_per_annotator(all_j(fx), CORPUS)


@register("A7_prf_per_annotator", with_fixtures(
    "SELECT annotator_id, class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(fscore, 6) AS fscore, support FROM a7", "a7"))
def a7(fx):
    p = _a7(fx)
    return p.select("annotator_id", "class_id", r6(F.col("precision")).alias("precision"),
                    r6(F.col("recall")).alias("recall"), r6(F.col("fscore")).alias("fscore"), "support")


# Student's t with nu degrees of freedom as the finite series in theta = atan(t / sqrt(nu)),
# with c = cos(theta) squared = 1 - rho squared.
_SERIES = """CASE WHEN nu % 2 = 0 THEN
      1 - sqrt(1 - c) * (1 + coalesce(list_sum(list_transform(range(1, nu // 2), lambda k:
          list_product(list_transform(range(1, k + 1), lambda i: (2 * i - 1) / (2 * i))) * pow(c, k))), 0))
    ELSE 1 - 2 / pi() * (asin(sqrt(1 - c)) + CASE WHEN nu = 1 THEN 0 ELSE sqrt(1 - c) * sqrt(c) *
      (1 + coalesce(list_sum(list_transform(range(1, (nu - 1) // 2), lambda k:
          list_product(list_transform(range(1, k + 1), lambda i: (2 * i) / (2 * i + 1))) * pow(c, k))), 0)) END) END"""


@register("A8_metric_rank_corr", with_fixtures(f"""
    SELECT a, b, round(rho, 6) AS rho, n, CASE WHEN nu > 0 THEN CASE WHEN c <= 1e-15 THEN 0.0 ELSE round({_SERIES}, 6) END END AS p
    FROM (SELECT *, n - 2 AS nu, 1 - least(rho * rho, 1.0) AS c FROM (
      SELECT x.annotator_id AS a, y.annotator_id AS b, corr(x.r, y.r) AS rho, count(*) AS n FROM
        (SELECT annotator_id, class_id, rank() OVER (PARTITION BY annotator_id ORDER BY fscore)
                + (count(*) OVER (PARTITION BY annotator_id, fscore) - 1) / 2.0 AS r FROM a7) x
      JOIN (SELECT annotator_id, class_id, rank() OVER (PARTITION BY annotator_id ORDER BY fscore)
                + (count(*) OVER (PARTITION BY annotator_id, fscore) - 1) / 2.0 AS r FROM a7) y
        ON x.class_id = y.class_id AND x.annotator_id <> y.annotator_id
      GROUP BY 1, 2))""", "a7"))
def a8(fx):
    out = A.metric_rank_corr(_a7(fx), "fscore")
    return out.select("a", "b", r6(F.col("rho")).alias("rho"), "n", r6(F.col("p")).alias("p"))


@register("A9_confidence_by_prob_bin", with_fixtures(f"""
    SELECT annotator_id, bin, confidence, n, round(n / sum(n) OVER (PARTITION BY annotator_id, bin), 6) AS share FROM (
      SELECT h.annotator_id, ceil(m.probability * 10) / 10 AS bin, h.confidence, count(*) AS n
      FROM judgements h JOIN judgements m ON m.sent_id = h.sent_id AND m.annotator_id = {MODEL}
      WHERE h.annotator_id IN {HUMANS} GROUP BY 1, 2, 3)""", "judgements"))
def a9(fx):
    out = A.confidence_by_prob_bin(humans(fx), model_rows(fx))
    return out.select("annotator_id", F.col("bin").cast("double"), "confidence", "n", r6(F.col("share")).alias("share"))


TRIPLES = ((1, 2, 6), (1, 2, 3), (2, 3, 6), (1, 4, 6))


@register("A10_disagreements", with_fixtures(" UNION ALL ".join(f"""
    SELECT '{a}={b}<>{c}' AS judges, a.sent_id, a.label AS label_ab, c.label AS label_c,
           d.lang IS DISTINCT FROM a.label AS modified, d.text AS sentence FROM all_j a
    JOIN all_j b ON b.sent_id = a.sent_id AND b.annotator_id = {b}
    JOIN all_j c ON c.sent_id = a.sent_id AND c.annotator_id = {c}
    LEFT JOIN documents d ON d.doc_id = a.sent_id
    WHERE a.annotator_id = {a} AND a.label = b.label AND a.label <> c.label""" for a, b, c in TRIPLES), "all_j"))
def a10(fx):
    """Disagreements of several triples of judges, with the text and whether the agreed
    label differs from the one that the corpus gives."""
    docs = fx.t("documents").withColumnRenamed("doc_id", "sent_id")
    told = A.sentences(docs, text_col="text").withColumnRenamed("text", "sentence")
    out = None
    for a, b, c in TRIPLES:
        part = A.disagreements(all_j(fx), a, b, c, sentences=told, written=docs.select("sent_id", F.col("lang").alias("label"))) \
            .withColumn("judges", F.lit(f"{a}={b}<>{c}"))
        out = part if out is None else out.unionByName(part)
    return out.select("judges", "sent_id", "label_ab", "label_c", "modified", "sentence")


@register("A4_sentences", with_fixtures("""
    SELECT doc_id AS sent_id, min(text) AS sentence FROM documents
    WHERE doc_id IN (SELECT sent_id FROM all_j) GROUP BY doc_id""", "all_j"))
def a4_sentences(fx):
    """The judged texts, each once however many judges saw it."""
    docs = fx.t("documents").select(F.col("doc_id").alias("sent_id"), F.col("text").alias("sentence"))
    files = [docs.join(all_j(fx).filter(F.col("annotator_id") == i).select("sent_id"), "sent_id", "left_semi") for i in ALL]
    return A.sentences(*files)


_SUMMARY = (("annotator1-truth", 1, CORPUS), ("model-truth", MODEL, CORPUS), ("model-annotator1", MODEL, 1))


@register("A11_annotator_summary", with_fixtures(" UNION ALL ".join(f"""
    SELECT '{name}' AS pair, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
           round(avg(fscore), 6) AS fscore,
           (SELECT round(kappa, 6) FROM kappa WHERE annotator_a = {p} AND annotator_b = {t}) AS kappa,
           CAST(sum(support) AS BIGINT) AS n FROM (
      SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS fscore
      FROM (SELECT coalesce(t.class_id, pr.class_id) AS class_id,
                   CASE WHEN coalesce(pr.predicted, 0) > 0 THEN coalesce(t.tp, 0) / pr.predicted ELSE 0.0 END AS precision,
                   CASE WHEN coalesce(t.support, 0) > 0 THEN t.tp / t.support ELSE 0.0 END AS recall,
                   coalesce(t.support, 0) AS support
            FROM (SELECT y AS class_id, count(*) AS support, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS tp FROM
                    (SELECT tr.label_code AS y, o.label_code AS p FROM all_j o JOIN all_j tr
                     ON tr.sent_id = o.sent_id AND tr.annotator_id = {t} WHERE o.annotator_id = {p}) GROUP BY 1) t
            FULL OUTER JOIN (SELECT p AS class_id, count(*) AS predicted FROM
                    (SELECT tr.label_code AS y, o.label_code AS p FROM all_j o JOIN all_j tr
                     ON tr.sent_id = o.sent_id AND tr.annotator_id = {t} WHERE o.annotator_id = {p}) GROUP BY 1) pr
            ON t.class_id = pr.class_id))""" for name, p, t in _SUMMARY), "all_j", "kappa"))
def a11(fx):
    j = all_j(fx)
    kp = A.kappa_pairs(j)
    out = None
    for name, p, t in _SUMMARY:
        truth = j.filter(F.col("annotator_id") == t).select("sent_id", F.col("label_code").alias("_y"))
        pred = j.filter(F.col("annotator_id") == p).select("sent_id", F.col("label_code").alias("_p"))
        per = M.prf_per_class(pred.join(truth, "sent_id"), "_y", "_p")
        avg = M.prf_average(per, "macro")
        k = kp.filter((F.col("annotator_a") == p) & (F.col("annotator_b") == t)) \
            .select(F.lit(name).alias("pair"), r6(F.col("kappa")).alias("kappa"))
        row = avg.withColumn("pair", F.lit(name)).join(F.broadcast(k), "pair", "left").select(
            "pair", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
            r6(F.col("fscore")).alias("fscore"), "kappa", F.col("support").cast("bigint").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
