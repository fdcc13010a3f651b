"""Registered queries for decision rules, metrics and sampling
(P1-P10, M1-M16, B1-B10, I1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import u32_sql
from ..operators import decide as Pd
from ..operators import metrics as M
from ..operators import sampling as B
from ..operators import sizing
from ..operators import text as T
from ..operators import windows as W
from .catalog import register
from .fixtures import CONFUSABLES, P, register_fixture_sql, with_fixtures
from . import window_queries  # noqa: F401  (pairs helpers)

N_CLASSES = 10          # classes of the embeddings fixture (labels 0..9)
SOFTMAX_SCALE = 120.0   # sharpness of the centroid soft-max scores
R6 = 6                  # digits kept for doubles in registered outputs


def r6(c):
    return F.round(c, R6)


# ---------------------------------------------------------------------------
# Fixtures: scores from class centroids; names; bigram predictor on pairs
# ---------------------------------------------------------------------------

def scores_long(fx):
    def build():
        emb = fx.t("embeddings")
        x = emb.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")) \
               .withColumn("x", F.col("x").cast("double"))
        cent = x.groupBy(F.col("label").alias("k"), "i").agg(F.avg("x").alias("c"))
        cent = sizing.broadcast_if_small(cent, 1_000_000)
        z = x.join(cent, "i").groupBy("vec_id", "label", "k").agg(F.sum(F.col("x") * F.col("c")).alias("z"))
        w = Window.partitionBy("vec_id")
        e = z.withColumn("e", F.exp(F.lit(SOFTMAX_SCALE) * (F.col("z") - F.max("z").over(w))))
        return e.select("vec_id", "label", F.col("k").cast("int").alias("k"),
                        r6(F.col("e") / F.sum("e").over(w)).alias("p"))
    return fx._get("scores_long", build)


def scores(fx):
    """``(vec_id, label, prob array<double>)``; groups are one row per class."""
    def build():
        s = scores_long(fx).groupBy("vec_id", "label").agg(
            F.sort_array(F.collect_list(F.struct("k", "p"))).alias("_kp"))
        cur = F.when(rng.pick(2, P.seed, "cur", F.col("vec_id")) == 0, F.col("label")).otherwise(
            F.pmod(F.col("label") + 1 + rng.pick(N_CLASSES - 1, P.seed, "cur2", F.col("vec_id")), F.lit(N_CLASSES)))
        return s.select("vec_id", "label", F.transform("_kp", lambda t: t["p"]).alias("prob"),
                        cur.cast("int").alias("current"))
    return fx._get("scores", build)


def class_name(i):
    first = F.expr(f"char(97 + pmod(({i} + 1) div 2, 5))")
    second = F.expr(f"char(97 + ({i} div 2))")
    return F.concat(first, F.lit("-"), second)


def names(fx):
    return fx.t("embeddings").select(F.col("label").alias("class_id")).distinct() \
        .withColumn("name", class_name("class_id"))


def pairs_pred(fx):
    """Pairs with a bigram prediction of the original word from the next word."""
    def build():
        pp = fx.pairs().withColumn("nxt", F.coalesce(F.get(F.col("sent"), F.col("position") + 1), F.lit(-1)))
        model = (pp.filter(~F.col("is_error")).groupBy("nxt", "original_code").count()
                 .groupBy("nxt").agg(F.min(F.struct((-F.col("count")).alias("nc"), "original_code")).alias("_b"))
                 .select("nxt", F.col("_b.original_code").alias("_best")))
        model = sizing.broadcast_if_small(model, bound=P.max_features + 2)
        return pp.join(model, "nxt", "left").withColumn("pred", F.coalesce("_best", "current_code")).drop("_best")
    return fx._get("pairs_pred", build)


register_fixture_sql("emb_x", (), """
    SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(len(embedding))) AS INT) AS i
    FROM embeddings""")
register_fixture_sql("scores_long", ("emb_x",), f"""
    SELECT vec_id, label, k, round(e / sum(e) OVER (PARTITION BY vec_id), {R6}) AS p FROM (
      SELECT vec_id, label, k, exp({SOFTMAX_SCALE} * (z - max(z) OVER (PARTITION BY vec_id))) AS e FROM (
        SELECT x.vec_id, x.label, CAST(c.k AS INT) AS k, sum(x.x * c.c) AS z
        FROM emb_x x JOIN (SELECT label AS k, i, avg(x) AS c FROM emb_x GROUP BY label, i) c ON x.i = c.i
        GROUP BY x.vec_id, x.label, c.k))""")
register_fixture_sql("scores", ("scores_long",), f"""
    SELECT vec_id, label, prob,
           CAST(CASE WHEN {u32_sql('duck', P.seed, 'cur', 'vec_id')} % 2 = 0 THEN label
                ELSE (label + 1 + {u32_sql('duck', P.seed, 'cur2', 'vec_id')} % {N_CLASSES - 1}) % {N_CLASSES}
                END AS INT) AS current
    FROM (SELECT vec_id, label, list(p ORDER BY k) AS prob FROM scores_long GROUP BY vec_id, label)""")
register_fixture_sql("names", (), """
    SELECT class_id, chr(CAST(97 + ((class_id + 1) // 2) % 5 AS INT)) || '-' || chr(CAST(97 + class_id // 2 AS INT)) AS name
    FROM (SELECT DISTINCT label AS class_id FROM embeddings)""")
register_fixture_sql("scored", ("scores",), """
    SELECT *, CAST(list_position(prob, list_max(prob)) - 1 AS INT) AS pred,
           list_sort(prob, 'DESC')[1] AS best, list_sort(prob, 'DESC')[2] AS second FROM scores""")
register_fixture_sql("pairs_pred", ("pairs",), """
    SELECT pp.*, coalesce(b.best, pp.current_code) AS pred FROM
      (SELECT *, coalesce(sent[position + 2], -1) AS nxt FROM pairs) pp
    LEFT JOIN (SELECT nxt, original_code AS best FROM (
        SELECT nxt, original_code, row_number() OVER (PARTITION BY nxt ORDER BY cnt DESC, original_code) AS rk
        FROM (SELECT coalesce(sent[position + 2], -1) AS nxt, original_code, count(*) AS cnt
              FROM pairs WHERE NOT is_error GROUP BY 1, 2)) WHERE rk = 1) b ON b.nxt = pp.nxt""")


def _scored(fx):
    return scores(fx).withColumn("pred", Pd.argmax("prob"))


# ---------------------------------------------------------------------------
# P1-P10
# ---------------------------------------------------------------------------

@register("P1_argmax", with_fixtures("SELECT vec_id, pred FROM scored", "scored"))
def p1(fx):
    return scores(fx).select("vec_id", Pd.argmax("prob").alias("pred"))


@register("P2_rank_of_target", with_fixtures(
    "SELECT vec_id, CAST(len(list_filter(prob, lambda p: p > prob[label + 1])) AS INT) AS rank FROM scores",
    "scores"))
def p2(fx):
    return scores(fx).select("vec_id", Pd.rank_of_target("prob", "label").alias("rank"))


@register("P3_top_k", with_fixtures("""
    SELECT vec_id, CAST(r AS INT) AS r, k AS class_id, p FROM (
      SELECT vec_id, k, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS r FROM scores_long)
    WHERE r <= 3""", "scores_long"))
def p3(fx):
    s = scores(fx).select("vec_id", F.posexplode(Pd.top_k("prob", 3)).alias("r", "t"))
    return s.select("vec_id", (F.col("r") + 1).cast("int").alias("r"), F.col("t.class_id").alias("class_id"),
                    F.col("t.p").alias("p"))


@register("P4_abs_threshold", with_fixtures("SELECT vec_id, pred FROM scored WHERE best >= 0.7", "scored"))
def p4(fx):
    return Pd.abs_threshold(scores(fx), "prob", 0.7).select("vec_id", "pred")


@register("P5_margin_top_two", with_fixtures(
    "SELECT vec_id, current, CASE WHEN best - second < 0.5 THEN current ELSE pred END AS decision FROM scored",
    "scored"))
def p5(fx):
    return scores(fx).select("vec_id", "current", Pd.margin_top_two("prob", "current", 0.5).alias("decision"))


@register("P6_margin_vs_actual", with_fixtures(
    "SELECT vec_id, current, CASE WHEN best - prob[current + 1] <= 0.3 THEN current ELSE pred END AS decision "
    "FROM scored", "scored"))
def p6(fx):
    return scores(fx).select("vec_id", "current", Pd.margin_vs_actual("prob", "current", 0.3).alias("decision"))


@register("P7_margin_band", with_fixtures(
    "SELECT vec_id, current, CASE WHEN best - prob[current + 1] > 0.025 AND best - prob[current + 1] < 0.25 "
    "THEN current ELSE pred END AS decision FROM scored", "scored"))
def p7(fx):
    return scores(fx).select("vec_id", "current", Pd.margin_band("prob", "current", 0.025, 0.25).alias("decision"))


register_fixture_sql("defaults", ("names",), """
    SELECT n.class_id, n.name, d.class_id AS default_id FROM names n
    LEFT JOIN names d ON d.name = split_part(n.name, '-', 2) || '-' || split_part(n.name, '-', 2)""")


def _defaults(fx):
    return Pd.default_targets(names(fx))


@register("P8b_default_targets", with_fixtures("SELECT class_id, name, default_id FROM defaults", "defaults"))
def p8b(fx):
    return _defaults(fx)


@register("P8_predict_for_fbeta", with_fixtures("""
    SELECT s.vec_id,
           CASE WHEN best - second > 0.5 THEN pred ELSE d.default_id END AS pred_margin,
           CASE WHEN best > 0.5 THEN pred ELSE d.default_id END AS pred_value
    FROM scored s LEFT JOIN defaults d ON d.class_id = s.pred""", "scored", "defaults"))
def p8(fx):
    rows = _defaults(fx).orderBy("class_id").collect()      # one row per class (bounded)
    arr = F.array(*[F.lit(r["default_id"]).cast("int") for r in rows])
    s = scores(fx)
    return s.select("vec_id", Pd.predict_for_fbeta("prob", arr, 0.5, "margin").alias("pred_margin"),
                    Pd.predict_for_fbeta("prob", arr, 0.5, "value").alias("pred_value"))


@register("P9_one_hot", with_fixtures(f"""
    SELECT vec_id, array_to_string(list_transform(range({N_CLASSES}), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ',')
           AS one_hot FROM scores""", "scores"))
def p9(fx):
    return scores(fx).select("vec_id", F.array_join(Pd.one_hot("label", N_CLASSES).cast("array<string>"), ",")
                             .alias("one_hot"))


@register("P10_prob_histogram", with_fixtures("""
    SELECT g.k, g.bin, coalesce(c.n, 0) AS n FROM
      (SELECT k, CAST(unnest(range(10)) AS INT) AS bin FROM (SELECT DISTINCT k FROM scores_long)) g
    LEFT JOIN (SELECT k, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n FROM scores_long GROUP BY 1, 2) c
      ON c.k = g.k AND c.bin = g.bin""", "scores_long"))
def p10(fx):
    return Pd.prob_histogram(scores_long(fx), 10)


# ---------------------------------------------------------------------------
# M1-M16 (SQL helpers build the same per-class table)
# ---------------------------------------------------------------------------

def _prf_sql(src: str, y: str, yhat: str, groups: tuple[str, ...] = (), beta: float = 1.0) -> str:
    g = ", ".join(groups)
    gc = (g + ", ") if g else ""
    on = " AND ".join([f"t.{c} IS NOT DISTINCT FROM pr.{c}" for c in groups] + ["t.class_id = pr.class_id"])
    b2 = beta * beta
    return f"""
      SELECT {', '.join(f'coalesce(t.{c}, pr.{c}) AS {c}' for c in groups)}{',' if groups else ''}
             coalesce(t.class_id, pr.class_id) AS class_id,
             CASE WHEN coalesce(pr.predicted, 0) > 0 THEN coalesce(t.tp, 0) / pr.predicted ELSE 0.0 END AS precision,
             CASE WHEN coalesce(t.support, 0) > 0 THEN t.tp / t.support ELSE 0.0 END AS recall,
             CAST(coalesce(t.support, 0) AS BIGINT) AS support
      FROM (SELECT {gc}{y} AS class_id, count(*) AS support, sum(CASE WHEN {y} = {yhat} THEN 1 ELSE 0 END) AS tp
            FROM {src} GROUP BY {gc}{y}) t
      FULL OUTER JOIN (SELECT {gc}{yhat} AS class_id, count(*) AS predicted FROM {src} GROUP BY {gc}{yhat}) pr
        ON {on}"""


def _with_f(sql: str, beta: float = 1.0) -> str:
    b2 = beta * beta
    return (f"SELECT *, CASE WHEN precision + recall > 0 THEN {1 + b2} * precision * recall / "
            f"({b2} * precision + recall) ELSE 0.0 END AS fscore FROM ({sql})")


def _macro_sql(per_class: str, groups=()) -> str:
    g = ", ".join(groups)
    return (f"SELECT {g + ', ' if g else ''}round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, "
            f"round(avg(fscore), 6) AS fscore, CAST(sum(support) AS BIGINT) AS n FROM ({per_class}) "
            f"{'GROUP BY ' + g if g else ''}")


def _round_prf(df, *extra):
    return df.select(*extra, r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                     r6(F.col("fscore")).alias("fscore"))


def _macro(df, y, yhat, groups=()):
    per = M.prf_per_class(df, y, yhat, 1.0, groups)
    avg = M.prf_average(per, "macro", groups)
    return avg.select(*groups, r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                      r6(F.col("fscore")).alias("fscore"), F.col("support").cast("bigint").alias("n"))


@register("M1_confusion", with_fixtures("""
    SELECT g.y, g.yhat, coalesce(c.n, 0) AS n FROM
      (SELECT a.c AS y, b.c AS yhat FROM (SELECT DISTINCT label AS c FROM scored UNION SELECT DISTINCT pred FROM scored) a,
                                         (SELECT DISTINCT label AS c FROM scored UNION SELECT DISTINCT pred FROM scored) b) g
    LEFT JOIN (SELECT label AS y, pred AS yhat, count(*) AS n FROM scored GROUP BY 1, 2) c ON c.y = g.y AND c.yhat = g.yhat""",
    "scored"))
def m1(fx):
    return M.confusion(_scored(fx), "label", "pred")


_PER_CLASS = _with_f(_prf_sql("scored", "label", "pred"))


@register("M2_prf_per_class", with_fixtures(
    f"SELECT class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fscore, 6) AS fscore, "
    f"support FROM ({_PER_CLASS})", "scored"))
def m2(fx):
    per = M.prf_per_class(_scored(fx), "label", "pred")
    return _round_prf(per, "class_id").join(per.select("class_id", "support"), "class_id")


_AVG_SQL = f"""
    SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
           round(avg(fscore), 6) AS fscore, CAST(sum(support) AS BIGINT) AS support FROM ({_PER_CLASS})
    UNION ALL
    SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
           round(sum(fscore * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM ({_PER_CLASS})"""


def _avgs(fx):
    per = M.prf_per_class(_scored(fx), "label", "pred")
    out = None
    for a in ("macro", "weighted"):
        d = M.prf_average(per, a).select(F.lit(a).alias("average"), r6(F.col("precision")).alias("precision"),
                                         r6(F.col("recall")).alias("recall"), r6(F.col("fscore")).alias("fscore"),
                                         F.col("support").cast("bigint").alias("support"))
        out = d if out is None else out.unionByName(d)
    return out


@register("M3_prf_average", with_fixtures(_AVG_SQL, "scored"))
def m3(fx):
    return _avgs(fx)


@register("M4_classification_report", with_fixtures(f"""
    SELECT n.name AS label_name, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(fscore, 6) AS fscore, support
    FROM ({_PER_CLASS}) p LEFT JOIN names n ON n.class_id = p.class_id
    UNION ALL SELECT average || ' avg', precision, recall, fscore, support FROM ({_AVG_SQL})""", "scored", "names"))
def m4(fx):
    per = M.prf_per_class(_scored(fx), "label", "pred")
    rows = per.join(names(fx), "class_id", "left").select(
        F.col("name").alias("label_name"), r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
        r6(F.col("fscore")).alias("fscore"), F.col("support").cast("bigint").alias("support"))
    avgs = _avgs(fx).select(F.concat("average", F.lit(" avg")).alias("label_name"), "precision", "recall",
                            "fscore", "support")
    return rows.unionByName(avgs)


register_fixture_sql("m5_per", ("scored",), f"""
      SELECT c AS class_id, tp, fp, fn, support,
             (1 + 0.25) * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9))
               / (0.25 * (tp / (tp + fp + 1e-9)) + (tp / (tp + fn + 1e-9)) + 1e-9) AS f FROM (
        SELECT c, sum(CASE WHEN label = c AND pred = c THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN pred = c AND label <> c THEN 1 ELSE 0 END) AS fp,
               sum(CASE WHEN label = c AND pred <> c THEN 1 ELSE 0 END) AS fn,
               sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS support
        FROM scored, (SELECT CAST(unnest(range({N_CLASSES})) AS INT) AS c) cs GROUP BY c)""")


@register("M5_fbeta_from_counts", with_fixtures("""
    SELECT 'class' AS scope, class_id, round(f, 6) AS fbeta FROM m5_per
    UNION ALL SELECT 'macro', NULL, round(avg(f), 6) FROM m5_per
    UNION ALL SELECT 'weighted', NULL, round(sum(f * support) / sum(support), 6) FROM m5_per""", "m5_per"))
def m5(fx):
    out = M.fbeta_from_counts(_scored(fx), "label", "pred", N_CLASSES, 0.5)
    return out.select("scope", "class_id", r6(F.col("fbeta")).alias("fbeta"))


@register("M6_accuracy", with_fixtures(
    "SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM scored",
    "scored"))
def m6(fx):
    return M.accuracy(_scored(fx), "label", "pred").select(r6(F.col("accuracy")).alias("accuracy"), "n")


def _det_sql(groups=()):
    g = ", ".join(groups)
    return f"""
      SELECT {g + ', ' if g else ''}round(p, 6) AS precision, round(r, 6) AS recall,
             round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1,
             round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END, 6) AS f05, n FROM (
        SELECT {g + ', ' if g else ''}
               CASE WHEN sum(fl) > 0 THEN sum(tp) / sum(fl) ELSE 0.0 END AS p,
               CASE WHEN sum(pos) > 0 THEN sum(tp) / sum(pos) ELSE 0.0 END AS r, count(*) AS n
        FROM (SELECT *, CAST(pred <> current_code AS INT) AS fl, CAST(is_error AS INT) AS pos,
                     CAST(is_error AND pred <> current_code AS INT) AS tp FROM pairs_pred) {'GROUP BY ' + g if g else ''})"""


def _det(df, groups=()):
    out = M.binary_prf(df, F.col("is_error"), F.col("pred") != F.col("current_code"), (1.0, 0.5), groups)
    return out.select(*groups, r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                      r6(F.col("f1")).alias("f1"), r6(F.col("f05")).alias("f05"), "n")


@register("M7_detection", with_fixtures(_det_sql(), "pairs_pred"))
def m7(fx):
    return _det(pairs_pred(fx))


@register("M8_baselines", with_fixtures(f"""
    SELECT 'no_change' AS baseline, round(avg(CASE WHEN current_code = original_code THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM pairs_pred
    UNION ALL SELECT 'prior', round(avg(CASE WHEN original_code = (SELECT original_code FROM pairs_pred WHERE NOT is_error
        GROUP BY original_code ORDER BY count(*) DESC, original_code LIMIT 1) THEN 1.0 ELSE 0.0 END), 6) FROM pairs_pred
    UNION ALL SELECT 'uniform', round(avg(CASE WHEN original_code =
        {u32_sql('duck', P.seed, 'uniform', 'pair_id', 'is_error')} % {len(CONFUSABLES)} THEN 1.0 ELSE 0.0 END), 6)
        FROM pairs_pred
    UNION ALL SELECT 'bigram', round(avg(CASE WHEN pred = original_code THEN 1.0 ELSE 0.0 END), 6) FROM pairs_pred""",
    "pairs_pred"))
def m8(fx):
    pp = pairs_pred(fx)
    prior = (pp.filter(~F.col("is_error")).groupBy("original_code").count()
             .orderBy(F.desc("count"), "original_code").limit(1).select("original_code").scalar())
    uni = rng.pick(len(CONFUSABLES), P.seed, "uniform", F.col("pair_id"), F.col("is_error").cast("string"))
    acc = lambda c: r6(F.avg(c.cast("double")))
    base = pp.agg(
        acc(F.col("current_code") == F.col("original_code")).alias("no_change"),
        acc(F.col("original_code") == prior).alias("prior"),
        acc(F.col("original_code") == uni).alias("uniform"),
        acc(F.col("pred") == F.col("original_code")).alias("bigram"))
    return base.select(F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("accuracy"))
                                           for n in ("no_change", "prior", "uniform", "bigram")])).alias("b")) \
        .select("b.baseline", "b.accuracy")


@register("M9_pr_curve", with_fixtures("""
    SELECT k, threshold, round(cp / (cp + cn), 6) AS precision, round(CASE WHEN tot > 0 THEN cp / tot ELSE 0.0 END, 6) AS recall
    FROM (SELECT k, threshold,
                 sum(pos) OVER (PARTITION BY k ORDER BY threshold DESC) AS cp,
                 sum(neg) OVER (PARTITION BY k ORDER BY threshold DESC) AS cn,
                 sum(pos) OVER (PARTITION BY k) AS tot
          FROM (SELECT k, p AS threshold, sum(CASE WHEN label = k THEN 1 ELSE 0 END) AS pos,
                       sum(CASE WHEN label = k THEN 0 ELSE 1 END) AS neg FROM scores_long GROUP BY k, p))
    UNION ALL SELECT DISTINCT k, NULL, 1.0, 0.0 FROM scores_long""", "scores_long"))
def m9(fx):
    c = M.pr_curve(scores_long(fx))
    return c.select("k", "threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@register("M10_metrics_by_length", with_fixtures(
    _macro_sql(_with_f(_prf_sql("(SELECT * FROM pairs_pred WHERE len BETWEEN 5 AND 49)", "original_code", "pred",
                                ("len",))), ("len",)), "pairs_pred"))
def m10(fx):
    pp = pairs_pred(fx).filter(F.col("len").between(5, 49))
    return _macro(pp, "original_code", "pred", ["len"])


_CONSTRAINTS_SQL = """(SELECT c.constraint_name, pp.* FROM pairs_pred pp, (VALUES ('length'), ('no_unknown'), ('both'))
    c(constraint_name) WHERE (c.constraint_name IN ('length', 'both') AND NOT (pp.len > 8 AND pp.len < 20)) IS NOT TRUE
      AND (c.constraint_name IN ('no_unknown', 'both') AND list_contains(pp.sent, 0)) IS NOT TRUE)"""


@register("M11_metrics_with_constraints", with_fixtures(
    _macro_sql(_with_f(_prf_sql(_CONSTRAINTS_SQL, "original_code", "pred", ("constraint_name",))),
               ("constraint_name",)), "pairs_pred"))
def m11(fx, lo: int = 8, hi: int = 20):
    pp = pairs_pred(fx)
    length_ok = (F.col("len") > lo) & (F.col("len") < hi)
    known = ~F.array_contains("sent", 0)
    names_ = F.filter(F.array(F.when(length_ok, F.lit("length")), F.when(known, F.lit("no_unknown")),
                              F.when(length_ok & known, F.lit("both"))), lambda x: x.isNotNull())
    fan = pp.withColumn("constraint_name", F.explode(names_))
    return _macro(fan, "original_code", "pred", ["constraint_name"])


@register("M12_detection_by_word", with_fixtures(
    _det_sql(("grouping", "word")).replace(
        "FROM pairs_pred)", "FROM (SELECT 'original' AS grouping, original AS word, * FROM pairs_pred "
                            "UNION ALL SELECT 'current', current, * FROM pairs_pred))"), "pairs_pred"))
def m12(fx):
    pp = pairs_pred(fx)
    fan = pp.withColumn("_g", F.explode(F.array(
        F.struct(F.lit("original").alias("grouping"), F.col("original").alias("word")),
        F.struct(F.lit("current").alias("grouping"), F.col("current").alias("word"))))) \
        .select("*", "_g.grouping", "_g.word")
    return _det(fan, ["grouping", "word"])


_PAIR_SQL = """
    SELECT current, original, precision, recall,
           CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS fscore,
           support, nfl FROM (
      SELECT s.current, s.original, CASE WHEN coalesce(pr.predicted, 0) > 0 THEN s.tp / pr.predicted ELSE 0.0 END AS precision,
             s.tp / s.support AS recall, s.support, (SELECT count(*) FROM pairs_pred WHERE pred <> current_code) AS nfl
      FROM (SELECT current, original, count(*) AS support, sum(CASE WHEN pred = original_code THEN 1 ELSE 0 END) AS tp
            FROM pairs_pred WHERE pred <> current_code GROUP BY 1, 2) s
      LEFT JOIN (SELECT current, p.original AS pred_word, count(*) AS predicted FROM pairs_pred
                 JOIN (SELECT DISTINCT original, original_code FROM pairs_pred) p ON p.original_code = pairs_pred.pred
                 WHERE pred <> current_code GROUP BY 1, 2) pr ON pr.current = s.current AND pr.pred_word = s.original)"""


def _pair_prf(fx):
    pp = pairs_pred(fx).filter(F.col("pred") != F.col("current_code"))
    conf = F.array(*[F.lit(c) for c in CONFUSABLES])
    pp = pp.withColumn("pred_word", F.element_at(conf, F.col("pred") + 1))
    s = pp.groupBy("current", "original").agg(F.count(F.lit(1)).alias("support"),
                                              F.sum((F.col("pred") == F.col("original_code")).cast("int")).alias("tp"))
    pr = pp.groupBy("current", F.col("pred_word").alias("original")).agg(F.count(F.lit(1)).alias("predicted"))
    t = s.join(pr, ["current", "original"], "left")
    p = F.when(F.coalesce("predicted", F.lit(0)) > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    # flagged rows = sum of the supports of the (few) pair rows
    nfl = F.sum("support").over(Window.partitionBy(F.lit(1)))
    return t.select("current", "original", p.alias("precision"), r.alias("recall"),
                    M.fbeta(p, r, 1.0).alias("fscore"), "support", nfl.alias("nfl"))


@register("M13_correction_by_pair", with_fixtures(f"""
    SELECT current, original, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fscore, 6) AS fscore,
           support, round(fscore * support / nfl, 6) AS weight FROM ({_PAIR_SQL})""", "pairs_pred"))
def m13(fx):
    t = _pair_prf(fx)
    return t.select("current", "original", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                    r6(F.col("fscore")).alias("fscore"), "support",
                    r6(F.col("fscore") * F.col("support") / F.col("nfl")).alias("weight"))


@register("M14_class_sizes", with_fixtures(
    "SELECT original_code AS class_id, original AS name, count(*) AS n FROM pairs WHERE NOT is_error GROUP BY 1, 2",
    "pairs"))
def m14(fx):
    return fx.pairs().filter(~F.col("is_error")).groupBy(F.col("original_code").alias("class_id"),
                                                          F.col("original").alias("name")).agg(
        F.count(F.lit(1)).alias("n"))


@register("M15_size_vs_f1", with_fixtures(
    f"SELECT round(corr(CAST(support AS DOUBLE), fscore), 6) AS corr, count(*) AS n_pairs FROM ({_PAIR_SQL})",
    "pairs_pred"))
def m15(fx):
    return M.size_vs_f1(_pair_prf(fx)).select(r6(F.col("corr")).alias("corr"), "n_pairs")


def _scen_sql():
    return ", ".join(f"({k}, [{', '.join(map(str, m))}]::INT[], "
                     f"'{''.join('P' if j == 2 else ('?' if j in m else '_') for j in range(5))}')"
                     for k, m in enumerate(W.mask_scenarios(5)))


@register("M16_sensitivity_report", with_fixtures(_macro_sql(_with_f(_prf_sql(f"""(
    SELECT m.pattern, m.original_code, coalesce(b.best, m.current_code) AS pred FROM (
      SELECT s.pattern, p.original_code, p.current_code,
             CASE WHEN list_contains(s.mask, 3) THEN 0 ELSE
               list_slice(list_concat([0, 0], p.sent, [0, 0]), p.position + 1, p.position + 5)[4] END AS nxt
      FROM pairs p, (VALUES {_scen_sql()}) s(scenario, mask, pattern)) m
    LEFT JOIN (SELECT nxt, original_code AS best FROM (
        SELECT nxt, original_code, row_number() OVER (PARTITION BY nxt ORDER BY cnt DESC, original_code) AS rk
        FROM (SELECT coalesce(sent[position + 2], -1) AS nxt, original_code, count(*) AS cnt
              FROM pairs WHERE NOT is_error GROUP BY 1, 2)) WHERE rk = 1) b ON b.nxt = m.nxt)""",
    "original_code", "pred", ("pattern",))), ("pattern",)), "pairs"))
def m16(fx):
    pp = pairs_pred(fx)
    model = (pp.filter(~F.col("is_error")).groupBy("nxt", "original_code").count()
             .groupBy("nxt").agg(F.min(F.struct((-F.col("count")).alias("nc"), "original_code")).alias("_b"))
             .select(F.col("nxt").alias("_nxt"), F.col("_b.original_code").alias("_best")))
    model = sizing.broadcast_if_small(model, bound=P.max_features + 2)
    p = fx.pairs().withColumn("win", W.word_window(F.col("sent"), F.col("position"), 5))
    m = W.mask_positions(p, "win", "sent", "position", 5).withColumn("_nxt", F.element_at("win", 4))
    scored = m.join(model, "_nxt", "left").withColumn("pred", F.coalesce("_best", "current_code"))
    return _macro(scored, "original_code", "pred", ["pattern"])


# ---------------------------------------------------------------------------
# B1-B10, I1
# ---------------------------------------------------------------------------

@register("B1_balance_pairs", with_fixtures(f"""
    SELECT p.pair_id, p.is_error, p.original_code FROM pairs p JOIN (
      SELECT pair_id FROM (
        SELECT pair_id, original_code, row_number() OVER (PARTITION BY original_code
                 ORDER BY {u32_sql('duck', P.seed, 'balance', 'pair_id')}, pair_id) AS rk
        FROM pairs WHERE NOT is_error)
      WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM pairs WHERE NOT is_error GROUP BY original_code))) k
    ON k.pair_id = p.pair_id""", "pairs"))
def b1(fx):
    return B.balance_pairs(fx.pairs().select("pair_id", "is_error", "original_code"), "original_code")


@register("B2_class_weights", with_fixtures("""
    SELECT original_code AS class_id, count(*) AS count,
           round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
    FROM pairs WHERE NOT is_error GROUP BY original_code""", "pairs"))
def b2(fx):
    w = B.class_weights(fx.pairs().filter(~F.col("is_error")), "original_code", 1.0)
    return w.select("class_id", "count", r6(F.col("weight")).alias("weight"))


@register("B3_real_examples", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 0")
def b3(fx):
    return B.real_examples(fx.t("labels"), "quality").select("doc_id", "quality", "toxic")


@register("B4_take_subset", "SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 50")
def b4(fx):
    return B.take_subset(fx.t("labels"), 50, "doc_id", F.col("toxic") == 1)


@register("B5_even_rows", with_fixtures("SELECT pair_id, original FROM pairs WHERE NOT is_error", "pairs"))
def b5(fx):
    return B.even_rows(fx.pairs()).select("pair_id", "original")


@register("B6_ok_centre", with_fixtures("""
    SELECT p.pair_id, p.is_error FROM pairs p
    WHERE list_slice(list_concat([0, 0], p.sent, [0, 0]), p.position + 1, p.position + 5)[3] IN
          (SELECT id FROM vocab_ids WHERE term IN ('of', 'to', 'in'))""", "pairs", "vocab_ids"))
def b6(fx):
    ids = [r[0] for r in fx.vocab().filter(F.col("term").isin("of", "to", "in"))
           .select((F.col("term_id") + 1).alias("i")).collect()]
    p = fx.pairs().withColumn("win", W.word_window(F.col("sent"), F.col("position"), 5))
    return B.ok_centre(p, "win", ids, 5).select("pair_id", "is_error")


def _rows(fx):
    return fx.pairs().select((F.col("pair_id") * 2 + F.col("is_error").cast("int")).alias("row_key"))


def _lines(fx):
    """Every line of every document by its key."""
    return fx.sents().select(F.col("sent_id").alias("row_key"))


@register("B7_sample_batch", with_fixtures(f"""
    SELECT row_key FROM (SELECT sent_id AS row_key FROM sents)
    ORDER BY {u32_sql('duck', P.seed, 'batch', "'0'", 'row_key')}, row_key LIMIT 256""", "sents"))
def b7(fx):
    return B.sample_batch(_lines(fx), "row_key", 256, P.seed, 0)


@register("B8_make_batches", with_fixtures(f"""
    SELECT row_key, CAST((row_number() OVER (ORDER BY {u32_sql('duck', P.seed, 'epoch', "'0'", 'row_key')}, row_key) - 1)
                         // 64 AS BIGINT) AS batch_id
    FROM (SELECT sent_id AS row_key FROM sents)""", "sents"))
def b8(fx):
    return B.make_batches(_lines(fx), "row_key", 64, P.seed, 0)


@register("B9_pairwise_shuffle", with_fixtures(f"""
    SELECT p.pair_id, p.is_error, 2 * r.rk + CAST(p.is_error AS INT) AS new_idx FROM pairs p JOIN (
      SELECT pair_id, row_number() OVER (ORDER BY {u32_sql('duck', P.seed, 'pairwise', 'pair_id')}, pair_id) - 1 AS rk
      FROM pairs WHERE NOT is_error) r ON r.pair_id = p.pair_id""", "pairs"))
def b9(fx):
    return B.pairwise_shuffle(fx.pairs().select("pair_id", "is_error")).select("pair_id", "is_error", "new_idx")


@register("B10_reference_shares", with_fixtures(f"""
    SELECT coalesce(o.original, r.original) AS original, o.n, round(o.n / sum(o.n) OVER (), 6) AS share,
           round(r.pct / sum(r.pct) OVER (), 6) AS ref_share FROM
      (SELECT original, count(*) AS n FROM pairs WHERE NOT is_error GROUP BY original) o
    FULL OUTER JOIN (SELECT token AS original, count(*) AS pct FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) AS token FROM benchmark)
      WHERE token IN {tuple(CONFUSABLES)} GROUP BY token) r ON r.original = o.original""", "pairs"))
def b10(fx):
    ref = (fx.t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("original"))
           .filter(F.col("original").isin(*CONFUSABLES)).groupBy("original").agg(F.count(F.lit(1)).alias("pct")))
    out = B.reference_shares(fx.pairs().filter(~F.col("is_error")), "original", ref)
    return out.select("original", "n", r6(F.col("share")).alias("share"), r6(F.col("ref_share")).alias("ref_share"))


@register("I1_dense_index", with_fixtures(
    "SELECT row_key, row_number() OVER (ORDER BY row_key) - 1 AS idx FROM (SELECT sent_id AS row_key FROM sents)",
    "sents"))
def i1(fx):
    return B.dense_index(_lines(fx), "row_key")
