"""Registered queries for sequences (X1-X6), outliers (O1-O7) and run logs
(R1-R7), built on ``events`` and ``embeddings``.

``events`` stands in for training logs: a user is a run, a calendar day is an
epoch, the order of a user's events inside a day is the batch order, ``value``
is the metric and ``props.k`` the batch size.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import outliers as O
from ..operators import sequences as X
from ..operators import text as T
from .catalog import register
from .fixtures import P, with_fixtures, register_fixture_sql
from .score_queries import r6

K_RX = r'"k": (\d+)'


def seq(fx):
    def build():
        ev = fx.t("events").select("event_id", "ts", F.col("user_id").alias("seq_id"), F.col("value").alias("v"))
        return X.sequence_index(ev, "seq_id", ["ts", "event_id"], F.to_date("ts")).select("seq_id", "t", "v")
    return fx._get("seq", build)


def run_log(fx):
    def build():
        ev = fx.t("events")
        first = ev.agg(F.min(F.to_date("ts"))).first()[0]
        e = ev.select(F.col("user_id").alias("run_id"), "event_type", "ts", "event_id", F.col("value").alias("metric"),
                      F.regexp_extract("props", K_RX, 1).cast("int").alias("size"),
                      F.datediff(F.to_date("ts"), F.lit(first)).alias("epoch"))
        w = Window.partitionBy("run_id", "epoch").orderBy("ts", "event_id")
        return e.withColumn("batch", F.row_number().over(w) - 1)
    return fx._get("run_log", build)


def epochs(fx):
    return run_log(fx).groupBy("run_id", "epoch").agg(F.avg("metric").alias("val_loss"))


register_fixture_sql("seq", (), """
    SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
           value AS v FROM events""")
register_fixture_sql("run_log", (), f"""
    SELECT user_id AS run_id, event_type, ts, event_id, value AS metric,
           CAST(regexp_extract(props, '{K_RX}', 1) AS INT) AS size,
           CAST(date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS INT) AS epoch,
           CAST(row_number() OVER (PARTITION BY user_id, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)
                                   ORDER BY ts, event_id) - 1 AS INT) AS batch
    FROM events""")
register_fixture_sql("epochs", ("run_log",), "SELECT run_id, epoch, avg(metric) AS val_loss FROM run_log GROUP BY 1, 2")
register_fixture_sql("best_so_far", ("epochs",), """
    SELECT run_id, epoch, val_loss,
           min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
           arg_min(epoch, val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_epoch
    FROM epochs""")


# X1-X6 ---------------------------------------------------------------------

@register("X1_temporal_difference", with_fixtures("""
    SELECT seq_id, t, round(nv - v, 6) AS d FROM (
      SELECT seq_id, t, v, lead(v) OVER (PARTITION BY seq_id ORDER BY t) AS nv FROM seq) WHERE nv IS NOT NULL""",
    "seq"))
def x1(fx):
    d = X.temporal_difference(seq(fx))
    return d.select("seq_id", "t", r6(F.col("d")).alias("d"))


@register("X2_split_by_filter", """
    SELECT vec_id, CAST(i // 16 AS INT) AS block, CAST(i % 16 AS INT) AS j, round(CAST(v AS DOUBLE), 6) AS v FROM (
      SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) WHERE i < 64""")
def x2(fx):
    out = X.split_by_filter(fx.t("embeddings"), "vec_id", "embedding", 4, 16)
    return out.select("vec_id", "block", "j", r6(F.col("v")).alias("v"))


@register("X3_max_energy_window", with_fixtures("""
    SELECT s.seq_id, b.start, s.t, s.v, round(b.energy, 6) AS energy FROM seq s JOIN (
      SELECT seq_id, start, energy FROM (
        SELECT seq_id, t AS start, e3 AS energy, row_number() OVER (PARTITION BY seq_id ORDER BY e3 DESC, t) AS rk FROM (
          SELECT seq_id, t, sum(v * v) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS e3,
                 count(*) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c3 FROM seq)
        WHERE c3 = 3) WHERE rk = 1) b
    ON s.seq_id = b.seq_id AND s.t BETWEEN b.start AND b.start + 2""", "seq"))
def x3(fx):
    out = X.max_energy_window(seq(fx), 3)
    return out.select("seq_id", "start", "t", "v", r6(F.col("energy")).alias("energy"))


@register("X4_zero_diagonal", """
    SELECT vec_id, CAST(i // 8 AS INT) AS i, CAST(i % 8 AS INT) AS j,
           CASE WHEN i // 8 = i % 8 THEN 0.0 ELSE round(CAST(v AS DOUBLE), 6) END AS v FROM (
      SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)""")
def x4(fx):
    cells = fx.t("embeddings").select("vec_id", F.posexplode("embedding").alias("_k", "v")) \
        .select("vec_id", F.floor(F.col("_k") / 8).cast("int").alias("i"), F.pmod("_k", F.lit(8)).cast("int").alias("j"),
                r6(F.col("v").cast("double")).alias("v"))
    return X.zero_diagonal(cells)


def _embedded(fx):
    ids = T.positions(fx.tokens(), fx.vocab(), P.max_features).select(
        "doc_id", "pos", (F.col("term_id") + 1).alias("vec_id"))
    return X.embed(ids, fx.t("embeddings"))


register_fixture_sql("embedded", ("tokens", "vocab"), """
    SELECT t.doc_id, t.pos, v.term_id + 1 AS vec_id, e.embedding FROM tokens t JOIN vocab v ON t.token = v.term
    LEFT JOIN embeddings e ON e.vec_id = v.term_id + 1""")


@register("X5_embed", with_fixtures("""
    SELECT doc_id, pos, vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)
           AS norm FROM embedded""", "embedded"))
def x5(fx):
    e = _embedded(fx)
    sq = F.aggregate(F.col("embedding"), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return e.select("doc_id", "pos", "vec_id", r6(F.sqrt(sq)).alias("norm"))


@register("X6_max_pool", with_fixtures("""
    SELECT doc_id, CAST(dim AS INT) AS dim, round(max(CAST(embedding[dim + 1] AS DOUBLE)), 6) AS max_v FROM (
      SELECT doc_id, embedding, unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS dim FROM embedded)
    GROUP BY 1, 2""",
    "embedded"))
def x6(fx):
    width = fx.t("embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0
    m = X.max_pool(_embedded(fx), "doc_id", width)
    return m.select("doc_id", "dim", r6(F.col("max_v")).alias("max_v"))


# O1-O7 ---------------------------------------------------------------------

def _emb(fx):
    return fx.t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@register("O1_mahalanobis")
def o1(fx):
    return O.mahalanobis(_emb(fx), "x").select("vec_id", r6(F.col("distance")).alias("distance"))


@register("O2_robust_mahalanobis")
def o2(fx):
    return O.robust_mahalanobis(_emb(fx), "x", "vec_id").select(
        "vec_id", r6(F.col("robust_distance")).alias("robust_distance"))


@register("O3_pca_project")
def o3(fx):
    out, _ = O.pca_project(_emb(fx), "x", 2)
    return out.select("vec_id", r6(F.element_at("pc", 1)).alias("pc1"), r6(F.element_at("pc", 2)).alias("pc2"))


@register("O4_recon_error")
def o4(fx):
    return O.recon_error(_emb(fx), "x", 2).select("vec_id", r6(F.col("recon_error")).alias("recon_error"))


@register("O5_scale01", """
    SELECT vec_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x01 FROM (
      SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)""")
def o5(fx):
    d = fx.t("embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"))
    return O.scale01(d, "x", "x01").select("vec_id", r6(F.col("x01")).alias("x01"))


@register("O6_grid", """
    WITH r AS (SELECT min(a) - (max(a) - min(a)) * 0.1 AS x0, max(a) + (max(a) - min(a)) * 0.1 AS x1,
                      min(b) - (max(b) - min(b)) * 0.1 AS y0, max(b) + (max(b) - min(b)) * 0.1 AS y1
               FROM (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings))
    SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(x0 + ix * ((x1 - x0) / 49), 6) AS gx,
           round(y0 + iy * ((y1 - y0) / 49), 6) AS gy
    FROM r, (SELECT unnest(range(50)) AS ix) a, (SELECT unnest(range(50)) AS iy) b""")
def o6(fx):
    d = fx.t("embeddings").select(F.element_at("embedding", 1).cast("double").alias("a"),
                                  F.element_at("embedding", 2).cast("double").alias("b"))
    g = O.grid(d, "a", "b", 50)
    return g.select("ix", "iy", r6(F.col("gx")).alias("gx"), r6(F.col("gy")).alias("gy"))


@register("O7_pearson", """
    SELECT round(corr(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)), 6) AS pearson, count(*) AS n
    FROM embeddings""")
def o7(fx):
    d = fx.t("embeddings").select(F.element_at("embedding", 1).cast("double").alias("a"),
                                  F.element_at("embedding", 2).cast("double").alias("b"))
    return O.pearson(d, "a", "b").select(r6(F.col("pearson")).alias("pearson"), "n")


# R1-R7 ---------------------------------------------------------------------

@register("R1_running_mean", with_fixtures("""
    SELECT run_id, epoch, batch, round(avg(metric) OVER (PARTITION BY run_id, epoch ORDER BY batch
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean FROM run_log""", "run_log"))
def r1(fx):
    return X.running_mean(run_log(fx)).select("run_id", "epoch", "batch", r6(F.col("running_mean")).alias("running_mean"))


@register("R2_weighted_epoch_mean", with_fixtures("""
    SELECT run_id, epoch, round(CASE WHEN sum(size) <> 0 THEN sum(metric * size) / sum(size) END, 6) AS epoch_mean, sum(size) AS n
    FROM run_log GROUP BY 1, 2""", "run_log"))
def r2(fx):
    m = X.weighted_epoch_mean(run_log(fx))
    return m.select("run_id", "epoch", r6(F.col("epoch_mean")).alias("epoch_mean"), "n")


@register("R3_best_so_far", with_fixtures(
    "SELECT run_id, epoch, round(best, 6) AS best, best_epoch FROM best_so_far", "best_so_far"))
def r3(fx):
    b = X.best_so_far(epochs(fx))
    return b.select("run_id", "epoch", r6(F.col("best")).alias("best"), "best_epoch")


@register("R4_early_stop", with_fixtures("""
    SELECT run_id, coalesce(min(CASE WHEN epoch - best_epoch > 3 THEN epoch END), max(epoch)) AS stop_epoch
    FROM best_so_far GROUP BY run_id""", "best_so_far"))
def r4(fx):
    return X.early_stop(epochs(fx), 3)


@register("R5_lr_drop", with_fixtures("""
    SELECT b.run_id, b.epoch, CASE WHEN d.drop_epoch IS NOT NULL AND b.epoch >= d.drop_epoch THEN CAST(0.1 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS lr
    FROM best_so_far b LEFT JOIN (SELECT run_id, min(epoch) AS drop_epoch FROM best_so_far
                                  WHERE epoch - best_epoch >= 2 GROUP BY run_id) d ON d.run_id = b.run_id""",
    "best_so_far"))
def r5(fx):
    return X.lr_drop(epochs(fx), 2, 10.0).select("run_id", "epoch", "lr")


@register("R6_best_per_group", with_fixtures("""
    SELECT feature_set, run_id, round(val_loss, 6) AS val_loss FROM (
      SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY val_loss, run_id) AS rk FROM (
        SELECT event_type AS feature_set, run_id, avg(metric) AS val_loss FROM run_log GROUP BY 1, 2))
    WHERE rk = 1""", "run_log"))
def r6_(fx):
    runs = run_log(fx).groupBy(F.col("event_type").alias("feature_set"), "run_id").agg(F.avg("metric").alias("val_loss"))
    b = X.best_per_group(runs, "feature_set")
    return b.select("feature_set", "run_id", r6(F.col("val_loss")).alias("val_loss"))


TYPES = ("click", "error", "purchase", "signup", "view")  # the event types of the given table


@register("R7_feature_comparison", with_fixtures(
    "SELECT epoch, " + ", ".join(f"round(avg(metric) FILTER (event_type = '{t}'), 6) AS {t}" for t in TYPES)
    + " FROM run_log GROUP BY epoch", "run_log"))
def r7(fx):
    log = run_log(fx)
    # Spark refuses more types than spark.sql.pivotMaxValues instead of dropping some.
    return log.groupBy("epoch").pivot("event_type").agg(r6(F.avg("metric")))
