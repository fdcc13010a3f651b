"""Registered queries for contexts and word windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .catalog import register
from .fixtures import P, with_fixtures

N_VOCAB = P.max_features + 1      # replacement id for unknown words (W5, W6) and nonce
BOS, EOS = P.max_features + 2, P.max_features + 3
PAD = 3                           # trailing zero padding of the X sentences


def _s(col):
    return F.array_join(F.col(col).cast("array<string>"), ",") if isinstance(col, str) \
        else F.array_join(col.cast("array<string>"), ",")


def _zeros(n):
    return "[" + ", ".join(["0"] * n) + "]"


def _lead_sql(n):
    k = W.frame_rows(n)
    return (f"lpad(right(coalesce(array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY pos "
            f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), ' '), ''), {n}), {n}, ' ')")


def _trail_sql(k):
    return (f"coalesce(array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY pos "
            f"ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), ' '), '')")


@register("W1_leading_context", with_fixtures(
    f"SELECT doc_id, pos, {_lead_sql(P.lead)} AS lead FROM tokens", "tokens"))
def w1(fx):
    return W.leading_context(fx.tokens(), P.lead).select("doc_id", "pos", "lead")


@register("W2_trailing_context", with_fixtures(
    f"SELECT doc_id, pos, rpad({_trail_sql(W.frame_rows(P.trail))}, {P.trail}, ' ') AS trail FROM tokens",
    "tokens"))
def w2(fx):
    return W.trailing_context(fx.tokens(), P.trail).select("doc_id", "pos", "trail")


@register("W3_char_window", with_fixtures(
    f"SELECT doc_id, pos, {_lead_sql(40)} || ' ' || token || ' ' || "
    f"rpad({_trail_sql(W.frame_rows(58))}, CAST(greatest(58 - length(token), 0) AS INT), ' ') AS window FROM tokens",
    "tokens"))
def w3(fx):
    return W.char_window(fx.docs(), 100, 40).select("doc_id", "pos", "window")


def _win_sql(size, nonce=None):
    h = size // 2
    base = f"list_slice(list_concat({_zeros(h)}, sent, {_zeros(h)}), position + 1, position + {size})"
    if nonce is not None:
        base = f"list_transform({base}, lambda x, i: CASE WHEN i - 1 = {h} THEN {nonce} ELSE x END)"
    return base


@register("W4_word_window", with_fixtures(
    f"SELECT pair_id, is_error, array_to_string({_win_sql(5)}, ',') AS win5, "
    f"array_to_string({_win_sql(7, N_VOCAB)}, ',') AS win7_nonce FROM pairs", "pairs"))
def w4(fx):
    p = fx.pairs()
    return p.select("pair_id", "is_error",
                    _s(W.word_window(F.col("sent"), F.col("position"), 5)).alias("win5"),
                    _s(W.word_window(F.col("sent"), F.col("position"), 7, N_VOCAB)).alias("win7_nonce"))


def _x_spark():
    return F.concat(F.array(F.lit(BOS)), F.col("sent"), F.array(F.lit(EOS)), F.array_repeat(F.lit(0), PAD))


_X_SQL = f"list_concat([{BOS}], sent, [{EOS}], {_zeros(PAD)})"


@register("W5_renumber_unknown_sentence", with_fixtures(
    f"SELECT sent_id, array_to_string(list_transform({_X_SQL}, lambda v, i: "
    f"CASE WHEN v = 0 AND i - 1 < len + 2 THEN {N_VOCAB} ELSE v END), ',') AS x_rnn FROM sent_ids",
    "sent_ids"))
def w5(fx):
    s = fx.sents()
    return s.select("sent_id", _s(W.renumber_unknown_sentence(_x_spark(), F.col("len"), N_VOCAB)).alias("x_rnn"))


@register("W6_renumber_unknown_window", with_fixtures(
    f"SELECT pair_id, is_error, array_to_string(list_transform({_win_sql(5)}, lambda v, i: "
    f"CASE WHEN v = 0 AND i - 1 >= greatest(0, 2 - position) THEN {N_VOCAB} ELSE v END), ',') AS win_rnn "
    f"FROM pairs", "pairs"))
def w6(fx):
    p = fx.pairs()
    win = W.word_window(F.col("sent"), F.col("position"), 5)
    return p.select("pair_id", "is_error",
                    _s(W.renumber_unknown_window(win, F.col("position"), N_VOCAB)).alias("win_rnn"))


@register("W7_add_window", with_fixtures(
    f"SELECT pair_id, is_error, array_to_string({_win_sql(7)}, ',') AS xwindow7 FROM pairs", "pairs"))
def w7(fx):
    p = fx.pairs().withColumn("X", _x_spark()).withColumnRenamed("position", "window_position")
    out = W.add_window(p, "xwindow7", 7)
    return out.select("pair_id", "is_error", _s("xwindow7").alias("xwindow7"))


def _scenario_values():
    rows = []
    for k, m in enumerate(W.mask_scenarios(5)):
        pattern = "".join("P" if j == 2 else ("?" if j in m else "_") for j in range(5))
        rows.append(f"({k}, [{', '.join(map(str, m))}]::INT[], '{pattern}')")
    return ", ".join(rows)


@register("W8_mask_positions", with_fixtures(f"""
    SELECT pair_id, is_error, scenario, pattern,
           array_to_string(list_transform({_win_sql(5)}, lambda v, i: CASE WHEN list_contains(mask, i - 1) THEN 0 ELSE v END), ',') AS win,
           CAST(len(list_filter(list_transform(sent, lambda v, i:
                CASE WHEN list_contains(list_transform(mask, lambda m: m - 2 + position), i - 1) THEN 0 ELSE v END),
                lambda x: x = 0)) AS INT) AS n_zero_sent
    FROM pairs CROSS JOIN (VALUES {_scenario_values()}) s(scenario, mask, pattern)""", "pairs"))
def w8(fx):
    p = fx.pairs().withColumn("win", W.word_window(F.col("sent"), F.col("position"), 5))

    def zeros(sent):
        return F.size(sent) - F.size(F.array_remove(sent, 0))

    # no scenario changes what lies beyond the window: its zeros are counted once per pair, and
    # each scenario masks the sentence's part under the window
    first = F.greatest(F.col("position") - 2, F.lit(0))
    p = p.withColumn("under", F.slice("sent", first + 1, F.col("position") + 3 - first)) \
        .select("pair_id", "is_error", "win", "under", (F.col("position") - first).alias("place"),
                (zeros(F.col("sent")) - zeros(F.col("under"))).alias("beyond"))
    m = W.mask_positions(p, "win", "under", "place", 5)
    return m.select("pair_id", "is_error", "scenario", "pattern", _s("win").alias("win"),
                    (F.col("beyond") + zeros(F.col("under"))).alias("n_zero_sent"))
