"""Registered queries for error injection, nearest words and datasets
(C1-C10, N1-N5, D1-D6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import (OPERATORS, any_step_sql, draw_sql, effective_count_sql, prep_columns,
                              prep_levels, u32_sql)
from ..operators import corrupt as C
from ..operators import examples as D
from ..operators import nearest as N
from ..operators import noise
from ..operators import text as T
from . import text_queries  # noqa: F401  (registers the char_vocab fixture)
from .catalog import register
from .fixtures import CONFUSABLES, P, register_fixture_sql, with_fixtures

SPEC = D.ExampleSpec(max_token_length=P.max_token_length, lead=P.lead, trail=P.trail,
                     copies=P.copies, n_token_errors=(1, 2), n_context_errors=(0, 1), seed=P.seed)
SINGLE_OP_N = 2          # errors per token for the single-operator queries C1-C4
DICT_MIN_FREQ = 5        # dictionary = document words seen at least this often
D1_COLUMNS = ("correction", "error_type", "context_id", "example_id", "edit_distance_to_nearest_term",
              "nearest", "term_length", "correct_token", "corrupt_token")
TRAIN, VALID = 0.8, 0.5  # D3: train share; valid share of the rest

# ---------------------------------------------------------------------------
# Spark fixtures
# ---------------------------------------------------------------------------


def dictionary(fx):
    return fx._get("dict", lambda: fx.freq().filter(F.col("freq") >= DICT_MIN_FREQ))


def short_vocab(fx):
    return fx.vocab().filter(F.length("term") <= P.max_token_length)


def cands(fx):
    return fx._get("cands", lambda: N.candidates(short_vocab(fx), dictionary(fx), 2,
                                                 max_term_len=P.max_token_length))


def nearest_words(fx):
    return fx._get("nearest", lambda: N.nearest(short_vocab(fx), cands(fx), dictionary(fx)))


def examples(fx, encode=False):
    """The examples; with ``encode`` the columns of D1, its codes joined to strings."""
    def build():
        chars = T.char_vocab(fx.freq(), "term") if encode else None
        return D.build_examples(fx.docs(), fx.vocab(), nearest_words(fx), chars, SPEC,
                                P.max_features, encode=encode, keep=D1_COLUMNS, joined=encode)
    return fx._get(f"examples{encode}", build)


def spellings(fx):
    """The examples' keys and spellings alone."""
    return fx._get("spellings", lambda: D.corrupted_occurrences(fx.tokens(), fx.vocab(), SPEC, P.max_features))


def positions15(fx):
    return T.positions(fx.tokens(), short_vocab(fx), P.max_features)


# ---------------------------------------------------------------------------
# DuckDB fixtures
# ---------------------------------------------------------------------------


def corrupt_sql(base: str, src: str, out: str, op: str, n: str, max_n: int, tag: str, keys) -> str:
    """Nested SELECTs applying ``max_n`` guarded steps (the Spark plan's twin)."""
    q = f"SELECT *, {effective_count_sql(op, n, src)} AS _n_{out}, {src} AS _a0 FROM ({base})"
    drop = [f"_n_{out}"] + [f"_a{k}" for k in range(max_n)]
    for k in range(1, max_n + 1):
        draws = draw_sql("duck", P.seed, tag, keys, k)
        q = f"SELECT *, {', '.join(f'{e} AS {name}' for name, e in draws)} FROM ({q})"
        for level in prep_levels(f"_a{k - 1}", tag, k):
            q = f"SELECT *, {', '.join(f'{e} AS {name}' for name, e in level)} FROM ({q})"
        step = any_step_sql(op, f"_a{k - 1}", tag, k)
        q = f"SELECT *, CASE WHEN _n_{out} >= {k} THEN {step} ELSE _a{k - 1} END AS _a{k} FROM ({q})"
        drop += [name for name, _ in draws] + prep_columns(tag, k)
    drops = ", ".join(drop)
    return f"SELECT * EXCLUDE ({drops}) RENAME (_a{max_n} AS {out}) FROM ({q})"


def _ops_sql():
    return "[" + ", ".join(f"'{o}'" for o in OPERATORS) + "]"


def _pick_sql(n, salt, *keys):
    return f"CAST({u32_sql('duck', P.seed, salt, *keys)} % {n} AS INT) + 1"


def _variants_sql(w: str) -> str:
    def d1(x):
        return f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, 1, i - 1) || substr({x}, i + 1))"
    return f"list_distinct(list_concat([{w}], {d1(w)}, flatten(list_transform({d1(w)}, lambda y: {d1('y')}))))"


_KEYS3 = ("doc_id", "pos", "copy")

register_fixture_sql("dict", ("freq",), f"SELECT term, freq FROM freq WHERE freq >= {DICT_MIN_FREQ}")
register_fixture_sql("svocab", ("vocab",), f"SELECT * FROM vocab WHERE length(term) <= {P.max_token_length}")
register_fixture_sql("cands", ("svocab", "dict"), f"""
    SELECT v.term, d.term AS cand, CAST(levenshtein(v.term, d.term) AS INT) AS distance
    FROM svocab v JOIN dict d ON abs(length(v.term) - length(d.term)) <= 2
    WHERE levenshtein(v.term, d.term) <= 2""")
register_fixture_sql("cands_flagged", ("cands",), """
    SELECT *, reason IS NOT NULL AS rejected FROM (
      SELECT term, cand, distance,
             CASE WHEN cand = term THEN 'self'
                  WHEN contains(cand, ' ') OR contains(cand, '-') OR contains(cand, '''') THEN 'split'
                  WHEN cand = term || 's' OR cand || 's' = term THEN 'plural' END AS reason
      FROM cands)""")
register_fixture_sql("nearest", ("cands_flagged", "dict", "svocab"), """
    SELECT v.term, b.cand AS nearest, b.distance, CAST(coalesce(b.rank, 0) AS INT) AS rank,
           coalesce(r.n_rejected, 0) AS n_rejected
    FROM svocab v
    LEFT JOIN (SELECT * FROM (
        SELECT term, cand, distance, rank,
               row_number() OVER (PARTITION BY term ORDER BY distance, rank) AS k
        FROM (SELECT c.*, row_number() OVER (PARTITION BY c.term ORDER BY c.distance, d.freq DESC NULLS LAST, c.cand) AS rank
              FROM cands_flagged c LEFT JOIN dict d ON d.term = c.cand)
        WHERE NOT rejected) WHERE k = 1) b ON b.term = v.term
    LEFT JOIN (SELECT term, count(*) AS n_rejected FROM cands_flagged WHERE rejected GROUP BY term) r
      ON r.term = v.term""")
register_fixture_sql("positions15", ("tokens", "svocab"), """
    SELECT t.doc_id, t.pos, v.term, v.term_id FROM tokens t JOIN svocab v ON t.token = v.term""")

_K_LEAD = 10 // 2 + 2
_EX_BASE = f"""
    SELECT c.doc_id, c.pos, c.term, c.term_id, c.lead, c.trail, n.nearest, n.distance, cp.copy,
           {_ops_sql()}[{_pick_sql(4, 'op', 'c.doc_id', 'c.pos', 'cp.copy')}] AS error_type,
           {list(SPEC.n_token_errors)}[{_pick_sql(len(SPEC.n_token_errors), 'n_token', 'c.doc_id', 'c.pos', 'cp.copy')}] AS n_token_errors,
           {list(SPEC.n_context_errors)}[{_pick_sql(len(SPEC.n_context_errors), 'n_context', 'c.doc_id', 'c.pos', 'cp.copy')}] AS n_context_errors
    FROM (SELECT x.doc_id, x.pos, v.term, v.term_id, x.lead, x.trail FROM (
            SELECT doc_id, pos, token,
                   lpad(right(coalesce(array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY pos
                        ROWS BETWEEN {_K_LEAD} PRECEDING AND 1 PRECEDING), ' '), ''), {P.lead}), {P.lead}, ' ') AS lead,
                   rpad(coalesce(array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY pos
                        ROWS BETWEEN 1 FOLLOWING AND {_K_LEAD} FOLLOWING), ' '), ''), {P.trail}, ' ') AS trail
            FROM tokens) x JOIN svocab v ON x.token = v.term) c
    LEFT JOIN nearest n ON n.term = c.term
    CROSS JOIN (SELECT CAST(unnest(range(1, {SPEC.copies + 1})) AS INT) AS copy) cp"""
_EX = corrupt_sql(_EX_BASE, "term", "corrupt_token", "error_type", "n_token_errors",
                  max(SPEC.n_token_errors), "token", _KEYS3)
_EX = corrupt_sql(_EX, "lead", "lead_c", "error_type", "n_context_errors", max(SPEC.n_context_errors), "lead", _KEYS3)
_EX = corrupt_sql(_EX, "trail", "trail_c", "error_type", "n_context_errors", max(SPEC.n_context_errors), "trail",
                  _KEYS3)
register_fixture_sql("examples", ("tokens", "svocab", "nearest"), f"""
    SELECT term_id AS correction, error_type, doc_id * {D.CONTEXT_FACTOR} + pos AS context_id,
           (doc_id * {D.CONTEXT_FACTOR} + pos) * {SPEC.copies} + copy - 1 AS example_id,
           CAST(distance AS DOUBLE) AS edit_distance_to_nearest_term, nearest,
           CAST(length(term) AS INT) AS term_length, term AS correct_token, corrupt_token,
           lead_c, trail_c, rpad(lead_c || '{SPEC.leading_separator}' || corrupt_token || '{SPEC.trailing_separator}' || trail_c,
                                 {SPEC.window_width}, ' ') AS full_window, doc_id, pos, copy, n_token_errors, n_context_errors
    FROM ({_EX})""")
_SLIM = corrupt_sql(f"""
    SELECT c.doc_id, c.pos, c.term, c.term_id, cp.copy,
           {_ops_sql()}[{_pick_sql(4, 'op', 'c.doc_id', 'c.pos', 'cp.copy')}] AS error_type,
           {list(SPEC.n_token_errors)}[{_pick_sql(len(SPEC.n_token_errors), 'n_token', 'c.doc_id', 'c.pos', 'cp.copy')}] AS n_token_errors
    FROM positions15 c CROSS JOIN (SELECT CAST(unnest(range(1, {SPEC.copies + 1})) AS INT) AS copy) cp""",
    "term", "corrupt_token", "error_type", "n_token_errors", max(SPEC.n_token_errors), "token", _KEYS3)
register_fixture_sql("spellings", ("positions15",), f"""
    SELECT term_id AS correction, error_type, doc_id * {D.CONTEXT_FACTOR} + pos AS context_id,
           (doc_id * {D.CONTEXT_FACTOR} + pos) * {SPEC.copies} + copy - 1 AS example_id,
           term AS correct_token, corrupt_token, doc_id, pos, copy FROM ({_SLIM})""")
register_fixture_sql("char_map", ("char_vocab",), "SELECT map(list(ch), list(char_id)) AS m FROM char_vocab")


# ---------------------------------------------------------------------------
# C1-C10
# ---------------------------------------------------------------------------

def _single_op(op):
    sql = corrupt_sql(f"SELECT doc_id, pos, term, '{op}' AS _op, {SINGLE_OP_N} AS _n FROM positions15",
                      "term", "corrupted", "_op", "_n", SINGLE_OP_N, "token", ("doc_id", "pos"))
    return with_fixtures(f"SELECT doc_id, pos, term, corrupted FROM ({sql})", "positions15")


def _single(fx, op):
    out = C.corrupt_with(positions15(fx).select("doc_id", "pos", "term"), op, SINGLE_OP_N, token_col="term",
                         seed=P.seed)
    return out.select("doc_id", "pos", "term", "corrupted")


@register("C1_insert_chars", _single_op("insert"))
def c1(fx):
    return _single(fx, "insert")


@register("C2_delete_chars", _single_op("delete"))
def c2(fx):
    return _single(fx, "delete")


@register("C3_replace_chars", _single_op("replace"))
def c3(fx):
    return _single(fx, "replace")


@register("C4_transpose_chars", _single_op("transpose"))
def c4(fx):
    return _single(fx, "transpose")


@register("C5_corrupt", with_fixtures(
    "SELECT doc_id, pos, copy, error_type, n_token_errors, corrupt_token FROM examples", "examples"))
def c5(fx):
    return examples(fx).select("doc_id", "pos", "copy", "error_type", "n_token_errors", "corrupt_token")


@register("C6_corrupt_context", with_fixtures(
    "SELECT doc_id, pos, copy, n_context_errors, lead_c, trail_c FROM examples", "examples"))
def c6(fx):
    return examples(fx).select("doc_id", "pos", "copy", "n_context_errors", "lead_c", "trail_c")


@register("C7_confusion_swap", with_fixtures(
    "SELECT pair_id, is_error, original, current FROM pairs", "pairs"))
def c7(fx):
    occ = fx.pairs().filter(~F.col("is_error")).select("pair_id", "original")
    return C.confusion_swap(occ, "original", CONFUSABLES, "pair_id", P.seed).select(
        "pair_id", "is_error", "original", "current")


@register("C8_duplicate_values", with_fixtures(
    "SELECT pair_id, is_error, original_code AS target FROM pairs", "pairs"))
def c8(fx):
    return fx.pairs().select("pair_id", "is_error", F.col("original_code").alias("target"))


@register("C9_permute_centre", with_fixtures(f"""
    SELECT k.pair_id, k.original_code, h.permuted FROM
      (SELECT pair_id, original_code, row_number() OVER (ORDER BY pair_id) AS i FROM pairs WHERE NOT is_error) k
    JOIN (SELECT original_code AS permuted,
                 row_number() OVER (ORDER BY {u32_sql('duck', P.seed, 'permute', 'pair_id')}, pair_id) AS i
          FROM pairs WHERE NOT is_error) h ON k.i = h.i""", "pairs"))
def c9(fx):
    base = fx.pairs().filter(~F.col("is_error")).select("pair_id", "original_code")
    return C.permute_centre(base, "pair_id", "original_code", P.seed).select("pair_id", "original_code", "permuted")


@register("C10_regularize_centre", with_fixtures(f"""
    SELECT pair_id, is_error, original_code,
           CASE WHEN len(rest) > 0 THEN rest[CAST({u32_sql('duck', P.seed, 'regularize', 'pair_id')} % len(rest) AS INT) + 1]
                ELSE original_code END AS regularized
    FROM (SELECT p.*, list_filter(s.vals, lambda x: x <> p.original_code) AS rest
          FROM pairs p, (SELECT list(DISTINCT original_code ORDER BY original_code) AS vals FROM pairs) s)""", "pairs"))
def c10(fx):
    p = fx.pairs().select("pair_id", "is_error", "original_code")
    return C.regularize_centre(p, "original_code", "pair_id", P.seed)


# ---------------------------------------------------------------------------
# N1-N5
# ---------------------------------------------------------------------------

@register("N1_candidates", with_fixtures("SELECT term, cand, distance FROM cands", "cands"))
def n1(fx):
    return cands(fx)


@register("N2_reject_rules", with_fixtures(
    "SELECT term, cand, distance, reason, rejected FROM cands_flagged", "cands_flagged"))
def n2(fx):
    return N.reject_rules(cands(fx))


@register("N3_nearest", with_fixtures(
    "SELECT term, nearest, distance, rank, n_rejected FROM nearest", "nearest"))
def n3(fx):
    return nearest_words(fx)


@register("N4_edit_distance", with_fixtures(
    "SELECT doc_id, pos, copy, CAST(levenshtein(correct_token, corrupt_token) AS INT) AS distance FROM examples",
    "examples"))
def n4(fx):
    return N.edit_distance(spellings(fx), "correct_token", "corrupt_token").select("doc_id", "pos", "copy", "distance")


register_fixture_sql("n5_cands", ("examples", "dict"), f"""
    SELECT e.term, e.cand, CAST(levenshtein(e.term, e.cand) AS INT) AS distance, d.freq FROM (
      SELECT DISTINCT t.term, c.cand FROM
        (SELECT term, unnest(vs) AS v FROM (SELECT DISTINCT corrupt_token AS term, {_variants_sql('corrupt_token')} AS vs
                                         FROM examples)) t
        JOIN (SELECT cand, unnest(vs) AS v FROM (SELECT term AS cand, {_variants_sql('term')} AS vs
                                             FROM dict WHERE length(term) <= {P.max_token_length + 4})) c
        ON t.v = c.v) e
    JOIN dict d ON d.term = e.cand
    WHERE levenshtein(e.term, e.cand) <= 2""")


@register("N5_noisy_channel_correct", with_fixtures("""
    SELECT x.doc_id, x.pos, x.copy, x.corrupt_token, b.cand AS correction, b.distance AS correction_distance
    FROM examples x LEFT JOIN (
      SELECT term, cand, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, freq DESC, cand) AS k FROM n5_cands)
      WHERE k = 1) b ON b.term = x.corrupt_token""", "examples", "n5_cands"))
def n5(fx):
    errs = spellings(fx).select("doc_id", "pos", "copy", "corrupt_token")
    out = N.noisy_channel_correct(errs, dictionary(fx), ["doc_id", "pos", "copy"],
                                  max_term_len=P.max_token_length + 2)
    return out.select("doc_id", "pos", "copy", "corrupt_token", "correction", "correction_distance")


# ---------------------------------------------------------------------------
# D1-D6
# ---------------------------------------------------------------------------

def _codes_sql(col, width):
    return (f"array_to_string(list_transform(string_split(rpad({col}, {width}, ' '), ''), "
            f"lambda c: coalesce(cm.m[c], cm.m[' '])), ',')")


@register("D1_build_examples", with_fixtures(f"""
    SELECT correction, error_type, context_id, example_id, edit_distance_to_nearest_term, nearest, term_length,
           correct_token, corrupt_token,
           {_codes_sql('full_window', SPEC.window_width)} AS full_error,
           {_codes_sql('lead_c', SPEC.lead + SPEC.max_ctx)} AS leading_context,
           {_codes_sql('corrupt_token', SPEC.max_token_length + max(SPEC.n_token_errors))} AS spelling_error,
           {_codes_sql('trail_c', SPEC.trail + SPEC.max_ctx)} AS trailing_context
    FROM examples, char_map cm""", "examples", "char_map"))
def d1(fx):
    return examples(fx, encode=True).select(*D1_COLUMNS, "full_error", "leading_context", "spelling_error", "trailing_context")


@register("D2_window_string", with_fixtures("SELECT example_id, full_window FROM examples", "examples"))
def d2(fx):
    return examples(fx).select("example_id", "full_window")


def _split_sql():
    u = f"({u32_sql('duck', P.seed, 'split', 'context_id')} % 1000000)"
    t_cut = int(round(TRAIN * 1_000_000))
    v_cut = int(round((TRAIN + (1 - TRAIN) * VALID) * 1_000_000))
    return f"CASE WHEN {u} < {t_cut} THEN 'train' WHEN {u} < {v_cut} THEN 'valid' ELSE 'test' END"


register_fixture_sql("splits", ("examples",), f"SELECT example_id, context_id, {_split_sql()} AS split FROM examples")


def splits(fx):
    return D.group_split(spellings(fx).select("example_id", "context_id", "correct_token", "corrupt_token"),
                         ["context_id"], TRAIN, VALID, P.seed)


@register("D3_group_split", with_fixtures("SELECT example_id, split FROM splits", "splits"))
def d3(fx):
    return splits(fx).select("example_id", "split")


@register("D4_leakage_check", with_fixtures("""
    SELECT g.split_a, g.split_b, coalesce(s.n, 0) AS n_shared
    FROM (VALUES ('train', 'valid'), ('train', 'test'), ('valid', 'test')) g(split_a, split_b)
    LEFT JOIN (SELECT least(a.split, b.split) AS x, greatest(a.split, b.split) AS y, count(*) AS n
               FROM (SELECT DISTINCT context_id, split FROM splits) a
               JOIN (SELECT DISTINCT context_id, split FROM splits) b
                 ON a.context_id = b.context_id AND a.split < b.split GROUP BY 1, 2) s
      ON s.x = least(g.split_a, g.split_b) AND s.y = greatest(g.split_a, g.split_b)""", "splits"))
def d4(fx):
    return D.leakage_check(splits(fx), "context_id")


@register("D5_range_split", with_fixtures("""
    SELECT example_id, idx, CASE WHEN idx < n * 8 // 10 THEN 'train' WHEN idx < n * 9 // 10 THEN 'valid'
                                 ELSE 'test' END AS split
    FROM (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS idx, count(*) OVER () AS n
          FROM examples)""", "examples"))
def d5(fx):
    return D.range_split(spellings(fx).select("example_id"), "example_id", 0.8, 0.1)


@register("D6_binary_real_word", with_fixtures("""
    SELECT e.example_id, CASE WHEN d.term IS NULL THEN 0 ELSE 1 END AS is_real_word
    FROM spellings e LEFT JOIN dict d ON d.term = e.corrupt_token""", "spellings", "dict"))
def d6(fx):
    ex = spellings(fx).select("example_id", "corrupt_token")
    return D.binary_real_word(ex, "corrupt_token", dictionary(fx)).select("example_id", "is_real_word")


_EXACT = [int(round(x * 1000)) for x in (TRAIN, TRAIN + (1 - TRAIN) * VALID)]


@register("D3_group_split_exact", with_fixtures(f"""
    SELECT * FROM (
    WITH g AS (SELECT context_id, count(*) AS n, {u32_sql('duck', P.seed, 'split', 'context_id')} AS h
               FROM spellings GROUP BY context_id),
         c AS (SELECT context_id, sum(n) OVER (ORDER BY h, context_id) AS upto, sum(n) OVER () AS total FROM g)
    SELECT s.example_id, CASE WHEN c.upto <= c.total * {_EXACT[0]} // 1000 THEN 'train'
                              WHEN c.upto <= c.total * {_EXACT[1]} // 1000 THEN 'valid' ELSE 'test' END AS split
    FROM spellings s JOIN c USING (context_id))""", "spellings"))
def d3_exact(fx):
    ex = spellings(fx).select("example_id", "context_id")
    return D.exact_group_split(ex, ["context_id"], TRAIN, VALID, P.seed).select("example_id", "split")


# C11 -----------------------------------------------------------------------

@register("C11_learned_corruption", with_fixtures("""
    SELECT op, from_ch, to_ch, n, round(n / sum(n) OVER (PARTITION BY op), 6) AS p FROM (
      SELECT op, CASE WHEN op = 'insert' THEN '' ELSE substr(term, pos, 1) END AS from_ch,
                 CASE WHEN op = 'delete' THEN '' ELSE substr(cand, pos, 1) END AS to_ch, count(*) AS n FROM (
        SELECT term, cand,
               CASE WHEN length(cand) = length(term) + 1 THEN 'insert'
                    WHEN length(cand) = length(term) - 1 THEN 'delete' ELSE 'replace' END AS op,
               coalesce(list_min(list_filter(range(1, greatest(least(length(term), length(cand)), 1) + 1),
                        lambda i: substr(term, i, 1) <> substr(cand, i, 1))), least(length(term), length(cand)) + 1) AS pos
        FROM cands WHERE distance = 1) GROUP BY 1, 2, 3)""", "cands"))
def c11(fx):
    pairs = cands(fx).filter(F.col("distance") == 1).select(F.col("term").alias("correct"), F.col("cand").alias("error"))
    out = C.learned_corruption(pairs)
    return out.select("op", "from_ch", "to_ch", "n", F.round("p", 6).alias("p"))


@register("C11_apply_learned")
def c11_apply(fx):
    """Every occurrence of a vocabulary term with a misspelling drawn from the operations
    estimated on the corpus' word pairs, and its weighted edit distance."""
    pairs = cands(fx).filter(F.col("distance") > 0).select(F.col("term").alias("correct"), F.col("cand").alias("error"))
    out = noise.corrupt(positions15(fx).select("doc_id", "pos", "term"), noise.estimate(pairs), ["doc_id", "pos"], "term",
                        seed=P.seed)
    return out.select("doc_id", "pos", "term", "corrupted", F.round("cost", 6).alias("cost"))
