"""String expressions: tokenizer, word test, marking, character corruption.

All functions return built-in Spark expressions (JVM side, no Python UDF).
The corruption steps are written as SQL expression text because the same text
(with the hash spelled per engine) is the DuckDB oracle of the operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for equal results)
# ---------------------------------------------------------------------------
# Tokenizer: words with inner . ' - joins, or one non-space symbol.
TOKEN_RX = r"[\p{L}\p{N}_]+(?:[.'-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"
# A "word" is a whole token of ASCII word characters, dots and hyphens, 2+ long.
WORD_RX = r"^[\w.-]{2,}$"
# Letters drawn by the insert and replace errors.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Names of the four error operators, in the order they are drawn from.
OPERATORS = ("insert", "delete", "replace", "transpose")
# Characters always present in the character vocabulary besides those seen in
# words: space, ASCII letters, ASCII punctuation, digits.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BASE_CHARS = (
    " "
    + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    + ASCII_PUNCTUATION
    + "0123456789"
)


def token_array(text: Column) -> Column:
    """T1 core: ordered lowercase tokens of a text as ``array<string>``."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RX), 0)


def is_word(token: Column) -> Column:
    """Whole token of ASCII word characters, '.' or '-', length >= 2."""
    return token.rlike(WORD_RX)


def method_end(value: Column) -> Column:
    """``value`` itself, through a step that Spark does not fuse with its neighbours.  The
    unrolled corruption steps would otherwise make one generated method of more than 8000
    bytes, which the JVM interprets and never compiles."""
    return F.transform(F.array(value), lambda v: v)[0]


def mark(word: Column) -> Column:
    """``^word$``."""
    return F.concat(F.lit("^"), word, F.lit("$"))


# ---------------------------------------------------------------------------
# Hash RNG as SQL text (Spark and DuckDB spellings of rng.u32)
# ---------------------------------------------------------------------------

def u32_sql(dialect: str, seed, salt, *keys: str) -> str:
    parts = [f"'{seed}'", f"'{salt}'"] + [f"CAST({k} AS STRING)" for k in keys]
    inner = f"substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)"
    if dialect == "spark":
        return f"CAST(conv({inner}, 16, 10) AS BIGINT)"
    return f"CAST(('0x' || {inner})::UBIGINT AS BIGINT)"


# ---------------------------------------------------------------------------
# Character corruption steps (C1-C4).  One step edits ``acc`` once.
#   insert    random letter before position r in [0, len)   (never at the end)
#   delete    remove position max(1, r) - 1                  (last char kept)
#   replace   overwrite position max(1, r) - 1 with a random letter
#   transpose swap position p = max(1, r) with a neighbour: p-1 when p is the
#             last position, otherwise p-1 or p+1 by a coin; strings made of one
#             repeated character are left unchanged
# r, the letter and the coin are keyed draws: (seed, salt, keys..., step),
# materialised as three columns per step so each hash is computed once.
# ---------------------------------------------------------------------------

def draw_columns(tag: str, step: int) -> tuple[str, str, str]:
    """Names of the three per-step draw columns (position, letter, coin)."""
    return f"_r_{tag}{step}", f"_c_{tag}{step}", f"_d_{tag}{step}"


def draw_sql(dialect: str, seed, tag: str, keys, step: int) -> list[tuple[str, str]]:
    """``(name, expression)`` of the raw 32-bit draws of one step."""
    ks = list(keys) + [str(step)]
    r, c, d = draw_columns(tag, step)
    return [(r, u32_sql(dialect, seed, tag + ":pos", *ks)),
            (c, u32_sql(dialect, seed, tag + ":ch", *ks)),
            (d, u32_sql(dialect, seed, tag + ":dir", *ks))]


def prep_levels(acc: str, tag: str, step: int) -> list[list[tuple[str, str]]]:
    """Per-step helper columns, in dependency order (one projection per level).

    _q  insert position r mod len        _ch  drawn letter        _len  len(acc)
    _p  max(1, _q)                        _nb  neighbour for transpose
    Keeping them as columns keeps each step expression small (no repeated
    arithmetic inside CASE branches) and inside one generated method.
    """
    rc, cc, dc = draw_columns(tag, step)
    q, ch, ln, p, nb = (f"_{x}_{tag}{step}" for x in ("q", "ch", "len", "p", "nb"))
    return [
        [(ln, f"length({acc})"),
         (q, f"CAST({rc} % greatest(length({acc}), 1) AS INT)"),
         (ch, f"substr('{LETTERS}', CAST({cc} % 26 AS INT) + 1, 1)")],
        [(p, f"greatest(1, {q})")],
        [(nb, f"CASE WHEN {p} = {ln} - 1 THEN {p} - 1 WHEN {dc} % 2 = 1 THEN {p} + 1 ELSE {p} - 1 END")],
    ]


def prep_columns(tag: str, step: int) -> list[str]:
    return [f"_{x}_{tag}{step}" for x in ("q", "ch", "len", "p", "nb")]


def step_sql(op: str, acc: str, tag: str, step: int) -> str:
    """SQL for one corruption step of operator ``op`` (literal name) on ``acc``;
    draws and positions are read from the helper columns of ``prep_levels``."""
    q, ch, ln, p, nb = prep_columns(tag, step)
    a = f"({acc})"
    if op == "insert":
        return f"substr({a}, 1, {q}) || {ch} || substr({a}, {q} + 1)"
    if op == "delete":
        return f"substr({a}, 1, {p} - 1) || substr({a}, {p} + 1)"
    if op == "replace":
        return f"substr({a}, 1, {p} - 1) || {ch} || substr({a}, {p} + 1)"
    if op == "transpose":
        lo, hi = f"least({p}, {nb})", f"greatest({p}, {nb})"
        return (f"CASE WHEN {ln} < 2 OR replace({a}, substr({a}, 1, 1), '') = '' THEN {a} "
                f"ELSE substr({a}, 1, {lo}) || substr({a}, {hi} + 1, 1) || substr({a}, {lo} + 1, 1) "
                f"|| substr({a}, {hi} + 2) END")
    raise ValueError(f"unknown operator {op!r}")


def any_step_sql(op_col: str, acc: str, tag: str, step: int) -> str:
    """One step of the operator named by the column ``op_col``."""
    arms = " ".join(f"WHEN {op_col} = '{op}' THEN {step_sql(op, acc, tag, step)}" for op in OPERATORS)
    return f"(CASE {arms} ELSE {acc} END)"


def effective_count_sql(op_col: str, n_col: str, token: str) -> str:
    """Error count actually applied: delete never removes the whole string."""
    return (f"(CASE WHEN {op_col} = 'delete' AND {n_col} > length({token}) "
            f"THEN length({token}) - 1 ELSE {n_col} END)")


def edit_columns(op_col: str, acc: str, n_col: str, tag: str, step: int) -> dict[str, Column]:
    """What ``any_step_sql`` does as one edit of ``acc``: its first ``_x`` characters, then
    ``_mid``, then all from ``_y`` on.  An unused step or a string of one repeated character
    under transpose keeps all of ``acc``.  Few nodes in the generated code, and ``_x`` ends its
    method."""
    q, ch, ln, p, nb = prep_columns(tag, step)
    x, mid, y = edit_names(tag, step)
    lo, hi = f"least({p}, {nb})", f"greatest({p}, {nb})"
    swap = f"{op_col} = 'transpose' AND {ln} >= 2"
    used = f"{n_col} >= {step}"
    return {x: method_end(F.expr(f"CASE WHEN {used} THEN CASE WHEN {op_col} = 'insert' THEN {q} "
                                 f"WHEN {op_col} IN ('delete', 'replace') THEN {p} - 1 WHEN {swap} THEN {lo} ELSE {ln} END ELSE {ln} END")),
            mid: F.expr(f"CASE WHEN {used} THEN CASE WHEN {op_col} IN ('insert', 'replace') THEN {ch} "
                        f"WHEN {swap} THEN substr({acc}, {hi} + 1, 1) || substr({acc}, {lo} + 1, 1) ELSE '' END ELSE '' END"),
            y: F.expr(f"CASE WHEN {used} THEN CASE WHEN {op_col} = 'insert' THEN {q} + 1 "
                      f"WHEN {op_col} IN ('delete', 'replace') THEN {p} + 1 WHEN {swap} THEN {hi} + 2 ELSE {ln} + 1 END ELSE {ln} + 1 END")}


def edit_names(tag: str, step: int) -> list[str]:
    return [f"_{x}_{tag}{step}" for x in ("x", "mid", "y")]


def corruption_step(acc: str, n_col: str, tag: str, step: int) -> Column:
    """Spark column: ``acc`` after the edit of ``edit_columns`` when ``step <= n``, else ``acc``."""
    x, mid, y = edit_names(tag, step)
    return F.expr(f"CASE WHEN {n_col} >= {step} THEN substr({acc}, 1, {x}) || {mid} || substr({acc}, {y}) ELSE {acc} END")
