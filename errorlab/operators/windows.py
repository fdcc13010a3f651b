"""Positional windows and contexts.

Contexts are strings of neighbouring tokens.  Two physical forms:

* ``leading_context`` / ``trailing_context`` work on a ``tokens`` table.  The
  frame is bounded (K rows) and partitioned by (doc_id, block of positions);
  each block also receives the K boundary rows of its neighbour as "halo"
  rows, so a document of any size is spread over many small partitions.
* ``contexts_from_text`` works on the document row itself: the token array is
  built once and each token's contexts are slices of it, computed inside a
  ``transform`` before the explode.  No shuffle at all.

Word windows (W4-W8) are array expressions on id sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_array


def frame_rows(n_chars: int) -> int:
    """Tokens needed to fill ``n_chars`` characters (each token + space >= 2)."""
    return n_chars // 2 + 2


def _context(tokens: DataFrame, n: int, side: str, out: str, block: int,
             id_col: str = "doc_id", pos_col: str = "pos", token_col: str = "token") -> DataFrame:
    k = frame_rows(n)
    if block <= k:
        raise ValueError("block must exceed the frame size")
    blk = F.floor(F.col(pos_col) / block)
    base = tokens.select(id_col, pos_col, token_col, blk.alias("_blk"), F.lit(False).alias("_halo"))
    if side == "lead":
        halo = tokens.filter(F.pmod(F.col(pos_col), block) >= block - k) \
            .select(id_col, pos_col, token_col, (blk + 1).alias("_blk"), F.lit(True).alias("_halo"))
        frame = (-k, -1)
    else:
        halo = tokens.filter((F.pmod(F.col(pos_col), block) < k) & (F.col(pos_col) >= block)) \
            .select(id_col, pos_col, token_col, (blk - 1).alias("_blk"), F.lit(True).alias("_halo"))
        frame = (1, k)
    w = Window.partitionBy(id_col, "_blk").orderBy(pos_col).rowsBetween(*frame)
    ctx = F.array_join(F.collect_list(token_col).over(w), " ")
    if side == "lead":
        value = F.lpad(F.expr(f"right(_ctx, {n})"), n, " ")
    else:
        value = F.rpad(F.col("_ctx"), n, " ")
    return (base.unionByName(halo)
            .withColumn("_ctx", ctx)
            .filter(~F.col("_halo"))
            .withColumn(out, value)
            .drop("_blk", "_halo", "_ctx"))


# W1 ------------------------------------------------------------------------
def leading_context(tokens: DataFrame, n: int = 10, out: str = "lead", block: int = 4096) -> DataFrame:
    """Last ``n`` characters of the space-joined tokens before each token,
    left-padded with spaces.  Includes token 0 (see SURVEY §8 row 11)."""
    return _context(tokens, n, "lead", out, block)


# W2 ------------------------------------------------------------------------
def trailing_context(tokens: DataFrame, n: int = 10, out: str = "trail", block: int = 4096) -> DataFrame:
    """First ``n`` characters of the space-joined tokens after each token,
    right-padded with spaces."""
    return _context(tokens, n, "trail", out, block)


def lead_expr(toks: Column, i: Column, n: int) -> Column:
    """Leading context of 0-based position ``i`` of token array ``toks``."""
    k = frame_rows(n)
    start = F.greatest(F.lit(1), i - k + 1)
    joined = F.array_join(F.slice(toks, start, i - start + 1), " ")
    return F.lpad(F.substring(joined, -n, n), n, " ") if n > 0 else F.lit("")


def trail_expr(toks: Column, i: Column, n) -> Column:
    """Trailing context of 0-based position ``i``; ``n`` may be a column."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    k = frame_rows(n if isinstance(n, int) else 100)
    joined = F.array_join(F.slice(toks, i + 2, k), " ")
    return F.rpad(joined, F.greatest(n_col, F.lit(0)), " ")


def _with_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, token, _toks)``: each token beside its document's token array.  An outer
    explode: for a plain one the optimizer makes the array twice."""
    return (docs.select(id_col, token_array(F.col(text_col)).alias("_toks"))
            .select(id_col, "_toks", F.posexplode_outer("_toks").alias("pos", "token"))
            .filter(F.col("token").isNotNull()))


def contexts_from_text(docs: DataFrame, n_lead: int = 10, n_trail: int = 10,
                       id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """``(doc_id, pos, token, lead, trail)`` for every token, without a shuffle; with ``terms``
    (small, a column ``term``) only for its tokens, with its other columns."""
    toks = _with_tokens(docs, id_col, text_col)
    if terms is not None:
        toks = toks.join(terms, F.col("token") == F.col("term"))
    return toks.select(id_col, "pos", "token", lead_expr(F.col("_toks"), F.col("pos"), n_lead).alias("lead"),
                       trail_expr(F.col("_toks"), F.col("pos"), n_trail).alias("trail"), *(terms.columns if terms is not None else []))


# W3 ------------------------------------------------------------------------
def char_window(docs: DataFrame, size: int = 100, token_pos: int = 40,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """leading(token_pos) + ' ' + token + ' ' + trailing(size - token_pos - len - 2)."""
    rest = size - token_pos - 2
    i, t = F.col("pos"), F.col("token")
    trail_n = F.greatest(F.lit(rest) - F.length(t), F.lit(0))
    joined = F.array_join(F.slice(F.col("_toks"), i + 2, frame_rows(rest)), " ")
    return _with_tokens(docs, id_col, text_col).select(
        id_col, "pos", "token", F.concat(lead_expr(F.col("_toks"), i, token_pos), F.lit(" "), t, F.lit(" "),
                                         F.rpad(joined, trail_n, " ")).alias("window"))


# W4 ------------------------------------------------------------------------
def word_window(sent: Column, position: Column, size: int, nonce=None, checked: bool = True) -> Column:
    """Odd-size window of ids centred at ``position`` (0-based), zero padded.

    With ``nonce`` the centre is replaced by that id.  A position outside the
    sentence raises an error (``raise_error``) when ``checked``.
    """
    if size % 2 != 1:
        raise ValueError("window size must be odd")
    h = size // 2
    zeros = F.array_repeat(F.lit(0), h)
    win = F.slice(F.concat(zeros, sent, zeros), position + 1, size)
    if nonce is not None:
        nonce_col = nonce if isinstance(nonce, Column) else F.lit(nonce)
        win = F.transform(win, lambda x, i: F.when(i == h, nonce_col).otherwise(x))
    if checked:
        bad = (position < 0) | (position >= F.size(sent))
        win = F.when(bad, F.raise_error(F.concat(
            F.lit("position "), position.cast("string"), F.lit(" outside sentence of length "),
            F.size(sent).cast("string")))).otherwise(win)
    return win


# W5 ------------------------------------------------------------------------
def renumber_unknown_sentence(x: Column, length: Column, n_vocab) -> Column:
    """0 -> n_vocab within the first length+2 ids (markers included);
    trailing padding zeros stay 0."""
    nv = n_vocab if isinstance(n_vocab, Column) else F.lit(n_vocab)
    return F.transform(x, lambda v, i: F.when((v == 0) & (i < length + 2), nv).otherwise(v))


# W6 ------------------------------------------------------------------------
def renumber_unknown_window(win: Column, window_position: Column, n_vocab, half: int = 2) -> Column:
    """0 -> n_vocab from index max(0, half - window_position) on."""
    nv = n_vocab if isinstance(n_vocab, Column) else F.lit(n_vocab)
    start = F.greatest(F.lit(0), F.lit(half) - window_position)
    return F.transform(win, lambda v, i: F.when((v == 0) & (i >= start), nv).otherwise(v))


# W7 ------------------------------------------------------------------------
def add_window(df: DataFrame, name: str, size: int, nonce=None, x_col: str = "X",
               len_col: str = "len", pos_col: str = "window_position") -> DataFrame:
    """Strip ``<s>``/``</s>`` and padding from the sentence and add a window."""
    body = F.slice(F.col(x_col), 2, F.col(len_col))
    return df.withColumn(name, word_window(body, F.col(pos_col), size, nonce))


# W8 ------------------------------------------------------------------------
def mask_scenarios(size: int = 5) -> list[list[int]]:
    """Every subset of the non-centre window indices (16 for size 5)."""
    centre = size // 2
    idx = [i for i in range(size) if i != centre]
    return [[idx[b] for b in range(len(idx)) if m >> b & 1] for m in range(1 << len(idx))]


def mask_positions(df: DataFrame, win_col: str, sent_col: str, pos_col: str, size: int = 5) -> DataFrame:
    """One row per (example, scenario): masked window indices set to 0 in the
    window and at the matching sentence offsets.  The scenario list is a fixed
    literal of 2^(size-1) masks exploded per row (a generator, not a join)."""
    centre = size // 2
    scen = mask_scenarios(size)
    lit = F.array(*[F.struct(F.lit(k).alias("scenario"),
                             F.array(*[F.lit(i) for i in m]).cast("array<int>").alias("mask"),
                             F.lit("".join("P" if j == centre else ("?" if j in m else "_")
                                           for j in range(size))).alias("pattern"))
                    for k, m in enumerate(scen)])
    ex = df.withColumn("_s", F.explode(lit))
    mask, win, pos = F.col("_s.mask"), F.col(win_col), F.col(pos_col)

    def places(values):
        """The window's places, masked ones 0: plain array expressions, no lambda per place."""
        return F.array(*[F.when(F.array_contains(mask, j), 0).otherwise(v) for j, v in enumerate(values)])

    masked_win = F.when(win.isNotNull(), F.concat(F.slice(places([F.get(win, F.lit(j)) for j in range(size)]), 1, F.size(win)),
                                                  F.slice(win, size + 1, F.size(win))))
    # only the places under the window change: the rest of the sentence is taken as it is
    first = F.greatest(pos - centre, F.lit(0))
    n_under = F.greatest(F.least(F.size(sent_col), pos + (size - centre)) - first, F.lit(0))
    under = F.slice(places([F.get(F.col(sent_col), pos + (j - centre)) for j in range(size)]),
                    F.greatest(F.lit(centre) - pos, F.lit(0)) + 1, n_under)
    masked_sent = F.concat(F.slice(sent_col, 1, first), under,
                           F.slice(sent_col, F.col(pos_col) + (size - centre) + 1, F.size(sent_col)))
    return (ex.withColumn("scenario", F.col("_s.scenario"))
            .withColumn("pattern", F.col("_s.pattern"))
            .withColumn(win_col, masked_win)
            .withColumn(sent_col, masked_sent)
            .drop("_s"))
