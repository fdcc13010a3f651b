"""Registered queries for tokens and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import u32
from ..functions.text import BASE_CHARS, TOKEN_RX, WORD_RX, mark, token_array, u32_sql
from ..operators import text as T
from .catalog import register
from .fixtures import P, register_fixture_sql, sql_lit, with_fixtures

MAX_WORD = 12      # T15: characters of a generated word at most
LEAST_SEEN = 20    # T15: a context of the model was seen so often, else the shorter one counts


def _sql_str_list(chars: str) -> str:
    return "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in chars) + "]"


register_fixture_sql("char_vocab", ("words",), f"""
    SELECT ch, CAST(row_number() OVER (ORDER BY ch) AS INT) AS char_id FROM (
      SELECT DISTINCT unnest(string_split(token, '')) AS ch FROM words
      UNION SELECT unnest({_sql_str_list(BASE_CHARS)}) AS ch)""")

register_fixture_sql("positions", ("tokens", "vocab"), """
    SELECT t.doc_id, t.pos, v.term, v.term_id FROM tokens t JOIN vocab v ON t.token = v.term""")


@register("T1_tokenize", with_fixtures("SELECT doc_id, pos, token FROM tokens", "tokens"))
def t1(fx):
    return fx.tokens()


@register("T2_words", with_fixtures("SELECT doc_id, pos, token FROM words", "words"))
def t2(fx):
    return fx.words()


@register("T3_term_freq", with_fixtures("SELECT term, freq FROM freq", "freq"))
def t3(fx):
    return T.term_freq(fx.words())


@register("T4_prune_rare", with_fixtures(
    f"SELECT term, freq FROM freq WHERE freq >= {P.min_freq + 2}", "freq"))
def t4(fx):
    return T.prune_rare(T.term_freq(fx.words()), P.min_freq)


@register("T5_top_terms", with_fixtures("SELECT term, term_id, freq FROM vocab", "vocab"))
def t5(fx):
    return T.top_terms(T.prune_rare(T.term_freq(fx.words()), P.min_freq), P.max_features)


@register("T6_positions", with_fixtures("SELECT * FROM positions", "positions"))
def t6(fx):
    return T.positions(fx.tokens(), fx.vocab(), P.max_features)


@register("T7_downsample_terms", with_fixtures(f"""
    SELECT doc_id, pos, term, term_id FROM (
      SELECT *, row_number() OVER (PARTITION BY term
                 ORDER BY {u32_sql('duck', P.seed, 'downsample', 'term', 'doc_id', 'pos')}, doc_id, pos) AS rn
      FROM positions) WHERE rn <= {P.downsample_cap}""", "positions"))
def t7(fx):
    pos = T.positions(fx.tokens(), fx.vocab(), P.max_features)
    return T.downsample_terms(pos, P.downsample_cap, P.seed)


@register("T8_char_vocab", with_fixtures("SELECT ch, char_id FROM char_vocab", "char_vocab"))
def t8(fx):
    return T.char_vocab(fx.words())


@register("T9_invert_index", with_fixtures("SELECT term_id AS id, term AS value FROM vocab", "vocab"))
def t9(fx):
    return T.invert_index(fx.vocab())


@register("T10_encode_chars", with_fixtures("""
    SELECT term, string_agg(CAST(coalesce(c.char_id, sp.char_id) AS VARCHAR), ',' ORDER BY i) AS codes
    FROM (SELECT term, unnest(string_split(rpad(term, w, ' '), '')) AS ch, unnest(range(w)) AS i
          FROM vocab, (SELECT CAST(greatest(15, max(length(term))) AS INT) AS w FROM vocab)) x
    LEFT JOIN char_vocab c ON x.ch = c.ch
    CROSS JOIN (SELECT char_id FROM char_vocab WHERE ch = ' ') sp
    GROUP BY term""", "vocab", "char_vocab"))
def t10(fx):
    chars = T.char_vocab(fx.words())
    vocab = fx.vocab().select("term")
    longest = vocab.agg(F.max(F.length("term"))).first()[0] or 0  # no term is cut
    coded = T.encode_chars(vocab, "term", "codes", max(P.max_token_length, longest), chars)
    return coded.select("term", F.array_join("codes", ",").alias("codes"))


@register("T11_mark", with_fixtures("SELECT term, '^' || term || '$' AS marked FROM vocab", "vocab"))
def t11(fx):
    return T.mark_words(fx.vocab().select("term"))


@register("T12_recover_char_index", with_fixtures("""
    SELECT x.ch, min(c.char_id) AS char_id, count(DISTINCT c.char_id) AS n_ids
    FROM (SELECT unnest(string_split('^' || term || '$', '')) AS ch FROM vocab) x
    JOIN char_vocab c ON x.ch = c.ch GROUP BY x.ch""", "vocab", "char_vocab"))
def t12(fx):
    marked = fx.vocab().select(mark(F.col("term")).alias("marked"))
    longest = marked.agg(F.max(F.length("marked"))).first()[0] or 1
    coded = T.encode_chars(marked, "marked", "codes", longest, T.char_vocab(fx.words()))
    return T.recover_char_index(coded, "marked", "codes")


@register("T13_unknown_count", with_fixtures("""
    SELECT d.doc_id, CAST(coalesce(u.n_unknown, 0) AS INT) AS n_unknown
    FROM documents d LEFT JOIN (
      SELECT t.doc_id, count(*) AS n_unknown FROM tokens t LEFT JOIN vocab v ON t.token = v.term
      WHERE v.term IS NULL GROUP BY t.doc_id) u ON d.doc_id = u.doc_id""",
    "tokens", "vocab"))
def t13(fx):
    counts = T.unknown_tokens(fx.tokens(), fx.vocab(), P.max_features)
    return fx.t("documents").select("doc_id").join(counts, "doc_id", "left").fillna(0, ["n_unknown"])


@register("T14_novel_words", with_fixtures("""
    SELECT DISTINCT b.token AS term FROM (
      SELECT unnest(regexp_extract_all(lower(text), """ + sql_lit(TOKEN_RX) + """, 0)) AS token FROM benchmark) b
    WHERE regexp_matches(b.token, """ + sql_lit(WORD_RX) + """) AND length(b.token) BETWEEN 5 AND 10
      AND b.token NOT IN (SELECT term FROM vocab)""", "vocab"))
def t14(fx):
    bench = T.words(T.tokenize(fx.t("benchmark").select(F.col("item_id").alias("doc_id"), "text")))
    return T.novel_words(bench.select(F.col("token").alias("term")), fx.vocab())


@register("T15_ngram_counts", with_fixtures("""
    SELECT o AS gram_order, substr(m, i, o) AS ngram, count(*) AS n FROM (
      SELECT m, o, unnest(range(1, length(m) - o + 2)) AS i FROM (
        SELECT '^' || token || '$' AS m FROM words) w, (SELECT unnest([1, 2, 3]) AS o) r) g
    GROUP BY o, substr(m, i, o)""", "words"))
def t15(fx):
    return ngrams(fx)


def ngrams(fx):
    return fx._get("ngrams", lambda: T.all_ngram_counts(fx.words().select(F.col("token").alias("term"))))


register_fixture_sql("ngrams", ("words",), """
    SELECT o AS gram_order, substr(m, i, o) AS ngram, count(*) AS n FROM (
      SELECT m, o, unnest(range(1, length(m) - o + 2)) AS i FROM (
        SELECT '^' || token || '$' AS m FROM words) w, (SELECT unnest([1, 2, 3]) AS o) r) g
    GROUP BY o, substr(m, i, o)""")
register_fixture_sql("sampler", ("ngrams",), f"""
    SELECT context, ch, n, total, sum(n) OVER (PARTITION BY context ORDER BY ch) AS upto FROM (
      SELECT substr(ngram, 1, gram_order - 1) AS context, substr(ngram, gram_order, 1) AS ch, n,
             sum(n) OVER (PARTITION BY substr(ngram, 1, gram_order - 1)) AS total
      FROM ngrams WHERE substr(ngram, gram_order, 1) <> '^') WHERE total >= {LEAST_SEEN}""")
register_fixture_sql("kept", ("freq",), f"SELECT term, freq FROM freq WHERE freq >= {P.min_freq + 2}")
# A word grows by a character a step, after the longest context that the model knows.
register_fixture_sql("generated", ("sampler", "kept"), f"""
    WITH RECURSIVE contexts AS MATERIALIZED (SELECT DISTINCT context, total FROM sampler),
    steps AS MATERIALIZED (SELECT * FROM sampler),
    grown(term, word, step, done) AS (
      SELECT term, '^', 0, false FROM kept
      UNION ALL
      SELECT g.term, CASE WHEN s.ch = '$' THEN g.word ELSE g.word || s.ch END, g.step + 1,
             s.ch = '$' OR g.step + 1 = {MAX_WORD}
      FROM (SELECT x.*, coalesce(c2.context, c1.context, '') AS context,
                   coalesce(c2.total, c1.total, (SELECT total FROM contexts WHERE context = '')) AS total
            FROM grown x LEFT JOIN contexts c2 ON c2.context = right(x.word, 2)
                         LEFT JOIN contexts c1 ON c1.context = right(x.word, 1)
            WHERE NOT x.done) g
      JOIN steps s ON s.context = g.context
       AND {u32_sql('duck', P.seed, 'ngram', 'g.term', 'g.step')} % CAST(g.total AS BIGINT) >= s.upto - s.n
       AND {u32_sql('duck', P.seed, 'ngram', 'g.term', 'g.step')} % CAST(g.total AS BIGINT) < s.upto)
    SELECT term, substr(word, 2) AS word FROM grown WHERE done""")


def generated(fx):
    keys = T.prune_rare(T.term_freq(fx.words()), P.min_freq)
    return T.generate_words(keys, ngrams(fx), P.seed, MAX_WORD, LEAST_SEEN)


@register("T15_generate_words", with_fixtures("SELECT term, word FROM generated", "generated"))
def t15_words(fx):
    """A word drawn from the n-gram model for every word of the corpus that is not rare."""
    return generated(fx)


@register("T14_novel_generated", with_fixtures("""
    SELECT DISTINCT word AS term FROM generated WHERE length(word) BETWEEN 5 AND 10
      AND word NOT IN (SELECT term FROM vocab) ORDER BY term LIMIT 100""", "generated", "vocab"))
def t14_generated(fx):
    """The first 100 generated words of 5 to 10 characters that the vocabulary lacks."""
    return T.novel_words(generated(fx), fx.vocab(), 5, 10, 100, "word")
