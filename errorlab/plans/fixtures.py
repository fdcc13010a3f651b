"""Fixtures derived from the driver tables, in Spark and as DuckDB SQL.

Each fixture is defined twice: a Spark builder (the real operator chain) and an
SQL body for the DuckDB oracle.  ``with_fixtures(sql, names)`` prepends the
needed fixtures as a WITH clause (dependencies first).

Fixed parameters of the registered queries live in ``P``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import TOKEN_RX, WORD_RX, token_array
from ..operators import sizing
from ..operators import text as T
from ..session import cut_lineage, kept, spread, table


@dataclass(frozen=True)
class Params:
    seed: int = 17
    min_freq: int = 3              # compat rule: freq >= min_freq + 2
    max_features: int = 1000
    lead: int = 10
    trail: int = 10
    max_token_length: int = 15
    downsample_cap: int = 20
    copies: int = 2


P = Params()

# The confusable words of the preposition task, in class order.
CONFUSABLES = ("of", "to", "in", "for", "on", "with", "by", "at", "from")
SENT_FACTOR = 100_000     # sent_id = doc_id * SENT_FACTOR + line
PAIR_FACTOR = 100_000     # pair_id = sent_id * PAIR_FACTOR + position

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


class Fx:
    """Lazy fixture builder bound to (spark, sf_dir); DataFrames are cached per
    instance only as plans (no actions)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._memo: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _get(self, key, fn):
        if key not in self._memo:
            self._memo[key] = fn()
        return self._memo[key]

    def docs(self) -> DataFrame:
        """``(doc_id, text)`` of all documents, over all cores."""
        return self._get("docs", lambda: spread(self.t("documents").select("doc_id", "text")))

    def tokens(self) -> DataFrame:
        return self._get("tokens", lambda: T.tokenize(self.docs()))

    def words(self) -> DataFrame:
        return self._get("words", lambda: T.words(self.tokens()))

    def freq(self) -> DataFrame:
        """Words and their counts, counted once: vocabulary, dictionary and characters come from them."""
        return self._get("freq", lambda: kept(T.term_freq(self.words())))

    def vocab(self) -> DataFrame:
        return self._get("vocab", lambda: T.top_terms(T.prune_rare(self.freq(), P.min_freq), P.max_features))

    def vocab_ids(self):
        """Literal term -> id+1 map (0 stays "unknown"); bounded by max_features."""
        return self._get("vocab_ids", lambda: T.id_map(
            self.vocab().select("term", (F.col("term_id") + 1).alias("term_id")), P.max_features))

    def sents(self) -> DataFrame:
        """Lines of all documents as id sequences: ``(sent_id, lang, toks, sent, len)``.

        Each line is coded where it is read, by a literal lookup of the (bounded)
        vocabulary.  Only lines that share their key with another document's (repeated or
        null ``doc_id``, or documents of more than ``SENT_FACTOR`` lines) are regrouped by it.
        """
        def build():
            ids = T.hashed_map(((r[0], int(r[1]) + 1) for r in self.vocab().select("term", "term_id").collect()))
            docs = self.t("documents").select("doc_id", "lang", "text")
            more = F.floor((F.size(F.split("text", "\n")) - 1) / SENT_FACTOR)
            shared = cut_lineage(
                docs.filter(F.col("text").isNotNull())
                .select("lang", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), more)).alias("_more"))
                .groupBy("lang", (F.col("doc_id") + F.col("_more")).alias("_block")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
                .select(F.col("lang").alias("_lang"), F.col("_block").alias("_shared")))
            lines = spread(docs).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "l")) \
                .withColumn("sent_id", F.col("doc_id") * SENT_FACTOR + F.col("line"))

            def coded(df):
                # an outer explode: the tokens are not computed again for the filter
                return df.select("sent_id", "lang", F.explode_outer(F.array(token_array(F.col("l")))).alias("toks")) \
                    .filter(F.size("toks") > 0) \
                    .select("sent_id", "lang", "toks", F.transform("toks", lambda t: F.coalesce(ids(t), F.lit(0))).alias("sent"),
                            F.size("toks").alias("len"))

            if shared.isEmpty():
                return coded(lines)
            same = F.floor(F.col("sent_id") / SENT_FACTOR).eqNullSafe(F.col("_shared")) & F.col("lang").eqNullSafe(F.col("_lang"))
            keys = sizing.broadcast_if_small(shared)
            grouped = coded(lines.join(keys, same, "left_semi")) \
                .select("sent_id", "lang", F.posexplode(F.arrays_zip("toks", "sent")).alias("i", "c")) \
                .groupBy("sent_id", "lang").agg(F.sort_array(F.collect_list(F.struct("i", "c.toks", "c.sent"))).alias("_c")) \
                .select("sent_id", "lang", F.col("_c.toks").alias("toks"), F.col("_c.sent").alias("sent"), F.size("_c").alias("len"))
            return coded(lines.join(keys, same, "left_anti")).unionByName(grouped)
        return self._get("sents", build)

    def pairs(self) -> DataFrame:
        """Each confusable occurrence in English (is_error false) and a copy whose word is
        replaced by a different confusable picked by hash (is_error true)."""
        def build():
            # ids of the nine confusable words only (a 9-entry literal map)
            rows = self.vocab().filter(F.col("term").isin(*CONFUSABLES)).select("term", "term_id").collect()
            ids = T.literal_map((r[0], int(r[1]) + 1) for r in rows)
            conf = F.array(*[F.lit(c) for c in CONFUSABLES])
            occ = (self.sents().filter(F.col("lang") == "en")
                   .select("sent_id", "sent", "len", F.posexplode("toks").alias("position", "original"))
                   .filter(F.col("original").isin(*CONFUSABLES)))
            pid = F.col("sent_id") * PAIR_FACTOR + F.col("position")
            other = F.element_at(F.array_except(conf, F.array(F.col("original"))),
                                 (rng.pick(len(CONFUSABLES) - 1, P.seed, "swap", pid) + 1).cast("int"))
            two = occ.withColumn("pair_id", pid).withColumn("is_error", F.explode(F.array(F.lit(False), F.lit(True))))
            cur = F.when(F.col("is_error"), other).otherwise(F.col("original"))
            code = F.coalesce(F.element_at(ids, F.col("current")), F.lit(0))
            out = (two.withColumn("current", cur)
                   .withColumn("original_code", (F.array_position(conf, F.col("original")) - 1).cast("int"))
                   .withColumn("current_code", (F.array_position(conf, F.col("current")) - 1).cast("int"))
                   .withColumn("sent", F.concat(F.slice("sent", 1, F.col("position")), F.array(code),
                                                F.slice("sent", F.col("position") + 2, F.col("len")))))
            return out.select("pair_id", "is_error", "sent_id", "position", "original", "current",
                              "original_code", "current_code", "sent", "len")
        return self._get("pairs", build)


# ---------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------

def sql_lit(s: str) -> str:
    """Quote a Python string as an SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


FIX_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "tokens": ((), f"""
        SELECT doc_id, CAST(pos AS INT) AS pos, token FROM (
          SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos
          FROM (SELECT doc_id, regexp_extract_all(lower(text), {sql_lit(TOKEN_RX)}, 0) AS t FROM documents))"""),
    "words": (("tokens",), f"SELECT * FROM tokens WHERE regexp_matches(token, {sql_lit(WORD_RX)})"),
    "freq": (("words",), "SELECT token AS term, count(*) AS freq FROM words GROUP BY token"),
    "vocab": (("freq",), f"""
        SELECT term, CAST(row_number() OVER (ORDER BY freq DESC, term) - 1 AS INT) AS term_id, freq
        FROM freq WHERE freq >= {P.min_freq + 2}
        ORDER BY freq DESC, term LIMIT {P.max_features}"""),
}


_CONF_SQL = "[" + ", ".join(f"'{c}'" for c in CONFUSABLES) + "]"

FIX_SQL.update({
    "vocab_ids": (("vocab",), "SELECT term, term_id + 1 AS id FROM vocab"),
    "sents": ((), f"""
        SELECT sent_id, lang, toks FROM (
          SELECT doc_id * {SENT_FACTOR} + line AS sent_id, lang, regexp_extract_all(lower(l), {sql_lit(TOKEN_RX)}, 0) AS toks
          FROM (SELECT doc_id, lang, unnest(ls) AS l, CAST(unnest(range(len(ls))) AS BIGINT) AS line
                FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)))
        WHERE len(toks) > 0"""),
    "sent_tok": (("sents",), "SELECT sent_id, lang, unnest(toks) AS tok, CAST(unnest(range(len(toks))) AS INT) AS i FROM sents"),
    "sent_ids": (("sent_tok", "vocab_ids"), """
        SELECT s.sent_id, list(coalesce(v.id, 0) ORDER BY s.i) AS sent, CAST(count(*) AS INT) AS len
        FROM sent_tok s LEFT JOIN vocab_ids v ON s.tok = v.term GROUP BY s.sent_id"""),
    "pairs": (("sent_tok", "sent_ids", "vocab_ids"), f"""
        SELECT o.pair_id, e.is_error, o.sent_id, o.position, o.original, c.current,
               CAST(list_position({_CONF_SQL}, o.original) - 1 AS INT) AS original_code,
               CAST(list_position({_CONF_SQL}, c.current) - 1 AS INT) AS current_code,
               list_transform(si.sent, lambda x, i: CASE WHEN i - 1 = o.position THEN coalesce(vi.id, 0) ELSE x END) AS sent,
               si.len
        FROM (SELECT sent_id, i AS position, tok AS original, sent_id * {PAIR_FACTOR} + i AS pair_id
              FROM sent_tok WHERE lang = 'en' AND tok IN {tuple(CONFUSABLES)}) o
        CROSS JOIN (SELECT unnest([false, true]) AS is_error) e
        CROSS JOIN LATERAL (SELECT CASE WHEN e.is_error THEN
             list_filter({_CONF_SQL}, lambda x: x <> o.original)[
               CAST({rng.u32_sql(P.seed, 'swap', 'o.pair_id')} % {len(CONFUSABLES) - 1} AS INT) + 1]
             ELSE o.original END AS current) c
        JOIN sent_ids si ON si.sent_id = o.sent_id
        LEFT JOIN vocab_ids vi ON vi.term = c.current"""),
})


def register_fixture_sql(name: str, deps: tuple[str, ...], body: str) -> None:
    FIX_SQL[name] = (deps, body)


def with_fixtures(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in FIX_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIX_SQL[n][1]})" for n in order)
    return f"WITH {ctes}\n{sql}"
