"""Tokens and vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import rng
from ..functions.text import BASE_CHARS, is_word, mark, token_array
from . import scale, sizing


# T1 ------------------------------------------------------------------------
def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, token)``: ordered lowercase tokens, one row per token.

    Narrow: each document row is split where it is read; no shuffle.  An outer explode: for
    a plain one the optimizer tests the array for emptiness first, which splits every text twice.
    """
    return docs.select(F.col(id_col), F.posexplode_outer(token_array(F.col(text_col))).alias("pos", "token")) \
        .filter(F.col("token").isNotNull())


# T2 ------------------------------------------------------------------------
def words(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    return tokens.filter(is_word(F.col(token_col)))


# T3 ------------------------------------------------------------------------
def term_freq(words_df: DataFrame, token_col: str = "token") -> DataFrame:
    """``(term, freq)``; partial aggregation happens before the shuffle."""
    return words_df.groupBy(F.col(token_col).alias("term")).agg(F.count(F.lit(1)).alias("freq"))


# T4 ------------------------------------------------------------------------
def prune_rare(freq: DataFrame, min_freq: int, strict: bool = False) -> DataFrame:
    """Drop infrequent terms.

    Compatibility default: a term survives with ``freq >= min_freq + 2`` (the
    reference's counting rule); ``strict=True`` gives ``freq >= min_freq``.
    """
    threshold = min_freq if strict else min_freq + 2
    return freq.filter(F.col("freq") >= threshold)


# T5 ------------------------------------------------------------------------
def top_terms(freq: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` most frequent terms; ``term_id`` = rank from 0.

    Ties in frequency are ordered by term.  The ordered limit runs as a
    TakeOrderedAndProject (per-partition top-k, then merge); the numbering
    window only sees the <= max_features survivors.
    """
    top = freq.orderBy(F.desc("freq"), F.asc("term")).limit(max_features)
    w = Window.orderBy(F.desc("freq"), F.asc("term"))
    return top.select("term", (F.row_number().over(w) - 1).cast("int").alias("term_id"), "freq")


def build_vocab(tokens: DataFrame, min_freq: int = 100, max_features: int = 1000,
                strict: bool = False) -> DataFrame:
    """T2 -> T3 -> T4 -> T5."""
    return top_terms(prune_rare(term_freq(words(tokens)), min_freq, strict), max_features)


# T6 ------------------------------------------------------------------------
def positions(tokens: DataFrame, vocab: DataFrame, max_features: int | None = None) -> DataFrame:
    """Positional index of kept terms: ``(doc_id, pos, term, term_id)``.

    The vocabulary is bounded by ``max_features``; it is broadcast behind that
    bound (or a count), so the token side is never shuffled.
    """
    v = sizing.broadcast_if_small(vocab.select("term", "term_id"), bound=max_features)
    return tokens.join(v, tokens["token"] == v["term"], "inner").drop("token")


# T7 ------------------------------------------------------------------------
def downsample_terms(pos_df: DataFrame, cap: int, seed: int = 17,
                     key_cols=("doc_id", "pos")) -> DataFrame:
    """At most ``cap`` occurrences per term, chosen by a keyed hash.

    Exact per-term cut by ``histogram_cut``: a term with a third of all
    occurrences is still ranked in many small windows.
    """
    h = rng.u32(seed, "downsample", F.col("term"), *[F.col(c) for c in key_cols])
    with_h = pos_df.withColumn("_h", h)
    return scale.histogram_cut(with_h, ["term"], "_h", cap, tie_cols=list(key_cols)).drop("_h")


# T8 ------------------------------------------------------------------------
def char_vocab(words_df: DataFrame, token_col: str = "token") -> DataFrame:
    """``(ch, char_id)``: base characters plus every character seen in words.

    Ids start at 1 in code-point order; id 0 is reserved for NONCE.
    The distinct character set is tiny; its numbering window is unpartitioned
    over those few rows only.
    """
    spark = words_df.sparkSession
    seen = words_df.select(F.explode(F.split(F.col(token_col), "")).alias("ch")).distinct()
    base = spark.createDataFrame([(c,) for c in BASE_CHARS], "ch string")
    chars = seen.union(base).distinct()
    return chars.select("ch", F.row_number().over(Window.orderBy("ch")).cast("int").alias("char_id"))


# T9 ------------------------------------------------------------------------
def invert_index(vocab: DataFrame, key: str = "term", value: str = "term_id") -> DataFrame:
    """id -> term view of a term -> id table (a column swap)."""
    return vocab.select(F.col(value).alias("id"), F.col(key).alias("value"))


# T10 -----------------------------------------------------------------------
def literal_map(pairs, value_type: str = "int"):
    """One constant ``map<string, value_type>`` expression.

    Built as ``from_json`` of a single string literal, which the optimizer
    folds into one map literal (a map of many ``lit`` columns would blow the
    generated code past the JVM method size limit).
    """
    import json

    return F.from_json(F.lit(json.dumps(dict(pairs))), f"map<string,{value_type}>")


def hashed_map(pairs, buckets: int = 4096):
    """``term column -> int column`` of a bounded table (null: not in it).  Spark scans a map
    from its start, so the literal is an array of small maps that a hash of the term picks."""
    import json

    table = sorted(dict(pairs).items())
    spark = SparkSession.getActiveSession()
    slot = F.pmod(F.xxhash64(F.col("term")), F.lit(buckets)).cast("int")
    slots = [r[0] for r in spark.createDataFrame(table, "term string, id int").select(slot).collect()] if table else []
    maps = [{} for _ in range(buckets)]
    for (term, i), at in zip(table, slots):
        maps[at][term] = i
    literal = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")

    def look_up(term):
        return F.element_at(F.get(literal, F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")), term)
    return look_up


def char_codes(chars: DataFrame) -> np.ndarray:
    """Code point -> character id (unknown ones: the id of the space).  The table has a row
    per code point at most, whatever the data."""
    ids = {ord(r["ch"]): r["char_id"] for r in chars.filter(F.length("ch") == 1).select("ch", "char_id").collect()}
    table = np.full(0x110000, ids[ord(" ")], np.int32)
    table[list(ids)] = list(ids.values())
    return table


def _digits(top: int) -> np.ndarray:
    """Row ``i``: the bytes of ``i`` in decimal behind zero bytes, and a comma."""
    width = len(str(top))
    texts = np.frombuffer("".join(str(i).rjust(width, "\0") + "," for i in range(top + 1)).encode(), np.uint8)
    return texts.reshape(top + 1, width + 1)


def _joined(codes: np.ndarray, rows: int, width: int, digits: np.ndarray) -> pa.Array:
    """``rows`` strings of ``width`` codes each, comma between codes."""
    if not rows or not width:
        return pa.array([""] * rows, pa.string())
    text = digits[codes].reshape(rows, width, digits.shape[1])
    text[:, -1, -1] = 0  # no comma behind the last
    seen = text != 0
    ends = np.zeros(rows + 1, np.int32)
    np.cumsum(np.count_nonzero(seen.reshape(rows, -1), axis=1), out=ends[1:])
    return pa.StringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(text[seen]))


def encode_columns(df: DataFrame, chars: DataFrame, what: dict[str, tuple[str, int]],
                   keep: Sequence[str] | None = None, joined: bool = False) -> DataFrame:
    """``df`` (its columns ``keep``, or all) with a fixed-width ``array<int>`` of character ids
    for each ``out: (column, width)``, or with ``joined`` the ids as a string, comma between;
    unknown characters and the padding take the id of the space, null strings count as empty.
    One Arrow step: all characters of a batch are looked up at once."""
    codes_of = char_codes(chars)
    digits = _digits(int(codes_of.max())) if joined else None
    table = df.sparkSession.sparkContext.broadcast(codes_of)  # 4 MB
    pads = {out: f"_pad_{i}" for i, out in enumerate(what)}
    held = list(keep) if keep is not None else df.columns
    kind = StringType() if joined else ArrayType(IntegerType())
    schema = StructType(df.select(*held).schema.fields + [StructField(out, kind) for out in what])
    widths = [w for _, w in what.values()]

    def step(batches):
        for b in batches:
            kept, texts = b.columns[:-len(widths)], b.columns[-len(widths):]
            codes = []
            for col, width in zip(texts, widths):
                points = np.frombuffer("".join(col.to_pylist()).encode("utf-32-le"), "<u4")
                if joined:
                    codes.append(_joined(table.value[points], b.num_rows, width, digits))
                    continue
                ends = np.arange(0, (b.num_rows + 1) * width, width, dtype=np.int32)[:b.num_rows + 1]
                codes.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(table.value[points])))
            yield pa.RecordBatch.from_arrays([*kept, *codes], schema.names)

    padded = df.select(*held, *[F.rpad(F.coalesce(F.col(c), F.lit("")), w, " ").alias(pads[out]) for out, (c, w) in what.items()])
    return padded.mapInArrow(step, schema)


def encode_chars(df: DataFrame, col: str, out: str, width: int, chars: DataFrame) -> DataFrame:
    """String -> fixed-width ``array<int>`` of character ids."""
    return encode_columns(df, chars, {out: (col, width)})


# T11 -----------------------------------------------------------------------
def mark_words(df: DataFrame, col: str = "term", out: str = "marked") -> DataFrame:
    return df.withColumn(out, mark(F.col(col)))


# T12 -----------------------------------------------------------------------
def recover_char_index(df: DataFrame, word_col: str, codes_col: str) -> DataFrame:
    """Rebuild char -> id from marked words and their code rows.

    Characters are aligned with codes by position until the first 0 code.
    Returns ``(ch, char_id, n_ids)``; ``n_ids > 1`` reports a conflict.
    """
    chars = df.select(
        F.col(word_col).alias("_w"),
        F.col(codes_col).alias("_codes"),
        F.posexplode(F.split(F.col(word_col), "")).alias("_i", "ch"))
    stop = F.array_position(F.col("_codes"), 0)
    aligned = chars.filter((stop == 0) | (F.col("_i") < stop - 1)) \
                   .filter(F.col("_i") < F.size("_codes")) \
                   .withColumn("code", F.element_at("_codes", F.col("_i") + 1))
    return aligned.groupBy("ch").agg(F.min("code").alias("char_id"),
                                     F.count_distinct("code").alias("n_ids"))


def id_map(vocab: DataFrame, limit: int, key: str = "term", value: str = "term_id"):
    """Literal ``map<term, id>`` of a vocabulary bounded by ``limit`` rows.

    The bound is a parameter (``max_features``); a larger table raises instead
    of being collected.
    """
    rows = vocab.select(key, value).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"vocabulary larger than {limit} rows; join it instead")
    return literal_map((r[0], int(r[1])) for r in rows)


# T13 -----------------------------------------------------------------------
def unknown_count(sent, length):
    """Number of 0 ids within the first ``length`` ids (Column expression)."""
    return F.size(F.filter(F.slice(sent, 1, length), lambda x: x == 0))


def unknown_tokens(tokens: DataFrame, vocab: DataFrame, max_features: int | None = None,
                   id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_unknown)``: tokens outside the vocabulary, for documents with any token.
    The vocabulary is joined (broadcast behind its bound); counts are partial first."""
    v = sizing.broadcast_if_small(vocab.select(F.col("term").alias("_t"), F.lit(0).alias("_known")), bound=max_features)
    return tokens.join(v, F.col("token") == F.col("_t"), "left") \
        .groupBy(id_col).agg(F.sum(F.coalesce("_known", F.lit(1))).cast("int").alias("n_unknown"))


# T14 -----------------------------------------------------------------------
def novel_words(candidates: DataFrame, vocab: DataFrame, min_len: int = 5, max_len: int = 10,
                k: int | None = None, col: str = "term") -> DataFrame:
    """Distinct candidate words of length min..max that are not in ``vocab``."""
    c = candidates.select(F.col(col).alias("term")).distinct() \
        .filter(F.length("term").between(min_len, max_len))
    out = c.join(vocab.select("term"), "term", "left_anti")
    if k is not None:
        out = out.orderBy("term").limit(k)
    return out


# T15 -----------------------------------------------------------------------
def ngram_counts(words_df: DataFrame, order: int, col: str = "term") -> DataFrame:
    """Character n-gram counts of marked words: ``(ngram, n)`` for n = order."""
    return all_ngram_counts(words_df, (order,), col).select("ngram", "n")


def all_ngram_counts(words_df: DataFrame, orders=(1, 2, 3), col: str = "term") -> DataFrame:
    """``(gram_order, ngram, n)`` for several orders in one pass.

    Words are marked ``^word$`` so that starts and ends are modelled; each distinct word
    is cut once and counts with its frequency.
    """
    m = F.col("_m")

    def grams(o: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length(m) - o + 1, F.lit(1)))
        cut = F.transform(starts, lambda i: F.struct(F.lit(o).alias("gram_order"), F.substring(m, i, o).alias("ngram")))
        return F.filter(cut, lambda g: F.length(g["ngram"]) == o)

    return words_df.groupBy(mark(F.col(col)).alias("_m")).agg(F.count(F.lit(1)).alias("_n")) \
        .select("_n", F.explode(F.concat(*[grams(o) for o in orders])).alias("g")) \
        .groupBy("g.gram_order", "g.ngram").agg(F.sum("_n").alias("n"))


def sampler(counts: DataFrame, least: int = 1) -> dict[str, tuple[np.ndarray, list[str]]]:
    """The generator's table from ``all_ngram_counts``: for each context of up to two
    characters that was seen ``least`` times or more, the running sums of its successors'
    counts and the successors, in code-point order.

    A context holds at most the alphabet, and there are at most (alphabet + 1) squared
    contexts: a property of the script, not of the amount of text.
    """
    rows = counts.select(F.expr("substring(ngram, 1, gram_order - 1)").alias("context"),
                         F.expr("substring(ngram, gram_order, 1)").alias("ch"), "n").filter(F.col("ch") != "^")
    held = rows.groupBy("context").agg(F.sort_array(F.collect_list(F.struct("ch", "n"))).alias("next"),
                                       F.sum("n").alias("total")).filter(F.col("total") >= least)
    return {r["context"]: (np.cumsum([x["n"] for x in r["next"]]), [x["ch"] for x in r["next"]]) for r in held.collect()}


def draw_word(key: str, table: dict, seed: int, max_len: int) -> str:
    """A word drawn from the sampler: each character after the longest known context (two
    characters, one, none), by the hash of key and step; it ends at ``$`` or ``max_len``."""
    word = "^"
    for step in range(max_len):
        ends, successors = next(table[c] for c in (word[-2:], word[-1:], "") if c in table)
        u = int(hashlib.md5(f"{seed}|ngram|{key}|{step}".encode()).hexdigest()[:8], 16) % int(ends[-1])
        ch = successors[int(np.searchsorted(ends, u, "right"))]
        if ch == "$":
            break
        word += ch
    return word[1:]


def generate_words(keys: DataFrame, counts: DataFrame, seed: int = 17, max_len: int = 12, least: int = 1,
                   key_col: str = "term", out: str = "word") -> DataFrame:
    """A word for each key, drawn from the model ``counts`` (``all_ngram_counts``): rows of
    ``keys`` are independent, the sampler goes to the tasks as one bounded table."""
    shared = keys.sparkSession.sparkContext.broadcast(sampler(counts, least))
    schema = StructType([keys.schema[key_col], StructField(out, StringType())])

    def step(batches):
        for b in batches:
            words = [draw_word(str(k), shared.value, seed, max_len) if shared.value else "" for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string())], [key_col, out])

    return keys.select(key_col).mapInArrow(step, schema)
