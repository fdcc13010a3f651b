"""Readers and writers.

Parquet is the default format; CSV/TSV/JSON/text readers take explicit
schemas.  Writers partition by column so later reads prune partitions.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import token_array
from ..session import checkpoint_dir


# S1 ------------------------------------------------------------------------
def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, newlines replaced by spaces: ``(path, text)``."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.regexp_replace("value", "\n", " ").alias("text"))


def corpus_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """S1 on a table with a text column."""
    return docs.withColumn(text_col, F.regexp_replace(text_col, "\n", " "))


# S2 ------------------------------------------------------------------------
def bulk_tokenize(spark: SparkSession, path: str, out: str) -> None:
    """Tokenise many sentence files, a line at a time (no file is held whole); one output
    partition per input file, a row per token with its place in the line.

    Rows arrive file by file, so each task keeps writers open instead of sorting all its
    tokens by their file's name (with more files than writers, Spark sorts the rest)."""
    tokens = spark.read.option("recursiveFileLookup", "true").text(path) \
        .select(F.col("_metadata.file_path").alias("source_file"), F.posexplode_outer(token_array(F.col("value"))).alias("pos", "token")) \
        .filter(F.col("token").isNotNull())
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "32")
    try:
        tokens.write.mode("overwrite").partitionBy("source_file").parquet(out)
    finally:
        spark.conf.set(writers, before)


def _int_array(df: DataFrame, c: str):
    if df.schema[c].dataType.typeName() == "array":
        return F.col(c).cast("array<int>")
    return F.array(F.col(c).cast("int"))


# S3 ------------------------------------------------------------------------
def load_features(df: DataFrame, data_names: Sequence[str], target: str, n: int | None = None,
                  order: str | None = None) -> DataFrame:
    """Chosen columns as one int feature array plus the target; first n rows
    in an explicit order (a positional prefix needs an order)."""
    parts = [_int_array(df, c) for c in data_names]
    out = df.select(F.concat(*parts).alias("features"), F.col(target).cast("int").alias("target"),
                    *([order] if order and order not in (target,) else []))
    if n is not None:
        if order is None:
            raise ValueError("a row limit needs an explicit order")
        out = out.orderBy(order).limit(n)
    return out


# S4 ------------------------------------------------------------------------
def load_all(df: DataFrame, data_names: Sequence[str], target: str, n_classes: int) -> DataFrame:
    """S3 plus a one-hot target and every other column; clashing names get a
    leading underscore."""
    from ..operators.decide import one_hot

    rest = [c for c in df.columns if c not in data_names]
    taken = {"features", "target_one_hot"}
    cols = [F.col(c).alias(("_" + c) if c in taken else c) for c in rest]
    return df.select(F.concat(*[_int_array(df, c) for c in data_names]).alias("features"),
                     one_hot(F.col(target), n_classes).alias("target_one_hot"), *cols)


# S5 ------------------------------------------------------------------------
def check_table(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """One aggregate: non-null count per column against the row count, and
    the class count max(target) + 1."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.count(F.col(c)).alias(f"n_{c}") for c in cols]
    if target:
        aggs.append((F.max(target) + 1).alias("n_classes"))
    return df.agg(*aggs)


# S6 ------------------------------------------------------------------------
def split_files(df: DataFrame, key: str, rows_per_file: int, out: str) -> None:
    """Consecutive shards of ``rows_per_file`` rows in key order, written to
    ``shard=00000`` style folders."""
    from ..operators import scale

    idx = scale.dense_index_by_range(df, key, name="_idx")
    shard = F.format_string("%05d", F.floor(F.col("_idx") / rows_per_file))  # wider from 100000 on
    idx.withColumn("shard", shard).drop("_idx").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(out)


# S7 ------------------------------------------------------------------------
def select_like(df: DataFrame, what: dict[str, str]) -> DataFrame:
    """Project columns by name or by regular expression (regex matches are
    gathered into one int array column)."""
    cols = []
    for name, pattern in what.items():
        if name in df.columns:
            cols.append(F.col(name).cast("long").alias(name))
        else:
            matched = [c for c in df.columns if re.fullmatch(pattern, c)]
            if not matched:
                continue
            cols.append(F.array(*[F.col(c).cast("int") for c in matched]).alias(name))
    return df.select(*cols)


def write_examples(df: DataFrame, path: str, what: dict[str, str], partition_by: str | None = None) -> None:
    w = select_like(df, what).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


# S8 / S9 / S10 -------------------------------------------------------------
def save_vocab(vocab: DataFrame, chars: DataFrame, prefix: str) -> None:
    vocab.select(F.col("term_id").alias("id"), F.col("term").alias("value")).write.mode("overwrite") \
        .parquet(prefix + "vocab")
    chars.select(F.col("char_id").alias("id"), F.col("ch").alias("value")).write.mode("overwrite") \
        .parquet(prefix + "chars")


def save_targets(vocab: DataFrame, path: str, target: str = "y") -> None:
    """Names ordered by id, all weights 1, as one JSON record per target (the
    class list is bounded by the vocabulary limit)."""
    names = vocab.agg(F.sort_array(F.collect_list(F.struct("term_id", "term"))).alias("_n"))
    rec = names.select(F.lit(target).alias("target"),
                       F.transform("_n", lambda s: s["term"]).alias("names"),
                       F.map_from_arrays(F.transform("_n", lambda s: s["term_id"].cast("string")),
                                         F.transform("_n", lambda s: F.lit(1.0))).alias("weights"))
    rec.coalesce(1).write.mode("overwrite").json(path)


def load_targets(spark: SparkSession, path: str, target: str = "y") -> DataFrame:
    """``(target, class_id, name, weight)``; a missing target raises."""
    raw = spark.read.schema("target string, names array<string>, weights map<string,double>").json(path)
    rows = raw.filter(F.col("target") == target)
    if rows.limit(1).count() == 0:
        raise KeyError(f"target {target!r} not in {path}")
    ex = rows.select("target", F.posexplode("names").alias("class_id", "name"), "weights")
    return ex.select("target", F.col("class_id").cast("int"), "name",
                     F.coalesce(F.element_at("weights", F.col("class_id").cast("string")), F.lit(1.0)).alias("weight"))


# S11 -----------------------------------------------------------------------
def save_scores(scores: DataFrame, path: str, partition_col: str = "split") -> None:
    """Write predictions; only the partitions that ``scores`` holds are overwritten."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(partition_col).parquet(path)


def replace_scores(spark: SparkSession, path: str, scores: DataFrame, key: str, partition_col: str = "split") -> None:
    """Replace ``prob`` and ``pred`` of the stored rows that ``scores`` (``key, prob, pred``)
    names; their other columns, and all other rows, stay.

    Partitions without such a row are not read past their keys and not written.  The
    others are merged into a staging folder first and then swapped in by the dynamic
    overwrite: a job that fails before leaves the stored files as they were.
    """
    stored = spark.read.parquet(path)
    new = scores.select(key, F.col("prob").alias("_prob"), F.col("pred").alias("_pred"), F.lit(True).alias("_new"))
    touched = [r[0] for r in stored.select(key, partition_col).join(new.select(key), key, "left_semi")
               .select(partition_col).distinct().collect()]  # a value per folder
    if not touched:
        return
    merged = stored.filter(F.col(partition_col).isin(touched)).join(new, key, "left")
    for old, fresh in (("prob", "_prob"), ("pred", "_pred")):
        merged = merged.withColumn(old, F.when(F.col("_new"), F.col(fresh)).otherwise(F.col(old)))
    staging = os.path.join(checkpoint_dir(spark), "staging", uuid.uuid4().hex)
    merged.select(*stored.columns).write.parquet(staging)
    save_scores(spark.read.schema(stored.schema).parquet(staging), path, partition_col)


# S12 -----------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def score(model: PipelineModel, data: DataFrame) -> DataFrame:
    """``data`` with ``prob`` (array) and ``pred``; the model's own columns are dropped."""
    scored = model.transform(data)
    return scored.withColumn("prob", vector_to_array("probability")).withColumn("pred", F.col("prediction").cast("int")) \
        .select(*data.columns, "prob", "pred")


def score_file(spark: SparkSession, model_path: str, data_path: str, out: str) -> DataFrame:
    """Load a saved pipeline, score a whole Parquet table and save the predictions with
    the configuration that made them (``out/predictions``, ``out/configuration``)."""
    model = PipelineModel.load(model_path)
    data = spark.read.parquet(data_path)
    score(model, data).write.mode("overwrite").parquet(f"{out}/predictions")
    stages = [(i, type(s).__name__, s.uid, json.dumps({p.name: str(v) for p, v in sorted(
        s.extractParamMap().items(), key=lambda x: x[0].name)})) for i, s in enumerate(model.stages)]
    spark.createDataFrame(stages, "stage int, kind string, uid string, parameters string") \
        .withColumn("model", F.lit(model_path)).withColumn("data", F.lit(data_path)) \
        .coalesce(1).write.mode("overwrite").json(f"{out}/configuration")
    return spark.read.parquet(f"{out}/predictions")


# S13 -----------------------------------------------------------------------
# The columns of the judgement files.
JUDGEMENT_SCHEMA = ("sent_id long, sentence string, correct_preposition string, confidence string, "
                    "sentence_quality string")


def read_judgements(spark: SparkSession, path: str, header: bool = True, corrupt: str | None = None) -> DataFrame:
    """Judgement files by ``sent_id``; with ``corrupt`` a column of that name keeps the
    whole line where a line does not fit the columns (else such lines have nulls)."""
    schema = JUDGEMENT_SCHEMA + (f", {corrupt} string" if corrupt else "")
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", header).option("mode", "PERMISSIVE")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).csv(path).orderBy("sent_id")


# S14 -----------------------------------------------------------------------
def read_points(spark: SparkSession, path: str, dims: int) -> DataFrame:
    schema = StructType.fromDDL(", ".join(f"c{i} double" for i in range(dims)))
    df = spark.read.csv(path, header=False, schema=schema)
    return df.select(F.array(*[F.col(f"c{i}") for i in range(dims)]).alias("x"))


# S15 -----------------------------------------------------------------------
def read_word_list(spark: SparkSession, path: str, col: str = "word") -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).select(col).distinct()


# S16 -----------------------------------------------------------------------
# Fixed value: the format of a training log line.
RUN_LOG_RX = r"loss: ([0-9.eE+-]+) - acc: ([0-9.eE+-]+) - val_loss: ([0-9.eE+-]+) - val_acc: ([0-9.eE+-]+)"


def parse_run_logs(lines: DataFrame, line_col: str = "value", run_col: str = "run_id") -> DataFrame:
    """Metrics of training log lines; lines without metrics are dropped."""
    names = ["loss", "acc", "val_loss", "val_acc"]
    out = lines.select(run_col, *[F.regexp_extract(line_col, RUN_LOG_RX, i + 1).alias(n) for i, n in enumerate(names)])
    return out.filter(F.col("loss") != "").select(run_col, *[F.col(n).cast("double").alias(n) for n in names])


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("run_id", F.col("_metadata.file_path"))
    return parse_run_logs(lines)
