"""Token-id output: every text encoded, compressed on its own, readable on its own.

The file format is a folder of two Parquet tables, so any store that Spark reaches will do:

* ``dictionary``: one row ``(dictionary, dictionary_sha256, end_id)``; the Zstandard
  dictionary is trained on serialized id arrays of a bounded sample of documents.
* ``blocks``: rows in ascending key order; a block holds some documents' frames, one
  Zstandard frame per document (little-endian unsigned 32-bit ids, the end id last), as
  ``payload``, and its offset index: ``doc_ids``, ``offsets``, ``n_tokens``; further
  ``part, block`` (its place in the order), ``first_id, last_id`` (for skipping) and the
  hash of the dictionary that its frames need.

Reading a short document takes its block's index and one frame.  Texts are encoded
whole; null counts as empty (the end id alone).  Null keys come first, equal keys in the
order of their frames.  Blocks end at ``BLOCK_BYTES``; a longer document has one of its own.
An empty table gives files without blocks.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import longs, materialize, pick, scratch_path, table, text_steps

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 1 << 20
CACHE_PIECES = 1_200_000
LINES = 1000

#: What Python calls a space, for Arrow's regular expressions.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Ranges of nothing but letters since Unicode 5, so to Python, Arrow and the library alike.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁ"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that byte-level tokenizers write for each byte.
BYTE_CHARS = "".join(chr(b if b in _PRINTED else 256 + b - sum(p < b for p in _PRINTED)) for b in range(256))

BLOCKS = ("part long, block long, first_id long, last_id long, doc_ids array<long>, offsets array<long>, "
          "n_tokens array<long>, payload binary, dictionary_sha256 string")


class Encoder:
    """A tokenizer that encodes each distinct piece of text between blanks once.

    Byte-level splitting never joins a blank that follows a non-space with what stands
    before it, and a line end between two non-spaces stands alone.  So a text in which no
    two spaces meet may be cut before every blank and around every line end, one without
    a blank between two spaces before every blank, and the pieces' ids be joined.  Other
    texts, those that hold an added token, and all texts of other kinds of tokenizers are
    encoded in one go.  Letters and the marks behind them never join either: cut there too.

    Arrow cuts the texts, finds a batch's distinct pieces and joins their ids; Python sees
    the distinct pieces only.  The library gets new pieces many at a time, as lines of one
    text; the ids of the line ends tell them apart.  Lines of nothing but letters need no
    splitting, so the library's model gets them as they are.  Two generations of pieces
    are kept, of half the bound each: what is in use goes on from the old one to the young one.
    """

    _line = re.compile(r" ?\S+").fullmatch
    _word = re.compile(f" ?[{LETTERS}]+").fullmatch
    _words = re.compile(f" ?[{LETTERS}]++(?:\n ?[{LETTERS}]++)*+").fullmatch

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = False
        self.line_end = self._whole(["\n"])[0]
        kind = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space \
            and self.tokenizer.normalizer is None and len(self.line_end) == 4 \
            and not any(re.search(r"\s", t) for t in self.added)
        self.by_word = self.cuts and isinstance(self.tokenizer.model, models.BPE) \
            and self.tokenizer.truncation is None and self.tokenizer.padding is None \
            and not any(map(self._word, self.added))

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.cuts or not len(texts):
            return self._whole(texts.to_pylist())
        one_go = pc.match_substring_regex(texts, f"\\x00|{SPACE} {SPACE}")
        for t in self.added:
            one_go = pc.or_(one_go, pc.match_substring(texts, t))
        cut = pc.replace_substring_regex(pc.if_else(one_go, "", texts), f"([{LETTERS}])([.,;:!?%&*$#])", "\\1\0\\2")
        cut = pc.replace_substring(cut, " ", "\0 ")
        lines = pc.replace_substring(cut, "\n", "\0\n\0")
        rows = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, SPACE + SPACE), cut, lines), "\0")
        pieces = rows.flatten().dictionary_encode()
        ids = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[rows.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        whole = iter(self._whole(texts.filter(one_go).to_pylist()))
        return [next(whole) if g else data[a:b].tobytes() for g, a, b in zip(one_go.to_pylist(), ends, ends[1:])]

    def _ids(self, pieces: list[str]) -> pa.Array:
        """The serialized ids of distinct pieces."""
        found = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        self._fill({pieces[i] for i in new})
        for i in new:
            found[i] = self.cache[pieces[i]]
        return pa.array(found, pa.large_binary())

    def _fill(self, pieces: set[str]) -> None:
        """Bring ``pieces`` into the young generation."""
        if len(self.cache) > CACHE_PIECES // 2:
            self.before, self.cache = self.cache, {}
        new = self._missing(pieces)
        words = list(filter(self._word, new))
        self.cache.update(zip(words, self._lines(words)))
        new.difference_update(words)
        lines = list(filter(self._line, new))
        self.cache.update(zip(lines, self._lines(lines)))
        others = list(new.difference(lines))
        self.cache.update(zip(others, self._whole(others)))

    def _missing(self, pieces: set[str]) -> set[str]:
        """Those that neither generation has."""
        pieces = pieces.difference(self.cache)
        kept = pieces & self.before.keys()
        self.cache.update(zip(kept, map(self.before.__getitem__, kept)))
        return pieces - kept

    def _lines(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), LINES):
            lines = pieces[i:i + LINES]
            data, = self._whole(["\n".join(lines)])
            at = np.flatnonzero(np.frombuffer(data, "<u4") == np.frombuffer(self.line_end, "<u4")) * 4
            if len(at) == len(lines) - 1:
                out += [data[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(data)])]
            else:
                out += self._whole(lines)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        if self.by_word and len(texts) == 1 and self._words(texts[0]):
            return [self._letters(texts[0])]
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]

    def _letters(self, text: str) -> bytes:
        """Lines of letters: the library's model on each, written as its bytes' characters."""
        tokenize, (end,) = self.tokenizer.model.tokenize, np.frombuffer(self.line_end, "<u4").tolist()
        ids = []
        for word in codecs.charmap_decode(text.encode(), "strict", BYTE_CHARS)[0].split(BYTE_CHARS[10]):
            ids += [t.id for t in tokenize(word)]
            ids.append(end)
        return np.array(ids[:-1], "<u4").tobytes()


def worker_encoder(definition: str) -> Encoder:
    """The encoder of this worker process, kept with its pieces from task to task.  The
    library starts no threads of its own there: Spark's tasks have the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.__dict__.setdefault("_errorlab_encoders", {})
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in kept:
        kept[key] = Encoder(definition)
    return kept[key]


def serialized(docs: DataFrame, definition: str, end_id: int) -> DataFrame:
    """``doc_id, ids``: the serialized id array of every text."""
    end = np.array([end_id], "<u4").tobytes()

    def step(batches):
        encode = worker_encoder(definition)
        for b in text_steps(batches):
            ids = encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x + end for x in ids], pa.binary())],
                                             ["doc_id", "ids"])

    return docs.mapInArrow(step, "doc_id long, ids binary")


def train_dictionary(docs: DataFrame, definition: str, end_id: int, sample_docs: int, sample_bytes: int,
                     size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on at most ``sample_docs`` documents and ``sample_bytes`` of their ids, in
    the order of a hash of their keys; empty where that is too little."""
    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id") \
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample_docs).distinct()
    rows = serialized(docs.join(F.broadcast(chosen), "doc_id"), definition, end_id) \
        .groupBy("doc_id").agg(F.max("ids").alias("ids")).orderBy("doc_id").toLocalIterator()
    sample, left = [], sample_bytes
    for r in rows:
        if len(r["ids"]) <= left:
            sample.append(bytes(r["ids"]))
            left -= len(r["ids"])
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int = END_ID,
                 sample_docs: int = 1000, sample_bytes: int = 8 << 20, level: int = 3) -> None:
    """Encode ``docs`` and write the files to ``path``."""
    spark = docs.sparkSession
    docs = pick(docs)
    dictionary = train_dictionary(docs, definition, end_id, sample_docs, sample_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dictionary, digest, end_id)],
                          "dictionary binary, dictionary_sha256 string, end_id long").coalesce(1) \
        .write.parquet(f"{path}/dictionary")
    end = np.array([end_id], "<u4").tobytes()

    def compress(batches):
        encode = worker_encoder(definition)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        for b in text_steps(batches):
            ids = [x + end for x in encode(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), longs([len(x) // 4 for x in ids]),
                 pa.array([packer.compress(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "frame"])

    def block(batches):
        part, number, held, size = None, 0, [], 0

        def full():
            frames = [f for _, _, f in held]
            ends = np.cumsum([len(f) for f in frames])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), longs([number]), pa.array([held[0][0]], pa.int64()),
                 pa.array([held[-1][0]], pa.int64()), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())),
                 pa.array([[0, *ends.tolist()]], pa.list_(pa.int64())),
                 pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
                 pa.array([b"".join(frames)], pa.binary()), pa.array([digest])],
                ["part", "block", "first_id", "last_id", "doc_ids", "offsets", "n_tokens", "payload",
                 "dictionary_sha256"])

        started = False
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if not started:
                    part, started = row[0], True
                if held and size + len(row[2]) > BLOCK_BYTES:
                    yield full()
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield full()

    frames = materialize(docs.mapInArrow(compress, "doc_id long, n_tokens long, frame binary"), "frames")
    frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "frame") \
        .mapInArrow(block, BLOCKS).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dictionary_sha256"]:
        raise ValueError(f"damaged dictionary in {path}")
    return data, row["dictionary_sha256"]


def placed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``block_start``, the number of ids before each.  Totals are summed
    per part (as many as the writer had partitions), then along each part's blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    held = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = blocks.withColumn("held", held)
    totals = blocks.groupBy("part").agg(F.sum("held").alias("held")).collect()
    starts, run = [], 0
    for r in sorted(totals, key=lambda r: (r["part"] is not None, r["part"] or 0)):
        starts.append((r["part"], run))
        run += r["held"]
    starts = spark.createDataFrame(starts, "of long, part_start long").coalesce(1)
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("part", "block", "held").withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))) \
        .join(F.broadcast(starts), F.col("part").eqNullSafe(F.col("of"))) \
        .select(F.col("part").alias("p"), F.col("block").alias("k"), (F.col("part_start") + F.col("before")).alias("block_start"))
    return blocks.join(index, F.col("part").eqNullSafe(F.col("p")) & (F.col("block") == F.col("k"))).drop("p", "k", "held")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files, ``ids`` serialized as written."""
    return placed_blocks(spark, path).mapInArrow(_unpack(*_dictionary(spark, path), None),
                                                 "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The same for a few keys: other blocks are skipped by their statistics and other
    frames of a block are not decompressed.  No keys: no rows."""
    if not doc_ids:
        return read_tokens(spark, path).limit(0).drop("start")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(
        (F.col("first_id").isNull() | (F.col("first_id") <= max(doc_ids))) & (F.col("last_id") >= min(doc_ids))
        & F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast("long") for d in doc_ids]))) \
        .withColumn("block_start", F.lit(None).cast("long"))
    return blocks.mapInArrow(_unpack(*_dictionary(spark, path), set(doc_ids)),
                             "doc_id long, start long, n_tokens long, ids binary").drop("start")


def _unpack(dictionary: bytes, digest: str, wanted: set | None):
    def step(batches):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        reader = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                if col["dictionary_sha256"][i].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                ids, offsets = col["doc_ids"][i].as_py(), col["offsets"][i].as_py()
                payload = memoryview(col["payload"][i].as_buffer())
                at, out = col["block_start"][i].as_py(), []
                for d, lo, hi, n in zip(ids, offsets, offsets[1:], col["n_tokens"][i].as_py()):
                    if wanted is None or d in wanted:
                        data = reader.decompress(payload[lo:hi])
                        out.append((d, at, len(data) // 4, data))
                    if at is not None:
                        at += n
                if out:
                    d, s, n, data = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64()), pa.array(s, pa.int64()), longs(n), pa.array(data, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])
    return step


def tokenizer_definition(name: str = TOKENIZER) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_definition())
    return read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
