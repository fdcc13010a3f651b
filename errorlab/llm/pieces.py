"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding is exact, by backtracking.  The merge order of a model (highest score first,
then leftmost) tells which pieces may stand side by side: a sequence of pieces is the
encoding of its text if and only if merging any two neighbours' text anew gives those two
neighbours.  So an encoder may take the longest piece at each place (Aho-Corasick), check
it against its left neighbour by re-merging the two (remembered per pair), try shorter
pieces, and step back where none fits; a bitfield marks the places from which no
continuation exists, so none is tried twice and the work stays linear in the text.

Texts are cut before every run of spaces that follows another character, and around
characters that the vocabulary lacks, provided that no piece of the vocabulary reaches
over such a place (``PieceModel`` checks that); merging never crosses those cuts, and each
distinct unit is encoded once per worker, in a cache of bounded size.  Characters without
a piece become their UTF-8 bytes.

Null and empty texts have no ids and decode to the empty text.  Rows are independent:
repeated rows, null or repeated keys, and extra columns change nothing, there is no
shuffle, and an empty table gives no rows.  Texts are encoded whole, whatever their
length.  Decoding is the library's ``decode``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table, text_steps

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# The piece types of a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct units (two generations of half each; parts of units have half), and pairs of pieces, that one worker remembers.
CACHE_UNITS = 1_000_000
CACHE_PAIRS = 1_000_000


class PieceModel:
    """The tables of a model file that encoding needs."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as format_

        proto = format_.ModelProto()
        proto.ParseFromString(data)
        rules, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != format_.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("not a merge-type model with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces \
                or not rules.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model rewrites texts in a way that is not supported")
        if kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        known = sorted(set(chain.from_iterable(self.id)))
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any(c not in self.id for c in known):
            raise ValueError("a piece reaches over a space, or has a character without a piece")
        #: Characters next to each other in some piece: merging crosses no other place.
        self.touch = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self.unknown = re.compile("([^" + "".join(map(re.escape, known)) + "])")
        # Marks that touch no letter before them: a word and the marks behind it are units of their own.
        self.letters = {c for c in known if c.isalpha()}
        held = {p[1] for p in self.touch if p[0] in self.letters}
        self.marks = "".join(c for c in known if not c.isalnum() and c not in (SPACE, " ") and c not in held)

    def merge(self, text: str) -> list[str]:
        """``text`` merged from its characters: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts


class PieceEncoder:
    """``unit(text)``: the serialized ids of a text in which every space is written ``SPACE``."""

    def __init__(self, model: PieceModel):
        self.model = model
        # Only a piece that merging its own text yields can occur.
        whole = {p for p in model.id if model.merge(p) == [p]}
        #: The longest proper prefix that is a piece (empty if there is none).
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), "") for p in whole}
        self.finder = ahocorasick.Automaton()
        for p in whole:
            self.finder.add_word(p, p)
        self.finder.make_automaton()
        #: For every beginning of a piece the longest piece that it begins with.
        self.within: dict[str, str] = {}
        for p in whole:
            for n in range(len(p), 0, -1):
                if p[:n] in self.within:
                    break
                self.within[p[:n]] = p[:n] if p[:n] in whole else \
                    next((p[:k] for k in range(n - 1, 0, -1) if p[:k] in whole), "")
        self.reach = max(map(len, whole), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[str, bytes] = {}
        self.code = {p: struct.pack("<I", i) for p, i in model.id.items()}
        self.byte = {b: struct.pack("<I", i) for b, i in model.byte.items()}

    def fits(self, pair: tuple[str, str]) -> bool:
        """Whether the two pieces stay apart when their text is merged anew (remembered)."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        left, right = pair
        known = left[-1] + right[0] not in self.model.touch or self.model.merge(left + right) == [left, right]
        self.pairs[pair] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """The encoding of a text of known characters, as pieces."""
        known, fits = self.pairs.get, self.fits
        out = [p for _, p in self.finder.iter_long(text)]  # longest matches, one after the other
        n = 0
        for pair in zip(out, out[1:]):
            n += 1
            ok = known(pair)
            if not ok and (ok is not None or not fits(pair)):
                break
        else:
            return out
        # Up to the first pair that does not fit this is how backtracking begins as well.
        longest_prefix, within, shorter = self.finder.longest_prefix, self.within, self.shorter
        piece, out = shorter[out[n]], out[:n]
        at, size, reach = sum(map(len, out)), len(text), self.reach
        failed = bytearray(size // 8 + 1)  # places from which no continuation was found
        while True:
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not out:
                        break
                    pair = out[-1], piece
                    ok = known(pair)
                    if ok or ok is None and fits(pair):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at = end
                if at == size:
                    return out
                rest = text[at:at + reach]
                piece = within[rest[:longest_prefix(rest)]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # refused now, as its end is marked: shorter ones follow
                at -= len(piece)

    def code_of(self, text: str) -> bytes:
        """The serialized ids of a text of any characters, not remembered itself."""
        codes = []
        for i, part in enumerate(self.model.unknown.split(text)):
            if i % 2:
                codes += [self.byte[b] for b in part.encode()]
            elif part == text:
                codes += map(self.code.__getitem__, self.pieces(part))
            elif part:
                codes.append(self.unit(part))
        return b"".join(codes)

    def run(self, text: str) -> bytes:
        code = self.runs.get(text)
        if code is None:
            code = self.runs[text] = self.code_of(text)
        return code

    def unit(self, text: str) -> bytes:
        if len(self.runs) > CACHE_UNITS // 2:
            self.runs.clear()
        word = text.rstrip(self.model.marks)
        if word and len(word) < len(text) and word[-1] in self.model.letters:
            return self.run(word) + self.run(text[len(word):])
        return self.run(text)


class TextEncoder:
    """Whole texts, through a memory of units: ids as little-endian unsigned 32-bit integers."""

    _units = re.compile(r" +[^ ]*").findall

    def __init__(self, model: PieceModel):
        self.encoder = PieceEncoder(model)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _fill(self, keys: set[str]) -> None:
        """Bring ``keys`` (units without their first space) into the young generation.  A
        word is remembered without the marks behind it too, as a unit that it also is."""
        if len(self.known) > CACHE_UNITS // 2:
            self.before, self.known = self.known, {}
        known, before, model = self.known, self.before, self.encoder.model
        unit, marks, letters = self.encoder.unit, model.marks, model.letters
        new = keys - known.keys()
        kept = new & before.keys()
        known.update(zip(kept, map(before.__getitem__, kept)))
        for key in new - kept:
            word = key.rstrip(marks)
            if not word or word == key or word[-1] not in letters:
                known[key] = self._apart(key)
                continue
            code = known.get(word)
            if code is None:
                code = before.get(word)
                if code is None:
                    code = self._apart(word)
                known[word] = code
            known[key] = code + unit(key[len(word):])

    def _apart(self, key: str) -> bytes:
        return self.encoder.code_of(SPACE + key.replace(" ", SPACE))

    def __call__(self, texts: list[str]) -> list[bytes]:
        units = []
        for t in texts:
            t = t.replace(SPACE, " ")
            # The model puts a space before every text; units begin with their spaces.
            units.append([] if not t else t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " "
                         else [u[1:] for u in self._units(" " + t)])
        self._fill(set(chain.from_iterable(units)))
        get = self.known.__getitem__
        return [b"".join(map(get, u)) for u in units]


def worker_state(data: bytes):
    """The encoder and the library's processor of this worker process, kept from task to task."""
    import sentencepiece

    kept = sys.__dict__.setdefault("_errorlab_pieces", {})
    key = hashlib.sha256(data).hexdigest()
    if key not in kept:
        kept[key] = TextEncoder(PieceModel(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    return kept[key]


def encode(docs: DataFrame, data: bytes) -> DataFrame:
    """``doc_id, ids``: the ids of every text under the model file ``data``."""
    shared = docs.sparkSession.sparkContext.broadcast(data)  # one model file

    def step(batches):
        encoder, _ = worker_state(shared.value)
        for b in text_steps(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(encoder(b.column("text").to_pylist()))],
                                             ["doc_id", "ids"])

    return pick(docs).mapInArrow(step, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, data: bytes) -> DataFrame:
    """``doc_id, ids, text``: the text of every id array; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(data)

    def step(batches):
        _, library = worker_state(shared.value)
        for b in batches:
            texts = [library.decode(ids.values.to_pylist()) if ids.is_valid and len(ids) else "" for ids in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(step, "doc_id long, ids array<int>, text string")


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def round_trip(docs: DataFrame, data: bytes) -> DataFrame:
    """``doc_id, ids, text`` of :func:`decode` over :func:`encode`, in one step over the
    rows: ids go on to the library where they are made."""
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def step(batches):
        encoder, library = worker_state(shared.value)
        for b in text_steps(batches):
            ids = encoder(b.column("text").to_pylist())
            texts = [library.decode(np.frombuffer(x, "<i4").tolist()) if x else "" for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids), pa.array(texts, pa.string())],
                                             ["doc_id", "ids", "text"])

    return pick(docs).mapInArrow(step, "doc_id long, ids array<int>, text string")


def model_data(name: str = MODEL) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op13_piece_codec(spark, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents"), model_data())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))
