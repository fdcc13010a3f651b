"""Piece encoding against the library, whose results it must give exactly."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from errorlab.llm import pieces


@pytest.fixture(scope="module")
def data():
    return pieces.model_data()


@pytest.fixture(scope="module")
def library(data):
    return sentencepiece.SentencePieceProcessor(model_proto=data)


@pytest.fixture(scope="module")
def encoder(data):
    return pieces.TextEncoder(pieces.PieceModel(data))


def ids_of(encoder, text):
    return np.frombuffer(encoder([text])[0], "<i4").tolist()


@pytest.mark.parametrize("text", [
    "", " ", "  ", "   x", "x  ", "\n", "▁", "a▁b", "a ▁▁ b", "   \n   a\n\n  b", "naïve 漢字 😀 \u0000​",
    "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 100, "é", "word,word.word;;;..."])
def test_cases(encoder, library, text):
    assert ids_of(encoder, text) == library.encode(text)


def test_random_texts(encoder, library, data):
    rng = random.Random(5)
    vocabulary = sorted(pieces.PieceModel(data).id)
    for alphabet in ("abcde  \n\tñé漢😀▁ .,;the ing \x00", ["the", "in", "g", "er", " ", "  ", "s", "."], vocabulary):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
            assert ids_of(encoder, text) == library.encode(text)


def test_steps_back_where_longest_matches_do_not_fit(data, library):
    found = pieces.PieceEncoder(pieces.PieceModel(data))
    rng, other = random.Random(6), 0
    for _ in range(3000):
        text = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 25)))
        got = found.pieces(text)
        assert got == found.model.merge(text)
        other += got != [p for _, p in found.finder.iter_long(text)]
    assert other > 300


def test_memory_is_bounded(data, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 50)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 50)
    small = pieces.TextEncoder(pieces.PieceModel(data))
    rng = random.Random(7)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20))
        assert ids_of(small, text) == library.encode(text)
    assert len(small.known) < 100 and len(small.encoder.pairs) <= 50 and len(small.encoder.runs) < 100


def test_other_models_are_refused(data):
    from sentencepiece import sentencepiece_model_pb2 as format_

    proto = format_.ModelProto()
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = format_.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        pieces.PieceModel(proto.SerializeToString())


def test_tables(spark, odd, empty, data, library):
    docs = odd.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("n_chars"), allowMissingColumns=True)
    want = sorted((r.doc_id is not None, r.doc_id or 0, library.encode(r.text or "")) for r in docs.collect())
    got = sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in pieces.encode(docs, data).collect())
    assert got == want
    both = pieces.round_trip(docs, data)
    assert sorted(map(str, both.collect())) == sorted(map(str, pieces.decode(pieces.encode(docs, data), data).collect()))
    assert all(r.text == library.decode(list(r.ids)) for r in both.collect())
    assert pieces.encode(empty, data).count() == 0 and pieces.round_trip(empty, data).count() == 0


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op13_piece_codec(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_words_are_remembered_once(data, library):
    """A word is kept as one unit, with or without marks behind it, not twice over."""
    fresh = pieces.TextEncoder(pieces.PieceModel(data))
    words = [f"{a}{b}ing" for a in "bcdfghjklm" for b in "aeiou"]
    searched = []
    search = fresh.encoder.pieces
    fresh.encoder.pieces = lambda text: searched.append(text) or search(text)
    for text in (" ".join(words), ", ".join(words)):
        assert ids_of(fresh, text) == library.encode(text)
    assert sum(t.startswith(pieces.SPACE) for t in searched) == len(words)
    fresh = pieces.TextEncoder(pieces.PieceModel(data))
    fresh([" ".join(words)])
    assert len(fresh.known) + len(fresh.encoder.runs) == len(words)
