"""The encoder against the library's own encoding of whole texts."""

import random

import numpy as np

from errorlab.llm import token_output as to

DEFINITION = to.tokenizer_definition()


def library(encoder, texts):
    return [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def odd_texts():
    rnd = random.Random(3)
    bits = ["word", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\x85", "\x1c", "\x0b", ".", ",!", "&&&", "it's", "'ll",
            "<|endoftext|>", "12", "½", "é", "é", "漢字", "😀", "\0", "_", "-", "Ġ", "Ċ", "x" * 30, "<|", "endoftext", "|>", "​"]
    texts = ["", " ", "\n", " a", "a ", "a\n", "\na", "a\nb", "a \nb", "a\n b", "a.\nB c", "one\n\ntwo", "a<|endoftext|>.\nb"]
    return texts + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 12))) for _ in range(4000)]


def test_same_ids_as_the_library(monkeypatch):
    for bound, lines in ((300_000, 1000), (40, 3)):
        monkeypatch.setattr(to, "CACHE_PIECES", bound)
        monkeypatch.setattr(to, "LINES", lines)
        encoder = to.Encoder(DEFINITION)
        assert encoder.cuts
        texts = odd_texts()
        want = library(encoder, texts)
        got = [x for i in range(0, len(texts), 100) for x in encoder(texts[i:i + 100])]
        assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_new_pieces_go_to_the_library_together(monkeypatch):
    encoder = to.Encoder(DEFINITION)
    calls = []
    whole = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: calls.extend(texts) or whole(texts))
    texts = [" ".join(f"piece{i}x{j}." for j in range(300)) + "\nnext line" for i in range(10)]
    got = encoder(texts)
    assert len(calls) <= 10
    assert got == library(encoder, texts)


def test_what_is_in_use_is_kept(monkeypatch):
    monkeypatch.setattr(to, "CACHE_PIECES", 100)
    encoder = to.Encoder(DEFINITION)
    sent = []
    whole = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: sent.extend(texts) or whole(texts))
    for i in range(20):
        encoder(["common words " + " ".join(f"rare{i}q{j}" for j in range(30))])
    assert sum("common" in t for t in sent) == 1
    assert len(encoder.cache) + len(encoder.before) <= 200


def test_no_threads_beside_the_tasks(monkeypatch):
    import os

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    to.worker_encoder(DEFINITION)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_other_tokenizers_encode_whole_texts():
    import json

    other = json.loads(DEFINITION)
    other["pre_tokenizer"]["add_prefix_space"] = True
    encoder = to.Encoder(json.dumps(other))
    texts = ["a b\nc", "one two.", ""]
    assert not encoder.cuts and encoder(texts) == library(encoder, texts)


def test_arrow_arrays_and_slices_give_the_same_ids():
    import pyarrow as pa

    encoder = to.Encoder(DEFINITION)
    texts = odd_texts()[:600]
    for kind in (pa.string(), pa.large_string()):
        assert encoder(pa.array(texts, kind)[7:503]) == library(encoder, texts[7:503])
    assert encoder([]) == [] and encoder(["", ""]) == [b"", b""]


def test_words_and_marks_are_remembered_apart():
    encoder = to.Encoder(DEFINITION)
    texts = ["One, two. two! two\nthree&&&", "Ünï, два. λόγος! two... a.b,c 3.5 x.\n y"]
    assert encoder(texts) == library(encoder, texts)
    assert {"One", " two", "three", "Ünï", " два", " λόγος", ",", ".", "!", "&&&"} <= encoder.cache.keys()
    assert not any(p[-1] in ",.!&" and p[:-1].strip(" ").isalpha() for p in encoder.cache if p)


def test_lines_of_letters_skip_the_splitter():
    encoder = to.Encoder(DEFINITION)
    whole = []

    class Counted:
        model = encoder.tokenizer.model

        def encode_batch_fast(self, texts, add_special_tokens):
            whole.extend(texts)
            return original.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

        encode_batch = encode_batch_fast

    original, encoder.tokenizer = encoder.tokenizer, Counted()
    got = encoder(["some words, größere Wörter\nи слова 12 it's"])
    encoder.tokenizer = original
    assert got == library(encoder, ["some words, größere Wörter\nи слова 12 it's"])
    assert not any("words" in t or "größere" in t or "слова" in t for t in whole)


def test_letters_spaces_and_byte_characters_are_the_library_s():
    import re

    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import pre_tokenizers

    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    letters = [c for c in chars if re.fullmatch(f"[{to.LETTERS}]", c)]
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    assert len(letters) > 600
    for c in letters:
        cut = split.pre_tokenize_str(f" a{c}b.")
        assert [p for p, _ in cut] == ["".join(to.BYTE_CHARS[b] for b in f" a{c}b".encode()), "."]
    assert set(to.BYTE_CHARS) == set(pre_tokenizers.ByteLevel.alphabet()) and len(to.BYTE_CHARS) == 256
    assert pc.match_substring_regex(pa.array(chars), to.SPACE).to_pylist() == [c.isspace() for c in chars]


def test_an_added_word_of_letters_is_one_id():
    import json

    other = json.loads(DEFINITION)
    other["added_tokens"].append(dict(other["added_tokens"][0], id=50257, content="zebra"))
    encoder = to.Encoder(json.dumps(other))
    texts = ["zebra", "a zebra", "zebras\nmore", "other words"]
    assert encoder(texts) == library(encoder, texts)
    assert [encoder([t]) for t in texts] == [[x] for x in library(encoder, texts)]
