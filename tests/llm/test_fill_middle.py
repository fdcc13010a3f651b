"""Fill-in-middle against a plain version, and restoration from the output alone."""

import hashlib
import re

import duckdb
import pytest

from errorlab.llm import fill_middle as fm

MARKS = ("<P>", "<S>", "<M>")


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert "".join(units) == text
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def restore(form, output):
    if form == "plain":
        return output
    order = MARKS if form == "psm" else ("<S>", "<P>", "<M>")
    parts = re.fullmatch("(.*)".join(["", *map(re.escape, order)]).removeprefix("(.*)") + "(.*)", output, re.S).groups()
    found = dict(zip(order, parts))
    return found["<P>"] + found["<M>"] + found["<S>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(rows):
    out = []
    for d, t in rows:
        n, form, p, m, output = brute(d, t)
        assert restore(form, output) == (t or "")
        out.append((d, n, form, p, m, sha(output), sha(t or "")))
    return sorted(out, key=str)


def digests(docs):
    return sorted((tuple(r) for r in fm.restored(docs).mapInArrow(fm.digest_text, fm.RESTORED).collect()), key=str)


def test_units():
    for text in ("", "a", " ", "ab cd", "é漢😀a😀", "[a]`{@Z", "\n\r\0x", "ſK"):  # the last two only look like letters
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert [len("".join(units[:i])) for i in range(len(units))] == fm.unit_starts(text).tolist()


def test_odd_rows(spark, odd, empty):
    more = [(i, f"{'word ' * (i % 9)}{x} tail") for i, x in enumerate(["", "<P>", "<M>", "< S>", "<S", "P>", "<<P>"] * 9)]
    docs = odd.select("doc_id", "text", "kept", "node").unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert digests(docs) == want(rows)
    outputs = sorted((tuple(r) for r in fm.outputs(docs).collect()), key=str)
    assert outputs == sorted(((d, *brute(d, t)) for d, t in rows), key=str)
    assert fm.outputs(empty).count() == 0 and digests(empty) == []


@pytest.mark.parametrize("units, chars", [(1, 1), (3, 2), (7, 1000)])
def test_small_pieces(spark, monkeypatch, units, chars):
    monkeypatch.setattr(fm, "CHUNK_UNITS", units)
    monkeypatch.setattr(fm, "CHUNK_CHARS", chars)
    rows = [(i, "one two, 三 <three\n>four" * (i % 4)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(docs) == want(rows)


def test_long_text_comes_in_pieces(spark):
    rows = [(i, "Words and more words, " * 40_000) for i in range(3)] + [(9, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(docs) == want(rows)
    sizes = [len(r.piece) for r in fm.assembled(docs).collect()]
    assert max(sizes) <= 4 * fm.CHUNK_CHARS + 3 and len(sizes) > 40


def test_copies_are_documents_of_their_own(spark):
    rows = [(5, "the same text again")] * 500 + [(None, "the same text again")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digests(docs) == want(rows)
    assert fm.assembled(docs).where("position = -1").select("key").distinct().count() == 1000


def test_query_and_sql(spark, sf):
    got = fm.op12_fill_in_middle(spark, sf)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert rows == want([(r.doc_id, r.text) for r in docs])
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        told = c.execute(fm.OP12_SQL)
        assert [d[0] for d in told.description] == got.columns
        assert sorted(told.fetchall(), key=str) == rows
