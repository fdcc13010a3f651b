"""Suffix-array dedup against brute force over all 50-byte strings."""

import hashlib
import random

import numpy as np

from errorlab.llm import repeats as rp


def brute(rows):
    first = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for i in range(len(b) - rp.LENGTH + 1):
                s = b[i:i + rp.LENGTH]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - rp.LENGTH + 1):
                if first[b[i:i + rp.LENGTH]] < d:
                    gone[i:i + rp.LENGTH] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=str)


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(rp.remove_repeats(docs)) == brute([tuple(r) for r in docs.collect()])


def test_planted(spark, monkeypatch):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcde é") for _ in range(rnd.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = [text(30) for _ in range(5)]
    rows = []
    for i in range(300):
        t = text(rnd.randrange(0, 60))
        for c in rnd.sample(common, rnd.randrange(0, 3)):
            lo = rnd.randrange(len(c) // 2)
            t += c[lo:lo + rnd.randrange(30, 120)] + text(3)
        rows.append((i * 7 % 1000, t))
    rows += [(2000 + i, "ab" * 200) for i in range(30)] + [(3000 + i, "a" * (40 + i)) for i in range(30)]
    rows += [(4000 + i, rows[i][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = brute(rows)
    assert got(rp.remove_repeats(docs)) == want


def test_odd_rows(spark, odd, empty):
    assert got(rp.remove_repeats(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert rp.remove_repeats(empty).count() == 0


def test_factor_arrays():
    """Suffix order, common prefixes and longest previous factors against plain loops."""
    rnd = random.Random(5)
    for letters, n in (("ab", 400), ("abcdefgh ", 900), ("a", 130)):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50, n))) for _ in range(6)]
        texts += [texts[0][7:] + "x" * 60, "x" * 90 + texts[1][-60:]]
        keys = [5, 3, 3, 9, 1, 7, -2, 4]
        data = "".join(texts).encode()
        starts, doc, base = [], [], 0
        for k, t in zip(keys, texts):
            starts += range(base, base + len(t) - rp.LENGTH + 1)
            doc += [k] * (len(t) - rp.LENGTH + 1)
            base += len(t)
        buf, starts, doc = np.frombuffer(data, np.uint8), np.array(starts), np.array(doc)
        order, lcp = rp.suffix_order(buf, starts, doc)
        strings = [data[s:s + rp.LENGTH] for s in starts]
        assert [(strings[i], doc[i]) for i in order] == sorted(zip(strings, doc))
        agree = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), rp.LENGTH)
        assert lcp.tolist()[1:] == [agree(strings[i], strings[j]) for i, j in zip(order, order[1:])]
        first = {}
        for s, d in zip(strings, doc):
            first[s] = min(first.get(s, d), d)
        want = [first[s] < d for s, d in zip(strings, doc)]
        assert (rp.previous_factor(doc[order], lcp) >= rp.LENGTH).tolist() == [want[i] for i in order]
        assert rp.earlier(buf, starts, doc).tolist() == want


def test_packed_numbers():
    x = np.array([-5, 3, 3, 2 ** 62, -(2 ** 63), 2 ** 63 - 1])
    assert (rp._sums(rp._numbers(rp._planes(rp._steps(x)))) == x).all()
    h = np.array([0, 1, 2 ** (8 * rp.KEY) - 1], np.uint64)
    assert (rp._numbers(rp._planes(h, rp.KEY), rp.KEY) == h).all()
    assert (rp._keys(rp._planes(h[1:2], rp.KEY) * 2) == 1).all()


def test_one_row_per_document(spark):
    """However many tasks own a document's anchors, what they found comes back packed."""
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(60)], "doc_id long, text string").repartition(6)
    lists = rp.shared_anchors(docs, 16).collect()
    assert sorted(r.doc_id for r in lists) == list(range(60))
    known = {r.doc_id: set(rp._keys(r.hashes).tolist()) for r in lists}
    assert all(known[i] == known[i % 20] and len(known[i]) > 16 for i in range(60))
    starts = rp.covered_starts(docs.join(spark.createDataFrame(lists), "doc_id"), 16).collect()
    assert sorted(r.doc_id for r in starts) == list(range(20, 60))


def test_packed_rows():
    doc = np.array([7, -3, 7, 2 ** 62, -3, 5])
    values = np.arange(12, dtype=np.uint8).reshape(6, 2)
    rows = rp._packed(doc, values, 3)
    assert rows.num_rows <= 3 and rows.column("bucket").to_pylist() == sorted(set(rows.column("bucket").to_pylist()))
    assert len(b"".join(rows.column("found").to_pylist())) == 12
