"""Near-dedup against brute force over all pairs, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from errorlab.llm import near_dedup as nd
from errorlab.llm.components import components


def brute_classes(rows, threshold=nd.THRESHOLD):
    arr = pa.array([t or "" for _, t in rows], pa.string())
    h, tf, offs = nd.weighted_sets(arr)
    doc = np.repeat(np.arange(len(rows)), np.diff(offs))
    seen = np.bincount(np.unique(doc * nd.SKETCH + nd.counter(h)) % nd.SKETCH, minlength=nd.SKETCH)
    idf = nd.idf_table(seen, len(rows))
    sets = [(h[i:j], tf[i:j]) for i, j in zip(offs, offs[1:])]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for d, (hs, _) in enumerate(sets):
        for x in hs.tolist():
            holders.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1:]}
    for a, b in sorted(pairs):
        if nd.similarity(*sets[a], *sets[b], idf) >= threshold:
            top[find(b)] = find(a)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted(((d, first.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_corpus_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(((r.doc_id, r.class_id) for r in nd.link_classes(docs).collect()), key=str)
    assert got == brute_classes([tuple(r) for r in docs.collect()])


def test_large_group_of_near_copies(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{rnd.randrange(500)}" for _ in range(60))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in nd.link_classes(docs).collect()), key=str)
    assert got == brute_classes(rows)
    assert {c for d, c in got if d < 1000} == {0}


def test_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.class_id) for r in nd.link_classes(odd).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 9), (10, 10)} <= got
    assert nd.link_classes(odd).count() == odd.count()
    assert nd.link_classes(empty).count() == 0
    kept = nd.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 8, 9, 10, None]))


def test_sampling_estimates_weighted_jaccard():
    rnd = np.random.default_rng(5)
    h = rnd.integers(0, 2 ** 63, 400).astype(np.uint64)
    a, b = np.sort(h[:300]), np.sort(h[60:])
    w = {x: 1 + (x % 7) / 7 for x in h.tolist()}
    wa, wb = (np.array([w[x] for x in s.tolist()]) for s in (a, b))
    sa, sb = (nd.sample(s, x, np.array([0, len(s)])) for s, x in ((a, wa), (b, wb)))
    both = sum(w[x] for x in set(a.tolist()) & set(b.tolist()))
    true = both / (wa.sum() + wb.sum() - both)
    assert abs((sa == sb).mean() - true) < 4 * np.sqrt(true * (1 - true) / sa.size)


@pytest.mark.parametrize("edges, n", [([], 0), ([(5, 4), (4, 3), (3, 2), (2, 1), (8, 9)], 7)])
def test_components(spark, edges, n):
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert len(got) == n
    assert all(got[x] == (1 if x < 6 else 8) for x in got)


def test_links_inside_a_template_family(spark):
    """Texts that share most of a template but stay apart, and pairs of them that do not."""
    rnd = random.Random(8)
    template = [f"t{i}" for i in range(240)]
    rows = []
    for i in range(700):
        own = [f"u{i}x{j}" for j in range(34)]
        rows.append((2 * i, " ".join(template + own)))
        if i % 5 == 0:
            at = rnd.randrange(5, 120)
            twin = template[:at] + [f"v{i}"] + template[at + 1:]
            rows.append((2 * i + 1, " ".join(twin + own[:-16] + [f"z{i}x{j}" for j in range(16)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in nd.link_classes(docs).collect()), key=str)
    assert got == linked_by_band(rows)


def linked_by_band(rows):
    """As ``brute_classes``, over the pairs that share a band."""
    arr = pa.array([t for _, t in rows], pa.string())
    h, tf, offs = nd.weighted_sets(arr)
    doc = np.repeat(np.arange(len(rows)), np.diff(offs))
    seen = np.bincount(np.unique(doc * nd.SKETCH + nd.counter(h)) % nd.SKETCH, minlength=nd.SKETCH)
    idf = nd.idf_table(seen, len(rows))
    keys = nd.bands(nd.sample(h, (1 + np.log(tf)) * idf[nd.counter(h)], offs))
    sets = [(h[i:j], tf[i:j]) for i, j in zip(offs, offs[1:])]
    label = np.arange(len(rows))
    n = [0, 0]
    for a in range(len(rows)):
        for b in np.flatnonzero((keys[a + 1:] == keys[a]).any(1)) + a + 1:
            n[0] += 1
            if label[a] != label[b] and nd.similarity(*sets[a], *sets[b], idf) >= nd.THRESHOLD:
                label[label == label[b]] = label[a]
                n[1] += 1
    assert n[1] > 50 and n[0] > 20 * n[1]
    ids = np.array([d for d, _ in rows])
    return sorted(((int(d), int(ids[label == x].min())) for d, x in zip(ids, label)), key=str)
