"""Learned corruption against plain enumeration."""

import math
import random
from collections import Counter

from errorlab.operators import noise


def alignments(a, b):
    """All alignments of two strings as (cost, operations)."""
    def go(i, j, before):
        if i == len(a) and j == len(b):
            yield 0, ()
            return
        if i < len(a):
            for cost, ops in go(i + 1, j, a[i]):
                yield cost + 1, (("delete", a[i], ""), *ops)
        if j < len(b):
            for cost, ops in go(i, j + 1, before):
                yield cost + 1, (("insert", before, b[j]), *ops)
        if i < len(a) and j < len(b):
            same = a[i] == b[j]
            for cost, ops in go(i + 1, j + 1, a[i]):
                yield cost + (not same), (("match" if same else "replace", a[i], b[j]), *ops)

    return list(go(0, 0, noise.START))


def test_expectation_over_all_minimal_alignments():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(2))
        found = alignments(a, b)
        least = [ops for cost, ops in found if cost == min(c for c, _ in found)]
        want = Counter()
        for ops in least:
            for op in ops:
                want[op] += 1 / len(least)
        got = noise.expected_operations(a, b)
        assert set(got) == set(want) and all(math.isclose(got[o], want[o]) for o in want)


def test_estimate_counts_every_pair(spark):
    pairs = [("cat", "cut"), ("cat", "cut"), ("cat", "ct"), ("book", "bok"), ("a", "ab"), (None, "x"), ("x", None)]
    rows = noise.estimate(spark.createDataFrame(pairs, "correct string, error string").repartition(4)).collect()
    got = {(r.op, r.from_ch, r.to_ch): r.n / 1e6 for r in rows}
    assert got["replace", "a", "u"] == 2 and got["delete", "a", ""] == 1 and got["insert", "a", "b"] == 1
    assert got["delete", "o", ""] == 1 and got["match", "o", "o"] == 1  # either of the two o's


def test_weighted_distance_is_the_cheapest_alignment():
    rng = random.Random(2)
    rows = [("match", c, c, 50_000_000) for c in "abc"] + [("replace", "a", "b", 9_000_000), ("delete", "c", "", 4_000_000),
                                                         ("insert", "b", "a", 2_000_000), ("insert", "^", "c", 1_000_000)]
    model = noise.EditModel(rows)
    for _ in range(120):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(2))
        want = min(sum(0 if op[0] == "match" else model.cost.get(op, noise.UNSEEN) for op in ops) for _, ops in alignments(a, b))
        assert math.isclose(model.distance(a, b), want, abs_tol=1e-12)


def test_draws_follow_the_estimates(spark):
    rows = [("match", c, c, 10_000_000) for c in "ab"] + [("replace", "a", "x", 3_000_000), ("delete", "a", "", 1_000_000)]
    model = spark.createDataFrame(rows, "op string, from_ch string, to_ch string, n long")
    words = spark.range(4000).selectExpr("id as k", "'aaaa' as token")
    got = noise.corrupt(words, model, ["k"]).collect()
    again = {r.k: r.corrupted for r in noise.corrupt(words.repartition(7), model, ["k"]).collect()}
    assert all(again[r.k] == r.corrupted for r in got)
    shares = Counter("delete" if len(r.corrupted) == 3 else "replace" if "x" in r.corrupted[:4] and len(r.corrupted) == 4 else "start" for r in got)
    assert abs(shares["delete"] / (shares["delete"] + shares["replace"]) - 0.25) < 0.04
    place = Counter(r.corrupted.index("x") for r in got if len(r.corrupted) == 4)
    assert all(abs(place[i] / sum(place.values()) - 0.25) < 0.05 for i in range(4))


def test_short_and_unknown_words(spark):
    model = noise.EditModel([("match", "a", "a", 1_000_000), ("delete", "a", "", 1_000_000)])
    assert {model.corrupt("a", str(i), 3, 1) for i in range(20)} == {"a"}
    assert model.corrupt("", "k", 2, 1) == "" and noise.EditModel([]).corrupt("word", "k", 1, 1) == "word"
    assert all(len(model.corrupt("zzz", str(i), 1, 1)) in (2, 3) for i in range(20))
    docs = spark.createDataFrame([(1, None), (2, "")], "k int, token string")
    rows = spark.createDataFrame([("delete", "a", "", 5)], "op string, from_ch string, to_ch string, n long")
    assert sorted(noise.corrupt(docs, rows, ["k"]).select("k", "corrupted").collect()) == [(1, None), (2, "")]
