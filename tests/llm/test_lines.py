"""Line dedup against brute force, and the bit-parallel distance against the plain one."""

import itertools
import random

import numpy as np
import pytest

from errorlab.llm import lines as ln


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        p = rnd.randrange(len(s))
        s[p:p + rnd.randrange(2)] = [rnd.choice("abé漢")] * rnd.randrange(2)
    return "".join(s)


def brute(rows):
    occ = sorted({(d, i, s) for d, t in rows if d is not None and t for i, s in enumerate(t.split("\n"))
                  if len(s) >= ln.LEAST})
    first = {}
    for d, i, s in occ:
        first.setdefault(s, (d, i))
    links, near = {s: 0 for s in first}, set()
    names = sorted(first, key=len)
    for x, s in enumerate(names):
        for t in names[x + 1:]:
            if len(t) - len(s) > ln.TAU:
                break
            if distance(s, t) <= ln.TAU:
                links[s] += 1
                links[t] += 1
                near.add(max(s, t, key=first.get))
    out = []
    for d, _ in rows:
        mine = [(i, s) for e, i, s in occ if e == d]
        gone = [i for i, s in mine if first[s] != (d, i) or s in near]
        out.append((d, sum(first[s] != (d, i) for i, s in mine),
                    sum(s in near and first[s] == (d, i) for i, s in mine),
                    sum(links[s] for i, s in mine if first[s] == (d, i)), gone))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_equal, r.n_near, r.n_links, list(r.gone)) for r in df.collect()), key=str)


def test_distance():
    rnd = random.Random(2)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abé漢 ") for _ in range(rnd.randrange(1, 40)))
        pairs.append((a, edited(rnd, a, rnd.randrange(5)) if rnd.random() < 0.8 else a[::-1]))
    to = lambda s: np.array([ord(c) for c in s], np.uint32)
    want = [min(distance(a, b), ln.TAU + 1) for a, b in pairs]
    assert ln.within([to(a) for a, _ in pairs], [to(b) for _, b in pairs]).tolist() == want


def test_planted(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefg é") for _ in range(rnd.randrange(14, 60))) for _ in range(60)]
    rows = []
    for d in range(80):
        lines = [edited(rnd, rnd.choice(base), rnd.randrange(4)) for _ in range(rnd.randrange(6))] + ["short"]
        rows.append((d * 3 % 80, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(ln.report(docs)) == brute(rows)


def test_odd_rows(spark, odd, empty):
    small = odd.where("doc_id is null or doc_id <> 9")
    assert got(ln.report(small)) == brute([(r.doc_id, r.text) for r in small.collect()])
    assert ln.report(empty).count() == 0
    out = ln.drop_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[6].startswith("alpha") and texts[7] == "" and texts[1] is None


def test_marks_never_rule_out_a_pair_within_two_edits():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = "".join(chr(c) for c in rng.integers(97, 105, rng.integers(16, 60)))
        b = a
        for _ in range(int(rng.integers(0, 3))):
            at, c = int(rng.integers(0, len(b) + 1)), chr(int(rng.integers(97, 105)))
            b = [b[:at] + c + b[at:], b[:at] + b[at + 1:], b[:at] + c + b[at + 1:]][int(rng.integers(0, 3))]
        buf, offs = ln.points([a, b])
        mark = ln.marks(buf, offs, offs[:-1], offs[1:])
        assert ln.may_link(mark[:1], mark[1:])[0]


def test_short_lines(spark):
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 16))) for _ in range(120)]
    pool += [s for n in (1, 2, 3) for s in map("".join, itertools.product("ab", repeat=n))]
    rows = [(d, "\n".join(rnd.choice(pool) for _ in range(6))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, first, links = ln.edit_join(docs)
    lines = sorted({s for _, t in rows for s in t.split("\n")})
    assert first.count() == len(lines) and seen.count() == 6 * len(rows)
    place = {(r.doc_id, r.number): r.line for r in first.collect()}
    name = {line: rows[d][1].split("\n")[i] for (d, i), line in place.items()}
    want = {(s, t): distance(s, t) for i, s in enumerate(lines) for t in lines[i + 1:]
            if distance(s, t) <= min(ln.TAU, max(len(s), len(t)) // 2)}
    assert {tuple(sorted((name[r.a], name[r.b]))): r.distance for r in links.collect()} == want
    counted = sum(r.n_equal for r in ln.report(docs).collect())
    assert counted == 6 * len(rows) - len(lines)


@pytest.mark.parametrize("parts", [1, 8, 64, 211])
def test_few_rows_over_any_number_of_partitions(spark, parts):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for texts in (["alpha beta gamma"], ["alpha beta gamma", "delta eps"], ["one line", "one line", "one lime"]):
            docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
            assert ln.drop_lines(docs).count() == len(texts)
            ln.report(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
