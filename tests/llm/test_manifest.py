"""The manifest against a tree built in plain Python from all leaves at once."""

import hashlib
import zlib

import duckdb
import pytest

from errorlab.llm import manifest as mf


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    fields = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """The root and each node's siblings per level, as (left, right)."""
    paths, own, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(now) > 1:
        up, groups = [], []
        for a in range(0, len(now), 3):
            run = now[a:a + 3]
            for k in range(len(run)):
                for i in own[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(H(*run))
            groups.append(sum(own[a:a + 3], []))
        now, own = up, groups
    return now[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault((r.source is not None, (r.source or "").encode()), []).append(r)
    made = []
    for s in sorted(by_source):
        mine = sorted(((r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)), r) for r in by_source[s]) \
            if all(r.doc_id is not None for r in by_source[s]) else \
            sorted((((r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)), r) for r in by_source[s]), key=lambda x: x[0])
        made.append((mine, tree([k[2] for k, _ in mine])))
    root, upper = tree([sub for _, (sub, _) in made])
    out = []
    for (mine, (sub, paths)), above in zip(made, upper):
        for (key, r), path in zip(mine, paths):
            path = path + above
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = brute_leaf(r, text)
            for left, right in path:
                node = H(left, node, right)
            out.append((r.doc_id, key[2], sub, root, H(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def check(spark, docs):
    got = sorted((tuple(r) for r in mf.manifest(docs).collect()), key=str)
    assert got == brute(docs.collect())
    return got


def test_levels_and_proofs():
    for n in (*range(1, 30), 80, 81):
        nodes = [H(str(i)) for i in range(n)]
        root, paths = tree(nodes)
        stack = mf.levels(nodes, n)
        assert stack[-1] == [root]
        for i in range(n):
            proof = mf.siblings(stack, i)
            assert proof == [f"{a}:{b}" for a, b in paths[i]]
            assert mf.fold(nodes[i], proof) == root and mf.fold(H("other"), proof) != root


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [3, 4], [81, 82, 1], [243, 244, 7], [700]])
def test_sizes(spark, sizes):
    rows, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((k * 37 % 10_007, f"text {k}\nline", "en", f"s{s}", k))
            k += 1
    got = check(spark, spark.createDataFrame(rows, FIELDS).repartition(5))
    assert {g[6] for g in got} <= {True, False} and (len(rows) < 5 or {g[6] for g in got} == {True, False})


def test_many_sources(spark):
    check(spark, spark.createDataFrame([(i, f"t{i}\n", "en", f"source{i % 131}é", i) for i in range(400)], FIELDS))


def test_odd_rows(spark, odd, empty):
    docs = odd.withColumn("n_chars", mf.F.when(mf.F.col("bucket") % 2 == 0, mf.F.col("bucket").cast("long"))) \
        .withColumn("tree", mf.F.lit("x")).withColumn("at", mf.F.lit("y")).withColumn("copy", mf.F.lit(1))
    docs = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id is null"))
    got = check(spark, docs.select(*docs.columns))
    assert len(got) == docs.count()
    assert mf.manifest(docs.limit(0)).count() == 0
    assert mf.manifest(docs.limit(0)).columns == mf.manifest(docs).columns


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(5, "same", "en", "hot", 4)] * 3000 + [(i, "x\n", "en", "hot", 1) for i in range(300)], FIELDS)
    leaves = mf.numbered(mf.leaves(docs.repartition(8)), ["doc_id", "node"])
    assert sorted(r.at for r in leaves.collect()) == list(range(3300))
    check(spark, docs)


def test_query_and_sql(spark, sf):
    got = mf.op11_merkle_manifest(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == brute(docs.collect()) and {r[6] for r in rows} == {True, False}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        told = c.execute(mf.OP11_SQL)
        assert [d[0] for d in told.description] == got.columns
        assert sorted(told.fetchall(), key=str) == rows
