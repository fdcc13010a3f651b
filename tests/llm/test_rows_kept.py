"""Dropping stages by row, not by key: repeated rows, null keys, clashing columns, short items."""

from collections import Counter

import duckdb
import pytest

from errorlab.llm import decontaminate, exact_dedup, near_dedup, packing

LONG = "the quick brown fox jumps over the lazy dog near the river bank today"
OTHER = "entirely different words stand in this clean document about packing boxes"


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3, LONG), (7, LONG), (7, LONG), (7, OTHER), (None, LONG), (None, "a text that only null keys have here"),
            (None, "a text that only null keys have here"), (9, None), (9, ""), (8, ""), (11, LONG.upper())]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_one_row_per_text(docs):
    assert rows_of(exact_dedup.keep_one(docs)) in (
        Counter([(11, LONG.upper()), (7, OTHER), (None, "a text that only null keys have here"), (9, x)]) for x in (None, ""))


def test_one_row_per_class(docs):
    assert rows_of(near_dedup.keep_first(docs)) == Counter(
        [(3, LONG), (7, OTHER), (None, "a text that only null keys have here"), (9, None), (9, ""), (8, "")])


def test_clashing_columns(docs):
    names = ["_key", "text_sha256", "id", "row", "stays", "n", "node", "digest", "class", "component"]
    wide = docs.selectExpr("*", *[f"xxhash64(text) AS `{name}`" for name in names])
    for keep, n in ((exact_dedup.keep_one, 4), (near_dedup.keep_first, 6)):
        kept = keep(wide)
        assert kept.columns == wide.columns and kept.count() == n


def test_nothing_to_drop(docs):
    for keep in (exact_dedup.keep_one, near_dedup.keep_first):
        assert keep(docs.limit(0)).count() == 0


def test_short_and_nameless_items(spark):
    docs = spark.createDataFrame([(1, "It says: Hidden, Answer here"), (2, "the answer is hidden"), (3, None), (4, "xyzzy"),
                                  (5, f"some words before {LONG} and after"), (5, "clean"), (None, "hidden answer")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(10, "hidden answer"), (None, LONG), (11, "XYZZY!"), (12, ""), (13, None), (13, "?!"),
                                   (14, "four words are enough"), (10, "hidden answer")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contained(docs, items).collect())
    n = len(LONG.split()) - 4
    assert got == Counter({(1, 10, 1, 1): 2, (None, 10, 1, 1): 2, (4, 11, 1, 1): 1, (5, None, n, n): 1})
    assert rows_of(decontaminate.keep_clean(docs, items)) == Counter([(2, "the answer is hidden"), (3, None), (5, "clean")])
    assert Counter(map(tuple, decontaminate.contained(docs, items, block_shingles=1).collect())) == \
        Counter(map(tuple, decontaminate.contained(docs, items).collect()))
    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
        c.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in docs.collect()])
        c.executemany("INSERT INTO benchmark VALUES (?, ?)", [tuple(r) for r in items.collect()])
        assert Counter((d, i, s, m) for d, i, s, m, _ in c.execute(decontaminate.OP7_SQL).fetchall()) == got


@pytest.mark.parametrize("key", ["NULL", "7"])
def test_no_key_fills_a_shard(spark, key):
    sized = spark.range(3000).selectExpr(f"CAST({key} AS BIGINT) AS doc_id", "id % 300 AS n_words",
                                         "CAST(id % 50 AS STRING) AS source", "CAST(NULL AS STRING) AS cluster")
    rows = packing.pack_documents(sized, shard_docs=500).collect()
    held = Counter(r.shard for r in rows)
    assert len(rows) == 3000 and len(held) == 6 and max(held.values()) < 700
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append((r.start, r.n_words))
    for spans in bins.values():
        spans.sort()
        assert spans[-1][0] + spans[-1][1] <= packing.CAPACITY
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]) if n)


def test_pipeline_runs_and_takes_effect(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    words = packing.sizes_of(docs).agg({"n_words": "sum"}).first()[0]
    packed = corpus_pipeline.run(spark, sf)
    assert packed.agg({"n_words": "sum"}).first()[0] == words
