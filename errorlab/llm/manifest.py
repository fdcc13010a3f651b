"""Merkle dataset manifest: one digest for a table, and a proof for every row of it.

A row is a leaf.  Per source the leaves, in ascending order of their keys, form a tree of
runs of ``RUN`` nodes (the last run of a level may be shorter) up to one subroot; the
subroots, ordered by source, form the same tree up to the root.

Checkpoint and recompute: of the tree only every ``STEP``-th level is stored, as a table of
aligned subtrees (``RUN ** STEP`` nodes each, their *blocks*).  Building hashes each block
to the node above it, in one task per block.  Proofs go down the stored levels: a task
takes a block with the proof of the node above it, regenerates the missing interior nodes
from the stored ones, emits for each node its siblings on those levels followed by the
proof from above, and discards the rest.  At the leaves only digests of the proofs leave
the task.  Positions come from a range partition, with counts per part and source added
up along the parts, so a source with most rows is spread like any other rows.

Null sources form a source of their own, which comes first; leaves with a null key come
first in their source; equal keys are ordered by their leaves, and leaves that are equal
altogether are interchangeable (their copies are dealt to several parts).  Null fields
count as ``-``, empty ones as length 0.  An empty table has no rows and no root.  Only the
five columns are looked at; others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

RUN, STEP = 3, 4
BLOCK = RUN ** STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A place in a tree: tree, position, number of nodes on the level, digest; ``doc_id`` and
#: ``changed`` (the digest of the tampered row) at leaves, ``name`` (a tree below) at subroots.
NODE = "tree string, at long, total long, node string, doc_id long, changed string, name string"
BLOCKS = f"tree string, at long, total long, nodes array<struct<{NODE.replace('tree string, ', '').replace(' ', ':').replace(',:', ',')}>>"


def join(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], total: int) -> list[list[str]]:
    """The block's nodes on each level, up to ``STEP`` levels above, or to the only node."""
    out = [nodes]
    while total > 1 and len(out) <= STEP:
        out.append([join(out[-1][i:i + RUN]) for i in range(0, len(out[-1]), RUN)])
        total = -(-total // RUN)
    return out


def siblings(stack: list[list[str]], i: int) -> list[str]:
    """For node ``i`` of the lowest level ``left:right``, the digests beside it in its run,
    on each level below the top."""
    out = []
    for level in stack[:-1]:
        a = i - i % RUN
        out.append("".join(level[a:i]) + ":" + "".join(level[i + 1:a + RUN]))
        i //= RUN
    return out


def fold(node: str, proof: list[str]) -> str:
    """The root that a leaf and its proof give."""
    for step in proof:
        left, right = step.split(":")
        node = join([left, node, right])
    return node


def proof_digest(proof: list[str]) -> str:
    return join([step.replace(":", "") for step in proof])


def leaf(value: Callable[[str], Column]) -> Column:
    """The digest of a row whose fields, as strings, ``value`` gives."""
    def told(name: str) -> Column:
        v = value(name)
        return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))

    return F.sha2(F.concat(*[told(n) for n in FIELDS]), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """A row per leaf, without its place."""
    def original(name: str) -> Column:
        return F.col(name).cast("string")

    def tampered(name: str) -> Column:
        return F.regexp_replace(original(name), "\n", "") if name == "text" else original(name)

    source = original("source")
    return docs.select(
        # The null source comes first, the others in the order of their bytes.
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("tree"),
        leaf(original).alias("node"), F.col("doc_id").cast("long").alias("doc_id"),
        F.when(is_tampered(F.col("doc_id")) & F.contains(original("text"), F.lit("\n")), leaf(tampered)).alias("changed"),
        F.lit(None).cast("string").alias("name"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their places (``NODE``): ``at`` counts a tree's rows in ``order``."""
    keys = ["tree", *order, "copy"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.withColumn("copy", F.xxhash64(F.monotonically_increasing_id())), "manifest-rows")
    run = F.monotonically_increasing_id()  # part, and place in the part, of rows in order
    ordered = materialize(
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("part", F.shiftright(run, 33)).withColumn("place", run.bitwiseAND((1 << 33) - 1)).drop("copy"),
        "manifest-ordered")
    held = ordered.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")  # a row per part at most
    held = held.withColumn("total", F.sum("n").over(tree)) \
        .withColumn("before", F.sum("n").over(tree.orderBy("part")) - F.col("n"))
    return ordered.join(held, ["tree", "part"]).select(
        "tree", (F.col("place") - F.col("first") + F.col("before")).alias("at"), "total", "node", "doc_id", "changed", "name")


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """A stored level: the nodes of each aligned subtree in order."""
    one = F.struct("at", "total", "node", "doc_id", "changed", "name")
    own = F.floor(F.col("at") / BLOCK).cast("long")
    return materialize(
        nodes.groupBy("tree", own.alias("of")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(one)).alias("nodes"))
        .select("tree", F.col("of").alias("at"), "total", "nodes"), name)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_text, _long = pa.string(), pa.int64()
_NODE = pa.schema([("tree", _text), ("at", _long), ("total", _long), ("node", _text), ("doc_id", _long),
                   ("changed", _text), ("name", _text)])


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r["tree"], r["at"], -(-r["total"] // BLOCK), levels([x["node"] for x in r["nodes"]], r["total"])[-1][0],
                 None, None, None) for r in b.to_pylist()]
        if rows:
            yield _batch(rows, _NODE)


class Tree:
    """The stored levels of the trees over ``nodes`` (rows ``NODE``), leaves first."""

    def __init__(self, nodes: DataFrame, name: str):
        self.stored = [blocks(nodes, f"{name}-0")]
        largest = self.stored[0].agg(F.max("total")).first()[0] or 0
        while largest > BLOCK:  # every level is BLOCK times smaller
            largest = -(-largest // BLOCK)
            self.stored.append(blocks(self.stored[-1].mapInArrow(_tops, NODE), f"{name}-{STEP * len(self.stored)}"))

    def roots(self) -> DataFrame:
        """``tree, at, total, node``: the only node of each tree's last level."""
        return self.stored[-1].mapInArrow(_tops, NODE)


#: What comes down the tree: the proof of a node, and the subroot that it belongs to.
PROOFS = "tree string, at long, node string, name string, proof array<string>, subroot string"
_PROOFS = pa.schema([("tree", _text), ("at", _long), ("node", _text), ("name", _text), ("proof", pa.list_(_text)),
                     ("subroot", _text)])


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            stack = levels([x["node"] for x in r["nodes"]], r["total"])
            yield _batch([(r["tree"], x["at"], x["node"], x["name"], siblings(stack, i) + r["proof"], r["subroot"])
                          for i, x in enumerate(r["nodes"])], _PROOFS)


def extend(proofs: DataFrame, level: DataFrame) -> DataFrame:
    """The blocks of a stored level with the proof (and subroot) of the node above each."""
    return level.join(proofs.select("tree", "at", "proof", "subroot"), ["tree", "at"])


def proofs_of(tree: Tree, above: DataFrame, last: Callable | None = None, schema: str = PROOFS) -> DataFrame:
    """Take the proofs ``above`` (of the trees' roots) down to the leaves; ``last`` says what
    a task emits for a block of leaves."""
    for i, level in enumerate(reversed(tree.stored)):
        final = i == len(tree.stored) - 1
        step = extend(above, level).mapInArrow(last if final and last else _below, schema if final and last else PROOFS)
        above = step if final else materialize(step, "manifest-proofs")
    return above


MANIFEST = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
            "verified boolean")


def manifest(docs: DataFrame) -> DataFrame:
    """``MANIFEST``: for every row its leaf, subroot, the root, a digest of its proof, and
    the root that the (possibly tampered) row gives with the proof."""
    spark = docs.sparkSession
    below = Tree(numbered(leaves(docs), ["doc_id", "node"]), "manifest-leaves")
    subroots = below.roots()
    upper = subroots.select(F.lit("").alias("tree"), "node", F.lit(None).cast("long").alias("doc_id"),
                            F.lit(None).cast("string").alias("changed"), F.col("tree").alias("name"))
    above = Tree(numbered(upper, ["name"]), "manifest-subroots")
    top = above.roots().first()
    root = top["node"] if top else None
    start = spark.createDataFrame([("", 0, root, None, [], None)] if top else [], PROOFS)
    named = materialize(proofs_of(above, start), "manifest-subroot-proofs")
    start = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "node", "name", "proof",
                         F.col("node").alias("subroot"))

    def emit(batches):
        schema = pa.schema([("doc_id", _long), *((n, _text) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
                            ("verified", pa.bool_())])
        for b in batches:
            for r in b.to_pylist():
                stack = levels([x["node"] for x in r["nodes"]], r["total"])
                rows = []
                for i, x in enumerate(r["nodes"]):
                    proof = siblings(stack, i) + r["proof"]
                    folded = fold(x["changed"] or x["node"], proof)
                    rows.append((x["doc_id"], x["node"], r["subroot"], root, proof_digest(proof), folded, folded == root))
                yield _batch(rows, schema)

    return proofs_of(below, start, emit, MANIFEST)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """The CRC-32 of a decimal number's text, bit by bit (fixed value: the polynomial)."""
    shift = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    code = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    step = shift.replace("[x,", "[xor(crc, d),")
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {code}), lambda crc, d: {step}), 4294967295)"


def _field_sql(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


_LEAF_SQL = "sha256(" + " || ".join(_field_sql(n) for n in FIELDS) + ")"
_TAMPERED_SQL = "sha256(" + " || ".join(_field_sql("replace(text, chr(10), '')" if n == "text" else n) for n in FIELDS) + ")"


def _tree_sql(name: str, base: str) -> str:
    """Levels of the trees over ``base(tree, idx, node, total)``, then of every node its run."""
    return f"""
{name}(lvl, tree, idx, node, total) AS (
  SELECT 0, tree, idx, node, total FROM {base}
  UNION ALL
  SELECT max(lvl) + 1, tree, idx // {RUN}, sha256(string_agg(node, '' ORDER BY idx)), (max(total) + {RUN - 1}) // {RUN}
  FROM {name} WHERE total > 1 GROUP BY tree, idx // {RUN}),
{name}_run AS (
  SELECT a.lvl, a.tree, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.lvl = b.lvl AND a.tree = b.tree AND a.idx // {RUN} = b.idx // {RUN}
  WHERE a.total > 1 GROUP BY a.lvl, a.tree, a.idx)"""


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF_SQL} AS leaf,
         CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_TAMPERED_SQL} ELSE {_LEAF_SQL} END AS told
  FROM documents),
base AS (
  SELECT *, leaf AS node, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS total FROM d),
{_tree_sql('low', 'base')},
upper_base AS (
  SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS total
  FROM low WHERE total = 1),
{_tree_sql('high', 'upper_base')},
steps AS (
  SELECT b.doc_id, b.tree, b.idx, r.lvl AS k, r.l, r.r
  FROM base b JOIN low_run r ON r.tree = b.tree AND r.idx = b.idx // CAST(pow({RUN}, r.lvl) AS BIGINT)
  UNION ALL
  SELECT b.doc_id, b.tree, b.idx, 1000 + r.lvl, r.l, r.r
  FROM base b JOIN upper_base u ON u.name = b.tree JOIN high_run r ON r.idx = u.idx // CAST(pow({RUN}, r.lvl) AS BIGINT)),
proofs AS (
  SELECT tree, idx, string_agg(l || r, '' ORDER BY k) AS proof, list(struct_pack(l := l, r := r) ORDER BY k) AS path
  FROM steps GROUP BY tree, idx),
folded(tree, idx, node, path) AS (
  SELECT b.tree, b.idx, b.told, coalesce(p.path, []) FROM base b LEFT JOIN proofs p USING (tree, idx)
  UNION ALL
  SELECT tree, idx, sha256(path[1].l || node || path[1].r), path[2:] FROM folded WHERE len(path) > 0)
SELECT b.doc_id, b.leaf, u.node AS subroot, t.node AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.node AS folded_root, f.node = t.node AS verified
FROM base b JOIN upper_base u ON u.name = b.tree JOIN high t ON t.total = 1
JOIN folded f ON f.tree = b.tree AND f.idx = b.idx AND len(f.path) = 0 LEFT JOIN proofs p ON p.tree = b.tree AND p.idx = b.idx
"""
