"""Fill-in-middle transformation: prefix, middle and suffix in another order.

A text is cut into units (a run of the letters A-Z in either case, or any other code
point).  Hashes of the key choose two places between units, which bound the middle, and
the form: ``psm`` writes prefix, suffix, middle, ``spm`` suffix, prefix, middle, each
behind its sentinel; ``plain`` texts stay as they are.

Assembly is a secondary sort.  The rows of a partition emit pieces of at most
``CHUNK_UNITS`` units, keyed by document and output position; one exchange by document and
a sort within partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form
of ``repartitionAndSortWithinPartitions``) bring them in output order, and a task streams
them into an incremental digest, holding one piece at a time.  Restoration reads that
stream as any reader of the output would: it knows only the form, finds the sentinels,
gives every piece its place in the text, and a second sort within the same partitions (no
exchange) streams the text into another digest.

A document's pieces are told apart by a digest of key, text, partition and the number of
the copy inside the partition, so repeated rows and rows with null or repeated keys are
documents of their own, none gathers in one task, and a recomputed task gives the same
keys.  A null key counts as the empty string where it is hashed.  Null and empty texts
are empty and plain; a text that holds a sentinel is plain.  An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table, text_steps

# Sentinels of prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
ORDERS = {"psm": (P, S, M), "spm": (S, P, M)}
PLACE = {P: 0, M: 1, S: 2}
PLAIN_FROM, SPM_BELOW = 90, 20
#: A piece holds so many units, and so many code points where units are long.
CHUNK_UNITS = 4096
CHUNK_CHARS = 1 << 16

HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"key binary, position int, {HEAD}, piece binary"


def unit_starts(text: str) -> np.ndarray:
    """The code point at which each unit begins."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((code | 32) - np.uint32(97)) < 26
    begins = ~letter
    begins[1:] |= ~letter[:-1]
    begins[:1] = True
    return np.flatnonzero(begins)


def layout(doc_id: int | None, text: str) -> tuple[int, str, np.ndarray, int, int]:
    """Number of units, form, unit starts with the text's end, and the units at which the
    middle begins and ends."""
    digest = hashlib.sha256(b"1:%s" % str("" if doc_id is None else doc_id).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    starts = unit_starts(text)
    n = len(starts)
    if not text or any(x in text for x in PLACE) or h3 % 100 >= PLAIN_FROM:
        form = "plain"
    else:
        form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, form, np.append(starts, len(text)), lo, hi


def pieces_of(text: str, starts: np.ndarray, lo: int, hi: int) -> Iterator[str]:
    """The units ``lo`` to ``hi`` in pieces of bounded size."""
    cuts = [*starts[lo:hi:CHUNK_UNITS].tolist(), int(starts[hi])]
    for a, b in zip(cuts, cuts[1:]):
        for at in range(a, b, CHUNK_CHARS):
            yield text[at:min(b, at + CHUNK_CHARS)]


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    copies: Counter[bytes] = Counter()
    for b in text_steps(batches):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            own = hashlib.blake2b(b"%s:%d:" % (str(doc_id).encode(), part) + text.encode(), digest_size=16).digest()
            key = hashlib.blake2b(own + b"%d" % copies[own], digest_size=16).digest()
            copies[own] += 1
            n, form, starts, lo, hi = layout(doc_id, text)
            if form == "plain":
                sizes = None, None
                parts = list(pieces_of(text, starts, 0, n))
            else:
                sizes = int(starts[lo]), int(starts[hi] - starts[lo])
                bounds = {P: (0, lo), M: (lo, hi), S: (hi, n)}
                parts = []
                for mark in ORDERS[form]:
                    first = len(parts)
                    parts += pieces_of(text, starts, *bounds[mark]) if bounds[mark][0] < bounds[mark][1] else [""]
                    parts[first] = mark + parts[first]
            # The document's facts stand on its first row, which carries no text.
            rows.append((key, -1, doc_id, n, form, *sizes, b""))
            rows += [(key, i, None, None, None, None, None, p.encode()) for i, p in enumerate(parts)]
        yield batch(rows, PIECES)


ARROW = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


#: Rows, or bytes of pieces, after which a task sends what it has.
SEND_ROWS, SEND_BYTES = 4096, 4 << 20


def sent(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= SEND_ROWS or size >= SEND_BYTES:
            yield batch(held, schema)
            held, size = [], 0
    if held:
        yield batch(held, schema)


def assembled(docs: DataFrame) -> DataFrame:
    """The output of every document, as rows ``PIECES`` in output order: a row with the
    document's facts (position -1), then its pieces."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pick(docs).mapInArrow(emit, PIECES).repartition(parts, "key").sortWithinPartitions("key", "position")


class Reader:
    """Gives each piece of one output, read in order, its place in the text."""

    def __init__(self, form: str):
        self.left = [m.encode() for m in ORDERS.get(form, ())]
        self.place = 0

    def __call__(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        while self.left and (at := piece.find(self.left[0])) >= 0:  # no piece cuts a sentinel in two
            if at:
                yield self.place, piece[:at]
            mark = self.left.pop(0)
            self.place = PLACE[mark.decode()]
            piece = piece[at + len(mark):]
        if piece:
            yield self.place, piece


DIGESTED = f"key binary, place int, number int, {HEAD}, output_sha256 string, piece binary"
RESTORED = f"{HEAD}, output_sha256 string, restored_sha256 string"


def read_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the outputs and emit their pieces by place in the text, behind a row
    (place -1) with the document's facts and the digest."""
    def rows():
        facts = digest = reader = None
        number = 0

        def over():
            return (*facts[:1], -1, 0, *facts[1:], digest.hexdigest(), b"")

        for key, position, doc_id, n, form, prefix, middle, piece in rows_of(batches):
            if position < 0:
                if facts:
                    yield over()
                facts, digest, reader, number = (key, doc_id, n, form, prefix, middle), hashlib.sha256(), Reader(form), 0
                continue
            digest.update(piece)
            for place, part in reader(piece):
                yield (key, place, number, None, None, None, None, None, None, part)
                number += 1
        if facts:
            yield over()

    return sent(rows(), DIGESTED)


def digest_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        facts = digest = None
        for _, place, _, doc_id, n, form, prefix, middle, output, piece in rows_of(batches):
            if place >= 0:
                digest.update(piece)
                continue
            if facts:
                yield (*facts, digest.hexdigest())
            facts, digest = (doc_id, n, form, prefix, middle, output), hashlib.sha256()
        if facts:
            yield (*facts, digest.hexdigest())

    return sent(rows(), RESTORED)


def restored(docs: DataFrame) -> DataFrame:
    """Pieces of every text as read back from its output, in text order (rows ``DIGESTED``)."""
    return assembled(docs).mapInArrow(read_output, DIGESTED).sortWithinPartitions("key", "place", "number")


def outputs(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: whole outputs, one in memory at a time."""
    schema = f"{HEAD}, output string"

    def join(batches):
        def rows():
            facts, parts = None, []
            for _, position, *head, piece in rows_of(batches):
                if position < 0:
                    if facts:
                        yield (*facts, b"".join(parts).decode())
                    facts, parts = head, []
                else:
                    parts.append(piece)
            if facts:
                yield (*facts, b"".join(parts).decode())

        return sent(rows(), schema)

    return assembled(docs).mapInArrow(join, schema)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return restored(table(spark, sf_dir, "documents")).mapInArrow(digest_text, RESTORED) \
        .select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("restored_sha256"))


OP12_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents),
u AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a,
         CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d
  FROM t),
v AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n,
         CASE WHEN text = '' OR contains(text, '{P}') OR contains(text, '{S}') OR contains(text, '{M}')
                OR c >= {PLAIN_FROM} THEN 'plain' WHEN d < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(a, b)], '') AS p,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(units[greatest(a, b) + 1:], '') AS s
  FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{P}' || p || '{S}' || s || '{M}' || m
                        ELSE '{S}' || s || '{P}' || p || '{M}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM v
"""
