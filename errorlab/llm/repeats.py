"""Suffix-array dedup: remove repeated passages, keep their first occurrence.

Texts are UTF-8 bytes (null: empty).  A byte goes if a string of ``LENGTH`` bytes that
covers it also starts in a document with a smaller key; matches never cross documents
and are judged on the input.

1. Every string of ``LENGTH`` bytes has an anchor: the leftmost of its ``K``-byte grams
   with the smallest hash.  Equal strings have equal anchors, so only strings whose
   anchor occurs in two documents need a comparison.  Tasks send one entry per anchor
   (40 bits of its hash, the owning task goes by the others; a chance agreement costs a
   comparison and changes nothing) and
   tell at once which of their own documents share it, so an anchor that a third of
   all documents hold costs one entry per task.
2. The texts and their shared anchors are written once, bucketed by key, so that they
   are exchanged once.  Regions around shared anchors are compared where they are: a
   suffix array over their starts, the common prefixes of its neighbours (counted up to
   ``LENGTH`` bytes), the previous and the next place in suffix order with a smaller
   key, and from these the longest previous factor of each start.  A start whose factor
   has ``LENGTH`` bytes has an earlier match.  Of segments around one anchor that agree
   byte by byte only that of the smallest key enters the arrays: at each start of the
   others it is the earlier match.
3. What found no earlier match goes on, with its ``LENGTH - K`` bytes on either side, to
   the task that owns the anchor, and the same arrays are built over all documents'
   regions there.
4. The starts found meet the documents' texts in their buckets.

What an owner finds, shared anchors and starts, goes back packed, one row per bucket of
documents, and becomes one row per document there: a document whose anchors many tasks
own costs one row, not one per owner.

Keys order the documents: rows without a key, or with equal keys, never clear each
other, and a row without a key loses nothing.  Rows that repeat a key share what was found for it, each
cut by its own length.  Texts under ``LENGTH`` bytes lose nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, materialize, pick, scratch_path, table, text_steps, utf8
from .hashing import mix, prefix, span

LENGTH = 50
K = 24
WINDOW = LENGTH - K + 1
#: Entries or bytes after which a task compares what it has gathered.
FLUSH = 3 << 20
#: Bytes of an anchor's hash that travel; the bits above them choose the owner.
KEY = 5
LOW = np.uint64((1 << 8 * KEY) - 1)
PACKED = "bucket long, docs binary, found binary"
#: Bytes of a run of starts: the first one and their number.
RUN = 8


def _owner(key: np.ndarray, parts: int) -> np.ndarray:
    return (key >> np.uint64(8 * KEY)) % np.uint64(parts)


def _planes(values: np.ndarray, width: int = 8) -> bytes:
    """The lowest ``width`` bytes of 64-bit numbers, byte by byte rather than number by
    number: what neighbours share packs well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, width: int = 8) -> np.ndarray:
    at = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((at.shape[1], 8), np.uint8)
    out[:, :width] = at.T
    return out.view(np.uint64).ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first value first; a running sum undoes it."""
    values = values.astype(np.int64).view(np.uint64)
    return np.diff(values, prepend=np.uint64(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64).view(np.int64)


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each position the index of the first smallest value among ``width`` ones."""
    at, have = np.arange(len(h), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return at


def anchors(buf: np.ndarray, offs: np.ndarray):
    """Segments of window starts with one anchor: its hash, the text, the
    first start (in ``buf``), the number of starts and the anchor's place from the first."""
    empty = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return empty.astype(np.uint64), empty, empty, empty, empty
    pre = prefix(buf)
    at = np.arange(len(buf) - K + 1)
    h = span(pre, at, at + K)
    anchor = _leftmost_minima(h, WINDOW)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    n = len(anchor)
    valid = doc[:n] == doc[LENGTH - 1:LENGTH - 1 + n]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(valid, first) if len(first) else empty
    # A segment ends where the next begins or where windows stop being valid.
    key = mix(h[anchor[first]])  # the smallest of many hashes has few high bits
    return key, doc[first], first, size.astype(np.int64), anchor[first] - first


def _split(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, with the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _shared(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(hash, doc)`` in order, and whether the hash has two documents."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    cut = _split(h)
    return h, doc, np.repeat(np.diff(cut) > 1, np.diff(cut))


def _by_doc(h: np.ndarray, doc: np.ndarray, parts: int) -> pa.RecordBatch:
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    cut = _split(doc)
    docs = doc[cut[:-1]] if len(doc) else doc
    data = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()
    none = pa.array([None] * len(docs), pa.binary())
    return pa.RecordBatch.from_arrays(
        [longs(mix(docs.view(np.uint64)) % np.uint64(parts)), longs(docs),
         pa.array([data[KEY * i:KEY * j] for i, j in zip(cut, cut[1:])][:len(docs)], pa.binary()), none, none],
        ["bucket", "doc_id", "hashes", "docs", "places"])


def _packed(doc: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """``bucket, docs, found``: the documents of a bucket in order and a row of bytes for
    each, in one row per bucket."""
    packer = zstandard.ZstdCompressor(level=1)
    bucket = mix(doc.view(np.uint64)) % np.uint64(parts)
    order = np.lexsort((doc, bucket))
    bucket, doc, values = bucket[order], doc[order], values[order]
    cut = _split(bucket)
    return pa.RecordBatch.from_arrays(
        [longs(bucket[cut[:-1]]),
         pa.array([packer.compress(_planes(_steps(doc[i:j]))) for i, j in zip(cut, cut[1:])], pa.binary()),
         pa.array([values[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["bucket", "docs", "found"])


def _expand(keys: pa.Array, data: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ``width`` bytes each, from rows of a key and the bytes of all that it has."""
    values = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(-1, width)
    size = np.diff(utf8(data)[1]) // width
    return np.repeat(keys.to_numpy(), size), values


def by_document(packed: DataFrame, parts: int, name: str, width: int) -> DataFrame:
    """``doc_id, <name>``: one row per document with all that any task found for it."""

    def unpack(batches):
        reader = zstandard.ZstdDecompressor()
        docs, found = [], []
        for b in batches:
            for d, x in zip(b.column("docs"), b.column("found")):
                docs.append(_sums(_numbers(reader.decompress(d.as_buffer()))))
                found.append(np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width))
        if docs:
            doc, found = np.concatenate(docs), np.concatenate(found)
            order = np.argsort(doc, kind="stable")
            doc, data = doc[order], found[order].tobytes()
            cut = _split(doc)
            yield pa.RecordBatch.from_arrays(
                [longs(doc[cut[:-1]]), pa.array([data[width * i:width * j] for i, j in zip(cut, cut[1:])], pa.binary())],
                ["doc_id", name])

    return packed.repartition(parts, "bucket").mapInArrow(unpack, f"doc_id long, {name} binary")


def shared_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, hashes``: anchors that the document shares with another one, in one row."""

    def count(batches):
        packer = zstandard.ZstdCompressor(level=1)
        hs, ds, held = [], [], 0

        def flush():
            h, doc, many = _shared(np.concatenate(hs), np.concatenate(ds))
            if many.any():
                yield _by_doc(h[many], doc[many], parts)
            first = _split(h)[:-1]
            h, doc = h[first], doc[first]
            owner = _owner(h, parts)
            order = np.lexsort((h & LOW, owner))
            h, doc, owner = h[order], doc[order], owner[order]
            cut = _split(owner)
            packed = []
            for i, j in zip(cut[:-1], cut[1:]):
                known, place = np.unique(doc[i:j], return_inverse=True)
                packed.append([packer.compress(x) for x in (
                    _planes(h[i:j], KEY), _planes(_steps(known)), _planes(place.astype(np.int64), 4))])
            blobs = [pa.array(list(x), pa.binary()) for x in zip(*packed)]
            yield pa.RecordBatch.from_arrays(
                [longs(owner[cut[:-1]]), pa.array([None] * len(packed), pa.int64()), *blobs],
                ["bucket", "doc_id", "hashes", "docs", "places"])

        for b in text_steps(batches):
            h, d, *_ = anchors(*utf8(b.column("text")))
            if len(h):
                hs.append(h)
                ds.append(b.column("doc_id").to_numpy()[d])
                held += len(h)
            if held > FLUSH:
                yield from flush()
                hs, ds, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches):
        reader = zstandard.ZstdDecompressor()
        hs, ds, docs, found = [], [], [], []
        for b in batches:
            told = b.filter(pa.array(~np.array(b.column("doc_id").is_null())))
            if told.num_rows:
                doc, data = _expand(told.column("doc_id"), told.column("hashes"), KEY)
                docs.append(doc)
                found.append(data)
            for row in zip(b.column("hashes"), b.column("docs"), b.column("places")):
                if row[1].is_valid:
                    h, known, place = (reader.decompress(x.as_buffer()) for x in row)
                    hs.append(_numbers(h, KEY))
                    ds.append(_sums(_numbers(known))[_numbers(place, 4).astype(np.int64)])
        if hs:
            h, doc, many = _shared(np.concatenate(hs), np.concatenate(ds))
            docs.append(doc[many])
            found.append(np.ascontiguousarray(h[many]).view(np.uint8).reshape(-1, 8)[:, :KEY])
        if sum(map(len, docs)):
            yield _packed(np.concatenate(docs), np.concatenate(found), parts)

    schema = "bucket long, doc_id long, hashes binary, docs binary, places binary"
    packed = docs.mapInArrow(count, schema).repartition(parts, "bucket").mapInArrow(meet, PACKED)
    return by_document(packed, parts, "hashes", KEY)


def suffix_order(buf: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the given starts by their first ``LENGTH`` bytes, ties by key,
    and the common prefix of each suffix with the one before it, up to ``LENGTH`` bytes."""
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.zeros(len(buf), np.uint64)  # eight bytes from each position, as a number
    for j in range(8):
        word = (word << np.uint64(8)) | wide[j:j + len(buf)]
    places = (*range(0, LENGTH - 8, 8), LENGTH - 8)
    keys = [word[starts + j] for j in places]
    order = np.lexsort((doc, *keys[::-1]))
    lcp = np.full(len(starts), LENGTH, np.int16)
    for j, k in reversed(list(zip(places, keys))):
        k = k[order]
        differ = k[1:] ^ k[:-1]
        at = np.flatnonzero(differ)
        # Whole bytes that agree before the highest bit that differs.
        agree = np.zeros(len(at), np.int16)
        for byte in range(1, 8):
            agree += differ[at] < np.uint64(1) << np.uint64(64 - 8 * byte)
        lcp[at + 1] = j + agree
    lcp[:1] = 0
    return order, lcp


def _smaller_before(key: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of a suffix array the common prefix with the nearest place before
    it that has a smaller key (0: none).  ``lcp`` is that of each place with the one
    before.  Pointers double: a place whose neighbour is not smaller takes over the
    neighbour's pointer; it gives up below ``LENGTH``, where the answer has no use."""
    at = np.arange(len(key)) - 1
    low = lcp.copy()
    live = np.flatnonzero(low >= LENGTH)
    live = live[key[at[live]] >= key[live]]
    while len(live):
        via = at[live]
        reach, least = at[via], np.minimum(low[live], low[via])
        at[live], low[live] = reach, least
        live = live[(least >= LENGTH) & (reach >= 0)]
        live = live[key[at[live]] >= key[live]]
    return low


def previous_factor(key: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each place of a suffix array, up to ``LENGTH``: its
    longest common prefix with a suffix of a smaller key, which is the nearest of these
    before or after it.  Lengths under ``LENGTH`` are upper bounds."""
    before = _smaller_before(key, lcp)
    after = _smaller_before(key[::-1], np.append(lcp[1:], lcp.dtype.type(0))[::-1])[::-1]
    return np.maximum(before, after)


def earlier(buf: np.ndarray, starts: np.ndarray, doc: np.ndarray, pre: np.ndarray | None = None) -> np.ndarray:
    """Whether the longest previous factor at each start, among the documents with a
    smaller key, has ``LENGTH`` bytes.  Only starts whose hash occurs twice enter the
    arrays; all others have a shorter one."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    h = span(prefix(buf) if pre is None else pre, starts, starts + LENGTH)
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    order, lcp = suffix_order(buf, starts[at], doc[at])
    out[at[order]] = previous_factor(doc[at][order], lcp) >= LENGTH
    return out


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions ``first[i] .. first[i] + size[i] - 1``."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _keys(data: bytes) -> np.ndarray:
    """Anchor hashes written one after the other, ``KEY`` bytes each."""
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return out.view(np.uint64).ravel()


def _grams(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for the ``K`` bytes at each position."""
    out = np.zeros(len(at), np.uint64)
    for j in (*range(0, K - 8, 8), K - 8):
        out = mix(out + buf[(at + j)[:, None] + np.arange(8)].view(np.uint64)[:, 0])
    return out


def matched(buf: np.ndarray, key: np.ndarray, at: np.ndarray, doc: np.ndarray, size: np.ndarray,
            place: np.ndarray) -> np.ndarray:
    """:func:`earlier` for all starts of segments that lie at ``at``, one after the other.
    A segment that equals one of a smaller key byte by byte has an earlier match at each
    start and adds nothing to the others' answers; a segment whose anchor no other one
    has, has none.  Only the starts of the rest enter the arrays."""
    width = size + LENGTH - 1
    pre = prefix(buf)
    whole = mix(span(pre, at, at + width) + mix(size << 8 | place))
    order = np.lexsort((doc, whole))
    cut = _split(whole[order])[:-1]
    first = np.zeros(len(order), np.int64)
    first[cut] = cut
    model = np.empty(len(order), np.int64)
    model[order] = order[np.maximum.accumulate(first)]
    later = np.flatnonzero((doc[model] < doc) & (size[model] == size))
    if len(later):
        w = width[later]
        same = buf[_spread(at[later], w)] == buf[_spread(at[model[later]], w)]
        later = later[np.logical_and.reduceat(same, np.cumsum(w) - w)]
    copies = np.zeros(len(order), bool)
    copies[later] = True
    hit = np.repeat(copies, size)
    rest = np.flatnonzero(~copies)
    _, group, n = np.unique(key[rest], return_inverse=True, return_counts=True)
    rest = rest[n[group] > 1]
    if len(rest):
        flat = np.cumsum(size) - size
        hit[_spread(flat[rest], size[rest])] = earlier(
            buf, _spread(at[rest], size[rest]), np.repeat(doc[rest], size[rest]), pre)
    return hit


def _found(hit: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The starts that are ``hit``, per document as runs ``(first start, number)``."""
    cut = np.cumsum(size) - size
    edge = np.zeros(len(hit) + 1, bool)
    edge[cut] = edge[-1] = True
    begin = hit.copy()
    begin[1:] &= edge[1:-1] | ~hit[:-1]
    end = hit.copy()
    end[:-1] &= edge[1:-1] | ~hit[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    seg = np.searchsorted(cut, begin, "right") - 1
    doc, first, n = doc[seg], first[seg] + begin - cut[seg], end - begin + 1
    order = np.lexsort((first, doc))
    doc, first, n = doc[order], first[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + n[:-1])
    lead = np.flatnonzero(new)
    doc, first, n = doc[lead], first[lead], np.add.reduceat(n, lead)
    runs = np.column_stack([first, n]).astype(np.uint32)
    cut = _split(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array([None] * (len(cut) - 1), pa.int64()), longs(doc[cut[:-1]]),
         pa.array([runs[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
         pa.array([None] * (len(cut) - 1), pa.binary())], ["bucket", "doc_id", "a", "b"])


def covered_starts(suspects: DataFrame, parts: int) -> DataFrame:
    """``doc_id, starts``: window starts with an earlier match, as runs of neighbours, in
    one row per document."""

    def local(batches):
        segs, text, held = [], [], 0

        def flush():
            h, doc, first, size, place, region_at = (np.concatenate(x) for x in zip(*segs))
            buf = np.concatenate(text)
            hit = matched(buf, h, region_at, doc, size, place)
            if hit.any():
                yield _found(hit, doc, first, size)
            cut = np.cumsum(size) - size
            open_ = np.add.reduceat(~hit, cut) > 0
            h, doc, first, size, place, region_at = (x[open_] for x in (h, doc, first, size, place, region_at))
            owner = _owner(h, parts)
            for p in np.unique(owner):
                mine = np.flatnonzero(owner == p)
                rows = _planes(_steps(doc[mine])) + _planes(first[mine]) + _planes(size[mine] << 8 | place[mine], 2)
                parts_of = buf[_spread(region_at[mine], size[mine] + LENGTH - 1)]
                yield pa.RecordBatch.from_arrays(
                    [longs([p]), pa.array([None], pa.int64()), pa.array([packer.compress(rows)], pa.binary()),
                     pa.array([packer.compress(parts_of.tobytes())], pa.binary())], ["bucket", "doc_id", "a", "b"])

        packer = zstandard.ZstdCompressor(level=3)
        for b in text_steps(batches):
            buf, offs = utf8(b.column("text"))
            h, d, first, size, place = anchors(buf, offs)
            lists = [_keys(xs) for xs in b.column("hashes").to_pylist()]
            known = np.concatenate([mix(x + mix(np.array([i], np.uint64))) for i, x in enumerate(lists)])
            ok = np.isin(mix((h & LOW) + mix(d.astype(np.uint64))), known)
            h, d, first, size, place = h[ok], d[ok], first[ok], size[ok], place[ok]
            if not len(h):
                continue
            # Neighbouring segments share their bytes: regions are maximal runs of starts.
            joined = (d[1:] == d[:-1]) & (first[1:] == first[:-1] + size[:-1])
            begin = np.concatenate([[True], ~joined])
            r_first = first[begin]
            r_end = (first + size)[np.append(~joined, True)] + LENGTH - 1
            r_at = np.cumsum(r_end - r_first) - (r_end - r_first)
            text.append(buf[_spread(r_first, r_end - r_first)])
            region = np.cumsum(begin) - 1
            segs.append((h, b.column("doc_id").to_numpy()[d], first - offs[d], size, place,
                         r_at[region] + first - r_first[region] + held))
            held += len(text[-1])
            if held > FLUSH:
                yield from flush()
                segs, text, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches):
        docs, found = [], []
        for told in compare(batches):
            doc, runs = _expand(told.column("doc_id"), told.column("a"), RUN)
            docs.append(doc)
            found.append(runs)
        if sum(map(len, docs)):
            yield _packed(np.concatenate(docs), np.concatenate(found), parts)

    def compare(batches):
        """Rows ``doc_id, a`` of what was found before and of what is found here."""
        reader = zstandard.ZstdDecompressor()
        rows, texts = [], []
        for b in batches:
            told = b.filter(pa.array(np.array(b.column("bucket").is_null())))
            if told.num_rows:
                yield told
            for a, t in zip(b.column("a"), b.column("b")):
                if t.is_valid:
                    a = reader.decompress(a.as_buffer())
                    n = len(a) // 18
                    doc, first = _sums(_numbers(a[:8 * n])), _numbers(a[8 * n:16 * n]).view(np.int64)
                    shape = _numbers(a[16 * n:], 2).astype(np.int64)
                    rows.append(np.column_stack([shape & 255, doc, first, shape >> 8]))
                    texts.append(np.frombuffer(reader.decompress(t.as_buffer()), np.uint8))
        if not rows:
            return
        rows, buf = np.concatenate(rows), np.concatenate(texts)
        size = rows[:, 3] + LENGTH - 1
        at = np.cumsum(size) - size
        anchor = _grams(buf, at + rows[:, 0])
        order = np.argsort(anchor, kind="stable")
        rows, size, at, anchor = rows[order], size[order], at[order], anchor[order]
        cut = _split(anchor)
        ends = np.cumsum(size)
        lo = 0
        while lo < len(rows):  # whole anchors, about FLUSH bytes at a time
            full = np.searchsorted(ends, ends[lo] - size[lo] + FLUSH)
            hi = cut[min(np.searchsorted(cut, full, "right"), len(cut) - 1)]
            place, doc, first, n = rows[lo:hi].T.copy()
            local_at = np.cumsum(size[lo:hi]) - size[lo:hi]
            hit = matched(buf[_spread(at[lo:hi], size[lo:hi])], anchor[lo:hi], local_at, doc, n, place)
            if hit.any():
                yield _found(hit, doc, first, n)
            lo = hi

    packed = suspects.mapInArrow(local, "bucket long, doc_id long, a binary, b binary") \
        .repartition(parts, F.coalesce("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))) \
        .mapInArrow(meet, PACKED)
    return by_document(packed, parts, "starts", RUN)


def cut(text: bytes, runs_: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes that stay, how many went and in how many runs; ``runs_`` are rows of
    first start and number of starts."""
    gone = np.zeros(len(text) + 1, np.int32)
    first = runs_[:, 0]
    n = np.minimum(runs_[:, 1], len(text) - LENGTH + 1 - first)
    first, n = first[n > 0], n[n > 0]
    np.add.at(gone, first, 1)
    np.add.at(gone, first + n + LENGTH - 1, -1)
    out = np.cumsum(gone[:-1]) > 0
    runs = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~out].tobytes(), int(out.sum()), runs


def bucketed(df: DataFrame, parts: int) -> DataFrame:
    """``df`` as written to the shared folder, bucketed by key: joins by key find it
    dealt.  The files outlive the name, which only this call needs."""
    spark = df.sparkSession
    name = f"suspects_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, "doc_id").option("path", scratch_path(spark, "suspects")) \
        .option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per row; ``kept`` holds the bytes that stay."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = pick(docs)
    keyed = docs.where(F.col("doc_id").isNotNull())
    lists = shared_anchors(keyed, parts)
    some = F.col("hashes").isNotNull()
    seen = bucketed(keyed.hint("merge").join(lists, "doc_id", "left"), parts)
    suspects = seen.where(some)
    clean = seen.where(~some).select("doc_id", "text").unionByName(docs.where(F.col("doc_id").isNull()))
    starts = materialize(covered_starts(suspects, parts), "starts")

    def apply(batches):
        for b in text_steps(batches):
            rows = []
            for t, xs in zip(b.column("text"), b.column("starts").to_pylist()):
                text = t.as_buffer().to_pybytes() if len(t.as_buffer() or b"") else b""
                at = np.frombuffer(xs or b"", np.uint32).reshape(-1, 2).astype(np.int64)
                kept, gone, spans_ = cut(text, at)
                rows.append((len(text), gone, spans_, hashlib.sha256(kept).hexdigest(), kept))
            n, gone, spans_, sha, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), longs(n), longs(gone), longs(spans_), pa.array(sha), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = suspects.select("doc_id", "text").hint("merge").join(starts, "doc_id", "left") \
        .select("doc_id", "text", "starts").mapInArrow(apply, schema)
    zero = F.lit(0).cast("long")
    data = F.col("text").cast("binary")
    rest = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"),
                        zero.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), data.alias("kept"))
    return done.unionByName(rest)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
