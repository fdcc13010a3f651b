"""Vectorised hashing of substrings, words and word shingles over a whole batch.

A prefix sum of ``value(symbol) * P^position`` modulo 2^64 gives the hash of any
substring in constant time; words and five-word shingles are built on it.  A word is
a maximal run of ASCII letters, digits, ``_`` and non-ASCII characters of the
lower-cased text (``WORD_RX``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

#: The same words in RE2 / Java syntax, for SQL over the lower-cased text.
WORD_RX = r"[a-z0-9_\x{80}-\x{10FFFF}]+"
SHINGLE = 5

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def _powers(base: int, n: int) -> np.ndarray:
    run = np.full(n, base, np.uint64)
    run[:1] = 1
    return np.multiply.accumulate(run)


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`span`; bytes through a table, code points mixed."""
    n = len(symbols)
    values = _BYTE[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(np.uint64) + np.uint64(_P))
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_P, n), out=out[1:])
    return out


def inverses(pre: np.ndarray) -> np.ndarray:
    """What :func:`span` needs of ``pre``'s length, for callers that ask many times."""
    return _powers(_P_INV, len(pre))


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray, inv: np.ndarray | None = None) -> np.ndarray:
    """Hash of ``symbols[start:end]``, element by element."""
    inv = inverses(pre) if inv is None else inv
    return mix((pre[end] - pre[start]) * inv[start])


def runs(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of member bytes within each text, and for each
    text the index of its first run (``n + 1`` values)."""
    return bounds(member[buf], offs)


def bounds(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the runs of true values."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    inner = offs[1:-1]
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of lower-cased texts, as :func:`runs`."""
    return runs(buf, offs, _WORD)


_M = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of a string column, text after text, and the
    ``n + 1`` offsets of the texts.  A text of one to four words has one shingle, of
    all its words; a text without words has none."""
    buf, offs = utf8(pc.utf8_lower(arr))
    starts, ends, first = words(buf, offs)
    h = span(prefix(buf), starts, ends)
    counts = np.diff(first)
    m = len(h) - SHINGLE + 1
    if m > 0:
        full = h[:m] * _M[0]
        for j in range(1, SHINGLE):
            full += h[j:j + m] * _M[j]
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = doc[:m] == doc[SHINGLE - 1:]
        full, doc = mix(full[inside]), doc[:m][inside]
    else:
        full, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            w = h[first[d]:first[d + 1]]
            extra[i] = (w * _M[:len(w)]).sum(dtype=np.uint64)
        extra = mix(extra + counts[short].astype(np.uint64))
        doc = np.concatenate([doc, short])
        full = np.concatenate([full, extra])
        order = np.argsort(doc, kind="stable")
        full, doc = full[order], doc[order]
    per_doc = np.bincount(doc, minlength=len(counts)) if len(doc) else np.zeros(len(counts), np.int64)
    return full, np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)


def word_grams(arr: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``n < SHINGLE``: hashes of all runs of ``n`` words, each as :func:`shingles`
    gives it for a text of just these words, and the text of each."""
    buf, offs = utf8(pc.utf8_lower(arr))
    starts, ends, first = words(buf, offs)
    h = span(prefix(buf), starts, ends)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = h[:m] * _M[0]
    for j in range(1, n):
        full += h[j:j + m] * _M[j]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    inside = doc[:m] == doc[n - 1:]
    return mix(full[inside] + np.uint64(n)), doc[:m][inside]
