"""Vectorised words of whole texts: bytes of an Arrow column in, 64-bit word hashes out.

A word class is a table over the 256 byte values, since both classes that the
operators use put every byte of a non-ASCII character on the same side. A word's
hash is a polynomial over random 64-bit byte values, mixed at the end, so equal
words have equal hashes and different ones meet with a chance of about 2**-60.
Texts are handled in runs of whole documents of bounded size; a longer document
is a run of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUE = _BYTE_VALUE[_LOWER]

#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of letters a-z (A-Z lower-cased), digits and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Words are what stands between spaces alone.
UNSPACED = np.ones(256, bool)
UNSPACED[0x20] = False

#: Bytes of text handled at once.
RUN_BYTES = 1 << 20

_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, RUN_BYTES + 1)
        up, down = np.full(n, _BASE), np.full(n, _INV)
        up[0] = down[0] = 1
        made = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n > 4 * RUN_BYTES:
            return made  # not kept: a worker's memory stays bounded after a very long text
        _powers = made
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (a finaliser of the murmur family)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """The words of some whole documents, in order; word k of document i is at doc_start[i] + k."""

    hashes: np.ndarray  # uint64, one a word
    doc_start: np.ndarray  # int64, documents + 1
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    data: np.ndarray  # uint8
    first: int  # index of the first document in the column
    doc_off: np.ndarray  # byte offsets of the documents, documents + 1

    def __len__(self) -> int:
        return len(self.doc_start) - 1

    def word(self, k: int) -> bytes:
        return _LOWER[self.data[self.start[k] : self.end[k]]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.empty(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def runs(off: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most limit bytes each, or of one document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words_of(data: np.ndarray, off: np.ndarray, kind: np.ndarray, first: int = 0, fold: bool = True) -> Words:
    """Words of the documents whose bytes lie between neighbouring offsets; fold: A-Z hash as a-z."""
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(len(off), np.int64), empty, empty, data, first, off)
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = off[:-1][off[:-1] < off[1:]]  # starts of documents that have text
    begins[cuts] = inside[cuts]
    lasts = off[1:][off[:-1] < off[1:]] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers_to(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER_VALUE if fold else _BYTE_VALUE)[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(hashes, np.searchsorted(start, off).astype(np.int64), start, end, data, first, off)


def words_in(column: pa.Array, kind: np.ndarray, limit: int = RUN_BYTES, fold: bool = True) -> Iterator[Words]:
    """The words of a column, run by run."""
    data, off = column_bytes(column)
    for i, j in runs(off, limit):
        yield words_of(data[off[i] : off[j]], off[i : j + 1] - off[i], kind, i, fold)


def gathered(each: list[bytes], which: np.ndarray, doc_start: np.ndarray) -> list[np.ndarray]:
    """int32 values of each document, where word k has those of each[which[k]]."""
    size = np.array([len(x) // 4 for x in each], np.int64)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(each), np.int32)
    lengths = size[which]
    edge = np.r_[0, np.cumsum(lengths)]
    out = flat[np.repeat(begin[which] - edge[:-1], lengths) + np.arange(edge[-1])]
    at = edge[doc_start].tolist()
    return [out[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def hash_words(words: list[str], kind: np.ndarray) -> np.ndarray:
    """Hashes of the words in a few strings, all in one array."""
    out = [w.hashes for w in words_in(pa.array(words, pa.string()), kind)] if words else []
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and where each document's begin.

    A document of fewer words than width, but not none, has its whole sequence as one.
    """
    h, ds = words.hashes, words.doc_start
    n = np.diff(ds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(begin[-1]) - begin[doc] + ds[doc]
    size = np.minimum(n, width)[doc]
    value = size.astype(np.uint64)
    for k in range(width):
        live = k < size
        step = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else value
        value = np.where(live, mix(value * _BASE + step), value)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int64)


def batches_of(columns: list, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of columns with the schema's types."""
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(x).type) if not isinstance(c, pa.Array) else c.cast(schema.field(x).type) for c, x in zip(columns, names, strict=True)], schema=schema)
