"""LM scoring: an interpolated modified Kneser-Ney model of order two or three over words.

Counting is done by tasks and joined up by shuffles of packed, pre-aggregated blocks:
a task sums the pairs (context, word) of some millions of tokens and sends, for each
partition, one compressed block of its distinct pairs. A context is spread over SALTS
partitions by its next words, so the commonest word makes no hot one. A partition
sums its pairs, writes them as a sorted array of 64-bit hashes with their counts,
and sends the contexts' and the words' own sums on in the same way. What the driver sees
are counts of counts. The files lie in the shared folder; workers map them into memory
and look words and pairs up by binary search, so a worker holds no part of the model. Words
keep all 64 bits of their hashes, pairs, triples and contexts those that tell them apart.

P(w | v) = max(c(vw) - D(c), 0) / c(v) + g(v) P1(w), and P1 is the same over
continuation counts, interpolated with 1 / (V + 1); D has three values at each level,
from counts of counts. At order three, P(w | u v) has the same form over c(uvw), and below
it P(w | v) takes for c(vw) the number of different words before v w. Triples go to the
partition of their last two words, so those numbers need no shuffle of their own; the sums
of a context u v lie in its SALTS partitions and are added up when it is looked up.

Defined results: a null text is empty; an empty text is its end alone; words never seen
share the uniform part of P1; with no training text every score is that of a uniform
model over one word, 0; rows without doc_id are not held out; repeated rows count as often as
they occur; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_schema, bounded, id_and_text, map_batches, release, shared_path, stored, table

#: Stand for the places before a text and after it.
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0xA0761D6478BD642F)
SALTS = 4
#: The order of the query's model.
ORDER = 3
#: Text bytes a partition of the model stands for, and tokens a task sums before it sends.
PARTITION_BYTES, FLUSH = 24 << 20, 4_000_000
BLOCKS = "part int, block binary"


def _pack(*columns: np.ndarray) -> bytes:
    raw = b"".join(c.tobytes() for c in columns)
    return struct.pack("<q", len(columns[0])) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(block: bytes, kinds) -> list[np.ndarray]:
    (n,), raw, at, out = struct.unpack_from("<q", block), zstandard.ZstdDecompressor().decompress(block[8:]), 0, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(raw, k, n, at))
        at += size
    return out


def pairs_of(words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of all tokens, the end of each document included, and where documents begin."""
    n = len(words)
    at = words.doc_start + np.arange(n + 1)  # a token more for each document
    w = np.empty(at[-1], np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    w[inner], w[~inner] = words.hashes, END
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[at[:-1]] = BEGIN
    return v, w, at


def grams_of(words: T.Words, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all n-grams of the order, each text begun by BEGINs, and where documents begin."""
    v, w, at = pairs_of(words)
    if order == 2:
        return [v, w], at
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[at[:-1]] = BEGIN
    return [u, v, w], at


def _gram_key(columns: list[np.ndarray]) -> np.ndarray:
    key = _pair_key(*columns[:2])
    for c in columns[2:]:
        key = _pair_key(key, c)
    return key


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return T.mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _pair_part(v: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    return ((T.mix(v) % np.uint64(1 << 32) + (w >> np.uint64(20)) % np.uint64(SALTS) * np.uint64(0x9E3779B1)) % np.uint64(parts)).astype(np.int64)


def _word_part(w: np.ndarray, parts: int) -> np.ndarray:
    return (T.mix(w) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by partition, keys about ascending in each, and where partitions begin: one sort of one number."""
    bits = np.uint64(parts.bit_length())
    order = np.argsort((part.astype(np.uint64) << (np.uint64(64) - bits)) | (key >> bits))
    return order, _edges(part, parts)


def _edges(part: np.ndarray, parts: int) -> np.ndarray:
    return np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]


def _summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, a place of each, sums of the columns)."""
    order = np.argsort(keys)
    k = keys[order]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[edge], order[edge], [np.add.reduceat(c[order], edge, dtype=np.int64) if len(edge) else c.astype(np.int64) for c in columns]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, keys ascending, and how often it is there."""
    order = np.argsort(keys)
    k = keys[order]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return order[edge], np.diff(edge, append=len(keys))


def _taken(columns: list[np.ndarray], places: np.ndarray) -> None:
    """Each column becomes its values at the places; only one is there twice at a time."""
    for k in range(len(columns)):
        columns[k] = columns[k][places]


def _planes(x: np.ndarray) -> bytes:
    """The lowest byte of each number, then the next of each, and so on: mostly zeros, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, kind, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel()


def _pack_words(words: np.ndarray, *sums: np.ndarray) -> bytes:
    """Ascending words as steps, and their sums."""
    raw = b"".join(_planes(x) for x in (np.diff(words, prepend=np.uint64(0)), *sums))
    return struct.pack("<q", len(words)) + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack_words(block: bytes) -> list[np.ndarray]:
    (n,), raw = struct.unpack_from("<q", block), zstandard.ZstdDecompressor().decompress(block[8:])
    steps, *sums = (_unplaned(raw, k, n, 8 * n * i) for i, k in enumerate(SENT_KINDS))
    return [np.cumsum(steps, dtype=np.uint64), *sums]


def _split(part: np.ndarray, parts: int, words: np.ndarray, *sums: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((words, part))
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edge[p] < edge[p + 1]:
            some = order[edge[p] : edge[p + 1]]
            yield p, _pack_words(words[some], *(x[some] for x in sums))


def _write(path: str, *columns: np.ndarray) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(struct.pack("<q", len(columns[0])))
        for c in columns:
            f.write(np.ascontiguousarray(c).tobytes())
    os.replace(temporary, path)


def _mapped(path: str, kinds) -> list[np.ndarray]:
    with open(path, "rb") as f:
        (n,) = struct.unpack("<q", f.read(8))
    at, out = 8, []
    for k in kinds:
        out.append(np.asarray(np.memmap(path, k, "r", at, (n,))) if n else np.empty(0, k))
        at += n * np.dtype(k).itemsize
    return out


def _padded(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def _write_table(path: str, key: np.ndarray, *columns: np.ndarray) -> None:
    """Ascending 64-bit hashes with their columns: where each value of the first bits begins, and the 32 bits after those.

    A value of the first bits has some eight hashes, however many there are, so a hash that
    is not there meets another with a chance of about 2**-28.
    """
    n = len(key)
    bits = max(0, n.bit_length() - 4)
    begin = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, n])
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(struct.pack("<qq", n, bits))
        for c in (begin.astype(np.uint32), (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), *columns):
            f.write(_padded(c))
    os.replace(temporary, path)


class _Table:
    """A written table, mapped."""

    def __init__(self, path: str, kinds):
        with open(path, "rb") as f:
            self.n, self.bits = struct.unpack("<qq", f.read(16))
        raw, at, out = np.asarray(np.memmap(path, np.uint8, "r")) if self.n else np.empty(0, np.uint8), 16, []
        for kind, n in ((np.uint32, (1 << self.bits) + 1), (np.uint32, self.n), *((k, self.n) for k in kinds)):
            size = n * np.dtype(kind).itemsize
            out.append(raw[at : at + size].view(kind) if self.n else np.empty(0, kind))
            at += size + -size % 8
        self.begin, self.low, *self.columns = out

    def search(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it does."""
        if not self.n:
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        top = (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        low, want = self.low, (key << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32)
        at, stop = self.begin[top].astype(np.int64), self.begin[top + 1].astype(np.int64)
        size = stop - at
        for k in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):  # steps of falling powers of two, while the last passed is below
            step = at + (1 << k)
            at = np.where((step <= stop) & (low[np.minimum(step, self.n) - 1] < want), step, at)
        hit = at < stop
        at = np.minimum(at, self.n - 1)
        return at, hit & (low[at] == want)


def _pack_grams(columns: list[np.ndarray], c: np.ndarray) -> bytes:
    """Grams as places in the block's own list of words, byte by byte, so that they take little of a shuffle."""
    words, place = np.unique(np.concatenate(columns), return_inverse=True)
    told = zstandard.ZstdCompressor(level=3).compress(_planes(c.astype(np.int64)))
    return struct.pack("<qq", len(words), len(c)) + told + zstandard.ZstdCompressor(level=3).compress(_planes(np.diff(words, prepend=np.uint64(0))) + _planes(place.astype(np.uint32)))


def _unpack_grams(block: bytes, order: int) -> list[np.ndarray]:
    n_words, n = struct.unpack_from("<qq", block)
    counts = zstandard.ZstdDecompressor().decompressobj()
    c = _unplaned(counts.decompress(block[16:]), np.int64, n)
    raw = zstandard.ZstdDecompressor().decompress(counts.unused_data)
    words = np.cumsum(_unplaned(raw, np.uint64, n_words), dtype=np.uint64)
    place = _unplaned(raw, np.uint32, order * n, 8 * n_words)
    return [*words[place].reshape(order, n), c]


PAIR_KINDS = (np.uint8,)  # count 255: see the overflow file
OVER_KINDS = (np.int64,)
CONTEXT_KINDS = (np.uint8,)  # which of the partition's SUMS_KINDS rows; 255: see the overflow file
SUMS_KINDS = (np.int64,) * 4  # tokens, N1, N2, N3+
CONTEXT_OVER_KINDS = SUMS_KINDS
SENT_KINDS = (np.uint64, *[np.int64] * 6)  # count, as context: tokens, N1, N2, N3+; continuations
WORD_KINDS = (np.uint64, *[np.uint8] * 6)  # the same where all are under 255; else 255: see the overflow file


def _count_grams(texts: DataFrame, parts: int, order: int) -> DataFrame:
    """Blocks of (n-gram, count) by the partition of the last two words, summed for FLUSH tokens of pairs at a time."""
    schema = arrow_schema(BLOCKS)

    def send(held):
        columns = _joined(held)
        held.clear()
        first, c = _counted(_gram_key(columns))
        _taken(columns, first)
        del first
        v, w = columns[-2:]
        by, edge = _by_part(_pair_part(v, w, parts), parts, v >> np.uint64(32) << np.uint64(32) | w >> np.uint64(32))  # equal contexts together, which compress well
        for p in range(parts):
            some = by[edge[p] : edge[p + 1]]
            if len(some):
                own = [x[some] for x in columns]
                yield T.batches_of([[p], [_pack_grams(own, c[some]) if order > 2 else _pack(*own, c[some])]], schema.names, schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for words in T.words_in(batch.column(0), T.SPACED):
                columns, _ = grams_of(words, order)
                held.append(columns)
                size += len(columns[0])
                if size * order >= 2 * FLUSH:
                    yield from send(held)
                    held, size = [], 0
                    release()
        if held:
            yield from send(held)
        release()

    bounded(texts.sparkSession)
    return texts.select("text").mapInArrow(run, BLOCKS)


def _write_counts(folder: str, kind: str, over: str, part: int, key: np.ndarray, c: np.ndarray) -> None:
    _write_table(f"{folder}/{kind}-{part:06d}", key, np.minimum(c, 255).astype(np.uint8))
    big = c >= 255
    _write_table(f"{folder}/{over}-{part:06d}", key[big], c[big])


def _joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of several pieces put together; the pieces are let go column by column."""
    out = []
    for k in range(len(pieces[0])):
        out.append(np.concatenate([x[k] for x in pieces]))
        for x in pieces:
            x[k] = None
    return out


def _grams_in(blocks: list, order: int) -> list[np.ndarray]:
    """The columns of several blocks and their counts, filled in block by block, so that only one is there twice."""
    sizes = [struct.unpack_from("<q", b, 8 if order > 2 else 0)[0] for b in blocks]
    out, at = [np.empty(sum(sizes), k) for k in (*[np.uint64] * order, np.int64)], 0
    for b, n in zip(blocks, sizes, strict=True):
        read = _unpack_grams(b, order) if order > 2 else _unpack(b, (np.uint64, np.uint64, np.int64))
        for o, x in zip(out, read, strict=True):
            o[at : at + n] = x
        at += n
    return out


def _classed(c: np.ndarray) -> list[np.ndarray]:
    return [c == 1, c == 2, c > 2]


def _word_sums(v: np.ndarray, w: np.ndarray, raw: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct words of pairs and their SENT_KINDS sums; either side is summed before the two meet."""
    ends, _, (count, follows) = _summed(w, [raw, np.ones(len(w), bool)])
    begins, _, told = _summed(v, [c, *_classed(c)])
    none, nothing = np.zeros(len(ends), np.int64), np.zeros(len(begins), np.int64)
    sums = [np.concatenate(x) for x in ((count, nothing), *((none, x) for x in told), (follows, nothing))]
    words, _, sums = _summed(np.concatenate([ends, begins]), sums)
    return words, sums


def _write_contexts(folder: str, part: int, u: np.ndarray, v: np.ndarray, c: np.ndarray) -> None:
    """The partition's share of each context's sums: a byte each where the sums are among its 255 commonest."""
    key, _, sums = _summed(_pair_key(u, v), [c, *_classed(c)])
    small = np.flatnonzero(sums[0] < 1 << 15)  # four sums of 16 bits in a number
    packed = sum(x[small].astype(np.uint64) << np.uint64(16 * k) for k, x in enumerate(sums))
    kinds, inverse, times = np.unique(packed, return_inverse=True, return_counts=True)
    common = np.argsort(-times, kind="stable")[:255]
    code = np.full(len(kinds), 255, np.uint8)
    code[common] = np.arange(len(common))
    which = np.full(len(key), 255, np.uint8)
    which[small] = code[inverse]
    _write_table(f"{folder}/contexts-{part:06d}", key, which)
    _write(f"{folder}/sums-{part:06d}", *((kinds[common] >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)))
    rare = which == 255
    _write_table(f"{folder}/contextover-{part:06d}", key[rare], *(x[rare] for x in sums))


def _merge_grams(blocks: DataFrame, folder: str, parts: int, order: int) -> DataFrame:
    """Writes each partition's pairs, and at order three its triples and contexts; gives blocks of word sums, and at part -1 counts of counts."""
    schema = arrow_schema(BLOCKS)

    def run(batch):
        for at, part in enumerate(batch.column(0).to_pylist()):
            *columns, c = _grams_in([memoryview(b.as_buffer()) for b in batch.column(1)[at].values], order)
            key, first, (c,) = _summed(_gram_key(columns), [c])
            _taken(columns, first)
            told, raw = {}, c
            if order > 2:
                _write_counts(folder, "triples", "tripleover", part, key, c)
                del key, first
                _write_contexts(folder, part, *columns[:2], c)
                told = {f"t{k}": int((c == k).sum()) for k in range(1, 5)}
                del columns[0]
                key, first, (raw, c) = _summed(_pair_key(*columns), [c, np.ones(len(c), bool)])  # from here on a pair's count is of the words before it
                _taken(columns, first)
            _write_counts(folder, "pairs", "over", part, key, c)
            del key, first
            words, sums = _word_sums(*columns, raw, c)
            told |= {"pairs": len(c), **{f"n{k}": int((c == k).sum()) for k in range(1, 5)}}
            del columns, raw, c
            release()
            for p, block in _split(_word_part(words, parts), parts, words, *sums):
                yield T.batches_of([[p], [block]], schema.names, schema)
            yield T.batches_of([[-1], [json.dumps(told).encode()]], schema.names, schema)

    gathered = blocks.groupBy("part").agg(F.collect_list("block").alias("blocks"))  # a partition's own share of the distinct pairs
    return map_batches(gathered, run, BLOCKS)


def _merge_words(blocks: DataFrame, folder: str) -> DataFrame:
    """Writes each partition's words; gives counts of counts, and at part -1 those of the grams."""
    schema = arrow_schema("part int, told string")

    def run(batch):
        for part, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part < 0:  # some numbers of each partition
                total: dict[str, int] = {}
                for one in map(json.loads, some):
                    total |= {k: total.get(k, 0) + n for k, n in one.items()}
                yield T.batches_of([[part], [json.dumps(total)]], schema.names, schema)
                continue
            words, *sums = _joined([_unpack_words(b) for b in some])
            words, _, sums = _summed(words, sums)
            big = np.any([x >= 255 for x in sums], axis=0)
            _write(f"{folder}/words-{part:06d}", words, *(np.where(big, 255, x).astype(np.uint8) for x in sums))
            _write(f"{folder}/wordover-{part:06d}", words[big], *(x[big] for x in sums))
            count, follows = sums[0], sums[5]
            seen = count > 0
            told = {"tokens": int(count.sum()), "vocabulary": int(seen.sum()), **{f"m{k}": int((follows[seen] == k).sum()) for k in range(1, 5)}, "m3up": int((follows[seen] >= 3).sum())}
            yield T.batches_of([[part], [json.dumps(told)]], schema.names, schema)

    gathered = blocks.groupBy("part").agg(F.collect_list("block").alias("blocks"))
    return stored(map_batches(gathered, run, "part int, told string"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """[0, D1, D2, D3+] from counts of counts; 0.5, 1 and 1.5 where some are missing."""
    if min(n1, n2, n3, n4) <= 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(max(x, 0.01), k - 0.01) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))]


class Model:
    """Paths and sums; the tables are mapped where it is used."""

    def __init__(self, folder: str, parts: int, sums: dict[str, int], order: int = 2):
        self.folder, self.parts, self.sums, self.order = folder, parts, sums, order
        self.d_triple = np.array(discounts(*(sums.get(f"t{k}", 0) for k in range(1, 5))))
        self.d_pair = np.array(discounts(*(sums[f"n{k}"] for k in range(1, 5))))
        self.d_word = np.array(discounts(*(sums[f"m{k}"] for k in range(1, 5))))
        left = self.d_word[1] * sums["m1"] + self.d_word[2] * sums["m2"] + self.d_word[3] * sums["m3up"]
        self.rest = left / sums["pairs"] if sums["pairs"] else 1.0
        self._open: dict[str, list[np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _file(self, name: str, kinds):
        if name in self._open:
            return self._open[name]
        path = f"{self.folder}/{name}"
        if name.startswith(("word", "sums")):
            out = _mapped(path, kinds) if os.path.exists(path) else [np.empty(0, k) for k in kinds]
        else:
            out = _Table(path, kinds) if os.path.exists(path) else None
        if self.order == 2 or name.startswith("word"):  # the tables of order three are let go, or they would fill a worker's memory
            self._open[name] = out
        return out

    def _find(self, kind: str, kinds, part: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        """The columns of each key, 0 where there is none."""
        whole = kind.startswith("word")
        out = [np.zeros(len(key), np.int64) for _ in (kinds[1:] if whole else kinds)]
        order, edge = _by_part(part, self.parts, key)
        for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            some = order[edge[p] : edge[p + 1]]
            table = self._file(f"{kind}-{p:06d}", kinds)
            if whole:
                have, *columns = table
                if not len(have):
                    continue
                at = np.minimum(np.searchsorted(have, key[some]), len(have) - 1)
                hit = have[at] == key[some]
            elif table is None:
                continue
            else:
                columns, (at, hit) = table.columns, table.search(key[some])
            for o, c in zip(out, columns, strict=True):
                o[some[hit]] = c[at[hit]]
        return out

    def words(self, w: np.ndarray) -> list[np.ndarray]:
        part = _word_part(w, self.parts)
        out = self._find("words", WORD_KINDS, part, w)
        big = np.flatnonzero(out[0] == 255)
        if len(big):
            for o, x in zip(out, self._find("wordover", SENT_KINDS, part[big], w[big]), strict=True):
                o[big] = x
        return out

    def _counts(self, kind: str, over: str, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        (c,) = self._find(kind, PAIR_KINDS, part, key)
        big = np.flatnonzero(c == 255)
        if len(big):
            (c[big],) = self._find(over, OVER_KINDS, part[big], key[big])
        return c

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of pairs; at order three, of the different words before them."""
        return self._counts("pairs", "over", _pair_part(v, w, self.parts), _pair_key(v, w))

    def triples(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._counts("triples", "tripleover", _pair_part(v, w, self.parts), _gram_key([u, v, w]))

    def contexts(self, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """Tokens, N1, N2 and N3+ after each u v, added up over the partitions that v is spread over."""
        key, first, inverse = np.unique(_pair_key(u, v), return_index=True, return_inverse=True)
        v = v[first]
        out, done = np.zeros((len(key), len(SUMS_KINDS)), np.int64), []
        for salt in range(SALTS):
            part = _pair_part(v, np.full(len(v), salt << 20, np.uint64), self.parts)
            fresh = np.flatnonzero(np.all([part != x for x in done], axis=0)) if done else np.arange(len(part))  # two salts can share a partition
            done.append(part)
            own = part[fresh].astype(np.uint16 if self.parts <= 1 << 16 else np.int64)  # 16 bits are sorted by counting
            order = fresh[np.argsort(own, kind="stable")]  # keys ascend within each partition
            edge = _edges(part[fresh], self.parts)
            for p in range(self.parts):
                some = order[edge[p] : edge[p + 1]]
                if not len(some):
                    continue
                table = self._file(f"contexts-{p:06d}", CONTEXT_KINDS)
                if table is None or not table.n:
                    continue
                at, hit = table.search(key[some])
                some, code = some[hit], table.columns[0][at[hit]]
                common = code < 255
                out[some[common]] += np.stack(self._file(f"sums-{p:06d}", SUMS_KINDS), axis=1)[code[common]]
                rare = some[~common]
                if len(rare):
                    out[rare] += np.stack(self._find("contextover", CONTEXT_OVER_KINDS, np.full(len(rare), p), key[rare]), axis=1)
        return list(out[inverse].T)

    def log10(self, *gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 P(w | v) or P(w | u v), log10 of the base estimate, count) of each token."""
        s, (v, w) = self.sums, gram[-2:]
        distinct, inverse = np.unique(np.concatenate([v, w]), return_inverse=True)
        count, tokens, n1, n2, n3, follows = self.words(distinct)
        iv, iw = inverse[: len(v)], inverse[len(v) :]
        follow = np.where(count > 0, follows, 0)
        lower = (np.maximum(follow - self.d_word[np.minimum(follow, 3)], 0) / s["pairs"] if s["pairs"] else np.zeros(len(distinct))) + self.rest / (s["vocabulary"] + 1)
        total = tokens[iv]
        both = self.pairs(v, w)
        held = (self.d_pair[1] * n1 + self.d_pair[2] * n2 + self.d_pair[3] * n3)[iv]
        safe = np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(both - self.d_pair[np.minimum(both, 3)], 0) / safe + held / safe * lower[iw], lower[iw])
        if self.order > 2:
            after, n1, n2, n3 = self.contexts(gram[0], v)
            c, safe = self.triples(*gram), np.maximum(after, 1)
            held = self.d_triple[1] * n1 + self.d_triple[2] * n2 + self.d_triple[3] * n3
            p = np.where(after > 0, np.maximum(c - self.d_triple[np.minimum(c, 3)], 0) / safe + held / safe * p, p)
        c = count[iw]
        return np.log10(p), np.log10((c + 0.5) / (s["tokens"] + 0.5 * (s["vocabulary"] + 1))), c


def train(texts: DataFrame, folder: str, *, order: int = 2, partition_bytes: int = PARTITION_BYTES) -> Model:
    """Count texts(text), write the tables to a folder that workers can map, and give the model."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: only 2 and 3 are there")
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size * order // (2 * partition_bytes)))
    told = _merge_words(_merge_grams(_count_grams(texts, parts, order), folder, parts, order), folder)
    sums = dict.fromkeys(("pairs", "n1", "n2", "n3", "n4", "tokens", "vocabulary", "m1", "m2", "m3", "m4", "m3up", "t1", "t2", "t3", "t4"), 0)
    for r in told.select(F.from_json("told", "map<string,bigint>").alias("m")).select(F.explode("m")).groupBy("key").agg(F.sum("value").alias("n")).collect():
        sums[r.key] += r.n
    return Model(folder, parts, sums, order)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every text."""
    schema = arrow_schema(ddl := "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")

    def run(batch):
        ids = batch.column(0)
        for words in T.words_in(batch.column(1), T.SPACED, 2 << 20):
            gram, at = grams_of(words, model.order)
            p, base, count = model.log10(*gram)
            known = np.add.reduceat((count > 0).astype(np.int64), at[:-1])
            total, simple = np.add.reduceat(p, at[:-1]), np.add.reduceat(base, at[:-1])
            n = np.diff(at)
            yield T.batches_of([ids[words.first : words.first + len(words)], n, known, simple, total, 10 ** np.minimum(-total / n, 300)], schema.names, schema)

    return map_batches(id_and_text(docs, id_col, text_col), run, ddl)


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5; -1 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id")) != 1).select("text"), shared_path(spark, "model"), order=ORDER)
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


QUERIES = {"op8_language_model": op8_language_model}
ORACLE_SQL: dict[str, str] = {}
