"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by concatenation.

A piece's symbols form a doubly linked list. A heap holds the mergeable neighbours as
(rank, place); the best pops first, entries whose symbols have changed since are stale
and skipped, and a merge pushes its two new neighbours. Pieces recur, so each worker
remembers some results, in memory of bounded size.

A text is cut into chunks at every single space between two characters that are not
white space; no piece of the splitting pattern can cross such a place, so the chunks
are encoded one by one. Texts with other white space beside a space are not cut.

Defined results: a null text is empty; an empty text has no ids and decodes to the
empty text; strings of special tokens in a text become their ids, as in the tokenizers
library; bytes that are not UTF-8 after decoding become U+FFFD; repeated rows give
repeated results; other columns are kept by `encode` where asked for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import text as T
from .common import arrow_schema, id_and_text, kept, map_batches, table

#: Fixed value: the byte-level splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts that a worker remembers, in each of two memories; the second holds few in practice.
MEMORY = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary with its merges, from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbol = byte_symbols()
        byte_of = {c: b for b, c in symbol.items()}
        self.byte_id = [vocab[symbol[b]] for b in range(256)]
        self.rank_of: dict[int, int] = {}  # two ids in one number
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.first = [self.rank_of.get(a << 20 | b, -1) for a in self.byte_id for b in self.byte_id]  # ranks of pairs of bytes
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = regex.compile(PATTERN)
        self._uncut = regex.compile(r" \s|\s ")
        self._spaced: dict[str, bytes] = {}  # what stands after a space, by its text without the space
        self._other: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        byte_id, n = self.byte_id, len(data)
        ids = [byte_id[b] for b in data]
        if n < 2:
            return ids
        rank_of, made, first = self.rank_of.get, self.made, self.first
        shift = n.bit_length()
        mask = (1 << shift) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        best = [first[a << 8 | b] for a, b in zip(data, data[1:])]  # noqa: B905  rank of each symbol with the next
        best.append(-1)
        heap = [r << shift | i for i, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & mask
            r = x >> shift
            if best[i] != r:
                continue  # stale
            j = after[i]
            ids[i] = new = made[r]
            ids[j] = best[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                best[i] = r = rank_of(new << 20 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                best[i] = -1
            h = before[i]
            if h >= 0:
                best[h] = r = rank_of(ids[h] << 20 | new, -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        return [x for x in ids if x >= 0]

    @staticmethod
    def _remember(known: dict[str, bytes], key: str, got: bytes) -> None:
        """A full memory loses the older half of its entries."""
        if len(key) <= 64:
            if len(known) >= MEMORY:
                for old in list(islice(known, MEMORY // 2)):
                    del known[old]
            known[key] = got

    def _pieces(self, chunk: str) -> bytes:
        out = []
        for piece in self._split.findall(chunk):
            known, key = (self._spaced, piece[1:]) if piece[0] == " " else (self._other, piece)
            got = known.get(key)
            if got is None:
                got = array("i", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()
                self._remember(known, key, got)
            out.append(got)
        return b"".join(out)

    def _plain(self, x: str) -> bytes:
        if self._uncut.search(x):
            return self._pieces(x)
        words = x.split(" ")
        known = self._spaced
        out = list(map(known.get, words))
        out[0] = self._pieces(words[0])
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    word = words[i]
                    if word.isascii() and word.isalpha():  # one piece
                        got = known.get(word)
                        out[i] = got = array("i", self.merge(b" " + word.encode())).tobytes() if got is None else got
                    else:
                        out[i] = got = self._pieces(" " + word)
                    if word not in known:
                        self._remember(known, word, got)
        return b"".join(out)

    def encode(self, x: str) -> np.ndarray:
        """Ids of a text, as int32."""
        if not x:
            return np.empty(0, np.int32)
        if self._special is None or not self._special.search(x):
            return np.frombuffer(self._plain(x), np.int32)
        out = [np.array([self.special[p]], np.int32).tobytes() if p in self.special else self._plain(p) for p in self._special.split(x) if p]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        of = self.bytes_of
        try:
            data = b"".join(map(of.__getitem__, ids))
        except KeyError:  # an id of no symbol
            data = b"".join([of.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace")


#: What a worker keeps as long as its tasks encode, decode or digest: vocabularies and numbers.
KEEPS = "bpe"


class Kept:
    def __init__(self):
        self.by_path: dict[str, Bpe] = {}
        self.said: list[bytes] = []


def loaded(path: str) -> Bpe:
    """A worker reads a vocabulary once."""
    by_path = kept(KEEPS, Kept).by_path
    if path not in by_path:
        by_path[path] = Bpe(path)
    return by_path[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ENCODED, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, text string"


def _digested(with_ids: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids


def _encoder(path: str):
    schema = arrow_schema(ENCODED)

    def run(batch):
        bpe = loaded(path)
        each = [bpe.encode(x.as_py() or "") for x in batch.column(1)]
        off = np.cumsum([0, *map(len, each)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(each) if each else np.empty(0, np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), ids.cast(schema.field("ids").type)], schema=schema)

    return run


def _decoder(path: str):
    schema = arrow_schema(DECODED)

    def run(batch):
        bpe = loaded(path)
        texts = [bpe.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in batch.column(1)]
        return T.batches_of([batch.column(0), batch.column(1), texts], schema.names, schema)

    return run


def _numbers(n: int) -> list[bytes]:
    """The numbers below n at least as text, a comma after each; a worker writes them once."""
    said = kept(KEEPS, Kept).said
    said.extend(b"%d," % i for i in range(len(said), n))
    return said


def _digester(with_ids: bool):
    schema = arrow_schema(_digested(with_ids))

    def run(batch):
        ids, texts = batch.column(1), batch.column(2)
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        said = _numbers(int(flat.max()) + 1 if len(flat) else 0)
        one = lambda a, z: hashlib.sha256(b"".join(map(said.__getitem__, flat[a:z].tolist()))[:-1]).hexdigest()
        spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
        return T.batches_of([batch.column(0), np.diff(off), [one(a, z) for a, z in spans], [hashlib.sha256(x.as_py().encode()).hexdigest() for x in texts], *[ids] * with_ids], schema.names, schema)

    return run


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids, an array of int."""
    return map_batches(id_and_text(docs, id_col, text_col), _encoder(path), ENCODED, (KEEPS,))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text they stand for; null ids are none."""
    return map_batches(encoded.select("doc_id", "ids"), _decoder(path), DECODED, (KEEPS,))


def digests(decoded: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Count and hashes of ids and text, and the ids where asked for."""
    return map_batches(decoded, _digester(with_ids), _digested(with_ids), (KEEPS,))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """digests(decode(encode(docs))) by one worker a task, which holds the vocabulary once."""
    steps = _encoder(path), _decoder(path), _digester(with_ids)

    def run(batch):
        for step in steps:
            batch = step(batch)
        return batch

    return map_batches(id_and_text(docs, id_col, text_col), run, _digested(with_ids), (KEEPS,))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
