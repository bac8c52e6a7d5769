"""Token-id files: static range asymmetric numeral coding in independent interleaved blocks.

Documents are dealt out by ranges of their id, so the files in order hold them in
ascending doc_id. A task tokenises its documents, counts their ids, and codes them with
that one frequency table, which all blocks of the file share. A block holds BLOCK ids in
LANES interleaved coders whose words lie in one stream; it starts from its own coder
states, so any block decodes alone. The file's index has for each block its place, its
states (the checkpoints) and the checksum of its ids, and for each document its first id.

Layout, little endian: b"RANSTOK1"; the byte length of the zstd-compressed JSON header
(uint64); the header; the streams of all blocks (uint32 words). The header has `scale`,
`lanes`, `block`, `n_tokens`, `symbols` and `freqs` (the table), `blocks` (first word,
words, ids, crc32, states) and `docs` (ids and lengths).

Defined results: a null text is empty; a document of no ids still has its end id;
repeated rows are kept, in the order of their texts; rows without doc_id come first; an
empty table writes no file and reads back no row. A task that runs again writes the same
file under the same name, put in place at once.
"""

from __future__ import annotations

import base64
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import text as T
from .bpe import byte_symbols
from .common import arrow_schema, bounded, id_and_text, map_batches, release, shared_path, stored, table

MAGIC = b"RANSTOK1"
SCALE, LANES, BLOCK = 20, 32, 1 << 15
#: Blocks that are coded side by side.
SIDE = 16
_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)
END_ID = 2
#: Bytes of text whose different words are looked up together.
RUN = 2 << 20


def table_of(ids: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, ascending, and their frequencies, each at least 1, which add up to 2**scale."""
    top = int(ids.max(initial=0)) + 1
    if int(ids.min(initial=0)) >= 0 and top <= 1 << 24:
        every = np.zeros(top, np.int64)
        for k in range(0, len(ids), 1 << 20):
            every += np.bincount(ids[k : k + (1 << 20)], minlength=top)
        symbols = np.flatnonzero(every)
        counts = every[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << scale
    if len(symbols) > total:
        raise ValueError("more symbols than the table has slots")
    freqs = np.maximum(1, counts * total // max(1, counts.sum())).astype(np.int64)
    left = total - int(freqs.sum())
    if len(symbols) and left > 0:
        freqs[np.argmax(freqs)] += left
    for k in np.argsort(-freqs, kind="stable").tolist() if left < 0 else ():
        take = min(-left, int(freqs[k]) - 1)
        freqs[k] -= take
        left += take
        if not left:
            break
    return symbols, freqs


def encode_blocks(index: np.ndarray, freqs: np.ndarray, lanes: int = LANES, block: int = BLOCK, scale: int = SCALE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(ids, words, states) of each block of symbol indices."""
    freq = freqs.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
    bits = np.uint64(scale)
    # bigger than any state: one emission brings a state below freq << (63 - scale)
    limit = freq << np.uint64(63 - scale)
    for at in range(0, len(index), block * SIDE):
        part = index[at : at + block * SIDE]
        n_blocks = -(-len(part) // block)
        steps = -(-min(block, len(part)) // lanes)
        padded = np.full(n_blocks * steps * lanes, -1, np.int64)
        for b in range(n_blocks):
            one = part[b * block : (b + 1) * block]
            padded[b * steps * lanes : b * steps * lanes + len(one)] = one
        grid = np.ascontiguousarray(padded.reshape(n_blocks, steps, lanes).transpose(1, 0, 2)).reshape(steps, n_blocks * lanes)
        state = np.full(n_blocks * lanes, _LOW, np.uint64)
        words, told = np.zeros((steps, n_blocks * lanes), np.uint32), np.zeros((steps, n_blocks * lanes), bool)
        for t in range(steps - 1, -1, -1):
            s = grid[t]
            live = s >= 0
            s = np.where(live, s, 0)
            f = freq[s]
            full = live & (state >= limit[s])
            words[t] = state.astype(np.uint32)
            told[t] = full
            state = np.where(full, state >> _U32, state)
            q = state // f
            state = np.where(live, (q << bits) + (state - q * f) + start[s], state)
        for b in range(n_blocks):
            cols = slice(b * lanes, (b + 1) * lanes)
            yield min(block, len(part) - b * block), words[:, cols][told[:, cols]], state[cols]


def decode_blocks(streams: list[np.ndarray], counts: list[int], states: np.ndarray, symbols: np.ndarray, freqs: np.ndarray, lanes: int = LANES, scale: int = SCALE) -> list[np.ndarray]:
    """Ids of some blocks, decoded side by side; states: blocks x lanes."""
    if not streams:
        return []
    freq = freqs.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
    slot = np.repeat(np.arange(len(freqs), dtype=np.int32), freqs)
    mask, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    steps, n = -(-max(counts) // lanes), len(streams)
    data = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.cumsum([0, *map(len, streams[:-1])]).astype(np.int64)
    state = states.astype(np.uint64).reshape(n, lanes).copy()
    size = np.array(counts)[:, None]
    lane = np.arange(lanes)[None, :]
    out = np.empty((steps, n, lanes), np.int32)
    for t in range(steps):
        live = t * lanes + lane < size
        low = state & mask
        s = slot[low.astype(np.int64)]
        out[t] = s
        state = np.where(live, freq[s] * (state >> bits) + low - start[s], state)
        need = live & (state < _LOW)
        order = np.cumsum(need, axis=1)
        word = data[np.where(need, at[:, None] + order - 1, len(data) - 1)]
        state = np.where(need, (state << _U32) | word, state)
        at += order[:, -1]
    flat = symbols[out.transpose(1, 0, 2).reshape(n, steps * lanes)]
    return [flat[b, : counts[b]] for b in range(n)]


def write_file(path: str, doc_ids: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
    """One file: ids are those of all documents in order."""
    symbols, freqs = table_of(ids)
    index = np.empty(len(ids), np.int32)
    top = int(symbols[-1]) + 1 if len(symbols) else 0
    place = None
    if len(symbols) and symbols[0] >= 0 and top <= 1 << 24:
        place = np.zeros(top, np.int32)
        place[symbols] = np.arange(len(symbols), dtype=np.int32)
    for k in range(0, len(ids), 1 << 20):
        some = ids[k : k + (1 << 20)]
        index[k : k + (1 << 20)] = np.searchsorted(symbols, some) if place is None else place[some]
    blocks, streams, first = [], [], 0
    for k, (n, words, state) in enumerate(encode_blocks(index, freqs)):
        crc = zlib.crc32(ids[k * BLOCK : k * BLOCK + n].astype("<u4").tobytes())
        blocks.append([first, len(words), n, crc, base64.b64encode(state.astype("<u8").tobytes()).decode()])
        streams.append(words.astype("<u4"))
        first += len(words)
    header = {"scale": SCALE, "lanes": LANES, "block": BLOCK, "n_tokens": len(ids), "symbols": symbols.tolist(), "freqs": freqs.tolist(), "blocks": blocks, "docs": [doc_ids, lengths.tolist()]}
    packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(json.dumps(header).encode())
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(MAGIC + struct.pack("<Q", len(packed)) + packed)
        for s in streams:
            f.write(s.tobytes())
    os.replace(temporary, path)


class TokenFile:
    """A file opened for reading, from its start or from any block."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"{path} is not a token file")
            (n,) = struct.unpack("<Q", f.read(8))
            try:
                self.header = json.loads(zstandard.ZstdDecompressor().decompress(f.read(n)))
            except zstandard.ZstdError as e:
                raise ValueError(f"{path}: the header's checksum differs") from e
        self.data_at = 16 + n
        self.symbols, self.freqs = (np.array(self.header[k], np.int64) for k in ("symbols", "freqs"))
        self.doc_ids, self.lengths = self.header["docs"][0], np.array(self.header["docs"][1], np.int64)

    def blocks(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """Ids of blocks first to last, block by block, each held against its checksum."""
        todo = self.header["blocks"][first:last]
        lanes = self.header["lanes"]
        with open(self.path, "rb") as f:
            for k in range(0, len(todo), SIDE):
                some = todo[k : k + SIDE]
                streams = []
                for at, n, *_ in some:
                    f.seek(self.data_at + 4 * at)
                    streams.append(np.frombuffer(f.read(4 * n), "<u4"))
                states = np.stack([np.frombuffer(base64.b64decode(b[4]), "<u8") for b in some])
                for b, ids in zip(some, decode_blocks(streams, [b[2] for b in some], states, self.symbols, self.freqs, lanes, self.header["scale"]), strict=True):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != b[3]:
                        raise ValueError(f"{self.path}: a block's checksum differs")
                    yield ids

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) of each document; at most SIDE blocks and one document are in memory."""
        held, source, at = [], self.blocks(), 0
        have = 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            while have < n:
                held.append(next(source))
                have += len(held[-1])
            joined = np.concatenate(held) if len(held) > 1 else held[0] if held else np.empty(0, np.int64)
            yield doc, at, joined[:n]
            held, have, at = [joined[n:]], have - n, at + n


class WordTokens:
    """Ids of the tokenizers library, for each different word once.

    Texts of Latin-1 characters (none of which its normaliser changes but for case) are lower-cased and
    cut at ASCII white space, which none of its pieces can span. Words are told apart by 64-bit
    hashes, some megabytes of text at a time; the ids of each different one come from memory, or its
    pieces, by the vocabulary's own splitting pattern, go to the library's model. All other
    texts, and those with strings of special tokens, go to the library whole, and so do all
    texts where the vocabulary is normalised or split in another way. Memory is sorted hashes and flat ids, some
    32 bytes a word; once full, the half that was met last stays. Pieces of words are kept for a while.
    """

    #: Words that are kept, and pieces of words.
    MEMORY, PIECES = 1_000_000, 80_000
    #: Fixed value: the splitting pattern of the vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.symbols = str.maketrans({chr(b): c for b, c in byte_symbols().items()})
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        own = _lowers(told["normalizer"]) and steps[0].get("pattern") == {"Regex": self.PATTERN} and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and not steps[1].get("add_prefix_space")
        self.cut = regex.compile(self.PATTERN) if own else None
        self.pieces: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.known = np.empty(0, np.uint64)  # hashes, ascending; of each, where its ids begin, how many, and the run that met it last
        self.begin, self.size, self.met = (np.empty(0, np.int32) for _ in range(3))
        self.flat = np.empty(0, np.int32)
        self.turn = 0

    def _ids(self, word: str) -> bytes:
        """Ids of a word: the library's model on the byte symbols of its pieces, as its pre-tokenizer gives them."""
        if word.isalpha():
            return self._piece(word)
        pieces, out = self.pieces, []
        for p in self.cut.findall(word):
            got = pieces.get(p)
            if got is None:
                got = pieces[p] = self._piece(p)
            out.append(got)
        return b"".join(out)

    def _piece(self, p: str) -> bytes:
        symbols = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.symbols)
        return array("i", [t.id for t in self.tokenize(symbols)]).tobytes()

    def _plain(self, x: str) -> bool:
        try:
            x.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self.cut is not None and not any(s in x for s in self.special)

    def _learn(self, at: np.ndarray, hashes: np.ndarray, each: list[bytes]) -> None:
        """Put the ids of new words into memory, before the places `at`."""
        size = np.array([len(x) // 4 for x in each], np.int32)
        begin = (len(self.flat) + np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(each), np.int32)])
        self.known, self.begin, self.size = (np.insert(old, at, new) for old, new in ((self.known, hashes), (self.begin, begin), (self.size, size)))
        self.met = np.insert(self.met, at, self.turn)

    def _forget(self) -> None:
        """Keep the words that were met last, half of what memory holds."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.MEMORY // 2])
        size = self.size[keep]
        edge = np.r_[0, np.cumsum(size, dtype=np.int64)]
        self.flat = self.flat[np.repeat(self.begin[keep] - edge[:-1], size) + np.arange(edge[-1])]
        self.known, self.begin, self.size, self.met = self.known[keep], edge[:-1].astype(np.int32), size, self.met[keep]

    def _run(self, words: T.Words) -> list[np.ndarray]:
        """Ids of each document of a run."""
        different, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.turn += 1
        at = np.searchsorted(self.known, different)
        new = np.ones(len(different), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != different[inside]
        if new.any():
            raw, place = words.data.tobytes(), first[new]
            each = [self._ids(raw[a:z].decode()) for a, z in zip(words.start[place].tolist(), words.end[place].tolist(), strict=True)]
            self._learn(at[new], different[new], each)
            at += np.cumsum(new) - new  # new words before it move a word on
        self.met[at] = self.turn
        at = at[which]
        lengths = self.size[at]
        edge = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        out = self.flat[np.repeat(self.begin[at] - edge[:-1], lengths) + np.arange(edge[-1])]
        if len(self.known) > self.MEMORY:
            self._forget()
        if len(self.pieces) > self.PIECES:
            for old in list(islice(self.pieces, len(self.pieces) - self.PIECES // 2)):
                del self.pieces[old]
        ends = edge[words.doc_start].tolist()
        return [out[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self._plain(x) for x in texts]
        out = [x for words in T.words_in(pa.array([x.lower() if p else "" for x, p in zip(texts, plain, strict=True)], pa.string()), T.SPACED, RUN) for x in self._run(words)]
        return [x if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for x, t, p in zip(out, texts, plain, strict=True)]


def _lowers(normalizer: dict | None) -> bool:
    """Whether all that a normaliser does to Latin-1 words is to lower-case them: NFC leaves them, as does white space read as spaces."""
    steps = (normalizer or {}).get("normalizers") or [normalizer or {}]
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return {"type": "Lowercase"} in steps and all(x in ({"type": "Lowercase"}, {"type": "NFC"}, spaces) for x in steps)


_loaded: dict[str, WordTokens] = {}


def loaded(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts tokenised at once, and bytes of text a file holds, about.
GROUP, FILE_BYTES = 1000, 16 << 20


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; the result, stored, has a row a file: file, part, n_docs, n_tokens."""
    bounded(docs.sparkSession)
    given = id_and_text(docs, id_col, text_col)
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-size // FILE_BYTES))
    ordered = given.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = arrow_schema(ddl := "file string, part long, n_docs long, n_tokens long")

    def write(batches):
        part = TaskContext.get().partitionId()
        doc_ids, lengths, ids = [], [], []
        tail = np.array([end_id], np.int32)
        for batch in batches:
            release()
            doc_ids += batch.column(0).to_pylist()
            for i in range(0, batch.num_rows, GROUP):
                for one in loaded(vocabulary).encode([x.as_py() or "" for x in batch.column(1)[i : i + GROUP]]):
                    lengths.append(len(one) + 1)
                    ids += [one, tail]  # 4 bytes an id: a task holds its own range's ids only
        if doc_ids:
            path = os.path.join(folder, f"part-{part:06d}.rans")
            write_file(path, doc_ids, np.array(lengths, np.int64), np.concatenate(ids))
            yield T.batches_of([[path], [part], [len(doc_ids)], [sum(lengths)]], schema.names, schema)

    return stored(ordered.mapInArrow(write, ddl))


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document, from the files.

    The places where files begin are a running sum over the list of files, a row each.
    """
    listed = files.select("part", "file", "n_tokens").orderBy("part").collect()
    first, rows = 0, []
    for r in listed:
        rows.append((r.file, first))
        first += r.n_tokens
    todo = spark.createDataFrame(rows, ST.StructType([ST.StructField("file", ST.StringType()), ST.StructField("first", ST.LongType())]))
    if rows:
        todo = todo.repartition(len(rows))
    schema = arrow_schema(ddl := "doc_id long, start long, ids array<int>")

    def read(batch):
        for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs, starts, parts, held = [], [], [], 0
            source = TokenFile(path).documents()
            for doc, at, ids in source:
                docs.append(doc)
                starts.append(begin + at)
                parts.append(ids.astype(np.int32))
                held += len(ids)
                if held >= 1 << 20:
                    yield out(docs, starts, parts)
                    docs, starts, parts, held = [], [], [], 0
            if docs:
                yield out(docs, starts, parts)

    def out(docs, starts, parts):
        off = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts)))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), ids.cast(schema.field("ids").type)], schema=schema)

    return map_batches(todo, read, ddl)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(table(spark, sf_dir, "documents"), default_path(), shared_path(spark, "tokens"))
    schema = arrow_schema(ddl := "doc_id long, start long, n_tokens long, ids_crc32 long")

    def digest(batch):
        off, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        crc = [zlib.crc32(flat[a:z].astype("<u4").tobytes()) for a, z in zip(off[:-1], off[1:], strict=True)]
        return T.batches_of([batch.column(0), batch.column(1), np.diff(off), crc], schema.names, schema)

    return map_batches(read_tokens(spark, files), digest, ddl)


QUERIES = {"op7_token_files": op7_token_files}
ORACLE_SQL: dict[str, str] = {}
