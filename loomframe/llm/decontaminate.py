"""Benchmark decontamination over a distributed positional inverted index.

`build_index` turns documents into segments; a segment holds, for a run of whole
documents, the sorted distinct words (as hashes) and for each the list of its places
in the segment. Segments are stored in the shared folder and are the unit of parallel
search, as in any document-partitioned index, so no posting is ever shuffled and a very
common word or passage only lengthens lists inside many segments.

`search` sends the benchmark to the segments in blocks of bounded size. Counts of its
words over all segments are summed first. For each window (`width` consecutive words of
an item; a shorter item is one window) the lists are intersected from the rarest word
on: places minus the word's offset in the window, kept while the next list holds them.
What remains are exact phrase occurrences. Proximity matches need every word of a
window within `near` words of an occurrence of its rarest word, in the same document.

Defined results: null or empty texts have no words, and no hits; items without words
have no windows; an item_id that is repeated counts once a document; items without item_id
hit words too, but are not named; a null doc_id stays null; repeated document
rows are searched one by one; an empty benchmark hits nothing; other columns are not
read except where the pipeline hands them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_schema, id_and_text, map_batches, stored, table

WIDTH, NEAR = 10, 20
#: Benchmark text that is sent to the segments at once.
BLOCK_BYTES = 8 << 20

SEGMENT = "segment string, n_docs long, doc_ids binary, no_id binary, doc_start binary, terms binary, lengths binary, places binary"
FOUND = "doc_id long, segment string, ordinal long, n_words long, items array<string>, near_items array<string>, hits array<struct<start:long,end:long>>"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a segment, stored: places are delta-coded along each word's list."""
    schema = arrow_schema(SEGMENT)

    def index(batch):
        parts = list(T.words_in(batch.column(1), T.ALNUM))
        h = np.concatenate([w.hashes for w in parts])
        base = np.cumsum([0] + [len(w.hashes) for w in parts])
        doc_start = np.concatenate([w.doc_start[:-1] + b for w, b in zip(parts, base, strict=False)] + [base[-1:]])
        order = np.argsort(h)
        sorted_h = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = sorted_h[1:] != sorted_h[:-1]
        at = np.flatnonzero(fresh)
        key = (np.cumsum(fresh) - 1).astype(np.uint64) << np.uint64(32) | order.astype(np.uint64)
        key.sort()
        places = (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
        lengths = np.diff(np.r_[at, len(h)]).astype(np.int32)
        delta = np.diff(places, prepend=np.int32(0)).astype(np.int32)
        delta[at] = places[at]
        no_id = pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
        ids = np.ascontiguousarray(pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False), np.int64)
        name = hashlib.sha256(ids.tobytes() + no_id.tobytes() + h.tobytes()).hexdigest()[:24]
        return T.batches_of([[name], [len(ids)], [ids.tobytes()], [no_id.tobytes()], [_pack(doc_start)], [sorted_h[at].tobytes()], [_pack(lengths)], [_pack(delta)]], schema.names, schema)

    segments = map_batches(id_and_text(docs, id_col, text_col), index, SEGMENT)
    return stored(segments.withColumn("segment", F.concat_ws("-", "segment", F.monotonically_increasing_id())))  # equal segments are told apart


class _Segment:
    def __init__(self, row: dict):
        self.name = row["segment"]
        self.ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["no_id"], bool))
        self.doc_start = _unpack(row["doc_start"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.lengths = _unpack(row["lengths"], np.int32).astype(np.int64)
        self.begin = np.r_[0, np.cumsum(self.lengths)]
        self._packed = row["places"]
        self._delta: np.ndarray | None = None
        self._lists: dict[int, np.ndarray] = {}

    def find(self, vocab: np.ndarray) -> np.ndarray:
        """The list number of each word, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(len(vocab), -1)
        at = np.minimum(np.searchsorted(self.terms, vocab), len(self.terms) - 1)
        return np.where(self.terms[at] == vocab, at, -1)

    def list(self, k: int) -> np.ndarray:
        if k not in self._lists:
            if self._delta is None:
                self._delta = _unpack(self._packed, np.int32)
            self._lists[k] = np.cumsum(self._delta[self.begin[k] : self.begin[k + 1]], dtype=np.int64)
        return self._lists[k]


def _held(sorted_list: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_list, x), len(sorted_list) - 1)
    return sorted_list[at] == x


class _Block:
    """Windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        words = [w for w in T.words_in(pa.array([x for _, x in items], pa.string()), T.ALNUM)]
        hashes = [w.hashes[w.doc_start[i] : w.doc_start[i + 1]] for w in words for i in range(len(w))]
        self.names = [k for k, _ in items]
        self.vocab = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        by: dict[int, list] = {}
        for k, h in enumerate(hashes):
            size = min(width, len(h))
            if size:
                t = np.searchsorted(self.vocab, h)
                by.setdefault(size, []).extend((t[i : i + size], k) for i in range(len(h) - size + 1))
        self.groups = [(np.stack([t for t, _ in v]), np.array([k for _, k in v])) for v in by.values()]


def _blocks(benchmark: DataFrame, width: int, limit: int) -> Iterator[_Block]:
    held, size = [], 0
    for r in benchmark.toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text or "")
        if size >= limit:
            yield _Block(held, width)
            held, size = [], 0
    yield _Block(held, width)


def _search_block(index: DataFrame, block: _Block, near: int) -> DataFrame:
    vocab = block.vocab
    count_schema, found_schema = arrow_schema("word long, n long"), arrow_schema(FOUND)

    def count(batch):
        total = np.zeros(len(vocab), np.int64)
        for row in batch.select(["terms", "lengths"]).to_pylist():
            terms, lengths = np.frombuffer(row["terms"], np.uint64), _unpack(row["lengths"], np.int32)
            if len(terms):
                at = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
                total += np.where(terms[at] == vocab, lengths[at], 0)
        return T.batches_of([np.arange(len(vocab)), total], count_schema.names, count_schema)

    counts = np.zeros(len(vocab), np.int64)
    if len(vocab):  # one number a benchmark word: as many as the block has, however large the corpus
        for r in map_batches(index.select("terms", "lengths"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            counts[r.word] = r.n
    groups = [(t, k, np.argsort(counts[t], axis=1, kind="stable")) for t, k in block.groups]
    names = block.names

    def search(batch):
        for row in batch.to_pylist():
            seg = _Segment(row)
            n, total = len(seg.ids), int(seg.doc_start[-1])
            edge = np.zeros(total + 1, np.int32)
            exact: list[set[str]] = [set() for _ in range(n)]
            close: list[set[str]] = [set() for _ in range(n)]
            at = seg.find(vocab)
            for terms, owner, rarest in groups:
                lists, size = at[terms], terms.shape[1]
                for k in np.flatnonzero((lists >= 0).all(axis=1)).tolist():
                    order, own = rarest[k].tolist(), lists[k].tolist()
                    anchor = seg.list(own[order[0]])
                    p, q = anchor - order[0], anchor
                    for o in order[1:]:
                        if not len(p):
                            break
                        p = p[_held(seg.list(own[o]), p + o)]
                    p = p[(p >= 0) & (p + size <= total)]
                    if len(p):
                        d = np.searchsorted(seg.doc_start, p, "right") - 1
                        good = p + size <= seg.doc_start[d + 1]
                        p, d = p[good], d[good]
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + size, -1)
                        for x in np.unique(d).tolist() if names[owner[k]] is not None else ():
                            exact[x].add(names[owner[k]])
                    if near:
                        d = np.searchsorted(seg.doc_start, q, "right") - 1
                        low, high = np.maximum(q - near, seg.doc_start[d]), np.minimum(q + near, seg.doc_start[d + 1] - 1)
                        for o in order[1:]:
                            if not len(low):
                                break
                            other = seg.list(own[o])
                            i = np.searchsorted(other, low)
                            keep = i < len(other)
                            keep[keep] = other[i[keep]] <= high[keep]
                            low, high, d = low[keep], high[keep], d[keep]
                        for x in np.unique(d).tolist() if names[owner[k]] is not None else ():
                            close[x].add(names[owner[k]])
            hit = np.cumsum(edge[:-1]) > 0
            flip = np.diff(np.r_[False, hit, False].astype(np.int8))
            begins, ends = np.flatnonzero(flip == 1), np.flatnonzero(flip == -1)
            spans: list[list[dict]] = [[] for _ in range(n)]
            for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
                d = int(np.searchsorted(seg.doc_start, a, "right") - 1)
                while a < z:  # a stretch of hit words may run on into the next document
                    stop = min(z, int(seg.doc_start[d + 1]))
                    if stop > a:
                        spans[d].append({"start": a - int(seg.doc_start[d]), "end": stop - int(seg.doc_start[d])})
                    a, d = stop, d + 1
            yield T.batches_of([seg.ids, [seg.name] * n, np.arange(n), np.diff(seg.doc_start), [sorted(x) for x in exact], [sorted(x) for x in close], spans], found_schema.names, found_schema)

    return map_batches(index, search, FOUND)


def search(index: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, near: int = NEAR, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: items with an exact window, items with a proximity match, and the hit words as ranges."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    parts = [_search_block(index, b, near) for b in _blocks(items, width, block_bytes)]
    out = parts[0]
    if len(parts) == 1:
        return out
    for p in parts[1:]:
        out = out.unionByName(p)
    merged = out.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
    )
    joined = F.aggregate(
        "hits",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    return merged.withColumn("hits", F.when(F.size("hits") > 0, joined).otherwise(F.col("hits"))).select(*[f.split(" ")[0] for f in FOUND.replace("start:long,", "").split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Index and search in one: a row a document of docs(doc_id, text)."""
    return search(build_index(docs), benchmark, **options)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"),
    )


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
