"""MinHash near-dedup: circulant signatures, banding, exact Jaccard on full sets.

One permutation spreads the shingles of a set, a second one, circularly shifted k times,
gives coordinate k of the signature: min over the set of pi((sigma(x) + k * step) mod 2**32).
The whole signature is made first; ROWS coordinates of it then make a band, and two sets that
agree in a band are candidates. With 32 bands of 4 a pair at Jaccard 0.75 is missed with a
chance of 5e-6. A signature's low bytes, its sketch, spare most candidates the exact check: a
pair at 0.75 agrees in fewer than 72 of 128 coordinates with a chance of 1e-6.

Sets that are equal are one class from the start, so any number of copies is one
candidate. First all classes of a bucket are compared with one hub, its smallest, and the
links are joined up into components: a bucket of n near copies costs n comparisons. Only
buckets in which several components remain go on. Their classes are dealt into blocks by the
fullest of their buckets, so that those that share buckets lie together, and two blocks meet
in a tile only where they share such a bucket. A tile compares the candidates that are not yet
in one component; it gives the links that join components and never lists pairs. Blocks are
bounded in rows and bytes. Jaccard is taken on the whole sets, from the texts.

Defined results: null texts, and texts without words, have an empty set and link with
nothing; a text of fewer than five words has its whole sequence as its one shingle; rows
without doc_id link with nothing; repeated rows count as one document; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_schema, dropped, id_and_text, map_batches, stored, table
from .components import components

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Sets and text bytes of a block, on average.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Ids up to which a join sends them to every executor: 8 bytes each.
SMALL_ROWS = 1_000_000

_STEP = 0x9E3779B1
SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def coordinates(value: np.ndarray, start: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Whole signatures (sets x n, uint32) of sets of 64-bit shingles; an empty set's are undefined."""
    sigma = (T.mix(value) >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(start) > 0)
    out = np.zeros((len(start) - 1, n), np.uint32)
    if not len(full):
        return out
    at = start[full]
    x, y = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(n):
        np.add(sigma, np.uint32(k * _STEP & 0xFFFFFFFF), out=x)  # the circular shift
        np.multiply(x, np.uint32(0x85EBCA6B), out=x)  # pi, a bijection of 32-bit values
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0xC2B2AE35), out=x)
        np.right_shift(x, np.uint32(13), out=y)
        np.bitwise_xor(x, y, out=x)
        out[full, k] = np.minimum.reduceat(x, at)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of whole signatures: sets x bands."""
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r].astype(np.uint64))
        keys[:, b] = key
    return keys


def signatures(value: np.ndarray, start: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (sets x bands) of sets of 64-bit shingles."""
    return band_keys(coordinates(value, start, bands * rows), bands, rows)


def sign(docs: DataFrame, *, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, set size, a key that equal sets share (null for an empty set), the band keys and the sketch."""
    schema = arrow_schema(SIGNED)

    def run(batch):
        ids = batch.column(0)
        for w in T.words_in(batch.column(1), T.SPACED, T.RUN_BYTES // 2):
            value, start = T.shingles(w, width)
            size = np.diff(start)
            edges = start.tolist()
            keys = [hashlib.blake2b(value[a:z].tobytes(), digest_size=16).digest() if z > a else None for a, z in zip(edges[:-1], edges[1:], strict=True)]
            signature = coordinates(value, start, bands * rows)
            found = band_keys(signature, bands, rows).view(np.int64)
            sketch = [x.tobytes() for x in signature.astype(np.uint8)]
            yield T.batches_of([ids[w.first : w.first + len(w)], size, keys, [f if s else None for f, s in zip(found, size, strict=True)], sketch], schema.names, schema)

    return map_batches(docs, run, SIGNED)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union; an empty one has no link."""
    merged = np.concatenate([x, y])
    merged.sort()
    common = int((merged[1:] == merged[:-1]).sum())
    return len(merged) > 0 and 100 * common >= percent * (len(merged) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text")), "v").join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text")), "u").select("u", "v", "u_text", "v_text")
    schema = arrow_schema("u long, v long")

    def check(batch):
        left, off_l = T.column_bytes(batch.column(2))
        right, off_r = T.column_bytes(batch.column(3))
        n = batch.num_rows
        keep = np.zeros(n, bool)
        for i, j in T.runs(off_l + off_r, T.RUN_BYTES):
            a, b = (T.shingles(T.words_of(d[o[i] : o[j]], o[i : j + 1] - o[i], T.SPACED), width) for d, o in ((left, off_l), (right, off_r)))
            for k in range(j - i):
                x, y = (v[s[k] : s[k + 1]] for v, s in (a, b))
                keep[i + k] = _linked(x, y, percent)
        ids = batch.select(["u", "v"]).filter(pa.array(keep))
        return T.batches_of([ids.column(0), ids.column(1)], schema.names, schema)

    return map_batches(both, check, "u long, v long")


def _few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its counted ids are few; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _agree(n: int, share: float) -> int:
    """Coordinates of n in which a pair at this Jaccard agrees at least, but for a chance of about 1e-6."""
    return math.floor(n * share - 4.8 * math.sqrt(n * share * (1 - share)))


def _joined(left: list[dict], right: list[dict] | None, width: int, percent: int, rows: int) -> list[tuple[int, int]]:
    """Links between the sets of a tile that join two of its components: a forest, no pairs of one component."""
    both = [*left, *(right or ())]
    data, off = T.column_bytes(pa.array([r["text"] for r in both], pa.string()))
    sets = []
    for i, j in T.runs(off):
        value, start = T.shingles(T.words_of(data[off[i] : off[j]], off[i : j + 1] - off[i], T.SPACED), width)
        sets += [value[a:z] for a, z in zip(start[:-1], start[1:], strict=True)]
    size = np.array([len(x) for x in sets])
    sketch = np.frombuffer(b"".join(r["sketch"] for r in both), np.uint8).reshape(len(both), -1)
    agree = _agree(sketch.shape[1], percent / 100)
    nodes = [r["node"] for r in both]
    label = np.unique([r["root"] for r in both], return_inverse=True)[1]
    n, links = len(left), []
    for i in range(n):
        first = i + 1 if right is None else n
        fits = 100 * np.minimum(size[first:], size[i]) >= percent * np.maximum(size[first:], size[i])
        at = np.flatnonzero(fits & (label[first:] != label[i])) + first
        if not len(at):
            continue
        same = sketch[at] == sketch[i]
        at = at[(same.sum(axis=1) >= agree) & same.reshape(len(at), -1, rows).all(axis=2).any(axis=1)]
        for j in at.tolist():
            if label[j] != label[i] and _linked(sets[i], sets[j], percent):
                links.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return links


def _tiles(shared: DataFrame, members: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """Links among members(part, node, root, sketch, text) that share a bucket of shared(bucket, node), by tiles of two blocks.

    A class belongs to the fullest of its buckets, its home. The homes of a part are dealt
    into as many blocks as the part's rows and bytes ask for, and a home that fills
    several blocks is dealt over as many.
    """
    schema = arrow_schema("u long, v long")
    room = lambda: F.greatest(F.count("*") / F.lit(BLOCK), F.sum("bytes") / F.lit(BLOCK_BYTES))
    full = shared.groupBy("bucket").agg(F.count("*").alias("n"))
    homes = shared.join(full, "bucket").groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("home")).select("node", F.col("home.bucket").alias("home"))
    sized = stored(members.select("part", "node", F.octet_length("text").alias("bytes")).join(homes, "node"))
    parts = sized.groupBy("part").agg(F.ceil(room()).alias("n_blocks"))
    places = sized.groupBy("part", "home").agg(F.ceil(room()).alias("n_own"))
    dealt = sized.join(parts, "part").join(places, ["part", "home"])
    dealt = stored(dealt.select("node", F.xxhash64("part", F.pmod(F.xxhash64("home") + F.pmod(F.xxhash64("node"), "n_own"), "n_blocks")).alias("block")))
    packed = stored(members.join(dealt, "node").groupBy("block").agg(F.collect_list(F.struct("node", "root", "sketch", "text")).alias("a")))  # about BLOCK rows each, by hash
    meet = shared.join(dealt, "node").select("bucket", "block").distinct()
    pairs = meet.join(meet.select("bucket", F.col("block").alias("other")), "bucket").where("block < other").select("block", "other").distinct()

    def own(batch):
        return _out(_joined(row, None, width, percent, rows) for row in batch.column(0).to_pylist())

    def cross(batch):
        return _out(_joined(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), width, percent, rows) for k in range(batch.num_rows))

    def _out(found):
        links = [x for one in found for x in one]
        return T.batches_of([[u for u, _ in links], [v for _, v in links]], schema.names, schema)

    tiles = pairs.join(packed, "block").select("other", "a").join(packed.select(F.col("block").alias("other"), F.col("a").alias("b")), "other")
    out = stored(map_batches(packed.select("a"), own, "u long, v long").unionByName(map_batches(tiles.select("a", "b"), cross, "u long, v long")))
    dropped(sized, dealt, packed)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, kept."""
    given = id_and_text(docs, id_col, text_col)
    signed = stored(sign(given, width=width, bands=bands, rows=rows))
    classes = stored(signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    listed = classes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = listed.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("hub")).where("n > 1").select("bucket", F.col("hub.node").alias("u"), F.col("hub.size").alias("u_size"))
    opened = stored(listed.join(shared, "bucket"))
    chosen = stored(opened.select(F.col("node").alias("doc_id")).distinct())
    texts = stored(given.join(_few(chosen), "doc_id"))

    able = opened.where((F.col("node") != F.col("u")) & (100 * F.least("size", "u_size") >= percent * F.greatest("size", "u_size"))).select("u", F.col("node").alias("v")).distinct()
    star = stored(_confirmed(able, texts, width, percent))
    roots = components(star)

    rooted = opened.join(roots.select("node", F.col("component").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    rest = stored(rooted.join(apart, "bucket").select("bucket", "node", "u", "root"))
    parts = components(rest.select(F.col("node").alias("u"), F.col("u").alias("v")).distinct())
    members = rest.select("node", "root").distinct().join(parts.select("node", F.col("component").alias("part")), "node").join(classes.select("node", "sketch"), "node").join(texts.withColumnRenamed("doc_id", "node"), "node")
    tiled = _tiles(rest.select("bucket", "node"), members, width, percent, rows)
    found = components(star.unionByName(tiled))
    dropped(opened, chosen, texts, star, roots, rest, parts, tiled)

    out = signed.join(classes.select("set_key", "node"), "set_key", "left").join(found, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
ORACLE_SQL = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS x FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
    ELSE list_distinct(list_transform(range(1, len(x) - 3), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] || ' ' || x[i + 3] || ' ' || x[i + 4])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM g), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (SELECT u, v FROM p WHERE 100 * c >= 75 * (nu + nv - c)),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
best AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(m, g.doc_id)) AS component_id, g.doc_id = least(g.doc_id, coalesce(m, g.doc_id)) AS kept
FROM g LEFT JOIN best ON best.u = g.doc_id"""
}
