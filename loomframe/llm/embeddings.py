"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Equal vectors are one class, so a vector that is repeated any number of times is
compared once. The classes of a label (and length) are dealt into blocks by hash, and each
pair of blocks is a tile. In a tile, unit vectors are x = s*q + e with q of int8; then
|x.y - s*t*q.r| <= |e| + |f| + |e||f|. The products q.r are exact (whole numbers below
2**24 in a float32 matrix product), so only pairs whose product plus bound reaches the
threshold are computed again in double precision, and no link is lost or made up.
A tile gives link counts and a spanning forest of its links, never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, null labels and null ids link with nothing (component_id is their own id, kept is
true, n_links 0); vectors of different length are never compared; repeated rows count as other
vectors; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_schema, map_batches, stored, table
from .components import components

THRESHOLD = 0.98
#: Vectors of a block, on average.
BLOCK = 2048
#: Pairs that are computed again at once.
AGAIN = 1 << 15

VECTOR = "vec_id long, label string, dim int, key string, vector binary"
PACKED = "label string, dim int, block int, n_blocks int, ids binary, times binary, vectors binary, quant binary, scale binary, error binary"
FOUND = "node long, links long, root long"


def _scaled(v: np.ndarray) -> np.ndarray:
    """v times a power of two that brings its largest component near 1, which changes no cosine and keeps its norm from over- or underflow; in float32 where that holds all of it."""
    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
    short = v.astype(np.float32)
    return short if (short == v).all() else v


def _vector(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64)


def _valid(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    ids, labels, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
    out = []
    for k, i in enumerate(ids):
        x = rows[k]
        if i is None or labels[k] is None or not x.is_valid or not len(x) or x.values.null_count:
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(v).all() and v.any():
            key = hashlib.blake2b(v.tobytes() + b"\0" + labels[k].encode(), digest_size=16).hexdigest()
            out.append((i, labels[k], len(v), key, _scaled(v).tobytes()))
    return T.batches_of(list(zip(*out, strict=True)) if out else [[]] * 5, schema.names, schema)


def _pack(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    out = []
    for row in batch.to_pylist():
        x = np.stack([_vector(r["vector"], row["dim"]) for r in row["rows"]])
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        q = np.rint(unit / scale[:, None])
        error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
        out.append((row["label"], row["dim"], row["block"], row["n_blocks"], np.array([r["node"] for r in row["rows"]], np.int64).tobytes(), np.array([r["times"] for r in row["rows"]], np.int64).tobytes(), (x.astype(np.float32) if all(len(r["vector"]) == 4 * row["dim"] for r in row["rows"]) else x).tobytes(), q.astype(np.int8).tobytes(), scale.tobytes(), error.tobytes()))
    return T.batches_of(list(zip(*out, strict=True)), schema.names, schema)


def links_of(a: np.ndarray, b: np.ndarray, threshold: float, quant=None) -> np.ndarray:
    """Boolean matrix of the pairs with cosine >= threshold in double precision; quant: ((q, scale, error), (q, scale, error))."""
    na, nb = (np.sqrt((x * x).sum(axis=1)) for x in (a, b))
    out = np.zeros((len(a), len(b)), bool)
    (qa, sa, ea), (qb, sb, eb) = quant
    step = 1 << 10  # columns of int8 whose product fits exactly in float32
    near = sum(((qa[:, k : k + step].astype(np.float32) @ qb[:, k : k + step].astype(np.float32).T).astype(np.float64) for k in range(0, qa.shape[1], step)), np.zeros(out.shape))
    near *= sa[:, None] * sb[None, :]
    maybe = np.flatnonzero((near + ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] >= threshold - 1e-9).ravel())
    flat = out.ravel()
    for k in range(0, len(maybe), AGAIN):
        p = maybe[k : k + AGAIN]
        i, j = p // len(b), p % len(b)
        flat[p] = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j]) >= threshold
    return out


def _compare(batch: pa.RecordBatch, schema: pa.Schema, threshold: float):
    for row in batch.to_pylist():
        dim = row["dim"]
        sides = []
        for s in "ab":
            f = lambda name, kind, s=s: np.frombuffer(row[f"{s}_{name}"], kind)
            ids = f("ids", np.int64)
            sides.append((ids, f("times", np.int64), _vector(row[f"{s}_vectors"], dim * len(ids)).reshape(-1, dim), (f("quant", np.int8).reshape(-1, dim), f("scale", np.float64), f("error", np.float64))))
        (ia, ta, va, qa), (ib, tb, vb, qb) = sides
        same = row["a_block"] == row["b_block"]
        linked = links_of(va, vb, threshold, (qa, qb))
        if same:
            np.fill_diagonal(linked, False)
        count_a, count_b = linked @ tb, linked.T @ ta
        has_a, has_b = linked.any(axis=1), linked.any(axis=0)
        la, lb = ia.copy(), ib.copy()
        big = np.iinfo(np.int64).max
        while has_a.any():
            nb_ = np.minimum(lb, np.where(linked, la[:, None], big).min(axis=0))
            na_ = np.minimum(la, np.where(linked, nb_[None, :], big).min(axis=1))
            if same:
                na_ = nb_ = np.minimum(na_, nb_)
            if (na_ == la).all() and (nb_ == lb).all():
                break
            la, lb = na_, nb_
        if same:
            nodes, links, roots = ia[has_a], count_a[has_a], la[has_a]
        else:
            nodes, links, roots = (np.concatenate(x) for x in ((ia[has_a], ib[has_b]), (count_a[has_a], count_b[has_b]), (la[has_a], lb[has_b])))
        yield T.batches_of([nodes, links, roots], schema.names, schema)


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A row a vector: its number of links, and its component."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    schemas = {x: arrow_schema(x) for x in (VECTOR, PACKED, FOUND)}
    valid = map_batches(raw, lambda b: _valid(b, schemas[VECTOR]), VECTOR)
    members = valid.select("vec_id", "key")
    classes = stored(valid.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    grouped = dealt.groupBy("label", "dim", "block", "n_blocks").agg(F.collect_list(F.struct("node", "times", "vector")).alias("rows"))  # about `block` rows each, by hash
    packed = stored(map_batches(grouped, lambda b: _pack(b, schemas[PACKED]), PACKED))
    parts = ("block", "ids", "times", "vectors", "quant", "scale", "error")
    left = packed.select("label", "dim", *(F.col(c).alias(f"a_{c}") for c in parts), F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("other"))
    right = packed.select("label", "dim", F.col("block").alias("other"), *(F.col(c).alias(f"b_{c}") for c in parts))
    tiles = left.join(right, ["label", "dim", "other"])
    found = stored(map_batches(tiles, lambda b: _compare(b, schemas[FOUND], threshold), FOUND))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    told = (
        members.join(classes.select("key", "node", "times"), "key").join(links, "node", "left").join(roots.withColumnRenamed("component", "root"), "node", "left")
        .select("vec_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
        .groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    )
    return raw.select("vec_id").join(told, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
ORACLE_SQL = {
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND list_inner_product(x, x) > 0
), link AS (
  SELECT a.id AS u, b.id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.id <> b.id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98
), reach(u, w) AS (SELECT u, w FROM link UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u)
SELECT v.id AS vec_id, (SELECT count(*) FROM link WHERE link.u = v.id) AS n_links,
  least(v.id, coalesce((SELECT min(w) FROM reach WHERE reach.u = v.id), v.id)) AS component_id,
  v.id = least(v.id, coalesce((SELECT min(w) FROM reach WHERE reach.u = v.id), v.id)) AS kept
FROM v"""
}
