"""Toxicity: subword embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its distinct character n-grams of 3 to 6 bytes within words, the
word's two edges included, hashed into 2**BITS rows of an embedding table. A text's
vector is the average of its n-grams' rows, weighted by inverse document frequency; a
softmax over two classes follows. Embeddings and softmax are learned together by
stochastic gradient descent, one text at a time. An unseen misspelling shares most
n-grams with its word and so its place.

The classifier is fitted on a bounded sample of labelled rows, `max_positive` and
`max_negative`, those with the smallest hash of doc_id, and at most `max_bytes` of text.
Scoring covers every whole text. Labels, lang, source and doc_id are no inputs.

Defined results: null and empty texts, and texts without known n-grams, get the softmax
of the bias alone; without labels of both classes every score is the share of label 1
among the labels, 0 without any; several labels of a document count as the largest;
repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_schema, bounded, id_and_text, map_batches, release, table

BITS, DIM, SIZES = 18, 8, (3, 4, 5, 6)
MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES = 1500, 3000, 48 << 20
THRESHOLD = 0.7

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[T.ALNUM] = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)[T.ALNUM]


def bags(column: pa.Array):
    """(first document, buckets, counts' boundaries) run by run: each document's distinct n-gram buckets."""
    data, off = T.column_bytes(column)
    for i, j in T.runs(off, T.RUN_BYTES // 4):
        n = j - i
        part = data[off[i] : off[j]]
        at = off[i : j + 1] - off[i] + np.arange(n + 1)  # a separator stands before each document and after the last
        spaced = np.full(len(part) + n + 1, 32, np.uint8)
        keep = np.ones(len(spaced), bool)
        keep[at] = False
        spaced[keep] = _NORMAL[part]
        letter = spaced != 32
        value = T._BYTE_VALUE[spaced]
        h, inner, size = value, np.ones(len(spaced), bool), len(spaced)
        places, buckets = [], []
        for k in range(1, max(SIZES)):
            m = size - k
            if m <= 0:
                break
            inner = inner[:m] & letter[k - 1 : k - 1 + m] if k >= 2 else inner[:m]
            h = h[:m] * T._BASE + value[k : k + m]
            if k + 1 in SIZES:
                p = np.flatnonzero(inner)
                places.append(p)
                buckets.append(T.mix(h[p]) >> np.uint64(64 - BITS))
        p = np.concatenate(places) if places else np.empty(0, np.int64)
        key = (np.searchsorted(at, p, "right") - 1).astype(np.uint64) << np.uint64(BITS)
        key |= np.concatenate(buckets) if buckets else np.empty(0, np.uint64)
        key.sort()
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        doc = (key >> np.uint64(BITS)).astype(np.int64)
        yield i, (key & np.uint64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(doc, np.arange(n + 1))


@dataclass
class Model:
    """weight: what a bucket adds to the log odds; share: its part in the average."""

    weight: np.ndarray
    share: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for first, bucket, edge in bags(column):
            share = self.share[bucket].astype(np.float64)
            total = np.r_[0.0, np.cumsum(share)]
            logit = np.r_[0.0, np.cumsum(share * self.weight[bucket])]
            over = total[edge[1:]] - total[edge[:-1]]
            z = np.divide(logit[edge[1:]] - logit[edge[:-1]], over, out=np.zeros(len(over)), where=over > 0) + self.bias
            out[first : first + len(over)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def train(texts: list[str | None], labels: list[int], *, epochs: int = 5, rate: float = 0.3, seed: int = 17) -> Model:
    """Embeddings and softmax, jointly."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 500.0 if p == 1 else -500.0)
    docs = [b[e[k] : e[k + 1]] for _, b, e in bags(pa.array(texts, pa.string())) for k in range(len(e) - 1)]
    seen = np.zeros(1 << BITS, np.int64)
    for d in docs:
        seen[d] += 1
    share = np.where(seen >= 3, np.log((len(docs) + 1) / (seen + 1.0)), 0).astype(np.float32)
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            d = docs[i]
            v = share[d]
            total = v.sum()
            if total <= 0:
                continue
            v = v / total
            rows = table_[d]
            h = v @ rows
            z = h @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = out @ g
            table_[d] = rows - (step / max(float(v @ v), 1e-6)) * v[:, None] * back[None, :]  # a row occurs once a text
            out -= step * 0.1 * np.outer(h, g)
            bias -= step * 0.1 * g
    return Model(table_ @ (out[:, 1] - out[:, 0]), share, float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, *, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_bytes: int = MAX_BYTES) -> Model:
    """A model from at most max_positive + max_negative labelled rows outside fold 1."""
    spark = bounded(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 1)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, max_positive), (0, max_negative))]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # max_positive + max_negative rows at most
    rows = id_and_text(docs).join(chosen, "doc_id").withColumn("bytes", F.octet_length("text"))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    texts, ys, size = [], [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_positive + max_negative).toLocalIterator():
        if size + (r.bytes or 0) <= max_bytes:
            texts.append(r.text)
            ys.append(r.toxic)
            size += r.bytes or 0
        r = None
    model = train(texts, ys)
    del texts
    release()  # the driver works on, and has little memory
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every text."""
    schema = arrow_schema("doc_id long, score double")
    return map_batches(id_and_text(docs, id_col, text_col), lambda b: T.batches_of([b.column(0), model.score(b.column(1))], schema.names, schema), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is under the threshold, all columns as they were."""
    at = docs.columns.index(text_col)

    def clean(b):
        keep = model.score(b.column(at).cast(pa.string())) < threshold
        return b.filter(pa.array(keep)) if keep.any() else None

    return map_batches(docs, clean, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
