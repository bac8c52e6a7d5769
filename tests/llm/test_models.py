"""Toxicity by held-out accuracy, the language model against its formulas."""

from __future__ import annotations

import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomframe.llm import common, language_model, toxicity

from .helpers import corpus, frame, prose, spaced

BAD = ["idiot", "moron", "scumbag", "worthless"]


def labelled(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = prose(seed * 10_000 + i, r.randint(5, 60)).split(" ")
        y = i % 3 == 0
        if y:
            for _ in range(max(1, len(w) // 20)):
                w[r.randrange(len(w))] = r.choice(BAD)
        out.append((" ".join(w), int(y)))
    return out


def test_toxicity_held_out():
    rows, test = labelled(400, 1), labelled(200, 2)
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    score, y = model.score(pa.array([t for t, _ in test])), np.array([k for _, k in test])
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.95 and (score[y == 0] < toxicity.THRESHOLD).mean() > 0.95
    odd = model.score(pa.array(["you idiots are here", "you tables are here"]))
    assert odd[0] > odd[1]  # a word not seen shares n-grams


def test_toxicity_of_odd_rows(spark):
    model = toxicity.train(*map(list, zip(*labelled(60, 3), strict=True)))
    rows = toxicity.score(frame(spark), model).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 for r in rows)
    df = frame(spark)
    assert toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.keep_clean(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("labels, want", [([], 0.0), ([(7, 1, 1)], 1.0), ([(7, 1, 0)], 0.0), ([(7, None, None), (None, 1, 1)], 0.0)])
def test_toxicity_without_both_labels(spark, labels, want):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark), table)
    assert {round(r.score, 6) for r in toxicity.score(frame(spark), model).collect()} == {want}


def test_toxicity_gives_the_driver_s_memory_back(spark, monkeypatch):
    done, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *x: (train(*x), done.append("train"))[0])
    monkeypatch.setattr(toxicity, "release", lambda: done.append("release"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (10, 1), (11, 0)], "doc_id long, toxic int")
    toxicity.fit(frame(spark), labels)
    assert done == ["train", "release"]


def test_language_model_equals_its_formulas(spark):
    docs = [(100 + i, prose(i % 7 + 20, 40)) for i in range(40)] + corpus()[:6]
    train = docs[:30]
    model = language_model.train(frame(spark, train).select("text"), common.shared_path(spark, "model"), partition_bytes=1 << 10)
    got = {r.doc_id: r for r in language_model.score(frame(spark, docs), model).collect()}
    texts = [[*spaced(t), "</s>"] for _, t in train]
    c = collections.Counter(w for t in texts for w in t)
    pairs = collections.Counter(p for t in texts for p in zip(["<s>", *t[:-1]], t, strict=True))
    total, after, follows = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for (v, w), k in pairs.items():
        total[v] += k
        after[min(k, 3)][v] += 1
        follows[w] += 1
    d, e = ([0, *language_model.discounts(*(sum(x == k for x in counts.values()) for k in range(1, 5)))[1:]] for counts in (pairs, follows))
    n, size, kinds = sum(c.values()), len(c), len(pairs)
    rest = sum(e[min(k, 3)] for k in follows.values()) / kinds

    def p(v, w):
        low = max(follows[w] - e[min(follows[w], 3)], 0) / kinds + rest / (size + 1)
        return low if not total[v] else max(pairs[v, w] - d[min(pairs[v, w], 3)], 0) / total[v] + sum(d[k] * after[k][v] for k in (1, 2, 3)) / total[v] * low

    assert math.isclose(sum(p("<s>", w) for w in c) + p("<s>", "never"), 1)
    assert model.sums["tokens"] == n and model.sums["vocabulary"] == size
    for i, t in docs:
        w = [*spaced(t), "</s>"]
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(c[x] > 0 for x in w)
        assert math.isclose(got[i].score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (size + 1))) for x in w), rel_tol=1e-9)


def test_language_model_of_order_three_equals_its_formulas(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FLUSH", 500)
    docs = [(100 + i, prose(i % 7 + 20, 40)) for i in range(40)] + corpus()[:6] + [(200, "a b " * 400), (201, "b a c")]
    train = docs[:30] + docs[-2:-1]
    model = language_model.train(frame(spark, train).select("text"), common.shared_path(spark, "model"), order=3, partition_bytes=1 << 10)
    got = {r.doc_id: r for r in language_model.score(frame(spark, docs), model).collect()}
    begun = [["<s>", "<s>", *spaced(t), "</s>"] for _, t in train]
    triples = collections.Counter(x for t in begun for x in zip(t, t[1:], t[2:], strict=False))
    pairs, follows = collections.Counter(x[1:] for x in triples), collections.Counter()
    for _, w in pairs:
        follows[w] += 1
    d3, d2, d1 = ([0, *language_model.discounts(*(sum(x == k for x in counts.values()) for k in range(1, 5)))[1:]] for counts in (triples, pairs, follows))
    after = collections.defaultdict(list)
    for table in (triples, pairs):
        for x, k in table.items():
            after[x[:-1]].append(k)
    rest = sum(d1[min(k, 3)] for k in follows.values()) / len(pairs)

    def p(*x):
        if len(x) == 1:
            return max(follows[x[0]] - d1[min(follows[x[0]], 3)], 0) / len(pairs) + rest / (len(follows) + 1)
        counts, d, low = (triples, d3, p(*x[1:])) if len(x) == 3 else (pairs, d2, p(*x[1:]))
        seen = after[x[:-1]]
        return low if not seen else max(counts[x] - d[min(counts[x], 3)], 0) / sum(seen) + sum(d[min(k, 3)] for k in seen) / sum(seen) * low

    assert triples["a", "b", "a"] > 255 and math.isclose(sum(p("a", "b", w) for w in follows) + p("a", "b", "never"), 1)
    for i, t in docs:
        w = ["<s>", "<s>", *spaced(t), "</s>"]
        assert got[i].n_tokens == len(w) - 2
        assert math.isclose(got[i].score, sum(math.log10(p(*x)) for x in zip(w, w[1:], w[2:], strict=False)), rel_tol=1e-9)


def test_language_model_query_has_order_three(spark, tmp_path):
    """The word before the last tells what follows; pairs alone cannot."""
    rows = [(i, " ".join(f"{a} m {a}{a}" for a in "pq" * 6)) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = language_model.op8_language_model(spark, str(tmp_path)).collect()
    assert {r.perplexity < 1.3 for r in out} == {True}


def test_language_model_of_nothing(spark):
    model = language_model.train(frame(spark, []).select("text"), common.shared_path(spark, "model"))
    assert {r.score for r in language_model.score(frame(spark), model).collect()} == {0.0}
    assert language_model.score(frame(spark, []), model).count() == 0


def test_counts_over_the_byte_are_kept(spark):
    model = language_model.train(frame(spark, [(1, "a " * 700)]).select("text"), common.shared_path(spark, "model"))
    a = language_model.T.hash_words(["a"], language_model.T.SPACED)
    assert model.pairs(a, a).tolist() == [699]


def test_partitions_of_the_model_are_joined_in_little_memory(spark, monkeypatch, tmp_path):
    lm = language_model
    taken = []
    monkeypatch.setattr(lm, "map_batches", lambda df, fn, schema: taken.append(fn) or df)
    lm._merge_grams(spark.createDataFrame([], lm.BLOCKS), str(tmp_path), 8, 3)
    r, n = np.random.default_rng(1), 50_000
    blocks = [lm._pack_grams([r.integers(1, 1 << 12, n).astype(np.uint64) << np.uint64(40) for _ in range(3)], np.ones(n, np.int64)) for _ in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([blocks], pa.list_(pa.binary()))], ["part", "blocks"])
    del blocks
    tracemalloc.start()
    try:
        for _ in taken[0](batch):
            pass
        assert tracemalloc.get_traced_memory()[1] < 160 * 8 * n  # a gram takes 32 bytes
    finally:
        tracemalloc.stop()
