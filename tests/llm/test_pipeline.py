"""The pipeline's stages against plain Python, each on what the one before kept."""

from __future__ import annotations

import hashlib
import random
import weakref

import pyarrow as pa
import pytest

import corpus_pipeline
from loomframe.llm import bpe, common, minhash, toxicity
from loomframe.llm.queries import queries

from .helpers import alnum, prose
from .test_models import BAD
from .test_similarity import plain_lines, reach, shingle_set


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    passage = prose(900, 30)
    docs, labels = [], []
    for i in range(150):
        w = prose(1000 + i, r.randint(20, 90)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 15)):
                w[r.randrange(len(w))] = r.choice(BAD)
        text = " ".join(w)
        if i % 10 == 3:
            text += "\n" + passage if i % 20 == 3 else "\nthe same line stands in many of these texts"
        docs.append((i, text))
        if i < 140:
            labels.append((i, 1, int(toxic)))
    docs += [(200 + k, docs[k][1]) for k in (1, 2, 5)] + [(300, None), (301, ""), (302, docs[6][1] + " one more word")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs), passage


def test_every_stage(spark, tables):
    d, texts, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns, name
        rows = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
            score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
            want = {i: t for i, t in kept.items() if score[i] < toxicity.THRESHOLD}
            assert sum(i % 4 == 0 for i in range(150)) - sum(i % 4 == 0 and i < 150 for i in want) > 18  # of 38, learnt from 25 or so
            assert sum(i % 4 > 0 and i < 150 for i in want) > 105
        elif name == "line_dedup":
            gone = plain_lines(sorted(kept.items()))
            want = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in kept.items()}
            assert gone and all(rows[i].n_chars == (None if t is None else len(t)) for i, t in want.items())
        elif name == "minhash_near_dedup":
            sets = {i: shingle_set(t) for i, t in kept.items()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= minhash.PERCENT * len(sets[a] | sets[b])]
            want = {i: t for i, t in kept.items() if reach(sets, links)[i] == i}
        else:
            item = alnum(passage)
            windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
            want = {i: t for i, t in kept.items() if not any(tuple(alnum(t)[k : k + 10]) in windows for k in range(len(alnum(t))))}
            assert len(want) < len(kept)
        assert {i: r.text for i, r in rows.items()} == want, name
        kept = want
        docs = spark.createDataFrame([tuple(rows[i]) for i in rows], docs.schema)
    own = bpe.Bpe(bpe.default_path())
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert final.keys() == kept.keys()
    for i, t in kept.items():
        ids = own.encode(t or "").tolist()
        assert list(final[i].ids) == ids and final[i].n_tokens == len(ids)
        assert final[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert final[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_short_repeated_lines_go(spark):
    """Lines of one to four words too; lines without words stay."""
    r = random.Random(12)
    rows = [(i, "\n".join(["Share this", prose(3000 + i, 12), "", "  ", r.choice(["Home", "home", "ad", "a b c d", "d c b a", "a b c e"])])) for i in range(40)] + [(50, None), (51, "share THIS")]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    gone = plain_lines(rows, least=1)
    assert sum(k == 0 for _, k in gone) == 40 and not any(k in (2, 3) for _, k in gone)
    got = {x.doc_id: x for x in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    for i, t in rows:
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert (got[i].text, got[i].n_chars) == (want, None if t is None else len(want))


def test_contaminated_documents_without_ids_go(spark, tables):
    d, _, passage = tables
    rows = [(None, "x " + passage), (None, "clean"), (-1, "clean"), (4, passage), (None, None)]
    out = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), d)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows[1:3] + rows[4:]))


def test_stages_on_empty_tables(spark, tables):
    d, *_ = tables
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_workers_give_memory_back_between_stages(spark, tables, monkeypatch):
    """A worker keeps the vocabulary for tasks that encode alone, and what scoring took goes before stages without Python."""
    d, *_ = tables
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    runs, released = [], []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    monkeypatch.setattr(common, "release", lambda: released.append(1))
    bpe.round_trip(df, bpe.default_path())
    toxicity.keep_clean(df, toxicity.train(["a fine day", "you idiot"], [0, 1]), threshold=2)
    encode, clean = runs
    work = lambda run: [b.num_rows for b in run(iter([pa.record_batch({"doc_id": [1, 2], "text": ["some words", None]})]))]
    assert work(encode) == [2]
    held = weakref.ref(bpe.loaded(bpe.default_path()))
    assert work(encode) == [2] and held() is not None
    released.clear()
    assert work(clean) == [2] and len(released) == 2 and held() is None  # for what went, and after the batch
