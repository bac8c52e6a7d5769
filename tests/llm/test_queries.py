"""The ten queries on the smallest tables: against their SQL, or against plain Python."""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from loomframe.llm.queries import oracle_sql, queries

from .helpers import LOWER, alnum, spaced

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def name(n):
    return next(k for k in queries() if k.startswith(f"op{n}_"))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def result(spark, n):
    return {r[0]: r for r in queries()[name(n)](spark, DATA).collect()}


@pytest.mark.parametrize("n", [1, 5, 6])
def test_sql(spark, n):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    answer = con.execute(oracle_sql()[name(n)])
    columns = [c[0] for c in answer.description]
    got = queries()[name(n)](spark, DATA).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(answer.fetchall())


def test_op2_and_op7(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, words = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    two, seven, start = result(spark, 2), result(spark, 7), 0
    for i, t in sorted(docs.items()):
        ids = plain.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(two[i])[:4] == (i, len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False)))
        ids = [*words.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(seven[i])[:4] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3(spark, docs):
    got = result(spark, 3)
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op4(spark, docs):
    got = result(spark, 4)
    for i, t in docs.items():
        w, at, labels = alnum(t), [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        assert tuple(got[i])[:6] == (i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1


def test_op8(spark, docs):
    got = result(spark, 8)
    train = [[*spaced(t), "</s>"] for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    total = sum(map(len, train))
    for i, t in docs.items():
        assert (got[i].n_tokens, got[i].train_tokens) == (len(spaced(t)) + 1, total) and got[i].score < 0
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op9(spark, docs):
    got = result(spark, 9)
    windows = {}
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = alnum(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    for i, t in docs.items():
        w, hit, items = alnum(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    items |= windows[tuple(w[k : k + size])]
                    hit |= set(range(k, k + size))
        assert tuple(got[i])[:6] == (i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))


def test_op10(spark, docs):
    got = result(spark, 10)
    for i, t in docs.items():
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.ASCII) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(spans))
        assert tuple(got[i])[:5] == (i, *(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(said.encode()).hexdigest())
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))


def test_lower_is_ascii_only():
    assert "ÀB".translate(LOWER) == "Àb"
