"""Near-duplicate operators against all pairs on small tables."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomframe.llm import embeddings, lines, minhash
from loomframe.llm.common import shared_dir
from loomframe.llm.components import components

from .helpers import corpus, frame, prose, spaced


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(1, 200), r.randint(1, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame([*links, (None, 4)], "u long, v long")).collect()}
    used = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in reach(used, [x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(t):
    w = spaced(t)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def check_minhash(spark, rows):
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reach(ids, links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_minhash_on_odd_texts(spark):
    check_minhash(spark, corpus())


def test_minhash_in_a_large_group_of_near_copies(spark, monkeypatch):
    """Chains and outliers: the hub alone doesn't join them, so tiles of several blocks must."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(9)
    base = prose(5, 120).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(len(w)), r.choice([0, 1, 2, 4, 6, 9])):
            w[k] = f"new{r.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    chain = prose(6, 60).split(" ")
    for i in range(200, 215):
        chain = chain[2:] + [f"more{i}", f"most{i}"]
        rows.append((i, " ".join(chain)))
    check_minhash(spark, rows)


def test_minhash_with_null_ids_and_repeated_rows(spark):
    text = prose(7, 50)
    got = minhash.near_duplicates(frame(spark, [(None, text), (4, text), (4, text), (9, text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_minhash_signature_agrees_as_jaccard():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 100, dtype=np.uint64)
    x, y = np.sort(a), np.sort(np.concatenate([a[:800], b]))
    keys = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), bands=400, rows=1)
    assert abs((keys[0] == keys[1]).mean() - 0.8) < 0.08


def test_embeddings(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(300):
        v = r.normal(size=16) if i % 3 else rows[r.integers(0, len(rows))][1] + r.normal(size=16) * r.choice([0, 0.02, 0.05]) if rows else r.normal(size=16)
        rows.append((i, np.asarray(v, np.float32).astype(float), int(r.integers(0, 3))))
    rows = [(i, list(map(float, v)), k) for i, v, k in rows]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [math.nan] * 16, 1), (1003, rows[0][1], None), (1004, [1.0], 1), (1005, [], 1), (1006, [None] + [1.0] * 15, 1), (1007, [math.inf] * 16, 1)]
    df = spark.createDataFrame([(*x, "t") for x in rows + odd], "vec_id long, embedding array<float>, label int, node string")
    got = {x.vec_id: x for x in embeddings.near_vectors(df, block=32).collect()}
    m = {i: (np.array(v, np.float32).astype(float), k) for i, v, k in rows}
    links = [(a, b) for a in m for b in m if a < b and m[a][1] == m[b][1] and float(m[a][0] @ m[b][0]) / (np.sqrt(m[a][0] @ m[a][0]) * np.sqrt(m[b][0] @ m[b][0])) >= 0.98]
    assert len(links) > 20
    want = reach(m, links)
    for i in m:
        assert (got[i].n_links, got[i].component_id) == (sum(i in x for x in links), want[i])
    assert all((got[x[0]].n_links, got[x[0]].component_id, got[x[0]].kept) == (0, x[0], True) for x in odd)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 33)) * np.exp(r.normal(size=(200, 1)))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    e = np.linalg.norm(unit - q * scale[:, None], axis=1)
    assert (np.abs((q * scale[:, None]) @ (q * scale[:, None]).T - unit @ unit.T) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()


def plain_lines(rows, percent=80, least=5):
    """Places removed, by all pairs."""
    flat = sorted((i, k, frozenset(x.lower().split())) for i, t in rows if t is not None and i is not None for k, x in enumerate(t.split("\n")))
    out = set()
    for n, (i, k, s) in enumerate(flat):
        if len(s) >= least and any(len(o) >= least and 100 * len(s & o) >= percent * len(s | o) for *_, o in flat[:n]):
            out.add((i, k))
    return out


@pytest.mark.parametrize("percent", [80, 60])
def test_lines_equal_brute_force(spark, percent):
    r = random.Random(11)
    base = [f"w{i}" for i in range(30)]
    rows = corpus()[:9] + corpus()[15:18]
    for i in range(100, 160):
        text = []
        for _ in range(4):
            w = list(base[: r.choice([4, 6, 12, 30])])
            for k in r.sample(range(len(w)), r.randint(0, 3)):
                w[k] = f"v{r.randint(0, 40)}"
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    got = {(x.doc_id, x.place) for x in lines.removed_lines(frame(spark, rows, extra=False), percent=percent).collect()}
    assert got == plain_lines(rows, percent)


def test_line_texts_and_columns(spark):
    rows = [*corpus(), (None, "line one of five words\nline one of five words")]
    df = frame(spark, rows)
    out = lines.dedup_lines(df, counts=True)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    gone = plain_lines(rows)
    got = {(x.doc_id): x for x in out.collect()}
    for i, t in rows:
        want = t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i].text == want and got[i].n_removed == (0 if i is None else sum(a == i for a, _ in gone))
    assert got[18].text == "" and got[1].text is None and got[7].node == 1
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_extreme_finite_vectors_link(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 0.0]), (4, [2e200, 0.0]), (5, [0.0, 1e200]), (6, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_tiles_join_what_hubs_do_not(spark, monkeypatch):
    """Many near copies of each other, dealt over several blocks, against all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in r.sample(range(120), r.randint(0, 12)):
            words[k] = f"v{r.randint(0, 10_000)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: want[i] for i in sets} and len(set(got.values())) > 3


def test_counts_take_the_place_of_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f\na b c d e f", 9)], "doc_id long, text string, n_lines long")
    out = lines.dedup_lines(df, counts=True)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"] and out.collect() == [(1, "a b c d e f", 2, 1)]


def test_lines_in_long_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "LIST", 3)
    monkeypatch.setattr(lines, "_CROWDED", 1)
    r = random.Random(8)
    rows = [(i, "\n".join(" ".join(r.choice("abcdefghijklmn") + str(k) for k in range(r.choice([5, 6, 10]))) for _ in range(5))) for i in range(40)]
    rows += [(100 + i, " ".join([f"c{k}" for k in range(20)] + [f"only{i}"])) for i in range(30)]
    got = {(x.doc_id, x.place) for x in lines.removed_lines(frame(spark, rows, extra=False), percent=60).collect()}
    assert got == plain_lines(rows, 60)


def left_behind(spark):
    """Files of tables in the shared folder."""
    root = shared_dir(spark).removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_line_dedup_leaves_only_its_result(spark):
    before = left_behind(spark)
    out = lines.removed_lines(frame(spark, corpus()[:9], extra=False))
    assert left_behind(spark) - before == {f for f in left_behind(spark) if out.held_at.removeprefix("file:") in f}


def test_any_order_of_words_gives_the_same_lines(spark, monkeypatch):
    """Late words meet late words in no list; long lines are told apart by wide parities."""
    monkeypatch.setattr(lines, "SAMPLE", 1 << 40)
    r = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"w{k}" for k in range(r.choice([5, 9, 45, 300]))]
        for k in r.sample(range(len(words)), r.randint(0, len(words) // 7)):
            words[k] = f"v{r.randint(0, 10_000)}"
        rows.append((i, " ".join(r.sample(words, len(words)))))
    got = {(x.doc_id, x.place) for x in lines.removed_lines(frame(spark, rows, extra=False)).collect()}
    assert got == plain_lines(rows) and 0 < len(got) < 40


def test_near_dedup_leaves_no_texts(spark):
    """Only what the result reads stays: signatures, classes and components, no tables of texts or rounds."""
    before = left_behind(spark)
    out = minhash.near_duplicates(frame(spark, corpus()))
    folders = {os.path.dirname(f) for f in left_behind(spark) - before}
    assert len(folders) == 3 and out.count() == len(corpus())


def test_no_table_of_all_lines_is_written(spark, monkeypatch):
    """What is known of a class comes from the first pass; the lines are not written, grouped and shuffled again."""
    tables, written = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df: tables.append(df.columns) or written(df))
    rows = [(1, "a b c d e\nx y\nx y"), (2, "f g h i j\nA  b c d e"), (2, "f g h i j\nA  b c d e"), (3, "e d c b a\nx y\n\n"), (None, "a b c d e")]
    gone = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, gone.collect())) == [(2, 1), (3, 0)]
    assert ["doc_id", "place", "k", "l"] not in tables


@pytest.mark.parametrize(("percent", "least"), [(80, 5), (80, 1), (60, 1), (30, 1)])
def test_keys_of_two_codes_equal_brute_force(spark, monkeypatch, percent, least):
    """Sets that share one word alone, short and long lines, families of near copies, all by crowded words."""
    monkeypatch.setattr(lines, "CROWD", 1)
    monkeypatch.setattr(lines, "LIST", 2)
    r = random.Random(17)
    rows = [(i, "\n".join(" ".join(r.choice("abcdefgh") + str(k) for k in range(r.choice([1, 2, 3, 5, 6, 10]))) for _ in range(4))) for i in range(40)]
    rows += [(100 + i, " ".join([f"c{k}" for k in range(25)] + [f"only{i}"])) for i in range(12)] + [(200, "a0 \n a0"), (201, "A0  b1")]
    got = {(x.doc_id, x.place) for x in lines.removed_lines(frame(spark, rows, extra=False), percent=percent, min_words=least).collect()}
    assert got == plain_lines(rows, percent, least) and got


def test_crowded_codes_are_compared_a_bounded_number_of_times(spark, monkeypatch):
    """Lists of crowded codes are split by a second code, so a row meets few lines however many share the first one."""
    monkeypatch.setattr(lines, "CROWD", 8)
    r = random.Random(23)
    rows = [((i, 0), 10, i, sorted(r.sample(range(100), 4))) for i in range(4000)]
    listed = lines._listed(spark.createDataFrame(rows, "at struct<doc_id long, place int>, n int, par long, prefix array<long>"), 80)[0]
    each = [(x.early, x.rows) for x in listed.groupBy("code").agg(F.sum(F.col("early").cast("int")).alias("early"), F.count("*").alias("rows")).collect()]
    assert sum(a * n for a, n in each) <= 8 * sum(n for _, n in each)
    assert listed.select("x").distinct().count() == 4000
