"""Tokens, scans and token files against plain Python, on whole small tables."""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import bpe, common, decontaminate, licenses, secrets, tokenfile
from loomframe.llm import text as T

from .helpers import alnum, corpus, frame, spaced

TEXTS = [t for _, t in corpus()]


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    for kind, plain in ((T.SPACED, spaced), (T.ALNUM, alnum)):
        got = [w.word(k).decode() for w in T.words_in(pa.array(texts, pa.string()), kind, 40) for k in range(len(w.hashes))]
        assert got == [w for t in texts for w in plain(t)]


def test_equal_words_have_equal_hashes_and_others_not():
    words = sorted({w for t in TEXTS for w in spaced(t)})
    hashes = T.hash_words([" ".join(words)], T.SPACED)
    assert len(set(hashes.tolist())) == len(words) == len(hashes)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    for t in [*(t or "" for t in TEXTS), "a\n b\t\tc  ", " x", "x ", "don't WE'LL", "   ", "<|endoftext|><|endoftext|>"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(frame(spark), path), path)).collect()}
    assert len(rows) == len(TEXTS) and rows[1].n_tokens == 0
    assert rows[11].n_tokens == len(library.encode(TEXTS[10], add_special_tokens=False).ids)
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_bpe_in_one_worker_equals_its_steps(spark):
    path = bpe.default_path()
    steps = bpe.digests(bpe.decode(bpe.encode(frame(spark), path), path), with_ids=True)
    once = bpe.round_trip(frame(spark), path, with_ids=True)
    assert once.schema == steps.schema
    assert sorted(once.collect(), key=str) == sorted(steps.collect(), key=str)
    assert bpe.round_trip(frame(spark, []), path).count() == 0


def test_bpe_memory_loses_its_older_half(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    own = bpe.Bpe(bpe.default_path())
    fresh = bpe.Bpe(bpe.default_path())
    monkeypatch.setattr(bpe, "MEMORY", 10)
    assert all((own.encode(t).tolist() == fresh.encode(t).tolist()) for t in (TEXTS[6], TEXTS[10], TEXTS[6]))
    assert len(own._spaced) <= 10


@given(st.lists(st.integers(0, 60_000), max_size=300), st.integers(1, 8), st.integers(4, 50))
@settings(max_examples=40, deadline=None)
def test_range_coding_round_trips(ids, lanes, block):
    ids = np.array(ids, np.int64)
    symbols, freqs = tokenfile.table_of(ids)
    if not len(ids):
        return
    assert freqs.sum() == 1 << tokenfile.SCALE and freqs.min() >= 1
    coded = list(tokenfile.encode_blocks(np.searchsorted(symbols, ids), freqs, lanes, block))
    back = tokenfile.decode_blocks([w for _, w, _ in coded], [n for n, _, _ in coded], np.stack([s for _, _, s in coded]), symbols, freqs, lanes)
    assert np.concatenate(back).tolist() == ids.tolist()


def test_token_files_hold_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenfile.default_path())
    folder = common.shared_path(spark, "tokens")
    files = tokenfile.write_tokens(frame(spark), tokenfile.default_path(), folder)
    rows = {r.doc_id: r for r in tokenfile.read_tokens(spark, files).collect()}
    start = 0
    for i, t in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, list(rows[i].ids)) == (start, ids)
        start += len(ids)
    path = files.first().file
    whole = list(tokenfile.TokenFile(path).blocks())
    assert [x.tolist() for x in tokenfile.TokenFile(path).blocks(len(whole) - 1)] == [whole[-1].tolist()]
    data = bytearray(open(path, "rb").read())
    data[-2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        list(tokenfile.TokenFile(path).blocks())


def test_token_files_of_an_empty_table(spark):
    files = tokenfile.write_tokens(frame(spark, []), tokenfile.default_path(), common.shared_path(spark, "tokens"))
    assert tokenfile.read_tokens(spark, files).count() == 0


def test_secrets_are_confirmed_by_structure():
    body = b"\x02\x01\x00" + b"\x02\x20" + bytes(range(32)) + b"\x30\x03\x02\x01\x05"
    der = b"\x30" + bytes([len(body)]) + body
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(der).decode()}\n-----END PRIVATE KEY-----"
    seg = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    jwt = f"{seg({'alg': 'HS256'})}.{seg({'sub': '1'})}.c2lnbmF0dXJl"
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = "ssh-rsa " + base64.b64encode(field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(bytes(64))).decode()
    kinds = lambda x: {k for k, _, _ in secrets.find_secrets(x)}
    assert "pem" in kinds(pem) and "pem" not in kinds(pem.replace("MCoC", "MCsC"))
    assert "jwt" in kinds(f"x {jwt} y") and "jwt" not in kinds("x eyJub3QganNvbg.eyJub3QganNvbg.abc y")
    assert "ssh" in kinds(ssh) and "ssh" not in kinds("ssh-rsa AAAAB3NzaC1yc2EBBBB")
    assert "der" in kinds(der.hex()) and "der" not in kinds("30" + "ab" * 40)


def test_base_secrets(spark):
    t = 'PassWord = "abcdefgh" token=abc api_key:token=123456 AKIA' + "A" * 16 + " AKIAshort " + "0a" * 12 + " 0a0a"
    got = secrets.find_secrets(t)
    assert [k for k, _, _ in got] == ["assign", "assign", "access", "hex"]
    assert t[got[0][1] : got[0][2]] == 'PassWord = "abcdefgh'
    rows = secrets.scan_secrets(frame(spark, [(1, None), (2, "é " + t)])).collect()
    assert [len(r.spans) for r in rows] == [0, 4] and rows[1].spans[0].start == 2
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_licenses(spark):
    lines = ["Nothing here", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "the GNU General Public License, version 3 and the MIT license"]
    mit = licenses.TEMPLATES[1][1]
    dropped = " ".join(mit.split()[5:])
    rows = [(1, None), (2, ""), (3, "\n".join(lines)), (4, "x\n" + mit), (5, dropped), (6, "mit\nlicense " + "word " * 3000), (7, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (got[1].n_words, got[1].labels, got[1].score, got[1].first_word) == (0, "", 0.0, None)
    assert got[3].base_labels == "apache,gpl,mit" and got[3].n_base == 4 and got[3].first_word == 5
    assert got[4].labels == "mit" and got[5].labels == "mit" and 0.8 <= got[5].score < 1
    assert got[6].n_base == 1 and got[7].labels == "cc-by-nc"
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_wrapped_short_licenses(spark, tmp_path):
    texts = ["x\nLicensed under CC\nBY-NC 4.0\ny", "Licensed\nunder CC\nBY-NC 4.0", "Licensed under CC\n\nBY-NC 4.0", "Licensed under\nx\ny\nCC BY-NC 4.0", "Licensed under CC BY-NC 4.0\nmore"]
    docs = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, wrapped=3).collect()}
    assert [got[i].labels for i in range(5)] == ["cc-by-nc", "cc-by-nc", "", "", "cc-by-nc"]
    assert [len(got[i].matches) for i in range(5)] == [1, 1, 0, 0, 1] and got[0].matches[0].start == 2
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.labels for r in licenses.op4_license_scan(spark, str(tmp_path)).collect()}[0] == "cc-by-nc"


def test_license_join_finds_every_block_over_the_threshold(spark):
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [("t", " ".join(r.sample(vocabulary, 6))) for _ in range(5)]
    rows = [(i, "\n".join(" ".join(r.choices([*vocabulary, "zz"], k=r.randint(1, 9))) for _ in range(4))) for i in range(60)]
    got = {x.doc_id: {(m.template, round(m.containment, 6)) for m in x.matches} for x in licenses.scan_licenses(frame(spark, rows), templates=templates, phrases=()).collect()}
    for i, t in rows:
        want = set()
        for line in t.split("\n"):
            for k, (_, x) in enumerate(templates):
                c = len(set(x.split()) & set(line.split())) / 6
                if c >= 0.8:
                    want.add((k, round(c, 6)))
        assert got[i] == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, block_bytes):
    docs = corpus()
    passage = " ".join(docs[10][1].split()[20:40])
    items = [(1, passage), (2, "two, WORDS"), (3, None), (4, ""), (5, "never there in any text of these at all, not once"), (6, passage), (10, docs[6][1]), (7, "!?")]
    docs = [*docs, (21, "start " + passage + " " + passage), (22, " ".join(reversed(passage.split())))]
    windows = {}
    for k, t in items:
        w = alnum(t)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(k))
    found = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        w, hit, have = alnum(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                some = windows.get(tuple(w[a : a + size]))
                if some:
                    have |= some
                    hit |= set(range(a, a + size))
        assert (got[i].n_words, sorted(have)) == (len(w), list(got[i].items))
        assert {k for h in got[i].hits for k in range(h.start, h.end)} == hit
    assert not got[22].items and "1" in got[22].near_items


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_decontamination_without_ids(spark, block_bytes):
    known, nameless = "a passage that has its own number", "another passage that has none at all"
    docs = [(None, "x " + known), (-1, "clean"), (None, "clean too"), (5, nameless + " x"), (6, None), (None, None)]
    items = spark.createDataFrame([("7", known), (None, nameless)], "item_id string, text string")
    found = decontaminate.contamination(frame(spark, docs), items, block_bytes=block_bytes).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, list(r.items), list(r.near_items), [tuple(h) for h in r.hits]) for r in found)
    assert got == [(False, -1, 1, [], [], []), (False, 5, 8, [], [], [(0, 7)]), (False, 6, 0, [], [], []), (True, 0, 0, [], [], []), (True, 0, 2, [], [], []), (True, 0, 8, ["7"], ["7"], [(1, 8)])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_decontamination_keeps_repeated_segments(spark, block_bytes):
    docs = frame(spark, [(1, "one short passage here"), (2, "nothing")])
    items = spark.createDataFrame([("1", "short passage here"), ("2", "never there at all")], "item_id string, text string")
    found = decontaminate.contamination(docs.unionByName(docs), items, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, list(r.items), len(r.hits)) for r in found) == [(1, ["1"], 1)] * 2 + [(2, [], 0)] * 2


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), none).count() == 0
    assert all(not r.items for r in decontaminate.contamination(frame(spark), none).collect())


def test_crc_of_token_query_is_unsigned():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) >= 0


def test_keys_are_found_at_any_place_of_a_run():
    body = b"\x02\x01\x00" + b"\x02\x20" + bytes(range(32)) + b"\x30\x03\x02\x01\x05"
    der = b"\x30" + bytes([len(body)]) + body
    b64 = base64.b64encode(der).decode()
    found = lambda x: [x[a:z] for a, z in secrets.find_der(x)]
    assert found(b64) == found("MAab" + b64) == found(f"x {b64} y") == [b64]
    assert found(b64.rstrip("=") + "abcd") == [b64.rstrip("=")]
    assert found(f"key:\n{b64[:32]}\n{b64[32:]}\nnext") == [f"{b64[:32]}\n{b64[32:]}"]
    assert found(der.hex() + "ab") == found("f" + der.hex()) == [der.hex()]
    assert found("M" * 60) == found("30" * 60) == found(b64[:-8]) == []
    deep = b"\x30\x03\x02\x09\x05"  # the inner integer says more bytes than there are
    bad = b"\x30" + bytes([len(body) + 2]) + body[:-5] + b"\x30\x05" + deep
    assert found(base64.b64encode(bad).decode()) == []


def test_openssh_keys_are_parsed_whole():
    field = lambda b: len(b).to_bytes(4, "big") + b
    key = field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 20) + field(b"s" * 40)
    armour = lambda k: f"-----BEGIN OPENSSH PRIVATE KEY-----\n{base64.b64encode(b'openssh-key-v1' + bytes(1) + k).decode()}\n-----END OPENSSH PRIVATE KEY-----"
    kinds = lambda x: {k for k, _, _ in secrets.find_secrets(x)}
    assert "pem" in kinds(armour(key)) and "pem" not in kinds(armour(key[:-1])) | kinds(armour(key + b"x"))


def test_blank_lines_of_white_space_end_paragraphs(spark):
    notice = "Permission to use, copy, modify, and/or distribute this software for any purpose"
    rest = "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    texts = [f"{notice}\n{rest}", f"{notice}\r\n{rest}", f"{notice}\n \t\n{rest}", f"{notice}\r\n\r\n{rest}"]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(4)] == ["isc", "isc", "", ""]


def test_bpe_decodes_ids_of_no_symbol_and_words_after_spaces():
    model = bpe.loaded(bpe.default_path())
    fresh = bpe.Bpe(bpe.default_path())
    text = "plain words, words plain é word's 12words words"
    want = b"".join(fresh._pieces(p if i == 0 else " " + p) for i, p in enumerate(text.split(" ")))
    assert model.encode(text).tobytes() == want and model.decode([*model.encode(text).tolist(), 10**6]) == text
    assert all(model.first[a << 8 | b] == model.rank_of.get(model.byte_id[a] << 20 | model.byte_id[b], -1) for a in (32, 101, 255) for b in (0, 97, 255))


def test_words_are_tokenised_once(monkeypatch):
    """Memory holds every word of a large vocabulary; when it is full, words are forgotten and found again."""
    words = [f"w{chr(97 + i % 26)}{i:x}" for i in range(250_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    tokens = tokenfile.WordTokens(tokenfile.default_path())
    asked, ids = [], tokens._ids
    monkeypatch.setattr(tokens, "_ids", lambda w: asked.append(w) or ids(w))
    first = [x.tolist() for x in tokens.encode(texts)]
    assert len(asked) == len(words)
    assert [x.tolist() for x in tokens.encode(texts)] == first and len(asked) == len(words)
    assert first[::50] == [tokens.tokenizer.encode(x, add_special_tokens=False).ids for x in texts[::50]]
    monkeypatch.setattr(tokens, "MEMORY", 2500)
    for some in (texts[:3], texts[1:2], texts[2:5], texts[:1], ["", "w, W! é\tw"], texts[4:6]):
        assert [x.tolist() for x in tokens.encode(some)] == [tokens.tokenizer.encode(x, add_special_tokens=False).ids for x in some]
        assert len(tokens.known) <= 2500 and (tokens.known[1:] > tokens.known[:-1]).all()
