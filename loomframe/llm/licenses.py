"""License scans: an exact set-similarity join of text blocks against license templates.

Blocks are the lines of a document and, for templates of LONG words or more, its
paragraphs (lines between those that hold white space at most, as a lone \\r does). With `wrapped` above 1, shorter templates are also
looked for in up to so many neighbouring lines of a paragraph, and given where no fewer lines hold them.
A template is found in a block when at least `threshold` of the template's distinct
words are among the block's. Words are ordered by their count over the whole corpus,
rarest first. With `need = ceil(threshold * |template|)`, a block that reaches it
must hold one of the template's first `|template| - need + 1` words (prefix filter),
must have `need` template words at all (length filter), and, at the first word in
common, enough words after it on both sides (positional filter). Survivors are
verified on full sets. The only broadcast data are the templates, a constant of
the program, and the counts of their words.

Defined results: a null text is empty; an empty text has no words, no places, null
first and last word, empty labels and score 0. Repeated rows give repeated results.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_schema, id_and_text, map_batches, table

#: Phrases whose consecutive words name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Customary notices of public licenses, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]

#: Templates of at least so many distinct words are also looked for in paragraphs; a shorter one's
#: words would come together by chance in a long paragraph.
LONG = 12

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,template:int,start:long,end:long,containment:double>>"


def _counts(df: DataFrame, vocab: np.ndarray) -> dict[int, int]:
    """Count over all texts of each word of the templates."""
    schema = arrow_schema("word long, n long")

    def count(batch):
        total = np.zeros(len(vocab), np.int64)
        for w in T.words_in(batch.column(1), T.ALNUM):
            at = np.searchsorted(vocab, w.hashes)
            at[at == len(vocab)] = 0
            total += np.bincount(at[vocab[at] == w.hashes], minlength=len(vocab))
        return T.batches_of([np.arange(len(vocab)), total], schema.names, schema)

    rows = map_batches(df, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=tuple(TEMPLATES), phrases=tuple(PHRASES.items()), threshold: float = 0.8, wrapped: int = 1) -> DataFrame:
    """One row a document: phrase places, labels, and the blocks that contain a template (byte offsets)."""
    df = id_and_text(docs, id_col, text_col)
    sets = [np.unique(T.hash_words([x], T.ALNUM)) for _, x in templates]
    vocab = np.unique(np.concatenate(sets))
    counts = _counts(df, vocab)
    order = np.argsort([counts.get(i, 0) for i in range(len(vocab))], kind="stable")
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))  # rarest first, ties by hash
    ranked = [np.sort(rank[np.searchsorted(vocab, s)]) for s in sets]
    need = [math.ceil(threshold * len(s) - 1e-9) for s in ranked]
    probes: dict[int, list[tuple[int, int]]] = {}  # rank of a prefix word: templates and the word's place in them
    for k, s in enumerate(ranked):
        for p, x in enumerate(s[: len(s) - need[k] + 1].tolist()):
            probes.setdefault(x, []).append((k, p))
    is_probe = np.zeros(len(vocab), bool)
    is_probe[list(probes)] = True
    is_short = np.zeros(len(vocab), bool)
    is_short[[x for x, some in probes.items() if any(len(ranked[k]) < LONG for k, _ in some)]] = True
    members = [set(s.tolist()) for s in ranked]
    labels = [x for x, _ in templates]
    wanted = [(T.hash_words([p], T.ALNUM), label) for p, label in phrases]
    schema = arrow_schema(SCHEMA)

    def best_in(have: np.ndarray, least: int) -> list[tuple[int, float]]:
        """Templates that a block's distinct template words, as ascending ranks, reach."""
        found, seen = [], set()
        for at, x in enumerate(have.tolist()):
            for k, p in probes.get(x, ()):
                if k in seen or len(have) < need[k] or len(ranked[k]) < least:  # length filters
                    continue
                seen.add(k)  # the first word in common, so all that can follow comes after it
                if 1 + min(len(ranked[k]) - p - 1, len(have) - at - 1) < need[k]:  # positional filter
                    continue
                both = len(members[k].intersection(have.tolist()))
                if both >= need[k]:
                    found.append((k, both / len(ranked[k])))
        return found

    def scan(batch):
        ids = batch.column(0).to_pylist()
        for w in T.words_in(batch.column(1), T.ALNUM):
            n = len(w)
            doc = np.repeat(np.arange(n), np.diff(w.doc_start))
            h = w.hashes
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base = [set() for _ in range(n)]
            for phrase, label in wanted:
                m = len(phrase)
                if len(h) < m:
                    continue
                hit = h[: len(h) - m + 1] == phrase[0]
                hit &= doc[: len(h) - m + 1] == doc[m - 1 :]
                for k in range(1, m):
                    hit &= h[k : len(h) - m + 1 + k] == phrase[k]
                at = np.flatnonzero(hit)
                d = doc[at]
                n_base += np.bincount(d, minlength=n)
                np.minimum.at(first, d, at - w.doc_start[d])
                np.maximum.at(last, d, at - w.doc_start[d])
                for x in np.unique(d).tolist():
                    base[x].add(label)
            at = np.searchsorted(vocab, h)
            at[at == len(vocab)] = 0
            own = np.flatnonzero(vocab[at] == h)
            own_rank = rank[at[own]]
            matches: list[list[dict]] = [[] for _ in range(n)]
            newline = np.flatnonzero(w.data == 10)
            seen = np.cumsum(~_WHITE[w.data])  # a line without any but white space ends a paragraph
            blank = newline[np.flatnonzero(seen[newline[1:]] == seen[newline[:-1]])] if len(newline) else newline
            for cuts, least in ((newline, 0), (blank, LONG)):  # lines, then paragraphs
                block = doc[own] + np.searchsorted(cuts, w.start[own])  # ascending, and another one for another document
                edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (doc[own][1:] != doc[own][:-1])]) if len(own) else np.empty(0, np.int64)
                live = np.flatnonzero(np.add.reduceat(is_probe[own_rank], edges)) if len(edges) else edges
                bounds = np.r_[edges, len(own)]
                for b in live.tolist():
                    a, z = bounds[b], bounds[b + 1]
                    d = int(doc[own[a]])
                    for k, c in best_in(np.unique(own_rank[a:z]), least):
                        start = int(w.start[own[a]] - (w.start[w.doc_start[d]] if w.doc_start[d + 1] > w.doc_start[d] else 0))
                        row = {"label": labels[k], "template": k, "start": start, "end": start + int(w.end[own[z - 1]] - w.start[own[a]]), "containment": c}
                        if row not in matches[d]:
                            matches[d].append(row)
            if wrapped > 1 and len(own):
                owner, line, paragraph = doc[own], np.searchsorted(newline, w.start[own]), np.searchsorted(blank, w.start[own])
                edges = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])
                bounds, probed = np.r_[edges, len(own)], np.r_[0, np.cumsum(is_short[own_rank])]
                held: dict[tuple[int, int], set[int]] = {}  # short templates in lines b to e of those that have any template word
                for more in range(wrapped):
                    b = np.arange(max(len(edges) - more, 0))
                    x, y = edges[b], edges[b + more]
                    near = (owner[x] == owner[y]) & (paragraph[x] == paragraph[y]) & (line[y] - line[x] < wrapped) & (probed[bounds[b + more + 1]] > probed[x])
                    for i in np.flatnonzero(near).tolist():
                        a, z, d = edges[i], bounds[i + more + 1], int(owner[edges[i]])
                        fewer = held.get((i, i + more - 1), set()) | held.get((i + 1, i + more), set())
                        found = [(k, c) for k, c in best_in(np.unique(own_rank[a:z]), 0) if len(ranked[k]) < LONG]
                        held[i, i + more] = fewer | {k for k, _ in found}
                        for k, c in found if more else ():
                            if k not in fewer:
                                start = int(w.start[own[a]] - w.start[w.doc_start[d]])
                                matches[d].append({"label": labels[k], "template": k, "start": start, "end": start + int(w.end[own[z - 1]] - w.start[own[a]]), "containment": c})
            none = n_base == 0
            got = [sorted(base[i] | {m["label"] for m in matches[i]}) for i in range(n)]
            yield T.batches_of(
                [
                    ids[w.first : w.first + n], np.diff(w.doc_start), n_base, pa.array(first, mask=none), pa.array(last, mask=none),
                    [",".join(sorted(x)) for x in base], [",".join(x) for x in got],
                    [max([1.0] * bool(base[i]) + [m["containment"] for m in matches[i]], default=0.0) for i in range(n)], matches,
                ],
                schema.names, schema,
            )

    return map_batches(df, scan, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), wrapped=3).drop("matches")


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE_SQL: dict[str, str] = {}
