"""Small tables and the plain forms of what the operators compute."""

from __future__ import annotations

import random
import re

LOWER = {c: c + 32 for c in range(65, 91)}


def spaced(x):
    return re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOWER))


def alnum(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))


def prose(seed, words):
    r = random.Random(seed)
    syllables = "the of an re ti er on st ou ble tion ha ing wh Éau ß ñ".split()
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(words))


def corpus():
    """(doc_id, text) with nulls, empty and very long texts, copies, near copies, short texts and odd characters."""
    base = prose(1, 300)
    words = base.split(" ")
    near = " ".join(w if i not in (40, 150) else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 9 else "other" for i, w in enumerate(words))
    out = [
        (1, None), (2, ""), (3, "  \t \n"), (4, "One"), (5, "one"), (6, "two words"), (7, base), (8, base), (9, near), (10, far),
        (11, prose(2, 80)), (12, prose(3, 20_000)), (13, prose(3, 20_000) + " end"), (14, "a\x1cb  c d <|endoftext|> 😀 é"), (15, base.upper()),
        (16, "line one of five words\n" + prose(4, 30) + "\nline one of five words"), (17, prose(4, 30) + "\nSomething else entirely is here now"),
        (18, "line one of five words"), (19, None), (20, "x" * 5000),
    ]
    return out


def frame(spark, rows=None, extra=True):
    """documents with columns whose names the operators use inside."""
    rows = corpus() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    wide = [(i, t, "en", None, None if t is None else len(t), 1, "k", [1]) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, node int, set_key string, places array<int>")
