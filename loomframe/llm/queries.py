"""All queries of the subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import bpe, decontaminate, embeddings, language_model, licenses, lines, minhash, secrets, tokenfile, toxicity

MODULES = (minhash, bpe, toxicity, licenses, embeddings, lines, tokenfile, language_model, decontaminate, secrets)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in MODULES for k, f in m.ORACLE_SQL.items()}
