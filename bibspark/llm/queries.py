"""Registered queries of the training-data operators and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from . import q_corpus, q_text

QUERIES = {**q_text.QUERIES, **q_corpus.QUERIES}
ORACLES = {**q_text.ORACLES, **q_corpus.ORACLES}
