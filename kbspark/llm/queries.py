"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from kbspark.llm import align, bm25, bpe, exact, html, merkle, mixing, ngrams, pivots, repeats, simhash, toxicity, warc

_MODULES = (toxicity, simhash, bm25, bpe, ngrams, repeats, pivots, warc, html, mixing, align, exact, merkle)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
