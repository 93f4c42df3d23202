"""Named queries of this subpackage with their optional SQL checks."""

from __future__ import annotations

from emberline.plans.registry import Query, QueryFn

QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[key] = Query(key, fn, sql)
        return fn
    return register


def load_all() -> dict[str, Query]:
    import corpus_pipeline
    from emberline.llm import (ann, binary_ids, codebooks, importance, langid, lattice, mixture, neardup, packing, paragraphs, quality,  # noqa: F401
                               toxicity, windows)
    QUERIES["pipeline"] = Query("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
    return QUERIES
