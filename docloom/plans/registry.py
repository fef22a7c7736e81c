"""All queries of the engine's own operators, with their SQL counterparts."""

from __future__ import annotations

from docloom.plans import learning, spans, structure
from docloom.session import guard

PARTS = (spans, structure, learning)


def _guarded(query):
    def run(spark, sf_dir):
        return query(guard(spark), sf_dir)

    return run


def queries() -> dict:
    return {k: _guarded(v) for p in PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.oracle_sql().items()}
