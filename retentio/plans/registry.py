"""Single registry of query keys -> Spark callables and DuckDB oracles."""

from __future__ import annotations

from . import oracle_sql as O
from . import queries as Q


def all_queries() -> dict:
    q = {}
    q.update(Q.panel_queries())
    q.update(Q.woe_queries())
    q.update(Q.eval_queries())
    q.update(Q.model_queries())
    q.update(Q.stats_queries())
    return q


def all_oracle_sql() -> dict[str, str]:
    o = {}
    o.update(O.panel_queries())
    o.update(O.woe_queries())
    o.update(O.eval_queries())
    o.update(O.encode_queries())
    o.update(O.model_checks())
    o.update(O.stats_queries())
    return o
