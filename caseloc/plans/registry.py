"""Named queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from . import code_queries, deep_queries, edge_queries, evidence_queries, flow_queries, page_queries, policy_queries, report_queries, reproduction_queries, review_queries, search_queries, stream_queries, summary_queries, term_queries

FLAGSHIP = "flagship"
MODULES = (evidence_queries, page_queries, search_queries, code_queries, flow_queries, deep_queries, edge_queries, policy_queries, report_queries, reproduction_queries, review_queries, stream_queries, summary_queries, term_queries)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
