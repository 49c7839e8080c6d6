"""The given tables as graph tables, and the registered queries over them."""

from . import analytics_queries, contract_queries, corpus_queries, evidence_queries, gap_queries, matching_queries, overview_queries, registry, summary_queries, text_queries

__all__ = ["analytics_queries", "contract_queries", "corpus_queries", "evidence_queries", "gap_queries", "matching_queries", "overview_queries", "registry", "summary_queries", "text_queries"]
