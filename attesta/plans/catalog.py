"""Every query of the library by name, with the SQL that gives the same rows."""

from attesta.plans import claim_queries, document_queries, evidence_queries, graph_queries, prosecution_queries, review_queries, risk_queries, search_queries, typed_graph_queries, validation_queries  # noqa: F401
from attesta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
