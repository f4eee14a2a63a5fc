"""Query catalogue over the given tables."""

from importlib import import_module

from tieout.queries.registry import ORACLES, QUERIES

MODULES = ["scalar_queries", "statement_queries", "note_queries", "result_queries", "crosscheck_queries", "structure_queries", "ingest_queries", "report_queries", "tie_out_queries", "note_audit_queries"]


def load_all():
    for m in MODULES:
        import_module(f"tieout.queries.{m}")
    return QUERIES, ORACLES
