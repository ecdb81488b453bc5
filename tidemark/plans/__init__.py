"""Queries of the engine's operators over the driver's tables, with the SQL that gives the same rows."""

from . import analysis_queries, cohort_queries, contrast_queries, evidence_queries, file_queries, import_queries, integrity_queries, more_queries, provenance_queries, series_queries, space_queries, summary_queries

MODULES = (series_queries, evidence_queries, analysis_queries, space_queries, cohort_queries, import_queries, more_queries, file_queries, integrity_queries, contrast_queries, provenance_queries, summary_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
