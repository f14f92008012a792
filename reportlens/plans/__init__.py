"""Registered queries, one module per area."""

from importlib import import_module

AREAS = ["text_queries", "table_queries", "vector_queries", "explain_queries", "outcome_queries"]


def all_queries() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
