"""The data model over the fixture tables, and the registered queries by theme."""

import importlib

THEMES = ("temporal_queries", "graph_queries", "similarity_queries", "library_queries", "knowledge_queries", "scoring_queries", "source_queries", "cluster_queries", "theme_queries")


def load_all() -> None:
    """Imports every theme, which registers its queries."""
    for name in THEMES:
        importlib.import_module(f"threadloom.plans.{name}")
