"""Registered queries of the engine."""

from importlib import import_module

MODULES = ("scalars", "retrieval", "evaluation", "chunking", "comparison", "curation", "guards", "operations", "answers", "incremental", "reports", "streams")


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
