"""Ready-made queries over the given tables."""

import importlib

_MODULES = [
    "search_queries", "profile_queries", "document_queries", "integrity_queries", "change_queries",
    "keep_queries", "fold_queries", "stream_queries", "command_queries", "discovery_queries", "layout_queries",
]


def load() -> None:
    """Import the query modules, which register themselves."""
    for name in _MODULES:
        importlib.import_module(f"tablewarden.plans.{name}")
