"""Search, profile, check, change and keep sets of tables with Spark."""

from tablewarden.runtime import build_session
from tablewarden.sources.tables import Reference, TableSet

__all__ = ["Reference", "TableSet", "build_session"]
