"""Registered queries, each beside the SQL that must give the same rows."""

from importlib import import_module

TOPICS = ("sources", "relational", "profiles", "privacy", "quality", "lakehouse", "surface")


def load():
    """All queries by name: (callable, SQL or None)."""
    for topic in TOPICS:
        import_module(f".{topic}", __name__)
    from .registry import ENTRIES
    return ENTRIES
