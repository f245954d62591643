"""Registered queries: each binds operators to the given tables."""

from importlib import import_module

MODULES = ["prepare", "textual", "sample", "search", "decide", "evaluate", "score", "sourcing",
           "stream"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"replylens.plans.{name}")
