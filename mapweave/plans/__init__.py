"""Registered queries: each runs one operator over the driver tables."""

from importlib import import_module

_MODULES = ("functions", "mapping", "rules", "profiles", "catalog", "sources", "discovery", "evidence", "audit")

def load_all() -> None:
    """Import every query module so that the registry is filled."""
    for name in _MODULES:
        import_module(f"mapweave.plans.{name}")
