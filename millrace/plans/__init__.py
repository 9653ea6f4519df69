"""Registered queries over the engine's own operators."""

from importlib import import_module

MODULES = ("corpus_queries", "record_queries", "mixing_queries", "metric_queries", "sampling_queries", "run_queries")


def all_queries() -> dict:
    """Every registered query by name."""
    out = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").QUERIES)
    return out


def all_oracles() -> dict:
    """The DuckDB SQL of the queries that have one."""
    out = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").ORACLES)
    return out
