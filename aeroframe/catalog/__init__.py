"""Registered queries over the given tables, each next to its DuckDB counterpart."""


def load() -> None:
    """Import every module that registers queries."""
    from aeroframe.catalog import cleaning, features, matching, scalars, tables  # noqa: F401
