"""All registered queries: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""
from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


from . import datasets, evaluation, scalars, scoring, training  # noqa: E402, F401
