"""Registers queries with the SQL that checks them."""

from __future__ import annotations


def register(queries: dict):  # noqa: ANN201
    """A decorator query(sql) that puts a function under its name into queries; sql is None where SQL cannot express it."""

    def query(sql: str | None):  # noqa: ANN202
        def put(f):  # noqa: ANN001, ANN202
            queries[f.__name__] = (f, sql)
            return f

        return put

    return query
