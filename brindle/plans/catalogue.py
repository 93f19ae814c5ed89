"""All queries of the library by name, with their SQL where SQL expresses them."""

from __future__ import annotations

from brindle.plans import flow, gates, ingest, ledger, memory, pieces, retrieval, review, storage, streams, texts, verify, workflow

ALL: dict = {}
for _part in (retrieval, texts, pieces, verify, gates, memory, storage, review, streams, ingest, ledger, flow, workflow):
    if twice := ALL.keys() & _part.QUERIES.keys():
        raise ValueError(f"queries registered twice: {sorted(twice)}")
    ALL |= _part.QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
