"""Operators for training corpora. Nothing else in the package imports this subpackage.

Its modules are imported here, so that a missing library shows when the subpackage is imported and the registry goes on without it.
"""

from yarrow.llm import alikes, borda, copies, encoding, leaks, mojibake, neighbours, scans, sentences, splitting

_MODULES = (mojibake, alikes, splitting, copies, neighbours, scans, borda, encoding, leaks, sentences)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
