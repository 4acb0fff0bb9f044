"""All queries outside the training-data subpackage, with their SQL twins."""

from __future__ import annotations

from . import general, reference, store

_MODULES = [reference, general, store]


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
