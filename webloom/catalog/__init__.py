"""Named queries over the stored tables, and the SQL that gives the same rows."""

from __future__ import annotations


def _modules():
    from webloom.catalog import events, pages, rendered, resolution

    return [pages, rendered, events, resolution]


def all_queries():
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
