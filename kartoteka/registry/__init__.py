"""Every operator bound to the given tables, with the SQL that checks it."""

from __future__ import annotations

from kartoteka.registry import (
    browse,
    landed,
    questions,
    shaping,
    stored,
    submissions,
    vectors,
)
from kartoteka.registry.base import Query

MODULES = (browse, shaping, landed, stored, vectors, questions, submissions)


def registered() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            assert name not in out, name
            out[name] = query
    return out
