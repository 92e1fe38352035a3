"""All queries of the library's own operators, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from lodestream.plans import behaviour, capture, consensus, documents, grounded, listing, macro, monitoring, search, signals, stored, structure, texts  # noqa: F401  (register on import)
from lodestream.plans.base import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
