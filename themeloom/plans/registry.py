"""All queries of the library, each with its SQL where there is one."""

from __future__ import annotations

from themeloom.plans import fitted, lexical, models, structure, topics, vectors  # noqa: F401
from themeloom.plans.register import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
