"""All registered queries of the calendar engine, with the SQL that checks them."""

from __future__ import annotations

from calspark.plans import calendar, grids, imports, recurrences, reminding, statistics, streams, texts  # noqa: F401  they register their queries
from calspark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
