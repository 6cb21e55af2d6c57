"""Registered queries of the catalog operators."""

from __future__ import annotations

from larder.plans import (  # noqa: F401  (they register their queries)
    catalog_plans, curation_plans, extraction_plans, fuzzy_plans, history_plans, listing_plans, menu_plans, place_plans, quality_plans, reader_plans, search_plans, upkeep_plans)
from larder.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
