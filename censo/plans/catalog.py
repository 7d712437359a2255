"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from censo.plans import centres, completion, gold, identity, landscape, nested, profile, quality, streams

REGISTRIES = (landscape.query, gold.query, identity.query, centres.query, profile.query, streams.query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "p2_found": nested.p2_found,
        "p2_tables": nested.p2_tables,
        "p3_found": quality.p3_found,
        "p3_profile": quality.p3_profile,
        "p6_found": completion.p6_found,
        "p6_filled": completion.p6_filled,
        "p6_series": completion.p6_series,
    }
    for r in REGISTRIES:
        out |= r.queries
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {"p6_series": completion.P6_SERIES_SQL}
    for r in REGISTRIES:
        out |= r.sql
    return out
