"""Registered queries of the llm subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from censo.llm import addresses, languages, leakage, linkage, packing, spellings, truth


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": truth.p1_found,
        "p4_found": addresses.p4_found,
        "p4_sites": addresses.p4_sites,
        "p5_found": spellings.p5_found,
        "p5_entities": spellings.p5_entities,
        "p7_found": linkage.p7_found,
        "p7_links": linkage.p7_links,
        "p8_packed": packing.p8_packed,
        "p8_certificate": packing.p8_certificate,
        "p9_found": leakage.p9_found,
        "p10_found": languages.p10_found,
        "p10_segments": languages.p10_segments,
    }


def oracle_sql() -> dict[str, str]:
    return {}
