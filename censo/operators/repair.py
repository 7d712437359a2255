"""Damaged codes restored from the evidence of whole ones.

A code that lost one digit is joined to the whole codes it may come from by the deletions of those (at most five keys a code), never by
comparing all codes. Evidence is tiered: the same centre, then the same town, then the town's prefixes; a tie within a tier settles nothing
and does not fall through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_deletions(code: Column) -> Column:
    """The distinct texts that remain when one character of ``code`` is left out."""
    n = F.length(code)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(code, F.lit(1), i - 1), F.substring(code, i + 1, n))))


def triangulate(rows: DataFrame, id_col: str, code: str, centre: str, town: str, length: int = 5, weight: str | None = None) -> DataFrame:
    """(id, codigo, base): every row's code, repaired where evidence settles it; base 'centro', 'localidad', 'provincia' or null.

    Only codes of exactly ``length`` - 1 digits are repaired, and only whole codes vote. Null codes stay null, other codes as they are. Votes are
    counted per (scope, code) first, so frequent centres and towns cost one row per code; a row has ``weight`` votes, 1 without it.
    """
    votes_of = F.col(weight) if weight else F.lit(1)
    r = rows.select(F.col(id_col).alias("id"), F.trim(code).alias("c"), F.col(centre).alias("centro"), F.col(town).alias("localidad"), votes_of.cast("bigint").alias("v"))
    whole = r.filter(F.col("c").rlike(f"^[0-9]{{{length}}}$"))
    short = r.filter(F.col("c").rlike(f"^[0-9]{{{length - 1}}}$"))

    def tier(scope: str) -> DataFrame:
        votes = whole.filter(F.col(scope).isNotNull()).groupBy(scope, F.col("c").alias("w")).agg(F.sum("v").alias("n"))
        keyed = votes.select(scope, "w", "n", F.explode_outer(one_deletions(F.col("w"))).alias("c"))
        seen = short.select(scope, "c").distinct().join(keyed, [scope, "c"])
        top = seen.groupBy(scope, "c").agg(F.max("n").alias("n"))
        best = seen.join(top, [scope, "c", "n"]).groupBy(scope, "c").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("k"))
        return best.select(scope, "c", F.when(F.col("k") == 1, F.col("w")).alias(f"w_{scope}"), F.lit(True).alias(f"hay_{scope}"))

    prefixes = whole.filter(F.col("localidad").isNotNull()).select("localidad", F.substring("c", 1, 2).alias("pre")).distinct().withColumn("hay_pre", F.lit(True))
    s = short.withColumn("padded", F.lpad("c", length, "0")).withColumn("pre", F.substring("padded", 1, 2))
    s = s.join(tier("centro"), ["centro", "c"], "left").join(tier("localidad"), ["localidad", "c"], "left").join(prefixes, ["localidad", "pre"], "left")
    code_ = F.when(F.col("hay_centro"), F.col("w_centro")).when(F.col("hay_localidad"), F.col("w_localidad")).when(F.col("hay_pre"), F.col("padded"))
    base = F.when(F.col("hay_centro"), F.lit("centro")).when(F.col("hay_localidad"), F.lit("localidad")).when(F.col("hay_pre"), F.lit("provincia"))
    fixed = s.select("id", F.coalesce(code_, F.col("c")).alias("codigo"), F.when(code_.isNotNull(), base).alias("base"))
    rest = r.filter(~F.coalesce(F.col("c").rlike(f"^[0-9]{{{length - 1}}}$"), F.lit(False))).select("id", F.col("c").alias("codigo"), F.lit(None).cast("string").alias("base"))
    return fixed.unionByName(rest)
