"""Blocked matching against an authority list, with a verdict and a reason for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scores from which a candidate is near and accepted, and the lead it needs.
FLOOR, ACCEPT, MARGIN = 0.25, 0.50, 0.10
#: Over so many keys the rows of one block are spread.
SALTS = 8


def _best(scored: DataFrame, row_id: str, code: str, keep: int) -> DataFrame:
    return scored.withColumn("rango", F.row_number().over(W.partitionBy(row_id).orderBy(F.desc("score"), code))).filter(F.col("rango") <= keep)


def blocked_candidates(rows: DataFrame, row_id: str, row_tokens: str, catalogue: DataFrame, code: str, code_tokens: str, blocks: list[str], keep: int) -> DataFrame:
    """(row_id, code, score, rango): each row's ``keep`` best candidates by shared over all words, ties by the smaller code.

    Candidates come from equi-joins, one per column of ``blocks`` (present on both sides), never from an OR condition; a pair found by
    several counts once. Null and empty block values match nothing. Word lists hold each word once.

    A block's pairs are scored where they are joined and only each row's best leave it, so no pair is shuffled; the rows of a block are
    spread over ``SALTS`` keys, so that a block with a large share of all rows is no single task.
    """
    top = None
    for b in blocks:
        left = rows.filter(F.col(b).isNotNull() & (F.col(b) != "")).select(row_id, b, F.col(row_tokens).alias("_a"), F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int").alias("_s"))
        right = catalogue.filter(F.col(b).isNotNull() & (F.col(b) != "")).select(code, b, F.col(code_tokens).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
        shared = left.join(right.hint("merge"), [b, "_s"]).select(row_id, code, F.size(F.array_intersect("_a", "_b")).alias("_n"), (F.size("_a") + F.size("_b")).alias("_m"))
        one = _best(shared.select(row_id, code, F.when(F.col("_m") > 0, F.col("_n") / (F.col("_m") - F.col("_n"))).otherwise(F.lit(0.0)).alias("score")), row_id, code, keep)
        top = one if top is None else top.unionByName(one)
    return _best(top.drop("rango").distinct(), row_id, code, keep)


def blocked_match(rows: DataFrame, row_id: str, row_tokens: str, catalogue: DataFrame, code: str, code_tokens: str, blocks: list[str]) -> DataFrame:
    """(row_id, code, score, second, verdict, why) for every row.

    The best of the ``blocked_candidates`` is accepted at ``ACCEPT`` or more when the runner-up is at least ``MARGIN`` behind. Rows without
    candidates get verdict 'sin candidato'.
    """
    best = blocked_candidates(rows, row_id, row_tokens, catalogue, code, code_tokens, blocks, 2)
    at = lambda c, r: F.max(F.when(F.col("rango") == r, F.col(c)))
    two = best.groupBy(row_id).agg(at(code, 1).alias(code), at("score", 1).alias("score"), at("score", 2).alias("second"))
    out = rows.select(row_id).join(two, row_id, "left")
    close = F.coalesce(F.col("score") - F.col("second") < MARGIN, F.lit(False))
    verdict = F.when(F.coalesce(F.col("score") < FLOOR, F.lit(True)), "sin candidato").when(F.col("score") < ACCEPT, "cerca").when(close, "ambiguo").otherwise("casado")
    why = F.when(F.col("score").isNull(), F.lit("ningún candidato comparte bloque")).otherwise(F.format_string("mejor %.2f, segundo %s", "score", F.coalesce(F.format_string("%.2f", "second"), F.lit("-"))))
    return out.withColumn("verdict", verdict).withColumn("why", why)
