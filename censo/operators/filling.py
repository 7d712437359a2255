"""Filling missing values from rows of the same entity along time, with the method and the distance recorded.

An entity may hold a large share of all rows, so nothing is sorted per entity: rows are sorted per (entity, time bucket), and what a bucket
needs from its neighbours comes from one summary row per bucket, over which the entity-wide windows run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86400.0


def seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / F.lit(1e6)


def neighbours(df: DataFrame, entity: str, time: str, order: str, values: list[str], bucket: str = "month") -> DataFrame:
    """``df`` and, for every row, the nearest observed values before and after it in its entity: structs prev_* and next_* (v, t) of each column.

    Rows are ordered by (time, order); rows without time come last in their entity and see only observed rows before them. ``order`` must be
    unique. All columns share the sorts, the summaries and the join.
    """
    late = F.lit(9e18)
    base = df.withColumn("_t", seconds(F.col(time))).withColumn("_b", F.coalesce(F.date_trunc(bucket, F.col(time).cast("timestamp")), F.lit("9999-12-31").cast("timestamp")))
    key = F.struct(F.coalesce("_t", late).alias("t"), F.col(order).alias("o"))
    observed = lambda c: F.when(F.col(c).isNotNull() & F.col("_t").isNotNull(), F.struct(key.alias("k"), F.col(c).alias("v")))
    # every bucket that has rows needs its neighbours, also one without an observed value
    found = base.groupBy(entity, "_b").agg(*(f(observed(c)).alias(f"{n}_{c}") for c in values for f, n in ((F.max, "last"), (F.min, "first"))))
    w = W.partitionBy(entity).orderBy("_b")
    around = found.select(
        entity, "_b", *(F.last(f"last_{c}", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias(f"_in_{c}") for c in values),
        *(F.first(f"first_{c}", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias(f"_out_{c}") for c in values),
    )
    inner = W.partitionBy(entity, "_b").orderBy(F.coalesce("_t", late), order)
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_t").alias("t")))
    rows = base.select(
        *base.columns, *(F.last(seen(c), ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, -1)).alias(f"_p_{c}") for c in values),
        *(F.first(seen(c), ignorenulls=True).over(inner.rowsBetween(1, W.unboundedFollowing)).alias(f"_n_{c}") for c in values),
    )
    rows = rows.join(around.hint("merge"), [entity, "_b"], "left")
    outer = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.v").alias("v"), F.col(f"{c}.k.t").alias("t")))
    kept = [c for c in df.columns if c != "_t"]
    return rows.select(*kept, "_t", *(F.coalesce(f"_p_{c}", outer(f"_in_{c}")).alias(f"prev_{c}") for c in values), *(F.coalesce(f"_n_{c}", outer(f"_out_{c}")).alias(f"next_{c}") for c in values))


def fill_over_time(df: DataFrame, entity: str, time: str, order: str, numeric: list[str], categories: list[str], max_gap_days: float | None = None) -> DataFrame:
    """Each column c of ``numeric`` and ``categories`` filled in place, with c_metodo and c_distancia (days).

    Numbers lie on the line between the observed neighbours ('interpolado'), or repeat the only one ('extremo'); categories repeat the nearer
    neighbour ('arrastre' from before, 'retroceso' from after; before wins a tie). Distance is that to the nearer neighbour used; beyond
    ``max_gap_days`` a value stays null. Observed values have method 'observado', unfilled nulls method null. Null entities are never filled
    from each other. Empty input gives an empty result; numeric results are doubles.
    """
    columns = [*numeric, *categories]
    out = neighbours(df, entity, time, order, columns)
    made = []
    for c in columns:
        alone = F.col(entity).isNull()
        p, n, t = F.when(~alone, F.col(f"prev_{c}")), F.when(~alone, F.col(f"next_{c}")), F.col("_t")
        dp, dn = (t - p["t"]) / DAY, (n["t"] - t) / DAY
        ok_p = p.isNotNull() & (F.lit(True) if max_gap_days is None else F.coalesce(dp <= max_gap_days, F.lit(False)))
        ok_n = n.isNotNull() & (F.lit(True) if max_gap_days is None else F.coalesce(dn <= max_gap_days, F.lit(False)))
        if c in numeric:
            share = F.coalesce(F.try_divide(t - p["t"], n["t"] - p["t"]), F.lit(0.5))
            line = p["v"].cast("double") + (n["v"].cast("double") - p["v"].cast("double")) * share
            value = F.when(ok_p & ok_n & t.isNotNull(), line).when(ok_p, p["v"].cast("double")).when(ok_n, n["v"].cast("double"))
            method = F.when(ok_p & ok_n & t.isNotNull(), "interpolado").when(ok_p | ok_n, "extremo")
            own = F.col(c).cast("double")
        else:
            before = ok_p & (~ok_n | F.coalesce(dp <= dn, F.lit(True)))
            value, method, own = F.when(before, p["v"]).when(ok_n, n["v"]), F.when(before, "arrastre").when(ok_n, "retroceso"), F.col(c)
        dist = F.when(ok_p & ok_n, F.least(dp, dn)).when(ok_p, dp).when(ok_n, dn)
        known = F.col(c).isNotNull()
        made += [F.when(known, own).otherwise(value).alias(c), F.when(known, "observado").otherwise(method).alias(f"{c}_metodo"), F.when(known, F.lit(0.0)).otherwise(dist).alias(f"{c}_distancia")]
    return out.select(*(x for x in df.columns if x not in (*columns, "_t")), *made)


def consensus(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, of): the most frequent non-null value of each group (smallest on ties), its count and the count of all values."""
    counts = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    ties = counts.groupBy(group).agg(F.max("n").alias("n"), F.sum("n").alias("of"))
    return counts.join(ties.hint("merge"), [group, "n"]).groupBy(group, "n", "of").agg(F.min(value).alias(value)).select(group, value, "n", "of")
