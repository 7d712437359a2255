"""Profiles of columns by load, from one mergeable summary per (column, load, value).

Values come in long form (load, table, column, text). One partial aggregation reduces the rows to counts by value; everything else
(nulls, distincts, violations, ranges, exact power sums, cumulative gaps) is derived from those counts, whose number is bounded by the
columns' domains and not by the rows. Power sums are kept as exact decimals, so sums of loads may be merged in any order, and "all
other loads" is the difference between the total and the load, without a second pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """How the texts of a kind of column are judged.

    ``missing``, ``form`` and ``in_range`` are conditions on the text ``valor``; ``number`` is the sound value as an exact integer.
    ``in_range`` and ``number`` are evaluated for texts of good form only.
    """

    missing: Column
    form: Column
    in_range: Column
    number: Column


def _by_kind(rules: dict[str, Rule], attribute: str) -> Column:
    kind, out = F.col("tipo"), None
    for name, rule in rules.items():
        value = getattr(rule, attribute)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def value_counts(values: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Counts by (tabla, campo, carga, valor), each value judged once: ``estado`` is falta, forma, rango or sano; ``x`` the sound number.

    A null or blank text is missing. Rows of one load and column holding the same text cost one row after the map-side combine, so a
    load or value with a large share of all rows makes no hot task.
    """
    counted = values.groupBy("tabla", "campo", "tipo", "carga", "valor").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("valor").isNull() | (F.trim("valor") == "")
    state = (
        F.when(blank | F.coalesce(_by_kind(rules, "missing"), F.lit(False)), "falta")
        .when(~F.coalesce(_by_kind(rules, "form"), F.lit(False)), "forma")
        .when(~F.coalesce(_by_kind(rules, "in_range"), F.lit(False)), "rango")
        .otherwise("sano")
    )
    judged = counted.withColumn("estado", state)
    return judged.withColumn("x", F.when(F.col("estado") == "sano", _by_kind(rules, "number")).cast("bigint"))


def profile_by_load(counts: DataFrame, loads: DataFrame) -> DataFrame:
    """One row per (tabla, campo, carga): the complete profile with its comparison to all other loads.

    ``counts`` comes from ``value_counts`` (it may lack rows for absent values); ``loads`` has (tabla, campo, carga, filas), the rows of
    each load. Values that did not come at all count as missing.

    Columns: filas, faltan, distintos, fuera_de_forma, fuera_de_rango, sanos, minimo, maximo, suma1, suma2 (exact), media, desviacion,
    diferencia_estandar (load against all others, in pooled standard deviations), hueco_num / hueco_den (largest gap between the two
    cumulative distributions as an exact fraction; null without sound values on either side), and the totals of all loads with suffix _t.
    Empty input gives an empty profile; a null load is a load of its own.
    """
    n = F.col("n")
    part = lambda s: F.sum(F.when(F.col("estado") == s, n).otherwise(F.lit(0)))
    xd = F.col("x").cast("decimal(20,0)")
    key = ["tabla", "campo", "carga"]
    per = counts.groupBy(*key).agg(
        F.sum(F.when(F.col("estado") != "falta", n).otherwise(F.lit(0))).alias("presentes"),
        F.sum(F.when(F.col("estado") != "falta", 1).otherwise(0)).alias("distintos"),
        part("forma").alias("fuera_de_forma"),
        part("rango").alias("fuera_de_rango"),
        part("sano").alias("sanos"),
        F.min("x").alias("minimo"),
        F.max("x").alias("maximo"),
        F.sum(xd * n).cast("decimal(38,0)").alias("suma1"),
        F.sum((xd * xd).cast("decimal(28,0)") * n).cast("decimal(38,0)").alias("suma2"),
    )
    same = lambda a, b: (a["tabla"] == b["tabla"]) & (a["campo"] == b["campo"]) & a["carga"].eqNullSafe(b["carga"])
    full = (
        loads.alias("l")
        .join(per.alias("p"), same(loads, per), "left")
        .select("l.*", *(F.coalesce(F.col(f"p.{c}"), F.lit(0)).alias(c) for c in ("presentes", "distintos", "fuera_de_forma", "fuera_de_rango", "sanos")), "p.minimo", "p.maximo", *(F.coalesce(F.col(f"p.{c}"), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("suma1", "suma2")))
        .withColumn("faltan", F.col("filas") - F.col("presentes"))
    )
    # one row per profiled column: as few as the schema has
    totals = full.groupBy("tabla", "campo").agg(*(F.sum(c).alias(f"{c}_t") for c in ("filas", "faltan", "sanos", "suma1", "suma2")))
    full = full.join(F.broadcast(totals), ["tabla", "campo"])
    d = lambda c: F.col(c).cast("double")
    n1, n0 = d("sanos"), d("sanos_t") - d("sanos")
    m1, m0 = F.try_divide(d("suma1"), n1), F.try_divide(d("suma1_t") - d("suma1"), n0)
    v1 = F.greatest(F.try_divide(d("suma2"), n1) - m1 * m1, F.lit(0.0))
    v0 = F.greatest(F.try_divide(d("suma2_t") - d("suma2"), n0) - m0 * m0, F.lit(0.0))
    pooled = F.sqrt((v1 + v0) / 2)
    full = full.withColumn("media", m1).withColumn("desviacion", F.sqrt(v1)).withColumn("diferencia_estandar", F.when(m1 == m0, F.lit(0.0)).otherwise(F.try_divide(m1 - m0, pooled)))
    gaps = cumulative_gaps(counts)
    return full.join(gaps.alias("g"), same(full, gaps), "left").select(full["*"], "g.hueco_num", "g.hueco_den")


def cumulative_gaps(counts: DataFrame) -> DataFrame:
    """Largest |F_load - F_others| per (tabla, campo, carga), as an exact fraction.

    Between two neighbouring values of the load its own distribution is flat, so the gap is largest at, or just before, one of its own
    values: only these points are looked at. The running total over all loads needs one window per column over its distinct sound
    values (bounded by the column's range), the load's own one window per load and column.
    """
    sound = counts.filter((F.col("estado") == "sano") & F.col("x").isNotNull()).groupBy("tabla", "campo", "carga", "x").agg(F.sum("n").alias("n"))
    by_x = sound.groupBy("tabla", "campo", "x").agg(F.sum("n").alias("n_x"))
    run = W.partitionBy("tabla", "campo").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    total = by_x.withColumn("c_all", F.sum("n_x").over(run)).withColumn("t_all", F.sum("n_x").over(W.partitionBy("tabla", "campo")))
    own = W.partitionBy("tabla", "campo", "carga")
    load = sound.withColumn("c_own", F.sum("n").over(own.orderBy("x").rowsBetween(W.unboundedPreceding, 0))).withColumn("t_own", F.sum("n").over(own))
    both = load.join(total, ["tabla", "campo", "x"])
    for c in ("n", "n_x", "c_own", "c_all", "t_own", "t_all"):
        both = both.withColumn(c, F.col(c).cast("decimal(18,0)"))
    t, a = F.col("t_own"), F.col("t_all")

    def gap(c_own: Column, c_all: Column) -> Column:
        # |c_own / t - (c_all - c_own) / (a - t)| over the common denominator t (a - t)
        return F.abs(c_own * (a - t) - (c_all - c_own) * t)

    at = gap(F.col("c_own"), F.col("c_all"))
    before = gap(F.col("c_own") - F.col("n"), F.col("c_all") - F.col("n_x"))
    return both.filter(a > t).groupBy("tabla", "campo", "carga").agg(
        F.max(F.greatest(at, before)).alias("hueco_num"), F.first(t * (a - t)).alias("hueco_den")
    )
