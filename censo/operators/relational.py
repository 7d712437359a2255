"""Relational operators of the landscape analyses, by column names: yearly counts, folded rankings, densified shares, flag mixes, nests.

All of them aggregate before they shuffle; the inputs of the later steps (totals, ladders, rankings) have one row per year, class or label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def since(df: DataFrame, date: str, first_year: int, last_year: int | None = None) -> DataFrame:
    """Rows dated in [first_year, last_year], as comparisons on the bare column so that they reach the scan."""
    kind = dict(df.dtypes)[date]
    day = lambda y: F.lit(f"{y:04d}-01-01").cast(kind)
    out = df.filter(F.col(date) >= day(first_year))
    return out.filter(F.col(date) < day(last_year + 1)) if last_year else out


def year_of(date: str) -> Column:
    return F.year(date).cast("bigint")


def counts_per_year(df: DataFrame, date: str, first_year: int, year: str = "anio", n: str = "n") -> DataFrame:
    """(year, n); years without rows are absent."""
    return since(df, date, first_year).groupBy(year_of(date).alias(year)).agg(F.count(F.lit(1)).alias(n))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percentage, null for an empty whole."""
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def fold_tail(counts: DataFrame, label: str, n: str, top: int, absent: list[str], absent_label: str, other_label: str, code: str | None = None) -> DataFrame:
    """(pos, label, n, sustantivo): the top labels, then one bar of the ``absent`` labels, then one of the rest with their number in its label.

    Ties go to the smaller ``code`` (default: the label itself). Bars without rows are left out.
    """
    key = code or label
    gone = F.col(key).isin(*absent) if absent else F.lit(False)
    rank = F.row_number().over(W.partitionBy("_gone").orderBy(F.desc(n), key))
    ranked = counts.withColumn("_gone", gone).withColumn("_r", rank)
    bar = F.when(F.col("_gone"), F.lit(top + 1)).when(F.col("_r") > top, F.lit(top + 2)).otherwise(F.col("_r"))
    folded = ranked.groupBy(bar.cast("bigint").alias("pos")).agg(F.min(label).alias("_label"), F.sum(n).alias(n), F.count(F.lit(1)).alias("_k"))
    text = F.when(F.col("pos") <= top, F.col("_label")).when(F.col("pos") == top + 1, F.lit(absent_label)).otherwise(F.format_string(other_label, F.col("_k")))
    return folded.select("pos", text.alias(label), n, (F.col("pos") <= top).alias("sustantivo"))


def densify(df: DataFrame, left: str, right: str, values: list[str]) -> DataFrame:
    """Every combination of the values of ``left`` and ``right`` that occur (domains of labels, not of rows), with 0 for absent ones."""
    lefts = df.select(left).distinct().groupBy().agg(F.collect_set(left).alias("_l"))
    grid = df.select(right).distinct().join(F.broadcast(lefts)).select(right, F.explode("_l").alias(left))
    return grid.join(df, [left, right], "left").select(left, right, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def flag_label(flags: dict[str, str], joiner: str = "/") -> Column:
    """The names of the flags that are set, in the given order: (1, 1, 0, 0) is 'I/II'; none set is ''."""
    return F.concat_ws(joiner, *(F.when(F.col(c) == 1, F.lit(name)) for c, name in flags.items()))


def ladder(counts: DataFrame, label: str, n: str, designs: list[str], other: str) -> DataFrame:
    """(pos, label, n): one row per design, 0 where absent, and the folded rest (if any) last."""
    spark = counts.sparkSession
    rungs = spark.createDataFrame([(i + 1, d) for i, d in enumerate(designs)], f"pos bigint, {label} string")
    known = rungs.join(counts, label, "left").select("pos", label, F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n))
    rest = counts.filter(~F.col(label).isin(*designs)).agg(F.sum(n).alias(n)).filter(F.col(n).isNotNull())
    return known.unionByName(rest.select(F.lit(len(designs) + 1).cast("bigint").alias("pos"), F.lit(other).alias(label), F.col(n).cast("bigint").alias(n)))


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The label of the first pattern, in order, that is found in ``text``."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), F.lit(label)) if out is None else out.when(text.rlike(pattern), F.lit(label))
    return out.otherwise(otherwise) if out is not None else otherwise


def override(df: DataFrame, fixes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``values`` replaced where a hand-checked row of ``fixes`` has its keys; ``fixes`` is a small table of literals."""
    f = fixes.select(*keys, *(F.col(v).alias(f"_fix_{v}") for v in values), F.lit(True).alias("_fixed"))
    joined = df.join(F.broadcast(f), keys, "left")
    return joined.select(*(F.when(F.col("_fixed"), F.col(f"_fix_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def first_seen(df: DataFrame, parent: str, text: str, delimiter: str = "|", key: Column | None = None, drop: Column | None = None) -> DataFrame:
    """(parent, pos, valor): the parts of a delimited text, blank and dropped ones left out, one per key within the parent, first spelling kept."""
    parts = df.select(parent, F.posexplode(F.split(F.col(text), "[" + delimiter + "]")).alias("pos", "_v")).withColumn("valor", F.trim("_v")).filter("valor <> ''")
    if drop is not None:
        parts = parts.filter(~drop)
    k = key if key is not None else F.lower("valor")
    first = parts.withColumn("_k", k).groupBy(parent, "_k").agg(F.min(F.struct("pos", "valor")).alias("x"))
    return first.select(parent, F.col("x.pos").cast("bigint").alias("pos"), F.col("x.valor").alias("valor"))


def mode_by(df: DataFrame, key: str | list[str], value: str, prefer: list[Column] | None = None, weight: str | None = None) -> DataFrame:
    """(key, value): the most frequent value of each key, the smaller on ties; values that meet an earlier condition of ``prefer`` come first.

    Counts by (key, value) come first, so a key with a third of all rows costs no more than its distinct values. A row counts ``weight`` times.
    """
    keys = [key] if isinstance(key, str) else key
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("_n"))
    better = [F.coalesce(p, F.lit(False)).cast("int") for p in (prefer or [])]
    order = F.struct(*(b.alias(f"b{i}") for i, b in enumerate(better)), F.col("_n").alias("n")) if better else F.struct(F.col("_n").alias("n"))
    top = counts.withColumn("_o", order)
    best = top.groupBy(*keys).agg(F.max("_o").alias("_o"))
    return top.join(best, [*keys, "_o"]).groupBy(*keys).agg(F.min(value).alias(value))


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, regla): every rule each row breaks; a rule that is null for a row counts as kept, as a check constraint does."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.col(id_col), F.explode(broken).alias("regla"))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, refused rows with ``faltas``, the names of the rules they break)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())))
    marked = df.withColumn("faltas", broken)
    return marked.filter(F.size("faltas") == 0).drop("faltas"), marked.filter(F.size("faltas") > 0)


def rule_tally(df: DataFrame, audits: dict[tuple[str, str], Column]) -> DataFrame:
    """(campo, regla, n): how many rows each (field, rule) changed."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("campo"), F.lit(r).alias("regla"))) for (f, r), c in audits.items())))
    return df.select(F.explode(hits).alias("x")).groupBy("x.campo", "x.regla").agg(F.count(F.lit(1)).alias("n"))


def upper_median(counts: DataFrame, key: str, value: str, n: str, name: str = "mediana") -> DataFrame:
    """(key, name): sorted[n // 2] of each key's values, from counts by (key, value); keys without values have no row.

    Works on counts, so no group's rows are gathered in one place.
    """
    w = W.partitionBy(key).orderBy(value)
    run = counts.filter(F.col(value).isNotNull()).withColumn("_hi", F.sum(n).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_of", F.sum(n).over(W.partitionBy(key)))
    at = F.floor(F.col("_of") / 2)
    return run.filter((F.col("_hi") > at) & (F.col("_hi") - F.col(n) <= at)).select(key, F.col(value).alias(name))


def row_gate(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(tabla, esperadas, filas, bien) for every expected table; an absent one has null rows."""
    spark = next(iter(tables.values())).sparkSession
    want = spark.createDataFrame(sorted(expected.items()), "tabla string, esperadas bigint")
    have = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        have = one if have is None else have.unionByName(one)
    return want.join(have, "tabla", "left").select("tabla", "esperadas", "filas", F.coalesce(F.col("esperadas") == F.col("filas"), F.lit(False)).alias("bien"))
