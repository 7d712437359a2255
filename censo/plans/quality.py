"""Problem 3: column profiles of the registry by load, and the columns and loads with something wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.operators.profiling import Rule, profile_by_load, value_counts
from censo.plans.nested import DATES, POPULATION, leaves
from censo.session import cut, table

#: Flags in which -1 is no "unknown" but out of range.
STRICT_FLAGS = ("voluntariossanos", "pacientes", "pobvulnerable", "adultos", "ancianos", "menores")
YEARS = (1995, 2035)
MOST_PEOPLE = 200_000
#: Standardised difference from which a load counts as shifted.
SHIFT = 0.5
LEAST_ROWS, NULL_SHARE, GAP = 30, (1, 5), (3, 10)


def _date_rule(pattern: str, fmt: str) -> Rule:
    v = F.col("valor")
    # try_to_timestamp is strict about days that do not exist
    day = F.try_to_timestamp(v, F.lit(fmt)).cast("date")
    year = F.year(day)
    return Rule(F.lit(False), v.rlike(pattern), day.isNotNull() & year.between(*YEARS), F.datediff(day, F.lit("1970-01-01").cast("date")))


def rules() -> dict[str, Rule]:
    v = F.col("valor")
    number = v.try_cast("decimal(38,6)")
    flag = F.col("valor").try_cast("int")
    return {
        "fecha_dmy": _date_rule(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "dd-MM-yyyy"),
        "fecha_iso": _date_rule(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
        "bandera": Rule(v == "-1", v.isin("0", "1", "-1"), v.isin("0", "1"), flag),
        "bandera_estricta": Rule(F.lit(False), v.isin("0", "1", "-1"), v.isin("0", "1"), flag),
        "total": Rule(number.isin(0, 999999), v.rlike("^[0-9]+$"), v.rlike("^0*[0-9]{1,6}$") & (number <= MOST_PEOPLE), number),
    }


def kind_of(field: str) -> str:
    return "fecha_dmy" if field in DATES else "total" if field == "total" else "bandera_estricta" if field in STRICT_FLAGS else "bandera"


def registry_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the dates of calendario, the flags and total of poblacion, and studies.fecha_autorizacion_aemps, by load."""
    detalle, studies = table(spark, sf_dir, "detalle").select("carga", "registro"), table(spark, sf_dir, "studies").select("carga", "fecha_autorizacion_aemps")
    fields = [*DATES, *POPULATION, "total"]
    kinds = F.create_map(*(F.lit(x) for f in fields for x in (f, kind_of(f))))
    flat = leaves(detalle, ["carga"], ("calendario", "poblacion"), mark_valid=True)
    wanted = ((F.col("bloque") == "calendario") & F.col("clave").isin(*DATES)) | ((F.col("bloque") == "poblacion") & F.col("clave").isin(*POPULATION, "total"))
    # campo '' counts the rows of a load
    nested = flat.filter(wanted | (F.col("bloque") == "")).select(
        F.lit("detalle").alias("tabla"), F.coalesce("clave", F.lit("")).alias("campo"), F.coalesce(F.try_element_at(kinds, F.col("clave")), F.lit("")).alias("tipo"), "carga", "valor"
    )
    date = F.struct(F.lit("fecha_autorizacion_aemps").alias("campo"), F.lit("fecha_iso").alias("tipo"), F.trim("fecha_autorizacion_aemps").alias("valor"))
    row = F.struct(F.lit("").alias("campo"), F.lit("").alias("tipo"), F.lit(None).cast("string").alias("valor"))
    plain = studies.select("carga", F.explode(F.array(date, row)).alias("v")).select(F.lit("studies").alias("tabla"), "v.campo", "v.tipo", "carga", "v.valor")
    # Cut, so that the records are parsed once and the judgement stays on counts (Catalyst would push its filters below the aggregation).
    all_counts = cut(value_counts(nested.unionByName(plain), rules()))
    counts, rows = all_counts.filter(F.col("campo") != ""), all_counts.filter(F.col("campo") == "")
    names = F.when(F.col("tabla") == "detalle", F.array(*map(F.lit, fields))).otherwise(F.array(F.lit("fecha_autorizacion_aemps")))
    loads = rows.select("tabla", F.explode(names).alias("campo"), "carga", F.col("n").alias("filas"))
    return profile_by_load(counts, loads)


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile, with standardised difference and gap rounded for reading.

    ``desplazado``: the mean of a load's sound values lies SHIFT pooled deviations or more from that of all other loads, with LEAST_ROWS on both
    sides: found from the power sums alone, and finer than the gap of p3_found where a small shift moves all values.
    """
    p = registry_profile(spark, sf_dir)
    enough = (F.col("sanos") >= LEAST_ROWS) & (F.col("sanos_t") - F.col("sanos") >= LEAST_ROWS)
    p = p.withColumn("desplazado", enough & F.coalesce(F.abs("diferencia_estandar") >= SHIFT, F.lit(False)))
    return p.select(
        "tabla", "campo", "carga", "filas", "faltan", "distintos", "fuera_de_forma", "fuera_de_rango", "sanos", "minimo", "maximo", "suma1", "suma2",
        F.round("media", 4).alias("media"), F.round("desviacion", 4).alias("desviacion"), F.round("diferencia_estandar", 4).alias("diferencia_estandar"),
        F.round(F.try_divide(F.col("hueco_num").cast("double"), F.col("hueco_den").cast("double")), 4).alias("hueco"),
        "desplazado",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each load and column with something wrong, one row per finding; thresholds are compared in integers."""
    p = registry_profile(spark, sf_dir)
    for c in ("filas", "filas_t", "faltan", "faltan_t"):
        p = p.withColumn(c, F.col(c).cast("decimal(17,0)"))
    rest = F.col("filas_t") - F.col("filas")
    null_gap = F.abs(F.col("faltan") * rest - (F.col("faltan_t") - F.col("faltan")) * F.col("filas"))
    sound_rest = F.col("sanos_t") - F.col("sanos")
    wide = F.coalesce(F.col("hueco_num") * GAP[1] > F.col("hueco_den") * GAP[0], F.lit(False))
    findings = {
        "forma": F.col("fuera_de_forma") > 0,
        "rango": F.col("fuera_de_rango") > 0,
        "nulos": (F.col("filas") >= LEAST_ROWS) & (rest > 0) & (null_gap * NULL_SHARE[1] > F.col("filas") * rest * NULL_SHARE[0]),
        "distribucion": (F.col("sanos") >= LEAST_ROWS) & (sound_rest >= LEAST_ROWS) & wide,
    }
    found = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in findings.items())))
    return p.select(F.col("carga").cast("int").alias("carga"), "tabla", "campo", F.explode(found).alias("hallazgo"))
