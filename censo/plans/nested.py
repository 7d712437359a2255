"""Problem 2: deeply nested registry records as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.operators.shredding import shred_elements, shred_json
from censo.session import table

# Raw keys of the registry's record format.
DATES = (
    "fechaAutorizacionAEMPS", "fechaRegistro", "fechaInicioPrevista", "fechaInicioReal", "fechaFinRealEspana", "fechaFinRealGlobal",
    "fechaInterrupcion", "fechaReinicio", "fechaFinPrematuro",
)
POPULATION = (
    "voluntariossanos", "pacientes", "pobvulnerable", "mujerusa", "mujernousa", "embarazadas", "lactancia", "urgencia", "incapaces",
    "intrauteros", "prematuros", "reciennacido", "preescolar", "ninos", "adolescentes", "adultos", "ancianos", "menores",
)
PURPOSE = (
    "faseUno", "faseDos", "faseTres", "faseCuatro", "diagnostico", "profilaxis", "tratamiento", "seguridad", "eficacia", "farmacocinetica",
    "farmacodinamica", "bioequivalencia", "dosis", "farmacogenetica", "farmacogenomica", "farmacoeconomica",
)

BLOCKS = ("areasTerapeuticas", "calendario", "poblacion", "proposito")


def leaves(detalle: DataFrame, keep: list[str], roots: tuple[str, ...] = BLOCKS, mark_valid: bool = False) -> DataFrame:
    """Flat leaves with ``clave``, the raw key of the leaf."""
    flat = shred_json(detalle, "registro", keep, list(roots), mark_valid=mark_valid)
    return flat.withColumn("clave", F.substring_index("campo", ".", -1))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of every valid record, linked by detalle_id."""
    flat = leaves(table(spark, sf_dir, "detalle"), ["detalle_id"])
    b, key, v = F.col("bloque"), F.col("clave"), F.col("valor")
    area_code = (b == "areasTerapeuticas") & ((key == "eutct") | F.col("campo").rlike(r"(^|\.)eutct\.codigo$"))
    scalar = (
        ((b == "calendario") & key.isin(*DATES))
        | ((b == "poblacion") & ((key.isin(*POPULATION) & (v == "1")) | (key == "total")))
        | ((b == "proposito") & key.isin(*PURPOSE) & (v == "1"))
    )
    # An object where a list is expected is the element at position 0: add a step for each 'area' key that no list follows.
    full = F.concat_ws(".", F.when(F.col("tabla") != "", F.col("tabla")), F.col("campo"))
    return (
        flat.filter(area_code | scalar)
        .withColumn("ruta", F.when(area_code, area_route(full, F.col("ruta"))).otherwise(F.lit("")))
        .select("detalle_id", "bloque", "ruta", F.when(area_code, F.lit("eutct")).otherwise(key).alias("campo"), "valor")
    )


def area_route(path, ruta):
    """Positions of an area and its ancestors: list positions as recorded, 0 where a single object stands for the list.

    ``path`` is the whole path below the block, e.g. ``area.[].subareas.area.eutct``; levels of areas are the parts between ``subareas``.
    """
    levels = F.split(path, r"(?:^|\.)subareas(?:\.|$)")
    at = F.split(ruta, r"\.")
    step = F.aggregate(
        levels,
        F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out")),
        lambda acc, part: F.struct(
            (acc["used"] + F.when(F.contains(part, F.lit("[]")), 1).otherwise(0)).alias("used"),
            F.concat(acc["out"], F.array(F.when(F.contains(part, F.lit("[]")), F.get(at, acc["used"])).otherwise(F.lit("0")))).alias("out"),
        ),
    )
    return F.array_join(step["out"], ".")


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of all lists of the four blocks, each with its parent: the tables that the rows of p2_found lie below."""
    return shred_elements(table(spark, sf_dir, "detalle"), "registro", ["detalle_id"], list(BLOCKS))
