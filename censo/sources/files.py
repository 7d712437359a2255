"""Readers and writers of the registry's files, every one with an explicit schema.

JSON lines keep their broken lines in ``_corrupta``; the load year comes from the file's name; reference files are read as text columns, so
codes keep their leading zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CENTRE = "struct<referencia:string,nombre:string,localidad:string,codPostal:string,provincia:string,ccaa:string>"
RECORD_SCHEMA = f"""identificador string, acronimo string, enfermedadRara string, organismo struct<promotor:string,financiador:string>,
    centros struct<centro:array<{CENTRE}>>, _corrupta string"""
POSTCODES_SCHEMA = "cod_postal string, lat double, lon double, town string"
HOSPITALS_SCHEMA = "codcnh string, nombre string, municipio string, provincia string, cod_postal string, camas string, clase string, dependencia string, complejo string"
FAILURES_SCHEMA = "identificador string, reason string, at string"


def year_in_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).try_cast("int")


def read_year_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(anio, identificador) of the yearly list documents; ids missing from an entry are left out."""
    raw = spark.read.schema("estudio array<struct<identificador:string>>").option("multiLine", True).json(f"{folder}/*.json")
    return raw.select(year_in_name().alias("anio"), F.explode("estudio.identificador").alias("identificador")).filter("identificador IS NOT NULL")


def cached_years(spark: SparkSession, folder: str) -> DataFrame:
    """The years a folder holds, newest first."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(F.regexp_extract("path", r"(\d{4})\.json$", 1).alias("a")).filter("a <> ''").select(F.col("a").cast("int").alias("anio")).distinct().orderBy(F.desc("anio"))


def read_records(spark: SparkSession, folder: str, years: list[int] | None = None, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON lines with ``anio``; broken lines have only ``_corrupta``. ``years`` prunes the files read."""
    paths = [f"{folder}/{y}.jsonl" for y in sorted(years)] if years else [f"{folder}/*.jsonl"]
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupta").json(paths)
    return raw.withColumn("anio", year_in_name())


def recorded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ids that were really recorded: cut-off and key-less lines do not count."""
    return read_records(spark, folder).filter("_corrupta IS NULL AND identificador IS NOT NULL").select("identificador").distinct()


def read_failures(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FAILURES_SCHEMA).json(f"{folder}/*.failures.jsonl").filter("identificador IS NOT NULL")


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTCODES_SCHEMA).option("header", True).csv(path)


def read_hospitals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOSPITALS_SCHEMA).option("header", True).csv(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, geometry) of the features; the geometry as JSON text."""
    raw = spark.read.schema("features array<struct<id:string,properties:struct<name:string>,geometry:string>>").option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select("f.id", "f.properties.name", "f.geometry")


def read_geojson_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of the features."""
    return read_geojson(spark, path).select("id", "name")


def append_records(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def dead_letter(df: DataFrame, folder: str, id_col: str, reason: str) -> None:
    """Append refused ids with their reason and the time of writing."""
    df.select(F.col(id_col).alias("identificador"), F.col(reason).alias("reason"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("at")).write.mode("append").json(folder)


def write_result(df: DataFrame, path: str, order: list[str], kind: str = "parquet") -> None:
    """A result in one total order, so that two runs write the same bytes; results are small by design (one file)."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").format(kind).save(path)


def write_gold(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Every table written once; the row counts of what was written."""
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}.parquet").count()
    return out
