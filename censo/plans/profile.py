"""Profiles of the raw records by path, and every constraint of the tables with its violations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.operators import relational as R
from censo.plans import sqltext as Q
from censo.plans.centres import elements
from censo.plans.nested import DATES, POPULATION, PURPOSE
from censo.plans.registry import Registry
from censo.session import table

query = Registry()

# The profiled paths of the record format by table; '[]' stands for the elements of a list.
SOURCES = ("atencionPrimaria", "atencionPersonalizada", "hospitalizacion", "medico", "farmaceutico", "historialClinico", "basesDatos", "otrasFuentes")
GROUPS = {
    "sponsors": ["organismo.promotor"],
    "studies.calendario": [f"calendario.{k}" for k in (*DATES, "fechaClasificacion", "fechaFinPrevista")],
    "studies.poblacion": [f"poblacion.{k}" for k in (*POPULATION, "total")],
    "studies.proposito": [f"proposito.{k}" for k in (*PURPOSE, *SOURCES)],
    "centers": [f"centros.centro[].{k}" for k in ("referencia", "nombre", "tipo", "situacion", "ccaa", "provincia", "localidad", "codPostal", "departamento")],
    "funders": ["organismo.financiador"],
    "therapeutic_areas": [f"areasTerapeuticas.area[].{k}" for k in ("eutct", "nombre_es", "nombre_en")],
    "interventions": [f"intervenciones.intervencion[].{k}" for k in ("nombreComercial", "nombreCientifico", "codigo", "huerfano", "formaFarmaceutica", "formaFarmaceutica_en", "sustancias", "atcs", "viasAdministracion")],
    "studies.identity": ["identificador", "acronimo", "enfermedadRara"],
}


def presence(v: Column, path: str) -> Column:
    """Absent, null, blank and present are four facts about a path; what lies below a value of another shape is absent."""
    at = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(at.isNull(), "ausente").when(F.is_variant_null(at), "nulo").when(F.trim(F.try_variant_get(v, f"$.{path}", "string")) == "", "blanco").otherwise("presente")


def statuses(df: DataFrame, v: Column, fields: list[tuple[str, str, str]]) -> DataFrame:
    """(grupo, campo, estado, n) of the paths (group, shown path, path below ``v``), all in one pass."""
    facts = F.array(*(F.struct(F.lit(g).alias("grupo"), F.lit(shown).alias("campo"), presence(v, below).alias("estado")) for g, shown, below in fields))
    return df.select(F.explode(facts).alias("x")).groupBy("x.grupo", "x.campo", "x.estado").agg(F.count(F.lit(1)).alias("n"))


def profile(spark: SparkSession, sf_dir: str, groups: list[str]) -> DataFrame:
    """Presence of every path of the given groups; an unknown group is an error. Paths in lists count their elements, a bare object being one."""
    unknown = sorted(set(groups) - set(GROUPS))
    if unknown:
        raise ValueError(f"unknown groups: {', '.join(unknown)}")
    paths = [(g, p) for g in groups for p in GROUPS[g]]
    out = None
    plain = [(g, p, p) for g, p in paths if "[]" not in p]
    if plain:
        valid = table(spark, sf_dir, "detalle").select(F.try_parse_json("registro").alias("v")).filter("v IS NOT NULL")
        out = statuses(valid, F.col("v"), plain)
    for head in sorted({p.split("[].")[0] for _, p in paths if "[]" in p}):
        items = elements(spark, sf_dir, f"$.{head}").filter(F.schema_of_variant("x").startswith("OBJECT"))
        one = statuses(items, F.col("x"), [(g, p, p.split("[].")[1]) for g, p in paths if p.startswith(f"{head}[].")])
        out = one if out is None else out.unionByName(one)
    return out


def _state_sql(v: str, path: str) -> str:
    return f"CASE WHEN json_type({v}, '$.{path}') IS NULL THEN 'ausente' WHEN json_type({v}, '$.{path}') = 'NULL' THEN 'nulo' WHEN trim({v} ->> '$.{path}') = '' THEN 'blanco' ELSE 'presente' END"


def _facts_sql(v: str, fields: list[tuple[str, str, str]]) -> str:
    return "unnest([" + ", ".join(f"{{'grupo': '{g}', 'campo': '{s}', 'estado': {_state_sql(v, b)}}}" for g, s, b in fields) + "]) AS f"


_ALL = [(g, p) for g, ps in GROUPS.items() for p in ps]
_HEADS = sorted({p.split("[].")[0] for _, p in _ALL if "[]" in p})
PROFILE_SQL = f"""WITH {Q.records()}, {', '.join(Q.elements(f'$.{h}', f'e{i}') for i, h in enumerate(_HEADS))},
f AS (SELECT {_facts_sql('r', [(g, p, p) for g, p in _ALL if '[]' not in p])} FROM j {' '.join(f"UNION ALL SELECT {_facts_sql('x', [(g, p, p.split('[].')[1]) for g, p in _ALL if p.startswith(f'{h}[].')])} FROM e{i} WHERE json_type(x) = 'OBJECT'" for i, h in enumerate(_HEADS))})
SELECT f.grupo AS grupo, f.campo AS campo, f.estado AS estado, count(*) AS n FROM f GROUP BY 1, 2, 3"""


@query(PROFILE_SQL)
def record_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine groups."""
    return profile(spark, sf_dir, list(GROUPS))


# Constraints of the tables (id, then name and condition; null passes unless the name says 'presente').
_ID = r"[0-9]{4}-[0-9]{6}-[0-9]{2}(-[0-9]{2})?"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_STUDY_DATES = ("fecha_autorizacion_aemps", "fecha_registro", "fecha_inicio_prevista", "fecha_inicio_real", "fecha_fin_real_espana", "fecha_fin_real_global", "fecha_interrupcion", "fecha_reinicio", "fecha_fin_prematuro")
CHECKS = {
    "sponsors": ("sponsor_id", {"promotor_key presente": "promotor_key IS NOT NULL AND promotor_key <> ''", "promotor presente": "promotor IS NOT NULL AND promotor <> ''"}),
    "funders": ("funder_id", {"nombre_key presente": "nombre_key IS NOT NULL AND nombre_key <> ''", "nombre presente": "nombre IS NOT NULL AND nombre <> ''"}),
    "centers": ("center_id", {"center_key presente": "center_key IS NOT NULL AND center_key <> ''", "localidad presente": "localidad IS NOT NULL", "cod_postal presente": "cod_postal IS NOT NULL", "cod_postal forma": "cod_postal = '' OR MATCH(cod_postal, '[0-9]{5}')", "referencia no vacía": "referencia <> ''"}),
    "studies": ("identificador", {
        "identificador forma": f"MATCH(identificador, '{_ID}')", "sponsor presente": "sponsor_id IS NOT NULL", "acronimo no vacío": "acronimo <> ''", "enfermedad_rara presente": "enfermedad_rara IS NOT NULL", "enfermedad_rara 0 o 1": "enfermedad_rara IN (0, 1)",
        **{f"{d} forma": f"MATCH({d}, '{_DAY}')" for d in _STUDY_DATES}, "fecha_autorizacion_aemps presente": "fecha_autorizacion_aemps IS NOT NULL", "fecha_registro presente": "fecha_registro IS NOT NULL",
        "poblacion_total positivo": "poblacion_total > 0", **{f"fase_{n} 0 o 1": f"fase_{n} IN (0, 1)" for n in ("uno", "dos", "tres", "cuatro")},
    }),
    "therapeutic_areas": ("eutct_code", {"eutct_code presente": "eutct_code IS NOT NULL AND eutct_code <> ''", "nombre_es presente": "nombre_es IS NOT NULL AND nombre_es <> ''"}),
}
UNIQUE = {"sponsors": ["promotor_key"], "funders": ["nombre_key"], "centers": ["center_key", "localidad", "cod_postal"], "studies": ["identificador"], "study_centers": ["study_id", "center_id"], "therapeutic_areas": ["eutct_code"]}
FOREIGN = [("studies", "sponsor_id", "sponsors", "sponsor_id"), ("study_centers", "study_id", "studies", "identificador"), ("study_centers", "center_id", "centers", "center_id"), ("center_groups", "center_id", "centers", "center_id")]

_REPORT = " UNION ALL ".join(
    [f"SELECT '{t}' AS tabla, '{name}' AS regla, count(*) AS n, min(CAST({i} AS VARCHAR)) AS ejemplo FROM {t} WHERE NOT ({c.replace('MATCH(', 'regexp_full_match(')}) HAVING count(*) > 0" for t, (i, cs) in CHECKS.items() for name, c in cs.items()]
    + [f"SELECT '{t}', 'única: {', '.join(ks)}', count(*), min({' || chr(124) || '.join(f"CAST({k} AS VARCHAR)" for k in ks)}) FROM (SELECT {', '.join(ks)} FROM {t} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in ks)} GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0" for t, ks in UNIQUE.items()]
    + [f"SELECT '{t}', 'existe: {c} en {u}', count(*), min(CAST({c} AS VARCHAR)) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {d} FROM {u} WHERE {d} IS NOT NULL) HAVING count(*) > 0" for t, c, u, d in FOREIGN]
)


@query(_REPORT)
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tabla, regla, n, ejemplo) of every broken constraint: conditions of a row, repeated keys, references to nothing.

    All conditions of a table are judged in one pass, so that every fault of a row is attributed at once.
    """
    out = None
    for t, (i, cs) in CHECKS.items():
        rules = {name: F.expr(re.sub(r"MATCH\((\w+), '([^']*)'\)", r"regexp_like(\1, '^(?:\2)$')", c)) for name, c in cs.items()}
        one = R.violations(table(spark, sf_dir, t).withColumn("_id", F.col(i).cast("string")), "_id", rules).groupBy("regla").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("ejemplo")).withColumn("tabla", F.lit(t))
        out = one if out is None else out.unionByName(one)
    for t, ks in UNIQUE.items():
        again = table(spark, sf_dir, t).dropna(subset=ks).groupBy(*ks).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        out = out.unionByName(again.agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws("|", *(F.col(k).cast("string") for k in ks))).alias("ejemplo")).filter("n > 0").select(F.lit(f"única: {', '.join(ks)}").alias("regla"), "n", "ejemplo", F.lit(t).alias("tabla")))
    for t, c, u, d in FOREIGN:
        lost = table(spark, sf_dir, t).select(F.col(c).alias("_k")).filter("_k IS NOT NULL").join(table(spark, sf_dir, u).select(F.col(d).alias("_k")), "_k", "left_anti")
        out = out.unionByName(lost.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_k").cast("string")).alias("ejemplo")).filter("n > 0").select(F.lit(f"existe: {c} en {u}").alias("regla"), "n", "ejemplo", F.lit(t).alias("tabla")))
    return out.select("tabla", "regla", "n", "ejemplo")


@query(f"""
WITH d AS (SELECT identificador, {', '.join(f"try_cast(CASE WHEN regexp_full_match({c}, '{_DAY}') THEN {c} END AS DATE) AS d_{c}, regexp_full_match({c}, '{_DAY}') AS f_{c}" for c in _STUDY_DATES)} FROM studies),
m AS (SELECT identificador, unnest(list_filter([{', '.join(f"CASE WHEN f_{c} AND d_{c} IS NULL THEN 'no existe: {c}' END" for c in _STUDY_DATES)}, CASE WHEN d_fecha_fin_real_espana < d_fecha_inicio_real THEN 'fin antes de inicio' END], lambda x: x IS NOT NULL)) AS motivo FROM d)
SELECT motivo, count(*) AS filas, count(DISTINCT identificador) AS estudios FROM m GROUP BY 1""")
def impossible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in form that do not exist, and ends before starts, counted: what a load drops is named first."""
    s = table(spark, sf_dir, "studies")
    day = {c: F.try_to_date(F.when(F.col(c).rlike(f"^{_DAY}$"), F.col(c)), "yyyy-MM-dd") for c in _STUDY_DATES}
    rules = {f"no existe: {c}": ~(F.col(c).rlike(f"^{_DAY}$") & d.isNull()) for c, d in day.items()}
    rules["fin antes de inicio"] = ~(day["fecha_fin_real_espana"] < day["fecha_inicio_real"])
    return R.violations(s, "identificador", rules).groupBy(F.col("regla").alias("motivo")).agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("identificador").alias("estudios"))
