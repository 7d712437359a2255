"""Raw records to a normalised schema: entities, children and bridges, with every refused row reported.

Each table is one expression over the flat leaves or the parsed variant of the records; surrogate numbers are avoided, natural keys join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.functions import text as X
from censo.functions import vocabularies as V
from censo.operators import relational as R
from censo.plans import sqltext as Q
from censo.plans.centres import elements, leaf
from censo.plans.nested import DATES, POPULATION, PURPOSE, leaves
from censo.plans.registry import Registry
from censo.session import cut, table

query = Registry()

def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).replace("_a_e_m_p_s", "_aemps")


def flat_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per valid record, whatever shape its blocks came in: dates as ISO text, flags 0/1/null, total without stand-ins."""
    d = table(spark, sf_dir, "detalle")
    flat = leaves(d, ["detalle_id"], ("calendario", "poblacion", "proposito"), mark_valid=True)
    value = lambda block, key: F.max(F.when((F.col("bloque") == block) & (F.col("clave") == key), F.col("valor")))
    cols = [value("calendario", k).alias(k) for k in DATES] + [value("poblacion", k).alias(k) for k in (*POPULATION, "total")] + [value("proposito", k).alias(k) for k in PURPOSE]
    wide = flat.groupBy("detalle_id").agg(*cols)
    flag = lambda k: F.when(F.col(k).isin("0", "1"), F.col(k).cast("int"))
    head = d.select("detalle_id", "carga", F.get_json_object("registro", "$.identificador").alias("identificador"), F.get_json_object("registro", "$.acronimo").alias("_a"), F.get_json_object("registro", "$.enfermedadRara").alias("_r"), F.get_json_object("registro", "$.organismo.promotor").alias("promotor"))
    return wide.join(head, "detalle_id").select(
        "detalle_id", "carga", "identificador", (F.length("identificador") == 17).alias("es_ctis"), F.when(~F.upper(F.trim("_a")).isin("N/A", "NA", "ND", "-", ""), F.trim("_a")).alias("acronimo"), X.flag(F.col("_r")).alias("enfermedad_rara"), "promotor",
        *(X.iso_date(F.col(k)).alias(snake(k)) for k in DATES), *(flag(k).alias(k) for k in POPULATION), X.clean_total(X.integer(F.col("total"))).alias("poblacion_total"), *(flag(k).alias(snake(k)) for k in PURPOSE),
    )


def study_rules() -> dict[str, Column]:
    """Constraints of the studies table; null passes."""
    dates = {snake(k): F.col(snake(k)).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") for k in DATES}
    return {"identificador": F.coalesce(F.col("identificador").rlike(r"^[0-9]{4}-[0-9]{6}-[0-9]{2}(-[0-9]{2})?$"), F.lit(False)), "poblacion_total": F.col("poblacion_total") > 0, **dates}


_STATE = "CASE WHEN trim({0}) <> '' THEN regexp_replace(trim({0}), '^([0-9]{{2}})-([0-9]{{2}})-([0-9]{{4}})$', '\\3-\\2-\\1') END"
_FLAG = "CASE WHEN {0} IN ('0', '1') THEN CAST({0} AS INT) END"
_PICKED = ", ".join(f"max(valor) FILTER (WHERE bloque = '{b}' AND clave = '{k}') AS \"{k}\"" for b, ks in (("calendario", DATES), ("poblacion", (*POPULATION, "total")), ("proposito", PURPOSE)) for k in ks)
_COLUMNS = ", ".join(
    [f"{_STATE.format(f'"{k}"')} AS {snake(k)}" for k in DATES] + [f"{_FLAG.format(f'"{k}"')} AS {k}" for k in POPULATION]
    + ["CASE WHEN regexp_full_match(trim(total), '[0-9]+') AND try_cast(trim(total) AS BIGINT) NOT IN (0, 999999) THEN try_cast(trim(total) AS BIGINT) END AS poblacion_total"] + [f"{_FLAG.format(f'"{k}"')} AS {snake(k)}" for k in PURPOSE]
)
_BAD_DATES = ", ".join(f"CASE WHEN NOT regexp_full_match({snake(k)}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN '{snake(k)}' END" for k in DATES)
STUDIES_SQL = f"""{Q.records()},
bx AS (SELECT detalle_id, b.bloque, json_extract(r, '$.' || b.bloque) AS x FROM j, (VALUES ('calendario'), ('poblacion'), ('proposito')) b(bloque)),
by_ AS (SELECT detalle_id, bloque, CASE WHEN json_type(x) = 'VARCHAR' AND json_valid(x ->> '$') THEN CAST(x ->> '$' AS JSON) ELSE x END AS x FROM bx),
tr AS (SELECT detalle_id, bloque, t.key AS k, t.type AS tipo, t.atom ->> '$' AS v, t.parent AS padre FROM by_, json_tree(x) t),
lf AS (SELECT detalle_id, bloque, clave, nullif(trim(valor), '') AS valor FROM (SELECT detalle_id, bloque, k AS clave, v AS valor FROM tr WHERE tipo NOT IN ('OBJECT', 'ARRAY', 'NULL')
  UNION ALL SELECT detalle_id, bloque, max(v) FILTER (WHERE k = 'campo'), max(v) FILTER (WHERE k = 'valor') FROM tr GROUP BY detalle_id, bloque, padre HAVING count(*) FILTER (WHERE k = 'campo') > 0)),
wi AS (SELECT detalle_id, {_PICKED} FROM (SELECT * FROM lf UNION ALL SELECT detalle_id, NULL, NULL, NULL FROM j) GROUP BY 1),
fs AS (SELECT detalle_id, d.carga, d.registro ->> '$.identificador' AS identificador, length(d.registro ->> '$.identificador') = 17 AS es_ctis, CASE WHEN upper(trim(d.registro ->> '$.acronimo')) NOT IN ('N/A', 'NA', 'ND', '-', '') THEN trim(d.registro ->> '$.acronimo') END AS acronimo,
  CASE WHEN trim(d.registro ->> '$.enfermedadRara') IN ('0', '1') THEN CAST(trim(d.registro ->> '$.enfermedadRara') AS INT) END AS enfermedad_rara, d.registro ->> '$.organismo.promotor' AS promotor, {_COLUMNS} FROM wi JOIN detalle d USING (detalle_id)),
ck AS (SELECT *, list_filter([CASE WHEN NOT coalesce(regexp_full_match(identificador, '[0-9]{{4}}-[0-9]{{6}}-[0-9]{{2}}(-[0-9]{{2}})?'), false) THEN 'identificador' END, CASE WHEN NOT poblacion_total > 0 THEN 'poblacion_total' END, {_BAD_DATES}], lambda x: x IS NOT NULL) AS faltas FROM fs)"""


@query(f"WITH {STUDIES_SQL} SELECT * EXCLUDE (faltas) FROM ck WHERE len(faltas) = 0 QUALIFY row_number() OVER (PARTITION BY identificador ORDER BY detalle_id DESC) = 1")
def gold_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted studies: the last record of each identifier among those that keep every constraint."""
    good, _ = R.quarantine(flat_studies(spark, sf_dir), study_rules())
    last = good.groupBy("identificador").agg(F.max("detalle_id").alias("detalle_id"))
    return good.join(last, ["identificador", "detalle_id"], "left_semi")


@query(f"WITH {STUDIES_SQL} SELECT detalle_id, identificador, array_to_string(faltas, ',') AS faltas FROM ck WHERE len(faltas) > 0")
def gold_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused studies with the columns at fault."""
    _, bad = R.quarantine(flat_studies(spark, sf_dir), study_rules())
    return bad.select("detalle_id", "identificador", F.array_join("faltas", ",").alias("faltas"))


def split_names(column: str) -> list[Column]:
    """Columns (orden, parte) of a text of names between bars."""
    return [F.posexplode(F.split(F.col(column), "[|]")).alias("orden", "parte")]


def said_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(detalle_id, papel, orden, parte): every name a record gives its sponsor ('promotor') or, between bars, its funders ('financiador')."""
    v = F.try_parse_json("registro")
    d = table(spark, sf_dir, "detalle").select("detalle_id", F.try_variant_get(v, "$.organismo.promotor", "string").alias("promotor"), F.try_variant_get(v, "$.organismo.financiador", "string").alias("financiador"))
    sponsor = d.select("detalle_id", F.lit("promotor").alias("papel"), F.lit(0).alias("orden"), F.col("promotor").alias("parte"))
    funders = d.select("detalle_id", F.lit("financiador").alias("papel"), *split_names("financiador"))
    return sponsor.unionByName(funders).filter("parte IS NOT NULL AND trim(parte) <> ''")


def keyed_names(said: DataFrame) -> DataFrame:
    """(parte, m, limpio, clave, llana) of every distinct spelling that names somebody: its count, compared key, and whether nothing was cut from it."""
    counts = said.groupBy("parte").agg(F.count(F.lit(1)).alias("m"))
    keyed = cut(counts.select("parte", "m", X.clean_text(F.col("parte")).alias("limpio"), X.organisation_key(F.col("parte")).alias("clave"), X.match_key(F.col("parte")).alias("entera"), X.is_placeholder(F.col("parte")).alias("nadie")))
    return keyed.filter("clave IS NOT NULL AND NOT nadie").select("parte", "m", "limpio", "clave", (F.col("clave") == F.col("entera")).alias("llana"))


_CUTS = ", ".join(f"nullif(position({Q.quote(m)} IN k), 0)" for m in X.CLAUSES)
_ADDRESS = X.ADDRESS.replace("'", "''")
NAMES_SQL = f"""{Q.records()},
sp AS (SELECT detalle_id, 'promotor' AS papel, 0 AS orden, r ->> '$.organismo.promotor' AS parte FROM j),
fi AS (SELECT detalle_id, 'financiador' AS papel, generate_subscripts(ps, 1) - 1 AS orden, unnest(ps) AS parte FROM (SELECT detalle_id, string_split(r ->> '$.organismo.financiador', '|') AS ps FROM j)),
sn AS (SELECT * FROM (SELECT * FROM sp UNION ALL SELECT * FROM fi) WHERE parte IS NOT NULL AND trim(parte) <> ''),
ct AS (SELECT parte, count(*) AS m FROM sn GROUP BY 1),
k0 AS (SELECT parte, m, {Q.clean('parte')} AS limpio, {Q.spaced_key('parte')} AS k, {Q.placeholder('parte')} AS nadie FROM ct),
k1 AS (SELECT *, list_min(list_filter([{_CUTS}, nullif(position(regexp_extract(k, '{_ADDRESS}') IN k), 0) * CASE WHEN regexp_matches(k, '{_ADDRESS}') THEN 1 END], lambda x: x > 1)) AS corte FROM k0),
k2 AS (SELECT parte, m, limpio, nadie, nullif(replace(coalesce(nullif(trim(CASE WHEN corte IS NULL THEN k ELSE substr(k, 1, corte - 1) END), ''), k), ' ', ''), '') AS clave, replace(k, ' ', '') AS entera FROM k1),
kn AS (SELECT parte, m, limpio, clave, clave = entera AS llana FROM k2 WHERE clave IS NOT NULL AND NOT nadie),
og AS (SELECT clave, limpio AS nombre FROM (SELECT clave, limpio, row_number() OVER (PARTITION BY clave ORDER BY max(llana::INT) DESC, sum(m) DESC, limpio) AS r FROM kn GROUP BY clave, limpio) WHERE r = 1)"""


@query(f"WITH {NAMES_SQL} SELECT clave, nombre FROM og")
def gold_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clave, nombre): one row per organisation identity of sponsors and funders together.

    Keys are computed once per distinct spelling; the display is the most frequent spelling that needed no cut, else the most frequent.
    """
    names = keyed_names(said_names(spark, sf_dir))
    votes = names.groupBy("clave", "limpio").agg(F.sum("m").alias("m"), F.max("llana").alias("llana"))
    top = votes.groupBy("clave").agg(F.max(F.struct("llana", "m")).alias("x"))
    return votes.join(top.hint("merge"), "clave").filter((F.col("llana") == F.col("x.llana")) & (F.col("m") == F.col("x.m"))).groupBy("clave").agg(F.min("limpio").alias("nombre"))


@query(f"WITH {NAMES_SQL}, f AS (SELECT detalle_id, papel, orden, clave, row_number() OVER (PARTITION BY detalle_id, papel, clave ORDER BY orden) AS q FROM sn JOIN kn USING (parte)) SELECT detalle_id, papel, CAST(orden AS BIGINT) AS orden, clave FROM f WHERE q = 1")
def gold_record_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridges of records with their sponsor and funders: keys in source order, the first of each organisation within a record and role."""
    said = said_names(spark, sf_dir)
    keyed = said.join(keyed_names(said).select("parte", "clave").hint("merge"), "parte")
    return keyed.groupBy("detalle_id", "papel", "clave").agg(F.min("orden").cast("bigint").alias("orden"))


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(detalle_id, pos, comercial, codigo, huerfano, via, sustancias): one row per element, not deduplicated; no block, no rows; a single object is one element."""
    blank = lambda k: F.nullif(F.trim(leaf(k)), F.lit(""))
    return elements(spark, sf_dir, "$.intervenciones.intervencion").select(
        "detalle_id", F.col("pos").cast("bigint").alias("pos"), blank("nombreComercial").alias("comercial"), blank("codigo").alias("codigo"), blank("huerfano").alias("huerfano"), blank("viasAdministracion").alias("via"), blank("sustancias").alias("sustancias")
    )


_ITEMS = f"""{Q.records()}, {Q.elements('$.intervenciones.intervencion')},
t AS (SELECT detalle_id, pos, nullif(trim(x ->> '$.nombreComercial'), '') AS comercial, nullif(trim(x ->> '$.codigo'), '') AS codigo, nullif(trim(x ->> '$.viasAdministracion'), '') AS via, nullif(trim(x ->> '$.sustancias'), '') AS sustancias, nullif(trim(x ->> '$.huerfano'), '') AS huerfano FROM x)"""


@query(f"WITH {_ITEMS} SELECT huerfano, count(*) AS n, count(via) AS con_via, count(DISTINCT sustancias) AS sustancias FROM t GROUP BY 1")
def intervention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions(spark, sf_dir).groupBy("huerfano").agg(F.count(F.lit(1)).alias("n"), F.count("via").alias("con_via"), F.countDistinct("sustancias").alias("sustancias"))


def routes_of(spark: SparkSession, spellings: DataFrame) -> DataFrame:
    """(via, ruta) of distinct spellings ``via``: the canonical route, null for texts that name none; unmapped spellings stay as they are, cleaned."""
    names = spark.createDataFrame(list(V.ROUTES.items()), "k string, ruta string")
    keyed = spellings.select("via", X.clean_text(F.col("via")).alias("limpia")).withColumn("k", X.fold(F.col("limpia")))
    named = keyed.join(F.broadcast(names), "k", "left")  # a table of literals
    return named.select("via", F.when(~F.col("k").isin(*V.NOT_A_ROUTE), F.coalesce("ruta", "limpia")).alias("ruta"))


_ROUTES_SQL = f"""rn AS {Q.values(list(V.ROUTES.items()), 'k, ruta')}, gr AS {Q.values(list(V.ROUTE_GROUPS.items()), 'ruta, grupo')},
vi AS (SELECT via, {Q.clean('via')} AS limpia FROM (SELECT DISTINCT via FROM t WHERE via IS NOT NULL)),
ru AS (SELECT via, CASE WHEN {Q.fold('limpia')} NOT IN ({', '.join(map(Q.quote, V.NOT_A_ROUTE))}) THEN coalesce(rn.ruta, limpia) END AS ruta FROM vi LEFT JOIN rn ON rn.k = {Q.fold('limpia')})"""


@query(f"""WITH {_ITEMS}, {_ROUTES_SQL}
SELECT detalle_id, CAST(pos AS BIGINT) AS pos, CASE WHEN NOT {Q.placeholder('comercial')} THEN {Q.clean('comercial')} END AS nombre_comercial, {Q.clean('codigo')} AS codigo, CASE WHEN huerfano IN ('0', '1') THEN CAST(huerfano AS INT) END AS huerfano, ru.ruta FROM t LEFT JOIN ru ON ru.via = t.via""")
def gold_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child table of interventions: stand-in names are null, the route is canonical; two arms with one drug are two rows."""
    i = interventions(spark, sf_dir)
    routes = routes_of(spark, i.select("via").filter("via IS NOT NULL").distinct())
    name = F.when(~X.is_placeholder(F.col("comercial")), X.clean_text(F.col("comercial")))
    return i.join(routes, "via", "left").select("detalle_id", "pos", name.alias("nombre_comercial"), X.clean_text(F.col("codigo")).alias("codigo"), X.flag(F.col("huerfano")).alias("huerfano"), "ruta")


@query(f"WITH {_ITEMS}, {_ROUTES_SQL} SELECT coalesce(grupo, 'sin grupo') AS grupo, ru.ruta, count(*) AS n FROM t JOIN ru ON ru.via = t.via LEFT JOIN gr ON gr.ruta = ru.ruta WHERE ru.ruta IS NOT NULL GROUP BY 1, 2")
def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with their group and interventions; a route no group is known for is visible under 'sin grupo'."""
    groups = spark.createDataFrame(list(V.ROUTE_GROUPS.items()), "ruta string, grupo string")
    said = cut(interventions(spark, sf_dir).filter("via IS NOT NULL").groupBy("via").agg(F.count(F.lit(1)).alias("n")))
    named = said.join(routes_of(spark, said.select("via")), "via").filter("ruta IS NOT NULL").join(F.broadcast(groups), "ruta", "left")  # a table of literals
    return named.groupBy(F.coalesce("grupo", F.lit("sin grupo")).alias("grupo"), "ruta").agg(F.sum("n").alias("n"))


def said_substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(detalle_id, pos, orden, clave, nombre): the substances of each intervention, split at bars; stand-ins dropped, the first of each key kept."""
    parts = interventions(spark, sf_dir).select("detalle_id", "pos", *split_names("sustancias")).filter("trim(parte) <> ''")
    keyed = cut(parts.groupBy("parte").agg(F.count(F.lit(1)).alias("m")).select("parte", X.match_key(F.col("parte")).alias("clave"), X.clean_text(F.col("parte")).alias("nombre"), X.is_placeholder(F.col("parte")).alias("nadie")))
    known = parts.join(keyed.filter("clave IS NOT NULL AND NOT nadie").select("parte", "clave", "nombre").hint("merge"), "parte")
    first = known.groupBy("detalle_id", "pos", "clave").agg(F.min(F.struct("orden", "nombre")).alias("x"))
    return first.select("detalle_id", "pos", F.col("x.orden").cast("bigint").alias("orden"), "clave", F.col("x.nombre").alias("nombre"))


_SUBSTANCES_SQL = f"""{_ITEMS}, pa AS (SELECT detalle_id, pos, generate_subscripts(ps, 1) - 1 AS orden, unnest(ps) AS parte FROM (SELECT detalle_id, pos, string_split(sustancias, '|') AS ps FROM t WHERE sustancias IS NOT NULL)),
ks AS (SELECT detalle_id, pos, orden, {Q.match_key('parte')} AS clave, {Q.clean('parte')} AS nombre FROM pa WHERE trim(parte) <> '' AND NOT {Q.placeholder('parte')}),
su AS (SELECT detalle_id, CAST(pos AS BIGINT) AS pos, CAST(orden AS BIGINT) AS orden, clave, nombre FROM (SELECT *, row_number() OVER (PARTITION BY detalle_id, pos, clave ORDER BY orden, nombre) AS q FROM ks WHERE clave IS NOT NULL) WHERE q = 1)"""


@query(f"WITH {_SUBSTANCES_SQL} SELECT * FROM su")
def gold_intervention_substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said_substances(spark, sf_dir)


@query(f"WITH {_SUBSTANCES_SQL} SELECT clave, arg_min(nombre, (detalle_id, pos, orden)) AS nombre, count(DISTINCT detalle_id) AS registros FROM su GROUP BY 1")
def substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of substances by compared name; shown as the corpus writes it first."""
    s = said_substances(spark, sf_dir)
    return s.groupBy("clave").agg(F.min_by("nombre", F.struct("detalle_id", "pos", "orden")).alias("nombre"), F.countDistinct("detalle_id").alias("registros"))


def said_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = elements(spark, sf_dir, "$.areasTerapeuticas.area")
    return a.select("detalle_id", "pos", *(X.clean_text(leaf(k)).alias(k) for k in ("eutct", "nombre_es", "nombre_en"))).filter("eutct IS NOT NULL")


_AREAS_SQL = f"""{Q.records()}, {Q.elements('$.areasTerapeuticas.area')}, ar AS (SELECT * FROM (SELECT detalle_id, pos, {', '.join(f"{Q.clean(f"(x ->> '$.{k}')")} AS {k}" for k in ('eutct', 'nombre_es', 'nombre_en'))} FROM x) WHERE eutct IS NOT NULL)"""


@query(f"WITH {_AREAS_SQL} SELECT eutct, arg_min(nombre_es, (detalle_id, pos)) FILTER (WHERE nombre_es IS NOT NULL) AS nombre_es, arg_min(nombre_en, (detalle_id, pos)) FILTER (WHERE nombre_en IS NOT NULL) AS nombre_en FROM ar GROUP BY 1")
def gold_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of therapeutic areas: names as the corpus gives them first."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("detalle_id", "pos"))).alias(c)
    return said_areas(spark, sf_dir).groupBy("eutct").agg(first("nombre_es"), first("nombre_en"))


@query(f"WITH {_AREAS_SQL} SELECT DISTINCT detalle_id, eutct FROM ar")
def gold_record_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said_areas(spark, sf_dir).select("detalle_id", "eutct").distinct()


@query("SELECT study_id, center_id FROM study_centers GROUP BY 1, 2")
def gold_study_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge carries keys only; pairs sent twice are one."""
    return table(spark, sf_dir, "study_centers").select("study_id", "center_id").distinct()


@query("""
WITH n AS (SELECT CAST(carga AS BIGINT) AS carga, count(*) AS n, count(*) FILTER (WHERE trim(acronimo) = '') AS blanco, count(acronimo) AS hay, count(DISTINCT acronimo) AS distintos, max(length(acronimo)) AS largo, min(fecha_registro) AS desde, max(fecha_registro) AS hasta FROM studies GROUP BY 1) SELECT * FROM n""")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, distinct values, lengths and range of plain fields by load, in one pass."""
    s = table(spark, sf_dir, "studies")
    return s.groupBy(F.col("carga").cast("bigint").alias("carga")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.trim("acronimo") == "").alias("blanco"), F.count("acronimo").alias("hay"), F.countDistinct("acronimo").alias("distintos"), F.max(F.length("acronimo")).cast("bigint").alias("largo"), F.min("fecha_registro").alias("desde"), F.max("fecha_registro").alias("hasta")
    )
