"""Identity, repair, matching, cleaning and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censo.functions import text as X
from censo.operators import relational as R
from censo.operators.matching import MARGIN, blocked_candidates, blocked_match
from censo.operators.repair import triangulate
from censo.plans import sqltext as Q
from censo.plans.registry import Registry
from censo.session import cut, table

query = Registry()


_TOK = "list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('of', 'de', 'the', 'and', 'a')))"


@query(f"""
WITH t AS (SELECT p_partkey, p_type, p_size, {_TOK} AS w FROM part),
rws AS (SELECT * FROM t WHERE p_partkey % 2 = 1), cat AS (SELECT p_partkey AS code, p_type, p_size, w AS v FROM t WHERE p_partkey % 2 = 0),
x AS (SELECT DISTINCT p_partkey, code FROM rws JOIN cat USING (p_type, p_size)),
s AS (SELECT x.p_partkey, x.code, len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) AS score FROM x JOIN rws USING (p_partkey) JOIN cat USING (code)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, code) AS r FROM s),
b AS (SELECT p_partkey, max(CASE WHEN r = 1 THEN code END) AS code, max(CASE WHEN r = 1 THEN score END) AS score, max(CASE WHEN r = 2 THEN score END) AS second FROM r WHERE r <= 2 GROUP BY 1)
SELECT rws.p_partkey, code, round(score, 6) AS score, round(second, 6) AS second, CASE WHEN score IS NULL OR score < 0.25 THEN 'sin candidato' WHEN score < 0.5 THEN 'cerca' WHEN coalesce(score - second < 0.10, false) THEN 'ambiguo' ELSE 'casado' END AS verdict FROM rws LEFT JOIN b USING (p_partkey)""")
def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd parts matched against even ones within (type, size) blocks by the words of their names."""
    words = F.filter(F.split(F.regexp_replace(F.lower("p_name"), "[^a-z0-9 ]", " "), " "), lambda w: (w != "") & ~w.isin("of", "de", "the", "and", "a"))
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_type", F.col("p_size").cast("string")).alias("bloque"), F.array_distinct(words).alias("w"))
    cat = t.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("code"), "bloque", F.col("w").alias("v"))
    m = blocked_match(t.filter("p_partkey % 2 = 1"), "p_partkey", "w", cat, "code", "v", ["bloque"])
    return m.select("p_partkey", "code", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), "verdict")


_SYN = ", ".join(f"'{k}': '{v}'" for k, v in X.SYNONYMS.items())
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _words_sql(column: str) -> str:
    plain = f"regexp_replace(lower(strip_accents(coalesce({column}, ''))), '[^a-z0-9 ]', ' ', 'g')"
    mapped = f"list_transform(list_filter(string_split({plain}, ' '), lambda w: w <> ''), lambda w: coalesce(MAP {{{_SYN}}}[w], w))"
    return f"list_distinct(list_filter({mapped}, lambda w: w NOT IN ({_STOP})))"


def _town_sql(column: str) -> str:
    head = f"trim(split_part(split_part(split_part(coalesce({column}, ''), ',', 1), '/', 1), '(', 1))"
    plain = f"trim(regexp_replace(lower(strip_accents({head})), '\\s+', ' ', 'g'), ' .,;:-''´`')"
    return f"trim(regexp_replace({plain}, '^(?:(?:a|o|la|el|lo|las|los|les|els)(?:\\s+|$)|l'')', ''))"


def _code_sql(column: str) -> str:
    bare = f"replace(replace(trim({column}), '.', ''), ',', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9]{{4,5}}') THEN lpad({bare}, 5, '0') END"


MATCH_SIDES = f"""rws AS (SELECT center_id, {_code_sql('cod_postal')} AS cp, {_town_sql('localidad')} AS ciudad, {_words_sql('nombre')} AS w FROM centers),
cat AS (SELECT codcnh, {_code_sql('cod_postal')} AS cp, {_town_sql('municipio')} AS ciudad, {_words_sql('nombre')} AS v FROM hospitals)"""


MATCH_SQL = f"""
WITH {MATCH_SIDES},
x AS (SELECT center_id, codcnh FROM rws JOIN cat ON substr(rws.cp, 1, 2) = substr(cat.cp, 1, 2) UNION SELECT center_id, codcnh FROM rws JOIN cat ON rws.ciudad = cat.ciudad AND rws.ciudad <> ''),
s AS (SELECT x.center_id, x.codcnh, CASE WHEN len(list_distinct(list_concat(w, v))) > 0 THEN len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) ELSE 0.0 END AS score FROM x JOIN rws USING (center_id) JOIN cat USING (codcnh)),
r AS (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY score DESC, codcnh) AS r FROM s),
b AS (SELECT center_id, max(CASE WHEN r = 1 THEN codcnh END) AS codcnh, max(CASE WHEN r = 1 THEN score END) AS score, max(CASE WHEN r = 2 THEN score END) AS second FROM r WHERE r <= 2 GROUP BY 1)
SELECT rws.center_id, codcnh, round(score, 6) AS score, round(second, 6) AS second, CASE WHEN score IS NULL OR score < 0.25 THEN 'sin candidato' WHEN score < 0.5 THEN 'cerca' WHEN coalesce(score - second < 0.10, false) THEN 'ambiguo' ELSE 'casado' END AS verdict FROM rws LEFT JOIN b USING (center_id)"""


def match_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Centre rows and catalogue with prov, ciudad (blocks) and their words w and v."""
    side = lambda t, town: (F.substring(X.normalise_postcode(F.col("cod_postal")), 1, 2).alias("prov"), X.normalise_town(F.coalesce(town, F.lit(""))).alias("ciudad"), X.tokens(F.coalesce("nombre", F.lit(""))).alias(t))
    c = cut(table(spark, sf_dir, "centers").select("center_id", "nombre", "localidad", *side("w", "localidad")))
    return c, cut(table(spark, sf_dir, "hospitals").select("codcnh", *side("v", "municipio")))


@query(MATCH_SQL)
def hospital_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre rows against the catalogue: blocks by province and town, synonyms united, a verdict for every row.

    The province is the first two digits of the code, so its block holds every hospital of the row's postcode as well. Rows that read alike
    are matched once.
    """
    c, h = match_sides(spark, sf_dir)
    c = c.drop("nombre", "localidad")
    # whatever the order of their words
    alike = cut(c.withColumn("w", F.array_sort("w")).withColumn("k", F.min("center_id").over(W.partitionBy("prov", "ciudad", "w"))))
    m = blocked_match(alike.filter("center_id = k").select("k", "prov", "ciudad", "w"), "k", "w", h, "codcnh", "v", ["prov", "ciudad"]).drop("why")
    return alike.select("center_id", "k").join(m, "k").drop("k").withColumn("score", F.round("score", 6)).withColumn("second", F.round("second", 6))


@query(f"SELECT center_id, codcnh FROM ({MATCH_SQL}) WHERE verdict = 'casado'")
def hospital_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every centre row that was matched, whatever its studies."""
    return hospital_match(spark, sf_dir).filter("verdict = 'casado'").select("center_id", "codcnh")


_WORD_TEXT = "array_to_string(list_filter(string_split(regexp_replace(lower(strip_accents(coalesce(nombre, ''))), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> ''), ' ')"


@query(f"""
WITH m AS ({MATCH_SQL}), {MATCH_SIDES},
t AS (SELECT sc.center_id, count(DISTINCT s.identificador) AS ensayos FROM study_centers sc JOIN studies s ON s.identificador = sc.study_id AND s.fecha_autorizacion_aemps >= '2013-01-01' GROUP BY 1),
a AS (SELECT c.center_id, c.nombre, c.localidad, {_WORD_TEXT.replace('nombre', 'c.nombre')} AS palabras, rws.ciudad, coalesce(ensayos, 0) AS ensayos FROM m JOIN centers c USING (center_id) JOIN rws USING (center_id) LEFT JOIN t USING (center_id) WHERE verdict = 'ambiguo'),
g AS (SELECT palabras, ciudad, min(center_id) AS center_id, CAST(sum(ensayos) AS BIGINT) AS ensayos, count(*) AS filas FROM a GROUP BY 1, 2),
x AS (SELECT center_id, codcnh FROM rws JOIN cat ON substr(rws.cp, 1, 2) = substr(cat.cp, 1, 2) UNION SELECT center_id, codcnh FROM rws JOIN cat ON rws.ciudad = cat.ciudad AND rws.ciudad <> ''),
s AS (SELECT g.center_id, x.codcnh, cat.ciudad AS donde, CASE WHEN len(list_distinct(list_concat(w, v))) > 0 THEN len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) ELSE 0.0 END AS score FROM g JOIN x USING (center_id) JOIN rws USING (center_id) JOIN cat USING (codcnh)),
r AS (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY score DESC, codcnh) AS r, max(score) OVER (PARTITION BY center_id) AS top FROM s),
f AS (SELECT g.center_id, string_agg(codcnh, ',' ORDER BY r.r) AS candidatos, CASE WHEN g.ciudad <> '' AND count(*) FILTER (WHERE score >= top - 0.1 AND donde = g.ciudad) = 1 THEN min(codcnh) FILTER (WHERE score >= top - 0.1 AND donde = g.ciudad) END AS propuesta FROM g JOIN r ON r.center_id = g.center_id AND r.r <= 5 GROUP BY g.center_id, g.ciudad)
SELECT format('c{{:02d}}', row_number() OVER (ORDER BY g.ensayos DESC, g.center_id)) AS caso, a.nombre, a.localidad, g.ensayos, g.filas, candidatos, propuesta FROM g JOIN a USING (center_id) JOIN f USING (center_id)""")
def ambiguous_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person has to separate, busiest first: ambiguous rows of one folded name and town are one case, asked for its first row.

    Of a case's five best candidates, the only one within MARGIN of the best in the row's own town is proposed.
    """
    c, h = match_sides(spark, sf_dir)
    unclear = hospital_match(spark, sf_dir).filter("verdict = 'ambiguo'").select("center_id")
    s = table(spark, sf_dir, "studies").filter("fecha_autorizacion_aemps >= '2013-01-01'").select(F.col("identificador").alias("study_id")).distinct()
    n = table(spark, sf_dir, "study_centers").select("study_id", "center_id").distinct().join(s.hint("merge"), "study_id", "left_semi").groupBy("center_id").agg(F.count(F.lit(1)).alias("ensayos"))
    rows = c.join(unclear.hint("merge"), "center_id").join(n.hint("merge"), "center_id", "left").withColumn("palabras", F.array_join(X.words_of(F.coalesce("nombre", F.lit(""))), " "))
    cases = cut(rows.groupBy("palabras", "ciudad").agg(F.min("center_id").alias("center_id"), F.coalesce(F.sum("ensayos"), F.lit(0)).cast("bigint").alias("ensayos"), F.count(F.lit(1)).alias("filas")))
    asked = cut(cases.select("center_id", "ensayos", "filas").join(c.hint("merge"), "center_id"))
    best = blocked_candidates(asked, "center_id", "w", h, "codcnh", "v", ["prov", "ciudad"], 5)
    best = best.withColumn("top", F.max("score").over(W.partitionBy("center_id"))).join(h.select("codcnh", F.col("ciudad").alias("donde")).hint("merge"), "codcnh").join(asked.select("center_id", "ciudad").hint("merge"), "center_id")
    here = (F.col("score") >= F.col("top") - MARGIN) & (F.col("donde") == F.col("ciudad")) & (F.col("ciudad") != "")
    found = best.groupBy("center_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rango", "codcnh"))), lambda x: x["codcnh"]), ",").alias("candidatos"), F.when(F.count_if(here) == 1, F.min(F.when(here, F.col("codcnh")))).alias("propuesta"))
    number = F.row_number().over(W.orderBy(F.desc("ensayos"), "center_id"))  # a review list: one row a case
    return asked.join(found.hint("merge"), "center_id").select(F.format_string("c%02d", number).alias("caso"), "nombre", "localidad", "ensayos", "filas", "candidatos", "propuesta")


@query("""
WITH r AS (SELECT center_id AS id, trim(cod_postal) AS c, center_key || '|' || localidad AS centro, localidad FROM centers),
whole AS (SELECT * FROM r WHERE regexp_full_match(c, '[0-9]{5}')), short AS (SELECT * FROM r WHERE regexp_full_match(c, '[0-9]{4}')),
dl AS (SELECT DISTINCT w, substr(w, 1, CAST(i AS INT) - 1) || substr(w, CAST(i AS INT) + 1) AS c FROM (SELECT DISTINCT c AS w FROM whole), range(1, 6) t(i)),
v1 AS (SELECT centro, c AS w, count(*) AS n FROM whole WHERE centro IS NOT NULL GROUP BY 1, 2), k1 AS (SELECT s.id, v1.w, v1.n FROM short s JOIN dl USING (c) JOIN v1 ON v1.w = dl.w AND v1.centro = s.centro),
v2 AS (SELECT localidad, c AS w, count(*) AS n FROM whole WHERE localidad IS NOT NULL GROUP BY 1, 2), k2 AS (SELECT s.id, v2.w, v2.n FROM short s JOIN dl USING (c) JOIN v2 ON v2.w = dl.w AND v2.localidad = s.localidad),
b1 AS (SELECT id, CASE WHEN count(*) FILTER (WHERE n = m) = 1 THEN min(w) FILTER (WHERE n = m) END AS w FROM (SELECT *, max(n) OVER (PARTITION BY id) AS m FROM k1) GROUP BY 1),
b2 AS (SELECT id, CASE WHEN count(*) FILTER (WHERE n = m) = 1 THEN min(w) FILTER (WHERE n = m) END AS w FROM (SELECT *, max(n) OVER (PARTITION BY id) AS m FROM k2) GROUP BY 1),
pre AS (SELECT DISTINCT localidad, substr(c, 1, 2) AS p FROM whole),
f AS (SELECT s.id, s.c, CASE WHEN b1.id IS NOT NULL THEN b1.w WHEN b2.id IS NOT NULL THEN b2.w WHEN pre.p IS NOT NULL THEN '0' || s.c END AS w, CASE WHEN b1.id IS NOT NULL THEN 'centro' WHEN b2.id IS NOT NULL THEN 'localidad' WHEN pre.p IS NOT NULL THEN 'provincia' END AS base
  FROM short s LEFT JOIN b1 ON b1.id = s.id LEFT JOIN b2 ON b2.id = s.id LEFT JOIN pre ON pre.localidad = s.localidad AND pre.p = '0' || substr(s.c, 1, 1))
SELECT id, coalesce(w, c) AS codigo, CASE WHEN w IS NOT NULL THEN base END AS base FROM f UNION ALL SELECT id, c, NULL FROM r WHERE NOT coalesce(regexp_full_match(c, '[0-9]{4}'), false)""")
def digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcodes of centres that lost a digit, restored from whole codes of the same centre, town or province."""
    c = table(spark, sf_dir, "centers").withColumn("centro", F.concat("center_key", F.lit("|"), "localidad"))
    return triangulate(c, "center_id", "cod_postal", "centro", "localidad")


@query("SELECT center_id, CASE WHEN regexp_full_match(replace(replace(trim(cod_postal), '.', ''), ',', ''), '[0-9]{4,5}') THEN lpad(replace(replace(trim(cod_postal), '.', ''), ',', ''), 5, '0') END AS codigo FROM centers")
def postcode_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "centers").select("center_id", X.normalise_postcode(F.col("cod_postal")).alias("codigo"))


@query("SELECT identificador, CASE WHEN trim(fecha_registro) <> '' THEN regexp_replace(trim(fecha_registro), '^([0-9]{2})-([0-9]{2})-([0-9]{4})$', '\\3-\\2-\\1') END AS fecha, CASE WHEN poblacion_total NOT IN (0, 999999) THEN poblacion_total END AS total, count(*) AS n FROM studies GROUP BY 1, 2, 3")
def converted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "studies")
    return s.groupBy("identificador", X.iso_date(F.col("fecha_registro")).alias("fecha"), X.clean_total(F.col("poblacion_total")).alias("total")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sponsor_id, lower({Q.clean('promotor')}) AS limpio FROM sponsors")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned names of the whole table, entities decoded."""
    return table(spark, sf_dir, "sponsors").select("sponsor_id", F.lower(X.clean_text(F.col("promotor"))).alias("limpio"))


@query(f"""
WITH u AS (SELECT sponsor_id AS id, promotor AS n FROM sponsors UNION ALL SELECT funder_id, nombre FROM funders), k AS (SELECT id, {Q.match_key('n')} AS clave FROM u)
SELECT clave, count(*) AS n, min(id) AS primero FROM k GROUP BY 1 HAVING count(*) > 1""")
def match_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that differ in case, accents, punctuation, spacing or entities only; rows without a name are the group of key null."""
    u = table(spark, sf_dir, "sponsors").select(F.col("sponsor_id").alias("id"), F.col("promotor").alias("n")).unionByName(table(spark, sf_dir, "funders").select(F.col("funder_id").alias("id"), F.col("nombre").alias("n")))
    k = u.select("id", X.match_key(F.col("n")).alias("clave"))
    return k.groupBy("clave").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("primero")).filter("n > 1")


@query("""
WITH c AS (SELECT provincia AS v, lower(strip_accents(provincia)) AS k, count(*) AS n FROM centers WHERE provincia IS NOT NULL GROUP BY 1, 2),
r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v = upper(v), n DESC, v) AS r FROM c) SELECT k AS clave, v AS valor FROM r WHERE r = 1""")
def mode_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent spelling of each province, quiet ones before capitals, ties to the smaller."""
    plain = F.translate(F.lower("provincia"), "áéíóúüñàèìòùç", "aeiouunaeiouc")
    rows = table(spark, sf_dir, "centers").select("provincia", plain.alias("clave"))
    return R.mode_by(rows, "clave", "provincia", [F.col("provincia") != F.upper("provincia")]).select("clave", F.col("provincia").alias("valor"))


@query("""
WITH j AS (SELECT detalle_id, registro FROM detalle WHERE json_valid(registro)), f AS (SELECT detalle_id, registro ->> '$.organismo.financiador' AS t FROM j),
p AS (SELECT detalle_id, unnest(string_split(t, '|')) AS v, generate_subscripts(string_split(t, '|'), 1) - 1 AS pos FROM f WHERE t IS NOT NULL),
q AS (SELECT detalle_id, pos, trim(v) AS valor, row_number() OVER (PARTITION BY detalle_id, lower(trim(v)) ORDER BY pos) AS r FROM p WHERE trim(v) <> '')
SELECT detalle_id, CAST(pos AS BIGINT) AS pos, valor FROM q WHERE r = 1""")
def pipe_split_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funders of each record: split, blanks dropped, first spelling per key, source order."""
    d = table(spark, sf_dir, "detalle").select("detalle_id", F.get_json_object("registro", "$.organismo.financiador").alias("t"), F.try_parse_json("registro").isNotNull().alias("ok")).filter("ok AND t IS NOT NULL")
    return R.first_seen(d, "detalle_id", "t")


@query("""
WITH v AS (
SELECT identificador AS id, 'identificador' AS regla FROM studies WHERE NOT regexp_full_match(identificador, '[0-9]{4}-[0-9]{6}-[0-9]{2}(-[0-9]{2})?')
UNION ALL SELECT identificador, 'fecha_autorizacion' FROM studies WHERE NOT regexp_full_match(fecha_autorizacion_aemps, '[0-9]{4}-[0-9]{2}-[0-9]{2}')
UNION ALL SELECT identificador, 'total_positivo' FROM studies WHERE NOT poblacion_total > 0
UNION ALL SELECT identificador, 'fase_uno_01' FROM studies WHERE NOT fase_uno IN (0, 1)
UNION ALL SELECT identificador, 'rara_01' FROM studies WHERE NOT enfermedad_rara IN (0, 1))
SELECT regla, count(*) AS n, min(id) AS ejemplo FROM v GROUP BY 1""")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken constraint, attributed to its column in one pass, null counting as kept."""
    rules = {
        "identificador": F.col("identificador").rlike(r"^[0-9]{4}-[0-9]{6}-[0-9]{2}(-[0-9]{2})?$"),
        "fecha_autorizacion": F.col("fecha_autorizacion_aemps").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "total_positivo": F.col("poblacion_total") > 0,
        "fase_uno_01": F.col("fase_uno").isin(0, 1),
        "rara_01": F.col("enfermedad_rara").isin(0, 1),
    }
    return R.violations(table(spark, sf_dir, "studies"), "identificador", rules).groupBy("regla").agg(F.count(F.lit(1)).alias("n"), F.min("identificador").alias("ejemplo"))


@query("""
SELECT campo, regla, count(*) AS n FROM (
SELECT 'poblacion_total' AS campo, 'centinela' AS regla FROM studies WHERE poblacion_total IN (0, 999999)
UNION ALL SELECT 'acronimo', 'vacio' FROM studies WHERE trim(acronimo) = '' UNION ALL SELECT 'acronimo', 'marcador' FROM studies WHERE upper(trim(acronimo)) IN ('N/A', 'NA', 'ND', '-')
UNION ALL SELECT 'fecha_registro', 'vacio' FROM studies WHERE trim(fecha_registro) = '') GROUP BY 1, 2""")
def rule_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "studies")
    blank = lambda c: F.trim(c) == ""
    return R.rule_tally(s, {
        ("poblacion_total", "centinela"): F.col("poblacion_total").isin(0, 999999), ("acronimo", "vacio"): blank("acronimo"),
        ("acronimo", "marcador"): F.upper(F.trim("acronimo")).isin("N/A", "NA", "ND", "-"), ("fecha_registro", "vacio"): blank("fecha_registro"),
    })


@query("""
WITH p AS (SELECT event_type, try_cast(props ->> '$.k' AS BIGINT) AS k, props ->> '$.k' AS t FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE t IS NULL) AS faltan, count(DISTINCT k) AS distintos, min(k) AS minimo, max(k) AS maximo, CAST(list_sort(list(k) FILTER (WHERE k IS NOT NULL))[CAST(floor(count(k) / 2) AS INT) + 1] AS BIGINT) AS mediana FROM p GROUP BY 1""")
def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON leaf by event type: presence, distinct values, range and upper median."""
    v = F.try_parse_json("props")
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(v, "$.k", "bigint").alias("k"))
    counts = e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("m"))
    med = R.upper_median(counts, "event_type", "k", "m")
    base = counts.groupBy("event_type").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("k").isNull(), F.col("m")).otherwise(0)).alias("faltan"), F.count("k").alias("distintos"), F.min("k").alias("minimo"), F.max("k").alias("maximo"))
    return base.join(med, "event_type", "left")


@query("""
WITH j AS (SELECT detalle_id, json_valid(registro) AS ok, CASE WHEN json_valid(registro) THEN registro END AS r FROM detalle),
s AS (SELECT CASE WHEN NOT ok THEN 'ilegible' WHEN json_type(r, '$.acronimo') IS NULL THEN 'ausente' WHEN json_type(r, '$.acronimo') = 'NULL' THEN 'nulo' WHEN trim(r ->> '$.acronimo') = '' THEN 'blanco' ELSE 'presente' END AS estado FROM j)
SELECT estado, count(*) AS n FROM s GROUP BY 1""")
def presence_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent, null, blank and present are four facts about a path (and an unreadable record a fifth)."""
    v = F.try_parse_json("registro")
    at = F.try_variant_get(v, "$.acronimo", "variant")
    state = F.when(v.isNull(), "ilegible").when(at.isNull(), "ausente").when(F.is_variant_null(at), "nulo").when(F.trim(F.try_variant_get(v, "$.acronimo", "string")) == "", "blanco").otherwise("presente")
    return table(spark, sf_dir, "detalle").select(state.alias("estado")).groupBy("estado").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH j AS (SELECT registro AS r FROM detalle WHERE json_valid(registro)), t AS (SELECT json_array_length(r, '$.centros.centro') AS n FROM j WHERE json_type(r, '$.centros.centro') = 'ARRAY')
SELECT CAST(n AS BIGINT) AS largo, count(*) AS registros FROM t GROUP BY 1""")
def list_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the lists of a path are."""
    v = F.try_parse_json("registro")
    items = F.try_variant_get(v, "$.centros.centro", "array<variant>")
    return table(spark, sf_dir, "detalle").select(F.size(items).cast("bigint").alias("largo")).filter("largo >= 0").groupBy("largo").agg(F.count(F.lit(1)).alias("registros"))


@query("""
WITH j AS (SELECT detalle_id, registro AS r FROM detalle WHERE json_valid(registro)),
c AS (SELECT detalle_id, unnest(json_extract(r, '$.centros.centro[*]')) AS x FROM j) SELECT detalle_id, count(*) AS centros, count(DISTINCT x ->> '$.codPostal') AS codigos FROM c GROUP BY 1""")
def centre_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of an array of objects, linked to their record; no array, no rows."""
    v = F.try_variant_get(F.try_parse_json("registro"), "$.centros.centro", "array<struct<codPostal:string>>")
    rows = table(spark, sf_dir, "detalle").select("detalle_id", F.explode(v).alias("x"))
    return rows.groupBy("detalle_id").agg(F.count(F.lit(1)).alias("centros"), F.countDistinct("x.codPostal").alias("codigos"))


@query("SELECT DISTINCT identificador FROM studies WHERE carga > 2 AND identificador NOT IN (SELECT identificador FROM studies WHERE carga <= 2)")
def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed ids that no earlier load has brought: a set difference."""
    s = table(spark, sf_dir, "studies")
    return s.filter("carga > 2").select("identificador").distinct().join(s.filter("carga <= 2").select("identificador"), "identificador", "left_anti").orderBy("identificador")


@query("""
WITH l AS (SELECT carga, count(DISTINCT identificador) AS listados FROM studies GROUP BY 1), f AS (SELECT s.carga, count(DISTINCT s.identificador) AS bajados FROM studies s JOIN (SELECT DISTINCT registro ->> '$.identificador' AS id FROM detalle WHERE json_valid(registro)) d ON d.id = s.identificador GROUP BY 1)
SELECT l.carga, listados, coalesce(bajados, 0) AS bajados, listados - coalesce(bajados, 0) AS pendientes FROM l LEFT JOIN f USING (carga)""")
def ingestion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed, fetched and pending ids per load."""
    s = table(spark, sf_dir, "studies").select("carga", "identificador").distinct()
    have = table(spark, sf_dir, "detalle").select(F.try_variant_get(F.try_parse_json("registro"), "$.identificador", "string").alias("identificador")).filter("identificador IS NOT NULL").distinct().withColumn("x", F.lit(1))
    g = s.join(have, "identificador", "left").groupBy("carga").agg(F.count(F.lit(1)).alias("listados"), F.count("x").alias("bajados"))
    return g.select("carga", "listados", "bajados", (F.col("listados") - F.col("bajados")).alias("pendientes"))


@query("""
WITH g AS (SELECT center_key, count(*) AS filas FROM centers GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT DISTINCT study_id, center_id FROM study_centers)
SELECT center_key AS clave, any_value(filas) AS filas, count(DISTINCT localidad) AS localidades, count(DISTINCT study_id) AS ensayos, string_agg(DISTINCT localidad, '; ' ORDER BY localidad) AS lista FROM g JOIN centers USING (center_key) LEFT JOIN p USING (center_id) GROUP BY 1""")
def centre_groups_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys held by several centre rows with distinct studies over the group (not their sum) and the towns as a sorted list."""
    c = table(spark, sf_dir, "centers").select("center_id", "center_key", "localidad")
    g = c.groupBy("center_key").agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("localidad").alias("localidades"), F.array_join(F.array_sort(F.collect_set("localidad")), "; ").alias("lista")).filter("filas >= 2")
    pairs = table(spark, sf_dir, "study_centers").select("study_id", "center_id").distinct()
    n = pairs.join(c, "center_id").groupBy("center_key").agg(F.countDistinct("study_id").alias("ensayos"))
    return g.join(n, "center_key", "left").select(F.col("center_key").alias("clave"), "filas", "localidades", F.coalesce("ensayos", F.lit(0)).cast("bigint").alias("ensayos"), "lista")


@query("""
WITH h AS (SELECT cod_postal, min(municipio) AS ciudad FROM hospitals WHERE regexp_full_match(cod_postal, '[0-9]{5}') GROUP BY 1),
n AS (SELECT center_id, count(DISTINCT study_id) AS ensayos FROM study_centers GROUP BY 1), s AS (SELECT center_id, h.ciudad, coalesce(ensayos, 0) AS ensayos FROM centers LEFT JOIN n USING (center_id) LEFT JOIN h USING (cod_postal))
SELECT CASE WHEN ciudad IS NULL THEN 'sin punto' ELSE 'con punto' END AS lugar, count(*) AS centros, CAST(sum(ensayos) AS BIGINT) AS ensayos FROM s GROUP BY 1""")
def place_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres joined to known points by postcode, with both losses: centres and studies that cannot be placed."""
    h = table(spark, sf_dir, "hospitals").filter(F.col("cod_postal").rlike("^[0-9]{5}$")).groupBy("cod_postal").agg(F.min("municipio").alias("ciudad"))
    n = table(spark, sf_dir, "study_centers").select("study_id", "center_id").distinct().groupBy("center_id").agg(F.count(F.lit(1)).alias("ensayos"))
    s = table(spark, sf_dir, "centers").select("center_id", "cod_postal").join(n, "center_id", "left").join(h, "cod_postal", "left")
    place = F.when(F.col("ciudad").isNull(), "sin punto").otherwise("con punto")
    return s.groupBy(place.alias("lugar")).agg(F.count(F.lit(1)).alias("centros"), F.coalesce(F.sum("ensayos"), F.lit(0)).cast("bigint").alias("ensayos"))


# Rows of the tables that do not grow.
EXPECTED_ROWS = {"region": 5, "nation": 25, "therapeutic_areas": 56, "eval_items": 500, "container_sizes": 4}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tabla, CAST({n} AS BIGINT) AS esperadas, count(*) AS filas, count(*) = {n} AS bien FROM {t}" for t, n in EXPECTED_ROWS.items()))
def row_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the fixed tables against what is expected of them."""
    return R.row_gate({t: table(spark, sf_dir, t) for t in EXPECTED_ROWS}, EXPECTED_ROWS)


@query("""
WITH c AS (SELECT provincia, count(*) AS n FROM centers WHERE provincia IS NOT NULL GROUP BY 1), k AS (SELECT *, trim(regexp_replace(lower(strip_accents(provincia)), '\\s+', ' ', 'g'), ' .,;:-''´`') AS norma FROM c)
SELECT norma, CAST(sum(n) AS BIGINT) AS n, string_agg(provincia, '; ' ORDER BY provincia) AS valores FROM k GROUP BY 1 HAVING count(*) > 1""")
def collapsing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a field that are one after folding, by total frequency."""
    c = table(spark, sf_dir, "centers").filter("provincia IS NOT NULL").groupBy("provincia").agg(F.count(F.lit(1)).alias("n"))
    g = c.withColumn("norma", X.fold(F.col("provincia"))).groupBy("norma").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("provincia")), "; ").alias("valores"), F.count(F.lit(1)).alias("k"))
    return g.filter("k > 1").select("norma", "n", "valores").orderBy(F.desc("n"), "norma")


@query()
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre names in one consistent case: distinct names are recased once and joined back."""
    names = table(spark, sf_dir, "centers").select("nombre").distinct().withColumn("visible", X.display_name(X.clean_text(F.col("nombre"))))
    return table(spark, sf_dir, "centers").select("center_id", "nombre").join(names, "nombre").select("center_id", "visible")
