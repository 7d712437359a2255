"""The centre side of the normalised tables: entries of the raw records to sites, rows of the centre table to identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.functions import text as X
from censo.operators import relational as R
from censo.operators.components import connected_components
from censo.operators.repair import triangulate
from censo.operators.sites import star_links
from censo.plans import sqltext as Q
from censo.plans.registry import Registry
from censo.session import cut, table

query = Registry()

ENTRY = {"referencia": "referencia", "nombre": "nombre", "localidad": "localidad", "codPostal": "cod_postal", "provincia": "provincia", "ccaa": "ccaa"}
# Fixed value: a postcode filed for centres of three towns, which links nothing.
KEEP_APART = ("08908",)


def elements(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """(detalle_id, pos, x): the elements of a list of every valid record as variants; a single object is one element, an absent block none."""
    v = F.try_parse_json("registro")
    many = F.try_variant_get(v, path, "array<variant>")
    one = F.try_variant_get(v, path, "variant")
    items = F.coalesce(many, F.when(F.schema_of_variant(one).startswith("OBJECT"), F.array(one)))
    return table(spark, sf_dir, "detalle").select("detalle_id", F.posexplode(items).alias("pos", "x"))


def leaf(key: str) -> Column:
    return F.try_variant_get(F.col("x"), f"$.{key}", "string")


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir, "$.centros.centro").select("detalle_id", "pos", *(leaf(k).alias(c) for k, c in ENTRY.items()))


def read_entries(raw: DataFrame) -> DataFrame:
    """One row for every distinct raw entry (columns r_*) that names a site: its identity, cleaned fields, compared place and count ``n``.

    The identity is the reference, unless that is a stand-in, else the compared name; entries without either name no site and have no row.
    """
    fields = list(ENTRY.values())
    counted = raw.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("detalle_id", "pos")).alias("primero"))
    cleaned = cut(counted.select("n", "primero", *(F.col(c).alias(f"r_{c}") for c in fields), *(X.clean_text(F.col(c)).alias(c) for c in fields)))
    ref = F.when(~X.is_placeholder(F.col("referencia")), F.col("referencia"))
    named = cleaned.withColumn("referencia", ref).withColumn("identidad", F.coalesce("referencia", X.match_key(F.col("nombre"))))
    return cut(named.filter("identidad IS NOT NULL").withColumn("lugar", X.place_key(F.col("localidad"))).withColumn("pueblo", X.fold(F.col("localidad"))))


def sited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_entries`` with the postcode repaired from the corpus and ``base``, how: rows of one (identidad, lugar, codigo) are one site."""
    e = read_entries(raw_entries(spark, sf_dir)).withColumn("id", F.concat_ws("-", "primero.detalle_id", "primero.pos")).withColumn("centro", F.concat_ws("|", "identidad", "lugar"))
    fixed = triangulate(e, "id", "cod_postal", "centro", "pueblo", weight="n")
    return cut(e.join(fixed.hint("merge"), "id").withColumn("codigo", F.coalesce("codigo", F.lit(""))))


def is_inverted(name: Column) -> Column:
    return name.rlike(rf"(?iu)^(.+?)\s*[,(\[]\s*({X.ARTICLES})\s*['´’]?\s*[)\]]?$")


_SPEAKS = "v <> upper(v) OR v = lower(v)"
ENTRIES_SQL = f"""{Q.records()}, {Q.elements('$.centros.centro')},
w AS (SELECT detalle_id, pos, {', '.join(f"x ->> '$.{k}' AS r_{c}, {Q.clean(f"(x ->> '$.{k}')")} AS {c}" for k, c in ENTRY.items())} FROM x),
w2 AS (SELECT * REPLACE (CASE WHEN NOT {Q.placeholder('referencia')} THEN referencia END AS referencia) FROM w),
en AS (SELECT *, coalesce(referencia, {Q.match_key('nombre')}) AS identidad, {Q.place_key('localidad')} AS lugar, {Q.fold('localidad')} AS pueblo FROM w2 WHERE coalesce(referencia, {Q.match_key('nombre')}) IS NOT NULL),
whole AS (SELECT identidad, lugar, pueblo, cod_postal AS c FROM en WHERE regexp_full_match(cod_postal, '[0-9]{{5}}')), short AS (SELECT DISTINCT identidad, lugar, pueblo, cod_postal AS c FROM en WHERE regexp_full_match(cod_postal, '[0-9]{{4}}')),
dl AS (SELECT DISTINCT w, substr(w, 1, CAST(i AS INT) - 1) || substr(w, CAST(i AS INT) + 1) AS c FROM (SELECT DISTINCT c AS w FROM whole), range(1, 6) t(i)),
v1 AS (SELECT identidad, lugar, c AS w, count(*) AS n FROM whole GROUP BY ALL), k1 AS (SELECT s.identidad, s.lugar, s.c, v1.w, v1.n FROM (SELECT DISTINCT identidad, lugar, c FROM short) s JOIN dl USING (c) JOIN v1 ON v1.w = dl.w AND v1.identidad = s.identidad AND v1.lugar = s.lugar),
b1 AS (SELECT identidad, lugar, c, CASE WHEN count(*) FILTER (WHERE n = m) = 1 THEN min(w) FILTER (WHERE n = m) END AS w FROM (SELECT *, max(n) OVER (PARTITION BY identidad, lugar, c) AS m FROM k1) GROUP BY ALL),
v2 AS (SELECT pueblo, c AS w, count(*) AS n FROM whole GROUP BY ALL), k2 AS (SELECT s.pueblo, s.c, v2.w, v2.n FROM (SELECT DISTINCT pueblo, c FROM short) s JOIN dl USING (c) JOIN v2 ON v2.w = dl.w AND v2.pueblo = s.pueblo),
b2 AS (SELECT pueblo, c, CASE WHEN count(*) FILTER (WHERE n = m) = 1 THEN min(w) FILTER (WHERE n = m) END AS w FROM (SELECT *, max(n) OVER (PARTITION BY pueblo, c) AS m FROM k2) GROUP BY ALL),
pre AS (SELECT DISTINCT pueblo, substr(c, 1, 2) AS p FROM whole),
si AS (SELECT en.*, CASE WHEN b1.c IS NOT NULL THEN b1.w WHEN b2.c IS NOT NULL THEN b2.w WHEN pre.p IS NOT NULL THEN '0' || en.cod_postal END AS arreglo, CASE WHEN b1.c IS NOT NULL THEN 'centro' WHEN b2.c IS NOT NULL THEN 'localidad' WHEN pre.p IS NOT NULL THEN 'provincia' END AS base0
  FROM en LEFT JOIN b1 ON b1.identidad = en.identidad AND b1.lugar = en.lugar AND b1.c = en.cod_postal LEFT JOIN b2 ON b2.pueblo = en.pueblo AND b2.c = en.cod_postal
  LEFT JOIN pre ON pre.pueblo = en.pueblo AND regexp_full_match(en.cod_postal, '[0-9]{{4}}') AND pre.p = '0' || substr(en.cod_postal, 1, 1)),
st AS (SELECT * EXCLUDE (arreglo, base0), coalesce(arreglo, cod_postal, '') AS codigo, CASE WHEN arreglo IS NOT NULL THEN base0 END AS base FROM si)"""


def _mode_sql(name: str, column: str) -> str:
    return f"{name} AS (SELECT identidad, lugar, codigo, {column} FROM (SELECT identidad, lugar, codigo, {column}, row_number() OVER (PARTITION BY identidad, lugar, codigo ORDER BY count(*) DESC, {column}) AS r FROM st WHERE {column} IS NOT NULL GROUP BY identidad, lugar, codigo, {column}) WHERE r = 1)"


@query(f"""
WITH {ENTRIES_SQL}, {_mode_sql('mn', 'nombre')}, {_mode_sql('mp', 'provincia')}, {_mode_sql('mc', 'ccaa')},
ml AS (SELECT lugar, v FROM (SELECT lugar, v, row_number() OVER (PARTITION BY lugar ORDER BY ({_SPEAKS}) DESC, NOT regexp_matches(v, '(?i)^(.+?)\\s*[,(\\[]\\s*({X.ARTICLES})\\s*[''´’]?\\s*[)\\]]?$') DESC, count(*) DESC, v) AS r FROM (SELECT lugar, localidad AS v FROM st WHERE localidad IS NOT NULL) GROUP BY lugar, v) WHERE r = 1),
g AS (SELECT identidad, lugar, codigo, max(referencia) AS referencia, count(*) AS entradas, count(DISTINCT detalle_id) AS registros FROM st GROUP BY ALL)
SELECT g.identidad AS center_key, g.referencia, mn.nombre, coalesce(ml.v, '') AS localidad, g.codigo AS cod_postal, mp.provincia, mc.ccaa, g.entradas FROM g LEFT JOIN mn USING (identidad, lugar, codigo) LEFT JOIN mp USING (identidad, lugar, codigo) LEFT JOIN mc USING (identidad, lugar, codigo) LEFT JOIN ml ON ml.lugar = g.lugar""")
def gold_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a site: reference or name, place and repaired postcode are its key; each attribute is the most frequent of its entries.

    A town is spelled as most entries of its place do, quiet spellings before capitals and articles in front before articles at the end.
    """
    e = sited_entries(spark, sf_dir)
    key = ["identidad", "lugar", "codigo"]
    loud = (F.col("localidad") == F.upper("localidad")) & (F.col("localidad") != F.lower("localidad"))
    towns = R.mode_by(e, "lugar", "localidad", [~loud, ~is_inverted(F.col("localidad"))], weight="n")
    sites = e.groupBy(*key).agg(F.max("referencia").alias("referencia"), F.sum("n").alias("entradas"))
    for c in ("nombre", "provincia", "ccaa"):
        sites = sites.join(R.mode_by(e, key, c, weight="n").hint("merge"), key, "left")
    sites = sites.join(towns.hint("merge"), "lugar", "left")
    return sites.select(F.col("identidad").alias("center_key"), "referencia", "nombre", F.coalesce("localidad", F.lit("")).alias("localidad"), F.col("codigo").alias("cod_postal"), "provincia", "ccaa", "entradas")


@query(f"WITH {ENTRIES_SQL} SELECT DISTINCT detalle_id, identidad AS center_key, lugar, codigo AS cod_postal FROM st")
def gold_record_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge of records and sites: keys only, a site that a record names twice once."""
    e = sited_entries(spark, sf_dir)
    raw = raw_entries(spark, sf_dir)
    same = [raw[c].eqNullSafe(e[f"r_{c}"]) for c in ENTRY.values()]
    return raw.join(e.hint("merge"), same).select(raw["detalle_id"], e["identidad"].alias("center_key"), e["lugar"], e["codigo"].alias("cod_postal")).distinct()


@query(f"WITH {ENTRIES_SQL} SELECT coalesce(base, 'sin cambio') AS base, count(*) AS entradas, count(DISTINCT identidad || '|' || lugar || '|' || codigo) AS sitios FROM st GROUP BY 1")
def postcode_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries had their postcode settled by which evidence."""
    e = sited_entries(spark, sf_dir)
    return e.groupBy(F.coalesce("base", F.lit("sin cambio")).alias("base")).agg(F.sum("n").alias("entradas"), F.countDistinct("identidad", "lugar", "codigo").alias("sitios"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cp, pueblo): one town for every postcode of the catalogue."""
    h = table(spark, sf_dir, "hospitals").select(X.normalise_postcode(F.col("cod_postal")).alias("cp"), "municipio")
    return h.filter("cp IS NOT NULL").groupBy("cp").agg(F.min("municipio").alias("pueblo"))


def resolve_towns(rows: DataFrame, towns: DataFrame) -> DataFrame:
    """``rows`` (localidad, cp, center_key) with ``ciudad``: the reported town where it is readable, else that of the postcode, else the only town of the key's rows."""
    told = rows.join(towns.hint("merge"), "cp", "left")
    own = F.when(X.is_readable(F.coalesce("localidad", F.lit(""))), F.col("localidad")).otherwise(F.coalesce("pueblo", F.lit("")))
    told = told.withColumn("ciudad", X.normalise_town(own)).drop("pueblo")
    single = told.filter("ciudad <> ''").groupBy("center_key").agg(F.min("ciudad").alias("_lo"), F.max("ciudad").alias("_hi")).filter("_lo = _hi").select("center_key", "_lo")
    return told.join(single.hint("merge"), "center_key", "left").withColumn("ciudad", F.when(F.col("ciudad") != "", F.col("ciudad")).otherwise(F.coalesce("_lo", F.lit("")))).drop("_lo")


def identities(rows: DataFrame, towns: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(center_id, sitio): rows that are one site, named by its smallest center_id.

    ``rows``: (center_id, center_key, nombre, localidad, cod_postal, referencia). Two rows are linked that share a reference or a compared name
    and, beside it, a town or a postcode (but those of KEEP_APART); or a national code of ``codes`` (center_id, codcnh) alone. Blank parts
    link nothing. Links are stars, so no group is expanded into pairs.
    """
    ref = F.when(~X.is_placeholder(F.col("referencia")) & (F.trim("referencia") != ""), F.trim("referencia"))
    r = rows.select("center_id", "center_key", "localidad", X.normalise_postcode(F.coalesce("cod_postal", F.lit(""))).alias("cp"), ref.alias("ref"), X.match_key(F.col("nombre")).alias("nom"))
    r = cut(resolve_towns(r, towns))
    place = {"t": F.nullif("ciudad", F.lit("")), "c": F.when(~F.col("cp").isin(*KEEP_APART), F.col("cp"))}
    keys = [F.when(F.col(i).isNotNull() & p.isNotNull(), F.concat_ws("|", F.lit(i + k), F.col(i), p)) for i in ("ref", "nom") for k, p in place.items()]
    keyed = r.select("center_id", F.explode(F.array_compact(F.array(*keys))).alias("k"))
    if codes is not None:
        keyed = keyed.unionByName(codes.filter("codcnh IS NOT NULL").select("center_id", F.concat(F.lit("h|"), "codcnh").alias("k")))
    comp = connected_components(star_links(keyed, "k", "center_id"), "a", "b")
    return r.select("center_id").join(comp.hint("merge"), F.col("center_id") == F.col("node"), "left").select("center_id", F.coalesce("component", "center_id").alias("sitio"))


def _town(c: str) -> str:
    head = f"trim(split_part(split_part(split_part(coalesce({c}, ''), ',', 1), '/', 1), '(', 1))"
    return f"trim(regexp_replace({Q.fold(head)}, '^(?:(?:a|o|la|el|lo|las|los|les|els)(?:\\s+|$)|l'')', ''))"


def _code(c: str) -> str:
    bare = f"replace(replace(trim({c}), '.', ''), ',', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9]{{4,5}}') THEN lpad({bare}, 5, '0') END"


IDENTITIES_SQL = f"""gz AS (SELECT {_code('cod_postal')} AS cp, min(municipio) AS pueblo FROM hospitals GROUP BY 1),
r0 AS (SELECT center_id, center_key, localidad, {_code('cod_postal')} AS cp, CASE WHEN NOT {Q.placeholder('referencia')} AND trim(referencia) <> '' THEN trim(referencia) END AS ref, {Q.match_key('nombre')} AS nom FROM centers),
r1 AS (SELECT r0.*, {_town("CASE WHEN trim(coalesce(localidad, '')) <> '' AND NOT regexp_matches(localidad, '[?�]') THEN localidad ELSE coalesce(gz.pueblo, '') END")} AS ciudad0 FROM r0 LEFT JOIN gz USING (cp)),
sg AS (SELECT center_key, min(ciudad0) AS lo FROM r1 WHERE ciudad0 <> '' GROUP BY 1 HAVING min(ciudad0) = max(ciudad0)),
r2 AS (SELECT r1.*, coalesce(nullif(ciudad0, ''), lo) AS ciudad, CASE WHEN cp NOT IN ({', '.join(f"'{c}'" for c in KEEP_APART)}) THEN cp END AS cpk FROM r1 LEFT JOIN sg USING (center_key)),
ks AS (SELECT center_id, 'rt' || ref || '|' || ciudad AS k FROM r2 UNION ALL SELECT center_id, 'rc' || ref || '|' || cpk FROM r2 UNION ALL SELECT center_id, 'nt' || nom || '|' || ciudad FROM r2 UNION ALL SELECT center_id, 'nc' || nom || '|' || cpk FROM r2),
kk AS (SELECT center_id, min(center_id) OVER (PARTITION BY k) AS m FROM ks WHERE k IS NOT NULL),
ed AS (SELECT DISTINCT center_id AS x, m AS y FROM kk UNION SELECT DISTINCT m, center_id FROM kk),
cl(x, y) AS (SELECT center_id, center_id FROM centers UNION SELECT cl.x, ed.y FROM cl JOIN ed ON ed.x = cl.y),
id AS (SELECT x AS center_id, min(y) AS sitio FROM cl GROUP BY 1)"""


def centre_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(identities(table(spark, sf_dir, "centers").select("center_id", "center_key", "nombre", "localidad", "cod_postal", "referencia"), gazetteer(spark, sf_dir)))


@query(f"WITH RECURSIVE {IDENTITIES_SQL} SELECT center_id, sitio FROM id")
def site_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every centre row with the site it belongs to."""
    return centre_identities(spark, sf_dir)


@query(f"""
WITH RECURSIVE {IDENTITIES_SQL}, p AS (SELECT DISTINCT study_id, center_id FROM study_centers),
n AS (SELECT center_id, count(*) AS n FROM p GROUP BY 1), d AS (SELECT sitio, count(DISTINCT study_id) AS ensayos FROM p JOIN id USING (center_id) GROUP BY 1),
m AS (SELECT sitio, count(*) AS filas, string_agg(CAST(center_id AS VARCHAR), ',' ORDER BY center_id) AS miembros FROM id GROUP BY 1),
b AS (SELECT sitio, center_id, row_number() OVER (PARTITION BY sitio ORDER BY n DESC, center_id) AS r FROM id JOIN n USING (center_id))
SELECT d.sitio, filas, miembros, ensayos, c.nombre AS principal, c.localidad, c.provincia, c.cod_postal FROM d JOIN m USING (sitio) JOIN b ON b.sitio = d.sitio AND b.r = 1 JOIN centers c ON c.center_id = b.center_id""")
def site_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sites with distinct studies, their members, and name and place of the busiest member (smaller id on ties)."""
    who = centre_identities(spark, sf_dir)
    pairs = cut(table(spark, sf_dir, "study_centers").select("study_id", "center_id").distinct())
    studies = pairs.join(who.hint("merge"), "center_id").groupBy("sitio").agg(F.countDistinct("study_id").alias("ensayos"))
    busy = pairs.groupBy("center_id").agg(F.count(F.lit(1)).alias("n")).join(who.hint("merge"), "center_id").groupBy("sitio").agg(F.max_by("center_id", F.struct("n", (-F.col("center_id")).alias("k"))).alias("center_id"))
    members = who.groupBy("sitio").agg(F.count(F.lit(1)).alias("filas"), F.array_join(F.transform(F.array_sort(F.collect_list("center_id")), lambda i: i.cast("string")), ",").alias("miembros"))
    names = table(spark, sf_dir, "centers").select("center_id", F.col("nombre").alias("principal"), "localidad", "provincia", "cod_postal")
    return studies.join(members.hint("merge"), "sitio").join(busy.hint("merge"), "sitio").join(names.hint("merge"), "center_id").select("sitio", "filas", "miembros", "ensayos", "principal", "localidad", "provincia", "cod_postal")
