"""Problem 6: missing places of centres filled from rows of the same site or town, and numeric series filled along time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.functions.udf import parse_places
from censo.operators.filling import consensus, fill_over_time
from censo.operators.sites import mend_towns, place_links, settle
from censo.session import cut, table

#: Longest time over which the place of a site (or of a town, prefix or province) is carried.
MAX_GAP_DAYS = 1826.0


def sited_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed centre rows with their ``site``; a row linked to no other is a site of its own."""
    parsed = cut(parse_places(table(spark, sf_dir, "centers").select("center_id", "nombre", "localidad", "cod_postal", "provincia", "ccaa", "actualizado_en"), "nombre", "localidad", "cod_postal", "provincia", "ccaa"))
    parsed = cut(mend_towns(parsed))
    sites = settle(parsed, cut(place_links(parsed, "center_id")), "center_id", "actualizado_en")
    return parsed.join(sites.hint("merge"), parsed["center_id"] == sites["node"], "left").withColumn("site", F.coalesce("site", "center_id")).drop("node")


def display(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): the spelling most rows use of each folded key; the smaller one on ties."""
    return consensus(rows.filter(F.col(key) != "").select(key, F.trim(text).alias(text)), key, text).select(key, text)


def targets(rows: DataFrame) -> DataFrame:
    """``rows`` with what may be carried to and within their site: t_prov, t_region and t_cp, and the sources ``de_prov``, ``de_cp`` beyond the site.

    A site's province is the one most of its rows, the prefixes of their codes and their town speak for; its region the one most rows of that
    province have. A code needs more than half of the site's rows with one, or, if there are none, all rows of the town with one: a row that
    lacks the code is not among them, so all are others.
    """
    pre = rows.withColumn("pre", F.substring("cp", 1, 2))
    by_pre = consensus(pre, "pre", "prov").select("pre", F.col("prov").alias("v"))
    by_town = consensus(rows, "ciudad", "prov").select("ciudad", F.col("prov").alias("v"))
    region_of = consensus(rows, "prov", "region").select("prov", F.col("region").alias("region_of"))
    site_votes = rows.filter("prov IS NOT NULL").groupBy("site", F.col("prov").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"), F.lit(None).cast("string").alias("de"))
    pre_votes = pre.join(F.broadcast(by_pre), "pre")  # a postcode has at most 52 prefixes
    pre_votes = pre_votes.groupBy("site", "v").agg((F.count(F.lit(1)) * 1.25).alias("w"), F.concat(F.lit("c:"), F.min("pre")).alias("de"))
    town_votes = rows.filter("ciudad IS NOT NULL").select("site", "ciudad").distinct().join(by_town.hint("merge"), "ciudad").groupBy("site", "v").agg(F.lit(1.1).alias("w"), F.concat(F.lit("t:"), F.min("ciudad")).alias("de"))
    votes = cut(site_votes.unionByName(pre_votes).unionByName(town_votes).groupBy("site", "v").agg(F.sum("w").alias("w"), F.max("de").alias("de")))
    settled = votes.groupBy("site").agg(F.max(F.struct("w", "v", "de")).alias("x")).select("site", F.col("x.v").alias("t_prov"), F.col("x.de").alias("de_prov"))
    settled = settled.join(region_of.select(F.col("prov").alias("t_prov"), "region_of"), "t_prov", "left")
    site_region = consensus(rows, "site", "region").select("site", F.col("region").alias("site_region"))
    site_code = consensus(rows, "site", "cp").select("site", F.col("cp").alias("code"), F.col("n").alias("n"), F.col("of").alias("of"))
    of_site = cut(settled.join(site_region, "site", "full").join(site_code, "site", "full"))
    town_code = rows.filter("ciudad IS NOT NULL AND cp IS NOT NULL").groupBy("ciudad").agg(F.min("cp").alias("lo"), F.max("cp").alias("hi"))
    out = rows.join(of_site.hint("merge"), "site", "left").join(town_code.hint("merge"), "ciudad", "left")
    code = F.when(F.col("of").isNotNull(), F.when(F.col("n") * 2 > F.col("of"), F.col("code"))).otherwise(F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    return out.select(*rows.columns, "t_prov", "de_prov", F.coalesce("region_of", "site_region").alias("t_region"), code.alias("t_cp"))


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing provincia, ccaa and cod_postal with what could be found: (center_id, campo, valor, metodo, distancia).

    Values are carried along time, from the nearest row (at most MAX_GAP_DAYS away) of the same site that says what the site's rows agree on;
    where the site has none, of the same town, postcode prefix or province. What is agreed on but further away in time has metodo 'acuerdo' and
    no distance.
    """
    empty_as_null = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = cut(sited_centres(spark, sf_dir).select(
        "center_id", "site", "actualizado_en", empty_as_null("p_ciudad").alias("ciudad"), F.coalesce("p_extranjero", F.lit(False)).alias("fuera"), "provincia", "ccaa", empty_as_null("p_provincia").alias("prov"), empty_as_null("p_ccaa").alias("region"), F.col("p_cp").alias("cp")
    ))
    whole = cut(targets(rows))
    fields = {"provincia": "prov", "ccaa": "region", "cod_postal": "cp"}
    # only rows that say what is agreed on are carried
    said = whole.select("center_id", "site", "actualizado_en", *(F.when(F.col(c) == F.col(f"t_{c}"), F.col(c)).alias(c) for c in fields.values()))
    filled = cut(fill_over_time(said, "site", "actualizado_en", "center_id", [], list(fields.values()), MAX_GAP_DAYS))
    missing = whole.filter("NOT fuera AND (prov IS NULL OR region IS NULL OR cp IS NULL)").select("center_id", "ciudad", "t_prov", "de_prov", "t_region", "t_cp", *(F.col(c).isNull().alias(f"sin_{c}") for c in fields.values()))
    beyond = {"prov": F.col("de_prov"), "region": F.concat(F.lit("p:"), "t_prov"), "cp": F.concat(F.lit("t:"), "ciudad")}
    one = lambda campo, c: F.when(F.col(f"sin_{c}") & F.col(f"t_{c}").isNotNull(), F.struct(F.lit(campo).alias("campo"), F.col(f"t_{c}").alias("meta"), F.col(c).alias("valor"), F.col(f"{c}_metodo").alias("metodo"), F.col(f"{c}_distancia").alias("distancia"), F.concat(F.lit(f"{campo}|"), beyond[c]).alias("de")))
    wanted = filled.drop("site").join(missing.hint("merge"), "center_id").select("center_id", "actualizado_en", F.explode(F.array_compact(F.array(*(one(k, c) for k, c in fields.items())))).alias("x")).select("center_id", "actualizado_en", "x.*")
    wanted = cut(wanted)
    in_site = wanted.filter("valor IS NOT NULL").select("center_id", "campo", "valor", "metodo", "distancia")
    open_ = wanted.filter("valor IS NULL")
    # what the site cannot give comes from rows of its town, prefix or province
    give = lambda campo, of, c: F.when(F.col(c).isNotNull() & of.isNotNull(), F.struct(F.concat(F.lit(f"{campo}|"), of).alias("de"), F.col(c).alias("v")))
    town, prefix = F.concat(F.lit("t:"), "ciudad"), F.concat(F.lit("c:"), F.substring("cp", 1, 2))
    given = whole.select("center_id", "actualizado_en", F.explode(F.array_compact(F.array(give("provincia", town, "prov"), give("provincia", prefix, "prov"), give("ccaa", F.concat(F.lit("p:"), "prov"), "region"), give("cod_postal", town, "cp")))).alias("x")).select("center_id", "actualizado_en", "x.*")
    asked = open_.filter("de IS NOT NULL").groupBy("de").agg(F.min("meta").alias("meta"), F.max("meta").alias("meta_hi"))
    given = given.join(asked.hint("merge"), "de").filter("v = meta OR v = meta_hi").select("center_id", "actualizado_en", "de", "v")
    given = cut(given)  # small plans: the driver keeps every plan and re-plans it at each stage
    both = open_.select("center_id", "actualizado_en", "de", F.lit(None).cast("string").alias("v"), "campo", "meta").unionByName(given.withColumn("campo", F.lit(None).cast("string")).withColumn("meta", F.lit(None).cast("string")))
    far = fill_over_time(both, "de", "actualizado_en", "center_id", [], ["v"], MAX_GAP_DAYS).filter("campo IS NOT NULL")
    agreed = F.coalesce(F.col("v") == F.col("meta"), F.lit(False))
    elsewhere = far.select("center_id", "campo", F.col("meta").alias("valor"), F.when(agreed, F.col("v_metodo")).otherwise(F.lit("acuerdo")).alias("metodo"), F.when(agreed, F.col("v_distancia")).alias("distancia"))
    found = cut(in_site.unionByName(elsewhere))
    names = display(rows, "prov", "provincia").select(F.lit("provincia").alias("campo"), F.col("prov").alias("valor"), F.col("provincia").alias("texto"))
    names = names.unionByName(display(rows, "region", "ccaa").select(F.lit("ccaa").alias("campo"), F.col("region").alias("valor"), F.col("ccaa").alias("texto")))
    named = found.filter("campo <> 'cod_postal'").join(names.hint("merge"), ["campo", "valor"]).select("center_id", "campo", F.col("texto").alias("valor"), "metodo", "distancia")
    return named.unionByName(found.filter("campo = 'cod_postal'").select("center_id", "campo", "valor", "metodo", "distancia"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing places that similar rows settle."""
    return p6_filled(spark, sf_dir).select("center_id", "campo", "valor")


def p6_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """studies.poblacion_total and enfermedad_rara filled along time within each sponsor, at most 400 days from an observed row.

    Of a study sent twice the newest row counts (then the larger values, so that the choice is one of the rows whatever their order).
    """
    s = table(spark, sf_dir, "studies").select("identificador", "sponsor_id", "poblacion_total", "enfermedad_rara", "cargado_en", "carga")
    newest = F.max(F.struct("cargado_en", "carga", "sponsor_id", "poblacion_total", "enfermedad_rara"))
    one = s.groupBy("identificador").agg(newest.alias("r")).select("identificador", "r.sponsor_id", "r.poblacion_total", "r.enfermedad_rara", "r.cargado_en")
    real = F.when(~F.col("poblacion_total").isin(0, 999999), F.col("poblacion_total"))
    filled = fill_over_time(one.withColumn("poblacion_total", real), "sponsor_id", "cargado_en", "identificador", ["poblacion_total"], ["enfermedad_rara"], 400.0)
    return filled.select(
        "identificador", "sponsor_id", "enfermedad_rara", "enfermedad_rara_metodo", F.round("enfermedad_rara_distancia", 4).alias("enfermedad_rara_distancia"),
        F.round("poblacion_total", 4).alias("poblacion_total"), "poblacion_total_metodo", F.round("poblacion_total_distancia", 4).alias("poblacion_total_distancia"),
    )


P6_SERIES_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY identificador ORDER BY cargado_en DESC NULLS LAST, carga DESC NULLS LAST, sponsor_id DESC NULLS LAST, poblacion_total DESC NULLS LAST, enfermedad_rara DESC NULLS LAST) AS r FROM studies),
o AS (SELECT identificador, sponsor_id, epoch_us(cargado_en) / 1e6 AS t, CASE WHEN poblacion_total NOT IN (0, 999999) THEN poblacion_total END AS p, enfermedad_rara AS e FROM r WHERE r = 1),
w AS (SELECT *,
  last_value(CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN {'v': p, 't': t} END IGNORE NULLS) OVER b AS pp, first_value(CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN {'v': p, 't': t} END IGNORE NULLS) OVER f AS pn,
  last_value(CASE WHEN e IS NOT NULL AND t IS NOT NULL THEN {'v': e, 't': t} END IGNORE NULLS) OVER b AS ep, first_value(CASE WHEN e IS NOT NULL AND t IS NOT NULL THEN {'v': e, 't': t} END IGNORE NULLS) OVER f AS en
  FROM o WINDOW b AS (PARTITION BY sponsor_id ORDER BY t NULLS LAST, identificador ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY sponsor_id ORDER BY t NULLS LAST, identificador ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, CASE WHEN sponsor_id IS NOT NULL AND (t - pp.t) / 86400 <= 400 THEN (t - pp.t) / 86400 END AS dpp, CASE WHEN sponsor_id IS NOT NULL AND (pn.t - t) / 86400 <= 400 THEN (pn.t - t) / 86400 END AS dpn,
  CASE WHEN sponsor_id IS NOT NULL AND (t - ep.t) / 86400 <= 400 THEN (t - ep.t) / 86400 END AS dep, CASE WHEN sponsor_id IS NOT NULL AND (en.t - t) / 86400 <= 400 THEN (en.t - t) / 86400 END AS den FROM w)
SELECT identificador, sponsor_id,
  CASE WHEN e IS NOT NULL THEN e WHEN dep IS NOT NULL AND (den IS NULL OR dep <= den) THEN ep.v WHEN den IS NOT NULL THEN en.v END AS enfermedad_rara,
  CASE WHEN e IS NOT NULL THEN 'observado' WHEN dep IS NOT NULL AND (den IS NULL OR dep <= den) THEN 'arrastre' WHEN den IS NOT NULL THEN 'retroceso' END AS enfermedad_rara_metodo,
  round(CASE WHEN e IS NOT NULL THEN 0.0 ELSE least(dep, den) END, 4) AS enfermedad_rara_distancia,
  round(CASE WHEN p IS NOT NULL THEN p WHEN dpp IS NOT NULL AND dpn IS NOT NULL THEN pp.v + (pn.v - pp.v) * coalesce((t - pp.t) / nullif(pn.t - pp.t, 0), 0.5) WHEN dpp IS NOT NULL THEN pp.v WHEN dpn IS NOT NULL THEN pn.v END, 4) AS poblacion_total,
  CASE WHEN p IS NOT NULL THEN 'observado' WHEN dpp IS NOT NULL AND dpn IS NOT NULL THEN 'interpolado' WHEN dpp IS NOT NULL OR dpn IS NOT NULL THEN 'extremo' END AS poblacion_total_metodo,
  round(CASE WHEN p IS NOT NULL THEN 0.0 ELSE least(dpp, dpn) END, 4) AS poblacion_total_distancia FROM k"""
