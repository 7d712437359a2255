"""Landscape analyses: volume, coverage, memberships, flag mixes, classes, families, participation.

On the driver's tables orders stand for studies, distinct (order, brand) for memberships in areas, lineitem flags for phases, customers for
sponsors, nations and regions for provinces and regions; registry tables are used where they hold the fact itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censo.functions import vocabularies as V
from censo.operators import relational as R
from censo.plans import sqltext as Q
from censo.plans.registry import Registry
from censo.session import table

query = Registry()
FLOOR = 1996


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, count(*) AS ensayos FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def volume_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_per_year(table(spark, sf_dir, "orders"), "o_orderdate", FLOOR, n="ensayos")


@query("SELECT CAST(substr(fecha_autorizacion_aemps, 1, 4) AS BIGINT) AS anio, count(DISTINCT identificador) AS ensayos FROM studies WHERE regexp_full_match(fecha_autorizacion_aemps, '(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}') AND fecha_autorizacion_aemps >= '2013-01-01' GROUP BY 1")
def study_volume_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry studies by authorisation year; the text comparison reaches the scan, ill-formed dates are left out."""
    f = F.col("fecha_autorizacion_aemps")
    s = table(spark, sf_dir, "studies").filter((f >= "2013-01-01") & f.rlike("^(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$"))
    return s.groupBy(F.substring(f, 1, 4).cast("bigint").alias("anio")).agg(F.countDistinct("identificador").alias("ensayos"))


@query("SELECT max(CAST(o_orderdate AS DATE)) AS corte, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS excluidos, count(*) AS total FROM orders")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return o.agg(F.max(F.col("o_orderdate").cast("date")).alias("corte"), F.count_if(old).alias("excluidos"), F.count(F.lit(1)).alias("total"))


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
l AS (SELECT l_suppkey, p_brand FROM lineitem JOIN s ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT (SELECT count(*) FROM s) AS ensayos, (SELECT count(DISTINCT o_custkey) FROM s) AS promotores,
(SELECT count(DISTINCT l_suppkey) FROM l) AS centros, (SELECT count(DISTINCT p_brand) FROM l) AS areas, (SELECT max(CAST(o_orderdate AS DATE)) FROM s) AS corte""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.since(table(spark, sf_dir, "orders"), "o_orderdate", FLOOR)
    top = s.agg(F.count(F.lit(1)).alias("ensayos"), F.countDistinct("o_custkey").alias("promotores"), F.max(F.col("o_orderdate").cast("date")).alias("corte"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(s.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # distinct ids before the second join: parts are few beside lines
    parts = lines.select("l_partkey").distinct().join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    centres, areas = lines.agg(F.countDistinct("l_suppkey").alias("centros")), parts.agg(F.countDistinct("p_brand").alias("areas"))
    return top.join(F.broadcast(centres)).join(F.broadcast(areas)).select("ensayos", "promotores", "centros", "areas", "corte")


def memberships(spark: SparkSession, sf_dir: str, first_year: int = FLOOR, last_year: int | None = None) -> DataFrame:
    """(o_orderkey, o_orderdate, p_brand): distinct memberships in the window."""
    s = R.since(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", first_year, last_year)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderdate", "p_brand").distinct()


MEMBERS = "m AS (SELECT DISTINCT o_orderkey, o_orderdate, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01')"


@query(f"WITH {MEMBERS} SELECT p_brand, count(*) AS n FROM m GROUP BY 1")
def memberships_per_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(spark, sf_dir).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {MEMBERS}, c AS (SELECT p_brand, count(*) AS n FROM m GROUP BY 1),
r AS (SELECT *, p_brand IN ('Brand#11', 'Brand#22') AS gone, row_number() OVER (PARTITION BY p_brand IN ('Brand#11', 'Brand#22') ORDER BY n DESC, p_brand) AS r FROM c),
b AS (SELECT CASE WHEN gone THEN 13 WHEN r > 12 THEN 14 ELSE r END AS pos, min(p_brand) AS lab, sum(n) AS n, count(*) AS k FROM r GROUP BY 1)
SELECT CAST(pos AS BIGINT) AS pos, CASE WHEN pos <= 12 THEN lab WHEN pos = 13 THEN 'Sin especificar' ELSE 'Otras (' || k || ' áreas)' END AS area, CAST(n AS BIGINT) AS n, pos <= 12 AS sustantivo FROM b""")
def ranked_areas_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold_tail(memberships_per_area(spark, sf_dir).withColumnRenamed("p_brand", "area"), "area", "n", 12, ["Brand#11", "Brand#22"], "Sin especificar", "Otras (%d áreas)")


@query(f"WITH {MEMBERS} SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, p_brand, count(*) AS n FROM m GROUP BY 1, 2")
def area_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(spark, sf_dir).groupBy(R.year_of("o_orderdate").alias("anio"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {MEMBERS}, c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, p_brand, count(*) AS n FROM m GROUP BY 1, 2),
t AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, count(*) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1),
g AS (SELECT anio, p_brand FROM (SELECT DISTINCT anio FROM c) CROSS JOIN (SELECT p_brand FROM c GROUP BY 1 ORDER BY sum(n) DESC, p_brand LIMIT 5))
SELECT g.anio, g.p_brand, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / total, 4) AS cuota FROM g LEFT JOIN c USING (anio, p_brand) JOIN t ON t.anio = g.anio""")
def area_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly shares of the five largest areas, absent years 0 %; the denominator is the year's studies."""
    c = area_year_counts(spark, sf_dir)
    top = c.groupBy("p_brand").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "p_brand").limit(5)
    dense = R.densify(c.join(F.broadcast(top.select("p_brand")), "p_brand"), "anio", "p_brand", ["n"])
    return dense.join(volume_per_year(spark, sf_dir), "anio").select("anio", "p_brand", "n", R.share(F.col("n"), F.col("ensayos")).alias("cuota"))


@query(f"WITH {MEMBERS}, c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, p_brand, count(*) AS n FROM m GROUP BY 1, 2) SELECT anio, p_brand, round(n * 100.0 / sum(n) OVER (PARTITION BY anio), 4) AS cuota FROM c")
def yearly_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio to the year's total of memberships."""
    c = area_year_counts(spark, sf_dir)
    return c.select("anio", "p_brand", R.share(F.col("n"), F.sum("n").over(W.partitionBy("anio"))).alias("cuota"))


PHASES = {"fase_uno": "I", "fase_dos": "II", "fase_tres": "III", "fase_cuatro": "IV"}
DESIGNS = ["I", "I/II", "II", "II/III", "III", "III/IV", "IV"]


def flagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with flags from their lines, as studies have phases."""
    lines = table(spark, sf_dir, "lineitem")
    bit = lambda c: F.max(F.when(c, 1).otherwise(0))
    flags = lines.groupBy("l_orderkey").agg(bit(F.col("l_returnflag") == "A").alias("fase_uno"), bit(F.col("l_returnflag") == "N").alias("fase_dos"), bit(F.col("l_returnflag") == "R").alias("fase_tres"), bit(F.col("l_quantity") >= 50).alias("fase_cuatro"))
    s = R.since(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey"), "o_orderdate", FLOOR)
    return s.join(flags, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


FLAGGED = """f AS (SELECT o_orderkey, o_orderdate, o_orderpriority, o_custkey, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS f1, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS f2,
max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f3, max(CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END) AS f4 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2, 3, 4),
lab AS (SELECT *, concat_ws('/', CASE WHEN f1 = 1 THEN 'I' END, CASE WHEN f2 = 1 THEN 'II' END, CASE WHEN f3 = 1 THEN 'III' END, CASE WHEN f4 = 1 THEN 'IV' END) AS fase FROM f)"""
LADDER = "d AS (SELECT * FROM (VALUES (1, 'I'), (2, 'I/II'), (3, 'II'), (4, 'II/III'), (5, 'III'), (6, 'III/IV'), (7, 'IV')) t(pos, fase))"


@query(f"""
WITH {FLAGGED}, c AS (SELECT fase, count(*) AS n FROM lab GROUP BY 1), {LADDER}
SELECT CAST(pos AS BIGINT) AS pos, d.fase, CAST(coalesce(n, 0) AS BIGINT) AS n FROM d LEFT JOIN c USING (fase)
UNION ALL SELECT 8, 'Otras combinaciones', CAST(sum(n) AS BIGINT) FROM c WHERE fase NOT IN (SELECT fase FROM d) HAVING sum(n) IS NOT NULL""")
def phase_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = flagged_orders(spark, sf_dir).groupBy(R.flag_label(PHASES).alias("fase")).agg(F.count(F.lit(1)).alias("n"))
    return R.ladder(c, "fase", "n", DESIGNS, "Otras combinaciones")


@query(f"""
WITH u AS (SELECT identificador, max(concat_ws('/', CASE WHEN fase_uno = 1 THEN 'I' END, CASE WHEN fase_dos = 1 THEN 'II' END, CASE WHEN fase_tres = 1 THEN 'III' END, CASE WHEN fase_cuatro = 1 THEN 'IV' END)) AS fase FROM studies GROUP BY 1),
c AS (SELECT fase, count(*) AS n FROM u GROUP BY 1), {LADDER}
SELECT CAST(pos AS BIGINT) AS pos, d.fase, CAST(coalesce(n, 0) AS BIGINT) AS n FROM d LEFT JOIN c USING (fase)
UNION ALL SELECT 8, 'Otras combinaciones', CAST(sum(n) AS BIGINT) FROM c WHERE fase NOT IN (SELECT fase FROM d) HAVING sum(n) IS NOT NULL""")
def study_phase_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "studies").groupBy("identificador").agg(F.max(R.flag_label(PHASES)).alias("fase"))
    return R.ladder(one.groupBy("fase").agg(F.count(F.lit(1)).alias("n")), "fase", "n", DESIGNS, "Otras combinaciones")


@query(f"""
WITH {FLAGGED}, u AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS anio, f1, o_orderpriority = '1-URGENT' AS g FROM f)
SELECT anio, count(*) AS n, round(sum(f1) * 100.0 / count(*), 4) AS todos, round(sum(f1) FILTER (WHERE g) * 100.0 / nullif(count(*) FILTER (WHERE g), 0), 4) AS grupo,
round(sum(f1) FILTER (WHERE NOT g) * 100.0 / nullif(count(*) FILTER (WHERE NOT g), 0), 4) AS resto FROM u GROUP BY 1""")
def phase_share_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled and per-group shares of a flag; an empty group has a null share, not 0."""
    f = flagged_orders(spark, sf_dir).withColumn("g", F.col("o_orderpriority") == "1-URGENT").groupBy(R.year_of("o_orderdate").alias("anio")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("fase_uno").alias("s"), F.sum(F.when(F.col("g"), F.col("fase_uno"))).alias("sg"), F.count_if("g").alias("ng"), F.sum(F.when(~F.col("g"), F.col("fase_uno"))).alias("sr"), F.count_if(~F.col("g")).alias("nr")
    )
    return f.select("anio", "n", R.share(F.col("s"), F.col("n")).alias("todos"), R.share(F.col("sg"), F.col("ng")).alias("grupo"), R.share(F.col("sr"), F.col("nr")).alias("resto"))


@query(f"""
WITH {FLAGGED}, m AS (SELECT DISTINCT o_orderkey, p_brand FROM f JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT p_brand AS area, count(*) AS n, round(sum(f1) * 100.0 / count(*), 4) AS i, round(sum(f2) * 100.0 / count(*), 4) AS ii, round(sum(f3) * 100.0 / count(*), 4) AS iii, round(sum(f4) * 100.0 / count(*), 4) AS iv FROM m JOIN f USING (o_orderkey) GROUP BY 1
UNION ALL SELECT 'Todos', count(*), round(sum(f1) * 100.0 / count(*), 4), round(sum(f2) * 100.0 / count(*), 4), round(sum(f3) * 100.0 / count(*), 4), round(sum(f4) * 100.0 / count(*), 4) FROM f""")
def phase_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of four flags by area in one pass, and a baseline row in which every study counts once."""
    f = flagged_orders(spark, sf_dir)
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("area")).distinct()
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in PHASES)]
    both = f.join(m, "o_orderkey").groupBy("area").agg(*sums).unionByName(f.agg(*sums).withColumn("area", F.lit("Todos")))
    return both.select("area", "n", *(R.share(F.col(c), F.col("n")).alias(x.lower()) for c, x in PHASES.items()))


def _any(markers: tuple[str, ...]) -> str:
    return "(?iu)" + "|".join(f"(?:{m})" for m in markers)


def is_individual(name: Column) -> Column:
    """A personal title opens the name and nothing in it speaks for a company."""
    return name.rlike("(?iu)" + V.PERSONAL_TITLE) & ~name.rlike(_any(V.INDUSTRY_MARKERS))


def family_of(name: Column) -> Column:
    """The first family whose pattern is found; a person is an unnamed individual, any other name its own family."""
    return F.when(is_individual(name), F.lit(V.INDIVIDUAL)).otherwise(R.first_rule(name, [(f"(?iu){p}", f) for p, f in V.FAMILIES], name))


def classify(name: Column) -> Column:
    """Individuals are academic; else what only one set of markers speaks for; else a company's family; else unclassified. Null is null."""
    industry, academic = name.rlike(_any(V.INDUSTRY_MARKERS)), name.rlike(_any(V.ACADEMIC_MARKERS))
    by_marker = F.when(industry & ~academic, V.INDUSTRY).when(academic & ~industry, V.ACADEMIC)
    family = F.when(family_of(name).isin(*sorted({f for _, f in V.FAMILIES})), V.INDUSTRY).otherwise(V.UNCLASSIFIED)
    return F.when(name.isNotNull(), F.when(is_individual(name), F.lit(V.ACADEMIC)).otherwise(F.coalesce(by_marker, family)))


def sponsor_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sponsor_id, clase, familia, visible): each sponsor classified once; persons are shown without their name."""
    n = F.col("promotor")
    return table(spark, sf_dir, "sponsors").select("sponsor_id", classify(n).alias("clase"), family_of(n).alias("familia"), F.when(is_individual(n), F.lit(V.INDIVIDUAL)).otherwise(n).alias("visible"))


def study_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(identificador, anio, clase, familia, promotor, fase_cuatro) of every study with a sound date."""
    f = F.col("fecha_autorizacion_aemps")
    s = table(spark, sf_dir, "studies").filter(f.rlike("^(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$")).groupBy("identificador").agg(F.min("sponsor_id").alias("sponsor_id"), F.min(f).alias("f"), F.max("fase_cuatro").alias("fase_cuatro"))
    return s.join(sponsor_classes(spark, sf_dir), "sponsor_id").select("identificador", F.substring("f", 1, 4).cast("bigint").alias("anio"), "clase", "familia", "visible", "fase_cuatro")


def _re(pattern: str) -> str:
    # DuckDB's word boundaries know ASCII letters only
    return f"regexp_matches(strip_accents(promotor), {Q.quote(pattern.replace('í', 'i').replace('ñ', 'n'))}, 'i')"


_PERSON = f"({_re(V.PERSONAL_TITLE)} AND NOT {_re('|'.join(V.INDUSTRY_MARKERS))})"
_FAMILY = "CASE " + f"WHEN {_PERSON} THEN {Q.quote(V.INDIVIDUAL)} " + " ".join(f"WHEN {_re(p)} THEN {Q.quote(f)}" for p, f in V.FAMILIES) + " ELSE promotor END"
CLASSES = f"""k0 AS (SELECT sponsor_id, promotor, {_re('|'.join(V.INDUSTRY_MARKERS))} AS ind, {_re('|'.join(V.ACADEMIC_MARKERS))} AS aca, {_PERSON} AS per, {_FAMILY} AS familia FROM sponsors),
k AS (SELECT sponsor_id, CASE WHEN promotor IS NULL THEN NULL WHEN per THEN '{V.ACADEMIC}' WHEN ind AND NOT aca THEN '{V.INDUSTRY}' WHEN aca AND NOT ind THEN '{V.ACADEMIC}' WHEN familia IN ({', '.join(sorted({Q.quote(f) for _, f in V.FAMILIES}))}) THEN '{V.INDUSTRY}' ELSE '{V.UNCLASSIFIED}' END AS clase, familia, CASE WHEN per THEN '{V.INDIVIDUAL}' ELSE promotor END AS visible FROM k0),
s AS (SELECT identificador, min(sponsor_id) AS sponsor_id, min(fecha_autorizacion_aemps) AS f, max(fase_cuatro) AS fase_cuatro FROM studies WHERE regexp_full_match(fecha_autorizacion_aemps, '(19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') GROUP BY 1),
q AS (SELECT identificador, CAST(substr(f, 1, 4) AS BIGINT) AS anio, clase, familia, visible, fase_cuatro FROM s JOIN k USING (sponsor_id))"""


@query(f"WITH {CLASSES} SELECT sponsor_id, clase, familia, visible FROM k")
def sponsor_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, family and shown name of every sponsor."""
    return sponsor_classes(spark, sf_dir)


@query(f"WITH {CLASSES} SELECT clase, count(*) AS n FROM q GROUP BY 1")
def classify_sponsors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_classes(spark, sf_dir).groupBy("clase").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLASSES} SELECT anio, round(count(*) FILTER (WHERE clase = '{V.INDUSTRY}') * 100.0 / count(*), 4) AS industria, round(count(*) FILTER (WHERE clase = '{V.ACADEMIC}') * 100.0 / count(*), 4) AS academia,
round(count(*) FILTER (WHERE clase = '{V.UNCLASSIFIED}') * 100.0 / count(*), 4) AS sin_clasificar FROM q WHERE clase IS NOT NULL GROUP BY 1""")
def class_share_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shares per year; an absent class is 0."""
    p = study_classes(spark, sf_dir).filter("clase IS NOT NULL").groupBy("anio").pivot("clase", [V.INDUSTRY, V.ACADEMIC, V.UNCLASSIFIED]).count().na.fill(0)
    total = F.col(V.INDUSTRY) + F.col(V.ACADEMIC) + F.col(V.UNCLASSIFIED)
    return p.select("anio", R.share(F.col(V.INDUSTRY), total).alias("industria"), R.share(F.col(V.ACADEMIC), total).alias("academia"), R.share(F.col(V.UNCLASSIFIED), total).alias("sin_clasificar"))


@query(f"WITH {CLASSES} SELECT anio, clase, count(*) AS ensayos, CAST(coalesce(sum(fase_cuatro), 0) AS BIGINT) AS fase_cuatro FROM q GROUP BY 1, 2")
def class_flag_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_classes(spark, sf_dir).groupBy("anio", "clase").agg(F.count(F.lit(1)).alias("ensayos"), F.coalesce(F.sum("fase_cuatro"), F.lit(0)).cast("bigint").alias("fase_cuatro"))


@query(f"WITH {CLASSES}, n AS (SELECT visible, familia, count(*) AS n FROM q GROUP BY 1, 2) SELECT familia, CAST(sum(n) AS BIGINT) AS n, count(*) AS grafias FROM n GROUP BY 1 ORDER BY n DESC, familia LIMIT 15")
def top_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies per spelling, then per family with the number of spellings; ties by name."""
    names = study_classes(spark, sf_dir).groupBy("visible", "familia").agg(F.count(F.lit(1)).alias("n"))
    return names.groupBy("familia").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("grafias")).orderBy(F.desc("n"), "familia").limit(15)


@query(f"WITH {CLASSES}, n AS (SELECT promotor, clase, familia, count(*) AS n FROM k JOIN s USING (sponsor_id) JOIN (SELECT sponsor_id, promotor FROM sponsors) USING (sponsor_id) WHERE familia <> '{V.INDIVIDUAL}' GROUP BY 1, 2, 3) SELECT familia, min(clase) AS clase, CAST(sum(n) AS BIGINT) AS n, string_agg(promotor || '=' || n, '; ' ORDER BY n DESC, promotor) AS grafias, count(*) > 1 AS varias FROM n GROUP BY 1")
def family_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with the sorted list of their spellings (bounded by the spellings of a family), and whether there are several; persons are left out."""
    names = table(spark, sf_dir, "sponsors").select("sponsor_id", "promotor").join(sponsor_classes(spark, sf_dir), "sponsor_id").filter(F.col("familia") != V.INDIVIDUAL)
    f = F.col("fecha_autorizacion_aemps")
    s = table(spark, sf_dir, "studies").filter(f.rlike("^(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$")).groupBy("identificador").agg(F.min("sponsor_id").alias("sponsor_id"))
    fam = s.join(names, "sponsor_id").groupBy("promotor", "clase", "familia").agg(F.count(F.lit(1)).alias("n"))
    lists = fam.groupBy("familia").agg(F.min("clase").alias("clase"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "promotor"))).alias("x"))
    return lists.select("familia", "clase", "n", F.array_join(F.transform("x", lambda e: F.concat(e["promotor"], F.lit("="), (-e["m"]).cast("string"))), "; ").alias("grafias"), (F.size("x") > 1).alias("varias"))


def placed(spark: SparkSession, sf_dir: str, first_year: int = FLOOR, last_year: int | None = None) -> DataFrame:
    """(estudio, n_name, r_name, l_suppkey): distinct (study, centre) pairs with their places."""
    s = R.since(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", first_year, last_year)
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("estudio"), "l_suppkey").distinct()
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return pairs.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("estudio", "l_suppkey", "n_name", "r_name")


PLACED = "p AS (SELECT DISTINCT l_orderkey AS estudio, l_suppkey, n_name, r_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'), t AS (SELECT count(*) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')"


def participation(pairs: DataFrame, place: str, trials: DataFrame) -> DataFrame:
    """(lugar, ensayos, cuota): distinct studies per place, in % of all studies of the window (shares overlap)."""
    total = trials.agg(F.count(F.lit(1)).alias("total"))  # one row
    counts = pairs.filter(F.col(place).isNotNull()).groupBy(F.col(place).alias("lugar")).agg(F.countDistinct("estudio").alias("ensayos"))
    return counts.join(F.broadcast(total)).select("lugar", "ensayos", R.share(F.col("ensayos"), F.col("total")).alias("cuota"))


@query(f"WITH {PLACED} SELECT r_name AS lugar, count(DISTINCT estudio) AS ensayos, round(count(DISTINCT estudio) * 100.0 / any_value(total), 4) AS cuota FROM p, t GROUP BY 1")
def participation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participation(placed(spark, sf_dir), "r_name", R.since(table(spark, sf_dir, "orders"), "o_orderdate", FLOOR))


@query(f"WITH {PLACED} SELECT n_name AS lugar, count(DISTINCT estudio) AS ensayos, round(count(DISTINCT estudio) * 100.0 / any_value(total), 4) AS cuota FROM p, t GROUP BY 1")
def participation_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participation(placed(spark, sf_dir), "n_name", R.since(table(spark, sf_dir, "orders"), "o_orderdate", FLOOR))


@query("SELECT count(*) AS sin_lugar FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)")
def unlocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of the window without any placed centre."""
    s = R.since(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", FLOOR)
    with_place = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return s.join(with_place, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("sin_lugar"))


@query(f"""
WITH {PLACED}, fix AS (SELECT * FROM (VALUES (1, 'NATION_3'), (2, 'NATION_7'), (5, NULL)) v(l_suppkey, nuevo))
SELECT CASE WHEN fix.l_suppkey IS NULL THEN n_name ELSE nuevo END AS lugar, count(DISTINCT estudio) AS ensayos, round(count(DISTINCT estudio) * 100.0 / any_value(total), 4) AS cuota
FROM p LEFT JOIN fix USING (l_suppkey), t WHERE CASE WHEN fix.l_suppkey IS NULL THEN n_name ELSE nuevo END IS NOT NULL GROUP BY 1""")
def corrected_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-checked corrections replace a centre's place before anything is counted; a correction to null drops the pair."""
    fixes = spark.createDataFrame([(1, "NATION_3"), (2, "NATION_7"), (5, None)], "l_suppkey bigint, n_name string")
    fixed = R.override(placed(spark, sf_dir), fixes, ["l_suppkey"], ["n_name"])
    return participation(fixed, "n_name", R.since(table(spark, sf_dir, "orders"), "o_orderdate", FLOOR))


@query("SELECT o_orderpriority AS prioridad, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1")
def window_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open window of whole years on the bare column."""
    return R.since(table(spark, sf_dir, "orders"), "o_orderdate", 1997, 1998).groupBy(F.col("o_orderpriority").alias("prioridad")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PLACED}, a AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13') SELECT l_suppkey AS centro, count(DISTINCT estudio) AS ensayos FROM p JOIN a ON l_orderkey = estudio WHERE n_name IN ('NATION_3', 'NATION_7') GROUP BY 1")
def area_filtered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of some places with their studies of one area: the area's filter is a semi-join."""
    area = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").filter("p_brand = 'Brand#13'").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("estudio"))
    return placed(spark, sf_dir).filter(F.col("n_name").isin("NATION_3", "NATION_7")).join(area, "estudio", "left_semi").groupBy(F.col("l_suppkey").alias("centro")).agg(F.countDistinct("estudio").alias("ensayos"))


@query("SELECT DISTINCT o_orderkey AS estudio, CAST(year(o_orderdate) AS BIGINT) AS anio, CAST(o_orderdate AS DATE) AS fecha FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey IN (1, 3) AND o_orderdate >= TIMESTAMP '1996-01-01'")
def studies_at_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies at a site's member centres, newest first, ids as ties."""
    at = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey").isin(1, 3)).select("l_orderkey")
    s = R.since(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", FLOOR).join(at, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return s.select(F.col("o_orderkey").alias("estudio"), R.year_of("o_orderdate").alias("anio"), F.col("o_orderdate").cast("date").alias("fecha")).orderBy(F.desc("fecha"), "estudio")


@query("SELECT n_name AS pais, count(DISTINCT o_orderkey) AS ensayos FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-25' GROUP BY 1")
def zero_trial_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date is a condition of the join, so places without studies stay with 0."""
    n, c, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    late = o.filter(F.col("o_orderdate") >= F.lit("2001-06-25").cast("timestamp_ntz"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(late, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("n_name").alias("pais")).agg(F.countDistinct("o_orderkey").alias("ensayos"))


@query("SELECT CAST(center_id AS BIGINT) AS centro, count(DISTINCT study_id) AS ensayos FROM study_centers GROUP BY 1 ORDER BY ensayos DESC, centro LIMIT 20")
def busiest_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top centres by distinct studies; pairs sent twice count once. The distinct comes first, so a centre with a tenth of all rows is spread."""
    pairs = table(spark, sf_dir, "study_centers").select("study_id", "center_id").distinct()
    return pairs.groupBy(F.col("center_id").alias("centro")).agg(F.count(F.lit(1)).alias("ensayos")).orderBy(F.desc("ensayos"), "centro").limit(20)


@query("""
WITH t AS (SELECT nombre_es, CASE WHEN position(' - ' IN nombre_es) > 0 THEN substr(nombre_es, position(' - ' IN nombre_es) + 3) ELSE nombre_es END AS hoja FROM therapeutic_areas) SELECT nombre_es, hoja FROM t""")
def area_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from censo.functions.text import leaf

    return table(spark, sf_dir, "therapeutic_areas").select("nombre_es", leaf(F.col("nombre_es")).alias("hoja"))


@query("""
SELECT identificador, CASE WHEN length(identificador) = 17 THEN 'https://registro.example/ctis/' ELSE 'https://registro.example/nacional/' END || identificador AS url FROM (SELECT DISTINCT identificador FROM studies)""")
def study_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("identificador")
    return table(spark, sf_dir, "studies").select("identificador").distinct().select(i, F.concat(F.when(F.length(i) == 17, "https://registro.example/ctis/").otherwise("https://registro.example/nacional/"), i).alias("url"))
