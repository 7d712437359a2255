"""Centre identities, classes, sources and losses against the hand fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from censo.functions import text as X
from censo.functions import vocabularies as V
from censo.operators.points import place_sites
from censo.plans import centres as C
from censo.plans import landscape as L
from censo.plans import profile as P
from censo.sources.files import read_geojson
from censo.sources.lookup import ListSource, LookupReader, LookupSource
from censo.streaming.ingest import backfill, has_files

ROWS = "center_id long, center_key string, nombre string, localidad string, cod_postal string, referencia string"


def who(spark, rows, codes=None, towns=()):
    df = spark.createDataFrame(rows, ROWS)
    gaz = spark.createDataFrame(list(towns), "cp string, pueblo string")
    codes = spark.createDataFrame(codes, "center_id long, codcnh string") if codes else None
    return {r.center_id: r.sitio for r in C.identities(df, gaz, codes).collect()}


def test_identities_by_reference_town_and_code(spark):
    assert who(spark, [(1, "k", "a", "Manresa", "08243", "R1"), (2, "k", "b", "Barcelona", "08243", "R1"), (3, "k", "c", "Manresa", "08240", "R1"), (4, "k", "d", "Manresa", "08242", "R1")]) == {1: 1, 2: 1, 3: 1, 4: 1}
    apart = who(spark, [(1, "k", "a", "Pamplona", "31008", "R1"), (2, "k", "a", "Madrid", "28027", "R1"), (3, "k", "a", "", "", "R1")])
    assert apart == {1: 1, 2: 2, 3: 3}
    keep = who(spark, [(1, "k", "ico", "L'Hospitalet", "08908", "R1"), (2, "k", "ico", "Badalona", "08908", "R1"), (3, "k", "ico", "Girona", "08908", "R1")])
    assert keep == {1: 1, 2: 2, 3: 3}


def test_identities_by_national_code(spark):
    rows = [(1, "k1", "a", "Cartagena", "30201", "R1"), (2, "k2", "b", "Murcia", "30001", "R2")]
    assert who(spark, rows) == {1: 1, 2: 2} and who(spark, rows, [(1, "300145"), (2, "300145")]) == {1: 1, 2: 1}
    joined = [(1, "k1", "a", "Murcia", "30201", "R1"), (2, "k2", "b", "Murcia", "30001", "R1")]
    assert who(spark, joined, [(1, "300145"), (2, "300146")]) == {1: 1, 2: 1}


def test_towns_from_postcode_or_the_only_town_of_a_key(spark):
    got = who(spark, [(1, "k", "a", "M?laga", "29010", "R1"), (2, "k", "b", "Málaga", "29001", "R1"), (3, "z", "c", "", None, "R9"), (4, "z", "d", "Soria", None, "R9"), (5, "q", None, None, None, None)], towns=[("29010", "Málaga")])
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert who(spark, [(1, "a", "x", "Soria", "42001", "NR"), (2, "b", "y", "Soria", "42001", "NR")]) == {1: 1, 2: 2}
    assert C.identities(spark.createDataFrame([], ROWS), spark.createDataFrame([], "cp string, pueblo string")).count() == 0


def test_entries_to_sites(spark):
    raw = [(1, 0, "R1", "Hosp A", "Sabadell", "08208", "B", "C"), (2, 0, "R1", "Hospital A", "SABADELL", "8208", "B", None), (3, 0, "-", "Hospital A", "Sabadell", None, None, None), (4, 0, None, ".", "x", "1", None, None), (5, 0, "R1", "Hospital A", "Sabadell", "08208", "B", "C")]
    df = spark.createDataFrame(raw, "detalle_id long, pos int, referencia string, nombre string, localidad string, cod_postal string, provincia string, ccaa string")
    e = {(r.identidad, r.cod_postal): r for r in C.read_entries(df).collect()}
    assert set(e) == {("R1", "08208"), ("R1", "8208"), ("hospitala", None)} or len(e) == 4
    assert all(r.lugar == "sabadell" for r in e.values()) and not any(r.nombre == "." for r in e.values())


@pytest.mark.parametrize("name,want", [
    ("BioNTech SE", V.INDUSTRY), ("Hospital Universitario La Paz", V.ACADEMIC), ("Something Institute Ltd", V.UNCLASSIFIED), ("ABBOTT", V.UNCLASSIFIED), ("Dr. Falk Pharma GmbH", V.INDUSTRY),
    ("Dra. Cristina Avendaño Solá", V.ACADEMIC), ("Novartis Farmacéutica", V.INDUSTRY), (None, None),
])
def test_classes(spark, name, want):
    r = spark.createDataFrame([(name,)], "n string").select(L.classify(F.col("n")).alias("c"), L.family_of(F.col("n")).alias("f"), L.is_individual(F.col("n")).alias("i")).first()
    assert r["c"] == want and r["i"] in ((name or "").startswith("Dra. "), None)


def test_families(spark):
    names = ["Sanofi Pasteur MSD S.A.", "Merck Sharp & Dohme LLC", "Merck KGaA", "Merckle GmbH", "Genentech Inc."]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(L.family_of(F.col("n"))).collect()]
    assert got == ["Sanofi Pasteur MSD", "Merck Sharp & Dohme (MSD)", "Merck KGaA", "Merckle GmbH", "Roche"]


def test_routes(spark):
    from censo.plans.gold import routes_of

    df = spark.createDataFrame([("Oral use",), ("INFUSI&Oacute;N INTRAVENOSA",), ("Unknown use",), ("por la puerta",), ("",)], "via string")
    got = {r.via: r.ruta for r in routes_of(spark, df).collect()}
    assert got == {"Oral use": "oral", "INFUSI&Oacute;N INTRAVENOSA": "intravenous", "Unknown use": None, "por la puerta": "por la puerta", "": None}
    assert set(V.ROUTES.values()) == set(V.ROUTE_GROUPS) and len(set(V.ROUTE_GROUPS.values())) == 12


def test_similarity_of_synonyms(spark):
    df = spark.createDataFrame([("University Hospital La Paz", "Hospital Universitario La Paz"), ("Clínica Quirón", "Quirónsalud Clinic"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(X.jaccard(X.tokens(F.col("a")), X.tokens(F.col("b")))).collect()] == [1.0, 1.0, 0.0]


def test_place_sites(spark):
    sites = spark.createDataFrame([("La Paz", "28046", 500), ("Vall", "8035", 400), ("x", None, 7), ("y", "99", 3)], "nombre string, cod_postal string, ensayos long")
    points = spark.createDataFrame([("28046", 40.4, -3.7), ("08035", 41.4, 2.1), ("08035", 49.0, 2.1)], "cod_postal string, lat double, lon double")
    placed, lost = place_sites(sites, points)
    assert {(r.nombre, r.lat) for r in placed.collect()} == {("La Paz", 40.4), ("Vall", 41.4)} and tuple(lost.first()) == (2, 10)
    assert tuple(place_sites(sites.limit(0), points)[1].first()) == (0, 0)


def answers(i):
    if i.startswith("e"):
        raise OSError("sin red")
    return {"n": "no existe", "t": '{"identificador": "cor'}.get(i[0], json.dumps({"identificador": i}))


def lists(first, last):
    return json.dumps({"estudio": [{"identificador": f"{first}/{last}"}]})


def test_lookups_stop_after_failures_in_a_row():
    read = lambda ids, **o: list(LookupReader({"ids": ids, "fetch": "tests.test_registry:answers", **o}).read(LookupReader({"ids": ids, "fetch": "x:y"}).partitions()[0]))
    assert [r[1] for r in read("a,n1,t1,e1")] == ["encontrado", "no existe", "error", "error"]
    assert [r[0] for r in read("e1,e2,e3,e4,e5,a")] == ["e1", "e2", "e3", "e4", "e5"]
    assert [r[0] for r in read("e1,e2,e3,e4,n1,e5,e6,a")] == ["e1", "e2", "e3", "e4", "n1", "e5", "e6", "a"]
    assert read("a,b", deadline="0") == [] and len(read("e1,e2,a", abortAfter="2")) == 2


def test_sources(spark, tmp_path):
    spark.dataSource.register(LookupSource)
    spark.dataSource.register(ListSource)
    got = spark.read.format("registro").option("ids", "a,b,n1").option("fetch", "tests.test_registry:answers").option("idsPerTask", "2").load().collect()
    assert sorted(r.estado for r in got) == ["encontrado", "encontrado", "no existe"]
    since = spark.read.format("registro_lista").option("since", "2024-03-01").option("fetch", "tests.test_registry:lists").load().first()
    assert since.anio is None and "2024-03-01/None" in since.documento
    years = {r.anio: r.documento for r in backfill(spark, 2019, 2022, [2020, 2021], "tests.test_registry:lists").collect()}
    assert set(years) == {2019, 2022} and "2022-01-01/2022-12-31" in years[2022] and backfill(spark, 2019, 2019, [2019], "x:y").count() == 0
    (tmp_path / "m.geojson").write_text(json.dumps({"features": [{"id": "1", "properties": {"name": "Soria"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    g = read_geojson(spark, str(tmp_path / "m.geojson")).first()
    assert (g.id, g.name) == ("1", "Soria") and json.loads(g.geometry)["coordinates"] == [1, 2]
    assert not has_files(spark, str(tmp_path / "nada")) and has_files(spark, str(tmp_path))


def test_unknown_profile_group(spark, sf):
    with pytest.raises(ValueError):
        P.profile(spark, sf, ["nada"])
    assert {r.grupo for r in P.profile(spark, sf, ["funders"]).collect()} == {"funders"}
