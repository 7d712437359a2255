"""Whole jobs: cases that a cut by block, text or size would lose."""

import pyarrow as pa
import pyarrow.parquet as pq

from censo.operators.sites import place_links
from censo.plans import identity as I


def write(folder, **tables):
    for name, (columns, rows) in tables.items():
        pq.write_table(pa.table({c: pa.array([r[i] for r in rows], pa.int64() if c.endswith("_id") else pa.string()) for i, c in enumerate(columns)}), f"{folder}/{name}.parquet")
    return str(folder)


def test_hospital_match_searches_the_province(spark, tmp_path):
    """A damaged town and a code of another office: the province still finds the hospital, and the runner-up."""
    centre, hospital = ("center_id", "nombre", "localidad", "cod_postal"), ("codcnh", "nombre", "municipio", "cod_postal")
    sf = write(tmp_path, centers=(centre, [
        (1, "Hospital Alba", "Brslorbao", "08230"), (2, "Hospital Alba", "Brslorbao", "8230"), (3, "Clínica Bruma", "Vic", "08500"),
        (4, "Hospital Alba", None, None), (5, "Hospital Alba", "", "28001"), (6, None, "Vic", "08500"),
    ]), hospitals=(hospital, [("1", "Hospital Alba", "Barcelona", "08001"), ("2", "Clínica Bruma", "Vic", "08500"), ("3", "Clínica Bruma", "Manresa", "08240"), ("4", "Hospital Sol", "Toledo", "45001")]))
    got = {r.center_id: (r.codcnh, r.score, r.second, r.verdict) for r in I.hospital_match(spark, sf).collect()}
    assert got[1] == got[2] == ("1", 1.0, 0.0, "casado") and got[3] == ("2", 1.0, 1.0, "ambiguo")
    assert got[4] == got[5] == (None, None, None, "sin candidato") and got[6] == ("1", 0.0, 0.0, "sin candidato") and len(got) == 6


def test_hospital_match_is_every_pair(spark):
    """Against all pairs of rows and hospitals in plain Python."""
    from pyspark.sql import functions as F

    from censo.functions import text as X

    sf = "/root/testdata/sf0.01"
    read = lambda t, i, town: spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(i).alias("i"), X.normalise_postcode(F.col("cod_postal")).alias("cp"), X.normalise_town(F.coalesce(town, F.lit(""))).alias("t"), X.tokens(F.coalesce("nombre", F.lit(""))).alias("w")).collect()
    hospitals = read("hospitals", "codcnh", "municipio")
    want = {}
    for r in read("centers", "center_id", "localidad"):
        near = [h for h in hospitals if (r.cp and h.cp and r.cp[:2] == h.cp[:2]) or (r.t and r.t == h.t)]
        score = lambda h: len(set(r.w) & set(h.w)) / len(set(r.w) | set(h.w)) if r.w or h.w else 0.0
        best = sorted((-round(score(h), 6), h.i) for h in near)
        want[r.i] = (best[0][1], -best[0][0], -best[1][0] if len(best) > 1 else None) if best else (None, None, None)
    assert {r.center_id: (r.codcnh, r.score, r.second) for r in I.hospital_match(spark, sf).collect()} == want


SPONSORS = [(1, "Merck Sharp &amp; Dohme"), (2, "MERCK SHARP & DOHME"), (3, None), (4, "Alba &amp;amp; Sol, S.L."), (5, "Bruma")]
FUNDERS = [(6, "Merck  Sharp &#38; Dohme."), (7, "Alba & Sol SL"), (8, None), (9, "Brúma"), (10, "Otro")]


def test_text_clean_keeps_entities_and_nulls(spark, tmp_path):
    sf = write(tmp_path, sponsors=(("sponsor_id", "promotor"), SPONSORS))
    got = {r.sponsor_id: r.limpio for r in I.text_clean(spark, sf).collect()}
    assert got == {1: "merck sharp & dohme", 2: "merck sharp & dohme", 3: None, 4: "alba & sol, s.l.", 5: "bruma"}


def test_match_key_groups_keep_entities_and_nulls(spark, tmp_path):
    sf = write(tmp_path, sponsors=(("sponsor_id", "promotor"), SPONSORS), funders=(("funder_id", "nombre"), FUNDERS))
    got = {r.clave: (r.n, r.primero) for r in I.match_key_groups(spark, sf).collect()}
    assert got == {"mercksharp&dohme": (3, 1), "alba&solsl": (2, 4), "bruma": (2, 5), None: (2, 3)}


def test_place_links_reach_compatible_codes(spark):
    """The smallest row of a name and town is a namesake with another code; slips of the site's code are linked all the same."""
    rows = [(1, "10001"), (2, "28013"), (3, "28013"), (4, "28012"), (5, "28031"), (6, "47999")]
    df = spark.createDataFrame([(i, True, ["virgen", "alba"], "H", "pueblo", c) for i, c in rows], "center_id long, p_nombrado boolean, p_nucleo array<string>, p_familia string, p_ciudad string, p_cp string")
    got = {frozenset((r.a, r.b)) for r in place_links(df, "center_id").collect()}
    assert got == {frozenset(p) for p in [(2, 3), (2, 4), (2, 5)]}
