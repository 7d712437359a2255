"""Relational, identity, repair, matching, filling and streaming operators on hand fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from censo.operators import relational as R
from censo.operators.components import connected_components
from censo.operators.filling import consensus, fill_over_time
from censo.operators.matching import blocked_match
from censo.operators.repair import triangulate
from censo.operators.sites import mend_towns, place_links, settle
from censo.functions.udf import parse_places
from censo.plans.completion import p6_found
from censo.streaming.ingest import ingest_new_files, merge_failures, pending, retryable


def test_ranked_fold(spark):
    rows = [("C04", "Cancer", 40), ("C10", "Nervous", 30), ("na", "Sin", 9), ("C14", "Otra", 5), ("np", "No", 4), ("C08", "Tres", 3)]
    df = spark.createDataFrame(rows, "code string, area string, n long")
    got = [tuple(r) for r in R.fold_tail(df, "area", "n", 2, ["na", "np"], "No consta", "Otras (%d)", code="code").orderBy("pos").collect()]
    assert got == [(1, "Cancer", 40, True), (2, "Nervous", 30, True), (3, "No consta", 13, False), (4, "Otras (2)", 8, False)]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 1), ("b", 5, 3), ("b", 1, 2), ("c", None, 4)], "k string, v int, n long")
    assert {tuple(r) for r in R.upper_median(df, "k", "v", "n").collect()} == {("a", 3), ("b", 5)}


def test_mode_and_first_seen(spark):
    df = spark.createDataFrame([("k", "ABC"), ("k", "ABC"), ("k", "Abc"), ("k", "abd"), ("j", None)], "k string, v string")
    assert [tuple(r) for r in R.mode_by(df, "k", "v").collect()] == [("k", "ABC")]
    assert [tuple(r) for r in R.mode_by(df, "k", "v", [F.col("v") != F.upper("v")]).collect()] == [("k", "Abc")]
    f = spark.createDataFrame([(1, "ISCIII|Pfizer|"), (2, "ISCIII|isciii"), (3, "||"), (4, None)], "id int, t string")
    assert sorted(tuple(r) for r in R.first_seen(f, "id", "t").collect()) == [(1, 0, "ISCIII"), (1, 1, "Pfizer"), (2, 0, "ISCIII")]


def test_violations_pass_on_null(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    rules = {"positivo": F.col("v") > 0, "chico": F.col("v") < 4}
    assert sorted(tuple(r) for r in R.violations(df, "id", rules).collect()) == [(1, "chico"), (3, "positivo")]
    good, bad = R.quarantine(df, rules)
    assert [r.id for r in good.collect()] == [2] and sorted(r.id for r in bad.collect()) == [1, 3]


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    df = spark.createDataFrame(edges * 2 + [(None, 3)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == brute_components(edges)
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_triangulate(spark):
    whole = [(100 + i, "11008", f"x{i}", "cadiz") for i in range(7)] + [(200 + i, "11408", f"y{i}", "cadiz") for i in range(5)] + [(300, "30008", "vissum", "murcia"), (301, "03010", "hgu", "alicante"), (302, "08208", "s", "sabadell"), (303, "11008", "z", "tie"), (304, "11408", "w", "tie")]
    rows = whole + [(1, "3008", "vissum", "murcia"), (2, "1108", "q", "cadiz"), (3, "1108", "q", "tie"), (4, "8207", "n", "sabadell"), (5, "2260", "n", "nowhere"), (6, None, "n", "cadiz"), (7, "ND", "n", "cadiz")]
    got = {r.id: (r.codigo, r.base) for r in triangulate(spark.createDataFrame(rows, "id int, c string, k string, t string"), "id", "c", "k", "t").collect()}
    assert [got[i] for i in range(1, 8)] == [("30008", "centro"), ("11008", "localidad"), ("1108", None), ("08207", "provincia"), ("2260", None), (None, None), ("ND", None)]
    assert len(got) == len(rows)


def test_blocked_match(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], "m"), (2, ["a"], "m"), (3, ["z"], "q"), (4, [], None)], "id int, w array<string>, b string")
    cat = spark.createDataFrame([("x", ["a", "b"], "m"), ("y", ["a", "c"], "m"), ("x2", ["q"], "q")], "code string, v array<string>, b string")
    got = {r.id: (r.code, r.verdict) for r in blocked_match(rows, "id", "w", cat, "code", "v", ["b"]).collect()}
    assert got == {1: ("x", "casado"), 2: ("x", "ambiguo"), 3: ("x2", "sin candidato"), 4: (None, "sin candidato")}


def brute_fill(rows, max_gap):
    """rows: (entity, day or None, order, value); nearest observed before (ties first) or after."""
    out = {}
    for e, d, o, v in rows:
        if v is not None:
            out[o] = (v, "observado")
            continue
        seen = [(x, y, z) for f, x, y, z in rows if f == e and z is not None and x is not None]
        before = [s for s in seen if d is None or (s[0], s[1]) < (d, o)]
        after = [] if d is None else [s for s in seen if (s[0], s[1]) > (d, o)]
        p, n = max(before, default=None), min(after, default=None)
        p = p if p and d is not None and d - p[0] <= max_gap else None
        n = n if n and d is not None and n[0] - d <= max_gap else None
        if p and (not n or d - p[0] <= n[0] - d):
            out[o] = (p[2], "arrastre")
        elif n:
            out[o] = (n[2], "retroceso")
        else:
            out[o] = (None, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fill_categories(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice([None, *range(0, 300, 7)]), o, rng.choice([None, None, "x", "y"])) for o in range(80)]
    base = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(e, None if d is None else base + dt.timedelta(days=d), o, v, "clash") for e, d, o, v in rows], "e string, t timestamp, o int, v string, _t string")
    got = {r.o: (r.v, r.v_metodo) for r in fill_over_time(df.drop("_t"), "e", "t", "o", [], ["v"], 60.0).collect()}
    assert got == brute_fill(rows, 60)


def test_fill_numbers(spark):
    base = dt.datetime(2020, 1, 1)
    rows = [("a", 0, 1, 10), ("a", 10, 2, None), ("a", 40, 3, 50), ("a", 45, 4, None), ("b", 0, 5, None), (None, 0, 6, None), (None, 1, 7, 5)]
    df = spark.createDataFrame([(e, base + dt.timedelta(days=d), o, v) for e, d, o, v in rows], "e string, t timestamp, o int, v int")
    got = {r.o: (r.v, r.v_metodo, r.v_distancia) for r in fill_over_time(df, "e", "t", "o", ["v"], []).collect()}
    assert got[2] == (20.0, "interpolado", 10.0) and got[4] == (50.0, "extremo", 5.0) and got[5] == (None, None, None) and got[6] == (None, None, None) and got[1] == (10.0, "observado", 0.0)
    assert fill_over_time(df.limit(0), "e", "t", "o", ["v"], []).count() == 0


def test_consensus(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("h", None), (None, "a")], "g string, v string")
    assert [tuple(r) for r in consensus(df, "g", "v").collect()] == [("g", "a", 2, 4)]


CENTRES = "center_id long, nombre string, localidad string, cod_postal string, actualizado_en timestamp"


def test_sites(spark):
    t = [dt.datetime(2010 + i, 1, 1) for i in range(9)]
    rows = [
        (1, "Clínica San Fenhurilla", "Bruxarveneña", "13809", t[0]), (2, "CLIN. SN. FENHURILLA", "BRUXARVENEÑA", None, t[1]), (3, "Hospital General San Fenhurila", "", "13809", t[2]),
        (4, "Hospital General San Fenhurilla", "Bruxarveneña", "13902", t[3]), (5, "Centro de Salud San Fenhurilla", "Bruxarveneña", "13809", t[4]), (6, None, None, None, None), (7, "", "", "", t[0]),
        (8, "Hospital Comarcal Río Tal", "Otro", "20001", t[0]), (9, "Hospital General Río Tal", "Otro", "20001", t[1]), (10, "Hospital Comarcal Río Tal", "Otro", "20001", t[2]),
    ]
    p = parse_places(spark.createDataFrame(rows, CENTRES), "nombre", "localidad", "cod_postal")
    got = {r.node: r.site for r in settle(p, place_links(mend_towns(p), "center_id"), "center_id", "actualizado_en").collect()}
    assert got.get(1) == got.get(2) == got.get(3) and got.get(5, 5) != got[1] and 6 not in got and 7 not in got
    # another code is another site, kinds used side by side are different centres
    assert got.get(4, 4) != got[1] and got[8] == got[10] != got.get(9, 9)


def test_p6_found(spark, sf):
    df = p6_found(spark, sf)
    assert df.columns == ["center_id", "campo", "valor"]
    rows = df.collect()
    assert len({(r.center_id, r.campo) for r in rows}) == len(rows) and {r.campo for r in rows} <= {"provincia", "ccaa", "cod_postal"}


def test_ingestion_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "identificador string")
    assert [r[0] for r in pending(ids("a", "b", "c", "c"), ids("a"), ids("b")).collect()] == ["c"]
    fails = spark.createDataFrame([("a", "error", "1"), ("a", "no existe", "2"), ("b", "error", "1")], "identificador string, reason string, at string")
    assert [r.identificador for r in retryable(fails).collect()] == ["b"]
    after = merge_failures(fails, spark.createDataFrame([("b", "otra", "9")], fails.schema), ids("a"))
    assert [tuple(r) for r in after.collect()] == [("b", "otra", "9")]


def test_ingest_new_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "2020.jsonl").write_text('{"identificador": "a"}\n{"identificador": "a"}\n{"identif')
    args = (str(src), "identificador string", str(tmp_path / "out"), str(tmp_path / "ck"), "identificador")
    assert ingest_new_files(spark, *args) == 1 and ingest_new_files(spark, *args) == 0
    (src / "2021.jsonl").write_text('{"identificador": "a"}\n{"identificador": "b"}\n')
    assert ingest_new_files(spark, *args) == 1
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def fake_fetch(i):
    if i == "bad":
        raise OSError("fuera")
    return "no existe " if i == "gone" else json.dumps({"identificador": i})


def test_sources(spark, tmp_path):
    from censo.sources import files
    from censo.sources.lookup import LookupReader

    r = LookupReader({"ids": "a,bad,gone", "fetch": f"{__name__}:fake_fetch", "idsPerTask": "2"})
    assert [(x[0], x[1]) for p in r.partitions() for x in r.read(p)] == [("a", "encontrado"), ("bad", "error"), ("gone", "no existe")]
    (tmp_path / "2020.jsonl").write_text('{"identificador": "a", "acronimo": null}\n{"identificador": "b"')
    (tmp_path / "2021.jsonl").write_text('{"identificador": "c"}\n{"acronimo": "x"}\n')
    rec = files.read_records(spark, str(tmp_path)).collect()
    assert sorted((x.anio, x.identificador) for x in rec if x.identificador) == [(2020, "a"), (2021, "c")]
    assert sorted(x[0] for x in files.recorded_ids(spark, str(tmp_path)).collect()) == ["a", "c"]
    assert files.read_records(spark, str(tmp_path), [2021]).count() == 2
