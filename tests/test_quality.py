"""Profiles by load against exact brute force."""

from bisect import bisect_right
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from censo.operators.profiling import Rule, profile_by_load, value_counts
from censo.plans.quality import p3_found, rules


def small_rules():
    v = F.col("valor")
    return {"n": Rule(v == "-", v.rlike("^[0-9]+$"), v.try_cast("int") <= 50, v.try_cast("int"))}


def profile(spark, values, loads):
    df = spark.createDataFrame([("t", "c", "n", c, v) for c, v in values], "tabla string, campo string, tipo string, carga int, valor string")
    ld = spark.createDataFrame([("t", "c", c, n) for c, n in loads.items()], "tabla string, campo string, carga int, filas long")
    return {r.carga: r for r in profile_by_load(value_counts(df, small_rules()), ld).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["0", "1", "7", "9", "50", "51", "x", "-", "", None])), max_size=40))
def test_profile_matches_brute_force(spark, values):
    loads = {c: sum(1 for k, _ in values if k == c) + 1 for c in (1, 2, 3)}
    got = profile(spark, values, loads)
    sound = {c: sorted(int(v) for k, v in values if k == c and v and v.isdigit() and int(v) <= 50) for c in loads}
    for c in loads:
        own, rest = sound[c], sorted(x for k in loads if k != c for x in sound[k])
        r = got[c]
        missing = 1 + sum(1 for k, v in values if k == c and (not v or v == "-"))
        assert (r.faltan, r.sanos) == (missing, len(own))
        assert r.fuera_de_forma == sum(1 for k, v in values if k == c and v == "x") and r.fuera_de_rango == sum(1 for k, v in values if k == c and v == "51")
        assert (int(r.suma1), int(r.suma2)) == (sum(own), sum(x * x for x in own))
        if own and rest:
            want = max(abs(Fraction(bisect_right(own, x), len(own)) - Fraction(bisect_right(rest, x), len(rest))) for x in own + rest)
            assert Fraction(int(r.hueco_num), int(r.hueco_den)) == want


def test_empty_and_lone_load(spark):
    assert profile(spark, [], {}) == {}
    r = profile(spark, [(1, "3")], {1: 1})[1]
    assert r.hueco_num is None and r.diferencia_estandar is None and r.sanos == 1


def test_rules(spark):
    cases = [("fecha_dmy", "31-02-2020", "rango"), ("fecha_dmy", "01-01-1994", "rango"), ("fecha_dmy", "2020-01-01", "forma"), ("fecha_dmy", "29-02-2020", "sano"), ("fecha_iso", "2020-02-30", "rango"), ("fecha_iso", "2035-12-31", "sano"),
             ("bandera", "-1", "falta"), ("bandera_estricta", "-1", "rango"), ("bandera", "2", "forma"), ("total", "0", "falta"), ("total", "999999", "falta"), ("total", "200001", "rango"), ("total", "9" * 30, "rango"), ("total", "12a", "forma"), ("total", "200000", "sano"), ("total", None, "falta")]
    df = spark.createDataFrame([("t", f"c{i}", k, 1, v) for i, (k, v, _) in enumerate(cases)], "tabla string, campo string, tipo string, carga int, valor string")
    got = {r.campo: r.estado for r in value_counts(df, rules()).collect()}
    assert [got[f"c{i}"] for i in range(len(cases))] == [w for _, _, w in cases]


def test_p3_found(spark, sf):
    df = p3_found(spark, sf)
    assert df.columns == ["carga", "tabla", "campo", "hallazgo"] and dict(df.dtypes)["carga"] == "int"
    rows = df.collect()
    assert len(rows) == len(set(rows))
