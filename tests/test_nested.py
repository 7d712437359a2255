"""Shredding round trips and the flat child tables."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from censo.operators.shredding import Node, Stripes, decode, flatten_batch, learn, positions, shred, shred_json
from censo.plans.nested import area_route, p2_found


def brute(value, path=(), at=()):
    """Leaves of one record by plain recursion: (table, positions, field, text)."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, (*path, k), at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, (*path, "[]"), (*at, i))
    elif value is not None and str(value).strip():
        last = max((i for i, s in enumerate(path) if s == "[]"), default=-1)
        yield ".".join(path[: last + 1]), ".".join(map(str, at)), ".".join(path[last + 1 :]), str(value).strip()


leaf = st.one_of(st.none(), st.text("ab 1", max_size=3))
tree = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from("xyz"), x, max_size=3)), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("xyz"), tree, max_size=3), max_size=4))
def test_levels_round_trip(records):
    rec, ruta, tabla, campo, valor = flatten_batch(records, list(range(len(records))), None)
    want = sorted((i, *x) for i, r in enumerate(records) for x in brute(r))
    assert sorted(zip(rec, tabla, ruta, campo, valor)) == want


def test_null_elements_keep_their_position():
    root, out = Node(), Stripes()
    value = {"a": [None, {"b": "1"}, {"b": None}, {"b": "2"}]}
    learn(root, value)
    shred(root, value, 0, out)
    recs, r, d, vals = out.by_path["a", "[]", "b"]
    assert vals == [None, "1", None, "2"] and r == [0, 1, 1, 1] and positions(("a", "[]", "b"), r, recs) == [(0,), (1,), (2,), (3,)]
    assert d[0] < d[1]


def test_decode():
    assert decode('{"a": 1.50}') == (True, {"a": "1.50"}) and decode("{") == (False, None) and decode(None) == (False, None) and decode("NaN")[0] is False
    assert decode("[" * 100_000)[0] is False


def test_shred_json_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "{", "x"), (4, "[1]", "x"), (5, '{"b": {"c": " 7 ", "valor": "v", "campo": "n"}}', "x"), (6, '{"b": "{\\"c\\": 1}"}', "x"), (6, '{"b": "{\\"c\\": 1}"}', "x"), (7, json.dumps({"b": {"c": "y" * 200_000}}), "x")]
    df = spark.createDataFrame(rows, "id long, j string, campo string")
    got = shred_json(df, "j", ["id"], ["b", "absent"]).collect()
    assert sorted((r.id, r.bloque, r.tabla, r.ruta, r.campo, len(r.valor)) for r in got) == [(5, "b", "", "", "c", 1), (5, "b", "", "", "n", 1), (6, "b", "", "", "c", 1), (6, "b", "", "", "c", 1), (7, "b", "", "", "c", 200_000)]
    assert shred_json(df.limit(0), "j", ["id"], ["b"]).count() == 0
    assert sorted(r.id for r in shred_json(df, "j", ["id"], [], mark_valid=True).collect()) == [4, 5, 6, 6, 7]


def test_area_route(spark):
    rows = [("area.[].eutct", "2"), ("area.eutct", ""), ("[].eutct", "1"), ("area.[].subareas.area.[].eutct", "0.3"), ("area.subareas.area.eutct.codigo", ""), ("area.subareas.area.[].eutct", "4")]
    df = spark.createDataFrame(rows, "p string, r string").select(area_route(F.col("p"), F.col("r")).alias("x"))
    assert [r.x for r in df.collect()] == ["2", "0", "1", "0.3", "0.0", "0.4"]


def test_p2_found(spark, sf):
    df = p2_found(spark, sf)
    assert df.columns == ["detalle_id", "bloque", "ruta", "campo", "valor"]
    rows = df.collect()
    assert len(rows) == len(set(rows)) and {r.bloque for r in rows} == {"areasTerapeuticas", "calendario", "poblacion", "proposito"}
    assert all(r.valor == "1" for r in rows if r.bloque == "proposito") and all(r.ruta == "" for r in rows if r.bloque != "areasTerapeuticas")


def test_elements_and_parents(spark):
    import json

    rows = [
        (1, json.dumps({"b": {"xs": [{"c": 1, "ys": [{"d": 2}, None, {"d": 3}]}, {}, {"c": 4, "ys": []}]}})), (2, json.dumps({"b": {"xs": []}})), (3, json.dumps({"b": [[1, 2], [], [3]]})), (4, "{cut"), (5, None), (6, json.dumps({})),
    ]
    from censo.operators.shredding import shred_elements

    df = spark.createDataFrame(rows, "id long, j string")
    got = sorted((r.id, r.tabla, r.ruta, r.padre) for r in shred_elements(df, "j", ["id"], ["b"]).collect())
    assert [g for g in got if g[0] == 1] == [(1, "xs.[]", "0", ""), (1, "xs.[]", "1", ""), (1, "xs.[]", "2", ""), (1, "xs.[].ys.[]", "0.0", "0"), (1, "xs.[].ys.[]", "0.1", "0"), (1, "xs.[].ys.[]", "0.2", "0")]
    assert not [g for g in got if g[0] in (2, 4, 5, 6)]
    assert [g[1:] for g in got if g[0] == 3] == [("[]", "0", ""), ("[]", "1", ""), ("[]", "2", ""), ("[].[]", "0.0", "0"), ("[].[]", "0.1", "0"), ("[].[]", "2.0", "2")]


def test_every_leaf_has_its_element(spark, sf):
    from censo.plans import nested as N
    from censo.session import table

    leaves = N.leaves(table(spark, sf, "detalle"), ["detalle_id"]).filter("tabla <> ''")
    elements = N.p2_tables(spark, sf).cache()
    assert leaves.join(elements, ["detalle_id", "bloque", "tabla", "ruta"], "left_anti").count() == 0
    child = elements.filter("padre <> ''")
    assert child.select("detalle_id", "bloque", "padre").distinct().join(elements.select("detalle_id", "bloque", elements["ruta"].alias("padre")).distinct(), ["detalle_id", "bloque", "padre"], "left_anti").count() == 0
