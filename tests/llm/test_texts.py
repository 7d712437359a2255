"""Packing, leakage and languages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from censo.llm import languages as G
from censo.llm import leakage as K
from censo.llm import packing as P


def exact_bins(sizes, c):
    """The least number of containers, by search over subsets (small inputs)."""
    n = len(sizes)
    if not n:
        return 0
    best = [(n + 1, c)] * (1 << n)
    best[0] = (1, 0)
    for mask in range(1 << n):
        k, used = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                new = (k, used + sizes[i]) if used + sizes[i] <= c else (k + 1, sizes[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], new)
    return best[-1][0]


@pytest.mark.parametrize("seed", range(12))
def test_bounds_bracket_the_optimum(seed):
    rng = random.Random(seed)
    c = rng.choice([10, 17, 30])
    sizes = [rng.randrange(0, c + 1) for _ in range(rng.randrange(1, 10))]
    a = np.array(sizes, np.int64)
    out = P.best_fit_decreasing(a, c)
    fill = np.bincount(out, weights=a)
    assert (fill <= c).all() and len(out) == len(sizes)
    assert P.lower_bound(a, c) <= exact_bins(sizes, c) <= out.max() + 1


def test_lower_bound_edges():
    assert P.lower_bound(np.array([], np.int64), 10) == 0 and P.lower_bound(np.array([0, 0]), 10) == 1 and P.lower_bound(np.array([6, 6, 6]), 10) == 3 and P.lower_bound(np.array([10]), 10) == 1


def test_pack_is_a_partition_of_the_texts(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, 60, 99, 100, 101, 250, 1000])) for i in range(400)]
    packed = P.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), [(1, 100), (2, 64)], per_partition=50).collect()
    for cid, c in ((1, 100), (2, 64)):
        mine = [r for r in packed if r.container_id == cid]
        by = {}
        for r in mine:
            by.setdefault(r.doc_id, []).append(r)
        for d, n in rows:
            parts = sorted(by[d], key=lambda r: r.pieza)
            assert sum(r.tokens for r in parts) == n and [r.inicio for r in parts] == [k * c for k in range(len(parts))]
            assert len(parts) == max(1, -(-n // c))  # split only beyond the capacity
        fill = {}
        for r in mine:
            fill[r.caja] = fill.get(r.caja, 0) + r.tokens
        assert max(fill.values()) <= c and len(fill) <= 1.05 * P.lower_bound(np.array([r.tokens for r in mine]), c) + 1
    assert P.pack(spark.createDataFrame([], "doc_id long, tokens long"), [(1, 100)]).count() == 0


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, "hola mundo"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in P.count_tokens(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2 and got[4] > 1 and got[5] >= 50_000


def test_p8_certificate(spark, sf):
    for r in P.p8_certificate(spark, sf).collect():
        assert r.cota <= r.cajas <= r.cota * 1.05 + 2


def passage(rng, n):
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def test_index_finds_all_within_radius():
    rng = random.Random(1)
    index = K.Index({i: passage(rng, 40) for i in range(30)})
    flips = np.random.default_rng(0).integers(0, 64, (len(index.prints), K.RADIUS))
    probe = index.prints.copy()
    for k in range(K.RADIUS):
        probe ^= np.uint64(1) << flips[:, k].astype(np.uint64)
    at, found = index.search(probe)
    pairs = set(zip(at.tolist(), found.tolist()))
    probe = np.unique(probe)
    at, found = index.search(probe)
    pairs = set(zip(at.tolist(), found.tolist()))
    near = np.bitwise_count(probe[:, None] ^ index.prints[None, :]) <= K.RADIUS
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_leaks(spark):
    rng = random.Random(7)
    items = {i: passage(rng, 50) for i in range(20)}
    rows = [(i, "Lea con calma el caso. " + " ".join(p) + " A) uno B) dos") for i, p in items.items()] + [(50, None), (51, ""), (None, "x")]
    filler = lambda n: " ".join(passage(rng, n))
    slip = lambda p: [w[:-1] + "x" if k % 12 == 5 else w for k, w in enumerate(p)]
    docs = [
        (1, filler(80) + " " + " ".join(items[3]) + " " + filler(10)), (2, " ".join(items[4][:12]) + " " + filler(30) + " " + " ".join(items[4][30:45])), (3, filler(40) + " " + " ".join(items[5][:9]) + " " + filler(40)),
        (4, " ".join(slip(items[6])).upper()), (5, "Lea con calma el caso. " + filler(60)), (6, None), (7, ""), (8, " ".join(items[3])), (9, filler(30_000) + " " + " ".join(items[7][5:40])), (10, " ".join(reversed(items[8]))),
    ]
    got = {(r.doc_id, r.item_id) for r in K.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got == {(1, 3), (2, 4), (4, 6), (8, 3), (9, 7)}
    assert K.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_match_brute_force(spark):
    """Against the longest common words in order, on the small tables: nothing that holds half a passage is missed."""
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in K.p9_found(spark, sf).collect()}
    passages = K.own_passages([(r.item_id, r.text) for r in items.collect()])
    grams = {}
    for i, p in passages.items():
        for g in set(zip(p, p[1:], p[2:])):
            grams.setdefault(g, set()).add(i)
    want = set()
    for r in docs.collect():
        w = K.words_of(r.text)
        hits = {}
        for g in set(zip(w, w[1:], w[2:])):
            for i in grams.get(g, ()):
                hits[i] = hits.get(i, 0) + 1
        want |= {(r.doc_id, i) for i, n in hits.items() if n >= 0.5 * (len(passages[i]) - 2)}
    assert want <= got


@pytest.mark.parametrize("label,code", [("es", "es"), ("ES", "es"), ("ca-ES", "ca"), ("es_ES", "es"), ("español", "es"), ("Deutsch", "de"), ("nl", "otra"), ("und", None), (" ", None), (None, None), ("N/A", None), ("baq", "eu")])
def test_label_code(label, code):
    assert G.label_code(label) == code


def test_viterbi_prefers_runs():
    s = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1], [0.01, 0.99], [0.01, 0.99]]))
    assert G.viterbi(s, 2.0) == [0, 0, 0, 1, 1]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.filter("doc_id % 3 <> 0")
    return docs.filter("doc_id % 3 = 0"), G.Discriminator().fit(*G.training_sample(train))


def test_held_out_accuracy(spark, fitted):
    """Labels are noisy (about a fifth missing or wrong), so agreement with the sound ones is what counts: each language's majority."""
    held, model = fitted
    rows = [r for r in G.identify(held, model).filter("NOT varias AND etiqueta IS NOT NULL AND etiqueta <> 'otra'").collect()]
    agree = sum(r.idioma == r.etiqueta for r in rows)
    assert len(rows) > 150 and agree / len(rows) > 0.85
    assert sum(r.confianza > 0.9 for r in rows) / len(rows) > 0.95


def test_segments(fitted):
    _, m = fitted
    es = "El comité de ética revisó la póliza del seguro antes de la visita. La unidad de farmacovigilancia completó la tabla de dosis. "
    en = "The ethics board reviewed the insurance policy before the visit. The safety unit completed the table of doses. "
    assert [(x, n) for x, _, n in G.segments(m, es + en)] == [("es", 2), ("en", 2)]
    assert [x for x, _, _ in G.segments(m, es + "The ethics board. " + es)] == ["es"]
    assert [x for x, _, _ in G.segments(m, es.upper())] == ["es"] and [x for x, _, _ in G.segments(m, G.plain(es))] == ["es"]
    for t in (None, "", "12 34 56", "OK", "uno dos tres"):
        assert G.segments(m, t) == []
    assert len(G.segments(m, en * 800)) == 1
    assert G.segments(G.Discriminator().fit([], []), en) == []


def test_p10_found(spark, sf):
    df = G.p10_found(spark, sf)
    assert df.columns == ["doc_id", "orden", "idioma"] and dict(df.dtypes)["orden"] == "int"
    rows = df.collect()
    assert len({(r.doc_id, r.orden) for r in rows}) == len(rows) and {r.idioma for r in rows} <= set(G.LANGUAGES)
    assert df.filter(F.col("orden") < 0).count() == 0


def test_passages_are_those_of_one_process(spark, sf):
    items = spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "text")
    want = {i: p for i, p in K.own_passages([tuple(r) for r in items.collect()]).items() if len(p) >= K.LEAST_STRETCH}
    assert {r.item_id: list(r.palabras) for r in K.passages_of(items).collect()} == want


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(passage(rng, 30))) for i in range(12)]
    docs = [(100 + i, "Inicio del texto. " + items[i][1] + " y sigue.") for i in range(12)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in K.leaks(d, q).collect())
    monkeypatch.setattr(K, "ITEMS_PER_PASS", 3)
    assert sorted(tuple(r) for r in K.leaks(d, q).collect()) == whole and len(whole) == 12
