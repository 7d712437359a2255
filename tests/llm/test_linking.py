"""Truth discovery, addresses, names and linkage: exact parts against brute force, whole operators on hand fixtures and small tables."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from censo.functions.places import damerau
from censo.functions.udf import parse_places
from censo.llm import addresses as A
from censo.llm import linkage as L
from censo.llm import spellings as S
from censo.llm import truth as U

T0 = dt.datetime(2015, 1, 1)
DAY = dt.timedelta(days=1)


def test_align():
    assert A.align(["san", "fenhurilla"], ["sn", "fenhurilla"]) == 1.0 and A.align([], []) == 0.0 and A.align(["a"], []) == 0.0
    assert A.align(["virgen", "baana"], ["virgen", "baanna"]) > A.LEAST_SCORE > A.align(["virgen", "baana"], ["doctor", "quinneo"])
    assert A.align(["rio", "lemqueluela"], ["ro", "lemqueluela"]) > A.LEAST_SCORE


def test_minhash_recall(spark):
    """Banding finds the like pairs brute force finds."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghijklmno") for _ in range(12)) for _ in range(60)]
    texts = base + [b[:k] + "z" + b[k + 1 :] for b in base for k in (2, 7)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    keyed = df.select("i", F.explode(A.minhash_bands(F.array_distinct(A.qgrams(F.col("t"))))).alias("k"))
    found = {(r.a, r.b) for r in keyed.select(F.col("i").alias("a"), "k").join(keyed.select(F.col("i").alias("b"), "k"), "k").filter("a < b").select("a", "b").distinct().collect()}

    def grams(t):
        t = f"_{t}_"
        return {t[i : i + 2] for i in range(len(t) - 1)}

    like = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j])) >= 0.6]
    assert len(like) >= 60 and sum(p in found for p in like) >= 0.95 * len(like)


CENTRES = "center_id long, nombre string, localidad string, cod_postal string, provincia string, actualizado_en timestamp"


def sites(spark, rows):
    p = parse_places(spark.createDataFrame(rows, CENTRES), "nombre", "localidad", "cod_postal", "provincia")
    return {r.node: r.site for r in A.resolve_sites(p, "center_id", "actualizado_en").collect()}


def test_resolve_sites(spark):
    rows = [
        (1, "Clínica Dorona y Lanedo, 143, Paseo Cordeleros", "Narnargarosa", "49014", "Deóbriga", T0), (2, "Clin. Dorona y Lanedo", "NARNARGAROSA", None, None, T0 + DAY),
        (3, "Cordeleros (paseo) 143", "Narnargarosa", "49011", None, T0), (4, "Clínica Dorona y Lanedo", "Venjargólón", "39537", "Palmanera", T0), (5, None, None, None, None, None), (6, "", "", "", "", T0),
        (7, "Clín. Dorona y Lanedo", "Narnargarosa", "49014", "Deóbriga", T0), (8, "Clín. Dorona y Lanedo", "Narnargarosa", "49014", "Deóbriga", T0), (9, "x" * 30_000, "Narnargarosa", "49014", "Deóbriga", T0),
        (10, "Centro de Salud Dorona y Lanedo", "Narnargarosa", "49014", "Deóbriga", T0),
    ]
    got = sites(spark, rows)
    assert {got.get(i) for i in (1, 2, 3, 7, 8)} == {1} and got.get(4, 4) != 1 and got.get(10, 10) != 1 and 5 not in got and 6 not in got and got.get(9, 9) != 1
    assert sites(spark, []) == {}


def test_many_copies_stay_linear(spark):
    """A third of all rows at one address: one site, no pair per copy in the candidates."""
    rows = [(i, "Hospital General Río Tal", "Pueblo", "20001", "P", T0) for i in range(300)] + [(1000 + i, f"Clínica Número{chr(97 + i % 26)}{chr(97 + i // 26)}alba", "Pueblo", "20001", "P", T0) for i in range(100)]
    p = parse_places(spark.createDataFrame(rows, CENTRES), "nombre", "localidad", "cod_postal", "provincia")
    copies, links = A.address_links(p, "center_id")
    assert copies.count() == 299 and links.count() < 2000
    assert len({s for n, s in sites(spark, rows).items() if n < 300}) == 1


def test_p4_found(spark, sf):
    df = A.p4_found(spark, sf)
    assert df.columns == ["center_id_a", "center_id_b"]
    rows = df.collect()
    groups = {r.center_id: r.group_id for r in spark.read.parquet(f"{sf}/center_groups.parquet").collect()}
    assert len(rows) == len(set(rows)) and all(r[0] < r[1] and (r[0] not in groups or groups[r[0]] != groups.get(r[1])) for r in rows)


@pytest.mark.parametrize("name,want", [
    ("Dr. F. Brunollano Jarmónosas", ("persona", ["f", "brunollano", "jarmonosas"], 0, True)), ("Brunollano Jarmónosas, Paco", ("persona", ["brunollano", "jarmonosas", "francisco"], 2, False)), ("Pfizer", ("", ["pfizer"])),
    ("Lab. Evkinyarora Yaryfrbioex", ("lab", ["evkinyarora", "yaryfrbioex"])), ("Engpryvexon Vithelwynal Biotechnology, C/ Tejares 24", ("biotec", ["engpryvexon", "vithelwynal"])),
    ("Yarulmaxity-Bronexbroora Pharmaceutical S.L.U., c/ Noria 24", ("farma", ["yarulmaxity", "bronexbroora"])), ("N/A", None), ("", None), (None, None),
])
def test_parse_name(name, want):
    assert S.parse_name(name) == (S.Name(*want) if want else None)


def test_automaton():
    words = ["casa", "caso", "cosas", "masa", "", "zzz"]
    for p in ("casa", "caza", "cas"):
        got = dict(S.walk(S.build_trie([w for w in words if w]), S.Automaton(p, 1)))
        import duckdb

        want = {w: d for w in words if w for d in [duckdb.sql(f"select levenshtein('{p}', '{w}')").fetchall()[0][0]] if d <= 1}
        assert got == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_join_is_exact(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    texts = set(base)
    for b in base:
        for _ in range(2):
            x = list(b)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "a", "c"])
            texts.add("".join(x))
    texts = sorted(t for t in texts if t)
    df = spark.createDataFrame([("g", t) for t in texts] * 2 + [("h", texts[0]), ("g", ""), ("g", None)], "g string, t string")
    got = {(r.a, r.b): r.d for r in S.trie_join(df, "g", "t").collect()}
    want = {(a, b): levenshtein(a, b) for a, b in combinations(texts, 2) if levenshtein(a, b) <= S.bound(min(len(a), len(b)))}
    assert got == want
    assert S.trie_join(df.limit(0), "g", "t").count() == 0


def test_resolve_names(spark):
    names = ["Dr. Francisco Brunollano Jarmónosas", "Brunollano Jarmonosas, Paco", "F. Brunollano J.", "Francisco Brunollano", "Manuel Brunollano Jarmónosas", "M. Brunollano Jarmónosas", "Univ. de Modionurois Kinbioviton", "ModionuroisKinbioviton University", "Universidad de Modionurois Kinbiovitn",
             "Instituto Modionurois Kinbioviton de Oncología", "N/A", None, "", "Dr. Francisco Brunollano Jarmónosas"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, n string")
    got = {r.id: r.entity for r in S.resolve_names(S.parse_names(df, "id", "n")).collect()}
    assert {got[i] for i in (0, 1, 2, 3, 13)} == {0} and got[4] == got[5] == 4 and {got[i] for i in (6, 7, 8)} == {6} and got[9] == 9 and not {10, 11, 12} & set(got)
    assert S.resolve_names(S.parse_names(df.limit(0), "id", "n")).count() == 0


def entities(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "id long, n string")
    return {r.id: r.entity for r in S.resolve_names(S.parse_names(df, "id", "n")).collect()}


def test_names_of_no_list(spark):
    """Given names that no vocabulary holds, five surnames, and organisations' words in every order."""
    five = "Lucía Otero Amaya Ruiz Sanz Mota"
    names = ["Dra. Lucía Pérez Gómez", "Lucia Perez Gomes", "Pérez Gómez, Lucía", "Pérez Gómez Lucía", "L. Pérez Gómez", "Pérez G., Lucía", five, five.upper(), "Ruiz Mota Sanz Otero Amaya, Lucía",
             "Fundación Alfa Betania Gamona", "Fundación Betania Gamona Alfa", "Gamona Alfa Betania Foundation", "Fund. Alfa Gamona Betania", "Fund. Gamonz Betania Alfa", "Fundación Alfa Betania Deltoria",
             "Dr. Ximo Tarrés Bonet", "X. Tarrés", "Xavi Tarrés Bonet", "Dra. Lucía Gómez Pérez", "Pfizer", "PFIZER.", "Bayer"]
    got = entities(spark, names)
    assert {got[i] for i in range(6)} == {0} == {got[18]} and {got[i] for i in (6, 7, 8)} == {6} and {got[i] for i in range(9, 14)} == {9} and got[14] == 14
    assert got[15] == 15 and got[17] == 17 and got[16] == 16 and got[19] == got[20] == 19 and got[21] == 21


def test_recall_of_planted_variants(spark):
    """People of invented given names under six spellings each: nearly all pairs are linked, and none across people."""
    rng = random.Random(11)
    syllable = lambda: rng.choice("bcdfglmnprstv") + rng.choice("aeiou") + rng.choice(["", "l", "n", "r", "s"])
    word = lambda k: "".join(syllable() for _ in range(k))
    givens = [word(3) for _ in range(25)]
    names, who = [], []
    for p in range(120):
        g, a, b = rng.choice(givens), word(4), word(4)
        at = rng.randrange(1, len(a))
        for n in (f"{g} {a} {b}", f"Dr. {g} {a} {b}", f"{a} {b}, {g}", f"{a} {b} {g}".upper(), f"{g[0]}. {a} {b}", f"{g} {a[:at]}x{a[at + 1 :]} {b}"):
            names.append(n)
            who.append(p)
    got = entities(spark, names)
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if got[i] == got[j]]
    right = sum(who[i] == who[j] for i, j in pairs)
    assert right >= 0.97 * 120 * 15 and right >= 0.99 * len(pairs)


@pytest.mark.parametrize("seed", range(4))
def test_words_fit_is_an_assignment(seed):
    from itertools import permutations

    rng = random.Random(seed)
    pool = ["perez", "peres", "p", "gomez", "g", "ruiz", "r", "ramos"]
    for _ in range(300):
        x, y = [rng.choice(pool) for _ in range(rng.randrange(1, 4))], [rng.choice(pool) for _ in range(rng.randrange(1, 5))]
        some = [p for p in permutations(y, len(x)) if all(S.word_fits(u, v) for u, v in zip(x, p))] if len(x) <= len(y) else []
        got = S.words_fit(x, y)
        assert not got or some
        if any(S.word_fits(u, v) == 2 for p in some for u, v in zip(x, p)) and not any(len(w) == 1 for w in x + y):
            assert got
    assert S.same_person(["a", *["bcdefg"] * 40, "zzzzz"], ["a", "zzzzz", *["bcdefg"] * 40])


def test_p5_found(spark, sf):
    rows = S.p5_found(spark, sf).collect()
    assert len(rows) == len(set(rows)) and all(r.id_a < r.id_b for r in rows)


def test_label_model_learns_accuracies():
    rng = random.Random(1)
    acc = (0.95, 0.9, 0.8, 0.7, 0.6)
    truth, counts = [], {}
    for _ in range(4000):
        y = rng.random() < 0.3
        v = tuple((1 if (rng.random() < a) == y else -1) if rng.random() < 0.9 else 0 for a in acc)
        truth.append((v, y))
        counts[v] = counts.get(v, 0) + 1
    m = L.LabelModel(("a", "b", "c", "d", "e")).fit(list(counts), [float(c) for c in counts.values()])
    right = sum((m.posterior(v) >= 0.5) == y for v, y in truth) / len(truth)
    assert right > 0.95 and abs(m.prior - 0.3) < 0.05
    assert L.LabelModel().fit([], []).posterior((1,) * 7) == 0.0


def test_link(spark):
    rows = [
        (1, "H.G. San Góltaleña", "Bajérúona", "34066", "Jorcaval", T0), (2, "Hospital General San Góltaleña", "", "34066", None, T0), (3, "Hospital General San Góltaleña", "Lejos", "12345", "Otra", T0),
        (4, "Centro de Salud San Góltaleña", "Bajérúona", "34066", "Jorcaval", T0), (5, "Paseo Cordeleros, 143", "Bajérúona", "34066", "Jorcaval", T0), (6, None, None, None, None, None), (7, "Hospital General Doctor Otro", "Bajérúona", "34066", "Jorcaval", T0),
    ]
    hospitals = [("h1", "Hospital General San Góltaleña", "Bajérúona", None, "Jorcaval"), ("h2", "Clínica Montes de Loruela", "Bajérúona", "34066", "Jorcaval"), (None, "Hospital General San Góltaleña", "Bajérúona", "34066", "Jorcaval")]
    c = parse_places(spark.createDataFrame(rows, CENTRES), "nombre", "localidad", "cod_postal", "provincia")
    h = parse_places(spark.createDataFrame(hospitals, "codcnh string, nombre string, municipio string, cod_postal string, provincia string"), "nombre", "municipio", "cod_postal", "provincia")
    s = A.resolve_sites(c, "center_id", "actualizado_en")
    got = {r.center_id: r.codcnh for r in L.link(c, s, h).collect()}
    assert got == {1: "h1", 2: "h1"}
    assert L.link(c.limit(0), s, h).count() == 0


def test_p7_found(spark, sf):
    rows = L.p7_found(spark, sf).collect()
    assert len({r.center_id for r in rows}) == len(rows) and len(rows) > 0


def brute_truth(votes, rounds=U.ROUNDS):
    import math

    trust = {s: 0.8 for _, _, s, _ in votes}
    seen = None
    for at in range(rounds):
        score = {}
        for g, k, s, n in votes:
            score[g, k] = score.get((g, k), 0) + max(math.log(trust[s] / (1 - trust[s])) + 1.5, 0.05) * n
        truth = {g: max((round(v, 9), k) for (h, k), v in score.items() if h == g)[1] for g, _ in score}
        old, trust = trust, {s: max(min((sum(n for g, k, x, n in votes if x == s and truth[g] == k) + 4) / (sum(n for _, _, x, n in votes if x == s) + 5), U.MOST_TRUST), U.LEAST_TRUST) for s in trust}
        if at >= U.DAMPED:
            trust = {s: (x + old[s]) / 2 for s, x in trust.items()}
        if truth == seen:
            return truth
        seen = truth
    raise AssertionError("not settled")


@pytest.mark.parametrize("seed", range(3))
def test_discover_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    votes = sorted({(g, k, s): 0 for g, k, s in ((rng.randrange(12), rng.choice("abc"), rng.choice("wxyz")) for _ in range(90))})
    votes = [(g, k, s, rng.randrange(1, 4)) for g, k, s in votes]
    df = spark.createDataFrame([(g, "f", k, s, n, T0) for g, k, s, n in votes], "grupo long, campo string, clave string, fuente string, n long, cuando timestamp")
    truths, trust = U.discover(df)
    assert {r.grupo: r.clave for r in truths.collect()} == brute_truth(votes) and trust.count() == len({s for *_, s, _ in votes})


def test_surviving(spark):
    rows = [
        (1, 1, "reec", T0, "CLÍNICA RÍO TAL", "P", "20001", "Navaluz.", "REGION DE PENAMAR"), (1, 2, "catalogo", T0 + 900 * DAY, "Hospital General Río Tal", "P", "20001", "Navaluz", None), (1, 3, "manual", T0 + 950 * DAY, "H.G. Rio Tal, Pº Noria 3", "P", None, "Orbeira", "Región de Peñamar"),
        (2, 4, None, None, None, None, None, None, None), (2, 5, "reec", T0, "", "", "", "-", "n/a"), (3, 6, "ctis", T0, "Clínica Á", "P", "1", "X", "Y"), (3, 7, "ctis", T0, "Clínica Á", "P", "1", "X", "Y"),
    ]
    df = spark.createDataFrame(rows, "grupo long, fila long, fuente string, cuando timestamp, nombre string, localidad string, cod_postal string, provincia string, ccaa string")
    got = {(r.grupo, r.campo): r.valor for r in U.surviving(df).collect()}
    assert got[1, "nombre"] == "Hospital General Río Tal" and got[1, "provincia"] == "Navaluz" and got[1, "ccaa"] == "Región de Peñamar"
    assert not any(g == 2 for g, _ in got) and got[3, "provincia"] == "X"
    assert U.surviving(df.limit(0)).count() == 0


def test_p1_found(spark, sf):
    rows = U.p1_found(spark, sf).collect()
    assert len({(r.group_id, r.campo) for r in rows}) == len(rows) and {r.campo for r in rows} == {"nombre", "provincia", "ccaa"}


def test_damerau_symmetry():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab?") for _ in range(rng.randrange(6))) for _ in range(2))
        assert damerau(a, b) == damerau(b, a)
