import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from censo.functions import places
from censo.llm import addresses as A


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", (3, 500))
def test_towns_of_one_ending(spark, monkeypatch, most):
    """Towns of one ending share keys: with blocks of any size each meets those it may stand for, once letters were compared first."""
    monkeypatch.setattr(A, "TOWNS_PAIRWISE", most)
    rng = random.Random(3)
    stem = lambda: "".join(rng.choice("bdlmnrst") + rng.choice("aeiou") for _ in range(3))
    towns = {f"{stem()} de la vega" for _ in range(80)} | {"oro", "aro", "oros", "san jose", "san josé 2", "l'aa", "?aa"}
    towns |= {t[:i] + "x" + t[i + 2 :] for t in sorted(towns)[:30] for i in (2,)}
    count = {t: rng.randrange(1, 4) for t in towns}
    df = spark.createDataFrame([(t,) for t in sorted(towns) for _ in range(count[t])], "p_ciudad string")
    got = {(r.p_ciudad, r.c) for r in A.town_neighbours(df).select("p_ciudad", F.explode("cerca").alias("c")).collect()}
    keys = {r.p_ciudad: set(r.k) for r in df.distinct().select("p_ciudad", A._town_bands().alias("k")).collect()}
    near = {(a, b) for a, b in combinations(sorted(towns), 2) if keys[a] & keys[b] and edits(a, b) <= (3 if max(len(a), len(b)) >= 8 else 1)}
    assert len(near) > 30 and got == {(a, b) if (count[a], a) < (count[b], b) else (b, a) for a, b in near}


def test_letters_never_part_near_towns(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("aabcdelz -'?9") for _ in range(rng.randrange(1, 14)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "z", "q"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("bits", F.bit_count(A.letters(F.col("a")).bitwiseXOR(A.letters(F.col("b")))))
    assert all(r.bits <= 2 * edits(r.a, r.b) for r in df.collect())


def test_vocabulary_word_compares_few_words():
    """An unknown word is compared with the words of the vocabulary that may be within its edits only, and finds the nearest of all."""
    rng = random.Random(7)
    vocabulary = sorted(places.LONG_VOCABULARY)
    words = []
    for _ in range(300):
        w = list(rng.choice(vocabulary))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(3)] = rng.choice(["", "a", "e", "?", w[at : at + 2][::-1]])
        words.append("".join(w))
    for t in (w for w in words if len(w) >= 5 and w not in (places.KIND | places.DEDICATION | places.STREET) and w not in places.DEPARTMENT):
        allowed = 1 if len(t) < 9 else 2
        least = min((places.damerau(t, w, allowed), len(w), w) for w in vocabulary)
        if "?" not in t:
            assert places.vocabulary_word(t) == (least[2] if least[0] <= allowed else t)
    before = places.damerau.cache_info().misses
    for _ in range(300):
        places.vocabulary_word("".join(rng.choice("bcdfgjklmn") + rng.choice("aiou") for _ in range(4)))
    assert places.damerau.cache_info().misses - before < 300
