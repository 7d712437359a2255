"""Problem 4: the same postal address written differently.

Candidates come from MinHash banding on the words and q-grams of the parsed centre name (or of street and number), each band joined with a
key of the place; every candidate is verified by an affine-gap alignment of its words, whose substitution costs know abbreviations. The
links are settled into sites by the core.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.functions import places
from censo.functions.udf import parse_places
from censo.operators.components import thin_links
from censo.operators.sites import compatible_code, mend_towns, place_keys, settle
from censo.session import at_least_partitions, cut, table

BANDS, ROWS = 20, 2
#: Larger buckets are compared block against block, of about so many spellings each.
PAIRWISE = 24
#: As PAIRWISE, of towns: their pairs cost a comparison of two numbers, so that fewer and larger blocks are cheaper than more copies.
TOWNS_PAIRWISE = 500
LEAST_SCORE = 0.72
GAP_OPEN, GAP_EXTEND = 0.45, 0.25

# Abbreviations of words inside names.
SHORT_FORMS = {**places.DEDICATION, **places.KIND}


def minhash_bands(shingles: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """Band keys of an array of shingles: each the hash of the minima of ``rows`` seeded hashes. JVM-side, no signature is kept."""
    def least(seed: Column) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, seed)))

    # one expression over the band numbers: unrolled, the plan would carry bands * rows copies of the shingles' expression
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *(least(b * rows + r) for r in range(rows))))


def qgrams(text: Column, q: int = 2) -> Column:
    """Overlapping q-grams of the text between two marks, in one pass over it."""
    return F.regexp_extract_all(F.concat(F.lit("_"), text, F.lit("_")), F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def _town_bands(keys: int = 4) -> Column:
    """Keys of a town that survive slips: each two minima of its 3-grams, rare enough to stay small as towns grow."""
    grams = qgrams(F.col("p_ciudad"), 3)
    least = lambda seed: F.array_min(F.transform(grams, lambda g: F.xxhash64(g, seed)))
    return F.transform(F.sequence(F.lit(0), F.lit(keys - 1)), lambda i: F.xxhash64(i, least(i * 2), least(i * 2 + 1)))


def near_town(a: Column, b: Column) -> Column:
    """Two known towns up to the slips no correction has mended."""
    long = (F.length(a) >= 8) | (F.length(b) >= 8)
    return (a != "") & (b != "") & F.when(long, F.levenshtein(a, b, 3) >= 0).otherwise(F.levenshtein(a, b, 1) >= 0)


def letters(text: Column) -> Column:
    """A bit for each letter a to z that the text has, and one for each it has twice: an edit changes two bits at most."""
    def add(seen: Column, x: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(x) - F.ascii(F.lit("a")))
        twice = F.call_function("shiftleft", seen.bitwiseAND(bit), F.lit(26))
        return F.when(x.between("a", "z"), seen.bitwiseOR(bit).bitwiseOR(twice)).otherwise(seen)

    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), add)


def town_neighbours(*tables: DataFrame) -> DataFrame:
    """(p_ciudad, cerca): every town that is near more frequent ones (in all tables) with those; equally frequent ones by name.

    Works on distinct towns, so that rows need the keys of their own town and, if it is a slip, of the towns it may stand for. A key that many
    towns share ('de la vega') is compared block against block, and only towns whose letters allow it are compared letter by letter.
    """
    each = [t.filter("p_ciudad <> ''").select("p_ciudad") for t in tables]
    towns = reduce(DataFrame.unionByName, each).groupBy("p_ciudad").agg(F.count(F.lit(1)).alias("n"))
    town = F.struct("p_ciudad", "n", letters(F.col("p_ciudad")).alias("l"), F.length("p_ciudad").alias("m"))
    keyed = cut(towns.select(F.explode_outer(_town_bands()).alias("k"), town.alias("town")).select("k", "town.*"))
    may = (F.abs(F.col("m_a") - F.col("m_b")) <= 3) & (F.bit_count(F.col("l_a").bitwiseXOR(F.col("l_b"))) <= 6)
    near = blocks(keyed, "p_ciudad", [], ["n", "l", "m"], TOWNS_PAIRWISE, may & near_town(F.col("a"), F.col("b")))
    # of a pair, the less frequent town is the slip
    less = F.col("n_a") <= F.col("n_b")
    slips = near.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("p_ciudad"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("cerca"))
    return cut(slips.groupBy("p_ciudad").agg(F.collect_set("cerca").alias("cerca")))


def with_places(rows: DataFrame, towns: DataFrame) -> DataFrame:
    """``rows`` with ``lugares``: the keys of their town, of the towns it may stand for, and of their postcode."""
    near = F.transform(F.coalesce("cerca", F.array().cast("array<string>")), lambda t: F.concat(F.lit("t:"), t))
    return rows.join(towns.hint("merge"), "p_ciudad", "left").withColumn("lugares", F.concat(place_keys(), near)).drop("cerca")


@lru_cache(maxsize=500_000)
def word_cost(a: str, b: str) -> float:
    """0 for the same word or a word and its abbreviation, up to 1 by edit distance; an initial costs little against its word."""
    if a == b or SHORT_FORMS.get(a, a) == SHORT_FORMS.get(b, b):
        return 0.0
    n = max(len(a), len(b))
    if min(len(a), len(b)) == 1 and a[0] == b[0]:
        return 0.3
    d = places.damerau(a, b, 3)
    return 1.0 if d > 3 or d * 2.5 > n else min(1.0, 1.2 * d / n)


def align(a: list[str], b: list[str]) -> float:
    """Similarity in 0..1 of two word lists by global alignment with affine gaps, weighted by word length (Gotoh).

    1 for equal lists or lists equal up to abbreviations; two empty lists have similarity 0.
    """
    if not a or not b:
        return 0.0
    # spacing slips: compare the texts run together as well
    ta, tb = "".join(a), "".join(b)
    d = places.damerau(ta, tb, 3)
    joined = 1.0 - 1.6 * d / max(len(ta), len(tb), 6) if d <= 3 else 0.0
    big = 1e9
    wa, wb = [min(len(x), 8) for x in a], [min(len(x), 8) for x in b]
    m, n = len(a), len(b)
    M = [[big] * (n + 1) for _ in range(m + 1)]
    X = [[big] * (n + 1) for _ in range(m + 1)]
    Y = [[big] * (n + 1) for _ in range(m + 1)]
    M[0][0] = 0.0
    for i in range(m + 1):
        for j in range(n + 1):
            if i and j:
                M[i][j] = min(M[i - 1][j - 1], X[i - 1][j - 1], Y[i - 1][j - 1]) + word_cost(a[i - 1], b[j - 1]) * (wa[i - 1] + wb[j - 1])
            if i:
                X[i][j] = min(min(M[i - 1][j], Y[i - 1][j]) + GAP_OPEN * 2 * wa[i - 1], X[i - 1][j] + GAP_EXTEND * 2 * wa[i - 1])
            if j:
                Y[i][j] = min(min(M[i][j - 1], X[i][j - 1]) + GAP_OPEN * 2 * wb[j - 1], Y[i][j - 1] + GAP_EXTEND * 2 * wb[j - 1])
    cost = min(M[m][n], X[m][n], Y[m][n])
    return max(joined, 1.0 - cost / (sum(wa) + sum(wb)))


def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}

    def one(x, y) -> float:
        key = (tuple(x) if x is not None else (), tuple(y) if y is not None else ())
        if key not in seen:
            seen[key] = align(list(key[0]), list(key[1]))
        return seen[key]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def blocks(keyed: DataFrame, what: str, carry: list[str], both: list[str] | None = None, most: int = PAIRWISE, when: Column | None = None) -> DataFrame:
    """(a, b, carry...): all pairs a < b of ``what`` that share a key ``k``; a key of more than ``most`` is compared block against block.

    ``carry`` are columns that the key determines, ``both`` columns of each side (x_a, x_b). Only pairs that fulfil ``when`` are given, a condition
    on a, b and these that is the same for (b, a).
    """
    both = both or []
    size = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", F.ceil(F.col("n") / most).cast("int").alias("of"))
    cells = keyed.join(size.hint("merge"), "k").withColumn("at_block", F.pmod(F.xxhash64(what), F.col("of")).cast("int"))
    # a block meets itself and each later one, so that no two blocks meet twice
    later, earlier = F.sequence(F.col("at_block"), F.col("of") - 1), F.sequence(F.lit(0), F.col("at_block"))
    side = lambda x: (F.col(what).alias(x), *(F.col(c).alias(f"{c}_{x}") for c in both))
    left = cells.select("k", F.col("at_block").alias("i"), F.explode(later).alias("j"), *carry, *side("a"))
    right = cells.select("k", F.explode(earlier).alias("i"), F.col("at_block").alias("j"), *side("b"))
    pairs = left.join(right.hint("merge"), ["k", "i", "j"]).filter("i < j OR a < b")
    pairs = pairs if when is None else pairs.filter(when)
    first = lambda c: F.when(F.col("a") < F.col("b"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_a")
    last = lambda c: F.when(F.col("a") < F.col("b"), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *carry, *(f(c) for c in both for f in (first, last)))


def candidates(spellings: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of ``s`` of spellings (s, w, g, lugares, p_provincia): those of one group ``g`` that share a band of their words' shingles and a place.

    Bands belong to word lists and are compared once for all spellings of a list at a place. Every pair of a bucket is a candidate; a large
    bucket is cut into blocks that are compared each with each, so that no task holds a whole bucket. Spellings of the same words at one place,
    or in one province where a town is too damaged for any key, are candidates as well; those without words are not.
    """
    n = int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = spellings.filter(F.size("w") > 0).withColumn("c", F.xxhash64("w", "g"))
    at = known.select("s", "c", F.explode(F.array_distinct("lugares")).alias("at")).select("s", "c", F.xxhash64("at").alias("at"))
    # a column of its own: inside the bands' expression the shingles would be built again for every hash; a fixed number of parts: small rows, much work
    lists = known.select("c", "g", "w").distinct().repartition(n, "c").select("c", "g", F.array_distinct(F.concat("w", qgrams(F.array_join("w", "")))).alias("sh"))
    lists = lists.select("c", F.transform(minhash_bands(F.col("sh")), lambda b: F.xxhash64(b, F.col("g"))).alias("bands"))
    keyed = at.select("c", "at").distinct().join(lists.hint("merge"), "c").select("c", "at", F.explode_outer("bands").alias("band")).select("c", "at", F.xxhash64("band", "at").alias("k"))
    lists_near = blocks(cut(keyed), "c", ["at"]).distinct()
    side = lambda x: at.select("at", F.col("c").alias(x), F.col("s").alias(f"s{x}"))
    pairs = lists_near.join(side("a").hint("merge"), ["at", "a"]).join(side("b").hint("merge"), ["at", "b"]).select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    same = at.select("s", F.xxhash64("c", "at").alias("k")).unionByName(known.filter("p_provincia <> ''").select("s", F.xxhash64("c", F.lit("v"), "p_provincia").alias("k")))
    return cut(pairs.unionByName(blocks(same, "s", [])).distinct())  # small plans: the driver keeps every plan and re-plans it at each stage


PARTS = ["por", "p_nucleo", "p_familia", "p_ciudad", "p_cp", "p_calle", "p_numero", "p_nombrado"]


def address_links(rows: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """(copies, links): copies tied to the smallest row of their spelling, and links with the components of the verified pairs of spellings.

    A named row is spelled by its name and place (``por`` 'n'), a row with street and number by these as well ('c'). Rows that agree in every
    part a link is verified on are one spelling, so copies cost nothing downstream. Null parts are unknown and contradict nothing; a row without
    any name, street or place has no link.
    """
    rows = rows.filter("(p_nombrado OR p_calle <> '') AND (p_ciudad <> '' OR p_cp IS NOT NULL)")
    by_name = rows.filter("p_nombrado").withColumn("por", F.lit("n")).withColumn("p_calle", F.lit("")).withColumn("p_numero", F.lit(""))
    by_street = rows.filter("p_calle <> '' AND p_numero <> ''").withColumn("por", F.lit("c"))
    both = by_name.select(node, "p_provincia", *PARTS).unionByName(by_street.select(node, "p_provincia", *PARTS))
    spelled = with_places(both.groupBy(*PARTS).agg(F.min(node).alias("id"), F.max("p_provincia").alias("p_provincia")), town_neighbours(rows))
    named = F.col("por") == "n"
    words = F.when(named, F.col("p_nucleo")).otherwise(F.array_append(F.split("p_calle", " "), F.col("p_numero")))
    spelled = cut(spelled.select(*PARTS, "id", "p_provincia", "lugares", F.concat("por", F.col("id").cast("string")).alias("s"), words.alias("w"), F.when(named, F.col("p_familia")).otherwise(F.lit("calle")).alias("g")))
    copies = both.join(spelled.select(*PARTS, "id").hint("merge"), on=[both[p].eqNullSafe(spelled[p]) for p in PARTS]).filter(F.col(node) != F.col("id")).select(F.col(node).alias("a"), F.col("id").alias("b"))
    side = lambda x: spelled.select(F.col("s").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in [*PARTS, "id"]))
    pairs = candidates(spelled).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter(compatible_code(F.col("p_cp_a"), F.col("p_cp_b")))
    ta, tb = F.col("p_ciudad_a"), F.col("p_ciudad_b")
    same_code = F.coalesce(F.col("p_cp_a") == F.col("p_cp_b"), F.lit(False))
    pairs = pairs.filter(near_town(ta, tb) | (same_code & ((ta == "") | (tb == "")))).filter("por_a = 'n' OR (p_numero_a = p_numero_b AND (NOT p_nombrado_a OR NOT p_nombrado_b))")
    # a town's name at the end of a centre's name is no part of it
    own = lambda x, y: F.when(F.col(f"p_ciudad_{x}") == "", F.filter(f"p_nucleo_{x}", lambda w: ~F.array_contains(F.split(f"p_ciudad_{y}", " "), w))).otherwise(F.col(f"p_nucleo_{x}"))
    text = lambda x, y: F.when(F.col("por_a") == "n", own(x, y)).otherwise(F.split(f"p_calle_{x}", " "))
    verified = pairs.withColumn("score", F.pandas_udf(_score, "double")(text("a", "b"), text("b", "a"))).filter(F.col("score") >= LEAST_SCORE)
    return copies.distinct(), thin_links(cut(verified.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).filter("a <> b")), "a", "b")


def resolve_sites(rows: DataFrame, node: str, when: str) -> DataFrame:
    """(node, site): rows of ``rows`` (parsed columns included) at one address of one centre."""
    copies, links = address_links(rows, node)
    return settle(rows, cut(copies.unionByName(links)), node, when)


CENTRE_COLUMNS = ("center_id", "nombre", "localidad", "cod_postal", "provincia", "ccaa", "actualizado_en")


def parsed_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at_least_partitions(table(spark, sf_dir, "centers").select(*CENTRE_COLUMNS))
    return cut(mend_towns(cut(parse_places(rows, "nombre", "localidad", "cod_postal", "provincia", "ccaa"))))


def p4_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(center_id, sitio): every linked centre row with the smallest center_id of its address, and the number of its rows in ``filas``."""
    sites = cut(resolve_sites(parsed_centres(spark, sf_dir), "center_id", "actualizado_en"))
    n = sites.groupBy("site").agg(F.count(F.lit(1)).alias("filas"))
    return sites.join(n.hint("merge"), "site").select(F.col("node").alias("center_id"), F.col("site").alias("sitio"), "filas")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of centre rows at one address, but for pairs a reviewer already grouped."""
    sites = cut(resolve_sites(parsed_centres(spark, sf_dir), "center_id", "actualizado_en"))
    groups = table(spark, sf_dir, "center_groups").groupBy("center_id").agg(F.min("group_id").alias("g"))
    at = sites.join(groups.hint("merge"), sites["node"] == groups["center_id"], "left").select("node", "site", "g")
    a, b = at.select("site", F.col("node").alias("center_id_a"), F.col("g").alias("ga")), at.select("site", F.col("node").alias("center_id_b"), F.col("g").alias("gb"))
    return a.join(b.hint("merge"), "site").filter("center_id_a < center_id_b AND NOT coalesce(ga = gb, false)").select("center_id_a", "center_id_b")
