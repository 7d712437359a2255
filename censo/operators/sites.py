"""Rows of a register to sites: one centre at one address.

``place_links`` proposes links by keys (same name and town, or same name and postcode, names within one deletion), ``settle`` turns verified
links of any origin into sites: connected components, parted where postcodes differ by more than a slip, and where two kinds of centre
are in use at the same time (a renamed centre changes its kind once; two neighbours of the same name keep theirs side by side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censo.operators.components import connected_components
from censo.session import cut


def name_text() -> Column:
    """The words of the parsed name that tell centres apart, as one text."""
    return F.array_join("p_nucleo", "")


#: From this length on, a text is keyed by its two ends instead of its deletions, whose total length grows with the square.
LONG = 60


def deletions(text: Column) -> Column:
    """Keys that texts one edit apart share: the text and its forms with one character left out; short texts only themselves.

    A text longer than LONG has its first and its last LONG / 2 characters as keys: one edit leaves one of them intact, but they do not prove
    that two texts are alike, so links of long texts are verified.
    """
    n = F.length(text)
    half = LONG // 2
    ends = F.array(F.concat(F.substring(text, 1, half), F.lit("|")), F.concat(F.lit("|"), F.substring(text, -half, half)))
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.when(n > LONG, ends).when(n >= 6, F.array_distinct(F.concat(F.array(text), cuts))).otherwise(F.array(text))


def long_alike(a: Column, b: Column) -> Column:
    """False for two long texts more than two edits apart, true otherwise."""
    return ((F.length(a) <= LONG) & (F.length(b) <= LONG)) | (F.levenshtein(a, b, 2) >= 0)


def mend_towns(rows: DataFrame, least_ratio: int = 2) -> DataFrame:
    """``rows`` with a mistyped p_ciudad replaced by the town it stands for.

    A spelling counts as a slip of another one when both share a form with one letter left out (one edit, swap or unreadable letter) and the
    other has at least ``least_ratio`` times its rows. Work is on distinct spellings with their counts, not on rows.
    """
    towns = rows.filter("p_ciudad <> ''").groupBy("p_ciudad").agg(F.count(F.lit(1)).alias("n"))
    keyed = towns.select("p_ciudad", "n", F.explode_outer(deletions(F.col("p_ciudad"))).alias("d"))
    best = keyed.groupBy("d").agg(F.max(F.struct("n", "p_ciudad")).alias("best"))
    mended = keyed.join(best.hint("merge"), "d").filter((F.col("best.p_ciudad") != F.col("p_ciudad")) & long_alike(F.col("best.p_ciudad"), F.col("p_ciudad")) & (F.col("best.n") >= F.col("n") * least_ratio)).groupBy("p_ciudad").agg(F.max("best").alias("to")).select("p_ciudad", F.col("to.p_ciudad").alias("_to"))
    return rows.join(mended.hint("merge"), "p_ciudad", "left").withColumn("p_ciudad", F.coalesce("_to", "p_ciudad")).select(*rows.columns)


def place_keys() -> Column:
    """Keys of the place of a parsed row: its town and its postcode, as far as known."""
    return F.array_compact(F.array(F.when(F.col("p_ciudad") != "", F.concat(F.lit("t:"), "p_ciudad")), F.when(F.col("p_cp").isNotNull(), F.concat(F.lit("c:"), "p_cp"))))


def compatible_code(a: Column, b: Column) -> Column:
    """Postcodes that may be one: either unknown, equal, or one digit or one swap apart."""
    return a.isNull() | b.isNull() | (F.levenshtein(a, b) <= 1) | ((F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))))


def star_links(keyed: DataFrame, key: str, node: str) -> DataFrame:
    """Links from every node to the smallest node of each of its keys: as many as rows, whatever the size of a group."""
    least = keyed.groupBy(key).agg(F.min(node).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(least.hint("merge"), key).filter(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b").distinct()


def near_code_links(keyed: DataFrame, node: str) -> DataFrame:
    """Links (a, b) between the smallest nodes of any two codes of a key ``k`` that are one digit or one swap apart.

    Whatever the smallest node of the key is, codes that may be one thus meet. Candidates share a form with one digit left out or have the
    same digits; work is on the distinct codes of a key, not on rows.
    """
    codes = keyed.filter(F.col("p_cp").isNotNull()).groupBy("k", "p_cp").agg(F.min(node).alias("s"))
    several = codes.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    cuts = F.transform(F.sequence(F.lit(1), F.length("p_cp")), lambda i: F.concat(F.substring(F.col("p_cp"), F.lit(1), i - 1), F.substring(F.col("p_cp"), i + 1, F.length("p_cp"))))
    near = F.concat(F.array(F.col("p_cp"), F.concat(F.lit("s:"), F.array_join(F.array_sort(F.split("p_cp", "")), ""))), cuts)
    near = codes.join(several.hint("merge"), "k").filter("p_cp <> ''").select("k", "p_cp", "s", F.explode(F.array_distinct(near)).alias("c"))
    a, b = near.select("k", "c", F.col("p_cp").alias("ca"), F.col("s").alias("a")), near.select("k", "c", F.col("p_cp").alias("cb"), F.col("s").alias("b"))
    return a.join(b.hint("merge"), ["k", "c"]).filter((F.col("ca") < F.col("cb")) & (F.col("a") != F.col("b")) & compatible_code(F.col("ca"), F.col("cb"))).select("a", "b")


def place_links(rows: DataFrame, node: str) -> DataFrame:
    """Links (a, b) between rows of parsed names at a common place whose names are equal up to one slip.

    Groups of one key are linked as stars, so no group is expanded into pairs. Rows without name or place have no link.
    """
    parts = ["_t", "_f", "p_ciudad", "p_cp"]
    named = rows.filter("p_nombrado").select(node, name_text().alias("_t"), F.col("p_familia").alias("_f"), "p_ciudad", "p_cp")
    # rows that agree in all that is compared are one spelling, tied to its smallest row
    spelled = cut(named.groupBy(*parts).agg(F.min(node).alias("s")))
    copies = named.join(spelled.hint("merge"), on=[named[p].eqNullSafe(spelled[p]) for p in parts]).filter(F.col(node) != F.col("s")).select(F.col(node).alias("a"), F.col("s").alias("b"))
    forms = spelled.select("_t").distinct().select("_t", F.explode_outer(deletions(F.col("_t"))).alias("_d"))
    keyed = spelled.select("s", "_t", "_f", "p_cp", F.explode(place_keys()).alias("_p")).join(forms.hint("merge"), "_t").select("s", "_d", "_f", "_p", "p_cp")
    # inside a town, codes that are no slip of each other are different sites: a row meets the rows of its own code as well
    code = F.explode(F.when(F.col("p_cp").isNull(), F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.col("p_cp"))))
    full = keyed.withColumn("_c", code).select("s", F.xxhash64("_d", "_f", "_p", "_c").alias("k"))
    links = cut(star_links(full, "k", "s").unionByName(near_code_links(keyed.withColumn("k", F.xxhash64("_d", "_f", "_p")), "s")).distinct())
    side = lambda x: spelled.select(F.col("s").alias(x), F.col("p_cp").alias(f"c{x}"), F.col("_t").alias(f"t{x}"))
    near = links.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter(compatible_code(F.col("ca"), F.col("cb")) & long_alike(F.col("ta"), F.col("tb"))).select("a", "b")
    return copies.unionByName(near)


def settle(rows: DataFrame, links: DataFrame, node: str, when: str) -> DataFrame:
    """(node, site) for every linked row of ``rows``.

    ``rows`` carries the parsed columns; ``when`` is the time a row was last confirmed. Rows that stay ambiguous after a component was parted
    (no postcode in a component of several, no kind among several) stand alone. Null times count as no evidence of use.
    """
    comp = cut(connected_components(links, "a", "b"))
    r = rows.select(F.col(node).alias("node"), "p_cp", "p_tipo", F.col(when).alias("_w")).join(comp.hint("merge"), "node")
    # codes of a component: a rarer one within one slip of a more frequent one counts as that one
    codes = r.filter(F.col("p_cp").isNotNull()).groupBy("component", "p_cp").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("component").orderBy(F.desc("n"), "p_cp").rowsBetween(W.unboundedPreceding, -1)
    ranked = codes.withColumn("before", F.collect_list("p_cp").over(by))
    code = ranked.withColumn("code", F.coalesce(F.get(F.filter("before", lambda x: compatible_code(x, F.col("p_cp"))), F.lit(0)), F.col("p_cp"))).select("component", "p_cp", "code")
    n_codes = code.groupBy("component").agg(F.countDistinct("code").alias("n_codes"), F.min("code").alias("only"))
    r = r.join(code.hint("merge"), ["component", "p_cp"], "left").join(n_codes.hint("merge"), "component", "left")
    r = r.withColumn("code", F.when(F.coalesce("n_codes", F.lit(0)) <= 1, F.coalesce("only", F.lit(""))).otherwise(F.coalesce("code", F.concat(F.lit("?"), F.col("node").cast("string"))))).drop("n_codes", "only")
    r = cut(r)  # small plans: the driver keeps every plan and re-plans it at each stage
    # kinds of a part: those in use at the same time are different centres
    kinds = r.filter(F.col("p_tipo") != "").groupBy("component", "code", "p_tipo").agg(F.min("_w").alias("lo"), F.max("_w").alias("hi"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("component", "code").orderBy("lo", "hi", "p_tipo")
    kinds = kinds.withColumn("prev_hi", F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)))
    clash = F.coalesce(F.col("lo") <= F.col("prev_hi"), F.lit(False))
    kinds = kinds.withColumn("part", F.sum(clash.cast("int")).over(w)).withColumn("parts", F.max("part").over(W.partitionBy("component", "code")))
    part = kinds.select("component", "code", "p_tipo", "part")
    several = kinds.groupBy("component", "code").agg(F.max("part").alias("parts"))
    r = r.join(part.hint("merge"), ["component", "code", "p_tipo"], "left").join(several.hint("merge"), ["component", "code"], "left")
    part_key = F.when(F.coalesce("parts", F.lit(0)) == 0, F.lit("0")).otherwise(F.coalesce(F.col("part").cast("string"), F.concat(F.lit("?"), F.col("node").cast("string"))))
    r = cut(r.withColumn("part", part_key).select("node", "component", "code", "part"))
    # aggregated and joined back, so that a component with a large share of all rows is no single task
    least = r.groupBy("component", "code", "part").agg(F.min("node").alias("site"))
    return r.join(least.hint("merge"), ["component", "code", "part"]).select("node", "site")
