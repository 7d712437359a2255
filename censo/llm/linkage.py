"""Problem 7: matching centres and an official catalogue without a common key, with a confidence for each match.

Matching functions vote (for, against, silent) on every candidate pair; a generative label model learns by expectation maximisation how
each function votes on true and on false pairs, and models the pairs of functions that depend on each other jointly. Rows of one site pool their
votes, so a row with little of its own gets the hospital of its site. Each site takes the hospital of the largest posterior; claims of
several sites on one hospital that contradict each other share it, and what is left of the posterior is the confidence.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.functions.udf import parse_places
from censo.llm.addresses import _score, minhash_bands, near_town, parsed_centres, qgrams, resolve_sites, town_neighbours, with_places
from censo.operators.sites import compatible_code
from censo.session import at_least_partitions, cut, table

VOTERS = ("v_nombre", "v_exacto", "v_apertura", "v_tipo", "v_ciudad", "v_codigo", "v_provincia")
#: Words that at least this share of the catalogue's names (and three of them) contain tell nothing apart: 'Nuestra Señora'.
COMMON_SHARE = 0.01
#: Dependence (conditional mutual information, nats) from which two voters are modelled jointly.
DEPENDENT = 0.02


class LabelModel:
    """Generative model of votes in {-1, 0, 1} with a binary truth; voters are independent given the truth but for the joint pairs.

    Fitted on counts of vote patterns: at most 3 ** voters rows, whatever the number of candidates. Without any pattern every posterior is 0.
    """

    def __init__(self, voters: tuple[str, ...] = VOTERS) -> None:
        self.voters = voters
        self.blocks: list[tuple[int, ...]] = [(i,) for i in range(len(voters))]
        self.prior = 0.5
        self.tables: dict[tuple[tuple[int, ...], int, tuple[int, ...]], float] = {}

    def _maximise(self, patterns: list[tuple[int, ...]], counts: list[float], post: list[float]) -> None:
        total = sum(counts)
        self.prior = min(max(sum(c * p for c, p in zip(counts, post)) / total, 1e-6), 1 - 1e-6)
        self.tables = {}
        for block in self.blocks:
            for y in (0, 1):
                sums: dict[tuple[int, ...], float] = {}
                for v, c, p in zip(patterns, counts, post):
                    key = tuple(v[i] for i in block)
                    sums[key] = sums.get(key, 0.0) + c * (p if y else 1 - p)
                n, cells = sum(sums.values()), 3 ** len(block)
                for key, s in sums.items():
                    self.tables[block, y, key] = (s + 0.5) / (n + 0.5 * cells)
                self.tables[block, y, ()] = 0.5 / (n + 0.5 * cells)

    def log_odds(self, v: tuple[int, ...]) -> float:
        out = math.log(self.prior / (1 - self.prior))
        for block in self.blocks:
            key = tuple(v[i] for i in block)
            p1 = self.tables.get((block, 1, key), self.tables.get((block, 1, ()), 0.5))
            p0 = self.tables.get((block, 0, key), self.tables.get((block, 0, ()), 0.5))
            out += math.log(p1 / p0)
        return out

    def posterior(self, v: tuple[int, ...]) -> float:
        if not self.tables:
            return 0.0
        z = self.log_odds(v)
        return 1 / (1 + math.exp(-max(min(z, 700.0), -700.0)))

    def _dependence(self, i: int, j: int, patterns, counts, post) -> float:
        """Mutual information of two voters given the truth."""
        out, total = 0.0, sum(counts)
        for y in (0, 1):
            joint: dict[tuple[int, int], float] = {}
            for v, c, p in zip(patterns, counts, post):
                joint[v[i], v[j]] = joint.get((v[i], v[j]), 0.0) + c * (p if y else 1 - p)
            n = sum(joint.values())
            if n <= 0:
                continue
            a, b = {}, {}
            for (x, z), s in joint.items():
                a[x] = a.get(x, 0.0) + s
                b[z] = b.get(z, 0.0) + s
            out += (n / total) * sum(s / n * math.log(s * n / (a[x] * b[z])) for (x, z), s in joint.items() if s > 0)
        return out

    def _run(self, patterns, counts, post, rounds: int = 200) -> list[float]:
        for _ in range(rounds):
            self._maximise(patterns, counts, post)
            new = [self.posterior(v) for v in patterns]
            change = max((abs(a - b) for a, b in zip(new, post)), default=0.0)
            post = new
            if change < 1e-6:
                break
        return post

    def fit(self, patterns: list[tuple[int, ...]], counts: list[float]) -> LabelModel:
        if not patterns:
            return self
        # start from the share of votes in favour
        post = [min(max(0.5 + 0.5 * sum(v) / len(v), 0.02), 0.98) ** 2 for v in patterns]
        post = self._run(patterns, counts, post)
        scored = sorted(((self._dependence(i, j, patterns, counts, post), i, j) for i, j in combinations(range(len(self.voters)), 2)), reverse=True)
        used: set[int] = set()
        pairs = []
        for d, i, j in scored:
            if d >= DEPENDENT and not {i, j} & used:
                used |= {i, j}
                pairs.append((i, j))
        self.blocks = pairs + [(i,) for i in range(len(self.voters)) if i not in used]
        self._run(patterns, counts, post)
        return self


def vote(good: Column, bad: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), 1).when(F.coalesce(bad, F.lit(False)), -1).otherwise(0)


def common_words(listed: DataFrame) -> list[str]:
    """Words of the catalogue's names that COMMON_SHARE of them contain: at most 1 / COMMON_SHARE times the words of a mean name."""
    n = listed.count()
    counts = listed.select(F.explode(F.array_distinct("p_nucleo")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["w"] for r in counts.filter(F.col("n") >= max(3.0, COMMON_SHARE * n)).select("w").collect())


def word_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def bucketed(df: DataFrame, node: str, common: list[str]) -> DataFrame:
    """(node, k): bands of the shingles of the words that tell names apart, joined with each of ``lugares``.

    Common words are left out: they would make half of a province's names alike. Names of common words only use them.
    """
    telling = F.array_except("p_nucleo", word_array(common))
    words = F.when(F.size(telling) > 0, telling).otherwise(F.col("p_nucleo"))
    named = df.select(node, words.alias("w"), "lugares", "p_provincia").filter(F.size("w") > 0)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = named.select("w").distinct().repartition(n, "w").select("w", F.array_distinct(F.concat("w", qgrams(F.array_join("w", "")))).alias("sh")).select("w", minhash_bands(F.col("sh")).alias("bands"))
    keyed = named.join(lists.hint("merge"), "w").select(node, F.explode_outer("bands").alias("band"), "lugares").select(node, "band", F.explode(F.array_distinct("lugares")).alias("p")).select(node, F.xxhash64("band", "p").alias("k"))
    # a town too damaged for any key: the same words within a province
    same = named.filter("p_provincia <> ''").select(node, F.xxhash64(F.lit("v"), F.array_join("w", ""), "p_provincia").alias("k"))
    return keyed.unionByName(same)


def voted_pairs(centres: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Candidate pairs (s, codcnh) with the votes of every voter. ``centres`` has spellings ``s``; both sides carry the parsed columns."""
    common = common_words(hospitals)
    towns = town_neighbours(centres, hospitals)
    pairs = bucketed(with_places(centres, towns), "s", common).join(bucketed(with_places(hospitals, towns), "codcnh", common).hint("merge"), "k").select("s", "codcnh").distinct()
    parts = ("p_nucleo", "p_tipo", "p_ciudad", "p_cp", "p_provincia")
    side = lambda df, n, x: df.select(n, *(F.col(c).alias(f"{c}_{x}") for c in parts))
    p = pairs.join(side(centres, "s", "c").hint("merge"), "s").join(side(hospitals, "codcnh", "h").hint("merge"), "codcnh")
    own = lambda x, y: F.filter(f"p_nucleo_{x}", lambda w: ~F.array_contains(F.split(f"p_ciudad_{y}", " "), w))
    p = p.withColumn("parecido", F.pandas_udf(_score, "double")(own("c", "h"), own("h", "c")))
    openings = word_array(common)
    oc, oh = F.array_sort(F.array_intersect("p_nucleo_c", openings)), F.array_sort(F.array_intersect("p_nucleo_h", openings))
    near = near_town(F.col("p_ciudad_c"), F.col("p_ciudad_h"))
    both = lambda c: (F.col(f"{c}_c") != "") & (F.col(f"{c}_h") != "")
    known = F.col("p_cp_c").isNotNull() & F.col("p_cp_h").isNotNull()
    code = compatible_code(F.col("p_cp_c"), F.col("p_cp_h"))
    return p.withColumns(
        {
            "v_nombre": vote(F.col("parecido") >= 0.88, F.col("parecido") < 0.72),
            "v_exacto": vote(F.array_join("p_nucleo_c", "") == F.array_join("p_nucleo_h", ""), F.col("parecido") < 0.6),
            "v_apertura": vote(oc == oh, oc != oh),
            "v_tipo": vote(both("p_tipo") & (F.col("p_tipo_c") == F.col("p_tipo_h")), both("p_tipo") & (F.col("p_tipo_c") != F.col("p_tipo_h"))),
            "v_ciudad": vote(both("p_ciudad") & near, both("p_ciudad") & ~near),
            "v_codigo": vote(known & code, known & ~code),
            "v_provincia": vote(both("p_provincia") & (F.col("p_provincia_c") == F.col("p_provincia_h")), both("p_provincia") & (F.col("p_provincia_c") != F.col("p_provincia_h"))),
        }
    )


def link(centres: DataFrame, sites: DataFrame, hospitals: DataFrame, least: float = 0.5) -> DataFrame:
    """(center_id, codcnh, confianza): at most one hospital for every centre row that names a centre.

    ``centres``: parsed rows; ``sites``: (node, site). Kinds that the catalogue does not list at all (by family) have no candidates. Rows that
    read alike are scored once. A site votes as most of its rows do. Repeated catalogue rows of one codcnh count once; null codcnh never
    matches. Of sites that claim one hospital, one whose kind (or postcode) contradicts the catalogue competes with the best one whose kind
    (or postcode) agrees: the hospital is one house, so their posteriors are normalised together. Ties go to the greater codcnh.
    """
    parts = ["p_nucleo", "p_tipo", "p_ciudad", "p_cp", "p_provincia"]
    listed = cut(hospitals.filter("codcnh IS NOT NULL").groupBy("codcnh").agg(*(F.min(c).alias(c) for c in [*parts, "p_familia"])))
    named = centres.filter("p_nombrado").join(listed.select("p_familia").distinct().unionByName(centres.sparkSession.createDataFrame([("",)], "p_familia string")).distinct(), "p_familia", "left_semi")
    spelled = cut(named.groupBy(*parts).agg(F.min("center_id").alias("s")))
    voted = voted_pairs(spelled, listed).select("s", "codcnh", *VOTERS)
    rows = named.join(spelled.select(*parts, "s"), on=[named[c].eqNullSafe(spelled[c]) for c in parts]).select("center_id", "s")
    rows = rows.join(sites.hint("merge"), rows["center_id"] == sites["node"], "left").select("center_id", "s", F.coalesce("site", "center_id").alias("site"))
    rows = cut(rows)
    copies = rows.groupBy("site", "s").agg(F.count(F.lit(1)).alias("n"))
    pooled = copies.join(voted.hint("merge"), "s").groupBy("site", "codcnh").agg(*(F.signum(F.sum(F.col(v) * F.col("n"))).cast("int").alias(v) for v in VOTERS), F.sum("n").alias("n"))
    pooled = cut(pooled)
    weights = pooled.groupBy(*VOTERS).agg(F.sum("n").alias("n")).orderBy(*VOTERS).collect()  # at most 3 ** 7 rows
    patterns = [tuple(r[v] for v in VOTERS) for r in weights]
    model = LabelModel().fit(patterns, [float(r["n"]) for r in weights])
    odds = {p: max(min(model.log_odds(p), 30.0), -30.0) for p in patterns}

    def score(*votes: pd.Series) -> pd.Series:
        return pd.Series([odds.get(tuple(int(x) for x in v), -30.0) for v in zip(*votes)], dtype="float64")

    scored = pooled.select("site", "codcnh", "v_tipo", "v_codigo", F.pandas_udf(score, "double")(*VOTERS).alias("z"))
    chosen = cut(scored.groupBy("site").agg(F.max(F.struct("z", "codcnh", "v_tipo", "v_codigo")).alias("x")).select("site", "x.*").filter("z > 0"))
    best = lambda v: F.max(F.when(F.col(v) == 1, F.col("z"))).alias(f"z_{v}")
    chosen = chosen.join(chosen.groupBy("codcnh").agg(best("v_tipo"), best("v_codigo")).hint("merge"), "codcnh")
    rival = lambda v: F.when((F.col(v) == -1) & F.col(f"z_{v}").isNotNull(), F.exp(F.col(f"z_{v}") - F.col("z"))).otherwise(F.lit(0.0))
    conf = 1 / (1 + F.exp(-F.col("z")) + rival("v_tipo") + rival("v_codigo"))
    chosen = chosen.select("site", "codcnh", conf.alias("confianza")).filter(F.col("confianza") >= least)
    return rows.join(chosen.hint("merge"), "site").select("center_id", "codcnh", "confianza")


def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every centre row with its hospital and the confidence of the match."""
    centres = parsed_centres(spark, sf_dir)
    sites = cut(resolve_sites(centres, "center_id", "actualizado_en"))
    listed = at_least_partitions(table(spark, sf_dir, "hospitals").select("codcnh", "nombre", "municipio", "cod_postal", "provincia"))
    hospitals = cut(parse_places(listed, "nombre", "municipio", "cod_postal", "provincia"))
    return link(centres, sites, hospitals).select("center_id", "codcnh", F.round("confianza", 4).alias("confianza"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each centre row that the catalogue lists, with its hospital."""
    return p7_links(spark, sf_dir).select("center_id", "codcnh")
