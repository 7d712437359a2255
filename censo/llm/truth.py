"""Problem 1: one surviving record per group of duplicates, by iterative truth discovery.

Every row claims a value for every field. The reliability of each source is estimated field by field from its agreement with the current
truths, the truths from the votes of the sources weighted by reliability and recency, in turn until nothing changes. Claims are compared by
a key (folded, parsed), and the surviving spelling is the most proper one among the rows that claim the true key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censo.functions import places
from censo.functions.udf import kind_name
from censo.session import cut, table

#: Rounds after which a discovery that has not converged is an error; from DAMPED on reliabilities move half way only, which ends cycles.
ROUNDS, DAMPED = 40, 8
#: Half-life of a claim on a value that changes in time, in days.
HALF_LIFE_DAYS = 120.0
#: A source's reliability lies between these.
LEAST_TRUST, MOST_TRUST = 0.05, 0.98

# Nouns that open a centre's name; adjectives ('general', 'universitario') follow them.
NOUNS = frozenset("hospital clinica centro instituto complejo".split())
FULL_WORDS = frozenset(places.KIND.values())


def properness(name: str | None, town: str | None = None) -> int:
    """How proper and full a centre's spelling is: higher is better, below 0 for damaged text. Null gives -100."""
    if not name or places.is_missing(name):
        return -100
    score = 0
    if re.search(r"[?�&;]|[ÃÂ][\u0080-¿]|  ", name) or name != name.strip():
        score -= 40
    words = name.split()
    small = {"de", "del", "la", "las", "los", "el", "y", "i", "d'"}
    if name == name.upper() or name == name.lower() or any(w[0].islower() and w.lower() not in small for w in words if w[0].isalpha()):
        score -= 25
    score -= 12 * len(re.findall(r"[,;()./:]| - |[0-9]", name))
    folded = [places.fold(w).strip(".,;()'") for w in words]
    score += 20 if folded and folded[0] in NOUNS else 0
    for f in folded:
        canonical = places.KIND.get(f) or places.DEDICATION.get(f)
        if f in places.KIND_SHORT or (canonical and canonical != f) or f in ("ns", "s", "n", "nª", "sª"):
            score -= 15
        if f in ("clinico", "zona", "complejo", "asistencial", "servicio", "dpto", "unidad", "sº"):
            score -= 6
        if f not in FULL_WORDS and places.vocabulary_word(f) in FULL_WORDS:
            score -= 15
    c = places.parse_centre(name, town)
    score -= 15 * len(c.tail) + 15 * (len(c.street) > 0) + 30 * (not c.named)
    accents = sum(ch not in places.fold(ch) for ch in name if ch.isalpha() and not ch.isupper()) + sum(ch in "ÑÁÉÍÓÚÀÈÒÇ" for ch in name)
    return score + 3 * accents


def plainness(value: str | None) -> int:
    """How proper a region's spelling is: mixed case, accents, no edge marks."""
    if not value or places.is_missing(value):
        return -100
    score = -20 if value != value.strip(" .,;") else 0
    score -= 20 if value in (value.upper(), value.lower()) else 0
    return score - 40 * ("?" in value) + 3 * sum(places.fold(ch) != ch.lower() for ch in value)


CLAIMS = T.StructType(
    [
        T.StructField("grupo", T.LongType()), T.StructField("fila", T.LongType()), T.StructField("fuente", T.StringType()), T.StructField("cuando", T.TimestampType()),
        T.StructField("campo", T.StringType()), T.StructField("clave", T.StringType()), T.StructField("texto", T.StringType()), T.StructField("limpio", T.IntegerType()),
    ]
)


def claims_of(rows: DataFrame) -> DataFrame:
    """Claims of centre rows (grupo, fila, fuente, cuando, nombre, localidad, cod_postal, provincia, ccaa): one per field that is not missing.

    A name makes two claims: 'tipo', the kind of centre, and 'nucleo', the words that tell it from others; a postcode claims its prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cols = {n: [] for n in CLAIMS.names}

            def add(row, campo, clave, texto, limpio):
                for n, v in zip(CLAIMS.names, (*row, campo, clave, texto, limpio)):
                    cols[n].append(v)

            data = [part.column(i).to_pylist() for i in range(part.num_columns)]
            for g, i, f, w, name, town, cp, prov, region in zip(*data):
                row = (g, i, f, w)
                c = places.parse_centre(name, town)
                if c.named:
                    kind = kind_name(c.kind)
                    if kind:
                        add(row, "tipo", kind, name, properness(name, town))
                    add(row, "nucleo", "".join([*c.opening, *c.stems]), name, properness(name, town))
                code = places.postcode(cp)
                if code:
                    add(row, "prefijo", code[:2], code, 0)
                for campo, value in (("provincia", prov), ("ccaa", region)):
                    key = places.region_key(value)
                    if key:
                        add(row, campo, key, value, plainness(value))
            types = [pa.int64(), pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(CLAIMS.names, types)], CLAIMS.names)

    return rows.select(
        F.col("grupo").cast("bigint"), F.col("fila").cast("bigint"), F.coalesce("fuente", F.lit("")).alias("fuente"), F.col("cuando").cast("timestamp"),
        *(F.col(c).cast("string") for c in ("nombre", "localidad", "cod_postal", "provincia", "ccaa")),
    ).mapInArrow(run, CLAIMS)


def discover(votes: DataFrame, changing: Column | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(truths, trust): the winning (grupo, campo, clave, apoyo) and the final reliability (fuente, campo, fiabilidad).

    ``votes``: (grupo, campo, clave, fuente, n, cuando): n claims of a source for a key, the last at ``cuando``. Where ``changing`` holds, a
    vote halves with every HALF_LIFE_DAYS before the newest of its group and field. A source's reliability is its (smoothed) share of claims
    that agree with the truths; its vote weighs log odds. Ties go to the newer, then to the greater key. Fully distributed; only the table of
    sources is small. Converged when no truth changes; raises if ``rounds`` do not get there.
    """
    w = W.partitionBy("grupo", "campo")
    age = F.coalesce((F.unix_micros(F.max("cuando").over(w)) - F.unix_micros("cuando")) / F.lit(8.64e10), F.lit(36500.0))
    fresh = F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS)
    v = cut(votes.withColumn("frescura", F.when(changing, fresh).otherwise(F.lit(1.0)) if changing is not None else F.lit(1.0)))
    trust = v.select("fuente", "campo").distinct().withColumn("fiabilidad", F.lit(0.8))
    seen = None
    for at in range(rounds):
        weighted = v.join(trust, ["fuente", "campo"])
        weight = F.log(F.col("fiabilidad") / (1 - F.col("fiabilidad"))) + F.lit(1.5)
        score = weighted.groupBy("grupo", "campo", "clave").agg(F.sum(F.greatest(weight, F.lit(0.05)) * F.col("n") * F.col("frescura")).alias("apoyo"), F.max("cuando").alias("cuando"))
        best = score.groupBy("grupo", "campo").agg(F.max_by(F.struct("clave", "apoyo"), F.struct(F.round("apoyo", 9), "cuando", "clave")).alias("b"))
        truths = cut(best.select("grupo", "campo", F.col("b.clave").alias("verdad"), F.col("b.apoyo").alias("apoyo")))
        state = truths.agg(F.sum(F.xxhash64("grupo", "campo", "verdad").cast("decimal(38,0)"))).first()[0]
        agreed = v.join(truths, ["grupo", "campo"]).groupBy("fuente", "campo").agg(((F.sum(F.when(F.col("clave") == F.col("verdad"), F.col("n")).otherwise(0)) + 4.0) / (F.sum("n") + 5.0)).alias("fiabilidad"))
        new = agreed.select("fuente", "campo", F.greatest(F.least("fiabilidad", F.lit(MOST_TRUST)), F.lit(LEAST_TRUST)).alias("fiabilidad"))
        if at >= DAMPED:
            old = trust.withColumnRenamed("fiabilidad", "antes")
            new = new.join(old, ["fuente", "campo"]).select("fuente", "campo", ((F.col("fiabilidad") + F.col("antes")) / 2).alias("fiabilidad"))
        trust = cut(new)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"truths did not settle in {rounds} rounds")
    return truths.withColumnRenamed("verdad", "clave"), trust


def surviving(rows: DataFrame) -> DataFrame:
    """(grupo, campo, valor): the surviving nombre, provincia and ccaa of each group, spelled as some row spells it.

    A group without any claim on a field has no row for it. The name is that of a row which claims the true words (else words two letters from
    them), of those one with the true kind if there is any, of those the most proper spelling; so support decides what is true, and
    properness only which of the rows that say it is spelled in full. Postcode prefixes vote for the province they go with elsewhere, provinces for their region.
    """
    claims = cut(claims_of(rows))
    count = lambda df: df.groupBy("grupo", "campo", "clave", "fuente").agg(F.count(F.lit(1)).alias("n"), F.max("cuando").alias("cuando"))

    def implied(of: str, to: str, source: str) -> DataFrame:
        """Claims on field ``to`` by what mostly goes with the row's ``of`` in all rows."""
        a = claims.filter(F.col("campo") == of).select("grupo", "fila", F.col("clave").alias("de"), "cuando")
        b = claims.filter(F.col("campo") == to).select("grupo", "fila", F.col("clave").alias("a"))
        both = a.join(b, ["grupo", "fila"]).groupBy("de", "a").agg(F.count(F.lit(1)).alias("n"))
        map_ = both.groupBy("de").agg(F.max_by("a", F.struct("n", "a")).alias("clave"))
        return a.join(map_, "de").select("grupo", F.lit(to).alias("campo"), "clave", F.lit(source).alias("fuente"), "cuando")

    extra = implied("prefijo", "provincia", "~prefijo").unionByName(implied("provincia", "ccaa", "~provincia")).unionByName(implied("prefijo", "ccaa", "~prefijo"))
    votes = count(claims.filter("campo <> 'prefijo'").select("grupo", "campo", "clave", "fuente", "cuando").unionByName(extra))
    truths, _ = discover(votes, F.col("campo") == "tipo")
    truths = cut(truths)
    # regions: the most proper spelling of the true key within the group; spellings are counted before anything is gathered by group
    spelled = claims.filter(F.col("campo").isin("provincia", "ccaa")).groupBy("grupo", "campo", "clave", "texto", "limpio").agg(F.count(F.lit(1)).alias("n"))
    region = spelled.join(truths.select("grupo", "campo", F.col("clave").alias("v")), ["grupo", "campo"]).groupBy("grupo", "campo").agg(F.max_by("texto", F.struct((F.col("clave") == F.col("v")).alias("ok"), "limpio", "n", "texto")).alias("valor"))
    kind = truths.filter("campo = 'tipo'").select("grupo", F.col("clave").alias("tipo"))
    core = truths.filter("campo = 'nucleo'").select("grupo", F.col("clave").alias("nucleo"))
    cores = claims.filter("campo = 'nucleo'").select("grupo", "fila", F.col("clave").alias("k"), "texto", "limpio", "cuando")
    kinds = claims.filter("campo = 'tipo'").select("grupo", "fila", F.col("clave").alias("t"))
    names = cores.join(kinds, ["grupo", "fila"], "left").groupBy("grupo", "k", "t", "texto", "limpio").agg(F.count(F.lit(1)).alias("n"), F.max("cuando").alias("cuando"))
    names = names.join(core, "grupo").join(kind, "grupo", "left")
    same_kind = F.coalesce(F.col("t") == F.col("tipo"), F.lit(False))
    slip = F.levenshtein("k", "nucleo")
    rank = F.struct((F.when(slip == 0, 2).when(slip <= 2, 1).otherwise(0)).alias("b"), same_kind.alias("a"), "limpio", "n", "cuando", "texto")
    name = names.groupBy("grupo").agg(F.max_by("texto", rank).alias("valor")).select("grupo", F.lit("nombre").alias("campo"), "valor")
    return name.unionByName(region.select("grupo", "campo", "valor"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving nombre, provincia and ccaa of every reviewed group of two or more rows."""
    groups = table(spark, sf_dir, "center_groups").filter("group_id IS NOT NULL").groupBy("group_id", "center_id").agg(F.count(F.lit(1)).alias("_n"))
    several = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("filas")).filter("filas > 1").select("group_id")
    centers = table(spark, sf_dir, "centers").select("center_id", "fuente", "actualizado_en", "nombre", "localidad", "cod_postal", "provincia", "ccaa")
    rows = groups.join(several, "group_id").join(centers, "center_id").select(
        F.col("group_id").alias("grupo"), F.col("center_id").alias("fila"), "fuente", F.col("actualizado_en").alias("cuando"), "nombre", "localidad", "cod_postal", "provincia", "ccaa"
    )
    found = surviving(rows)
    return found.select(F.col("grupo").alias("group_id"), "campo", "valor")
