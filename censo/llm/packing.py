"""Problem 8: texts of varying length into containers of fixed capacity, with the number of containers certified from below.

Sizes are tokens of a public tokenizer. Items are spread by hash over partitions of bounded size; each partition is packed by best-fit
decreasing and its number of containers is compared with a lower bound from dual feasible functions. Partitions that meet their bound are
certified and done. The others give the contents of their containers with empty space to a common exchange, where the items of several
partitions are packed together; an exchange that saves nothing leaves the former packing in place, and exchanges go on while any saves one.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censo.session import at_least_partitions, cut, table

#: The public tokenizer's ranks: a path every node can read, or the name of a file sent with ``SparkContext.addFile``; the session's setting
#: ``spark.censo.tokenizer`` comes before it.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ITEMS_PER_PARTITION = 4000
#: So many partitions' worth of items is packed together in an exchange.
MERGE = 8

_encodings: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a ranks file, loaded once per process."""
    if path not in _encodings:
        import tiktoken
        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("censo", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every row; a null or empty text has 0 tokens, strings of special tokens are ordinary text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for part in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return at_least_partitions(df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t"))).mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (largest first, each into the fullest container it fits). Items of size 0 open a container only if there is none."""
    out = np.zeros(len(sizes), np.int64)
    rests: list[int] = []
    open_by_rest: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(rests, s)
        if at == len(rests):
            bin_, rest = made, capacity
            made += 1
        else:
            rest = rests[at]
            stack = open_by_rest[rest]
            bin_ = stack.pop()
            if not stack:
                del open_by_rest[rest]
                rests.pop(at)
        out[i] = bin_
        rest -= s
        if rest in open_by_rest:
            open_by_rest[rest].append(bin_)
        else:
            open_by_rest[rest] = [bin_]
            insort(rests, rest)
    return out


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing needs: the best of two families of dual feasible functions, from the counts by size.

    f_t rounds sizes above capacity - t up to a whole container and drops those below t; u_k rounds sizes to multiples of 1/k. An empty list
    needs none; items of size 0 alone need one.
    """
    if not len(sizes):
        return 0
    c = capacity
    n = np.bincount(sizes.astype(np.int64), weights=counts, minlength=c + 1)[: c + 1].astype(np.int64)
    x = np.arange(c + 1)
    count, weight = np.cumsum(n), np.cumsum(n * x)
    total = int(n.sum())
    best = -(-int(weight[-1]) // c)
    t = np.arange(1, c // 2 + 1)
    if len(t):
        whole = total - count[c - t]
        between = weight[c - t] - weight[t - 1]
        best = max(best, int((-(-(whole * c + between) // c)).max()))
    for k in range(2, 13):
        num = x * (k + 1)
        u = np.where(num % c == 0, x * k, (num // c) * c)
        best = max(best, -(-int((u * n).sum()) // (k * c)))
    return max(best, 1)


ITEM = "container_id int, max_tokens int, doc_id long, pieza int, inicio long, tokens long"


def pieces(counted: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Items for every container kind: a text that fits whole, else pieces of full capacity and the rest. Texts without tokens are one item."""
    if not capacities:
        return counted.sparkSession.createDataFrame([], ITEM)
    kinds = F.array(*(F.struct(F.lit(i).cast("int").alias("container_id"), F.lit(c).cast("int").alias("max_tokens")) for i, c in capacities))
    wide = counted.select("doc_id", "tokens", F.explode(kinds).alias("k")).select("doc_id", "tokens", "k.*")
    n = F.greatest(F.ceil(F.col("tokens") / F.col("max_tokens")).cast("int"), F.lit(1))
    cut_up = wide.withColumn("pieza", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("pieza").cast("bigint") * F.col("max_tokens")
    return cut_up.select("container_id", "max_tokens", "doc_id", "pieza", start.alias("inicio"), F.least(F.col("tokens") - start, F.col("max_tokens")).alias("tokens"))


PACKED = f"{ITEM}, grupo string, caja long, cajas long, cota long"


def pack_groups(items: DataFrame) -> DataFrame:
    """Each group (container_id, grupo) packed: caja, the group's number of containers ``cajas`` and its lower bound ``cota``."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        c = int(g["max_tokens"].iloc[0])
        g = g.sort_values(["tokens", "doc_id", "pieza"], ascending=[False, True, True], ignore_index=True)
        sizes = g["tokens"].to_numpy(np.int64)
        g["caja"] = best_fit_decreasing(sizes, c)
        g["cajas"] = int(g["caja"].max()) + 1
        g["cota"] = lower_bound(sizes, c)
        return g[["container_id", "max_tokens", "doc_id", "pieza", "inicio", "tokens", "grupo", "caja", "cajas", "cota"]]

    return items.groupBy("container_id", "grupo").applyInPandas(pack, PACKED)


def pack(counted: DataFrame, capacities: list[tuple[int, int]], per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """(container_id, max_tokens, doc_id, pieza, inicio, tokens, caja): every text or piece with its container's name.

    Full pieces are containers of their own. All other items are hashed over partitions of about ``per_partition`` items, so no text, source or
    size makes a large one. Repeated doc_ids keep their items apart by position only if they differ in pieza; give unique ids.
    """
    items = cut(pieces(counted, capacities))
    own = items.filter("tokens = max_tokens").withColumn("caja", F.concat_ws("-", F.lit("s"), "doc_id", "pieza"))
    rest = items.filter("tokens < max_tokens")
    n = rest.groupBy("container_id").agg(F.count(F.lit(1)).alias("n"))
    parts = {r["container_id"]: max(1, -(-r["n"] // per_partition)) for r in n.collect()}  # one row per container kind
    of = F.lit(1)
    for cid, p in parts.items():
        of = F.when(F.col("container_id") == cid, F.lit(p)).otherwise(of)
    grouped = rest.withColumn("grupo", F.concat(F.lit("0-"), F.pmod(F.xxhash64("doc_id", "pieza"), of).cast("string")))
    packed = cut(pack_groups(grouped))
    done, round_ = None, 0
    while True:
        round_ += 1
        # certified partitions and full containers stay; the others' open containers are exchanged, in pools of bounded size
        fill = packed.groupBy("container_id", "grupo", "caja").agg(F.sum("tokens").alias("lleno"))
        marked = packed.join(fill.hint("merge"), ["container_id", "grupo", "caja"])
        stay = (F.col("cajas") <= F.col("cota")) | (F.col("lleno") >= F.col("max_tokens"))
        marked = cut(marked.withColumn("queda", stay).drop("lleno"))
        stays, opened = marked.filter("queda").drop("queda"), marked.filter("NOT queda").drop("queda")
        done = stays if done is None else done.unionByName(stays)
        sizes = opened.groupBy("container_id").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per container kind
        if not sizes:
            break
        pools = F.lit(1)
        for r in sizes:
            pools = F.when(F.col("container_id") == r["container_id"], F.lit(-(-r["n"] // (MERGE * per_partition)))).otherwise(pools)
        opened = opened.withColumn("_g", F.concat(F.lit(f"{round_}-"), F.pmod(F.xxhash64("grupo", F.lit(round_)), pools).cast("string")))
        new = cut(pack_groups(opened.select("container_id", "max_tokens", "doc_id", "pieza", "inicio", "tokens", F.col("_g").alias("grupo"))))
        before = opened.select("container_id", "_g", "grupo", "caja").distinct().groupBy("container_id", F.col("_g").alias("grupo")).agg(F.count(F.lit(1)).alias("antes"))
        gain = cut(new.select("container_id", "grupo", "cajas").distinct().join(before.hint("merge"), ["container_id", "grupo"]).select("container_id", "grupo", (F.col("cajas") < F.col("antes")).alias("mejor")))
        # a pool that gains nothing keeps its containers; one that does goes on, until no pool gains
        done = done.unionByName(opened.join(gain.filter("NOT mejor").select("container_id", F.col("grupo").alias("_g")), ["container_id", "_g"], "left_semi").drop("_g"))
        packed = new.join(gain.filter("mejor").select("container_id", "grupo"), ["container_id", "grupo"], "left_semi")
    named = done.withColumn("caja", F.concat_ws("-", "grupo", F.col("caja").cast("string")))
    cols = ["container_id", "max_tokens", "doc_id", "pieza", "inicio", "tokens", "caja"]
    return own.select(*cols).unionByName(named.select(*cols))


def capacities_of(sizes: DataFrame) -> list[tuple[int, int]]:
    """The kinds of container; there are a handful, more than a thousand are refused."""
    rows = sizes.filter("max_tokens > 0").select("container_id", "max_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 kinds of container")
    return sorted((r[0], r[1]) for r in rows)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or piece of a text, for each size."""
    counted = cut(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", spark.conf.get("spark.censo.tokenizer", TOKENIZER)))
    return pack(counted, capacities_of(table(spark, sf_dir, "container_sizes")))


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each size: containers used, the lower bound over all texts from their size counts, tokens and the share of empty space."""
    packed = cut(p8_packed(spark, sf_dir))
    used = packed.groupBy("container_id", "max_tokens", "caja").agg(F.sum("tokens").alias("t")).groupBy("container_id", "max_tokens").agg(F.count(F.lit(1)).alias("cajas"), F.sum("t").alias("tokens"))
    histogram = packed.groupBy("container_id", "max_tokens", "tokens").agg(F.count(F.lit(1)).alias("n"))  # at most max_tokens rows of each kind

    def bound(g: pd.DataFrame) -> pd.DataFrame:
        n = lower_bound(g["tokens"].to_numpy(np.int64), int(g["max_tokens"].iloc[0]), g["n"].to_numpy(np.float64))
        return pd.DataFrame({"container_id": [g["container_id"].iloc[0]], "cota": [n]})

    bounds = histogram.groupBy("container_id").applyInPandas(bound, "container_id int, cota long")
    return used.join(bounds, "container_id").select("container_id", "max_tokens", "cajas", "cota", "tokens", F.round(1 - F.col("tokens") / (F.col("cajas") * F.col("max_tokens")), 6).alias("vacio"))
