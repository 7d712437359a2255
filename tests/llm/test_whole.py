"""Whole jobs of the linkage operators: cases that a cut by size would lose."""

import random

from pyspark.sql import functions as F

from censo.llm import addresses as A


def test_large_buckets_are_compared_whole(spark):
    """A town with a third of the rows: every pair with a common band is a candidate, as in a brute-force join."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(6))
    rows = [(i, ["virgen", "puerta", word()], "grande" if i % 3 == 0 else f"pueblo{i % 7}") for i in range(240)]
    df = spark.createDataFrame(rows, "s long, p_nucleo array<string>, p_ciudad string").withColumn("p_provincia", F.lit(""))
    spelled = df.select("s", F.col("p_nucleo").alias("w"), F.lit("H").alias("g"), F.array("p_ciudad").alias("lugares"), "p_provincia")
    got = [(r.a, r.b) for r in A.candidates(spelled).collect()]
    shingles = df.select("s", "p_ciudad", F.array_distinct(F.concat("p_nucleo", A.qgrams(F.array_join("p_nucleo", "")))).alias("sh"))
    bands = {r.s: (r.p_ciudad, set(r.k)) for r in shingles.select("s", "p_ciudad", A.minhash_bands(F.col("sh")).alias("k")).collect()}
    want = {(a, b) for a in bands for b in bands if a < b and bands[a][0] == bands[b][0] and bands[a][1] & bands[b][1]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3000


def test_hot_bucket_keeps_links_of_different_texts(spark):
    """Thirty-two spellings of one name and town, the smallest of another office: all but it are one site, whatever the smallest row is."""
    import datetime as dt

    from censo.functions.udf import parse_places

    t = dt.datetime(2020, 1, 1)
    rows = [(1, "Hospital General Río Talmera", "Pueblo", "01234", "P", t)] + [(100 + i, f"Hospital General Río Talmera{'a' * (i % 3)}", "Pueblo", ("48123", "48133")[i % 2], "P", t) for i in range(32)]
    df = spark.createDataFrame(rows, "center_id long, nombre string, localidad string, cod_postal string, provincia string, actualizado_en timestamp")
    copies, links = A.address_links(parse_places(df, "nombre", "localidad", "cod_postal", "provincia"), "center_id")
    from censo.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(copies.unionByName(links), "a", "b").collect()}
    assert {got[100 + i] for i in range(32)} == {100} and got.get(1, 1) == 1
