"""Sites on a map: joined to known points by postcode, with both losses counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censo.functions.text import normalise_postcode


def place_sites(sites: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed sites with lat and lon, one row (sitios_perdidos, ensayos_perdidos)).

    ``sites``: (cod_postal, ensayos, ...); ``points``: (cod_postal, lat, lon). Codes are compared in their mended form; of a code listed twice the
    first point in order of latitude and longitude counts. Without sites both losses are 0.
    """
    known = points.withColumn("_cp", normalise_postcode(F.col("cod_postal"))).filter("_cp IS NOT NULL").groupBy("_cp").agg(F.min(F.struct("lat", "lon")).alias("_p"))
    joined = sites.withColumn("_cp", normalise_postcode(F.col("cod_postal"))).join(known, "_cp", "left")
    placed = joined.filter("_p IS NOT NULL").select(*sites.columns, "_p.lat", "_p.lon")
    lost = F.col("_p").isNull()
    losses = joined.agg(F.count_if(lost).alias("sitios_perdidos"), F.coalesce(F.sum(F.when(lost, F.col("ensayos"))), F.lit(0)).cast("bigint").alias("ensayos_perdidos"))
    return placed, losses
