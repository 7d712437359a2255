"""Streaming queries, run to the end of what is there (available-now)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censo.plans.registry import Registry
from censo.session import local_folder, table
from censo.streaming.ingest import windowed_counts

query = Registry()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder; a temporary one where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark, "censo-stream-")
    return f"{base}/{uuid.uuid4().hex}"


@query("""
SELECT time_bucket(INTERVAL 6 HOURS, ts) AS desde, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def events_windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by six-hour window and type from a stream over the files, appended once the watermark or the end of input closes them."""
    folder = shared_folder(spark)
    schema = table(spark, sf_dir, "events").schema
    # the file source wants a folder or a pattern: this one is matched by the table's own path only
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    counts = windowed_counts(raw.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("w.start").alias("desde"), "event_type", "n").write.mode("overwrite").parquet(f"{folder}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("desde", F.col("desde").cast("timestamp_ntz"))
