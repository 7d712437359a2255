"""Resumable ingestion as Structured Streaming: each run takes what is new and stops.

State lies in the checkpoint and the target, not in the process. A batch that is replayed after a failure adds nothing twice: rows whose id
the target already holds are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censo.sources.lookup import ListSource


def pending(listed: DataFrame, done: DataFrame, failed: DataFrame, id_col: str = "identificador") -> DataFrame:
    """Listed ids that were neither recorded nor refused, each once."""
    return listed.select(id_col).distinct().join(done.select(id_col), id_col, "left_anti").join(failed.select(id_col), id_col, "left_anti")


def retryable(failures: DataFrame, absent_reason: str = "no existe") -> DataFrame:
    """The last failure of each id, but for confirmed absences."""
    last = failures.groupBy("identificador").agg(F.max_by("reason", "at").alias("reason"), F.max("at").alias("at"))
    return last.filter(F.col("reason") != absent_reason)


def merge_failures(old: DataFrame, retried: DataFrame, recovered: DataFrame) -> DataFrame:
    """Failures after a retry: recovered ids leave, repeated ones replace their row, the others stay."""
    kept = old.join(retried.select("identificador"), "identificador", "left_anti").join(recovered.select("identificador"), "identificador", "left_anti")
    again = retried.join(recovered.select("identificador"), "identificador", "left_anti")
    both = kept.unionByName(again)
    return both.groupBy("identificador").agg(F.max_by("reason", "at").alias("reason"), F.max("at").alias("at"))


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether the folder exists and holds anything, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and len(fs.listStatus(path)) > 0


def backfill(spark: SparkSession, first: int, last: int, cached: list[int], fetch: str) -> DataFrame:
    """(anio, documento) of the years from ``first`` to ``last`` that are not cached yet; no rows if all are."""
    missing = [y for y in range(first, last + 1) if y not in set(cached)]
    spark.dataSource.register(ListSource)
    if not missing:
        return spark.createDataFrame([], "anio int, documento string")
    return spark.read.format("registro_lista").option("fetch", fetch).option("years", ",".join(map(str, missing))).load()


def ingest_new_files(spark: SparkSession, source: str, schema: T.StructType | str, target: str, checkpoint: str, id_col: str, file_format: str = "json", files_per_batch: int | None = None) -> int:
    """Take all files not yet seen (trigger available-now) into the Parquet folder ``target``; the number of rows added.

    Rows without id are left out; an id comes in once, whatever file, batch or run brings it again. One run at a time: the checkpoint admits no
    second one.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    added = [0]

    def take(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        new = batch.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        new = new.join(s.read.schema(batch.schema).parquet(target).select(id_col), id_col, "left_anti") if has_files(s, target) else new
        new = new.persist()
        added[0] += new.count()
        new.write.mode("append").parquet(target)
        new.unpersist()

    reader.load(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return added[0]


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window and key of a stream, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
