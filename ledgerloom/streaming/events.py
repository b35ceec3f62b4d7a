"""Event streams: windowed counts with a watermark, keyed upserts and duplicates, as file streams into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.workspace import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder as a stream of files, `ts` as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type. In append or update mode, state of windows older than the watermark is dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 6).cast("double").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def run_available(stream: DataFrame, keys: list[str], at: str | None = None, base: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its table so far: the last row per key.

    A batch writes its own rows, the last per key, to a folder named by its number below `base`; the table is the last of them all, by
    `at` if that is a column, then by batch. So a batch costs what is new in it, a repeated one changes nothing, and with the same
    `base` a stream goes on after a restart, as nothing is held by the driver. Without `base` a fresh one below the shared folder is taken.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    newest = [F.desc_nulls_last(at)] if at else []
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/out/batch=-1")

    def keep(batch: DataFrame, n: int) -> None:
        (last_of(batch, keys, newest) if at else batch).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    q = stream.writeStream.outputMode("append" if at else "update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return last_of(spark.read.parquet(f"{base}/out"), keys, [*newest, F.desc("batch")]).select(*stream.columns)
