"""Streaming counterparts of the append-only logs and of the ingest; each runs to the end of what there is and stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingsift.functions.answers import cache_key
from filingsift.functions.shared import shared_dir
from filingsift.sources.tables import table


#: Files of one batch of a stream.
FILES = 64


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream over a table, be it a folder of Parquet files or a single one."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = table(spark, folder, name).schema
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def hourly_cost(spark: SparkSession, folder: str, late: str = "2 hours") -> DataFrame:
    """(hour, kind, calls, usd) of every hour that is closed: older than the latest call by more than ``late``. A log_id counts
    once; a null cost counts as none. State is the open hours' groups and the ids seen since the watermark."""
    out = f"{shared_dir(spark)}/hourly-cost-{uuid.uuid4().hex}"
    calls = stream_of(spark, folder, "cost_log").where("log_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    calls = calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["log_id"])
    hours = calls.groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 6).alias("usd"))
    rows = hours.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "kind", "calls", "usd")
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def cost_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    """(hour, kind, calls, usd) of every hour there is, however late its calls arrive.

    Each batch adds the calls whose log_id no earlier batch had (in a batch, the first by arrival) to a table, in a folder of
    its own, so that a batch that is tried again replaces itself. The hours are summed over that table: an hour is never
    closed, so no call is too late, and the stream keeps no state but the table of its calls."""
    out = f"{shared_dir(spark)}/cost-by-hour-{uuid.uuid4().hex}"
    schema = "log_id long, kind string, ts timestamp, usd double, batch long"
    spark.createDataFrame([], schema).write.partitionBy("batch").parquet(f"{out}/rows")

    def add(batch: DataFrame, number: int) -> None:
        have = batch.sparkSession.read.schema(schema).parquet(f"{out}/rows").where(F.col("batch") != number)
        first = batch.groupBy("log_id").agg(F.min_by(F.struct("kind", "ts", "usd"), F.struct("arrived_at", "ts")).alias("r")).select("log_id", "r.*")
        first.join(have.select("log_id"), "log_id", "left_anti").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    calls = stream_of(spark, folder, "cost_log").where("log_id is not null").select("log_id", "kind", F.col("ts").cast("timestamp").alias("ts"), "usd", "arrived_at")
    calls.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    hour = F.date_format(F.date_trunc("HOUR", "ts"), "yyyy-MM-dd HH").alias("hour")
    return rows.groupBy(hour, "kind").agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 6).alias("usd"))


def ingested(spark: SparkSession, folder: str, model: str = "hash") -> DataFrame:
    """(key, chars) of the distinct chunk texts, ingested batch by batch: each batch adds the keys that are not there yet."""
    out = f"{shared_dir(spark)}/ingested-{uuid.uuid4().hex}"
    schema = "key string, chars int"
    spark.createDataFrame([], schema).write.parquet(f"{out}/rows")

    def add(batch: DataFrame, _: int) -> None:
        have = batch.sparkSession.read.schema(schema).parquet(f"{out}/rows")
        batch.dropDuplicates(["key"]).join(have.select("key"), "key", "left_anti").write.mode("append").parquet(f"{out}/rows")

    rows = stream_of(spark, folder, "chunks").where("text is not null").select(cache_key(model, F.col("text")).alias("key"), F.length("text").alias("chars"))
    rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")
