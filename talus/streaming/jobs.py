"""Structured Streaming forms of the batch cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.session import stage_root


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table's files as a stream; zone-less timestamps become TIMESTAMP, which watermarks need."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    dirs, leaf = path.rsplit("/", 1)
    s = spark.readStream.schema(schema).option("pathGlobFilter", leaf if path.endswith(".parquet") else "*").parquet(dirs) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_once(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its result table, written below the stage tables."""
    import uuid

    spark = df.sparkSession
    at = f"{stage_root(spark)}/stream-{name}-{uuid.uuid4().hex[:8]}"
    schema = df.schema
    if mode == "append":
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
        return spark.read.schema(schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/epoch={epoch:06d}")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    epochs = spark.read.schema(schema).parquet(f"{at}/epoch=*").withColumn("_epoch", F.input_file_name())
    last = epochs.agg(F.max(F.regexp_extract("_epoch", r"epoch=(\d+)", 1)).alias("last"))
    return epochs.join(last, F.regexp_extract("_epoch", r"epoch=(\d+)", 1) == F.col("last")).drop("_epoch", "last")


def daily_counts(events: DataFrame, ts: str, key: str) -> DataFrame:
    """Tumbling days: events per day and key."""
    w = events.withWatermark(ts, "2 days").groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), key, "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, delay: str = "60 days") -> DataFrame:
    """The first event per key within the watermark; a delay longer than the replay window makes it exact."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Extension: events per key and session, a session ending after a gap."""
    s = events.withWatermark(ts, "1 day").groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("started"), key, "n")
