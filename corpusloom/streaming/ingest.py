"""Structured Streaming: event windows with watermarks, and incremental ingest of records into an upserted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import written
from corpusloom.sources.connectors import folder_exists
from corpusloom.sources.tables import delivery_order


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling_counts(events: DataFrame, late: str = "2 days", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window; events later than the watermark are left out."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "2 days", gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n) per session of a user."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once_each(records: DataFrame, key: str, at: str, late: str = "400 days") -> DataFrame:
    """The first delivery of each key that arrives within the watermark."""
    return records.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


#: Parts of an ingested table; a batch rewrites only those its keys fall into.
BUCKETS = 256


def earliest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The earliest delivery of each key; one without time comes last."""
    return rows.groupBy(*key).agg(F.min_by(F.struct("*"), delivery_order(at)).alias("_row")).select("_row.*")


def ingest(records: DataFrame, target: str, key: list[str], at: str, checkpoint: str, buckets: int = BUCKETS):
    """Start a query that keeps the earliest delivery of each key in a Parquet table under ``target``, in buckets of keys.

    A batch reads and replaces the buckets it touches and no others. Since the earliest delivery stays the earliest, a
    batch that is run again after a failure changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = written(earliest(rows, key, at).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        if folder_exists(spark, target):
            old = spark.read.schema(new.schema).parquet(target).where(F.col("bucket").isin(touched))
            new = written(earliest(old.unionByName(new), key, at), "merged")
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
