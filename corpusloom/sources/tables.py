"""Table scans and the one-row-per-record rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAR = "9999-12-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is one file of fewer than half as many parts; a table of several files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) == 1 and 2 * df.rdd.getNumPartitions() <= cores else df


def wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table whose rows are worked on at length, spread over the cores."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df)


def delivery_order(at: str = "ingested_at") -> Column:
    """Sorts deliveries of one record; a delivery without time comes last."""
    return F.coalesce(F.col(at).cast("timestamp"), F.lit(FAR).cast("timestamp"))


def first_delivery(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: that of the earliest ``at``; equal times are broken by the values themselves.

    Only ``columns`` are shuffled, after a map-side partial minimum. Rows without key are dropped: they
    name no record.
    """
    packed = F.struct(delivery_order(at).alias("_at"), *[F.col(c) for c in columns])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(packed).alias("_first"))
        .select(key, F.col("_first._at").alias(at), *[F.col(f"_first.{c}").alias(c) for c in columns])
    )
