"""Versions of one text in a ranked list: families, newest, superseded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.cutoffs import never_empty


def older_dropped(df: DataFrame, same: list[str], code: str, year: str) -> DataFrame:
    """Without dated rows older than the newest of their group, where it has two codes and two dates; year 0 is undated."""
    w = Window.partitionBy(*same)
    marked = df.withColumn("_codes", F.size(F.collect_set(code).over(w))).withColumn("_dated", F.sum((F.col(year) > 0).cast("int")).over(w)).withColumn("_newest", F.max(year).over(w))
    old = (F.col("_codes") >= 2) & (F.col("_dated") >= 2) & (F.col(year) > 0) & (F.col(year) < F.col("_newest"))
    return marked.where(~old).drop("_codes", "_dated", "_newest")


def family_collapsed(df: DataFrame, family: str, year: str) -> DataFrame:
    """Without rows older than the newest of their family in the same list; rows without family or year stay."""
    newest = F.max(year).over(Window.partitionBy("qid", family))
    old = F.col(family).isNotNull() & (F.col(year) > 0) & (F.col(year) < newest)
    return df.withColumn("_old", F.coalesce(old, F.lit(False))).where(~F.col("_old")).drop("_old")


def superseded_dropped(df: DataFrame, superseded: DataFrame, code: str, name: str, year: str) -> DataFrame:
    """Without codes a table (old_code) names as replaced and versions older than one of the same name; a list is never emptied."""
    gone = F.broadcast(superseded.select(F.col("old_code").alias(code)).distinct().withColumn("_gone", F.lit(True)))
    newest = F.max(year).over(Window.partitionBy("qid", name))
    keep = F.col("_gone").isNull() & (F.col(name).isNull() | (F.col(year) >= newest))
    return never_empty(df.join(gone, code, "left").withColumn("_keep", keep), "_keep").drop("_gone", "_keep")


def successors(edges: DataFrame) -> DataFrame:
    """(old_code, successors): from edges (old_code, at, new_code) the newer codes in order of time, then code."""
    return edges.distinct().groupBy("old_code").agg(F.sort_array(F.collect_list(F.struct("at", "new_code"))).alias("_s")).select("old_code", F.col("_s.new_code").alias("successors"))
