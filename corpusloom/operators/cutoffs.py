"""Cut-offs and selection rules: each maps ranked(qid, item_id, score, rank) to a part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by_query():
    return Window.partitionBy("qid")


def fixed(df: DataFrame, threshold: float, k: int) -> DataFrame:
    """Scores from the threshold on; if fewer than half of k remain, the top half of k."""
    half = max(1, k // 2)
    kept = F.sum((F.col("score") >= threshold).cast("int")).over(_by_query())
    return df.withColumn("_n", kept).where(F.when(F.col("_n") >= half, F.col("score") >= threshold).otherwise(F.col("rank") <= half)).drop("_n")


def relative(df: DataFrame, ratio: float, least: int = 1, most: int | None = 10, absolute: float = float("-inf")) -> DataFrame:
    """Scores of at least max(absolute, ratio * top), between ``least`` and ``most`` items; no maximum if None."""
    cut = F.greatest(F.lit(absolute), ratio * F.max("score").over(_by_query()))
    kept = (F.col("score") >= F.col("_cut")) if most is None else (F.col("score") >= F.col("_cut")) & (F.col("rank") <= most)
    return df.withColumn("_cut", cut).where((F.col("rank") <= least) | kept).drop("_cut")


def margin(df: DataFrame, top: int, least_score: float, within: float) -> DataFrame:
    """The first, and those of the top with a score of at least ``least_score`` within a margin of the best."""
    best = F.max("score").over(_by_query())
    return df.withColumn("_b", best).where((F.col("rank") == 1) | ((F.col("rank") <= top) & (F.col("score") >= least_score) & (F.col("score") >= F.col("_b") - within))).drop("_b")


def largest_gap(df: DataFrame, least: int, least_gap: float) -> DataFrame:
    """Cut at the largest drop between neighbours, the first of equal ones; all if few or no drop is large enough."""
    ordered = _by_query().orderBy("rank")
    gaps = df.withColumn("_next", F.lead("score").over(ordered)).withColumn("_gap", F.col("score") - F.col("_next"))
    best = F.max(F.struct("_gap", -F.col("rank"))).over(_by_query())
    marked = gaps.withColumn("_best", best).withColumn("_n", F.count("*").over(_by_query()))
    cut = F.greatest(-F.col("_best.col2"), F.lit(least))
    keep_all = (F.col("_n") <= least) | F.col("_best._gap").isNull() | (F.col("_best._gap") < least_gap)
    return marked.where(keep_all | (F.col("rank") <= cut)).select(*df.columns)


def quota(df: DataFrame, group: str, per_group: int) -> DataFrame:
    """At most so many items of a group, best first."""
    w = Window.partitionBy("qid", group).orderBy("rank")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group).drop("_n")


def keep_one(df: DataFrame, bad: str) -> DataFrame:
    """Drop bad items, worst first, as long as one item is left."""
    n_bad, n = F.sum(F.col(bad).cast("int")).over(_by_query()), F.count("*").over(_by_query())
    return df.withColumn("_all", n_bad == n).where(~F.col(bad) | (F.col("_all") & (F.col("rank") == 1))).drop("_all")


def never_empty(df: DataFrame, keep: str) -> DataFrame:
    """Rows marked to keep; all rows of a qid where none is."""
    return df.withColumn("_any", F.max(F.col(keep).cast("int")).over(_by_query())).where(F.col(keep) | (F.col("_any") == 0)).drop("_any")


def newest(df: DataFrame, family: list[str], year: str) -> DataFrame:
    """The newest version of each family; undated rows (year 0) go if a dated sibling exists."""
    w = Window.partitionBy(*family)
    return df.withColumn("_y", F.max(year).over(w)).where(F.col(year) == F.col("_y")).drop("_y")


def siblings(df: DataFrame, kept: DataFrame, group: str, within: float, most: int) -> DataFrame:
    """For each group with a kept item, its best unseen items within a margin of the best score."""
    best = df.withColumn("_b", F.max("score").over(_by_query())).where(F.col("score") >= F.col("_b") - within).drop("_b")
    unseen = best.join(kept.select("qid", "item_id"), ["qid", "item_id"], "left_anti").join(kept.select("qid", group).distinct(), ["qid", group], "left_semi")
    w = Window.partitionBy("qid", group).orderBy("rank")
    return unseen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def scoped(df: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
    """Rows of the first scope (name, flag column) that has any in its list, else all; ``scope`` names it."""
    name, keep = F.lit("all"), F.lit(True)
    for label, flag in reversed(scopes):
        any_ = F.max(F.col(flag).cast("int")).over(_by_query()) == 1
        name, keep = F.when(any_, label).otherwise(name), F.when(any_, F.col(flag)).otherwise(keep)
    return df.withColumn("scope", name).withColumn("_keep", keep).where("_keep").drop("_keep")
