"""Set-based scoring of answers: pred(qid, key, rank) against gold(qid, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import numbered_within


def f2_of(p: Column, r: Column) -> Column:
    """5PR / (4P + R); 0 where both are 0."""
    return F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.when(p.isNotNull() & r.isNotNull(), 0.0))


def per_query(pred: DataFrame, gold: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(qid, p, r, f2): F2 = 5PR / (4P + R); both empty count as 1, an empty gold set has recall 1.

    ``questions`` (qid) lists all of them: those with neither prediction nor gold are in neither of the other tables.
    """
    p, g = pred.select("qid", "key").distinct().withColumn("p", F.lit(1)), gold.select("qid", "key").distinct().withColumn("g", F.lit(1))
    counts = p.join(g, ["qid", "key"], "full").groupBy("qid").agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("hit"))
    if questions is not None:
        counts = questions.select("qid").distinct().join(counts, "qid", "left").na.fill(0, ["np", "ng", "hit"])
    pr = F.when(F.col("np") == 0, F.when(F.col("ng") == 0, 1.0).otherwise(0.0)).otherwise(F.col("hit") / F.col("np"))
    re = F.when(F.col("ng") == 0, 1.0).otherwise(F.col("hit") / F.col("ng"))
    scored = counts.select("qid", pr.alias("p"), re.alias("r"))
    return scored.withColumn("f2", f2_of(F.col("p"), F.col("r")))


def macro(scores: DataFrame) -> DataFrame:
    """Means over the questions: precision, recall, F2, and F2 of the mean precision and recall."""
    p, r = F.avg("p"), F.avg("r")
    return scores.agg(F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(F.avg("f2"), 6).alias("f2"), F.round(f2_of(p, r), 6).alias("f2_of_means"), F.count("*").alias("n"))


def first_hit(pred: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(mrr, recall_at_k) from the rank of the first gold key."""
    hits = pred.where(F.col("rank") <= k).join(gold.select("qid", "key").distinct(), ["qid", "key"]).groupBy("qid").agg(F.min("rank").alias("first"), F.count_distinct("key").alias("hit"))
    sizes = gold.groupBy("qid").agg(F.count_distinct("key").alias("n"))
    joined = sizes.join(hits, "qid", "left")
    return joined.agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0))), 6).alias("recall_at_k"))


def strict(pred: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """(p, r, zero_pct): means in which empty sets score 0, and the percentage of questions without a hit."""
    p, g = pred.select("qid", "key").distinct().withColumn("p", F.lit(1)), gold.select("qid", "key").distinct().withColumn("g", F.lit(1))
    counts = p.join(g, ["qid", "key"], "full").groupBy("qid").agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    rows = questions.select("qid").distinct().join(counts, "qid", "left").na.fill(0, ["np", "ng", "hit"])
    share = lambda n: F.when((F.col("np") == 0) | (F.col("ng") == 0), 0.0).otherwise(F.col("hit") / F.col(n))
    return rows.agg(F.round(F.avg(share("np")), 6).alias("p"), F.round(F.avg(share("ng")), 6).alias("r"), F.round(100 * F.avg((F.col("hit") == 0).cast("int")), 6).alias("zero_pct"))


def stages(pred: DataFrame, gold: DataFrame, cuts: list[tuple[str, int]], loss: float) -> DataFrame:
    """(stage, p, r, f2, n, n_lost): means per question after each cut of a ranked list; F2 of the means.

    Questions without gold have no recall and are left out of its mean; ``n`` counts the others. ``n_lost`` counts those
    that lose more than ``loss`` of their recall between the first two stages.
    """
    gold = gold.select("qid", "key").distinct()
    marked = pred.join(gold.withColumn("_g", F.lit(1)), ["qid", "key"], "left")
    kept = marked.withColumn("c", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("k")) for s, k in cuts]))).where(F.col("rank") <= F.col("c.k"))
    per = kept.groupBy("qid", F.col("c.stage").alias("stage")).agg((F.count("_g") / F.count("*")).alias("p"), F.count("_g").alias("hit"))
    per = per.join(gold.groupBy("qid").agg(F.count("*").alias("total")), "qid", "left").withColumn("r", F.col("hit") / F.col("total"))
    a, b = (F.max(F.when(F.col("stage") == s, F.col("r"))) for s, _ in cuts[:2])
    lost = per.groupBy("qid").agg((a - b).alias("d")).agg(F.count_if(F.col("d") > loss).alias("n_lost"))
    p, r = F.avg("p"), F.avg("r")
    means = per.groupBy("stage").agg(F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f2_of(p, r), 6).alias("f2"), F.count("r").alias("n"))
    return means.crossJoin(F.broadcast(lost))  # one row


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, p50, p95): the median, and the value at place floor(0.95 n) in order from groups of five on."""
    placed = numbered_within(rows.where(F.col(value).isNotNull()).select(group, value), group, value)
    k, n = F.col("place"), F.col("n")
    at = F.max(F.when((n >= 5) & (k == F.floor(0.95 * n) + 1), F.col(value)))
    middle = F.avg(F.when(k.isin(F.floor((n + 1) / 2), F.floor(n / 2) + 1), F.col(value)))
    out = placed.groupBy(group).agg(F.round(F.avg(value), 4).alias("mean"), F.round(middle, 6).alias("p50"), F.round(at, 6).alias("p95"))
    all_ = rows.groupBy(group).agg(F.count("*").alias("n")).withColumnRenamed(group, "_g")
    return all_.join(out, F.col("_g").eqNullSafe(F.col(group)), "left").select(F.col("_g").alias(group), "n", "mean", "p50", "p95")
