"""Training examples from ranked lists, and checks of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.references import law_code


def window_negatives(hits: DataFrame, positives: DataFrame, window: tuple[int, int], top_up: int, guard: int, n: int) -> DataFrame:
    """(qid, pos, item_id, rank, pick): ``n`` negatives by hash order from a window of ranks, then from the ranks behind it.

    A positive within the window keeps ``guard`` ranks on either side free. Questions whose positive is no hit have none.
    """
    low, high = window
    of = hits.join(positives, "qid").where(F.col("item_id") == F.col("pos")).select("qid", "pos", F.col("rank").alias("_pr"))
    near = F.col("_pr").between(low, high) & (F.abs(F.col("rank") - F.col("_pr")) <= guard)
    rest = hits.where(F.col("rank").between(low, top_up)).join(of, "qid").where((F.col("item_id") != F.col("pos")) & ~near)
    w = Window.partitionBy("qid").orderBy(F.col("rank") > high, F.md5(F.col("item_id").cast("string")), "item_id")
    return rest.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).select("qid", "pos", "item_id", "rank", "pick")


def padded(candidates: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """(qid, pos, negatives): the first ``n`` candidates by rank as text, begun again where there are fewer."""
    listed = candidates.groupBy("qid").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"].cast("string")), 1, n).alias("_n"))
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("_n", (i % F.size("_n")).cast("int")))
    return positives.join(listed, "qid").select("qid", "pos", F.array_join(full, " ").alias("negatives"))


def round_trip(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """``pairs`` (qid, item_id) with ``kept``, whether the item is among the hits of its question, and ``n_missing`` in all."""
    found = hits.select("qid", "item_id").withColumn("_k", F.lit(True))
    marked = pairs.join(found, ["qid", "item_id"], "left").withColumn("kept", F.coalesce("_k", F.lit(False))).drop("_k")
    return marked.crossJoin(F.broadcast(marked.agg(F.count_if(~F.col("kept")).alias("n_missing"))))  # one row


def corpus_checks(records: DataFrame) -> DataFrame:
    """(flag, n): laws with gaps, a missing first article, repeated articles, uneven types, no numbered article, long texts in few
    articles; rows that are giant or short, or have no title or no code."""
    rows = records.select("id", law_code(F.col("law_id")).alias("law"), "article", F.length("content").alias("size"), F.trim("article_title").alias("title"), F.lower(F.trim("doc_type")).alias("kind"))
    rows = rows.withColumn("no", F.nullif(F.regexp_extract("article", r"(\d{1,9})", 1), F.lit("")).cast("bigint"))
    of_rows = rows.agg(F.count_if(F.col("size") > 5000).alias("giant"), F.count_if(F.col("size") < 30).alias("short"), F.count_if(F.coalesce("title", F.lit("")) == "").alias("empty_title"), F.count_if(F.col("law").isNull()).alias("null_code"))
    repeated = rows.where("law is not null and article is not null").groupBy("law", "article").agg(F.count_distinct("id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate"))
    laws = rows.where("law is not null").groupBy("law").agg(
        F.count_distinct("no").alias("n"), F.min("no").alias("lo"), F.max("no").alias("hi"), F.count_distinct("kind").alias("kinds"), F.sum("size").alias("size"), F.count_distinct("article").alias("articles")
    )
    of_laws = laws.agg(
        F.count_if((F.col("n") > 0) & (F.col("hi") - F.col("lo") + 1 > F.col("n"))).alias("gap"),
        F.count_if(F.col("lo") > 1).alias("missing_first"),
        F.count_if(F.col("kinds") > 1).alias("dup_metadata"),
        F.count_if(F.col("n") == 0).alias("zero_article"),
        F.count_if((F.col("size") > 3000) & (F.col("articles") < 4)).alias("long_few"),
    )
    one = of_rows.crossJoin(repeated).crossJoin(of_laws)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in one.columns])).alias("x")).select("x.*")
