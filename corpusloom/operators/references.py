"""References to records that do not exist (problem 5).

Parent keys are integers within a domain (law, letter suffix): the article numbers a law supplies, each with
the first month it was supplied. Sorted keys that follow each other with the same month are compressed into
runs. A reference is matched as of its number to the run that starts last at or before it, and is an orphan if
there is none, if the number lies beyond the run's end, or if the run was supplied after its month.

Runs are kept per block of 64 numbers, so that one row holds at most 64 runs and a law with a third of all
records is spread over its blocks; references meet them by an equality join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.packed import SPACE, articles_of, references_of
from corpusloom.sources.tables import FAR, first_delivery

BLOCK = 64


def law_code(text: Column) -> Column:
    """Upper case without white space; null for null and blank."""
    return F.nullif(F.upper(F.regexp_replace(text, f"{SPACE}+", "")), F.lit(""))


def article_key(text: Column) -> Column:
    """struct(number, suffix) of 'Điều 12a' or '12'; null where there is no number. Brackets are no part of it."""
    outside = F.lower(F.regexp_replace(text, r"\([^)]*\)?", " "))
    number = F.regexp_extract(outside, r"(\d{1,9})", 1)
    return F.when(
        number != "",
        F.struct(number.cast("bigint").alias("number"), F.regexp_extract(outside, r"\d{1,9}(\p{L}?)(?!\p{L})", 1).alias("suffix")),
    )


def month_of(at: Column) -> Column:
    """Months since year 0; the far month for a record that was never ingested."""
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def period_of(month: Column) -> Column:
    """'YYYY-MM' of ``month_of``; '' for the far month."""
    text = F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))
    return F.when(month >= 9999 * 12, F.lit("")).otherwise(text)


def parent_runs(parents: DataFrame) -> DataFrame:
    """(law, suffix, block, runs) from (law, suffix, number, month): contiguous keys with one month make a run."""
    first = parents.groupBy("law", "suffix", "number").agg(F.min("month").alias("month"))
    blocks = first.groupBy("law", "suffix", F.floor(F.col("number") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("number", "month"))).alias("numbers")
    )
    run = "array<struct<start:bigint,end:bigint,month:int>>"

    def add(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        fresh = F.struct(x["number"].alias("start"), x["number"].alias("end"), x["month"].alias("month"))
        longer = F.struct(last["start"].alias("start"), x["number"].alias("end"), last["month"].alias("month"))
        joins = (last["end"] + 1 == x["number"]) & (last["month"] == x["month"])
        return F.when(
            F.coalesce(joins, F.lit(False)), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))
        ).otherwise(F.concat(runs, F.array(fresh)))

    return blocks.select("law", "suffix", "block", F.aggregate("numbers", F.array().cast(run), add).alias("runs"))


def missing_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The ``references`` (law, suffix, number, month, ...) no parent answers by their month; other columns stay."""
    runs = parent_runs(parents).select(*[F.col(c).alias(f"_{c}") for c in ("law", "suffix", "block", "runs")])
    blocked = references.withColumn("_at", F.floor(F.col("number") / BLOCK))
    same = (F.col("law") == F.col("_law")) & (F.col("suffix") == F.col("_suffix")) & (F.col("_at") == F.col("_block"))
    before = F.try_element_at(F.filter("_runs", lambda r: r["start"] <= F.col("number")), F.lit(-1))
    found = (before["end"] >= F.col("number")) & (before["month"] <= F.col("month"))
    return (
        blocked.join(runs, same, "left")
        .where(~F.coalesce(found, F.lit(False)))
        .drop("_law", "_suffix", "_block", "_runs", "_at")
    )


def orphans(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, period, ref_law_id, ref_article, field): orphan references of ``law_id`` (article '') and ``extra``.

    Each record counts once, by its earliest delivery. Null and blank law ids refer to nothing and supply
    nothing. A packed value without law or article number is no reference. A record never ingested has period
    '' and supplies nothing to any month.
    """
    first = first_delivery(records, "id", "ingested_at", ["law_id", "article", "extra"]).select(
        "id",
        month_of(F.coalesce("ingested_at", F.lit(FAR).cast("timestamp"))).alias("month"),
        law_code(F.col("law_id")).alias("law"),
        "article",
        "extra",
    )
    parents = (
        first.where("law is not null and article is not null")
        .select("law", "month", F.explode(articles_of(F.col("article"))).alias("value"))
        .select("law", "month", article_key(F.col("value")).alias("key"))
        .where("key is not null")
        .select("law", "key.suffix", "key.number", "month")
    )
    parts = F.split("value", r"\|")
    references = (
        first.where("extra is not null")
        .select("id", "month", F.explode(references_of(F.col("extra"))).alias("value"))
        .where(F.size(parts) >= 3)
        .select(
            "id",
            "month",
            law_code(F.when(F.size(parts) == 3, parts[0]).otherwise(F.try_element_at(parts, F.lit(2)))).alias("law"),
            article_key(F.element_at(parts, -1)).alias("key"),
        )
        .where("law is not null and key is not null")
        .select("id", "month", "law", "key.suffix", "key.number")
        .distinct()
    )
    by_article = missing_references(references, parents).select(
        "id",
        period_of(F.col("month")).alias("period"),
        F.col("law").alias("ref_law_id"),
        F.concat(F.col("number").cast("string"), F.col("suffix")).alias("ref_article"),
        F.lit("extra").alias("field"),
    )
    known = registry.select(law_code(F.col("doc_code")).alias("law")).where("law is not null").distinct()
    by_law = (
        first.where("law is not null")
        .join(known, "law", "left_anti")
        .select("id", period_of(F.col("month")).alias("period"), F.col("law").alias("ref_law_id"), F.lit("").alias("ref_article"), F.lit("law_id").alias("field"))
    )
    return by_law.unionByName(by_article)


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, referring field and month."""
    return found.groupBy(F.lit("legal_knowledge_records").alias("src"), "field", "period").agg(
        F.count("*").alias("n_refs"), F.count_distinct("id").alias("n_records")
    )
