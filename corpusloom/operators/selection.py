"""Selection over candidates ranked(qid, item_id, score, rank): votes, coverage of clauses, citations, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.ranking import ranked


def weighted_votes(lists: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """(qid, item_id, score, n_sources, rank): scores of several sources, weighted, by the total weight."""
    total, union = sum(w for _, w, _ in lists), None
    for name, w, df in lists:
        part = df.select("qid", "item_id", (F.lit(w) * F.col("score")).alias("_s"), F.lit(name).alias("_n"))
        union = part if union is None else union.unionByName(part)
    votes = union.groupBy("qid", "item_id").agg(F.round(F.sum("_s") / total, 6).alias("score"), F.count_distinct("_n").alias("n_sources"))
    return ranked(votes)


def appearances(lists: list[DataFrame], least: int, most: int) -> DataFrame:
    """Items that several lists hold, by the number of lists, then the best rank; the first ``most`` of each question."""
    union = None
    for df in lists:
        part = df.select("qid", "item_id", "rank").dropDuplicates(["qid", "item_id"])
        union = part if union is None else union.unionByName(part)
    counts = union.groupBy("qid", "item_id").agg(F.count("*").cast("double").alias("score"), F.min("rank").alias("_best")).where(F.col("score") >= least)
    return ranked(counts, F.asc("_best")).where(F.col("rank") <= most).drop("_best")


def merged_with_bonus(lists: list[DataFrame], bonus: float) -> DataFrame:
    """Lists merged in their order: an item met again has the larger of its score and the new one plus a bonus."""
    union = None
    for n, df in enumerate(lists):
        part = df.select("qid", "item_id", F.lit(n).alias("_n"), "score")
        union = part if union is None else union.unionByName(part)
    met = union.groupBy("qid", "item_id").agg(F.sort_array(F.collect_list(F.struct("_n", "score"))).alias("_m"))  # one per list
    first = F.col("_m")[0]["score"]
    score = F.aggregate(F.slice("_m", F.lit(2), F.size("_m")), first, lambda s, x: F.greatest(s, x["score"] + bonus))
    return ranked(met.select("qid", "item_id", F.round(score, 6).alias("score"), F.size("_m").alias("n_sources")))


def of_few_groups(df: DataFrame, group: str, per_group: int, groups: int) -> DataFrame:
    """By rank, at most ``per_group`` items of a group and items of the first ``groups`` groups only."""
    first = F.min("rank").over(Window.partitionBy("qid", group))
    w = Window.partitionBy("qid", group).orderBy("rank")
    out = df.withColumn("_first", first).withColumn("_n", F.row_number().over(w))
    return out.withColumn("_g", F.dense_rank().over(Window.partitionBy("qid").orderBy("_first"))).where((F.col("_n") <= per_group) & (F.col("_g") <= groups)).drop("_first", "_n", "_g")


def packed_context(df: DataFrame, size: str, most: int, joint: int = 4, least_tail: int = 200) -> DataFrame:
    """By rank, whole blocks as long as they fit ``most`` characters, then a part of the next if that leaves enough of it.

    ``taken`` is the number of characters of a block that are used; ``joint`` is what stands between blocks.
    """
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.col(size) + joint).over(w)
    out = df.withColumn("_used", used).withColumn("_over", F.col("_used") > most)
    first_over = F.min(F.when(F.col("_over"), F.col("rank"))).over(Window.partitionBy("qid"))
    left = F.lit(most) - (F.col("_used") - F.col(size) - joint)
    taken = F.when(~F.col("_over"), F.col(size)).when((F.col("rank") == first_over) & (left > least_tail), left)
    return out.withColumn("taken", taken.cast("int")).where("taken is not null").drop("_used", "_over")


def covering(df: DataFrame, clauses: str, words: str, ratio: float, absolute: float, most: int, covered: float, direct: float, candidates: int = 16) -> DataFrame:
    """Items near the best score, then for each clause none of them covers the candidate that covers it best.

    ``clauses``: an array of word arrays, the same in all rows of a question; ``words``: the words of an item. A clause is
    covered by the share of its words. Of the first ``candidates`` items; the choice is a fold inside the JVM.
    """
    fields = [c for c in df.columns if c not in ("qid", clauses)]
    kind = df.select(F.array(F.struct(*fields)).alias("a")).schema["a"].dataType
    listed = df.where(F.col("rank") <= candidates).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("_r"), F.struct(*fields).alias("x")))).alias("_c"), F.first(clauses).alias("_clauses"))
    pool = F.transform("_c", lambda c: c["x"])

    def cover(x: Column, clause: Column) -> Column:
        return F.size(F.array_intersect(x[words], clause)) / F.greatest(F.size(clause), F.lit(1))

    cut = F.greatest(F.lit(absolute), ratio * F.col("_pool")[0]["score"])
    near = F.slice(F.filter("_pool", lambda x: (x["score"] >= cut) | (x["rank"] == 1)), 1, most)

    def add(done: Column, clause: Column) -> Column:
        free = F.filter("_pool", lambda x: ~F.exists(done, lambda y: y["rank"] == x["rank"]) & (cover(x, clause) >= direct))
        best = F.array_max(F.transform(free, lambda x: F.struct(F.round(cover(x, clause), 6).alias("cover"), x["score"].alias("score"), (-x["rank"]).alias("rank"))))
        chosen = F.filter("_pool", lambda x: x["rank"] == -best["rank"])
        full = (F.size(done) >= most) | F.exists(done, lambda y: cover(y, clause) >= covered)
        return F.when(full | best.isNull(), done).otherwise(F.concat(done, chosen))

    picked = F.aggregate("_clauses", F.col("_near").cast(kind), add)
    rows = listed.withColumn("_pool", pool).withColumn("_near", near).select("qid", F.explode(picked).alias("x"))
    return rows.select("qid", "x.*").drop(words)


def cited(df: DataFrame, answer: str, code: str, article: str, top: int = 3) -> DataFrame:
    """The best tier that has any: code and article both in the answer, the article alone, else the first hits. ``tier`` says which."""
    has = lambda c: F.contains(F.col(answer), F.col(c))
    tier = F.when(F.coalesce(has(code) & has(article), F.lit(False)), 1).when(F.coalesce(has(article), F.lit(False)), 2).when(F.col("rank") <= top, 3)
    out = df.withColumn("tier", tier).where("tier is not null")
    return out.withColumn("_t", F.min("tier").over(Window.partitionBy("qid"))).where("tier = _t").drop("_t")


def by_positions(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """The items at the chosen positions (qid, positions), each once, in the order given; the first item where none is valid."""
    wanted = chosen.select("qid", F.posexplode(F.array_distinct("positions")).alias("place", "rank"))
    hits = df.join(wanted, ["qid", "rank"])
    rest = df.where(F.col("rank") == 1).join(hits.select("qid").distinct(), "qid", "left_anti").withColumn("place", F.lit(0))
    return hits.unionByName(rest.select(hits.columns))


def without_uncited(text: Column, allowed: Column) -> Column:
    """Mentions of articles whose number is not in an array are cut out; blanks and brackets they leave are tidied."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?iu)(?:khoản\s+\d+\s+)?điều\s+(\d+[a-zđ]?)"), 1))
    bad = F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda n: ~F.array_contains(allowed, F.lower(n)))
    cut = F.when(F.size(bad) == 0, text).otherwise(
        F.regexp_replace(text, F.concat(F.lit(r"(?iu)(?:khoản\s+\d+\s+)?điều\s+(?:"), F.array_join(bad, "|"), F.lit(r")(?![\p{L}\p{N}])(?:\s+của)?")), F.lit(""))
    )
    tidy = F.regexp_replace(F.regexp_replace(cut, r"\(\s*\)", ""), r"\s+([,.;)])", "$1")
    return F.trim(F.regexp_replace(tidy, r"\s{2,}", " "))
