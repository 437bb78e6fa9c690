"""Named queries: order-dependent rules, score adjustment, cascades and stage reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators import references, sequential
from corpusloom.plans.retrieval import _JUDGED, _R, _judged, _orders
from corpusloom.session import tune
from corpusloom.sources.tables import table


def label_points(spark, d):
    rows = table(tune(spark), d, "legal_knowledge_records").select("id", sequential.labelled_points(F.col("content")).alias("labels"))
    return rows.where("labels <> ''").distinct()


def line_repair(spark, d):
    t = table(tune(spark), d, "documents").where("text is not null")
    return t.select("doc_id", (F.size(F.split("text", "\n")) - F.size(F.split(sequential.joined_lines(F.col("text")), "\n"))).alias("n_joined")).where("n_joined > 0")


def greedy_select(spark, d):
    """Orders with enough evidence (here: the last digits of the key), of few priorities; even customers seek several."""
    # Least evidence for one and for several targets, and largest gap, at the second to fourth place.
    steps = [(0.40, 0.34, 0.11), (0.80, 0.54, 0.06), (1.00, 1.00, 0.06)]
    r = _orders(spark, d).withColumn("evidence", F.col("item_id") % 101 / 100).withColumn("multi", F.col("qid") % 2 == 0)
    return sequential.greedy_evidence(r, "grp", "evidence", "multi", steps, strong=0.62).select("qid", "item_id", "score", "rank")


def knn_prefetch(spark, d):
    return sequential.knn_two_stage(table(tune(spark), d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")))


def metadata_adjust(spark, d):
    """Penalty for one status, bonus for another and for later years."""
    bonus = F.when(F.col("status") == "P", -0.10).when(F.col("status") == "O", 0.02).otherwise(0.0) + F.least(F.lit(0.05), 0.01 * (F.col("year") - 1992))
    return _orders(spark, d).where("rank <= 10").select("qid", "item_id", F.round(F.col("score") + bonus, 6).alias("score"))


def primary_sub_mean(spark, d):
    """0.7 of a customer's best score and 0.3 of the mean of the others; the best alone where there is no other."""
    r = _orders(spark, d)
    s = r.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.avg(F.when(F.col("rank") > 1, F.col("score"))).alias("b"))
    return s.select("qid", F.round(F.when(F.col("b").isNull(), F.col("a")).otherwise(0.7 * F.col("a") + 0.3 * F.col("b")), 6).alias("score"))


def cascade_ids(spark, d):
    """The registry entry of a document by its code as it stands, else cleaned, else by its title; the first that hits."""
    r = table(tune(spark), d, "legal_doc_registry")
    docs = table(spark, d, "documents").select("doc_id", "doc_code", "title", references.law_code(F.col("doc_code")).alias("clean"))
    exact = r.select(F.col("doc_code").alias("doc_code"), F.col("doc_code").alias("x"))
    cleaned = r.select(F.col("doc_code").alias("clean"), F.col("doc_code").alias("y"))
    titled = r.groupBy(F.lower(F.trim("canonical_title")).alias("t")).agg(F.min("doc_code").alias("z"))
    hit = docs.join(exact, "doc_code", "left").join(cleaned, "clean", "left").join(titled, F.lower(F.trim("title")) == F.col("t"), "left")
    step = F.when(F.col("x").isNotNull(), "exact").when(F.col("y").isNotNull(), "cleaned").when(F.col("z").isNotNull(), "title")
    return hit.select("doc_id", F.coalesce("x", "y", "z").alias("entry"), step.alias("step"))


def stage_recall(spark, d):
    """Recall and precision of the lists left after each stage: 10, 5 and 2 items."""
    gold = _judged(spark, d)[1].withColumn("gold", F.lit(1))
    pred = _orders(spark, d).where("rank <= 10").select("qid", F.col("item_id").alias("key"), "rank").join(gold, ["qid", "key"], "left")
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("k")) for s, k in (("retrieval", 10), ("rerank", 5), ("final", 2))])
    kept = pred.withColumn("s", F.explode(stages)).where("rank <= s.k").groupBy(F.col("s.stage").alias("stage")).agg(F.count("*").alias("n"), F.count("gold").alias("hit"))
    total = gold.agg(F.count("*").alias("total"))
    return kept.crossJoin(F.broadcast(total)).select("stage", F.round(F.col("hit") / F.col("n"), 6).alias("p"), F.round(F.col("hit") / F.col("total"), 6).alias("r"))


def answer_rules(spark, d):
    """Checks of an answer: a code of the gold named, numbers all in the question or gold, length."""
    e = table(tune(spark), d, "eval_items")
    numbers = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"(\d+)"), 1))
    return e.select("id", (F.size(F.regexp_extract_all("answer", F.lit(f"({X.VIETNAMESE.code})"), 1)) > 0).alias("cites"), F.size(numbers).alias("n_numbers"), (F.length("answer") >= 100).alias("long_enough"))


def topic_quota(spark, d):
    """At most three documents of a topic, by hash order."""
    w = Window.partitionBy("topic").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return table(tune(spark), d, "documents").select("doc_id", "topic").withColumn("k", F.row_number().over(w)).where("k <= 3").select("doc_id", "topic")


QUERIES = {f.__name__: f for f in (label_points, line_repair, greedy_select, knn_prefetch, metadata_adjust, primary_sub_mean, cascade_ids, stage_recall, answer_rules, topic_quota)}

_CLEAN = r"nullif(upper(regexp_replace(d.doc_code, '\s', '', 'g')), '')"
_FITS = "multi AND evidence >= {least} AND (top - score <= CAST({gap} AS DOUBLE) OR evidence >= 0.62)"
ORACLE = {
    "label_points": r"SELECT DISTINCT id, labels FROM (SELECT id, list_reduce(list_prepend('', regexp_extract_all(content, '(?m)^[ \t\n\r\f\x0b]*([a-z])\)', 1)), lambda acc, x: CASE WHEN ascii(x) = 97 + length(acc) THEN acc || x ELSE acc END) labels FROM legal_knowledge_records) WHERE length(labels) >= 2",
    "line_repair": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\n')) - len(regexp_extract_all(regexp_replace(text, '([\p{L},])[ \t]*\n[ \t]*(\p{Ll}{2})', '\1 \2', 'g'), '\n')) AS INTEGER) n_joined FROM documents WHERE n_joined > 0",
    "greedy_select": _R + ", c AS (SELECT *, item_id % 101 / 100 evidence, qid % 2 = 0 multi, max(score) OVER (PARTITION BY qid) top, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS INTEGER) k FROM r WHERE rank <= 8), a AS (SELECT qid, grp g1 FROM c WHERE k = 1), "
    "b AS (SELECT qid, min(k) k2, arg_min(grp, k) g2 FROM c WHERE k > 1 AND " + _FITS.format(least="0.34", gap="0.11") + " GROUP BY qid), "
    "d AS (SELECT c.qid, min(k) k3, arg_min(grp, k) g3 FROM c JOIN a USING (qid) JOIN b USING (qid) WHERE k > k2 AND " + _FITS.format(least="0.54", gap="0.06") + " AND CAST(grp = g1 AS INTEGER) + CAST(grp = g2 AS INTEGER) < 2 AND (grp IN (g1, g2) OR g1 = g2) GROUP BY c.qid), "
    "e AS (SELECT c.qid, min(k) k4 FROM c JOIN a USING (qid) JOIN b USING (qid) JOIN d USING (qid) WHERE k > k3 AND " + _FITS.format(least="1.00", gap="0.06") + " AND CAST(grp = g1 AS INTEGER) + CAST(grp = g2 AS INTEGER) + CAST(grp = g3 AS INTEGER) < 2 AND (grp IN (g1, g2, g3) OR (g1 = g2 AND g2 = g3)) GROUP BY c.qid) "
    "SELECT c.qid, item_id, score, rank FROM c LEFT JOIN b USING (qid) LEFT JOIN d USING (qid) LEFT JOIN e USING (qid) WHERE k = 1 OR k = k2 OR k = k3 OR k = k4",
    "metadata_adjust": _R + "SELECT qid, item_id, round(score + (CASE status WHEN 'P' THEN CAST(-0.10 AS DOUBLE) WHEN 'O' THEN CAST(0.02 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + least(CAST(0.05 AS DOUBLE), CAST(0.01 AS DOUBLE) * (\"year\" - 1992))), 6) score FROM r WHERE rank <= 10",
    "primary_sub_mean": _R + ", s AS (SELECT qid, max(score) FILTER (rank = 1) a, avg(score) FILTER (rank > 1) b FROM r GROUP BY qid) SELECT qid, round(CASE WHEN b IS NULL THEN a ELSE CAST(0.7 AS DOUBLE) * a + CAST(0.3 AS DOUBLE) * b END, 6) score FROM s",
    "cascade_ids": f"WITH t AS (SELECT lower(trim(canonical_title)) t, min(doc_code) z FROM legal_doc_registry GROUP BY 1) SELECT doc_id, coalesce(x.doc_code, y.doc_code, z) entry, CASE WHEN x.doc_code IS NOT NULL THEN 'exact' WHEN y.doc_code IS NOT NULL THEN 'cleaned' WHEN z IS NOT NULL THEN 'title' END step FROM documents d LEFT JOIN legal_doc_registry x ON d.doc_code = x.doc_code LEFT JOIN legal_doc_registry y ON {_CLEAN} = y.doc_code LEFT JOIN t ON lower(trim(d.title)) = t.t",
    "stage_recall": _JUDGED.split(", p AS")[0] + ", k(stage, n) AS (VALUES ('retrieval', 10), ('rerank', 5), ('final', 2)), g AS (SELECT count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) total FROM r) SELECT stage, round(count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) / count(*), 6) p, round(count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) / max(total), 6) r FROM r, k, g WHERE rank <= n GROUP BY stage",
    "answer_rules": r"SELECT id, len(regexp_extract_all(answer, '\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?')) > 0 cites, CAST(len(list_distinct(regexp_extract_all(answer, '\d+'))) AS INTEGER) n_numbers, length(answer) >= 100 long_enough FROM eval_items",
    "topic_quota": "SELECT doc_id, topic FROM (SELECT doc_id, topic, row_number() OVER (PARTITION BY topic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) k FROM documents) WHERE k <= 3",
}
