"""Named queries: versions, votes, scores, selection and citations over ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators import cutoffs, ranking, references, selection, versions
from corpusloom.plans.corpus import _CODE_SQL
from corpusloom.plans.named import Named
from corpusloom.plans.retrieval import _R, _TOK, _bm25_sql, _orders, _recent

query = Named()
_OUT = ("qid", "item_id", "score", "rank")


def _hits(t, k: int = 20):
    q = t("eval_items").select(F.col("id").alias("qid"), F.col("question").alias("text"))
    index = ranking.bm25_index(t("documents").select(F.col("doc_id").alias("item_id"), "text"))
    return ranking.bm25_top(q, index, k)


_H = f"WITH h AS ({_bm25_sql(_TOK, _TOK, True, 20)}) "
_KIND_OF = r"split_part(code, '/', 3)"
_C = _H + f", d AS (SELECT doc_id item_id, {_CODE_SQL.format(c='doc_code')} code, lower(trim(regexp_replace(regexp_replace(coalesce(title, ''), '\\d+', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) name, text, topic, source FROM documents), c AS (SELECT h.*, code, name, text, topic, source, coalesce(TRY_CAST(nullif(regexp_extract(code, '/(\\d{{4}})/', 1), '') AS INTEGER), 0) y, {_KIND_OF} kind FROM h JOIN d USING (item_id)) "


def _candidates(t):
    name = F.lower(X.collapsed(F.regexp_replace(F.coalesce("title", F.lit("")), r"\d+", " ")))
    d = t("documents").select(F.col("doc_id").alias("item_id"), references.law_code(F.col("doc_code")).alias("code"), name.alias("name"), "text", "topic", "source")
    y = F.when(F.col("code").isNotNull(), X.year_of_code(F.col("code"))).otherwise(0)
    return _hits(t).join(d, "item_id").withColumn("y", y).withColumn("kind", F.coalesce(F.get(F.split("code", "/"), F.lit(2)), F.when(F.col("code").isNotNull(), F.lit(""))))


# versions
@query(_C + "SELECT qid, item_id, score, rank FROM (SELECT *, len(list(DISTINCT code) FILTER (code IS NOT NULL) OVER w) k, count(*) FILTER (y > 0) OVER w n, max(y) OVER w m FROM c WINDOW w AS (PARTITION BY qid, kind, name)) WHERE NOT (coalesce(k, 0) >= 2 AND n >= 2 AND y > 0 AND y < m)")
def version_dedup(t):
    """Older versions of one kind and one title without digits, where two codes are dated."""
    return versions.older_dropped(_candidates(t), ["qid", "kind", "name"], "code", "y").select(*_OUT)


_FAMILY = "CASE WHEN code LIKE '%/LX' THEN 'law:' || topic WHEN contains(name, 'xử phạt') THEN 'fine:' || kind WHEN contains(name, 'quy chế') THEN 'rule' END"


@query(_C + f"SELECT qid, item_id, score, rank FROM (SELECT *, max(y) OVER (PARTITION BY qid, f) m FROM (SELECT *, {_FAMILY} f FROM c)) WHERE f IS NULL OR y = 0 OR y >= m")
def family_tags(t):
    """The newest of each family by tag; no tag, no collapse."""
    c = _candidates(t).withColumn("f", F.expr(_FAMILY.replace("contains(name, 'xử phạt')", "contains(name, 'xử phạt')")))
    return versions.family_collapsed(c, "f", "y").select(*_OUT)


@query(_C + ", g AS (SELECT DISTINCT c.code FROM c JOIN legal_effectiveness e ON c.code = upper(regexp_replace(document_number, '\\s', '', 'g')) WHERE eff_code = 'het_hieu_luc'), k AS (SELECT *, code IS NULL OR code NOT IN (SELECT code FROM g) ok, max(y) OVER (PARTITION BY qid, name) m FROM c), v AS (SELECT *, bool_or(ok AND y >= m) OVER (PARTITION BY qid) any_ FROM k) SELECT qid, item_id, score, rank FROM v WHERE (ok AND y >= m) OR NOT any_")
def superseded_filter(t):
    """Without replaced texts and older ones of the same name; never an empty list."""
    gone = t("legal_effectiveness").where("eff_code = 'het_hieu_luc'").select(references.law_code(F.col("document_number")).alias("old_code")).where("old_code is not null")
    return versions.superseded_dropped(_candidates(t), gone, "code", "name", "y").select(*_OUT)


@query(r"WITH v AS (SELECT doc_code, CAST(split_part(doc_code, '/', 2) AS INTEGER) y, split_part(doc_code, '/', 3) k, regexp_replace(lower(canonical_title), '[ \t\n\r\f\x0b]+[^ \t\n\r\f\x0b]+[ \t\n\r\f\x0b]+[^ \t\n\r\f\x0b]+$', '') n FROM legal_doc_registry) SELECT a.doc_code old_code, array_to_string(list(b.doc_code ORDER BY b.y, b.doc_code), ' ') successors FROM v a JOIN v b ON a.k = b.k AND a.n = b.n AND b.y > a.y GROUP BY 1")
def successors(t):
    """For each text the later ones of its kind and subject, in order of time."""
    v = t("legal_doc_registry").select("doc_code", X.year_of_code(F.col("doc_code")).alias("y"), F.split("doc_code", "/")[2].alias("k"), F.regexp_replace(F.lower("canonical_title"), r"\s+\S+\s+\S+$", "").alias("n"))
    edges = v.withColumnsRenamed({"doc_code": "old_code", "y": "y0"}).join(v.withColumnsRenamed({"doc_code": "new_code", "y": "at"}), ["k", "n"]).where("at > y0").select("old_code", "at", "new_code")
    return versions.successors(edges).select("old_code", F.array_join("successors", " ").alias("successors"))


@query(r"WITH c AS (SELECT DISTINCT upper(regexp_replace(law_id, '\s', '', 'g')) a, unnest(regexp_extract_all(law_name, '\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?')) b FROM legal_knowledge_records), i AS (SELECT r.doc_code a, upper(regexp_replace(document_number, '\s', '', 'g')) b FROM legal_doc_registry r JOIN legal_effectiveness ON document_number ILIKE r.doc_code WHERE eff_code = 'het_mot_phan') SELECT a, b, CAST(max(curated) AS BOOLEAN) curated FROM (SELECT a, b, 1 curated FROM c WHERE a <> '' AND a <> b UNION ALL SELECT a, b, 0 FROM i) GROUP BY a, b")
def merged_edges(t):
    """Given and inferred edges as one set; an edge of both is a given one."""
    code = lambda c: F.nullif(F.upper(F.regexp_replace(c, r"\s", "")), F.lit(""))
    given = t("legal_knowledge_records").select(code("law_id").alias("a"), F.explode(F.regexp_extract_all("law_name", F.lit(f"({X.VIETNAMESE.code})"), 1)).alias("b")).where("a is not null and a <> b").withColumn("curated", F.lit(True))
    e = t("legal_effectiveness").where("eff_code = 'het_mot_phan'").select(F.lower("document_number").alias("k"), code("document_number").alias("b"))
    inferred = t("legal_doc_registry").select(F.lower("doc_code").alias("k"), F.col("doc_code").alias("a")).join(e, "k").select("a", "b", F.lit(False).alias("curated"))
    return given.unionByName(inferred).groupBy("a", "b").agg(F.max("curated").alias("curated"))


@query(_C + "SELECT code, min(topic) topic, max(name) title, count(DISTINCT item_id) n_docs, count(DISTINCT qid) n_questions, bool_or(contains(name, 'chi tiết')) amends FROM c WHERE code IS NOT NULL GROUP BY code")
def document_nodes(t):
    """One node per code from its chunks: first fields, counts, whether it amends another."""
    return _candidates(t).where("code is not null").groupBy("code").agg(F.min("topic").alias("topic"), F.max("name").alias("title"), F.count_distinct("item_id").alias("n_docs"), F.count_distinct("qid").alias("n_questions"), F.max(F.col("name").contains("chi tiết")).alias("amends"))


@query(_C + "SELECT qid, kind, count(*) n, array_to_string(list(DISTINCT code ORDER BY code), ' ') codes FROM c WHERE kind IN ('LX', 'NĐ-HĐX') GROUP BY ALL")
def cited_layers(t):
    """The layers a list cites, with their texts."""
    c = _candidates(t).where("kind in ('LX', 'NĐ-HĐX')")
    return c.groupBy("qid", "kind").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("code")), " ").alias("codes"))


# fusion and scores
_B = "(SELECT qid, item_id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END score FROM t WINDOW w AS (PARTITION BY qid))"
_RANKED = "CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank"


@query(_R + f", u AS (SELECT qid, item_id, 0.6::DOUBLE * score s, 'a' n FROM r WHERE rank <= 5 UNION ALL SELECT qid, item_id, 0.6::DOUBLE * score, 'b' FROM {_B} WHERE rank <= 5), v AS (SELECT qid, item_id, round(sum(s) / 1.2::DOUBLE, 6) score, count(DISTINCT n) n_sources FROM u GROUP BY ALL) SELECT *, {_RANKED} FROM v")
def source_votes(t):
    """Weighted votes by the total weight, with the number of sources."""
    spark, d = t.spark, t.folder
    return selection.weighted_votes([("a", 0.6, _orders(spark, d).where("rank <= 5")), ("b", 0.6, ranking.minmax(_recent(spark, d)).where("rank <= 5"))])


@query(_R + ", x AS (SELECT qid, item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY item_id DESC) AS INTEGER) rank FROM o), u AS (SELECT qid, item_id, rank FROM r WHERE rank <= 5 UNION ALL SELECT qid, item_id, rank FROM t WHERE rank <= 5 UNION ALL SELECT * FROM x WHERE rank <= 5), v AS (SELECT qid, item_id, CAST(count(*) AS DOUBLE) score, min(rank) b FROM u GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM (SELECT qid, item_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, b, item_id) AS INTEGER) rank FROM v) WHERE rank <= 10")
def submission_votes(t):
    """Items at least two of three submissions hold, ten at most."""
    spark, d = t.spark, t.folder
    third = ranking.ranked(_orders(spark, d).select("qid", "item_id", F.col("item_id").cast("double").alias("score")))
    return selection.appearances([x.where("rank <= 5") for x in (_orders(spark, d), _recent(spark, d), third)], 2, 10)


@query(_R + f", u AS (SELECT qid, item_id, score a, NULL::DOUBLE b FROM r WHERE rank <= 5 UNION ALL SELECT qid, item_id, NULL, score / 2000 FROM t WHERE rank <= 5), v AS (SELECT qid, item_id, max(a) a, max(b) b FROM u GROUP BY ALL), m AS (SELECT qid, item_id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b + 0.025::DOUBLE) END, 6) score, CAST((a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER AS INTEGER) n_sources FROM v) SELECT *, {_RANKED} FROM m")
def bonus_merge(t):
    """Two lists in order: what both hold is raised."""
    spark, d = t.spark, t.folder
    return selection.merged_with_bonus([_orders(spark, d).where("rank <= 5"), _recent(spark, d).where("rank <= 5").withColumn("score", F.col("score") / 2000)], 0.025)


@query(_R + _R.split(" SELECT")[0][:0] + "SELECT qid, item_id, score, rank FROM (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY f) g FROM (SELECT *, min(rank) OVER (PARTITION BY qid, grp) f, row_number() OVER (PARTITION BY qid, grp ORDER BY rank) n FROM r)) WHERE n <= 2 AND g <= 3")
def two_of_three_groups(t):
    """Two items of a group, and three groups."""
    return selection.of_few_groups(_orders(t.spark, t.folder), "grp", 2, 3).select(*_OUT)


@query(_R + ", f AS (SELECT qid, grp FROM r WHERE rank = 1) SELECT r.qid, item_id, score, rank FROM r JOIN f ON r.qid = f.qid AND r.grp = f.grp QUALIFY score >= 0.70 AND score < 0.92 AND rank BETWEEN 2 AND 4 AND row_number() OVER (PARTITION BY r.qid, score >= 0.70 AND score < 0.92 AND rank BETWEEN 2 AND 4 ORDER BY rank) = 1")
def same_group_band(t):
    """The first item of ranks 2 to 4 in a band of scores and of the best item's group."""
    r = _orders(t.spark, t.folder)
    best = r.where("rank = 1").select("qid", "grp")
    band = r.join(best, ["qid", "grp"]).where("score >= 0.70 and score < 0.92 and rank between 2 and 4")
    return band.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("_n = 1").select(*_OUT)


@query(_R + "SELECT qid, item_id, round(1 / (1 + (1 - score)), 6) a, round(1 - (1 - score), 6) b, round(greatest(0, 1 - 2 * (1 - score)), 6) c FROM r")
def distance_scores(t):
    """Distances as scores, in three ways."""
    far = 1 - F.col("score")
    return _orders(t.spark, t.folder).select("qid", "item_id", F.round(1 / (1 + far), 6).alias("a"), F.round(1 - far, 6).alias("b"), F.round(F.greatest(F.lit(0.0), 1 - 2 * far), 6).alias("c"))


@query(_R + f", u AS (SELECT qid, item_id, score, 'O' store FROM (SELECT *, row_number() OVER (PARTITION BY qid, status ORDER BY score DESC, item_id) k FROM r) WHERE k <= 3) SELECT * FROM (SELECT qid, item_id, score, {_RANKED} FROM u) WHERE rank <= 5")
def fan_out(t):
    """The best of each store, merged to the best of all."""
    r = _orders(t.spark, t.folder)
    w = Window.partitionBy("qid", "status").orderBy(F.desc("score"), "item_id")
    return ranking.top_k(r.withColumn("_k", F.row_number().over(w)).where("_k <= 3").select("qid", "item_id", "score"), 5)


@query(_R + f", l AS (SELECT qid, item_id, grp, CAST(row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, item_id) AS INTEGER) k, count(DISTINCT grp) OVER (PARTITION BY qid) n, score FROM r), u AS (SELECT qid, item_id, CASE WHEN n = 1 THEN score ELSE 1.0::DOUBLE / (60 + k) END s FROM l WHERE k <= 10), v AS (SELECT qid, item_id, round(sum(s), 8) score FROM u GROUP BY ALL) SELECT * FROM (SELECT *, {_RANKED} FROM v) WHERE rank <= 8")
def many_lists_fused(t):
    """The lists of all sub-queries (here: priorities) fused; a single one passes with its own scores."""
    r = _orders(t.spark, t.folder)
    return ranking.rrf_lists(r, "grp", 10, 8)


@query(_C + f", w AS (SELECT id qid, list_distinct(list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 5)) ws FROM eval_items), s AS (SELECT c.qid, item_id, round(10 * score / 100 + 2 * len(list_filter(ws, lambda x: contains(lower(text), x))) + 1.5 * CAST(contains(lower(text), 'biểu phí') AS INTEGER), 8) score FROM c JOIN w USING (qid)) SELECT *, {_RANKED} FROM s")
def linear_words(t):
    """A dense score times ten, two for each word of the question in the text, more for a term of the trade."""
    q = t("eval_items").select(F.col("id").alias("qid"), F.array_distinct(F.filter(X.tokens(F.col("question")), lambda w: F.length(w) >= 5)).alias("ws"))
    low = F.lower("text")
    score = 10 * F.col("score") / 100 + 2 * F.size(F.filter("ws", lambda w: low.contains(w))) + 1.5 * low.contains("biểu phí").cast("int")
    return ranking.ranked(_candidates(t).join(q, "qid").select("qid", "item_id", F.round(score, 8).alias("score")))


@query(_R + ", b AS (SELECT r.qid, r.item_id, (r.score - min(r.score) OVER w) / CASE WHEN max(r.score) OVER w = min(r.score) OVER w THEN 1 ELSE max(r.score) OVER w - min(r.score) OVER w END a, CAST(t.score - 1991 AS DOUBLE) / 10 b, r.grp IN ('1-URGENT', '2-HIGH') g FROM r JOIN t ON r.qid = t.qid AND r.item_id = t.item_id WHERE r.rank <= 10 WINDOW w AS (PARTITION BY r.qid)), c AS (SELECT alpha, thr, mode_ FROM (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) alpha), (SELECT unnest([0.4, 0.6]::DOUBLE[]) thr), (SELECT unnest(['weighted', 'product']) mode_)), s AS (SELECT alpha, thr, mode_, count(*) n, count(*) FILTER (g) hit FROM b, c WHERE round(CASE WHEN mode_ = 'weighted' THEN alpha * a + (1 - alpha) * b ELSE a * b END, 9) >= thr GROUP BY ALL), f AS (SELECT *, hit / n p, hit / (SELECT count(*) FROM b WHERE g) rc FROM s) SELECT mode_, alpha, thr, round(5 * p * rc / (4 * p + rc), 6) f2, CAST(row_number() OVER (ORDER BY round(5 * p * rc / (4 * p + rc), 6) DESC, mode_, alpha, thr) AS INTEGER) place FROM f WHERE hit > 0")
def ensemble_sweep(t):
    """Two scores combined in two ways over a grid of weights and thresholds, best F2 first."""
    spark, d = t.spark, t.folder
    a = ranking.minmax(_orders(spark, d).where("rank <= 10")).select("qid", "item_id", F.col("score").alias("a"), F.col("grp").isin("1-URGENT", "2-HIGH").alias("g"))
    rows = a.join(_recent(spark, d).select("qid", "item_id", ((F.col("score") - 1991) / 10).alias("b")), ["qid", "item_id"])
    return ranking.swept(rows, [0.3, 0.5, 0.7], [0.4, 0.6])


@query(_C + f", q AS (SELECT id qid, list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) ws FROM eval_items), s AS (SELECT qid, item_id, round(len(list_intersect(ws, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')))) / len(ws), 6) score FROM c JOIN q USING (qid) WHERE rank <= 10) SELECT * FROM (SELECT *, {_RANKED} FROM s) WHERE rank <= 5")
def reranked(t):
    """The first ten scored anew by a scorer of pairs (here: the share of the question's words in the text), the best five kept."""
    q = t("eval_items").select(F.col("id").alias("qid"), F.array_distinct(X.tokens(F.col("question"))).alias("ws"))
    pairs = _candidates(t).where("rank <= 10").join(q, "qid")
    share = F.size(F.array_intersect("ws", F.array_distinct(X.tokens(F.col("text"))))) / F.size("ws")
    return ranking.top_k(pairs.select("qid", "item_id", F.round(share, 6).alias("score")), 5)


_WINDOWS = "SELECT item_id, qid, unnest(list_transform(range(1, greatest(length(text) - 200, 1) + 1, 1000), lambda i: substr(text, CAST(i AS BIGINT), 1200))) part FROM c WHERE rank <= 5"


@query(_C + f", q AS (SELECT id qid, list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) ws FROM eval_items), s AS (SELECT w.qid, item_id, round(max(len(list_intersect(ws, list_distinct(regexp_extract_all(lower(part), '[\\p{{L}}\\p{{N}}_]+')))) / len(ws)), 6) score FROM ({_WINDOWS}) w JOIN q USING (qid) GROUP BY ALL) SELECT *, {_RANKED} FROM s")
def maxp_windows(t):
    """Texts in overlapping windows, each scored; the best window is the text's score."""
    from corpusloom.operators.parsing import windows

    q = t("eval_items").select(F.col("id").alias("qid"), F.array_distinct(X.tokens(F.col("question"))).alias("ws"))
    parts = windows(_candidates(t).where("rank <= 5").select(F.struct("qid", "item_id").alias("k"), "text"), "k").select("k.qid", "k.item_id", "part").join(q, "qid")
    share = F.size(F.array_intersect("ws", F.array_distinct(X.tokens(F.col("part"))))) / F.size("ws")
    return ranking.ranked(parts.groupBy("qid", "item_id").agg(F.round(F.max(share), 6).alias("score")))


@query(_C + "SELECT c.qid, item_id, round(score + CASE WHEN code IN (SELECT upper(regexp_replace(document_number, '\\s', '', 'g')) FROM legal_effectiveness WHERE eff_code = 'het_hieu_luc' AND document_number IS NOT NULL) THEN -0.10 ELSE 0 END + CASE WHEN kind = 'QĐ-TTX' THEN -0.05 ELSE 0 END + CASE WHEN kind = 'LX' THEN 0.02 ELSE 0 END + CASE WHEN y > 0 THEN least(0.05, 0.002 * (y - 2000)) ELSE 0 END, 6) score FROM c")
def metadata_scores(t):
    """Expired, local, primary and recent texts: four corrections of a score."""
    gone = t("legal_effectiveness").where("eff_code = 'het_hieu_luc'").select(references.law_code(F.col("document_number")).alias("code")).where("code is not null").distinct().withColumn("_x", F.lit(True))
    c = _candidates(t).join(F.broadcast(gone), "code", "left")
    # What expired, local, primary and later texts lose or gain.
    more = F.when(F.col("_x"), -0.10).otherwise(0.0) + F.when(F.col("kind") == "QĐ-TTX", -0.05).otherwise(0.0) + F.when(F.col("kind") == "LX", 0.02).otherwise(0.0) + F.when(F.col("y") > 0, F.least(F.lit(0.05), 0.002 * (F.col("y") - 2000))).otherwise(0.0)
    return c.select("qid", "item_id", F.round(F.col("score") + more, 6).alias("score"))


_CUTOFF = "CASE WHEN y = 0 THEN 0 WHEN y > 2040 THEN -0.28 WHEN y > 2038 THEN -0.10 WHEN y >= 2035 THEN 0.02 ELSE -0.02 END"


@query(_C + f", x AS (SELECT DISTINCT upper(regexp_replace(document_number, '\\s', '', 'g')) code, eff_code FROM legal_effectiveness WHERE document_number IS NOT NULL AND eff_code IN ('het_hieu_luc', 'con_hieu_luc')) SELECT qid, item_id, round(score + CASE WHEN code IN (SELECT code FROM x WHERE eff_code = 'het_hieu_luc') THEN -0.12 ELSE 0 END + CASE WHEN code IN (SELECT code FROM x WHERE eff_code = 'con_hieu_luc') THEN 0.16 ELSE 0 END * 0.35 + {_CUTOFF} + CASE WHEN contains(name, 'chi tiết') THEN 0.01 ELSE 0 END, 6) score FROM c")
def graph_scores(t):
    """Obsolete and current texts by the status table, years by bucket, a nudge for those that amend."""
    x = t("legal_effectiveness").where("eff_code in ('het_hieu_luc', 'con_hieu_luc')").select(references.law_code(F.col("document_number")).alias("code"), "eff_code").where("code is not null")
    flags = x.groupBy("code").agg(F.max((F.col("eff_code") == "het_hieu_luc").cast("int")).alias("gone"), F.max((F.col("eff_code") == "con_hieu_luc").cast("int")).alias("holds"))
    c = _candidates(t).join(F.broadcast(flags), "code", "left").na.fill(0, ["gone", "holds"])
    # What obsolete and current texts lose and gain, and the weight of the gain.
    score = F.col("score") - 0.12 * F.col("gone") + 0.16 * F.col("holds") * 0.35 + F.expr(_CUTOFF).cast("double") + F.when(F.col("name").contains("chi tiết"), 0.01).otherwise(0.0)
    return c.select("qid", "item_id", F.round(score, 6).alias("score"))


@query(_R + ", e AS (SELECT DISTINCT qid, grp FROM r WHERE status = 'O') SELECT r.qid, item_id, round(score - CASE WHEN status = 'F' AND e.grp IS NOT NULL THEN 0.18 ELSE 0 END, 6) score FROM r LEFT JOIN e ON r.qid = e.qid AND r.grp = e.grp")
def successor_penalty(t):
    """A finished order loses where an open one of its priority is in the same list."""
    r = _orders(t.spark, t.folder)
    later = r.where("status = 'O'").select("qid", "grp").distinct().withColumn("_l", F.lit(True))
    joined = r.join(later, ["qid", "grp"], "left")
    return joined.select("qid", "item_id", F.round(F.col("score") - F.when((F.col("status") == "F") & F.col("_l"), 0.18).otherwise(0.0), 6).alias("score"))


@query("SELECT id qid, variant, text FROM (SELECT id, 0 variant, question text FROM eval_items UNION ALL SELECT id, 1, replace(replace(question, 'xử lý thế nào', 'giải quyết ra sao'), 'còn', 'trong khi') FROM eval_items UNION ALL SELECT id, 2, question || ' căn cứ pháp lý' FROM eval_items WHERE contains(question, 'căn cứ')) WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, text ORDER BY variant) = 1")
def query_variants(t):
    """A question, its phrases replaced in order, and with terms appended; each distinct text once."""
    q = F.col("question")
    given = F.array(q, X.replaced_in_order(q, [("xử lý thế nào", "giải quyết ra sao"), ("còn", "trong khi")]), F.when(q.contains("căn cứ"), F.concat(q, F.lit(" căn cứ pháp lý"))))
    rows = t("eval_items").where(q.isNotNull()).select(F.col("id").alias("qid"), F.posexplode(given).alias("variant", "text")).where("text is not null")
    return rows.groupBy("qid", "text").agg(F.min("variant").alias("variant")).select("qid", "variant", "text")


@query("SELECT id qid, CASE WHEN n < 30 THEN 1 WHEN n < 58 THEN 2 ELSE 3 END n_queries FROM (SELECT id, len(regexp_extract_all(question, '[^ \\t\\n\\r\\f\\x0b]+')) n FROM eval_items WHERE question IS NOT NULL)")
def query_budget(t):
    """How many sub-queries a question of its length gets."""
    n = F.regexp_count("question", F.lit(r"[^ \t\n\r\f\x0b]+"))
    return t("eval_items").where("question is not null").select(F.col("id").alias("qid"), F.when(n < 30, 1).when(n < 58, 2).otherwise(3).alias("n_queries"))


@query(_C + ", g AS (SELECT id qid, gold[1].so_ky_hieu want, topic tp FROM eval_items), m AS (SELECT c.*, code = want s1, topic = tp s2 FROM c LEFT JOIN g USING (qid)), k AS (SELECT *, bool_or(coalesce(s1, false)) OVER (PARTITION BY qid) a1, bool_or(coalesce(s2, false)) OVER (PARTITION BY qid) a2 FROM m) SELECT qid, item_id, score, CASE WHEN a1 THEN 'code' WHEN a2 THEN 'topic' ELSE 'all' END scope FROM k WHERE CASE WHEN a1 THEN s1 WHEN a2 THEN s2 ELSE true END AND score >= 0.2")
def scoped_search(t):
    """Within the document asked for, else its topic, else everywhere; a filter that leaves nothing is lifted."""
    g = t("eval_items").select(F.col("id").alias("qid"), F.get("gold", F.lit(0))["so_ky_hieu"].alias("want"), F.col("topic").alias("tp"))
    m = _candidates(t).join(g, "qid", "left").withColumn("s1", F.coalesce(F.col("code") == F.col("want"), F.lit(False))).withColumn("s2", F.coalesce(F.col("topic") == F.col("tp"), F.lit(False)))
    return cutoffs.scoped(m, [("code", "s1"), ("topic", "s2")]).where("score >= 0.2").select("qid", "item_id", "score", "scope")


@query("WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM n), s AS (SELECT a.vec_id qid, b.vec_id item_id, b.label, round(list_dot_product(a.v, b.v), 6) score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) k FROM s), d AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY k) j FROM r WHERE k <= 6 AND score >= 0.1) SELECT qid, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY k) AS INTEGER) rank FROM d WHERE j = 1) WHERE rank <= 3")
def few_shot(t):
    """Of the six nearest above a floor, one of a label, three at most."""
    v = t("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    near = ranking.knn(v, 20, 6).where("score >= 0.1").join(t("embeddings").select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return ranking.ranked(cutoffs.quota(near, "label", 1).select("qid", "item_id", "score")).where("rank <= 3")


@query(_R + f", a AS (SELECT qid, grp, item_id, row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, item_id) k1, row_number() OVER (PARTITION BY qid, grp ORDER BY \"year\" DESC, item_id) k2 FROM r), s AS (SELECT qid, grp, item_id, round(CASE WHEN k1 <= 5 THEN 1.0::DOUBLE / (60 + k1) ELSE 0 END + CASE WHEN k2 <= 5 THEN 1.0::DOUBLE / (60 + k2) ELSE 0 END, 8) score FROM a WHERE k1 <= 5 OR k2 <= 5) SELECT qid, grp, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, item_id) AS INTEGER) rank FROM s) WHERE rank <= 4")
def targets_fused(t):
    """Two lists fused for each target (here: priority) of a question, four items each."""
    r = _orders(t.spark, t.folder).select(F.struct("qid", "grp").alias("qid"), "item_id", "score", "year")
    lists = [ranking.top_k(r.select("qid", "item_id", "score"), 5), ranking.top_k(r.select("qid", "item_id", F.col("year").cast("double").alias("score")), 5)]
    return ranking.rrf(lists).where("rank <= 4").select("qid.qid", "qid.grp", "item_id", "score", "rank")
