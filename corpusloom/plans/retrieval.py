"""Named queries: retrieval, fusion, cut-offs, selection, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators import cutoffs, evaluate, ranking
from corpusloom.session import tune
from corpusloom.sources.tables import table, wide


def _questions(spark, d):
    return table(tune(spark), d, "eval_items").select(F.col("id").alias("qid"), F.col("question").alias("text"))


def _documents(spark, d):
    return wide(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "item_id")


def bm25_topk(spark, d):
    return ranking.bm25_top(_questions(spark, d), ranking.bm25_index(_documents(spark, d)), 10)


def bm25_lucene(spark, d):
    """Numerator without k1 + 1, tokens of two letters or more."""
    return ranking.bm25_top(_questions(spark, d), ranking.bm25_index(_documents(spark, d), X.long_tokens), 10, plus=False)


def bm25_okapi(spark, d):
    """The package form with its floor for frequent terms, at deployed parameters."""
    return ranking.bm25_top(_questions(spark, d), ranking.bm25_index(_documents(spark, d)), 10, 1.2, 0.65, idf=ranking.okapi_idf(0.25))


def bm25_filtered(spark, d):
    """Words between blanks in lower case, of Vietnamese documents only; frequencies are those of all documents."""
    docs = wide(spark, d, "documents", "doc_id", "text", "lang").withColumnRenamed("doc_id", "item_id")
    return ranking.bm25_top(_questions(spark, d), ranking.bm25_index(docs, X.blank_tokens), 10, where=F.col("lang") == "vi")


def bm25_overlap(spark, d):
    """Titles that resemble each other get equal scores, told apart by the words shared with the question."""
    q = _questions(spark, d)
    index = ranking.bm25_index(table(spark, d, "legal_doc_registry").select(F.col("doc_code").alias("item_id"), F.col("canonical_title").alias("text")))
    return ranking.by_overlap(ranking.bm25_top(q, index, 5), q, index)


def bm25_sparse(spark, d):
    """The same scores as a join of postings, relational from end to end."""
    titles = table(tune(spark), d, "legal_doc_registry").select(F.col("doc_code").alias("item_id"), F.col("canonical_title").alias("text"))
    return ranking.top_k(ranking.bm25(_questions(spark, d), titles), 5)


def _plain_tokens(text):
    return X.tokens(X.unaccented(text))


def bm25_family(spark, d):
    """Accent-sensitive and accent-free lists, fused by reciprocal rank."""
    q, c = _questions(spark, d), _documents(spark, d)
    lists = [ranking.bm25_top(q, ranking.bm25_index(c, how), 100) for how in (X.tokens, _plain_tokens)]
    return ranking.rrf(lists).where("rank <= 10")


def char4_bm25(spark, d):
    """BM25 over runs of four characters of titles (k1 1.5, b 0.4)."""
    grams = lambda t: X.char_ngrams(F.lower(t), 4)
    titles = table(tune(spark), d, "legal_doc_registry").select(F.col("doc_code").alias("item_id"), F.col("canonical_title").alias("text"))
    asked = table(spark, d, "eval_items").select(F.col("id").alias("qid"), F.explode("gold").alias("g")).select("qid", F.col("g.so_ky_hieu").alias("doc_code")).join(titles.withColumnRenamed("item_id", "doc_code"), "doc_code").groupBy("qid").agg(F.max("text").alias("text"))
    return ranking.top_k(ranking.bm25(asked, titles, 1.5, 0.4, tokenize=grams), 5)


def knn_cosine(spark, d):
    return ranking.knn(table(tune(spark), d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")))


def _orders(spark, d):
    """Each customer's orders ranked by price: the ranked lists the selection rules run on."""
    o = table(tune(spark), d, "orders")
    rows = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item_id"), (F.col("o_totalprice") / 524288).alias("score"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    return ranking.ranked(rows)


def _recent(spark, d):
    rows = _orders(spark, d).select("qid", "item_id", F.col("year").cast("double").alias("score"))
    return ranking.ranked(rows)


_R = "WITH o AS (SELECT o_custkey qid, o_orderkey item_id, o_totalprice / 524288 score, o_orderpriority grp, o_orderstatus status, CAST(year(o_orderdate) AS INTEGER) \"year\" FROM orders), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank FROM o), t AS (SELECT qid, item_id, CAST(\"year\" AS DOUBLE) score, CAST(row_number() OVER (PARTITION BY qid ORDER BY \"year\" DESC, item_id) AS INTEGER) rank FROM o) "
_OUT = ("qid", "item_id", "score", "rank")


def _cut(f):
    return lambda spark, d: f(_orders(spark, d)).select(*_OUT)


rank_topk = _cut(lambda r: r.where("rank <= 3"))
cut_fixed = _cut(lambda r: cutoffs.fixed(r, 0.8, 4))
cut_ratio = _cut(lambda r: cutoffs.relative(r, 0.3, 1, 5))
cut_adaptive = _cut(lambda r: cutoffs.relative(r, 0.7, 2, 6, absolute=0.4))
cut_keep_ratio = _cut(lambda r: cutoffs.relative(r.where("score > 0"), 0.9, 2, None))
cut_margin = _cut(lambda r: cutoffs.margin(r, 5, 0.3, 0.15))
cut_softfloor = _cut(lambda r: cutoffs.relative(r, 0.0, 1, 7, absolute=0.38))
largest_gap = _cut(lambda r: cutoffs.largest_gap(r, 2, 0.05))
doc_quota = _cut(lambda r: cutoffs.quota(r, "grp", 1))
minmax_norm = _cut(lambda r: ranking.minmax(r).withColumn("score", F.round("score", 6)))
newest_family = _cut(lambda r: cutoffs.newest(r, ["qid", "grp"], "year"))
never_empty = _cut(lambda r: cutoffs.never_empty(r.withColumn("keep", F.col("score") > 0.85), "keep"))
blacklist_keep_one = _cut(lambda r: cutoffs.keep_one(r.withColumn("bad", F.col("status") == "P"), "bad"))
band_pick = _cut(lambda r: r.where("rank <= 4 and score >= 0.80 and score < 0.92"))


def sibling_expand(spark, d):
    r = _orders(spark, d)
    return cutoffs.siblings(r, cutoffs.relative(r, 0.95, 1, 3), "grp", 0.4, 1).select(*_OUT)


def layer_complement(spark, d):
    """Where all kept items are of one status layer, the first item of another layer with a score of 0.5 or more."""
    r = _orders(spark, d)
    kept = r.where("rank <= 2").groupBy("qid").agg(F.collect_set("status").alias("layers")).where(F.size("layers") == 1)
    other = r.join(kept, "qid").where(~F.array_contains("layers", F.col("status")) & (F.col("score") >= 0.5))
    return other.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("_n = 1").select(*_OUT)


def _rrf(base, weights=None):
    return lambda spark, d: ranking.rrf([_orders(spark, d).where("rank <= 10"), _recent(spark, d).where("rank <= 10")], 60, base, weights)


rrf1, rrf0, wrrf = _rrf(1), _rrf(0), _rrf(1, [0.4, 0.6])


def linear_hybrid(spark, d):
    return ranking.fused_scores(_orders(spark, d).where("rank <= 10"), _recent(spark, d).where("rank <= 10"), 0.6)


def multi_query_merge(spark, d):
    r = _orders(spark, d)
    return ranking.best_of([r.where("rank <= 5"), r.where("status = 'O'").withColumn("score", F.col("score") * 2), r.where("year >= 1997")])


def running_context(spark, d):
    """Packing by rank until a budget of 1.2 is used up."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return _orders(spark, d).withColumn("used", F.round(F.sum("score").over(w), 6)).where("used <= 1.2").select(*_OUT, "used")


def _judged(spark, d):
    r = _orders(spark, d)
    return r.where("rank <= 5").select("qid", F.col("item_id").alias("key"), "rank"), r.where("grp in ('1-URGENT', '2-HIGH')").select("qid", F.col("item_id").alias("key"))


def prf2_macro(spark, d):
    return evaluate.macro(evaluate.per_query(*_judged(spark, d), _customers(spark, d)))


def prf2_of_means(spark, d):
    """F2 of the mean precision and the mean recall, which is not the mean of F2."""
    return prf2_macro(spark, d).select("p", "r", F.col("f2_of_means").alias("f2"), "n")


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("qid"))


def prf2_by_query(spark, d):
    s = evaluate.per_query(*_judged(spark, d), _customers(spark, d))
    return s.select("qid", *[F.round(c, 6).alias(c) for c in ("p", "r", "f2")])


def mrr_recall(spark, d):
    return evaluate.first_hit(*_judged(spark, d), 5)


def coverage(spark, d):
    """Questions whose gold documents are in the corpus: any, all, and the share of gold found."""
    gold = table(tune(spark), d, "eval_items").select("id", F.explode("gold").alias("g")).select("id", F.upper(F.regexp_replace("g.so_ky_hieu", r"\s", "")).alias("code")).distinct()
    have = table(spark, d, "documents").select(F.upper(F.regexp_replace("doc_code", r"\s", "")).alias("code")).where("code is not null").distinct().withColumn("hit", F.lit(1))
    per = gold.join(have, "code", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    return per.agg(F.count("*").alias("n_items"), F.count_if(F.col("hit") > 0).alias("cover_any"), F.count_if(F.col("hit") == F.col("n")).alias("cover_all"), F.round(F.sum("hit") / F.sum("n"), 6).alias("gold_share"))


def param_sweep(spark, d):
    """The cut (ratio, cap) with scores for every configuration over one scored list."""
    pred_all, gold = _orders(spark, d), _judged(spark, d)[1]
    grid = spark.createDataFrame([(c, r, k) for c, (r, k) in enumerate([(0.3, 5), (0.5, 5), (0.7, 3), (0.9, 2)])], "cfg int, ratio double, cap int")
    best = pred_all.withColumn("_b", F.max("score").over(Window.partitionBy("qid"))).crossJoin(F.broadcast(grid))
    kept = best.where((F.col("rank") == 1) | ((F.col("score") >= F.col("ratio") * F.col("_b")) & (F.col("rank") <= F.col("cap"))))
    g = gold.withColumn("gold", F.lit(1))
    per = kept.join(g, [kept.qid == g.qid, kept.item_id == g.key], "left").groupBy("cfg").agg(F.count("*").alias("n_kept"), F.count("gold").alias("n_hit"))
    return per.select("cfg", "n_kept", "n_hit", F.round(F.col("n_hit") / F.col("n_kept"), 6).alias("p"))


def weighted_vote(spark, d):
    """Pseudo-gold: weighted mean of the sources' scores; keep the first at 0.55, the second at 0.82 of it."""
    a = _orders(spark, d).where("rank <= 5").select("qid", "item_id", (0.6 * F.col("score")).alias("s"))
    b = ranking.minmax(_recent(spark, d)).where("rank <= 5").select("qid", "item_id", (0.4 * F.col("score")).alias("s"))
    v = ranking.ranked(a.unionByName(b).groupBy("qid", "item_id").agg(F.round(F.sum("s"), 6).alias("score")))
    top = F.max("score").over(Window.partitionBy("qid"))
    return v.withColumn("_t", top).where("(rank = 1 and score >= 0.55) or (rank = 2 and score >= 0.82 * _t and _t >= 0.55)").select(*_OUT)


def hard_negatives(spark, d):
    """Per question three non-gold items of ranks 4 to 10, picked by hash order."""
    _, gold = _judged(spark, d)
    pool = _orders(spark, d).where("rank between 4 and 10").join(gold.withColumnRenamed("key", "item_id"), ["qid", "item_id"], "left_anti")
    w = Window.partitionBy("qid").orderBy(F.md5(F.col("item_id").cast("string")))
    return pool.withColumn("pick", F.row_number().over(w)).where("pick <= 3").select("qid", "item_id", "rank", "pick")


def intersect_lists(spark, d):
    return _orders(spark, d).where("rank <= 5").select("qid", "item_id").intersect(_recent(spark, d).where("rank <= 5").select("qid", "item_id"))


def except_lists(spark, d):
    return _orders(spark, d).where("rank <= 5").select("qid", "item_id").exceptAll(_recent(spark, d).where("rank <= 5").select("qid", "item_id"))


QUERIES = {k: globals()[k] for k in (
    "bm25_topk bm25_lucene bm25_okapi bm25_filtered bm25_overlap bm25_sparse bm25_family char4_bm25 knn_cosine rank_topk cut_fixed cut_ratio cut_adaptive cut_keep_ratio cut_margin cut_softfloor "
    "largest_gap doc_quota minmax_norm newest_family never_empty blacklist_keep_one band_pick sibling_expand layer_complement rrf1 rrf0 wrrf "
    "linear_hybrid multi_query_merge running_context prf2_macro prf2_of_means prf2_by_query mrr_recall coverage param_sweep weighted_vote "
    "hard_negatives intersect_lists except_lists"
).split()}

_TOK2 = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_BLANK = r"regexp_extract_all(lower(text), '[^ \t\n\r\f\x0b]+')"
_PLAIN = f"regexp_extract_all(translate(lower(text), '{X.ACCENTED}', '{X.BASE}'), '[\\p{{L}}\\p{{N}}_]+')"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


_PROBABLE = "ln(1 + (n - df + 0.5) / (df + 0.5))"


def _bm25_sql(tok_q, tok_d, plus, k, questions="SELECT id qid, question AS text FROM eval_items", corpus="SELECT doc_id item_id, text FROM documents", k1=1.5, b=0.75, idf=_PROBABLE, more="", order="score DESC", last="qid, item_id, score, rank", where="TRUE"):
    num = f"{k1 + 1} *" if plus else ""
    return f"""WITH q AS (SELECT qid, term, count(*) qtf FROM (SELECT qid, unnest({tok_q}) term FROM ({questions})) GROUP BY ALL),
c AS (SELECT item_id, {tok_d} terms FROM ({corpus})), n AS (SELECT count(*) n, avg(len(coalesce(terms, []))) avgdl FROM c),
p AS (SELECT item_id, dl, term, count(*) tf FROM (SELECT item_id, len(terms) dl, unnest(terms) term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) df FROM p GROUP BY term),
s AS (SELECT qid, item_id, round(sum(qtf * {idf} * {num} tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) score FROM p JOIN f USING (term) JOIN q USING (term), n GROUP BY qid, item_id HAVING score > 0){more}
SELECT {last} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}, item_id) AS INTEGER) rank FROM s WHERE {where}) WHERE rank <= {k}"""


_GRAMS = "CASE WHEN length(text) >= 4 THEN list_transform(range(1, CAST(length(text) - 2 AS BIGINT)), lambda i: substr(lower(text), i, 4)) ELSE [] END"
_SEL = "SELECT qid, item_id, score, rank FROM "
_JUDGED = _R + ", p AS (SELECT qid, item_id FROM r WHERE rank <= 5), g AS (SELECT qid, item_id FROM r WHERE grp IN ('1-URGENT', '2-HIGH')), m AS (SELECT coalesce(p.qid, g.qid) qid, count(p.item_id) np, count(g.item_id) ng, count(*) FILTER (p.item_id IS NOT NULL AND g.item_id IS NOT NULL) hit FROM p FULL JOIN g ON p.qid = g.qid AND p.item_id = g.item_id GROUP BY 1), s AS (SELECT c_custkey qid, CASE WHEN coalesce(np, 0) = 0 THEN CASE WHEN coalesce(ng, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE hit / np END p, CASE WHEN coalesce(ng, 0) = 0 THEN 1.0 ELSE hit / ng END r FROM customer LEFT JOIN m ON qid = c_custkey), e AS (SELECT *, CASE WHEN 4 * p + r = 0 THEN 0.0 ELSE 5 * p * r / (4 * p + r) END f2 FROM s) "


def _rrf_sql(base, w=(1.0, 1.0)):
    return _R + f", u AS (SELECT qid, item_id, {w[0]} / (59 + {base} + rank) s FROM r WHERE rank <= 10 UNION ALL SELECT qid, item_id, {w[1]} / (59 + {base} + rank) FROM t WHERE rank <= 10), v AS (SELECT qid, item_id, round(sum(CAST(s AS DOUBLE)), 8) score FROM u GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank FROM v"


def _relative_sql(ratio, least, most, absolute, where="TRUE"):
    return _R + f"{_SEL} (SELECT *, max(score) OVER (PARTITION BY qid) b FROM r WHERE {where}) WHERE rank <= {least} OR (score >= greatest({absolute}, {ratio} * b) AND rank <= {most})"


ORACLE = {
    "bm25_topk": _bm25_sql(_TOK, _TOK, True, 10),
    "bm25_lucene": _bm25_sql(_TOK2, _TOK2, False, 10),
    "bm25_okapi": _bm25_sql(_TOK, _TOK, True, 10, k1=1.2, b=0.65, idf="CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * (SELECT avg(ln(n.n - v.df + 0.5) - ln(v.df + 0.5)) FROM (SELECT term, count(*) df FROM (SELECT DISTINCT item_id, unnest(terms) term FROM c) GROUP BY term) v, n) ELSE ln(n - df + 0.5) - ln(df + 0.5) END"),
    "bm25_filtered": _bm25_sql(_BLANK, _BLANK, True, 10, where="item_id IN (SELECT doc_id FROM documents WHERE lang = 'vi')"),
    "bm25_overlap": _bm25_sql(_TOK, _TOK, True, 5, corpus="SELECT doc_code item_id, canonical_title AS text FROM legal_doc_registry", more=", o AS (SELECT qid, item_id, count(DISTINCT term) overlap FROM p JOIN q USING (term) GROUP BY ALL), x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) r0 FROM s) WHERE r0 <= 5)").replace("SELECT qid, item_id, score, rank FROM (SELECT *,", "SELECT qid, item_id, score, overlap, rank FROM (SELECT qid, item_id, score, CAST(overlap AS INTEGER) overlap,").replace("ORDER BY score DESC, item_id) AS INTEGER) rank FROM s WHERE TRUE", "ORDER BY score DESC, overlap DESC, item_id) AS INTEGER) rank FROM x JOIN o USING (qid, item_id)"),
    "bm25_sparse": _bm25_sql(_TOK, _TOK, True, 5, corpus="SELECT doc_code item_id, canonical_title AS text FROM legal_doc_registry"),
    "bm25_family": "WITH a AS (" + _bm25_sql(_TOK, _TOK, True, 100) + "), b AS (" + _bm25_sql(_PLAIN, _PLAIN, True, 100) + "), u AS (SELECT qid, item_id, 1.0::DOUBLE / (60 + rank) s FROM a UNION ALL SELECT qid, item_id, 1.0::DOUBLE / (60 + rank) FROM b), v AS (SELECT qid, item_id, round(sum(s), 8) score FROM u GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank FROM v) WHERE rank <= 10",
    "char4_bm25": _bm25_sql(_GRAMS, _GRAMS, True, 5, "SELECT id qid, max(canonical_title) AS text FROM (SELECT id, unnest(gold, recursive := true) FROM eval_items) JOIN legal_doc_registry ON so_ky_hieu = doc_code GROUP BY id", "SELECT doc_code item_id, canonical_title AS text FROM legal_doc_registry", 1.5, 0.4),
    "knn_cosine": "WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM n), s AS (SELECT a.vec_id qid, b.vec_id item_id, round(list_dot_product(a.v, b.v), 6) score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank FROM s) WHERE rank <= 10",
    "rank_topk": _R + _SEL + "r WHERE rank <= 3",
    "cut_fixed": _R + _SEL + "(SELECT *, count(*) FILTER (score >= 0.8) OVER (PARTITION BY qid) k FROM r) WHERE CASE WHEN k >= 2 THEN score >= 0.8 ELSE rank <= 2 END",
    "cut_ratio": _relative_sql(0.3, 1, 5, -1e9),
    "cut_adaptive": _relative_sql(0.7, 2, 6, 0.4),
    "cut_keep_ratio": _relative_sql(0.9, 2, 1_000_000_000, -1e9, "score > 0"),
    "cut_margin": _R + _SEL + "(SELECT *, max(score) OVER (PARTITION BY qid) b FROM r) WHERE rank = 1 OR (rank <= 5 AND score >= 0.3 AND score >= b - CAST(0.15 AS DOUBLE))",
    "cut_softfloor": _relative_sql(0.0, 1, 7, 0.38),
    "largest_gap": _R + ", g AS (SELECT *, score - lead(score) OVER (PARTITION BY qid ORDER BY rank) gap, count(*) OVER (PARTITION BY qid) n FROM r), m AS (SELECT *, max(gap) OVER (PARTITION BY qid) mg FROM g), c AS (SELECT *, min(CASE WHEN gap = mg THEN rank END) OVER (PARTITION BY qid) cr FROM m) " + _SEL + "c WHERE n <= 2 OR mg IS NULL OR mg < 0.05 OR rank <= greatest(cr, 2)",
    "doc_quota": _R + _SEL + "(SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY rank) k FROM r) WHERE k = 1",
    "minmax_norm": _R + "SELECT qid, item_id, round((score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) score, rank FROM (SELECT *, min(score) OVER (PARTITION BY qid) lo, max(score) OVER (PARTITION BY qid) hi FROM r)",
    "newest_family": _R + _SEL + '(SELECT *, max("year") OVER (PARTITION BY qid, grp) y FROM r) WHERE "year" = y',
    "never_empty": _R + _SEL + "(SELECT *, max(CAST(score > 0.85 AS INTEGER)) OVER (PARTITION BY qid) k FROM r) WHERE score > 0.85 OR k = 0",
    "blacklist_keep_one": _R + _SEL + "(SELECT *, bool_and(status = 'P') OVER (PARTITION BY qid) k FROM r) WHERE status <> 'P' OR (k AND rank = 1)",
    "band_pick": _R + _SEL + "r WHERE rank <= 4 AND score >= 0.80 AND score < 0.92",
    "sibling_expand": _R + ", k AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY qid) b FROM r) WHERE rank <= 1 OR (score >= 0.95 * b AND rank <= 3)) " + _SEL + "(SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY rank) i FROM (SELECT *, max(score) OVER (PARTITION BY qid) b FROM r) x WHERE score >= b - CAST(0.4 AS DOUBLE) AND NOT EXISTS (SELECT 1 FROM k WHERE k.qid = x.qid AND k.item_id = x.item_id) AND EXISTS (SELECT 1 FROM k WHERE k.qid = x.qid AND k.grp = x.grp)) WHERE i = 1",
    "layer_complement": _R + ", k AS (SELECT qid, max(status) s FROM r WHERE rank <= 2 GROUP BY qid HAVING count(DISTINCT status) = 1) " + _SEL + "(SELECT r.*, row_number() OVER (PARTITION BY r.qid ORDER BY rank) i FROM r JOIN k ON r.qid = k.qid WHERE status <> s AND score >= 0.5) WHERE i = 1",
    "rrf1": _rrf_sql(1),
    "rrf0": _rrf_sql(0),
    "wrrf": _rrf_sql(1, (0.4, 0.6)),
    "linear_hybrid": _R + ", a AS (SELECT qid, item_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END x FROM r WHERE rank <= 10 WINDOW w AS (PARTITION BY qid)), b AS (SELECT qid, item_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END y FROM t WHERE rank <= 10 WINDOW w AS (PARTITION BY qid)), f AS (SELECT qid, item_id, round(CAST(0.6 AS DOUBLE) * coalesce(x, 0) + CAST(0.4 AS DOUBLE) * coalesce(y, 0), 6) score FROM a FULL JOIN b USING (qid, item_id)) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank FROM f",
    "multi_query_merge": _R + ", u AS (SELECT qid, item_id, score FROM r WHERE rank <= 5 UNION ALL SELECT qid, item_id, score * 2 FROM r WHERE status = 'O' UNION ALL SELECT qid, item_id, score FROM r WHERE \"year\" >= 1997), m AS (SELECT qid, item_id, max(score) score FROM u GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank FROM m",
    "running_context": _R + "SELECT qid, item_id, score, rank, used FROM (SELECT *, round(sum(score) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) used FROM r) WHERE used <= 1.2",
    "prf2_macro": _JUDGED + "SELECT round(avg(p), 6) p, round(avg(r), 6) r, round(avg(f2), 6) f2, round(5 * avg(p) * avg(r) / (4 * avg(p) + avg(r)), 6) f2_of_means, count(*) n FROM e",
    "prf2_of_means": _JUDGED + "SELECT round(avg(p), 6) p, round(avg(r), 6) r, round(5 * avg(p) * avg(r) / (4 * avg(p) + avg(r)), 6) f2, count(*) n FROM e",
    "prf2_by_query": _JUDGED + "SELECT qid, round(p, 6) p, round(r, 6) r, round(f2, 6) f2 FROM e",
    "mrr_recall": _R + ", g AS (SELECT qid, item_id, rank FROM r WHERE grp IN ('1-URGENT', '2-HIGH')), s AS (SELECT qid, count(*) n, min(rank) FILTER (rank <= 5) f, count(*) FILTER (rank <= 5) hit FROM g GROUP BY qid) SELECT round(avg(coalesce(1 / f, 0)), 6) mrr, round(avg(hit / n), 6) recall_at_k FROM s",
    "coverage": r"WITH g AS (SELECT DISTINCT id, upper(regexp_replace(so_ky_hieu, '\s', '', 'g')) code FROM (SELECT id, unnest(gold, recursive := true) FROM eval_items)), h AS (SELECT DISTINCT upper(regexp_replace(doc_code, '\s', '', 'g')) code FROM documents WHERE doc_code IS NOT NULL), p AS (SELECT id, count(*) n, count(h.code) hit FROM g LEFT JOIN h USING (code) GROUP BY id) SELECT count(*) n_items, count(*) FILTER (hit > 0) cover_any, count(*) FILTER (hit = n) cover_all, round(sum(hit) / sum(n), 6) gold_share FROM p",
    "param_sweep": _R + ", c(cfg, ratio, cap) AS (VALUES (0, 0.3::DOUBLE, 5), (1, 0.5::DOUBLE, 5), (2, 0.7::DOUBLE, 3), (3, 0.9::DOUBLE, 2)), k AS (SELECT cfg, grp FROM (SELECT *, max(score) OVER (PARTITION BY qid) b FROM r), c WHERE rank = 1 OR (score >= ratio * b AND rank <= cap)) SELECT cfg, count(*) n_kept, count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) n_hit, round(count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) / count(*), 6) p FROM k GROUP BY cfg",
    "weighted_vote": _R + ", b AS (SELECT qid, item_id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END y FROM t WINDOW w AS (PARTITION BY qid)), u AS (SELECT qid, item_id, CAST(0.6 AS DOUBLE) * score s FROM r WHERE rank <= 5 UNION ALL SELECT qid, item_id, CAST(0.4 AS DOUBLE) * y FROM b WHERE rank <= 5), v AS (SELECT qid, item_id, round(sum(s), 6) score FROM u GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank, max(score) OVER (PARTITION BY qid) m FROM v) " + _SEL + "k WHERE (rank = 1 AND score >= 0.55) OR (rank = 2 AND score >= CAST(0.82 AS DOUBLE) * m AND m >= 0.55)",
    "hard_negatives": _R + "SELECT qid, item_id, rank, pick FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY md5(CAST(item_id AS VARCHAR))) AS INTEGER) pick FROM r WHERE rank BETWEEN 4 AND 10 AND grp NOT IN ('1-URGENT', '2-HIGH')) WHERE pick <= 3",
    "intersect_lists": _R + "SELECT qid, item_id FROM r WHERE rank <= 5 INTERSECT SELECT qid, item_id FROM t WHERE rank <= 5",
    "except_lists": _R + "SELECT qid, item_id FROM r WHERE rank <= 5 EXCEPT ALL SELECT qid, item_id FROM t WHERE rank <= 5",
}
