"""Named queries: selection by evidence, citations, checks of answers, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators import cutoffs, ranking, selection, versions
from corpusloom.plans.named import Named
from corpusloom.plans.retrieval import _R, _orders
from corpusloom.plans.selects import _C, _RANKED, _candidates

query = Named()
_OUT = ("qid", "item_id", "score", "rank")
_WS = r"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))"

# top k, least score, margin, least score of siblings, drop status P, siblings
_SETTINGS = [(0, 3, 0.0, 1.0, False, False), (1, 5, 0.3, 0.2, False, False), (2, 5, 0.3, 0.2, True, False), (3, 5, 0.3, 0.2, True, True), (4, 2, 0.5, 0.1, False, True), (5, 1, 0.0, 0.0, True, True)]


@query(
    _R + ", c(cfg, k, lo, mar, dr, sib) AS (VALUES " + ", ".join(str(s).replace("(", "(", 1) for s in _SETTINGS).replace("True", "true").replace("False", "false") + "), x AS (SELECT r.*, c.*, max(score) OVER (PARTITION BY r.qid, cfg) b FROM r, c WHERE NOT (dr AND status = 'P')), y AS (SELECT *, row_number() OVER (PARTITION BY qid, cfg ORDER BY rank) p FROM x), "
    "z AS (SELECT *, p = 1 OR (p <= k AND score >= lo AND score >= b - CAST(mar AS DOUBLE)) kept FROM y), s AS (SELECT *, bool_or(kept) OVER (PARTITION BY qid, cfg, grp) g FROM z) SELECT cfg, count(*) n_kept, count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) n_hit FROM s WHERE kept OR (sib AND g AND p <= 10) GROUP BY cfg"
)
def cutoff_grid(t):
    """One scored list cut anew for six settings: top k, least score, margin, a status dropped, siblings added."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("cfg", "k", "lo", "mar", "dr", "sib"), s, strict=True)]) for s in _SETTINGS])
    x = _orders(t.spark, t.folder).withColumn("c", F.explode(grid)).select("*", "c.*").where(~(F.col("dr") & (F.col("status") == "P")))
    w = Window.partitionBy("qid", "cfg")
    y = x.withColumn("b", F.max("score").over(w)).withColumn("p", F.row_number().over(w.orderBy("rank")))
    kept = (F.col("p") == 1) | ((F.col("p") <= F.col("k")) & (F.col("score") >= F.col("lo")) & (F.col("score") >= F.col("b") - F.col("mar")))
    z = y.withColumn("kept", kept).withColumn("g", F.max(F.col("kept").cast("int")).over(Window.partitionBy("qid", "cfg", "grp")) == 1)
    out = z.where(F.col("kept") | (F.col("sib") & F.col("g") & (F.col("p") <= 10)))
    return out.groupBy("cfg").agg(F.count("*").alias("n_kept"), F.count_if(F.col("grp").isin("1-URGENT", "2-HIGH")).alias("n_hit"))


@query(_C + f", w AS (SELECT *, {_WS.format(c='name')} ws FROM c WHERE NOT contains(name, 'chi tiết')) SELECT qid, item_id, score, rank FROM c WHERE NOT EXISTS (SELECT 1 FROM w a JOIN w b ON a.qid = b.qid AND a.kind = b.kind AND b.y > a.y AND a.y > 0 AND a.code <> b.code WHERE a.qid = c.qid AND a.item_id = c.item_id AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.75)")
def topic_version_drop(t):
    """Without items of which the list holds a newer version: one kind, titles alike by three words in four, no amendment."""
    c = _candidates(t)
    v = c.where(~F.col("name").contains("chi tiết")).where("y > 0").select("qid", "item_id", "kind", "code", "y", F.array_distinct(X.tokens(F.col("name"))).alias("ws"))
    pairs = v.join(v.withColumnsRenamed({"item_id": "i2", "code": "code2", "y": "y2", "ws": "ws2"}), ["qid", "kind"]).where("y2 > y and code <> code2")
    old = pairs.where(X.jaccard(F.col("ws"), F.col("ws2")) >= 0.75).select("qid", "item_id")
    return c.join(old, ["qid", "item_id"], "left_anti").select(*_OUT)


@query(_R + ", k AS (SELECT * FROM r WHERE rank <= 2), a AS (SELECT r.*, row_number() OVER (PARTITION BY qid ORDER BY rank) n FROM r WHERE rank > 2 AND grp = '5-LOW' AND qid % 3 = 0 AND score >= 0.25) SELECT qid, item_id, score, rank FROM k UNION ALL SELECT qid, item_id, score, rank FROM a WHERE n = 1")
def conditional_add(t):
    """Questions of a kind get the best candidate of a list of allowed ones besides the first two."""
    r = _orders(t.spark, t.folder)
    more = r.where("rank > 2 and grp = '5-LOW' and qid % 3 = 0 and score >= 0.25")
    first = more.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("_n = 1")
    return r.where("rank <= 2").select(*_OUT).unionByName(first.select(*_OUT))


_OVER = "len(list_intersect({a}, {b})) / greatest(len({a}), 1)"


@query(_C + f", q AS (SELECT id qid, {_WS.format(c='question')} qw, {_WS.format(c='answer')} aw FROM eval_items), s AS (SELECT c.qid, item_id, rank, score, {_WS.format(c='text')} tw, {_WS.format(c='name')} nw, qw, aw FROM c JOIN q USING (qid) WHERE rank <= 8), e AS (SELECT qid, item_id, round(score / 100 + 0.26 * {_OVER.format(a='qw', b='tw')} + 0.18 * {_OVER.format(a='qw', b='nw')} + 0.12 * {_OVER.format(a='aw', b='tw')} + 0.14 * {_OVER.format(a='list_filter(aw, lambda x: regexp_full_match(x, chr(92) || chr(100) || chr(43)))', b='tw')} - 0.03 * (rank - 1), 6) score FROM s) SELECT *, {_RANKED} FROM e")
def evidence_scores(t):
    """Reranking score with shares of the question, the answer and its numbers in text and title, less for later ranks."""
    words = lambda c: F.array_distinct(X.tokens(F.col(c)))
    q = t("eval_items").select(F.col("id").alias("qid"), words("question").alias("qw"), words("answer").alias("aw"))
    s = _candidates(t).where("rank <= 8").join(q, "qid").withColumn("tw", words("text")).withColumn("nw", words("name"))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    numbers = F.filter("aw", lambda x: x.rlike(r"^\d+$"))
    # Weights of question in text and title, answer in text, its numbers, and the loss per rank.
    score = F.col("score") / 100 + 0.26 * share(F.col("qw"), F.col("tw")) + 0.18 * share(F.col("qw"), F.col("nw")) + 0.12 * share(F.col("aw"), F.col("tw")) + 0.14 * share(numbers, F.col("tw")) - 0.03 * (F.col("rank") - 1)
    return ranking.ranked(s.select("qid", "item_id", F.round(score, 6).alias("score")))


_REASON = "CASE WHEN rank = 1 THEN NULL WHEN y > 0 AND y < 2032 THEN 'old' WHEN name = '' THEN 'no_title' WHEN score < 0.5 * top THEN 'far' WHEN topic IS NULL THEN 'no_topic' END"


@query(_C + f", m AS (SELECT *, max(score) OVER (PARTITION BY qid) top FROM c WHERE rank <= 6), v AS (SELECT *, {_REASON} reason FROM m) SELECT qid, item_id, rank, coalesce(reason, 'kept') reason FROM v WHERE reason IS NULL OR (reason = 'far' AND code IN (SELECT code FROM m m2 WHERE m2.qid = v.qid AND m2.rank = 1))")
def veto_by_reason(t):
    """The first reason for suspicion drops an item; distance alone does not within the best item's document."""
    m = _candidates(t).where("rank <= 6").withColumn("top", F.max("score").over(Window.partitionBy("qid"))).withColumn("reason", F.expr(_REASON))
    same = F.col("code").isNotNull() & (F.col("code") == F.max(F.when(F.col("rank") == 1, F.col("code"))).over(Window.partitionBy("qid")))
    out = m.withColumn("same", same).where(F.col("reason").isNull() | ((F.col("reason") == "far") & F.col("same")))
    return out.select("qid", "item_id", "rank", F.coalesce("reason", F.lit("kept")).alias("reason"))


_CL = r"list_transform(list_filter(list_transform(string_split_regex(question, ',[ ]*còn[ ]+|[ ]+khi[ ]+|[ ]+thì[ ]+'), lambda x: trim(x)), lambda x: length(x) >= 15)[1:5], lambda x: list_distinct(list_filter(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3)))"
_COV = "len(list_intersect(ws[{i}], cl[k[1]])) / greatest(len(cl[k[1]]), 1)"


@query(
    _C + f", q AS (SELECT id qid, {_CL} cl FROM eval_items WHERE question IS NOT NULL), p AS (SELECT qid, list(item_id ORDER BY rank) it, list(score ORDER BY rank) sc, list(CAST(rank AS INTEGER) ORDER BY rank) rk, list({_WS.format(c='text')} ORDER BY rank) ws FROM c WHERE rank <= 16 GROUP BY qid), "
    "s AS (SELECT *, list_filter(range(1, len(it) + 1), lambda i: sc[i] >= greatest(0.34, 0.97 * sc[1]) OR i = 1)[1:4] near FROM p JOIN q USING (qid)), "
    f"f AS (SELECT qid, it, sc, rk, list_reduce(list_prepend(near, list_transform(range(1, len(cl) + 1), lambda i: [i])), lambda acc, k: CASE WHEN len(acc) >= 4 OR len(list_filter(acc, lambda i: {_COV.format(i='i')} >= 0.75)) > 0 THEN acc ELSE list_concat(acc, list_transform(list_reverse_sort(list_transform(list_filter(range(1, len(it) + 1), lambda j: NOT list_contains(acc, j) AND {_COV.format(i='j')} >= 0.42), lambda j: [round({_COV.format(i='j')}, 6), sc[j], -rk[j]]))[1:1], lambda b: CAST(list_position(rk, CAST(-b[3] AS INTEGER)) AS BIGINT))) END) pick FROM s) SELECT qid, it[i] item_id, sc[i] score, rk[i] rank FROM (SELECT qid, it, sc, rk, unnest(pick) i FROM f)"
)
def clause_cover(t):
    """Items near the best, then for each clause of the question that none covers the item that covers it best; four at most."""
    clauses = F.transform(X.clauses(F.col("question"), r",[ ]*còn[ ]+|[ ]+khi[ ]+|[ ]+thì[ ]+", 15, 5), lambda c: F.array_distinct(F.filter(X.tokens(c), lambda w: F.length(w) >= 3)))
    q = t("eval_items").where("question is not null").select(F.col("id").alias("qid"), clauses.alias("cl"))
    rows = _candidates(t).where("rank <= 16").join(q, "qid").select(*_OUT, "cl", F.array_distinct(X.tokens(F.col("text"))).alias("ws"))
    # Least score of all, and least share of a clause that adds an item; the other two suit these data.
    return selection.covering(rows, "cl", "ws", 0.97, 0.34, 4, 0.75, 0.42).select(*_OUT)


_GROUPS = [("fee", "mức phí"), ("file", "hồ sơ"), ("term", "ngày"), ("duty", "phải")]
_HAS = "[" + ", ".join(f"CASE WHEN contains(lower({{c}}), '{p}') THEN '{n}' END" for n, p in _GROUPS) + "]"


@query(
    _C + f", m AS (SELECT c.*, list_filter({_HAS.format(c='text')}, lambda x: x IS NOT NULL) own FROM c), q AS (SELECT id qid, list_filter({_HAS.format(c='answer')}, lambda x: x IS NOT NULL) want FROM eval_items), b AS (SELECT qid, code code1, own own1, score top FROM m WHERE rank = 1), j AS (SELECT m.qid, item_id, score, rank, len(list_filter(want, lambda x: list_contains(own, x) AND NOT list_contains(own1, x))) n FROM m JOIN q USING (qid) JOIN b USING (qid) WHERE rank > 1 AND code = code1 AND score >= 0.5 * top) SELECT qid, item_id, score, rank, CAST(n AS INTEGER) n FROM j WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, rank) = 1"
)
def group_complement(t):
    """From the best item's document the one that adds most keyword groups the answer asks for and the best item lacks."""
    groups = lambda c: X.groups_in(F.col(c), _GROUPS)
    m = _candidates(t).withColumn("own", groups("text"))
    q = t("eval_items").select(F.col("id").alias("qid"), groups("answer").alias("want"))
    best = m.where("rank = 1").select("qid", F.col("code").alias("code1"), F.col("own").alias("own1"), F.col("score").alias("top"))
    j = m.where("rank > 1").join(q, "qid").join(best, "qid").where("code = code1 and score >= 0.5 * top")
    n = F.size(F.array_except(F.array_intersect("want", "own"), "own1"))
    out = j.withColumn("n", n).where("n > 0")
    return out.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "rank"))).where("_k = 1").select(*_OUT, "n")


@query(_C + "SELECT qid, array_to_string(list(code ORDER BY rank), ' ') docs FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) k FROM (SELECT qid, code, min(rank) rank FROM c WHERE code IS NOT NULL AND rank <= 10 GROUP BY qid, code)) WHERE k <= 3 GROUP BY qid")
def reference_list(t):
    """The first three distinct documents of a list, in its order."""
    firsts = _candidates(t).where("code is not null and rank <= 10").groupBy("qid", "code").agg(F.min("rank").alias("rank"))
    few = firsts.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("_k <= 3")
    return few.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]), " ").alias("docs"))


@query(_C + ", u AS (SELECT qid, item_id, rank, length(text) n, sum(length(text) + 4) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) s FROM c), v AS (SELECT *, min(rank) FILTER (s > 3000) OVER (PARTITION BY qid) f FROM u) SELECT qid, item_id, rank, CAST(CASE WHEN s <= 3000 THEN n ELSE 3000 - (s - n - 4) END AS INTEGER) taken FROM v WHERE s <= 3000 OR (rank = f AND 3000 - (s - n - 4) > 200)")
def context_tail(t):
    """Texts by rank until 3,000 characters are used, and a part of the next if more than 200 are left for it."""
    rows = _candidates(t).withColumn("n", F.length("text"))
    return selection.packed_context(rows, "n", 3000).select("qid", "item_id", "rank", "taken")


_AN = r"list_distinct(regexp_extract_all(answer, '\d+'))"


@query(
    r"WITH g AS (SELECT id, array_to_string(list_transform(gold, lambda g: g.so_ky_hieu || ' Điều ' || g.dieu_so), '; ') ctx, coalesce(question, '') || ' ' || ctx near, answer FROM eval_items WHERE answer IS NOT NULL), a AS (SELECT *, answer || CASE WHEN id % 2 = 0 THEN ' (theo ' || ctx || ')' ELSE ' (theo Điều 9999 của 999/2030/LX, 5%)' END said FROM g) "
    r"SELECT id, len(list_filter(list_distinct(regexp_extract_all(said, 'Điều (\d+)', 1)), lambda n: NOT list_contains(regexp_extract_all(ctx, 'Điều (\d+)', 1), n))) = 0 in_context, len(list_filter(list_distinct(regexp_extract_all(said, '\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?')), lambda c: NOT list_contains(known, c))) = 0 codes_known, len(regexp_extract_all(said, '\d+%')) = 0 percents_ok, length(regexp_extract(said, '\d{1,4}/\d{4}/\p{Lu}+')) > 0 cites, length(said) >= 100 long_enough FROM a, (SELECT list(doc_code) known FROM legal_doc_registry)"
)
def answer_checks(t):
    """Five rules for an answer: articles in its context, codes known, percentages in the context, a citation, length."""
    code = X.VIETNAMESE.code
    ctx = F.array_join(F.transform("gold", lambda g: F.concat(g["so_ky_hieu"], F.lit(" Điều "), g["dieu_so"].cast("string"))), "; ")
    a = t("eval_items").where("answer is not null").withColumn("ctx", ctx)
    said = F.concat("answer", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" (theo "), "ctx", F.lit(")"))).otherwise(" (theo Điều 9999 của 999/2030/LX, 5%)"))
    a = a.withColumn("said", said).withColumn("codes", F.array_distinct(F.regexp_extract_all("said", F.lit(f"({code})"), 1)))
    known = t("legal_doc_registry").select(F.col("doc_code").alias("c")).distinct().withColumn("ok", F.lit(1))
    unknown = a.select("id", F.explode("codes").alias("c")).join(known, "c", "left").groupBy("id").agg(F.count_if(F.col("ok").isNull()).alias("n"))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"Điều (\d+)"), 1))
    percents = F.size(F.array_except(F.regexp_extract_all("said", F.lit(r"(\d+%)"), 1), F.regexp_extract_all("ctx", F.lit(r"(\d+%)"), 1)))
    return a.join(unknown, "id", "left").select(
        "id", (F.size(F.array_except(numbers("said"), numbers("ctx"))) == 0).alias("in_context"), (F.coalesce("n", F.lit(0)) == 0).alias("codes_known"), (percents == 0).alias("percents_ok"), (F.size("codes") > 0).alias("cites"), (F.length("said") >= 100).alias("long_enough")
    )


@query("SELECT id, trim(answer) || ' Theo 5 thì làm, Điều ' || gold[1].dieu_so || ' cho phép.' answer FROM eval_items WHERE answer IS NOT NULL AND len(gold) > 0 AND NOT regexp_matches(answer, '(?i)điều\\s+\\d|[ ]{2}|\\s[,.;)]|\\(\\s*\\)') ")
def uncited_removed(t):
    """Mentions of articles that are not among the item's own are cut out of the text, with the clause before and 'của' behind."""
    own = F.transform("gold", lambda g: g["dieu_so"].cast("string"))
    said = F.concat(F.trim("answer"), F.lit(" Theo khoản 3 Điều 99999 của 5 thì làm (Điều 88888), Điều "), F.get("gold", F.lit(0))["dieu_so"].cast("string"), F.lit(" cho phép."))
    rows = t("eval_items").where(F.col("answer").isNotNull() & (F.size("gold") > 0)).where(~F.col("answer").rlike(r"(?iu)điều\s+\d|[ ]{2}|\s[,.;)]|\(\s*\)"))
    return rows.select("id", selection.without_uncited(said, own).alias("answer"))


@query("SELECT count(*) n, count(*) - count(DISTINCT id) repeated, count(*) FILTER (question IS NULL OR answer IS NULL OR topic IS NULL) nulls, count(*) FILTER (length(answer) < 150) short, count(*) FILTER (len(coalesce(gold, [])) = 0) no_gold, count(*) = 240 complete FROM eval_items")
def output_checks(t):
    """Rows, repeated ids, nulls, short answers and answers without references of a result."""
    null = F.col("question").isNull() | F.col("answer").isNull() | F.col("topic").isNull()
    n = F.count("*")
    return t("eval_items").agg(n.alias("n"), (n - F.count_distinct("id")).alias("repeated"), F.count_if(null).alias("nulls"), F.count_if(F.length("answer") < 150).alias("short"), F.count_if(F.coalesce(F.size("gold"), F.lit(0)) <= 0).alias("no_gold"), (n == 240).alias("complete"))


_SAID = "CASE WHEN id % 3 = 0 THEN 'theo ' || gold[1].so_ky_hieu || ', Điều ' || gold[1].dieu_so || '.' WHEN id % 3 = 1 THEN 'theo Điều ' || gold[1].dieu_so || '.' ELSE 'không dẫn' END"


@query(f"WITH g AS (SELECT id qid, {_SAID} said, gold FROM eval_items WHERE len(gold) > 0), x AS (SELECT qid, said, CAST(unnest(range(1, len(gold) + 1)) AS INTEGER) rank, gold FROM g), h AS (SELECT qid, rank, said, gold[rank].so_ky_hieu code, 'Điều ' || gold[rank].dieu_so article FROM x), v AS (SELECT *, CASE WHEN contains(said, code) AND contains(said, article) THEN 1 WHEN contains(said, article) THEN 2 WHEN rank <= 3 THEN 3 END tier FROM h) SELECT qid, code, article, tier FROM v WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY qid)")
def three_tiers(t):
    """Sources an answer cites by code and article, else by article, else the first three."""
    said = F.when(F.col("id") % 3 == 0, F.concat(F.lit("theo "), F.col("gold")[0]["so_ky_hieu"], F.lit(", Điều "), F.col("gold")[0]["dieu_so"].cast("string"), F.lit("."))).when(F.col("id") % 3 == 1, F.concat(F.lit("theo Điều "), F.col("gold")[0]["dieu_so"].cast("string"), F.lit("."))).otherwise("không dẫn")
    g = t("eval_items").where(F.size("gold") > 0).select(F.col("id").alias("qid"), said.alias("said"), F.posexplode("gold").alias("pos", "g"))
    h = g.select("qid", "said", (F.col("pos") + 1).alias("rank"), F.col("g.so_ky_hieu").alias("code"), F.concat(F.lit("Điều "), F.col("g.dieu_so").cast("string")).alias("article"))
    return selection.cited(h, "said", "code", "article").select("qid", "code", "article", "tier")


@query(_R + ", c AS (SELECT DISTINCT qid, [CAST(qid % 4 AS INTEGER), 2, CAST(qid % 4 AS INTEGER), 99] p FROM r), u AS (SELECT qid, unnest(range(1, len(list_distinct(p)) + 1)) i, p FROM c), w AS (SELECT qid, p[i] rank, min(i) place FROM (SELECT qid, p, unnest(range(1, 5)) i FROM c) GROUP BY ALL), j AS (SELECT r.qid, item_id, r.rank, place FROM r JOIN w ON r.qid = w.qid AND r.rank = w.rank) SELECT qid, item_id, rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) place FROM j UNION ALL SELECT qid, item_id, rank, 1 FROM r WHERE rank = 1 AND qid NOT IN (SELECT qid FROM j)")
def by_index_list(t):
    """Items at chosen positions, repeats and positions that are none left out; the first item where none is left."""
    r = _orders(t.spark, t.folder)
    i = (F.col("qid") % 4).cast("int")
    chosen = r.select("qid").distinct().select("qid", F.array(i, F.lit(2), i, F.lit(99)).alias("positions"))
    out = selection.by_positions(r.select("qid", "item_id", "rank"), chosen)
    return out.select("qid", "item_id", "rank", F.row_number().over(Window.partitionBy("qid").orderBy("place")).alias("place"))


@query(_R + ", c AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) thr), k AS (SELECT thr, r.* FROM r, c WHERE rank = 1 OR (score >= thr AND rank <= 5)) SELECT thr, qid, item_id, rank FROM (SELECT *, max(\"year\") OVER (PARTITION BY thr, qid, grp) m FROM k) WHERE \"year\" = m")
def floor_variants(t):
    """The first item and those from a threshold on, five at most, the newest of a family; three thresholds."""
    thr = F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7))))
    k = _orders(t.spark, t.folder).withColumn("thr", thr).where((F.col("rank") == 1) | ((F.col("score") >= F.col("thr")) & (F.col("rank") <= 5)))
    return cutoffs.newest(k, ["thr", "qid", "grp"], "year").select("thr", "qid", "item_id", "rank")


@query(_C + f", k AS (SELECT *, max(y) OVER (PARTITION BY qid, kind, name) m FROM c WHERE rank <= 12 AND code IS NOT NULL) SELECT qid, item_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS INTEGER) rank FROM k WHERE kind IS NULL OR y = 0 OR y >= m QUALIFY rank <= 5")
def collapsed_first(t):
    """Rows without a code dropped, versions collapsed among the first twelve, then five kept with their scores."""
    few = _candidates(t).where("rank <= 12 and code is not null").withColumn("f", F.concat_ws("#", "kind", "name"))
    return ranking.top_k(versions.family_collapsed(few, "f", "y").select("qid", "item_id", "score"), 5)


@query(_R + ", x AS (SELECT qid, item_id FROM t WHERE rank <= 3), m AS (SELECT r.*, ['top', 'both', 'all'][1 + r.qid % 3] mode_, x.item_id IS NOT NULL s FROM r LEFT JOIN x ON r.qid = x.qid AND r.item_id = x.item_id) SELECT qid, item_id, mode_ FROM m WHERE CASE mode_ WHEN 'top' THEN rank <= 2 WHEN 'both' THEN rank <= 5 AND s ELSE s END")
def citation_modes(t):
    """First items, those a second list holds too, or all of the second list: three ways in one plan."""
    from corpusloom.plans.retrieval import _recent

    r = _orders(t.spark, t.folder)
    x = _recent(t.spark, t.folder).where("rank <= 3").select("qid", "item_id").withColumn("s", F.lit(True))
    m = r.join(x, ["qid", "item_id"], "left").withColumn("s", F.coalesce("s", F.lit(False))).withColumn("mode_", F.get(F.array(F.lit("top"), F.lit("both"), F.lit("all")), (F.col("qid") % 3).cast("int")))
    keep = F.when(F.col("mode_") == "top", F.col("rank") <= 2).when(F.col("mode_") == "both", (F.col("rank") <= 5) & F.col("s")).otherwise(F.col("s"))
    return m.where(keep).select("qid", "item_id", "mode_")


@query(_R + ", k AS (SELECT * FROM r WHERE rank <= 2 OR score >= 0.85), n AS (SELECT r.qid, r.item_id, r.score, r.rank, r.grp, row_number() OVER (PARTITION BY r.qid, r.grp ORDER BY r.rank) i FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.qid = r.qid AND k.grp = r.grp) AND score >= 0.5) SELECT qid, item_id, score, rank FROM k UNION ALL SELECT qid, item_id, score, rank FROM n WHERE i = 1")
def group_cover(t):
    """Kept items, and the best of each group none of them is of."""
    r = _orders(t.spark, t.folder)
    kept = r.where("rank <= 2 or score >= 0.85")
    missing = r.where("score >= 0.5").join(kept.select("qid", "grp").distinct(), ["qid", "grp"], "left_anti")
    return kept.select(*_OUT).unionByName(cutoffs.quota(missing, "grp", 1).select(*_OUT))
