"""Named queries: structure of texts, chunks, audits, mining."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import evaluate, mining, ranking, sequential, structure
from corpusloom.plans.named import Named
from corpusloom.plans.retrieval import _JUDGED, _R, _judged, _orders
from corpusloom.plans.selects import _H, _hits

query = Named()
_LN = "string_split(text, chr(10))"
_B = r"string_split_regex(regexp_replace(text, '(^|\n)(Điều \d{1,6}[a-zđ]?\.)', '\1' || chr(1) || '\2', 'g'), chr(1))"


# structure
_LAB = r"CASE WHEN regexp_matches(x[1], '^Điều \d{1,6}[a-zđ]?\.') THEN CAST(regexp_extract(x[1], '^Điều (\d+)', 1) AS INTEGER) * 1000 + coalesce(ascii(nullif(regexp_extract(x[1], '^Điều \d+([a-zđ])\.', 1), '')), 0) ELSE -1 END"
_LAST = "CAST(a[len(a)] AS INTEGER)"
_STEP = f"CASE WHEN ({_LAB}) >= 0 AND (({_LAST} = -1 AND ({_LAB}) // 1000 <= 2) OR ({_LAST} >= 0 AND ((({_LAB}) // 1000 = {_LAST} // 1000 AND ({_LAB}) > {_LAST}) OR (({_LAB}) // 1000 > {_LAST} // 1000 AND ({_LAB}) // 1000 <= {_LAST} // 1000 + 3)))) THEN list_concat(a[1:len(a) - 1], [x[1], CAST(({_LAB}) AS VARCHAR)]) WHEN len(a) = 1 THEN [x[1], a[1]] ELSE list_concat(a[1:len(a) - 2], [a[len(a) - 1] || x[1], a[len(a)]]) END"


@query(f"WITH b AS (SELECT doc_id, list_reduce(list_prepend(['-1'], list_transform({_B}, lambda y: [y])), lambda a, x: {_STEP}) l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, l[1:len(l) - 1] l FROM b) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) pos, body FROM (SELECT doc_id, unnest(l) body, generate_subscripts(l, 1) k FROM e) WHERE trim(body) <> ''")
def gated_split(t):
    """Articles by headers whose numbers go on; the text of others stays with the article before."""
    found = structure.gated_articles(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", F.posexplode(found).alias("pos", "b")).select("doc_id", "pos", F.col("b.body").alias("body"))


@query(
    r"""WITH m AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(text, '((?:tại|theo|của|khoản \d)[ \t\n]{0,3})Điều ', '\1' || chr(2) || 'iều ', 'g'), '(Điều \d{1,6}\. ?[\p{L}\p{N}"''(«“‘])', chr(1) || '\1', 'g'), chr(1)) l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_extract(b, '^Điều (\d{1,6})\.', 1) label, replace(b, chr(2), 'Đ') body FROM (SELECT doc_id, unnest(l) b FROM m) WHERE regexp_matches(b, '^Điều \d{1,6}\.') AND length(trim(b)) >= 20"""
)
def guarded_split(t):
    """Articles anywhere in a line, headers that are references ('theo Điều 5.') left alone."""
    found = structure.guarded_articles(F.col("text"), ["tại", "theo", "của", r"khoản \d"])
    return t("documents").where("text is not null").select("doc_id", F.explode(found).alias("b")).select("doc_id", "b.label", "b.body")


_CB = r"string_split_regex(regexp_replace(content, '(^|\n)([ \t]*\d{1,2}\.[ \t])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_CN = r"coalesce(TRY_CAST(nullif(regexp_extract(x[1], '^[ \t]*(\d{1,2})\.[ \t]', 1), '') AS INTEGER), -1)"
_CS = f"CASE WHEN {_CN} = {_LAST} + 1 THEN list_concat(a[1:len(a) - 1], [x[1], CAST({_CN} AS VARCHAR)]) WHEN len(a) = 1 THEN [x[1], a[1]] ELSE list_concat(a[1:len(a) - 2], [a[len(a) - 1] || x[1], a[len(a)]]) END"


@query(f"WITH c AS (SELECT DISTINCT id, content FROM legal_knowledge_records WHERE trim(content) <> ''), b AS (SELECT id, content, list_reduce(list_prepend(['0'], list_transform({_CB}, lambda y: [y])), lambda a, x: {_CS}) l FROM c), e AS (SELECT id, CASE WHEN CAST(l[len(l)] AS INTEGER) >= 2 THEN list_filter(l[1:len(l) - 1], lambda x: trim(x) <> '') ELSE [content] END l FROM b) SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) pos, unnest(l) body FROM e")
def clause_split(t):
    """Clauses by numbers that come as the next expected one."""
    r = t("legal_knowledge_records").where("trim(content) <> ''").select("id", "content").distinct()
    return r.select("id", F.posexplode(structure.numbered_clauses(F.col("content"))).alias("pos", "b")).select("id", "pos", F.col("b.body").alias("body"))


_RULES = [("chapter", 1, r"(?iu)^Chương\s+([IVX]+|\d+)"), ("part", 1, r"(?iu)^Phần\s*(\d+)[.)-]"), ("section", 2, r"(?iu)^Mục\s+([IVX]+|\d+)"), ("article", 3, r"(?iu)^Điều\s*(\d+)[.)-]"), ("clause", 4, r"^(\d+)\s*[.)-]"), ("point", 5, r"^([a-zđ])[.)-]\s")]


@query("SELECT doc_id, pos, " + "CASE " + " ".join(f"WHEN regexp_matches(l, '{p.replace('(?iu)', '(?i)')}') THEN '{k}'" for k, _, p in _RULES) + " WHEN upper(l) = l AND lower(l) <> l THEN 'title' ELSE 'text' END kind, CAST(CASE " + " ".join(f"WHEN regexp_matches(l, '{p.replace('(?iu)', '(?i)')}') THEN {lv}" for _, lv, p in _RULES) + " WHEN upper(l) = l AND lower(l) <> l THEN 0 ELSE 7 END AS DOUBLE) level_, CASE " + " ".join(f"WHEN regexp_matches(l, '{p.replace('(?iu)', '(?i)')}') THEN regexp_extract(l, '{p.replace('(?iu)', '(?i)')}', 1)" for _, _, p in _RULES) + f" ELSE '' END number FROM (SELECT doc_id, unnest({_LN}) l, CAST(generate_subscripts({_LN}, 1) - 1 AS INTEGER) pos FROM documents)")
def line_levels(t):
    """Type, level and number of every line by an ordered table of patterns."""
    lines = t("documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    x = structure.level_of(F.col("l"), _RULES, ("title", 0), ("text", 7))
    return lines.select("doc_id", "pos", x.alias("x")).select("doc_id", "pos", F.col("x.type").alias("kind"), F.col("x.level").alias("level_"), "x.number")


@query(f"WITH l AS (SELECT doc_id, unnest({_LN}) l, CAST(generate_subscripts({_LN}, 1) - 1 AS INTEGER) pos FROM documents), c AS (SELECT *, len(regexp_extract_all(l, '“')) o, len(regexp_extract_all(l, '”')) c FROM l), s AS (SELECT *, sum(o - c) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) d FROM c), m AS (SELECT *, least(0, min(d) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) lo FROM s) SELECT doc_id, pos FROM (SELECT *, coalesce(lag(d - lo) OVER (PARTITION BY doc_id ORDER BY pos), 0) before FROM m) WHERE before > 0 OR o > 0")
def quoted_lines(t):
    """Lines inside quotes: what an amending text wants written elsewhere."""
    lines = F.split("text", "\n")
    flags = t("documents").where("text is not null").select("doc_id", F.posexplode(structure.in_quotes(lines)).alias("pos", "q"))
    return flags.where("q").select("doc_id", "pos")


_HEADS = ["^Điều ", r"^\d+\. ", r"^[a-z]\) "]


@query(
    f"WITH l AS (SELECT doc_id, unnest({_LN}) l, CAST(generate_subscripts({_LN}, 1) - 1 AS INTEGER) pos FROM documents), h AS (SELECT *, CASE WHEN regexp_matches(l, '{_HEADS[0]}') THEN 1 WHEN regexp_matches(l, '{_HEADS[1]}') THEN 2 WHEN regexp_matches(l, '{_HEADS[2]}') THEN 3 END k FROM l), g AS (SELECT *, count(*) FILTER (k = 1) OVER w g1, count(*) FILTER (k <= 2) OVER w g2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) "
    "SELECT doc_id, pos, coalesce(last_value(CASE WHEN k = 1 THEN l END IGNORE NULLS) OVER a, '') h1, coalesce(last_value(CASE WHEN k = 2 THEN l END IGNORE NULLS) OVER b, '') h2, coalesce(last_value(CASE WHEN k = 3 THEN l END IGNORE NULLS) OVER c, '') h3 FROM g WINDOW a AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY doc_id, g1 ORDER BY pos ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY doc_id, g2 ORDER BY pos ROWS UNBOUNDED PRECEDING)"
)
def breadcrumb(t):
    """The headers every line stands under, of three levels."""
    lines = F.split("text", "\n")
    rows = t("documents").where("text is not null").select("doc_id", F.posexplode(structure.breadcrumbs(lines, _HEADS)).alias("pos", "h"))
    return rows.select("doc_id", "pos", *[F.col("h")[k].alias(f"h{k + 1}") for k in range(3)])


@query("SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE substr(CASE WHEN strpos(substr(text, 202), 'Hồ sơ gồm') > 0 THEN rtrim(substr(text, 1, strpos(substr(text, 202), 'Hồ sơ gồm') + 200)) ELSE text END, 1, 1200) END body FROM documents WHERE text IS NOT NULL")
def oversize_trim(t):
    """Long texts end before a marker, or at the limit."""
    return t("documents").where("text is not null").select("doc_id", structure.trimmed_at(F.col("text"), "Hồ sơ gồm", 1200).alias("body"))


@query()
def sentence_chunks(t):
    """Pieces cut softly at sentence ends."""
    return structure.sentence_chunks(t("documents"), "doc_id")


_FOLD = "list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({l}, lambda y: [y])), lambda a, x: CASE WHEN len(a) > 0 AND length(a[len(a)]) + 1 + length(x[1]) <= {n} THEN list_concat(a[1:len(a) - 1], [a[len(a)] || chr(10) || x[1]]) ELSE list_concat(a, x) END)"


@query(f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) chunk, unnest(l) body FROM (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN [text] ELSE {_FOLD.format(l=_LN, n=600)} END l FROM documents WHERE text IS NOT NULL)")
def pack_chunks(t):
    """Lines packed in order into chunks of a target size; a text that is short enough stays whole."""
    packed = structure.packed_segments(F.split("text", "\n"), 600, 1000)
    return t("documents").where("text is not null").select("doc_id", F.posexplode(packed).alias("chunk", "c")).select("doc_id", "chunk", F.col("c.body").alias("body"))


@query("WITH p AS (SELECT id, content FROM legal_knowledge_records WHERE trim(content) <> '') SELECT count(DISTINCT id) n_records, true in_limits, true complete FROM p")
def clause_chunks(t):
    """Clauses packed to 900 characters, longer ones than 1,200 cut softly: whether the limits hold and all words are kept."""
    r = t("legal_knowledge_records").where("trim(content) <> ''").select("id", "content").distinct()
    parts = r.withColumn("k", F.struct("id", F.xxhash64("content").alias("h"))).withColumn("s", F.transform(structure.numbered_clauses(F.col("content")), lambda b: b["body"]))
    chunks = structure.sized_chunks(parts, "k", "s", 900, 1200, 1200)
    words = lambda c: F.regexp_count(c, F.lit(r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"))
    per = chunks.groupBy("k").agg(F.max(F.length("piece")).alias("m"), F.sum(words("piece")).alias("n"))
    both = parts.select("k", words("content").alias("want")).join(per, "k", "left")
    return both.agg(F.count_distinct("k.id").alias("n_records"), (F.max("m") <= 1200).alias("in_limits"), F.every(F.coalesce(F.col("n"), F.lit(0)) == F.col("want")).alias("complete"))


_WD = r"regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')"


@query(f"SELECT doc_id, CAST(i AS INTEGER) chunk, array_to_string(CASE WHEN i = 0 THEN w[1:128] ELSE list_concat(w[1:4], w[i * 96 + 1:i * 96 + 128]) END, ' ') body FROM (SELECT doc_id, w, unnest(range(CAST(ceil(greatest(len(w) - 32, 1) / 96) AS BIGINT))) i FROM (SELECT doc_id, {_WD} w FROM documents) WHERE len(w) > 0)")
def token_chunks(t):
    """Windows of 128 words, 32 shared, the first four words as header of all."""
    words = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0b]+)"), 1)
    rows = t("documents").where("text is not null").select("doc_id", F.posexplode(structure.token_windows(words, 128, 32, 4)).alias("chunk", "w"))
    return rows.select("doc_id", "chunk", F.array_join("w", " ").alias("body"))


@query(f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) chunk, coalesce(title || ' > ', '') || unnest(l) body FROM (SELECT doc_id, title, {_FOLD.format(l='list_filter(' + _LN + ', lambda y: length(y) >= 10)', n=900)} l FROM documents WHERE text IS NOT NULL)")
def breadcrumb_chunks(t):
    """Small parts put together, each chunk behind the title of its text."""
    parts = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 10)
    packed = structure.packed_segments(parts, 900, 0)
    rows = t("documents").where("text is not null").select("doc_id", "title", F.posexplode(F.filter(packed, lambda c: c["n"] > 0)).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.concat(F.coalesce(F.concat("title", F.lit(" > ")), F.lit("")), "c.body").alias("body"))


@query("SELECT id, array_to_string(list_concat(['Điều ' || gold[1].dieu_so], ['khoản 1 Điều ' || gold[1].dieu_so, 'khoản 2 Điều ' || gold[1].dieu_so], ['điểm a khoản 1 Điều ' || gold[1].dieu_so, 'điểm b khoản 1 Điều ' || gold[1].dieu_so, 'điểm a khoản 2 Điều ' || gold[1].dieu_so, 'điểm b khoản 2 Điều ' || gold[1].dieu_so]), ';') keys_ FROM eval_items WHERE len(gold) > 0")
def citation_keys(t):
    article = F.concat(F.lit("Điều "), F.get("gold", F.lit(0))["dieu_so"].cast("string"))
    keys = structure.citation_keys(article, F.array(F.lit("1"), F.lit("2")), F.array(F.lit("a"), F.lit("b")))
    return t("eval_items").where(F.size("gold") > 0).select("id", F.array_join(keys, ";").alias("keys_"))


@query(r"SELECT doc_id, CASE WHEN a THEN 'article' WHEN b THEN 'foreign' WHEN coalesce(trim(text), '') = '' THEN 'empty' ELSE 'numbered' END kind, CASE WHEN a AND b THEN 'mixed' WHEN b THEN 'en' ELSE 'vi' END lang_ FROM (SELECT *, coalesce(regexp_matches(text, '(?m)^Điều \d'), false) a, coalesce(regexp_matches(text, '(?m)^(Article|Section) \d'), false) b FROM documents)")
def parse_kinds(t):
    """How a text can be taken apart, and the language of its headers."""
    x = structure.parse_kind(F.col("text"), r"(?m)^Điều \d", r"(?m)^(Article|Section) \d")
    return t("documents").select("doc_id", x.alias("x")).select("doc_id", "x.kind", F.col("x.lang").alias("lang_"))


# audits
_STAGES = "(VALUES ('retrieval', 10), ('rerank', 5), ('final', 2)) k(stage, n)"


@query(_JUDGED.split(", p AS")[0] + f", g AS (SELECT qid, count(*) total FROM r WHERE grp IN ('1-URGENT', '2-HIGH') GROUP BY qid), s AS (SELECT r.qid, stage, count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) / count(*) p, CASE WHEN max(total) IS NOT NULL THEN count(*) FILTER (grp IN ('1-URGENT', '2-HIGH')) / max(total) END rc FROM r JOIN {_STAGES} ON rank <= n LEFT JOIN g ON g.qid = r.qid GROUP BY ALL), l AS (SELECT a.qid, a.rc - b.rc > 0.3 lost FROM s a JOIN s b ON a.qid = b.qid WHERE a.stage = 'retrieval' AND b.stage = 'rerank') SELECT stage, round(avg(p), 6) p, round(avg(rc), 6) r, round(5 * avg(p) * avg(rc) / (4 * avg(p) + avg(rc)), 6) f2, count(rc) n, (SELECT count(*) FROM l WHERE lost) n_lost FROM s GROUP BY stage")
def stage_report(t):
    """Precision and recall per question and stage, questions without gold left out of recall; those that lose 0.3 of it on the way."""
    pred = _orders(t.spark, t.folder).where("rank <= 10").select("qid", F.col("item_id").alias("key"), "rank")
    return evaluate.stages(pred, _judged(t.spark, t.folder)[1], [("retrieval", 10), ("rerank", 5), ("final", 2)], 0.3)


@query(_JUDGED + "SELECT round(avg(CASE WHEN coalesce(np, 0) = 0 OR coalesce(ng, 0) = 0 THEN 0 ELSE hit / np END), 6) p, round(avg(CASE WHEN coalesce(ng, 0) = 0 THEN 0 ELSE hit / ng END), 6) r, round(100 * avg(CAST(coalesce(hit, 0) = 0 AS INTEGER)), 6) zero_pct FROM customer LEFT JOIN m ON qid = c_custkey")
def zero_recall(t):
    """Empty sets score 0 here; the share of questions without a hit."""
    pred, gold = _judged(t.spark, t.folder)
    return evaluate.strict(pred, gold, t("customer").select(F.col("c_custkey").alias("qid")))


_A = "SELECT law, count(*) n, min(no) lo, max(no) hi FROM (SELECT DISTINCT upper(regexp_replace(law_id, '\\s', '', 'g')) law, CAST(regexp_extract(article, '(\\d{1,9})', 1) AS BIGINT) no FROM legal_knowledge_records WHERE regexp_matches(article, '\\d') AND trim(law_id) <> '') GROUP BY law"


@query(
    f"WITH a AS ({_A}), r AS (SELECT *, upper(regexp_replace(law_id, '\\s', '', 'g')) law FROM legal_knowledge_records) SELECT 'gap' flag, count(*) FILTER (hi - lo + 1 > n) n FROM a UNION ALL SELECT 'missing_first', count(*) FILTER (lo > 1) FROM a UNION ALL SELECT 'giant', count(*) FILTER (length(content) > 5000) FROM r UNION ALL SELECT 'short', count(*) FILTER (length(content) < 30) FROM r UNION ALL SELECT 'empty_title', count(*) FILTER (coalesce(trim(article_title), '') = '') FROM r UNION ALL SELECT 'null_code', count(*) FILTER (coalesce(trim(law_id), '') = '') FROM r "
    "UNION ALL SELECT 'duplicate', count(*) FROM (SELECT law, article FROM r WHERE law <> '' AND article IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 1) UNION ALL SELECT 'dup_metadata', count(*) FROM (SELECT law FROM r WHERE law <> '' GROUP BY law HAVING count(DISTINCT trim(lower(doc_type))) > 1) UNION ALL SELECT 'zero_article', count(*) FROM (SELECT law FROM r WHERE law <> '' GROUP BY law HAVING count(*) FILTER (regexp_matches(article, '\\d')) = 0) UNION ALL SELECT 'long_few', count(*) FROM (SELECT law FROM r WHERE law <> '' GROUP BY law HAVING sum(length(content)) > 3000 AND count(DISTINCT article) < 4)"
)
def ten_checks(t):
    """Ten checks of a corpus of articles, each with the number of laws or rows that fail it."""
    return mining.corpus_checks(t("legal_knowledge_records"))


@query("SELECT count(*) n, count(*) FILTER (NOT coalesce(regexp_full_match(doc_code, '\\d{1,4}/\\d{4}/\\p{Lu}+(-\\p{Lu}+)?'), false)) junk_code, round(100 * count(*) FILTER (length(text) > 50000) / count(*), 4) huge_pct, round(100 * count(*) FILTER (length(text) < 30) / count(*), 4) tiny_pct, count(*) FILTER (length(title) > 200) long_title, count(*) FILTER (coalesce(trim(title), '') = '') no_title, count(*) FILTER (title IS NOT NULL AND contains(text, title)) repeated_title FROM documents")
def parse_quality(t):
    """Junk codes, huge and tiny texts, long, empty and repeated titles."""
    n, junk = F.count("*"), ~F.coalesce(F.col("doc_code").rlike(r"^\d{1,4}/\d{4}/\p{Lu}+(-\p{Lu}+)?$"), F.lit(False))
    share = lambda c: F.round(F.try_divide(100 * F.count_if(c), n), 4)
    return t("documents").agg(n.alias("n"), F.count_if(junk).alias("junk_code"), share(F.length("text") > 50000).alias("huge_pct"), share(F.length("text") < 30).alias("tiny_pct"), F.count_if(F.length("title") > 200).alias("long_title"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("no_title"), F.count_if(F.contains("text", "title")).alias("repeated_title"))


@query(rf"SELECT doc_id, array_to_string(list_sort(list_transform(m, lambda x: CAST(x AS INTEGER))), ',') missing FROM (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(text, 'Điều (\d{{1,6}})', 1)), lambda x: NOT list_contains(regexp_extract_all(text, '(?m)^Điều (\d{{1,6}})\.', 1), x)) m FROM documents WHERE text IS NOT NULL) WHERE len(m) > 0")
def headers_missing(t):
    """Article numbers a text mentions of which it has no header."""
    numbers = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), 1))
    missing = F.array_except(numbers(r"Điều (\d{1,6})"), numbers(r"(?m)^Điều (\d{1,6})\."))
    rows = t("documents").where("text is not null").select("doc_id", F.array_sort(F.transform(missing, lambda x: x.cast("int"))).alias("m")).where(F.size("m") > 0)
    return rows.select("doc_id", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("missing"))


@query(_R + ", m AS (SELECT *, max(\"year\") OVER (PARTITION BY qid, grp) y FROM r), s AS (SELECT *, y - \"year\" age FROM m WHERE rank <= 3) SELECT count(*) slots, count(*) FILTER (age > 0) stale, round(count(*) FILTER (age > 0) / count(*), 6) stale_share, count(*) FILTER (age BETWEEN 1 AND 2) young, count(*) FILTER (age > 2) old FROM s")
def stale_slots(t):
    """Of the first three places those a newer version of the family should have, and how much older they are."""
    m = _orders(t.spark, t.folder).withColumn("age", F.max("year").over(Window.partitionBy("qid", "grp")) - F.col("year")).where("rank <= 3")
    n = F.count("*")
    return m.agg(n.alias("slots"), F.count_if(F.col("age") > 0).alias("stale"), F.round(F.try_divide(F.count_if(F.col("age") > 0), n), 6).alias("stale_share"), F.count_if(F.col("age").between(1, 2)).alias("young"), F.count_if(F.col("age") > 2).alias("old"))


@query("SELECT event_type, count(*) n, round(avg(value), 4) mean, round(median(value), 6) p50, round(CASE WHEN count(*) >= 5 THEN list(value ORDER BY value)[1 + CAST(floor(0.95 * count(*)) AS INTEGER)] END, 6) p95 FROM events GROUP BY 1")
def latency_summary(t):
    """Counts, mean, median and the value at 95 of 100 places, the latter for five rows or more."""
    return evaluate.summary(t("events"), "event_type", "value")


# mining
@query(_H.replace("rank <= 20)", "rank <= 100)") + ", g AS (SELECT qid, item_id pos, rank pr FROM h WHERE rank % 7 = 3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY md5(item_id::VARCHAR)) = 1), w AS (SELECT h.qid, pos, h.item_id, h.rank, CASE WHEN h.rank BETWEEN 11 AND 60 THEN 0 ELSE 1 END band FROM h JOIN g ON h.qid = g.qid WHERE h.rank > 10 AND h.item_id <> pos AND NOT (pr BETWEEN 11 AND 60 AND abs(h.rank - pr) <= 2)) SELECT qid, pos, item_id, rank, CAST(pick AS INTEGER) pick FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY band, md5(item_id::VARCHAR), item_id) pick FROM w) WHERE pick <= 4")
def window_negatives(t):
    """Hard negatives of ranks 11 to 60 by hash order, not beside the positive, topped up from 61 to 100."""
    hits = _hits(t, 100)
    w = Window.partitionBy("qid").orderBy(F.md5(F.col("item_id").cast("string")))
    positives = hits.where("rank % 7 = 3").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("qid", F.col("item_id").alias("pos"))
    return mining.window_negatives(hits, positives, (11, 60), 100, 2, 4)


@query(_R + ", g AS (SELECT qid, item_id FROM r WHERE rank <= 20 AND grp IN ('1-URGENT', '2-HIGH')), p AS (SELECT qid, item_id pos FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY item_id) = 1), n AS (SELECT r.qid, list(item_id ORDER BY rank)[1:7] neg FROM r WHERE rank BETWEEN 4 AND 10 AND grp NOT IN ('1-URGENT', '2-HIGH') GROUP BY r.qid) SELECT qid, pos, array_to_string(list_transform(range(7), lambda i: neg[1 + i % len(neg)]), ' ') negatives FROM p JOIN n USING (qid)")
def padded_negatives(t):
    """One positive and seven negatives a question: those of ranks 4 to 10, repeated where they are too few."""
    r = _orders(t.spark, t.folder)
    gold = F.col("grp").isin("1-URGENT", "2-HIGH")
    pos = r.where("rank <= 20").where(gold).groupBy("qid").agg(F.min("item_id").alias("pos"))
    return mining.padded(r.where("rank between 4 and 10").where(~gold), pos, 7)


@query(_H.replace("rank <= 20)", "rank <= 40)") + ", p AS (SELECT id qid, doc_id item_id FROM eval_items e JOIN (SELECT topic, min(doc_id) doc_id FROM documents GROUP BY topic) d ON e.topic = d.topic) SELECT p.qid, p.item_id, h.rank IS NOT NULL kept, count(*) FILTER (h.rank IS NULL) OVER () n_missing FROM p LEFT JOIN h ON p.qid = h.qid AND p.item_id = h.item_id")
def round_trip(t):
    """Pairs whose positive is among the first forty hits of its question, and the number of those that are not."""
    d = t("documents").where("topic is not null").groupBy("topic").agg(F.min("doc_id").alias("item_id"))
    pairs = t("eval_items").join(d, "topic").select(F.col("id").alias("qid"), "item_id")
    return mining.round_trip(pairs, _hits(t, 40))


@query(_R + ", c AS (SELECT qid, item_id, grp IN ('1-URGENT', '2-HIGH') g FROM r WHERE rank <= 12), n AS (SELECT qid, list(item_id ORDER BY item_id) FILTER (NOT g) neg FROM c GROUP BY qid HAVING count(*) FILTER (NOT g) >= 5) SELECT c.qid, c.item_id pos, array_to_string(neg, ' ') negatives FROM c JOIN n USING (qid) WHERE g")
def distilled_rows(t):
    """One row per positive with the rest of its list, where that holds five or more."""
    c = _orders(t.spark, t.folder).where("rank <= 12").select("qid", "item_id", F.col("grp").isin("1-URGENT", "2-HIGH").alias("g"))
    rest = c.where("not g").groupBy("qid").agg(F.sort_array(F.collect_list("item_id")).alias("neg")).where(F.size("neg") >= 5)
    return c.where("g").join(rest, "qid").select("qid", F.col("item_id").alias("pos"), F.array_join(F.transform("neg", lambda x: x.cast("string")), " ").alias("negatives"))


@query("SELECT min(id) id, q FROM (SELECT id, lower(trim(question)) q, gold FROM eval_items) WHERE length(q) >= 15 AND gold[1].so_ky_hieu NOT IN (SELECT upper(regexp_replace(document_number, '\\s', '', 'g')) FROM legal_effectiveness WHERE eff_code = 'het_hieu_luc' AND document_number IS NOT NULL) GROUP BY q")
def training_pairs(t):
    """Distinct questions of some length whose law still holds."""
    gone = t("legal_effectiveness").where("eff_code = 'het_hieu_luc' and document_number is not null").select(F.upper(F.regexp_replace("document_number", r"\s", "")).alias("code")).distinct()
    q = t("eval_items").select("id", F.lower(F.trim("question")).alias("q"), F.get("gold", F.lit(0))["so_ky_hieu"].alias("code")).where(F.length("q") >= 15).where("code is not null")
    return q.join(gone, "code", "left_anti").groupBy("q").agg(F.min("id").alias("id"))


@query(_R + ", p AS (SELECT qid, min(item_id) pos, arg_min(grp, item_id) pg FROM r WHERE rank <= 10 GROUP BY qid), s AS (SELECT r.qid, pos, item_id, round(1 - abs(score - 0.5), 6) s2 FROM r JOIN p USING (qid) WHERE rank <= 20 AND grp <> pg), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, item_id) k, count(*) OVER (PARTITION BY qid) n FROM s) SELECT qid, pos, item_id, s2, CAST(k AS INTEGER) pick FROM k WHERE k <= 5 AND n >= 3")
def rescored_negatives(t):
    """Candidates scored anew, highest first, without those of the positive's key; lists of three or more."""
    r = _orders(t.spark, t.folder)
    pos = r.where("rank <= 10").groupBy("qid").agg(F.min("item_id").alias("pos"), F.min_by("grp", "item_id").alias("pg"))
    s = r.where("rank <= 20").join(pos, "qid").where("grp <> pg").select("qid", "pos", "item_id", F.round(1 - F.abs(F.col("score") - 0.5), 6).alias("s2"))
    w = Window.partitionBy("qid")
    return s.withColumn("pick", F.row_number().over(w.orderBy(F.desc("s2"), "item_id"))).withColumn("n", F.count("*").over(w)).where("pick <= 5 and n >= 3").drop("n")


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@query()
def knn_lists(t):
    """Approximate neighbours by lists."""
    return sequential.knn_lists(_vectors(t))


@query("SELECT count(*) n_queries, true at_least FROM embeddings WHERE vec_id % 20 = 0")
def knn_lists_recall(t):
    """Whether nine in ten of the exact neighbours are among the approximate ones."""
    return _recall(t, sequential.knn_lists(_vectors(t)))


@query("SELECT count(*) n_queries, true at_least FROM embeddings WHERE vec_id % 20 = 0")
def knn_prefetch_recall(t):
    """The same of the search in two stages."""
    return _recall(t, sequential.knn_two_stage(_vectors(t)))


def _recall(t, found):
    exact, near = ranking.knn(_vectors(t)).select("qid", "item_id"), found.select("qid", "item_id").withColumn("hit", F.lit(1))
    per = exact.join(near, ["qid", "item_id"], "left").groupBy("qid").agg(F.count("hit").alias("hit"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_queries"), (F.sum("hit") >= 0.9 * F.sum("n")).alias("at_least"))
