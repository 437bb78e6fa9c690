"""Named queries: projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators import references, validity
from corpusloom.operators.ranking import numbered
from corpusloom.plans.corpus import _CODE_SQL, _DATED, _dated
from corpusloom.plans.named import Named

query = Named()
_FIELDS = ("law_id", "law_name", "doc_type", "chapter", "article", "article_title", "author", "extra", "fetched_at", "ingested_at")


def _filled(c):
    return F.nullif(F.trim(c), F.lit(""))


@query("SELECT id, concat_ws(chr(10), " + ", ".join(f"'{c}: ' || nullif(trim({'strftime(' + c + ', ' + chr(39) + '%Y-%m-%d' + chr(39) + ')' if c.endswith('_at') else c}), '')" for c in _FIELDS) + ", 'domain: ' || nullif(trim(domain), ''), 'priority: ' || priority, 'content: ' || nullif(trim(content), '')) search_text FROM legal_knowledge_records LEFT JOIN legal_doc_registry ON " + _CODE_SQL.format(c="law_id") + " = doc_code")
def search_text(t):
    """Thirteen labelled lines of a record and its law; blank ones are left out."""
    r = t("legal_doc_registry").select("doc_code", "domain", "priority")
    rows = t("legal_knowledge_records").withColumn("doc_code", references.law_code(F.col("law_id"))).join(r, "doc_code", "left")
    day = lambda c: F.date_format(c, "yyyy-MM-dd") if c.endswith("_at") else F.col(c).cast("string")
    lines = [F.concat(F.lit(f"{c}: "), _filled(day(c))) for c in (*_FIELDS, "domain", "priority", "content")]
    return rows.select("id", F.concat_ws("\n", *lines).alias("search_text"))


@query("SELECT id, trim(coalesce(law_name, '') || chr(10) || trim(coalesce(article_title, '') || ':' || coalesce(content, ''), ':'), chr(10)) v FROM legal_knowledge_records")
def vector_text(t):
    """Name, line break, title:content, without colons and breaks at the ends."""
    n = lambda c: F.coalesce(F.col(c), F.lit(""))
    inner = F.btrim(F.concat(n("article_title"), F.lit(":"), n("content")), F.lit(":"))
    return t("legal_knowledge_records").select("id", F.btrim(F.concat(n("law_name"), F.lit("\n"), inner), F.lit("\n")).alias("v"))


_OWN = ("law_name", "article_title", "chapter", "doc_type")


@query("SELECT id, coalesce(canonical_title, " + ", ".join(f"nullif(trim({c}), '')" for c in _OWN) + ") title, CASE WHEN canonical_title IS NOT NULL THEN 'registry' " + " ".join(f"WHEN trim({c}) <> '' THEN '{c}'" for c in _OWN) + " ELSE 'none' END src, CASE WHEN law_name <> coalesce(canonical_title, " + ", ".join(f"nullif(trim({c}), '')" for c in _OWN) + ") THEN law_name END raw FROM legal_knowledge_records LEFT JOIN legal_doc_registry ON " + _CODE_SQL.format(c="law_id") + " = doc_code")
def canonical_rows(t):
    """The registry's title, else the first of four own fields; where it came from, and the raw name where it changed."""
    r = t("legal_doc_registry").select("doc_code", "canonical_title")
    rows = t("legal_knowledge_records").withColumn("doc_code", references.law_code(F.col("law_id"))).join(r, "doc_code", "left")
    source = F.when(F.col("canonical_title").isNotNull(), "registry")
    for c in _OWN:
        source = source.when(F.trim(c) != "", c)
    title = F.coalesce("canonical_title", *[_filled(c) for c in _OWN])
    return rows.select("id", title.alias("title"), source.otherwise("none").alias("src"), F.when(F.col("law_name") != title, F.col("law_name")).alias("raw"))


_KIND = "lower(coalesce(trim(doc_type), ''))"
_NAME = "lower(coalesce(law_name, ''))"
_TIERS = f"CASE WHEN contains({_NAME}, 'bản nháp') OR contains({_NAME}, 'bản scan') THEN 'excluded' WHEN author IS NULL OR trim(author) = '' THEN 'no_scope' WHEN {_KIND} NOT IN ('luật', 'nghị định', 'thông tư', 'quyết định') THEN 'wrong_type' WHEN {_CODE_SQL.format(c='law_id')} IN (SELECT doc_code FROM legal_doc_registry WHERE priority = 1) THEN 'whitelist' WHEN {_KIND} = 'luật' THEN 'keep_all' WHEN contains({_NAME}, 'quy chế') OR contains({_NAME}, 'vi phạm') THEN 'keyword' ELSE 'drop' END"


@query(f"SELECT id, {_TIERS} tier FROM legal_knowledge_records")
def scope_of_six(t):
    """Excluded title, scope, type, whitelist, types kept whole, keyword: the first rule that decides."""
    white = t("legal_doc_registry").where("priority = 1").select(F.col("doc_code").alias("code")).distinct().withColumn("white", F.lit(True))
    name, kind = F.coalesce(F.lower("law_name"), F.lit("")), F.coalesce(F.lower(F.trim("doc_type")), F.lit(""))
    tier = (
        F.when(name.contains("bản nháp") | name.contains("bản scan"), "excluded")
        .when(F.coalesce(F.trim("author"), F.lit("")) == "", "no_scope")
        .when(~kind.isin("luật", "nghị định", "thông tư", "quyết định"), "wrong_type")
        .when(F.col("white"), "whitelist")
        .when(kind == "luật", "keep_all")
        .when(name.contains("quy chế") | name.contains("vi phạm"), "keyword")
        .otherwise("drop")
    )
    rows = t("legal_knowledge_records").withColumn("code", references.law_code(F.col("law_id"))).join(white, "code", "left")
    return rows.select("id", tier.alias("tier"))


@query(f"SELECT DISTINCT {_CODE_SQL.format(c='law_id')} code, {_KIND} kind FROM legal_knowledge_records WHERE ((contains({_KIND}, 'nghị') AND contains({_NAME}, 'bến')) OR (contains({_KIND}, 'luật') AND contains({_NAME}, 'bảo'))) AND {_CODE_SQL.format(c='law_id')} IS NOT NULL AND ({_CODE_SQL.format(c='law_id')}, {_KIND}) NOT IN (SELECT doc_code, 'luật' FROM legal_doc_registry WHERE domain = 'ben_do')")
def scope_by_type(t):
    """Types with keywords of their own; what is there under the same code and type is left out."""
    name, kind = F.coalesce(F.lower("law_name"), F.lit("")), F.coalesce(F.lower(F.trim("doc_type")), F.lit(""))
    keep = (kind.contains("nghị") & name.contains("bến")) | (kind.contains("luật") & name.contains("bảo"))
    have = t("legal_doc_registry").where("domain = 'ben_do'").select(F.col("doc_code").alias("code"), F.lit("luật").alias("kind"))
    return t("legal_knowledge_records").where(keep).select(references.law_code(F.col("law_id")).alias("code"), kind.alias("kind")).where("code is not null").distinct().join(have, ["code", "kind"], "left_anti")


@query(f"SELECT doc_id FROM documents WHERE {_CODE_SQL.format(c='doc_code')} IN (SELECT doc_code FROM legal_doc_registry WHERE domain = 'kho_bai') OR (contains(lower(coalesce(source, '')), 'cong_bao') AND contains(lower(text), 'mức phí'))")
def allow_or_type(t):
    """A code of the list, or a type with a keyword."""
    allowed = t("legal_doc_registry").where("domain = 'kho_bai'").select(F.col("doc_code").alias("code")).distinct().withColumn("ok", F.lit(True))
    d = t("documents").withColumn("code", references.law_code(F.col("doc_code"))).join(allowed, "code", "left")
    return d.where(F.coalesce("ok", F.lit(False)) | (F.coalesce(F.lower("source"), F.lit("")).contains("cong_bao") & F.coalesce(F.lower("text").contains("mức phí"), F.lit(False)))).select("doc_id")


@query("SELECT DISTINCT law_name FROM legal_knowledge_records WHERE NOT regexp_matches(law_name, '(?i)danh mục|bản nháp|bản scan')")
def not_a_catalogue(t):
    return t("legal_knowledge_records").where(~F.col("law_name").rlike("(?iu)danh mục|bản nháp|bản scan")).select("law_name").distinct()


@query("SELECT id, CASE WHEN eff_code IN ('het_hieu_luc') THEN true WHEN eff_code = 'con_hieu_luc' THEN false WHEN eff_code = 'het_mot_phan' THEN false ELSE contains(lower(coalesce(eff_status, '')), 'hết hiệu lực') END expired, coalesce(contains(lower(eff_status), 'còn hiệu lực') OR contains(lower(eff_status), 'một phần'), false) in_force FROM legal_effectiveness")
def status_flags(t):
    """Expired by code, else by words; in force only with a marker."""
    status = F.col("eff_status")
    return t("legal_effectiveness").select(
        "id", validity.expired(F.col("eff_code"), status, {"het_hieu_luc"}, {"con_hieu_luc", "het_mot_phan"}, ["hết hiệu lực"]).alias("expired"), validity.in_force(status, ["còn hiệu lực", "một phần"]).alias("in_force")
    )


@query(f"WITH m AS (SELECT {_CODE_SQL.format(c='document_number')} code, coalesce(eff_code, '') || ':' || source k FROM legal_effectiveness WHERE document_number IS NOT NULL) SELECT code, CASE WHEN bool_or(starts_with(k, 'het') AND NOT starts_with(k, 'het_mot')) THEN 'ended' WHEN bool_or(starts_with(k, 'het_mot')) THEN 'partly' WHEN bool_or(starts_with(k, 'con')) THEN 'holds' ELSE 'unknown' END status FROM m WHERE code IS NOT NULL GROUP BY code")
def relation_status(t):
    """A status from the keys of a law's relation map, by prefixes in order of weight, one with an exception."""
    key = F.concat(F.coalesce("eff_code", F.lit("")), F.lit(":"), F.col("source"))
    maps = t("legal_effectiveness").select(references.law_code(F.col("document_number")).alias("code"), key.alias("k"), "source").where("code is not null").distinct().groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("k", F.array("source")))).alias("m"))
    return maps.select("code", validity.status_of_relations(F.col("m"), [("ended", "het", "het_mot"), ("partly", "het_mot", None), ("holds", "con", None)], "unknown").alias("status"))


@query("SELECT id, length(question) BETWEEN 12 AND 300 AND NOT regexp_matches(question, '(?i)điều\\s+\\d+|\\d{1,4}/\\d{4}/') AND NOT regexp_matches(question, '(?i)^xin cho biết') ok FROM eval_items WHERE question IS NOT NULL")
def question_quality(t):
    """Of fair length, echoing no article or code, with no stock opening."""
    q = F.col("question")
    ok = F.length(q).between(12, 300) & ~q.rlike(r"(?iu)điều\s+\d+|\d{1,4}/\d{4}/") & ~q.rlike("(?iu)^xin cho biết")
    return t("eval_items").where(q.isNotNull()).select("id", ok.alias("ok"))


_PARTS = r"list_filter(list_transform(string_split_regex(question, ',[ ]*còn[ ]+|[ ]+khi[ ]+|[ ]+thì[ ]+'), lambda x: trim(x)), lambda x: length(x) >= 15)"
_SETS = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3))"


@query(
    f"WITH s AS (SELECT id, question, {_PARTS} l FROM eval_items), p AS (SELECT id, question, l, CAST(unnest(range(least(len(l), 5))) AS INTEGER) k FROM s) "
    f"SELECT id, k, l[k + 1] sub, length(l[k + 1]) <= 1.2 * length(question) AND len(list_intersect({_SETS.format(c='l[k + 1]')}, {_SETS.format(c='question')})) >= 2 valid, len({_SETS.format(c='l[k + 1]')}) >= 3 AND len(list_intersect({_SETS.format(c='l[k + 1]')}, {_SETS.format(c='answer')})) / len({_SETS.format(c='l[k + 1]')}) >= 0.45 near FROM p JOIN (SELECT id, answer FROM eval_items) USING (id)"
)
def sub_queries(t):
    """Questions split at their connectives into at most five clauses; whether one is valid, and whether it keeps to the answer."""
    words = lambda c: F.array_distinct(F.filter(X.tokens(c), lambda w: F.length(w) >= 3))
    clauses = X.clauses(F.col("question"), r",[ ]*còn[ ]+|[ ]+khi[ ]+|[ ]+thì[ ]+", 15, 5)
    p = t("eval_items").where("question is not null").select("id", "question", "answer", F.posexplode(clauses).alias("k", "sub"))
    own = words(F.col("sub"))
    shared = lambda c: F.size(F.array_intersect(own, words(F.col(c))))
    valid = (F.length("sub") <= 1.2 * F.length("question")) & (shared("question") >= 2)
    near = (F.size(own) >= 3) & (shared("answer") / F.size(own) >= 0.45)
    return p.select("id", "k", "sub", valid.alias("valid"), near.alias("near"))


_DOMAINS = [("bến đò", ["bến", "đò"]), ("kho băng", ["kho", "băng"]), ("lò gốm", ["lò", "gốm"])]


@query("WITH d(word, triggers) AS (VALUES " + ", ".join(f"('{w}', [{', '.join(repr(x) for x in ts)}])" for w, ts in _DOMAINS) + "), g AS (SELECT id, question, unnest(gold, recursive := true) FROM eval_items) SELECT DISTINCT g.id, doc_code, EXISTS (SELECT 1 FROM d WHERE contains(lower(canonical_title), word) AND len(list_filter(triggers, lambda x: contains(lower(g.question), x))) = 0) veto FROM g JOIN legal_doc_registry ON so_ky_hieu = doc_code")
def domain_veto(t):
    """A law of a domain of which the question holds no trigger is vetoed; the rules are a small table."""
    items = t("eval_items").select("id", F.lower("question").alias("q"), F.explode("gold").alias("g")).select("id", "q", F.col("g.so_ky_hieu").alias("doc_code"))
    rows = items.join(t("legal_doc_registry").select("doc_code", F.lower("canonical_title").alias("name")), "doc_code")
    rules = F.array(*[F.struct(F.lit(w).alias("word"), F.array(*map(F.lit, ts)).alias("triggers")) for w, ts in _DOMAINS])
    veto = F.exists(rules, lambda r: F.col("name").contains(r["word"]) & ~F.exists(r["triggers"], lambda x: F.col("q").contains(x)))
    return rows.select("id", "doc_code", veto.alias("veto")).distinct()


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (trim(x) IN ('', '...', '…') OR contains(lower(x), 'trang ') OR contains(lower(x), 'bản tra cứu'))), chr(10)) body FROM documents WHERE text IS NOT NULL")
def boilerplate_lines(t):
    """Without lines that are blank, dots or hold a marker."""
    return t("documents").where("text is not null").select("doc_id", X.without_lines(F.col("text"), ["", "...", "…"], ["trang ", "bản tra cứu"]).alias("body"))


@query("WITH c AS (SELECT id, lower(law_name) a FROM legal_knowledge_records WHERE trim(law_name) <> ''), u AS (SELECT DISTINCT a FROM c), e AS (SELECT u.a, min(doc_code) x FROM u JOIN legal_doc_registry ON a = lower(canonical_title) GROUP BY 1), n AS (SELECT u.a, min(doc_code) y FROM u JOIN legal_doc_registry ON contains(a, lower(canonical_title)) OR contains(lower(canonical_title), a) GROUP BY 1) SELECT DISTINCT id, coalesce(x, y) entry, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'contained' WHEN contains(a, '/lx') THEN 'law' WHEN contains(a, '/nđ-') THEN 'decree' ELSE 'none' END how FROM c LEFT JOIN e USING (a) LEFT JOIN n USING (a)")
def name_manifest(t):
    """An entry by exact name, else by containment either way (once per distinct name), else a type read off a code."""
    r = t("legal_doc_registry").select("doc_code", F.lower("canonical_title").alias("b"))
    c = t("legal_knowledge_records").where(F.trim("law_name") != "").select("id", F.lower("law_name").alias("a"))
    names = c.select("a").distinct()
    exact = names.join(r, F.col("a") == F.col("b")).groupBy("a").agg(F.min("doc_code").alias("x"))
    near = names.join(r, F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).groupBy("a").agg(F.min("doc_code").alias("y"))
    how = F.when(F.col("x").isNotNull(), "exact").when(F.col("y").isNotNull(), "contained").when(F.col("a").contains("/lx"), "law").when(F.col("a").contains("/nđ-"), "decree").otherwise("none")
    return c.join(exact, "a", "left").join(near, "a", "left").select("id", F.coalesce("x", "y").alias("entry"), how.alias("how")).distinct()


@query("SELECT id, coalesce(trim(replace(law_name, '-', '')), '') IN ('', '_') OR starts_with(lower(law_name), 'căn cứ') OR starts_with(lower(law_name), 'theo ') bad_title, coalesce(trim(law_id), '') = '' bad_code, bad_title AND bad_code gone FROM legal_knowledge_records")
def deletable(t):
    """A row goes only if both its title and its code are worthless."""
    name = F.col("law_name")
    bad_title = F.coalesce(F.trim(F.replace(name, F.lit("-"), F.lit(""))), F.lit("")).isin("", "_") | F.coalesce(F.startswith(F.lower(name), F.lit("căn cứ")) | F.startswith(F.lower(name), F.lit("theo ")), F.lit(False))
    bad_code = F.coalesce(F.trim("law_id"), F.lit("")) == ""
    return t("legal_knowledge_records").select("id", bad_title.alias("bad_title"), bad_code.alias("bad_code"), (bad_title & bad_code).alias("gone"))


@query("SELECT id, reason, CAST(CASE WHEN reason = 'ok' THEN row_number() OVER (PARTITION BY reason ORDER BY id, at_) END AS INTEGER) rank FROM (SELECT id, ingested_at at_, CASE WHEN law_id IS NULL OR trim(law_id) = '' THEN 'no_code' WHEN law_name IS NULL OR trim(law_name) = '' THEN 'no_title' WHEN length(trim(law_name)) < 8 THEN 'bad_title' ELSE 'ok' END reason FROM legal_knowledge_records)")
def survivors_ranked(t):
    """The reason a row is rejected; those that are not are ranked anew."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(blank("law_id"), "no_code").when(blank("law_name"), "no_title").when(F.length(F.trim("law_name")) < 8, "bad_title").otherwise("ok")
    rows = t("legal_knowledge_records").select("id", "ingested_at", reason.alias("reason"))
    return numbered(rows.where("reason = 'ok'"), "id", "ingested_at").select("id", "reason", "rank").unionByName(rows.where("reason <> 'ok'").select("id", "reason", F.lit(None).cast("int").alias("rank")))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?)', 1), '') code, nullif(lower(regexp_extract(text, '(?i)điều\s+(\d+[a-zđ]?)', 1)), '') article, CASE WHEN regexp_extract(text, '(\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?)', 1) <> '' THEN NULL WHEN contains(lower(text), 'nghị định') THEN 'decree' WHEN contains(lower(text), 'luật') THEN 'law' END kind FROM documents WHERE text IS NOT NULL")
def hard_filters(t):
    """Code, article and type a text asks for; the type only where there is no code."""
    low, text = F.lower("text"), F.col("text")
    code = X.code_of(text)
    kind = F.when(code.isNotNull(), None).when(low.contains("nghị định"), "decree").when(low.contains("luật"), "law")
    return t("documents").where("text is not null").select("doc_id", code.alias("code"), F.get(X.article_numbers(text), F.lit(0)).alias("article"), kind.alias("kind"))


@query("SELECT doc_id, lst FROM (SELECT doc_id, source, 'new' lst, row_number() OVER (PARTITION BY topic ORDER BY published_at DESC NULLS LAST, doc_id) k FROM documents UNION ALL SELECT doc_id, source, 'long', row_number() OVER (PARTITION BY topic ORDER BY length(text) DESC, doc_id) FROM documents) WHERE k <= 20 AND source IS DISTINCT FROM 'dien_dan'")
def flag_on_both(t):
    """The same flag filter on two ranked lists."""
    d = t("documents")
    lists = [("new", F.desc_nulls_last("published_at")), ("long", F.desc(F.length("text")))]
    parts = [d.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(o, "doc_id"))).select("doc_id", "source", F.lit(n).alias("lst"), "k") for n, o in lists]
    return parts[0].unionByName(parts[1]).where("k <= 20").where(~F.col("source").eqNullSafe(F.lit("dien_dan"))).select("doc_id", "lst")


@query(_DATED + f"SELECT count(*) n_all, count(*) FILTER (w) n_keyword, count(*) FILTER (w AND ok) n_valid FROM (SELECT d.doc_id, contains(lower(text), 'mức phí') w, bool_or(coalesce(exp > DATE '2041-01-01', true)) ok FROM documents d LEFT JOIN e ON {_CODE_SQL.format(c='d.doc_code')} = {_CODE_SQL.format(c='e.document_number')} GROUP BY ALL)")
def export_stats(t):
    """Rows left after each filter of an export."""
    e = _dated(t).select(references.law_code(F.col("document_number")).alias("code"), "exp")
    d = t("documents").select("doc_id", references.law_code(F.col("doc_code")).alias("code"), F.lower("text").contains("mức phí").alias("w"))
    rows = d.join(e, "code", "left").groupBy("doc_id", "w").agg(F.max(F.coalesce(F.col("exp") > F.lit("2041-01-01").cast("date"), F.lit(True))).alias("ok"))
    return rows.agg(F.count("*").alias("n_all"), F.count_if("w").alias("n_keyword"), F.count_if(F.col("w") & F.col("ok")).alias("n_valid"))
