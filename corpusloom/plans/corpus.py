"""Named queries: preparation, joins, aggregation, parsing, audits, sampling, events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators import nested, parsing, references, validity
from corpusloom.operators.packed import articles_of, references_of
from corpusloom.operators.ranking import numbered_within
from corpusloom.plans.general import REFERENCES_SQL, trees_sql
from corpusloom.session import tune
from corpusloom.sources.tables import first_delivery, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: table(tune(spark), d, name))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_CODE_SQL = r"nullif(upper(regexp_replace({c}, '\s', '', 'g')), '')"


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_returnflag = 'N' AND l_quantity < 10")
def scan_prune(t):
    return t("lineitem").where((F.col("l_shipdate") >= "1998-06-01") & (F.col("l_returnflag") == "N") & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN 'title: ' || trim(title) END, CASE WHEN trim(doc_code) <> '' THEN 'code: ' || trim(doc_code) END, CASE WHEN trim(topic) <> '' THEN 'topic: ' || trim(topic) END) search_text FROM documents")
def template_text(t):
    line = lambda c, label: F.when(F.trim(c) != "", F.concat(F.lit(label + ": "), F.trim(c)))
    return t("documents").select("doc_id", F.concat_ws("\n", line("title", "title"), line("doc_code", "code"), line("topic", "topic")).alias("search_text"))


@query(f"SELECT d.doc_id, coalesce(r.canonical_title, nullif(trim(d.title), '')) title, CASE WHEN r.canonical_title IS NOT NULL THEN 'registry' WHEN trim(d.title) <> '' THEN 'own' ELSE 'none' END title_source FROM documents d LEFT JOIN legal_doc_registry r ON {_CODE_SQL.format(c='d.doc_code')} = r.doc_code")
def registry_coalesce(t):
    r = t("legal_doc_registry").select(F.col("doc_code").alias("code"), "canonical_title")
    d = t("documents").select("doc_id", "title", references.law_code(F.col("doc_code")).alias("code"))
    own = F.nullif(F.trim("title"), F.lit(""))
    source = F.when(F.col("canonical_title").isNotNull(), "registry").when(own.isNotNull(), "own").otherwise("none")
    return d.join(r, "code", "left").select("doc_id", F.coalesce("canonical_title", own).alias("title"), source.alias("title_source"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) k FROM events")
def json_field(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT doc_id, array_to_string(list_filter(['fee', 'council', 'council’s fee', 'khoản đặt cọc', 'tháng'], lambda k: contains(lower(text), k)), '|') hits FROM documents WHERE len(list_filter(['fee', 'council', 'council’s fee', 'khoản đặt cọc', 'tháng'], lambda k: contains(lower(text), k))) > 0")
def keyword_hits(t):
    words = F.array(*map(F.lit, ["fee", "council", "council’s fee", "khoản đặt cọc", "tháng"]))
    hits = F.filter(words, lambda k: F.lower("text").contains(k))
    return t("documents").select("doc_id", hits.alias("h")).where(F.size("h") > 0).select("doc_id", F.array_join("h", "|").alias("hits"))


_TIER = "CASE WHEN doc_type IS NULL OR trim(doc_type) = '' THEN 'drop' WHEN contains(lower(law_name), 'bảo hiểm') THEN 'core' WHEN lower(doc_type) IN ('luật', 'luat') THEN 'keep_all' WHEN contains(lower(law_name), 'quy chế') THEN 'keyword' ELSE 'drop' END"


@query(f"SELECT {_TIER} tier, count(*) n FROM legal_knowledge_records GROUP BY 1")
def scope_tiers(t):
    name = F.coalesce(F.lower("law_name"), F.lit(""))
    tier = F.when(F.coalesce(F.trim("doc_type"), F.lit("")) == "", "drop").when(name.contains("bảo hiểm"), "core").when(F.lower("doc_type").isin("luật", "luat"), "keep_all").when(name.contains("quy chế"), "keyword").otherwise("drop")
    return t("legal_knowledge_records").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def _dated(t):
    return t("legal_effectiveness").select("*", X.mixed_date(F.col("effective_date")).alias("eff"), X.mixed_date(F.col("expiry_date")).alias("exp"))


_DATE = "coalesce(CASE WHEN regexp_full_match({c}, '\\d\\d/\\d\\d/\\d{{4}}') THEN try_strptime({c}, '%d/%m/%Y') END, CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime({c}, '%Y-%m-%d') END, CASE WHEN regexp_full_match({c}, '\\d\\d-\\d\\d-\\d{{4}}') THEN try_strptime({c}, '%d-%m-%Y') END)"
_DATED = f"WITH e AS (SELECT *, CAST({_DATE.format(c='effective_date')} AS DATE) eff, CAST({_DATE.format(c='expiry_date')} AS DATE) exp FROM legal_effectiveness) "


@query(_DATED + "SELECT id, CASE WHEN eff_code IN ('con_hieu_luc', 'het_mot_phan') THEN true WHEN eff_code = 'het_hieu_luc' THEN coalesce(exp > DATE '2041-01-01', false) WHEN eff IS NOT NULL THEN eff <= DATE '2041-01-01' AND coalesce(exp > DATE '2041-01-01', true) ELSE true END valid FROM e")
def asof_validity(t):
    return _dated(t).select("id", validity.valid_after(F.col("eff_code"), F.col("eff"), F.col("exp"), "2041-01-01").alias("valid"))


@query(_DATED + f"SELECT d.doc_id, e.id FROM documents d JOIN e ON {_CODE_SQL.format(c='d.doc_code')} = {_CODE_SQL.format(c='e.document_number')} WHERE coalesce(eff <= CAST(published_at AS DATE), true) AND coalesce(exp > CAST(published_at AS DATE), true) AND published_at IS NOT NULL")
def time_travel(t):
    """Status rows in effect on the day a document was published."""
    e = _dated(t).select("id", "eff", "exp", references.law_code(F.col("document_number")).alias("code"))
    d = t("documents").where("published_at is not null").select("doc_id", F.to_date("published_at").alias("day"), references.law_code(F.col("doc_code")).alias("code"))
    return d.join(e, "code").where(validity.in_effect_on(F.col("day"), F.col("eff"), F.col("exp"))).select("doc_id", "id")


@query("SELECT CASE WHEN law_id IS NULL OR trim(law_id) = '' THEN 'no_code' WHEN law_name IS NULL OR trim(law_name) = '' THEN 'no_title' WHEN length(trim(law_name)) < 8 THEN 'bad_title' ELSE 'ok' END reason, count(*) n FROM legal_knowledge_records GROUP BY 1")
def reject_reasons(t):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(blank("law_id"), "no_code").when(blank("law_name"), "no_title").when(F.length(F.trim("law_name")) < 8, "bad_title").otherwise("ok")
    return t("legal_knowledge_records").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT q.id, count(*) n FROM (SELECT id, topic FROM eval_items) q JOIN (SELECT doc_id, topic, lang FROM documents) d ON q.topic = d.topic LEFT JOIN (SELECT topic, count(*) FILTER (lang = 'en') n FROM documents GROUP BY topic) f ON d.topic = f.topic WHERE lang = 'en' OR f.n < 10 GROUP BY q.id")
def filter_first_fallback(t):
    """Documents of a question's topic in English where there are ten; otherwise in any language."""
    d = t("documents").select("topic", "lang")
    counts = d.groupBy("topic").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count("*").alias("every"))
    n = F.when(F.col("en") >= 10, F.col("en")).otherwise(F.col("every"))
    return t("eval_items").select("id", "topic").join(counts, "topic").select("id", n.alias("n"))


@query(r"SELECT id, nullif(regexp_extract(law_name, '(\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?)', 1), '') code, CASE WHEN regexp_extract(law_name, '(\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?)', 1) <> '' THEN NULL WHEN contains(lower(law_name), 'nghị định') THEN 'decree' WHEN contains(lower(law_name), 'thông tư') THEN 'circular' WHEN contains(lower(law_name), 'luật') THEN 'law' END kind FROM (SELECT DISTINCT id, law_name FROM legal_knowledge_records WHERE law_name IS NOT NULL)")
def query_hard_filters(t):
    """A code in a name; the type by ordered words only where there is no code."""
    low = F.lower("law_name")
    kind = F.when(F.col("code").isNotNull(), None).when(low.contains("nghị định"), "decree").when(low.contains("thông tư"), "circular").when(low.contains("luật"), "law")
    return t("legal_knowledge_records").where("law_name is not null").select("id", "law_name").distinct().select("id", X.code_of(F.col("law_name")).alias("code"), "law_name").select("id", "code", kind.alias("kind"))


# joins
@query("SELECT c_mktsegment, count(*) n, round(sum(o_totalprice), 2) total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_inner(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_lookup(t):
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(t):
    return t("part").join(t("lineitem").where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("SELECT coalesce(a.k, b.k) nationkey, coalesce(a.n, 0) n_customers, coalesce(b.n, 0) n_suppliers FROM (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey k, count(*) n FROM supplier WHERE s_acctbal < 2000 GROUP BY 1) b ON a.k = b.k")
def join_full(t):
    a = t("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("a"))
    b = t("supplier").where("s_acctbal < 2000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("b"))
    return a.join(b, "nationkey", "full").select("nationkey", F.coalesce("a", F.lit(0)).alias("n_customers"), F.coalesce("b", F.lit(0)).alias("n_suppliers"))


@query("SELECT DISTINCT d.doc_id, r.doc_code FROM documents d JOIN legal_doc_registry r ON contains(lower(d.title), lower(r.canonical_title)) OR contains(lower(r.canonical_title), lower(d.title)) WHERE length(trim(d.title)) > 0")
def join_theta_contains(t):
    """Containment either way, checked per distinct title against the fixed registry."""
    r = t("legal_doc_registry").select("doc_code", F.lower("canonical_title").alias("b"))
    titles = t("documents").where(F.length(F.trim("title")) > 0).select("doc_id", F.lower("title").alias("a"))
    found = titles.select("a").distinct().join(r, F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    return titles.join(found, "a").select("doc_id", "doc_code").distinct()


@query("SELECT o_orderkey, count(*) n_late FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY AND l_shipdate <= o_orderdate + INTERVAL 120 DAY GROUP BY 1")
def join_range_dates(t):
    o, l = t("orders"), t("lineitem")
    late = (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 90 day")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 120 day"))
    return o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & late).groupBy("o_orderkey").agg(F.count("*").alias("n_late"))


@query("SELECT p.event_id, v.event_id last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def join_asof_events(t):
    """Each purchase with the user's last view at or before it: one union, one running value, no join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.desc(F.col("event_type") == "view")).rowsBetween(Window.unboundedPreceding, 0)
    e = t("events").where("event_type in ('purchase', 'view')")
    seen = e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "last_view")


@query("SELECT e.event_id, n.event_id near FROM (SELECT *, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.event_id) k, b.event_id bid FROM (SELECT * FROM events WHERE event_type = 'error') a JOIN (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id) e JOIN events n ON n.event_id = bid WHERE k = 1")
def join_nearest(t):
    """Each error with the nearest click of its user, either side; ties go to the smaller id."""
    e = t("events").where("event_type in ('error', 'click')")
    click = F.when(F.col("event_type") == "click", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id"))
    back = Window.partitionBy("user_id").orderBy("ts", F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    both = e.withColumn("b", F.last(click, True).over(back)).withColumn("a", F.first(click, True).over(ahead)).where("event_type = 'error'")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    pair = F.array_sort(F.filter(F.array(F.struct(F.abs(F.col("b.at") - at).alias("d"), F.col("b.event_id")), F.struct(F.abs(F.col("a.at") - at).alias("d"), F.col("a.event_id"))), lambda x: x["d"].isNotNull()))
    return both.where(F.size(pair) > 0).select("event_id", pair[0]["event_id"].alias("near"))


@query("WITH v AS (SELECT doc_code, CAST(split_part(doc_code, '/', 2) AS INTEGER) y, split_part(doc_code, '/', 3) k, regexp_replace(lower(canonical_title), '\\s+\\S+\\s+\\S+$', '') n FROM legal_doc_registry) SELECT a.doc_code old_code, b.doc_code new_code FROM v a JOIN v b ON a.k = b.k AND a.n = b.n AND b.y > a.y")
def join_self_version(t):
    """Pairs of an older and a newer text of one kind whose titles agree but for the place they end in."""
    r = t("legal_doc_registry")
    v = r.select("doc_code", X.year_of_code(F.col("doc_code")).alias("y"), F.split("doc_code", "/")[2].alias("k"), F.regexp_replace(F.lower("canonical_title"), r"\s+\S+\s+\S+$", "").alias("n"))
    b = v.withColumnsRenamed({"doc_code": "new_code", "y": "y2"})
    return v.join(b, ["k", "n"]).where("y2 > y").select(F.col("doc_code").alias("old_code"), "new_code")


@query(_DATED + f", s AS (SELECT {_CODE_SQL.format(c='document_number')} code, source, min(id) id FROM e WHERE eff IS NOT NULL GROUP BY ALL), f AS (SELECT s.*, e.eff FROM s JOIN e ON s.id = e.id) SELECT r.doc_code, coalesce(CAST(a.eff AS VARCHAR), CAST(b.eff AS VARCHAR)) eff, CASE WHEN a.eff IS NOT NULL THEN 'so_cai' WHEN b.eff IS NOT NULL THEN 'tra_cuu_tay' END src FROM legal_doc_registry r LEFT JOIN f a ON a.code = r.doc_code AND a.source = 'so_cai' LEFT JOIN f b ON b.code = r.doc_code AND b.source = 'tra_cuu_tay'")
def coalesce_sources(t):
    """The effective date by source priority, with the source that gave it."""
    e = _dated(t).where("eff is not null").groupBy(references.law_code(F.col("document_number")).alias("doc_code"), "source").agg(F.min_by("eff", "id").alias("eff"))
    a, b = (e.where(F.col("source") == s).select("doc_code", F.col("eff").alias(n)) for s, n in (("so_cai", "a"), ("tra_cuu_tay", "b")))
    source = F.when(F.col("a").isNotNull(), "so_cai").when(F.col("b").isNotNull(), "tra_cuu_tay")
    return t("legal_doc_registry").select("doc_code").join(a, "doc_code", "left").join(b, "doc_code", "left").select("doc_code", F.coalesce("a", "b").cast("string").alias("eff"), source.alias("src"))


@query(f"SELECT DISTINCT id, doc_code, domain FROM ({REFERENCES_SQL}) JOIN legal_doc_registry ON law = doc_code")
def related_refs(t):
    """References of a record's ``extra``, split and looked up in the registry, each once per record."""
    first = first_delivery(t("legal_knowledge_records"), "id", "ingested_at", ["extra"]).where("extra is not null")
    parts = F.split("v", r"\|")
    refs = first.select("id", F.explode(references_of(F.col("extra"))).alias("v")).where(F.size(parts) >= 3).select("id", references.law_code(F.element_at(parts, -3)).alias("doc_code")).distinct()
    return refs.join(t("legal_doc_registry").select("doc_code", "domain"), "doc_code").select("id", "doc_code", "domain")


# aggregation
@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(avg(l_discount), 6) avg_disc, count(*) n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def group_first_sum(t):
    return t("lineitem").where(F.col("l_shipdate") <= "1998-09-02").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_orderpriority END) n_prio FROM orders GROUP BY 1")
def distinct_if(t):
    return t("orders").groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority"))).alias("n_prio"))


@query(f"SELECT {_CODE_SQL.format(c='law_id')} law, article, count(DISTINCT id) n FROM legal_knowledge_records WHERE law_id IS NOT NULL AND article IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) > 1")
def dup_keys(t):
    return t("legal_knowledge_records").where("law_id is not null and article is not null").groupBy(references.law_code(F.col("law_id")).alias("law"), "article").agg(F.count_distinct("id").alias("n")).where("n > 1")


_N = "SELECT l_returnflag, l_linestatus, count(*) n, sum(l_quantity) qty FROM lineitem GROUP BY "


def _flags(t, how):
    return getattr(t("lineitem"), how)("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query(_N + "ROLLUP (l_returnflag, l_linestatus)")
def rollup_stats(t):
    return _flags(t, "rollup")


@query(_N + "CUBE (l_returnflag, l_linestatus)")
def cube_stats(t):
    return _flags(t, "cube")


@query(_N + "GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(t):
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")]]
    return t("lineitem").groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query(f"WITH v AS (SELECT {_CODE_SQL.format(c='law_id')} law, law_name, count(*) votes FROM legal_knowledge_records WHERE trim(law_name) <> '' GROUP BY ALL) SELECT law, law_name, votes FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY votes DESC, length(law_name), law_name) k FROM v WHERE law IS NOT NULL) WHERE k = 1")
def mode_vote(t):
    """The most frequent name of a law; among equals the shorter, then the first. Votes are counted before any ranking."""
    v = t("legal_knowledge_records").where("trim(law_name) <> ''").groupBy(references.law_code(F.col("law_id")).alias("law"), "law_name").agg(F.count("*").alias("votes")).where("law is not null")
    best = v.groupBy("law").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.length("law_name").alias("l"), "law_name")).alias("b"))
    return best.select("law", "b.law_name", (-F.col("b.v")).alias("votes"))


_LISTED = "CASE WHEN left(trim(article), 1) = '[' AND json_valid(article) THEN array_to_string(from_json(article, '[\"VARCHAR\"]'), ';') ELSE article END"


@query("WITH n AS (SELECT DISTINCT " + _CODE_SQL.format(c="law_id") + " law, CAST(unnest(regexp_extract_all(regexp_replace(" + _LISTED + ", '\\([^)]*\\)?', ' ', 'g'), '\\d{1,9}')) AS BIGINT) no FROM legal_knowledge_records) SELECT law, max(no) - min(no) + 1 - count(*) missing FROM n WHERE law IS NOT NULL GROUP BY law HAVING count(*) >= 3 AND missing > 0")
def gap_detect(t):
    """Article numbers missing between the first and the last of a law, from every value of the article fields.

    However written or packed; '22a' supplies 22.
    """
    rows = t("legal_knowledge_records").select(references.law_code(F.col("law_id")).alias("law"), F.explode(articles_of(F.col("article"))).alias("value"))
    return _gaps(rows.select("law", references.article_key(F.col("value"))["number"].alias("no")))


def _gaps(numbers):
    n = numbers.where("law is not null and no is not null").distinct()
    s = n.groupBy("law").agg(F.count("*").alias("n"), (F.max("no") - F.min("no") + 1 - F.count("*")).alias("missing"))
    return s.where("n >= 3 and missing > 0").select("law", "missing")


@query("SELECT CAST(thr AS DOUBLE) thr, count(*) FILTER (l_discount >= thr) n FROM lineitem, (SELECT unnest([0.02, 0.04, 0.06, 0.08]::DOUBLE[]) thr) GROUP BY thr")
def hist_thresholds(t):
    steps = [0.02, 0.04, 0.06, 0.08]
    counts = t("lineitem").agg(*[F.count_if(F.col("l_discount") >= s).alias(str(k)) for k, s in enumerate(steps)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("thr"), F.col(f"`{k}`").alias("n")) for k, s in enumerate(steps)])).alias("x")).select("x.*")


@query("SELECT source, lang, count(*) n FROM documents GROUP BY ALL ORDER BY n DESC, source, lang LIMIT 10")
def frequency(t):
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("source"), F.asc_nulls_last("lang")).limit(10)


@query("SELECT event_type, round(avg(value), 4) mean, round(stddev_pop(value), 4) sd, min(value) lo, max(value) hi FROM events GROUP BY 1")
def score_stats(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(f"SELECT {_CODE_SQL.format(c='law_id')} law, arg_min(chapter, id) FILTER (trim(chapter) <> '') chapter, arg_min(author, id) FILTER (trim(author) <> '') author, count(DISTINCT id) n FROM legal_knowledge_records WHERE law_id IS NOT NULL GROUP BY 1 HAVING law IS NOT NULL")
def first_non_empty(t):
    filled = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("id"))).alias(c)
    return t("legal_knowledge_records").groupBy(references.law_code(F.col("law_id")).alias("law")).agg(filled("chapter"), filled("author"), F.count_distinct("id").alias("n")).where("law is not null")


# windows
@query("SELECT event_id, lag(event_id) OVER w prev_id, lead(event_id) OVER w next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def prev_next(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_id").over(w).alias("next_id"))


@query(f"SELECT doc_id, code FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY code ORDER BY length(text) DESC, length(coalesce(title, '')) DESC, doc_id) k FROM (SELECT *, {_CODE_SQL.format(c='doc_code')} code FROM documents) WHERE code IS NOT NULL) WHERE k = 1")
def quality_dedup(t):
    """The best document of each code by length of text, then of title; a map-side minimum instead of a sort."""
    d = t("documents").select("doc_id", references.law_code(F.col("doc_code")).alias("code"), (-F.length("text")).alias("a"), (-F.coalesce(F.length("title"), F.lit(0))).alias("b")).where("code is not null")
    return d.groupBy("code").agg(F.min(F.struct("a", "b", "doc_id")).alias("m")).select("m.doc_id", "code")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) rn, count(*) OVER (PARTITION BY source) n FROM documents) WHERE (rn - 1) % greatest(1, n // 5) = 0 AND (rn - 1) // greatest(1, n // 5) < 5")
def systematic_sample(t):
    s = numbered_within(t("documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", F.col("place").alias("rn"), F.greatest(F.lit(1), F.floor(F.col("n") / 5)).alias("step"))
    return s.where("(rn - 1) % step = 0 and floor((rn - 1) / step) < 5").select("doc_id")


# text
@query(r"SELECT lang, count(*) n_docs, CAST(sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS BIGINT) n_tokens FROM documents GROUP BY 1")
def tokenize_stats(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(X.tokens(F.col("text")))).alias("n_tokens"))


@query(f"SELECT doc_code, translate(lower(canonical_title), '{X.ACCENTED}', '{X.BASE}') plain FROM legal_doc_registry")
def accent_strip(t):
    """Every title; signs the map does not know stay as they are."""
    return t("legal_doc_registry").select("doc_code", X.unaccented(F.col("canonical_title")).alias("plain"))


@query(r"SELECT code, count(*) n FROM (SELECT unnest(regexp_extract_all(extra, '\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?')) code FROM legal_knowledge_records) GROUP BY 1")
def codes_extract(t):
    return t("legal_knowledge_records").select(F.explode(F.regexp_extract_all("extra", F.lit(f"({X.VIETNAMESE.code})"), 1)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)đi[eề]u\s+(\d+[a-zđ]?)', 1), lambda x: lower(x)))), ',') nums FROM documents WHERE regexp_matches(text, '(?i)đi[eề]u\s+\d+')")
def article_mentions(t):
    nums = F.array_sort(X.article_numbers(F.col("text")))
    return t("documents").where(F.size(X.article_numbers(F.col("text"))) > 0).select("doc_id", F.array_join(nums, ",").alias("nums"))


@query(_DATED + "SELECT id, CAST(eff AS VARCHAR) eff, CAST(exp AS VARCHAR) exp FROM e")
def date_parse(t):
    return _dated(t).select("id", F.col("eff").cast("string").alias("eff"), F.col("exp").cast("string").alias("exp"))


@query(r"SELECT doc_id, count(*) n, CAST(sum(length(s)) AS BIGINT) n_chars FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+|\n+', '\1' || chr(1), 'g'), chr(1))), '[ \t\n\r\f\x0b]+', ' ', 'g')) s FROM documents) WHERE s <> '' GROUP BY 1")
def sentence_split(t):
    """Sentences and their characters, of the documents of every language and of none."""
    s = parsing.sentences(t("documents"), "doc_id")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


@query(r"""WITH b AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(^|\n)(Điều[ \t\n\r\f\x0b]+\d)', '\1' || chr(1) || '\2', 'g'), chr(1))) body, generate_subscripts(string_split_regex(regexp_replace(text, '(^|\n)(Điều[ \t\n\r\f\x0b]+\d)', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) k FROM documents),
c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) pos, body FROM b WHERE NOT (k = 1 AND body = '')) SELECT doc_id, pos, coalesce(nullif(regexp_extract(body, '^Điều[ \t\n\r\f\x0b]+(\d+)', 1), ''), '0') number, trim(body) body FROM c WHERE length(trim(body)) >= 20""")
def article_split(t):
    return parsing.articles(t("documents"), "doc_id")


@query(r"WITH w AS (SELECT DISTINCT doc_code, unnest(regexp_extract_all(lower(canonical_title), '[\p{L}\p{N}_]+')) w FROM legal_doc_registry), n AS (SELECT doc_code, count(*) n FROM w GROUP BY 1), p AS (SELECT a.doc_code a, b.doc_code b, count(*) k FROM w a JOIN w b ON a.w = b.w AND a.doc_code < b.doc_code GROUP BY 1, 2) SELECT a, b, round(k / (x.n + y.n - k), 6) sim FROM p JOIN n x ON x.doc_code = a JOIN n y ON y.doc_code = b WHERE k / (x.n + y.n - k) >= 0.8")
def jaccard_pairs(t):
    """Pairs of registry titles (a fixed list) of word Jaccard 0.8 or more: joined on their rarest words only.

    A pair at 0.8 shares a word among the first n - ceil(0.8 n) + 1 of each title in order of frequency.
    """
    words = t("legal_doc_registry").select("doc_code", F.explode(F.array_distinct(X.tokens(F.col("canonical_title")))).alias("w"))
    ordered = words.join(words.groupBy("w").agg(F.count("*").alias("df")), "w").groupBy("doc_code").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    sets = ordered.select("doc_code", F.transform("s", lambda x: x["w"]).alias("ws"))
    prefix = sets.select("doc_code", "ws", F.explode(F.slice("ws", 1, (F.size("ws") - F.ceil(F.size("ws") * 0.8) + 1).cast("int"))).alias("w"))
    pairs = prefix.withColumnsRenamed({"doc_code": "a", "ws": "x"}).join(prefix.withColumnsRenamed({"doc_code": "b", "ws": "y"}), "w").where("a < b")
    return pairs.withColumn("s", X.jaccard(F.col("x"), F.col("y"))).where("s >= 0.8").select("a", "b", F.round("s", 6).alias("sim")).distinct()


@query("SELECT doc_id, md5(coalesce(doc_code, '') || '|' || CAST(doc_id AS VARCHAR))[1:12] short_id, sha256(coalesce(title, '')) title_hash FROM documents")
def stable_ids(t):
    return t("documents").select("doc_id", F.substring(F.md5(F.concat(F.coalesce("doc_code", F.lit("")), F.lit("|"), F.col("doc_id").cast("string"))), 1, 12).alias("short_id"), F.sha2(F.coalesce("title", F.lit("")), 256).alias("title_hash"))


@query("SELECT event_id, round(1 / (1 + exp(value / 100 - 0.5)), 6) p FROM events")
def softmax(t):
    return t("events").select("event_id", F.round(X.softmax_first(F.lit(0.5), F.col("value") / 100), 6).alias("p"))


# trees and graphs
_PATHS = trees_sql()


@query(_PATHS + "SELECT tree_id, array_to_string(s[1:k], '.') ancestor, node_path descendant, CAST(len(s) - k AS INTEGER) depth FROM (SELECT tree_id, node_path, s, unnest(range(1, len(s) + 1)) k FROM (SELECT tree_id, node_path, string_split(node_path, '.') s FROM t))")
def closure(t):
    return parsing.closure(nested.node_links(t("tree_output")))


@query(_PATHS + "SELECT tree_id, parent_path, array_to_string(list(node_path ORDER BY CAST(split_part(node_path, '.', -1) AS INTEGER)), ' ') children FROM t WHERE parent_path <> '' GROUP BY ALL")
def adjacency(t):
    """The children of each node that has any, in their order."""
    kids = nested.node_links(t("tree_output")).where("parent_path <> ''")
    at = F.element_at(F.split("node_path", r"\."), -1).cast("int")
    listed = kids.groupBy("tree_id", "parent_path").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "node_path"))).alias("k"))
    return listed.select("tree_id", "parent_path", F.array_join("k.node_path", " ").alias("children"))


_OWN_WORDS = r"len(regexp_extract_all(coalesce({c}, ''), '[^ \t\n\r\f\x0b]+'))"


@query(trees_sql(", " + _OWN_WORDS.format(c="content") + " AS own", ", " + _OWN_WORDS.format(c="json_extract_string(kid, '$.content')")) + "SELECT tree_id, node_path, CAST(sum(own) AS BIGINT) n_words FROM (SELECT tree_id, array_to_string(s[1:k], '.') node_path, own FROM (SELECT tree_id, s, own, unnest(range(1, len(s) + 1)) k FROM (SELECT tree_id, string_split(node_path, '.') s, own FROM t))) GROUP BY ALL")
def subtree_totals(t):
    """Words of a node with everything below it, counted anew through the closure."""
    nodes = nested.flat_nodes(t("tree_output"))
    own = nodes.select("tree_id", "node_path", F.regexp_count(F.coalesce("content", F.lit("")), F.lit(r"[^ \t\n\r\f\x0b]+")).alias("own"))
    steps = F.split("node_path", r"\.")
    up = own.select("tree_id", "own", steps.alias("s"), F.explode(F.sequence(F.lit(1), F.size(steps))).alias("k"))
    return up.groupBy("tree_id", F.array_join(F.slice("s", 1, F.col("k")), ".").alias("node_path")).agg(F.sum("own").alias("n_words"))


@query("WITH e AS (SELECT event_id pos, user_id grp, CAST(floor(value) AS INTEGER) % 5 lvl FROM events) SELECT a.grp, a.pos, max(b.pos) parent_pos FROM e a LEFT JOIN e b ON a.grp = b.grp AND b.pos < a.pos AND b.lvl < a.lvl GROUP BY 1, 2")
def tree_parent(t):
    """Parents by level, nearest earlier node of a smaller one, on event streams read as outlines; none without a user."""
    e = t("events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("grp"), F.floor("value").cast("int").alias("r")).withColumn("lvl", F.col("r") % 5)
    p = parsing.level_parents(e, "grp", "pos", "lvl").select("grp", "pos", "parent_pos")
    return p.withColumn("parent_pos", F.when(F.col("grp").isNotNull(), F.col("parent_pos")))


@query(r"SELECT DISTINCT {c} old_code, code new_code FROM (SELECT law_id, unnest(regexp_extract_all(law_name, '\d{{1,4}}/\d{{4}}/\p{{Lu}}+(?:-\p{{Lu}}+)?')) code FROM legal_knowledge_records) WHERE {c} IS NOT NULL AND {c} <> code".format(c=_CODE_SQL.format(c="law_id")))
def ref_edges(t):
    """Edges from a record's law to another law whose code its name holds."""
    e = t("legal_knowledge_records").select(references.law_code(F.col("law_id")).alias("old_code"), F.explode(F.regexp_extract_all("law_name", F.lit(f"({X.VIETNAMESE.code})"), 1)).alias("new_code"))
    return e.where("old_code is not null and old_code <> new_code").distinct()


# audit, sampling
@query("SELECT count(*) n, count(*) FILTER (length(text) > 5000) giant, count(*) FILTER (length(text) < 200) short, count(*) FILTER (coalesce(trim(title), '') = '') no_title, count(*) FILTER (doc_code IS NULL) no_code, count(*) FILTER (length(text) <> n_chars) wrong_size, CAST(count(*) - count(DISTINCT md5(text)) AS BIGINT) copies FROM documents")
def corpus_audit(t):
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    return t("documents").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 5000).alias("giant"), F.count_if(F.length("text") < 200).alias("short"), F.count_if(blank).alias("no_title"), F.count_if(F.col("doc_code").isNull()).alias("no_code"), F.count_if(F.length("text") != F.col("n_chars")).alias("wrong_size"), (F.count("*") - F.count_distinct(F.md5("text"))).alias("copies"))


@query("WITH c AS (SELECT source, count(*) n FROM documents GROUP BY 1), q AS (SELECT source, CAST(round(100 * sqrt(n) / (SELECT sum(sqrt(n)) FROM c)) AS INTEGER) quota FROM c) SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id) k FROM documents) JOIN q USING (source) WHERE k <= quota")
def sqrt_sample(t):
    """About 100 documents, each source in proportion to the root of its size, picked by hash order."""
    c = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    total = c.agg(F.sum(F.sqrt("n")).alias("s"))
    q = c.crossJoin(F.broadcast(total)).select("source", F.round(100 * F.sqrt("n") / F.col("s")).cast("int").alias("quota"))
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("7"))), "doc_id")
    return t("documents").select("doc_id", "source").withColumn("k", F.row_number().over(w)).where("k <= 100").join(q, "source").where("k <= quota").select("doc_id")


@query("SELECT doc_id, CASE WHEN substr(md5(coalesce(doc_code, CAST(doc_id AS VARCHAR))), 1, 2) < '1a' THEN 'eval' ELSE 'train' END part FROM documents")
def group_split(t):
    """Nine to one by hash of the law, so that no law is on both sides."""
    h = F.substring(F.md5(F.coalesce("doc_code", F.col("doc_id").cast("string"))), 1, 2)
    return t("documents").select("doc_id", F.when(h < "1a", "eval").otherwise("train").alias("part"))


@query("SELECT topic, doc_id FROM (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY length(text) DESC, doc_id) k FROM documents) WHERE k = 1")
def longest_per_group(t):
    return t("documents").groupBy("topic").agg(F.min(F.struct((-F.length("text")).alias("l"), "doc_id")).alias("m")).select("topic", "m.doc_id")


@query("SELECT 'doc' kind, CAST(doc_id AS VARCHAR) id, doc_code code, topic FROM documents UNION ALL SELECT 'law', doc_code, doc_code, NULL FROM legal_doc_registry")
def union_schema(t):
    a = t("documents").select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("doc_code").alias("code"), "topic")
    b = t("legal_doc_registry").select(F.lit("law").alias("kind"), F.col("doc_code").alias("id"), F.col("doc_code").alias("code"))
    return a.unionByName(b, allowMissingColumns=True)


# events
def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) win_start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def event_tumbling(t):
    return t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(_micros(F.col("w.start")).alias("win_start"), "event_type", "n", "total")


@query("SELECT win_start, count(*) n FROM (SELECT unnest([epoch_us(time_bucket(INTERVAL 6 HOUR, ts)), epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - 21600000000]) win_start FROM events) GROUP BY 1")
def event_sliding(t):
    return t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(_micros(F.col("w.start")).alias("win_start"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) sid FROM g) SELECT user_id, epoch_us(min(ts)) start_us, count(*) n FROM s GROUP BY user_id, sid")
def event_session(t):
    return t("events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", _micros(F.col("w.start")).alias("start_us"), "n")
