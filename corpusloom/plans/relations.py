"""Named queries: joins, aggregation, sorts and sets beyond the plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators import matching, references
from corpusloom.operators.nested import flat_nodes
from corpusloom.operators.sequential import gated_headers
from corpusloom.plans.corpus import _CODE_SQL, _DATED, _dated
from corpusloom.plans.general import trees_sql
from corpusloom.plans.named import Named
from corpusloom.sources import connectors

query = Named()
_C = _CODE_SQL


# scans
@query("SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 7, 13, 42)")
def in_list(t):
    """A list of values that reaches the scan."""
    return t("part").where(F.col("p_size").isin(1, 7, 13, 42)).select("p_partkey", "p_brand")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(t):
    """Two columns, the first hundred rows by key."""
    return t("documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


@query(f"SELECT DISTINCT id FROM legal_knowledge_records JOIN (SELECT DISTINCT so_ky_hieu, 'Điều ' || dieu_so a FROM (SELECT unnest(gold, recursive := true) FROM eval_items)) ON {_C.format(c='law_id')} = so_ky_hieu AND article = a")
def lookup_pairs(t):
    """Records under any of the (law, article) pairs asked for."""
    gold = t("eval_items").select(F.explode("gold").alias("g")).select(F.col("g.so_ky_hieu").alias("law"), F.concat(F.lit("Điều "), F.col("g.dieu_so").cast("string")).alias("article"))
    rows = t("legal_knowledge_records").select("id", references.law_code(F.col("law_id")).alias("law"), "article")
    return connectors.point_lookup(rows, gold, ["law", "article"]).select("id").distinct()


@query("SELECT id, CAST(length(content) AS INTEGER) n FROM legal_knowledge_records WHERE trim(content) <> ''")
def full_scroll(t):
    """Every row with a text."""
    return t("legal_knowledge_records").where(F.trim("content") != "").select("id", F.length("content").alias("n"))


@query("SELECT o_custkey qid, o_orderkey item_id, o_clerk_, rank FROM (SELECT o_custkey, o_orderkey, o_orderpriority || '/' || o_orderstatus o_clerk_, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) rank FROM orders) WHERE rank <= 3")
def late_lookup(t):
    """Rank on two columns, then fetch the others of the few that are left."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"), "o_totalprice").where("rank <= 3").drop("o_totalprice")
    more = t("orders").select("o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("o_clerk_"))
    return top.join(more, "o_orderkey").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item_id"), "o_clerk_", "rank")


@query(
    f"SELECT doc_code, id FROM (SELECT doc_code, e.id, 100 * CAST({_C.format(c='document_number')} = doc_code AS INTEGER) + 20 * CAST(eff_code IS NOT NULL AS INTEGER) + 10 * CAST(source = 'so_cai' AS INTEGER) + len(list_intersect(regexp_extract_all(lower(canonical_title), '\\p{{L}}+'), regexp_extract_all(lower(coalesce(eff_status, '')), '\\p{{L}}+'))) score, row_number() OVER (PARTITION BY doc_code ORDER BY score DESC, e.id) k FROM legal_doc_registry r JOIN legal_effectiveness e ON split_part({_C.format(c='document_number')}, '/', 1) = split_part(doc_code, '/', 1)) WHERE k = 1 AND score >= 100"
)
def best_status(t):
    """The status row that fits a law best, by points for number, kind, source and words; none below the points of a number."""
    e = t("legal_effectiveness").select("id", references.law_code(F.col("document_number")).alias("code"), "eff_code", "source", "eff_status")
    pairs = t("legal_doc_registry").select("doc_code", "canonical_title").join(e, F.split("code", "/")[0] == F.split("doc_code", "/")[0])
    words = lambda c: F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"(\p{L}+)"), 1), F.array().cast("array<string>")))
    score = 100 * (F.col("code") == F.col("doc_code")).cast("int") + 20 * F.col("eff_code").isNotNull().cast("int") + 10 * F.coalesce(F.col("source") == "so_cai", F.lit(False)).cast("int") + F.size(F.array_intersect(words("canonical_title"), words("eff_status")))
    best = pairs.groupBy("doc_code").agg(F.max(F.struct(score.alias("score"), (-F.col("id")).alias("id"))).alias("b"))
    return best.where("b.score >= 100").select("doc_code", (-F.col("b.id")).alias("id"))


@query("SELECT doc_code, CASE WHEN priority = 1 THEN upper(canonical_title) ELSE canonical_title END title FROM legal_doc_registry UNION ALL SELECT 'new/' || n_nationkey, n_name FROM nation")
def upsert_rows(t):
    """Rows replaced by key, and new ones."""
    old = t("legal_doc_registry").select("doc_code", F.col("canonical_title").alias("title"))
    changed = t("legal_doc_registry").where("priority = 1").select("doc_code", F.upper("canonical_title").alias("title"))
    added = t("nation").select(F.concat(F.lit("new/"), F.col("n_nationkey").cast("string")).alias("doc_code"), F.col("n_name").alias("title"))
    return connectors.upserted(old, changed.unionByName(added), ["doc_code"])


@query("SELECT name_, value, '| ' || name_ || ' | ' || value || ' |' line FROM (UNPIVOT (SELECT count(*) n, count(*) FILTER (coalesce(trim(title), '') = '') no_title, count(DISTINCT source) sources FROM documents) ON n, no_title, sources INTO NAME name_ VALUE value)")
def report_lines(t):
    """Counters as rows and as lines of a report."""
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    counts = t("documents").agg(F.count("*").alias("n"), F.count_if(blank).alias("no_title"), F.count_distinct("source").alias("sources"))
    return connectors.counter_rows(counts)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE coalesce(trim(title), '') = '')")
def resume_todo(t):
    """What a run still has to do, given what it has done."""
    return connectors.unfinished(t("documents"), t("documents").where(F.coalesce(F.trim("title"), F.lit("")) == ""), ["doc_id"]).select("doc_id")


@query(f"SELECT doc_id, coalesce(canonical_title, title) title, coalesce(domain, topic) topic FROM documents d LEFT JOIN (SELECT doc_code, canonical_title, nullif(trim(domain), '') AS domain FROM legal_doc_registry WHERE priority = 1) r ON {_C.format(c='d.doc_code')} = r.doc_code")
def payload_patch(t):
    """A copy with the fields of a patch table in place of the old ones, where it has any."""
    patch = t("legal_doc_registry").where("priority = 1").select(F.col("doc_code").alias("code"), F.col("canonical_title").alias("title"), F.nullif(F.trim("domain"), F.lit("")).alias("topic"))
    rows = t("documents").select("doc_id", "title", "topic", references.law_code(F.col("doc_code")).alias("code"))
    return connectors.patched(rows, patch, ["code"]).select("doc_id", "title", "topic")


# joins
@query(_DATED + f", f AS (SELECT {_C.format(c='document_number')} code, source, arg_min(eff, id) eff, arg_min(eff_status, id) st FROM e WHERE eff IS NOT NULL GROUP BY ALL) SELECT r.doc_code, CAST(coalesce(a.eff, b.eff) AS VARCHAR) eff, coalesce(a.st, b.st) status, CASE WHEN a.code IS NOT NULL THEN 'so_cai' WHEN b.code IS NOT NULL THEN 'unknown' END src FROM legal_doc_registry r LEFT JOIN f a ON a.code = r.doc_code AND a.source = 'so_cai' LEFT JOIN f b ON b.code = r.doc_code AND b.source = 'unknown'")
def composite_sources(t):
    """First row per (code, source), joined on both; fields and their source by priority."""
    e = _dated(t).where("eff is not null").groupBy(references.law_code(F.col("document_number")).alias("doc_code"), "source").agg(F.min_by("eff", "id").alias("eff"), F.min_by("eff_status", "id").alias("st"))
    wanted = t("legal_doc_registry").select("doc_code", F.explode(F.array(F.lit("so_cai"), F.lit("unknown"))).alias("source"))
    found = wanted.join(e, ["doc_code", "source"], "left").groupBy("doc_code").pivot("source", ["so_cai", "unknown"]).agg(F.first(F.struct("eff", "st")).alias("x"))
    a, b = F.col("so_cai"), F.col("unknown")
    source = F.when(a["eff"].isNotNull(), "so_cai").when(b["eff"].isNotNull(), "unknown")
    return found.select("doc_code", F.coalesce(a["eff"], b["eff"]).cast("string").alias("eff"), F.coalesce(a["st"], b["st"]).alias("status"), source.alias("src"))


@query(trees_sql(", content", ", json_extract_string(kid, '$.content')") + "SELECT h.tree_id, h.parent_path, p.content, min(h.node_path) child FROM t h JOIN t p ON h.tree_id = p.tree_id AND h.parent_path = p.node_path WHERE contains(h.content, 'Mức phí') GROUP BY ALL")
def parent_of_hit(t):
    """Each parent of a node with the words once, with the first of these children."""
    nodes = flat_nodes(t("tree_output")).select("tree_id", "node_path", "parent_path", "content")
    hits = nodes.where(F.col("content").contains("Mức phí")).groupBy("tree_id", "parent_path").agg(F.min("node_path").alias("child"))
    return hits.join(nodes.select("tree_id", F.col("node_path").alias("parent_path"), "content"), ["tree_id", "parent_path"]).select("tree_id", "parent_path", "content", "child")


_LONG = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '\p{{L}}+'), lambda w: length(w) >= 6))"


@query(f"WITH a AS (SELECT DISTINCT topic, lower(topic) n, {_LONG.format(c='replace(topic, chr(95), chr(32))')} ws FROM documents WHERE topic IS NOT NULL), b AS (SELECT DISTINCT domain, lower(domain) n, {_LONG.format(c='replace(domain, chr(95), chr(32))')} ws FROM legal_doc_registry WHERE trim(domain) <> '') SELECT topic, domain FROM a JOIN b ON contains(a.n, b.n) OR contains(b.n, a.n) OR len(list_intersect(a.ws, b.ws)) > 0")
def fuzzy_names(t):
    """Names of two short lists that contain each other or share a long word."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.replace(F.col(c), F.lit("_"), F.lit(" "))), F.lit(r"(\p{L}+)"), 1), lambda w: F.length(w) >= 6))
    a = t("documents").where("topic is not null").select("topic", F.lower("topic").alias("n"), words("topic").alias("ws")).distinct()
    b = t("legal_doc_registry").where("trim(domain) <> ''").select("domain", F.lower("domain").alias("m"), words("domain").alias("vs")).distinct()
    near = F.col("n").contains(F.col("m")) | F.col("m").contains(F.col("n")) | F.arrays_overlap("ws", "vs")
    return a.join(F.broadcast(b), near).select("topic", "domain")


_CLEANED = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_RUNS = "list_distinct(list_transform(range(1, greatest(CAST(length({c}) AS BIGINT) - 23, 1)), lambda i: substr({c}, CAST(i AS BIGINT), 25)))"


@query(f"WITH q AS (SELECT id, {_CLEANED.format(c='answer')} a FROM eval_items), d AS (SELECT doc_id, {_CLEANED.format(c='text')} b FROM documents), g AS (SELECT id, unnest({_RUNS.format(c='a')}) s FROM q), h AS (SELECT doc_id, unnest({_RUNS.format(c='b')}) s FROM d WHERE length(b) >= 25) SELECT g.id, h.doc_id, count(*) n_runs FROM g JOIN h USING (s) WHERE length(g.s) = 25 GROUP BY 1, 2")
def shingle_overlap(t):
    """Answers quoted in documents: shared runs of 25 characters, letters and digits only."""
    q = t("eval_items").select("id", X.letters_only(F.col("answer")).alias("a"))
    d = t("documents").select("doc_id", X.letters_only(F.col("text")).alias("b"))
    return matching.shared_runs(q, d, "id", "a", "doc_id", "b", 25)


@query(r"WITH v AS (SELECT doc_code, CAST(split_part(doc_code, '/', 2) AS INTEGER) y, split_part(doc_code, '/', 3) k, list_distinct(regexp_extract_all(lower(canonical_title), '[\p{L}\p{N}_]+')) w, contains(lower(canonical_title), 'chi tiết') am FROM legal_doc_registry) SELECT DISTINCT a.doc_code old_code FROM v a JOIN v b ON a.k = b.k AND b.y > a.y AND a.doc_code <> b.doc_code AND NOT a.am AND NOT b.am WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.75")
def superseded_titles(t):
    """Texts with a newer one of their kind of which the titles share three words in four, amendments aside."""
    r = t("legal_doc_registry").where(~F.coalesce(F.lower("canonical_title").contains("chi tiết"), F.lit(False)))
    v = r.select("doc_code", X.year_of_code(F.col("doc_code")).alias("y"), F.split("doc_code", "/")[2].alias("k"), F.array_distinct(X.tokens(F.col("canonical_title"))).alias("w"))
    return matching.newer_versions(v, "doc_code", "k", "y", "w", 0.75).select(F.col("doc_code").alias("old_code")).distinct()


@query(r"WITH q AS (SELECT id, list_distinct(list_transform(regexp_extract_all(answer, 'kỳ (\d+)', 1), lambda x: CAST(x AS INTEGER))) m, gold FROM eval_items), g AS (SELECT id, m, unnest(gold, recursive := true) FROM q), j AS (SELECT *, bool_or(dieu_so IN (SELECT unnest(m))) OVER (PARTITION BY id) hit FROM g) SELECT id, so_ky_hieu, dieu_so FROM j WHERE NOT hit OR list_contains(m, dieu_so)")
def text_references(t):
    """Of an item's laws those whose number its answer mentions; all of them where it mentions none."""
    said = F.transform(F.regexp_extract_all("answer", F.lit(r"kỳ (\d+)"), 1), lambda x: x.cast("int"))
    rows = t("eval_items").select("id", said.alias("m"), F.explode("gold").alias("g")).select("id", "g.*", F.coalesce(F.array_contains("m", F.col("g.dieu_so")), F.lit(False)).alias("keep"))
    any_ = F.max(F.col("keep").cast("int")).over(Window.partitionBy("id"))
    return rows.withColumn("_any", any_).where(F.col("keep") | (F.col("_any") == 0)).select("id", "so_ky_hieu", "dieu_so")


_OFFSETS = "list_transform(range(len(f)), lambda i: CAST(coalesce(list_sum(list_transform(p[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i], lambda x: length(x))), 0) AS INTEGER))"


def _mentions_sql(name: str, pattern: str) -> str:
    return f"{name} AS (SELECT doc_id, f, o, CAST(unnest(range(len(f))) AS INTEGER) i, f[i + 1] txt, o[i + 1] at_ FROM (SELECT doc_id, f, {_OFFSETS} o FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') f, string_split_regex(text, '{pattern}') p FROM documents WHERE text IS NOT NULL)))"


@query("WITH " + _mentions_sql("a", r"Điều \d+") + ", " + _mentions_sql("b", r"Khi |Mức phí|Hồ sơ") + ", j AS (SELECT a.doc_id, a.at_ article_at, a.txt article, b.txt near, row_number() OVER (PARTITION BY a.doc_id, a.at_ ORDER BY abs(a.at_ - b.at_), b.at_) k FROM a JOIN b ON a.doc_id = b.doc_id) SELECT doc_id, article_at, article, near FROM j WHERE k = 1")
def nearest_mention(t):
    """Each article mention with the mention of another kind nearest to it in the text, the first of equals."""
    d = t("documents").where("text is not null")
    m = d.select("doc_id", X.mentions(F.col("text"), r"Điều \d+").alias("a"), X.mentions(F.col("text"), r"Khi |Mức phí|Hồ sơ").alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    rows = m.select("doc_id", F.explode("a").alias("x"), "b")
    return rows.select("doc_id", F.col("x.at").alias("article_at"), F.col("x.text").alias("article"), matching.nearest_in("b", F.col("x.at"))["text"].alias("near"))


@query("SELECT doc_code, i - 1 pos, aliases[i] alias, length(aliases[i]) n FROM (SELECT doc_code, aliases, unnest(range(1, len(aliases) + 1)) i FROM legal_doc_registry)")
def aligned_lists(t):
    """Lists side by side, joined by position."""
    both = F.arrays_zip("aliases", F.transform("aliases", lambda a: F.length(a)).alias("n"))
    return t("legal_doc_registry").select("doc_code", F.posexplode(both).alias("pos", "x")).select("doc_code", F.col("pos").cast("bigint").alias("pos"), F.col("x.aliases").alias("alias"), F.col("x.n").cast("bigint").alias("n"))


_STEM = "upper(regexp_replace(coalesce(doc_code, ''), '\\s', '', 'g'))"


@query(
    f"WITH d AS (SELECT doc_id, doc_code, {_STEM} c, lower(trim(title)) tt FROM documents), r AS (SELECT doc_code rc, split_part(doc_code, '/', 1) || '/' || split_part(doc_code, '/', 2) head, CAST(split_part(doc_code, '/', 1) AS INTEGER) no, lower(trim(canonical_title)) rt FROM legal_doc_registry), "
    "h AS (SELECT head, min(rc) x FROM r GROUP BY 1), n AS (SELECT no, min(rc) x FROM r GROUP BY 1 HAVING count(*) = 1), s AS (SELECT rt, min(rc) x FROM r GROUP BY 1), k AS (SELECT split_part(rc, '/', 3) || '#' || no kn, min(rc) x FROM r GROUP BY 1 HAVING count(*) = 1) "
    "SELECT doc_id, coalesce(e.rc, f.rc, h.x, k.x, n.x, s.x) entry, CASE WHEN e.rc IS NOT NULL THEN 1 WHEN f.rc IS NOT NULL THEN 2 WHEN h.x IS NOT NULL THEN 3 WHEN k.x IS NOT NULL THEN 4 WHEN n.x IS NOT NULL THEN 5 WHEN s.x IS NOT NULL THEN 6 ELSE 7 END step FROM d LEFT JOIN r e ON e.rc = d.doc_code LEFT JOIN r f ON f.rc = c LEFT JOIN h ON h.head = split_part(c, '/', 1) || '/' || split_part(c, '/', 2) LEFT JOIN k ON kn = split_part(c, '/', 3) || '#' || TRY_CAST(split_part(c, '/', 1) AS INTEGER) LEFT JOIN n ON n.no = TRY_CAST(split_part(c, '/', 1) AS INTEGER) LEFT JOIN s ON s.rt = tt"
)
def cascade_of_six(t):
    """The entry of a document by its code, the code cleaned, number and year, kind and number, number alone, title."""
    r = t("legal_doc_registry")
    parts = F.split("doc_code", "/")
    keys = r.select("doc_code", F.concat_ws("/", parts[0], parts[1]).alias("head"), parts[0].cast("int").alias("no"), parts[2].alias("kind"), F.lower(F.trim("canonical_title")).alias("name"))
    clean = F.upper(F.regexp_replace(F.coalesce("doc_code", F.lit("")), r"\s", ""))
    p = F.split(clean, "/")
    number = F.try_to_number(F.nullif(F.regexp_extract(p[0], r"^(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int")
    rows = t("documents").select("doc_id", F.col("doc_code").alias("k1"), clean.alias("k2"), F.concat_ws("/", p[0], F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("k3"), F.concat_ws("#", F.coalesce(F.get(p, F.lit(2)), F.lit("")), number.cast("string")).alias("k4"), number.alias("k5"), F.lower(F.trim("title")).alias("k6"))
    steps = {
        "k1": r.select(F.col("doc_code").alias("k1"), F.col("doc_code").alias("x")),
        "k2": r.select(F.col("doc_code").alias("k2"), F.col("doc_code").alias("x")),
        "k3": keys.groupBy(F.col("head").alias("k3")).agg(F.min("doc_code").alias("x")),
        "k4": keys.groupBy(F.concat_ws("#", "kind", F.col("no").cast("string")).alias("k4")).agg(F.min("doc_code").alias("x"), F.count("*").alias("n")).where("n = 1").drop("n"),
        "k5": keys.groupBy(F.col("no").alias("k5")).agg(F.min("doc_code").alias("x"), F.count("*").alias("n")).where("n = 1").drop("n"),
        "k6": keys.groupBy(F.col("name").alias("k6")).agg(F.min("doc_code").alias("x")),
    }
    return matching.first_lookup(rows, steps).select("doc_id", F.col("x").alias("entry"), "step")


# aggregation, windows
@query("SELECT l_returnflag, l_shipmode_ mode_, arg_min(l_partkey, l_orderkey * 10 + l_linenumber) first_part, sum(l_quantity) qty FROM (SELECT *, CASE WHEN l_quantity > 25 THEN l_linestatus END l_shipmode_ FROM lineitem) GROUP BY 1, 2")
def first_and_sum(t):
    """First by order and sum per key; nulls are a group of their own."""
    rows = t("lineitem").withColumn("mode_", F.when(F.col("l_quantity") > 25, F.col("l_linestatus")))
    return rows.groupBy("l_returnflag", "mode_").agg(F.min_by("l_partkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_part"), F.sum("l_quantity").alias("qty"))


@query(f"SELECT doc_id, code FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY code ORDER BY length(text) DESC, length(coalesce(title, '')) DESC, length(coalesce(topic, '')) DESC, doc_id) k FROM (SELECT *, {_C.format(c='doc_code')} code FROM documents) WHERE code IS NOT NULL) WHERE k = 1")
def best_of_three_keys(t):
    """The best document of a code by text, title and topic length, the first of equals."""
    size = lambda c: (-F.coalesce(F.length(c), F.lit(0)))
    d = t("documents").select("doc_id", references.law_code(F.col("doc_code")).alias("code"), (-F.length("text")).alias("a"), size("title").alias("b"), size("topic").alias("c")).where("code is not null")
    return d.groupBy("code").agg(F.min(F.struct("a", "b", "c", "doc_id")).alias("m")).select("m.doc_id", "code")


_NUM = r"list_transform(regexp_extract_all(text, '(?m)^Điều (\d{1,6}[a-zđ]?)\.', 1), lambda x: [CAST(regexp_extract(x, '\d+') AS INTEGER) * 1000 + coalesce(ascii(nullif(regexp_extract(x, '[a-zđ]$'), '')), 0)])"
_GATE = f"list_reduce(list_prepend(CAST([] AS INTEGER[]), {_NUM}), lambda a, x: CASE WHEN (len(a) = 0 AND x[1] // 1000 <= 2) OR (len(a) > 0 AND ((x[1] // 1000 = a[len(a)] // 1000 AND x[1] > a[len(a)]) OR (x[1] // 1000 > a[len(a)] // 1000 AND x[1] // 1000 <= a[len(a)] // 1000 + 3))) THEN list_concat(a, x) ELSE a END)"


@query(f"SELECT doc_id, CAST(len({_NUM}) AS INTEGER) n_found, CAST(len({_GATE}) AS INTEGER) n_accepted FROM documents WHERE len({_NUM}) > 0")
def numbering_gate(t):
    """Accepted against found article headers: next number, same number with a later letter, or a gap of up to three."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^Điều (\d{1,6}[a-zđ]?)\."), 1)
    rows = t("documents").where("text is not null").select("doc_id", found.alias("found")).where(F.size("found") > 0)
    return rows.select("doc_id", F.size("found").alias("n_found"), F.size(gated_headers(F.col("found"))).alias("n_accepted"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INTEGER) place FROM orders")
def composite_order(t):
    """Two sort keys and the id."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query(f"SELECT doc_code, CAST(row_number() OVER (PARTITION BY domain ORDER BY CASE split_part(doc_code, '/', 3) WHEN 'LX' THEN 3 WHEN 'NQ-HĐX' THEN 2 WHEN 'NĐ-HĐX' THEN 2 ELSE 1 END DESC, split_part(doc_code, '/', 2) DESC, doc_code) AS INTEGER) place FROM legal_doc_registry")
def higher_then_later(t):
    """Higher kinds first, then later years."""
    level = F.when(F.split("doc_code", "/")[2] == "LX", 3).when(F.split("doc_code", "/")[2].isin("NQ-HĐX", "NĐ-HĐX"), 2).otherwise(1)
    w = Window.partitionBy("domain").orderBy(level.desc(), F.split("doc_code", "/")[1].desc(), "doc_code")
    return t("legal_doc_registry").select("doc_code", F.row_number().over(w).alias("place"))


@query("SELECT id, question FROM eval_items ORDER BY id")
def input_order(t):
    """Results of two runs put together, in the order of the input."""
    done, rest = t("eval_items").where("topic = 'hoa_giai'"), t("eval_items").where("topic <> 'hoa_giai' or topic is null")
    return rest.select("id", "question").unionByName(done.select("id", "question")).orderBy("id")


@query("SELECT id, array_to_string(list_transform(gold[1:2], lambda g: g.so_ky_hieu || '|' || g.dieu_so), ';') articles, array_to_string(list_distinct(list_transform(gold[1:1], lambda g: g.so_ky_hieu)), ';') docs FROM eval_items")
def cut_answers(t):
    """Answers cut to their first two articles, and their documents made anew from the first."""
    cut = F.slice("gold", 1, 2)
    return t("eval_items").select("id", F.array_join(F.transform(cut, lambda g: F.concat_ws("|", g["so_ky_hieu"], g["dieu_so"].cast("string"))), ";").alias("articles"), F.array_join(F.array_distinct(F.transform(F.slice("gold", 1, 1), lambda g: g["so_ky_hieu"])), ";").alias("docs"))


@query("SELECT doc_code, canonical_title || coalesce(chr(10) || array_to_string(list_filter(list_transform(range(1, len(aliases) + 1), lambda i: CASE WHEN aliases[i] <> canonical_title AND list_position(aliases, aliases[i]) = i THEN aliases[i] END), lambda x: x IS NOT NULL), chr(10)), '') names_ FROM legal_doc_registry WHERE aliases IS NULL OR len(aliases) > 0")
def ordered_union(t):
    """Two lists as one without repeats, in the order of first mention."""
    names = F.array_distinct(F.concat(F.array("canonical_title"), F.coalesce(F.filter("aliases", lambda a: a.isNotNull()), F.array().cast("array<string>"))))
    return t("legal_doc_registry").where(F.col("aliases").isNull() | (F.size("aliases") > 0)).select("doc_code", F.array_join(names, "\n").alias("names_"))


@query("SELECT doc_code, canonical_title FROM legal_doc_registry WHERE doc_code NOT IN (SELECT doc_code FROM legal_doc_registry WHERE domain = 'ben_do') UNION ALL SELECT doc_code, 'by hand' FROM legal_doc_registry WHERE domain = 'ben_do'")
def overwritten(t):
    """Rows made by hand in place of those with their key."""
    r = t("legal_doc_registry").select("doc_code", "canonical_title")
    hand = t("legal_doc_registry").where("domain = 'ben_do'").select("doc_code", F.lit("by hand").alias("canonical_title"))
    return connectors.upserted(r, hand, ["doc_code"])


_TW = r"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"SELECT doc_id, round(k / (na + nb - k), 6) jaccard, round(k / least(na, nb), 6) overlap, round(k / na, 6) contained FROM (SELECT doc_id, len(list_intersect(a, b)) k, len(a) na, len(b) nb FROM (SELECT doc_id, {_TW.format(c='title')} a, {_TW.format(c='canonical_title')} b FROM documents d JOIN legal_doc_registry r ON {_C.format(c='d.doc_code')} = r.doc_code WHERE title IS NOT NULL)) WHERE na > 0 AND nb > 0")
def overlap_measures(t):
    """Jaccard, overlap with the smaller set, and the share of the first set in the second."""
    r = t("legal_doc_registry").select(F.col("doc_code").alias("code"), F.array_distinct(X.tokens(F.col("canonical_title"))).alias("b"))
    d = t("documents").where("title is not null").select("doc_id", references.law_code(F.col("doc_code")).alias("code"), F.array_distinct(X.tokens(F.col("title"))).alias("a"))
    m = d.join(r, "code").where((F.size("a") > 0) & (F.size("b") > 0))
    return m.select("doc_id", *[F.round(c, 6).alias(n) for n, c in zip(("jaccard", "overlap", "contained"), matching.overlaps(F.col("a"), F.col("b")), strict=True)])
