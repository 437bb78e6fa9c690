"""Named queries: scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.plans.named import Named

query = Named()
_W = r"[ \t\n\r\f\x0b]+"


def _replaced(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


@query(f"SELECT doc_id, {_replaced('title', X.tone_pairs())} title FROM documents WHERE title IS NOT NULL")
def tone_marks(t):
    return t("documents").where("title is not null").select("doc_id", X.tones_moved(F.col("title")).alias("title"))


@query("SELECT DISTINCT law_name, nfc_normalize(law_name) nfc, length(nfc_normalize(law_name)) n FROM legal_knowledge_records WHERE law_name IS NOT NULL")
def normal_form(t):
    """Names in composed form."""
    names = t("legal_knowledge_records").where("law_name is not null").select("law_name").distinct()
    return names.withColumn("nfc", X.normalized(F.col("law_name"))).withColumn("n", F.length("nfc").cast("bigint"))


_TAILS = [r"năm 20\d\d", "bản nháp", "toàn văn"]


@query(
    rf"SELECT DISTINCT id, trim(regexp_replace(CASE WHEN coalesce(law_id, '') = '' THEN c ELSE regexp_replace(c, '(?i){_W}số{_W}' || regexp_escape(law_id) || '([^\p{{L}}\p{{N}}_]|$)', '\1') END, '{_W}', ' ', 'g')) title "
    rf"FROM (SELECT *, regexp_replace(trim(regexp_replace(law_name, '{_W}', ' ', 'g')), '(?i){_W}(?:{'|'.join(_TAILS)})(?:[^\p{{L}}\p{{N}}_].*$|$)', '') c FROM legal_knowledge_records WHERE law_name IS NOT NULL)"
)
def title_clean(t):
    r = t("legal_knowledge_records").where("law_name is not null")
    return r.select("id", X.title_without(F.col("law_name"), F.col("law_id"), _TAILS).alias("title")).distinct()


@query(
    rf"SELECT DISTINCT id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(law_name, '(?i)^[ \t\n\r\f\x0b]*(?:toàn văn|văn bản)[ \t\n\r\f\x0b]*:{_W[:-1]}*', ''), '(?i)[ \t\n\r\f\x0b]*số{_W}' || regexp_escape(coalesce(law_id, '')), '', 'g'), '(?i)[ \t\n\r\f\x0b]*năm{_W}\d\d\d\d.*$', ''), '{_W}', ' ', 'g')), '^[ |–-]+|[ |–-]+$', '', 'g') name_ FROM legal_knowledge_records WHERE law_name IS NOT NULL"
)
def manifest_name(t):
    r = t("legal_knowledge_records").where("law_name is not null")
    return r.select("id", X.name_cleaned(F.col("law_name"), F.col("law_id"), "(?:toàn văn|văn bản)", r"năm\s+\d{4}").alias("name_")).distinct()


_SAYS = "CASE WHEN doc_id % 3 = 0 THEN 'có hiệu lực thi hành kể từ ngày ' WHEN doc_id % 3 = 1 THEN 'Có hiệu lực từ ngày ' ELSE 'ban hành ngày ' END || (doc_id % 31 + 1) || ' tháng ' || month(published_at) || ' năm ' || year(published_at)"


@query(
    f"SELECT doc_id, CAST(try_strptime(regexp_extract(s, 'năm (\\d+)', 1) || '-' || regexp_extract(s, 'tháng (\\d+)', 1) || '-' || regexp_extract(s, 'ngày (\\d+)', 1), '%Y-%m-%d') AS DATE)::VARCHAR on_day FROM (SELECT doc_id, {_SAYS} s FROM documents WHERE published_at IS NOT NULL) WHERE on_day IS NOT NULL AND doc_id % 3 < 2"
)
def date_words(t):
    """Dates spelled out behind one of two phrases; impossible days and other phrases give none."""
    said = t("documents").where("published_at is not null").select("doc_id", F.expr(_SAYS).alias("s"))
    day = X.worded_date(F.col("s"), ["có hiệu lực thi hành kể từ ngày", "có hiệu lực từ ngày"])
    return said.select("doc_id", day.cast("string").alias("on_day")).where("on_day is not null")


@query(r"SELECT w, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(law_name), '\d+/[\p{L}\p{N}_/.-]+|\p{L}+|\d+')) w FROM legal_knowledge_records) GROUP BY 1")
def code_words(t):
    """Word counts of the names, codes kept whole."""
    return t("legal_knowledge_records").select(F.explode(X.code_tokens(F.col("law_name"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


_SYNONYMS, _STOP = [("bảng giá", "biểu phí"), ("bãi neo", "bến đò")], ["của", "và", "theo", "thì", "các", "được", "cho", "khi"]
_LIST = ", ".join(f"'{w}'" for w in _STOP)


@query(rf"SELECT id, array_to_string(list_concat(list_filter(regexp_extract_all({_replaced('lower(question)', _SYNONYMS)}, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({_LIST})), regexp_extract_all(question, '\d+/\d+(?:/\p{{Lu}}[\p{{Lu}}-]*)?')), ' ') words FROM eval_items WHERE question IS NOT NULL")
def search_words(t):
    """Tokens after synonyms, without stopwords, with codes once more."""
    return t("eval_items").where("question is not null").select("id", F.array_join(X.search_tokens(F.col("question"), _SYNONYMS, _STOP), " ").alias("words"))


@query(rf"SELECT id, CAST(len(list_filter(list_distinct(regexp_extract_all(translate(lower(answer), '{X.ACCENTED}', '{X.BASE}'), '[\p{{L}}\p{{N}}_]+')), lambda w: w NOT IN ('cua', 'va', 'thi', 'cho'))) AS INTEGER) n FROM eval_items WHERE answer IS NOT NULL")
def content_words(t):
    return t("eval_items").where("answer is not null").select("id", F.size(X.content_tokens(F.col("answer"), ["cua", "va", "thi", "cho"])).alias("n"))


_TOPICS = [("harbour", ["bến đò", "bãi neo", "thuyền"]), ("farm", ["ruộng", "trại"]), ("fee", ["mức phí", "biểu phí"])]
_HIT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{label}'" for label, words in _TOPICS) + " ELSE 'other' END"


@query(f"SELECT coalesce({_HIT}, 'other') label, count(*) n FROM documents GROUP BY 1")
def topic_labels(t):
    return t("documents").groupBy(X.first_label(F.col("text"), _TOPICS, "other").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT id, contains(lower(question), ' có ') AND contains(lower(question), 'không') yes_no, contains(lower(question), 'mức phí') fee, length(question) - length(replace(question, ',', '')) >= 2 complex_, contains(lower(question), 'xử lý thế nào') how FROM eval_items WHERE question IS NOT NULL")
def question_kind(t):
    q, low = F.col("question"), F.lower("question")
    return t("eval_items").where(q.isNotNull()).select("id", (low.contains(" có ") & low.contains("không")).alias("yes_no"), low.contains("mức phí").alias("fee"), (F.regexp_count(q, F.lit(",")) >= 2).alias("complex_"), low.contains("xử lý thế nào").alias("how"))


def _escaped(c):
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def pages(documents):
    """(doc_id, url, html): each text as a page, a paragraph per line, of class 'head' for article headers."""
    line = lambda p: F.concat(F.lit('<p class="'), F.when(p.rlike("^Điều"), "part head").otherwise("part"), F.lit('">'), _escaped(p), F.lit("</p>"))
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    head = F.concat(F.lit("<html><head><title>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style></head><body><script>if (1 < 2) {}</script><svg><text>no</text></svg><div>"))
    url = F.concat(F.lit("https://example.org/van-ban/"), X.slug(F.coalesce("title", F.lit("khong ten"))), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".html"))
    return documents.where("text is not null").select("doc_id", url.alias("url"), F.concat(head, body, F.lit("</div></body></html>")).alias("html"))


_LINE = r"trim(regexp_replace(x, '[ \t\r\f\x0b]+', ' ', 'g'))"
_LINES = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LINE}), lambda x: x <> ''), chr(10))"


@query(f"SELECT doc_id, nullif(trim(regexp_replace(title, '[ \\t\\n\\r\\f\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '') title, {_LINES} body FROM documents WHERE text IS NOT NULL")
def html_text(t):
    """Every document through a page and back by a parser: title and lines, with all signs that a page must escape."""
    return pages(t("documents")).select("doc_id", X.page_text(F.col("html")).alias("p")).select("doc_id", "p.title", F.col("p.text").alias("body"))


@query(r"SELECT doc_id, k pos, trim(regexp_replace(h[k + 1], '[ \t]+', ' ', 'g')) head FROM (SELECT doc_id, h, CAST(unnest(range(len(h))) AS INTEGER) k FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'Điều')) h FROM documents))")
def para_extract(t):
    """The paragraphs of one class of every page."""
    return pages(t("documents")).select("doc_id", F.posexplode(X.paragraphs_of(F.col("html"), "head")).alias("pos", "head"))


@query("SELECT r_regionkey, array_to_string(list('| ' || n_nationkey || ' | ' || n_name || ' |' ORDER BY n_nationkey), chr(10)) md FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def table_markdown(t):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(rows.alias("rows")).select("r_regionkey", X.markdown_table(F.col("rows")).alias("md"))


_ROMAN = "['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']", "['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC']", "['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM']", "['', 'M', 'MM', 'MMM']"


@query(
    f"SELECT p_partkey, ({_ROMAN[3]})[p_partkey // 1000 + 1] || ({_ROMAN[2]})[p_partkey // 100 % 10 + 1] || ({_ROMAN[1]})[p_partkey // 10 % 10 + 1] || ({_ROMAN[0]})[p_partkey % 10 + 1] roman, "
    "CASE WHEN p_partkey > 702 THEN chr(CAST(97 + ((p_partkey - 703) // 676) % 26 AS INTEGER)) ELSE '' END || CASE WHEN p_partkey > 26 THEN chr(CAST(97 + ((p_partkey - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(97 + (p_partkey - 1) % 26 AS INTEGER)) alpha FROM part WHERE p_partkey BETWEEN 1 AND 3999"
)
def numerals(t):
    return t("part").where("p_partkey between 1 and 3999").select("p_partkey", X.roman(F.col("p_partkey")).alias("roman"), X.alpha(F.col("p_partkey")).alias("alpha"))


@query("SELECT id, trim(answer) answer, false cjk FROM eval_items WHERE answer IS NOT NULL")
def labels_stripped(t):
    """Answers behind a label and a thought come out as they were."""
    said = F.concat(F.lit("<think>a\nb</think> Trả lời: "), F.col("answer"), F.lit(" <think>never closed"))
    return t("eval_items").where("answer is not null").select("id", X.without_labels(said, ["trả lời", "answer"]).alias("answer"), X.has_cjk(F.col("answer")).alias("cjk"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(text[1:80]) || '…' ELSE text END cut, array_to_string(list_filter(string_split_regex(text, '{_W}'), lambda w: w <> '')[1:12], ' ') head FROM documents WHERE text IS NOT NULL")
def snippets(t):
    return t("documents").where("text is not null").select("doc_id", X.snippet(F.col("text"), 80).alias("cut"), X.first_tokens(F.col("text"), 12).alias("head"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) k FROM events")
def json_in_text(t):
    said = F.concat(F.lit("kết quả: ```json\n"), F.col("props"), F.lit("\n``` hết"))
    return t("events").select("event_id", X.json_in(said, "k int")["k"].alias("k"))


_NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_H = f"sha1(unhex('{_NS.replace('-', '')}') || encode(coalesce(doc_code, '') || '#' || doc_id))"
_SLUG = f"regexp_replace(regexp_replace(translate(lower(title), '{X.ACCENTED}', '{X.BASE}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    f"SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] uuid, sha1(coalesce(doc_code, ''))[1:10] short, "
    f"s || CASE WHEN k > 1 THEN '_' || k ELSE '' END slug FROM (SELECT doc_id, doc_code, lower({_H}) h, {_SLUG} s, row_number() OVER (PARTITION BY {_SLUG} ORDER BY doc_id) k FROM documents)"
)
def stable_uuids(t):
    """Version 5 UUIDs, short hashes, and slugs told apart by a number."""
    d = t("documents").withColumn("s", X.slug(F.col("title")))
    k = F.row_number().over(Window.partitionBy("s").orderBy("doc_id"))
    name = F.concat(F.coalesce("doc_code", F.lit("")), F.lit("#"), F.col("doc_id").cast("string"))
    return d.withColumn("k", k).select("doc_id", X.uuid5(_NS, name).alias("uuid"), F.substring(F.sha1(F.coalesce("doc_code", F.lit(""))), 1, 10).alias("short"), F.concat("s", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise("")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, 'Điều ' || l_partkey || ';Điều ' || l_suppkey labels FROM lineitem")
def label_expand(t):
    packed = F.concat(F.lit(" điều "), F.col("l_partkey").cast("string"), F.lit("_ "), F.col("l_suppkey").cast("string"), F.lit("_"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_join(X.expanded_labels(packed), ";").alias("labels"))


@query(f"SELECT doc_id, replace({_SLUG.replace('title', 'title')}, '-', ' ') name_, 'example.org' host FROM documents WHERE title IS NOT NULL AND text IS NOT NULL AND {_SLUG} <> ''")
def url_names(t):
    p = pages(t("documents").where("title is not null").where(X.slug(F.col("title")) != ""))
    return p.select("doc_id", X.name_in_url(F.col("url")).alias("name_"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT doc_id, title back, title kept FROM documents WHERE title IS NOT NULL")
def latin1_repair(t):
    """Titles garbled and put right, and clean ones, which stay."""
    garbled = F.decode(F.encode("title", "UTF-8"), "ISO-8859-1")
    return t("documents").where("title is not null").select("doc_id", X.from_latin1(garbled).alias("back"), X.from_latin1(F.col("title")).alias("kept"))


@query(r"SELECT id, w, count(*) n FROM (SELECT id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) w FROM eval_items) GROUP BY ALL")
def segmented_words(t):
    """Words by a segmenter of choice, here the plain one."""
    return X.segmented(t("eval_items"), "question").select("id", F.explode("words").alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
