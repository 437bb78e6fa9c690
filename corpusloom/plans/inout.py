"""Named queries: tables through sources and sinks and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.parsing import articles
from corpusloom.plans.language import _LINES, pages
from corpusloom.plans.named import Named
from corpusloom.session import scratch
from corpusloom.sources import connectors
from corpusloom.streaming import ingest

query = Named()
_DOC = "doc_id bigint, lang string, title string"


@query("SELECT doc_id, lang, title FROM documents")
def json_lines(t):
    """Written as JSON lines and read again."""
    path = scratch(t.spark, "lines")
    connectors.write_json_lines(t("documents").select("doc_id", "lang", "title"), path)
    return connectors.read_json_lines(t.spark, path, _DOC)


@query("SELECT doc_code, canonical_title title, CASE WHEN priority = 1 THEN 'duplicate' END problem FROM legal_doc_registry UNION ALL SELECT doc_code, canonical_title, 'duplicate' FROM legal_doc_registry WHERE priority = 1 UNION ALL SELECT NULL, 'no code', 'missing'")
def json_arrays(t):
    """Files that hold one list each, with missing and repeated keys named."""
    path = scratch(t.spark, "arrays")
    r = t("legal_doc_registry").select("doc_code", F.col("canonical_title").alias("title"), "priority")
    rows = r.unionByName(r.where("priority = 1")).select("doc_code", "title").unionByName(t.spark.createDataFrame([(None, "no code")], "doc_code string, title string"))
    listed = rows.groupBy(F.pmod(F.xxhash64("doc_code"), F.lit(4)).alias("k")).agg(F.to_json(F.collect_list(F.struct("doc_code", "title"))).alias("value"))
    listed.select("value").repartition(4).write.option("lineSep", "\n").text(path)
    return connectors.read_json_array(t.spark, path, "doc_code string, title string", "doc_code")


@query("SELECT coalesce(nullif(trim(domain), ''), 'none') kind, canonical_title line FROM legal_doc_registry WHERE trim(canonical_title) <> ''")
def text_folder(t):
    """A folder per kind with text files in it."""
    path = scratch(t.spark, "texts")
    kind = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("none"))
    t("legal_doc_registry").where("trim(canonical_title) <> ''").select(kind.alias("kind"), F.col("canonical_title").alias("value")).repartition("kind").write.partitionBy("kind").text(path)
    files = connectors.read_text_folder(t.spark, path)
    return files.select(F.replace("kind", F.lit("kind="), F.lit("")).alias("kind"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@query("SELECT doc_id, lang, title FROM documents")
def arrow_cache(t):
    """Through Arrow IPC streams, as a cache of another tool holds them."""
    return connectors.arrow_rows(connectors.arrow_files(t("documents").select("doc_id", "title", "lang")), _DOC)


@query("SELECT id, document_number, eff_code FROM legal_effectiveness WHERE eff_code <> ''")
def parquet_parts(t):
    """Written in parts by a column and read with that column from the path."""
    path = scratch(t.spark, "parts")
    t("legal_effectiveness").where("eff_code <> ''").select("id", "document_number", "eff_code").write.partitionBy("eff_code").parquet(path)
    return t.spark.read.schema("id bigint, document_number string, eff_code string").parquet(path)


@query("SELECT n_nationkey, n_name FROM nation")
def manifest_cache(t):
    """Built once and reused as long as the manifest, with the row count in it, is the same."""
    path, nation = scratch(t.spark, "cache"), t("nation").select("n_nationkey", "n_name")
    manifest = {"table": "nation", "rows": nation.count()}
    connectors.cached_with_manifest(t.spark, path, manifest, lambda: nation)
    return connectors.cached_with_manifest(t.spark, path, manifest, lambda: nation.limit(0))


@query("SELECT vec_id, CASE WHEN label = 0 THEN [-x for x in embedding] ELSE embedding END embedding FROM (SELECT vec_id, label, embedding[1:4] embedding FROM embeddings)")
def vector_upsert(t):
    """Vectors written in batches of parts, those that changed in place of the old ones."""
    path = scratch(t.spark, "vectors")
    v = t("embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("embedding"))
    changed = t("embeddings").where("label = 0").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: -x).alias("embedding"))
    connectors.upserted(v, changed, ["vec_id"]).write.option("maxRecordsPerFile", 10_000).parquet(path)
    return t.spark.read.parquet(path)


@query("SELECT o_custkey, 'order ' || o_orderkey entry FROM orders WHERE o_orderstatus <> 'P'")
def log_entries(t):
    """A log of orders in sections of customers, in which a line takes back the entry before it."""
    entry = F.concat(F.lit("ok order "), F.col("o_orderkey").cast("string"))
    lines = F.when(F.col("o_orderstatus") == "P", F.array(entry, F.lit("noise"), F.lit("undo"))).otherwise(F.array(entry, F.lit("noise")))
    log = t("orders").select("o_custkey", "o_orderkey", F.posexplode(lines).alias("k", "line")).withColumn("at", F.struct("o_orderkey", "k"))
    return connectors.retracted(log, "o_custkey", "at", r"^ok (order \d+)$", "^undo$")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) pos, line FROM (SELECT doc_id, unnest(l) line, generate_subscripts(l, 1) k FROM (SELECT doc_id, string_split(translate(text, chr(9) || chr(13), '  '), chr(10)) l FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')))")
def docx_lines(t):
    """Texts as word-processor files, read paragraph by paragraph."""

    @F.pandas_udf("binary")
    def packed(texts):
        return texts.map(lambda x: connectors.docx_bytes(x.split("\n")))

    d = t("documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    files = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), packed(F.translate("text", "\t\r", "  ")).alias("content"))
    read = connectors.read_documents(files)
    return read.select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "pos", F.col("text").alias("line"))


@query(r"SELECT doc_id, 'https://example.org/van-ban/' || s || '-' || doc_id || '.html' url, regexp_extract(h, '^Điều (\d+)', 1) article FROM (SELECT doc_id, regexp_replace(regexp_replace(translate(lower(coalesce(title, 'khong ten')), '" + X.ACCENTED + "', '" + X.BASE + r"'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') s, unnest(regexp_extract_all(l, '(?m)^Điều \d+')) h FROM (SELECT doc_id, title, " + _LINES + " l FROM documents WHERE text IS NOT NULL))")
def page_articles(t):
    """Pages by address, taken apart into the articles of their text."""
    p = pages(t("documents")).select(F.struct("doc_id", "url").alias("k"), X.page_text(F.col("html"))["text"].alias("text"))
    rows = articles(p, "k", least=0).where("number <> '0'")
    return rows.select("k.doc_id", "k.url", F.col("number").alias("article"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) win_start, event_type, count(*) n FROM events GROUP BY 1, 2")
def stream_windows(t):
    """The hourly windows of a stream over the event file, as they stand when it has been read."""
    path, folder = scratch(t.spark, "stream"), scratch(t.spark, "stream-checkpoint")
    schema = t("events").schema
    counts = ingest.tumbling_counts(ingest.event_stream(t.spark, f"{t.folder}/events.parquet*", schema))
    run = counts.writeStream.outputMode("complete").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(path)).option("checkpointLocation", folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(counts.schema).parquet(path).select(F.unix_micros("start").alias("win_start"), "event_type", "n")


@query("SELECT user_id, epoch_us(min(ts)) start_us, count(*) n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) sid FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END b FROM events)) GROUP BY user_id, sid")
def stream_sessions(t):
    """Sessions of a stream, closed by a last event far behind the watermark."""
    path, folder = scratch(t.spark, "sessions"), scratch(t.spark, "sessions-checkpoint")
    events = t("events")
    # one file behind the others moves the watermark past every session
    events.write.parquet(f"{path}/in")
    late = events.agg(F.max("ts").alias("m")).select(F.lit(-1).cast("bigint").alias("event_id"), (F.col("m") + F.expr("interval 30 days")).alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    late.coalesce(1).write.mode("append").parquet(f"{path}/in")
    sessions = ingest.sessions(ingest.event_stream(t.spark, f"{path}/in", events.schema, files=1_000))
    run = sessions.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(sessions.schema).parquet(f"{path}/out").where("user_id >= 0").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query(r"SELECT doc_id, k pos, word FROM (SELECT doc_id, unnest(l[1:3]) word, CAST(generate_subscripts(l[1:3], 1) - 1 AS INTEGER) k FROM (SELECT doc_id, regexp_extract_all(title, '[^ \t\n\r\f\x0b]+') l FROM documents))")
def table_function(t):
    """A Python table function from text to rows, called laterally."""

    @F.udtf(returnType="pos int, word string")
    class FirstWords:
        def eval(self, text: str, most: int):
            import re

            for k, word in enumerate(re.findall(r"[^ \t\n\r\f\x0b]+", text or "")[:most]):
                yield k, word

    t.spark.udtf.register("first_words", FirstWords)
    t("documents").select("doc_id", "title").createOrReplaceTempView("_titled")
    return t.spark.sql("select doc_id, w.pos, w.word from _titled, lateral first_words(title, 3) w")


@query("SELECT n_nationkey, n_name, NULL::VARCHAR note FROM nation")
def database_scan(t):
    """A table of a database over JDBC, in partitions of its key, with nulls for a column it does not have."""
    url = connectors.packed_database(t("nation"), scratch(t.spark, "db"), "nation", {"n_nationkey": "INTEGER", "n_name": "VARCHAR(32672)"})
    read = connectors.read_database(t.spark, url, "nation", ["n_nationkey", "n_name", "note"], driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", partitionColumn="n_nationkey", lowerBound="0", upperBound="25", numPartitions="4")
    return read.select("n_nationkey", "n_name", F.col("note").cast("string").alias("note"))
