"""Core operators on small fixtures: brute force, invariants and the awkward cases."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import cutoffs, evaluate, nested, packed, parsing, ranking, references, validity
from corpusloom.sources import connectors
from corpusloom.sources.tables import first_delivery
from corpusloom.streaming import ingest as streaming

AT = dt.datetime(2041, 3, 1)
RECORD = "id bigint, law_id string, law_name string, article string, extra string, content string, ingested_at timestamp, at int, key string"


def records(spark, rows):
    """rows: dicts; columns ``at`` and ``key`` clash with internal names on purpose."""
    full = [tuple(r.get(k) for k in ("id", "law_id", "law_name", "article", "extra", "content")) + (r.get("ingested_at", AT), 1, "k") for r in rows]
    return spark.createDataFrame(full, RECORD)


def values(spark, kind, texts):
    rule = {"article": packed.articles_of, "extra": packed.references_of}[kind]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


def test_packed_articles(spark):
    given = ["Điều 1", "Điều 1, 2 và 3", '["Điều 4", null, ""]', '"Điều 5","Điều 6"', "Điều 7; Điều 8 (khoản 2, 4)", "Điều 9/10", "a\nb", None, "  ", "[]"]
    assert values(spark, "article", given) == [["Điều 1"], ["Điều 1", "2", "3"], ["Điều 4"], ["Điều 5", "Điều 6"], ["Điều 7", "Điều 8 (khoản 2, 4)"], ["Điều 9", "10"], ["a", "b"], [], [], []]


def test_packed_references_round_trip(spark):
    """Every writer's packing of the same references is taken apart to them."""
    import csv
    import io

    refs = ['1/2030/LX|Luật "A" b, kè và lối|Điều 4', "Luật|2/2031/LX|Luật C|điều 5a", "3/2032/TT-BX|Thông tư D|Điều  6."]
    text = io.StringIO()
    csv.writer(text, quoting=csv.QUOTE_ALL).writerow(refs)
    quoted = text.getvalue().strip()
    packings = [json.dumps(refs), json.dumps(refs, ensure_ascii=False, indent=1), str(refs), "{" + ", ".join(map(repr, refs)) + "}", quoted, quoted.replace('","', '" "'), quoted.replace('","', '"；"'), ",".join(refs[1:]), " ; ".join(refs[1:]), "\t".join(refs[1:]), ";;".join(refs[1:]) + ";"]
    for packing, got in zip(packings, values(spark, "extra", packings), strict=True):
        assert got == refs[-len(got) :] and len(got) >= 2, packing


def test_packed_fields_of_any_length(spark):
    """No bound on brackets, blanks or numbers, and no sign of the field's own is a delimiter."""
    long = " (" + "khoản 1, " * 40 + "điểm a)"
    refs = [f"1/2030/LX|Luật A|Điều 4{long}", "2/2031/LX|Luật B, kè|    Điều     123456789", "3/2032/LX|Luật C|Điều 5"]
    assert values(spark, "extra", [", ".join(refs), ",   ,".join(refs), "," + refs[0]]) == [refs, refs, refs[:1]]
    own = "Điều 1\ue000a; Điều 2\ue001\ue003; \ue0020"
    assert values(spark, "article", [own, "\ue0030; \ue000"]) == [["Điều 1\ue000a", "Điều 2\ue001\ue003", "\ue0020"], ["\ue0030", "\ue000"]]
    assert values(spark, "extra", ['["a\ue000b", "c\\"d"]']) == [["a\ue000b", 'c"d']]


def test_first_delivery_takes_the_earliest(spark):
    rows = [{"id": 1, "article": "b", "ingested_at": AT}, {"id": 1, "article": "a", "ingested_at": AT - dt.timedelta(days=1)}, {"id": 1, "article": "c", "ingested_at": None}, {"id": None, "article": "x"}]
    assert [(r.id, r.article) for r in first_delivery(records(spark, rows), "id", "ingested_at", ["article"]).collect()] == [(1, "a")]


def brute_orphans(rows, registry):
    code = lambda c: re.sub(r"\s", "", c or "").upper() or None
    key = lambda a: (m[1] + m[2]) if (m := re.search(r"(\d+)([a-zđ]?)", a.lower())) else None
    period = lambda r: r.get("ingested_at", AT).strftime("%Y-%m")
    have = {}
    for r in rows:
        for a in (r.get("article") or "").split(";"):
            if code(r.get("law_id")) and key(a):
                k = (code(r["law_id"]), key(a))
                have[k] = min(have.get(k, "9999"), period(r))
    out = set()
    for r in rows:
        law = code(r.get("law_id"))
        if law and law not in registry:
            out.add((r["id"], period(r), law, ""))
        for ref in (r.get("extra") or "").split(";"):
            p = ref.split("|")
            if len(p) >= 3 and key(p[-1]) and have.get((code(p[-3]), key(p[-1])), "9999") > period(r):
                out.add((r["id"], period(r), code(p[-3]), key(p[-1])))
    return out


def test_orphans_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        law = rng.choice(["1/2030/LX"] * 4 + ["2/2030/LX", "3 / 2030 / lx", None, " "])
        refs = [f"{rng.choice(['1/2030/LX', '2/2030/lx', '9/2030/LX'])}|Luật|Điều {rng.randint(1, 150)}{rng.choice(['', '', 'a'])}" for _ in range(rng.randint(0, 3))]
        rows.append({"id": i, "law_id": law, "article": f"Điều {rng.randint(1, 140)}{rng.choice(['', 'a'])}", "extra": ";".join(refs) or None, "ingested_at": dt.datetime(2041, rng.randint(1, 6), 2)})
    registry = spark.createDataFrame([("1/2030/LX",), ("3/2030/LX",)], "doc_code string")
    found = references.orphans(records(spark, rows), registry)
    assert {(r.id, r.period, r.ref_law_id, r.ref_article) for r in found.collect()} == brute_orphans(rows, {"1/2030/LX", "3/2030/LX"})
    assert references.orphans(records(spark, []), registry).count() == 0
    assert sum(r.n_refs for r in references.orphan_counts(found).collect()) == found.count()


def test_runs_are_compressed(spark):
    keys = [("L", "", n, 5) for n in (1, 2, 3, 7, 8, 70)] + [("L", "", 9, 6)]
    runs = references.parent_runs(spark.createDataFrame(keys, "law string, suffix string, number bigint, month int")).orderBy("block").collect()
    assert [[tuple(x) for x in r.runs] for r in runs] == [[(1, 3, 5), (7, 8, 5), (9, 9, 6)], [(70, 70, 5)]]


NODE = "struct<id:string,content:string,type:string,number:string,level:double,is_edit:boolean,num_tokens:bigint,children_json:string>"
TREE = f"tree_id bigint, id string, content string, type string, number string, level double, is_edit boolean, num_tokens bigint, children array<{NODE}>, hash string"


def tree(i, kids):
    return (i, "r", "root", "t", None, 0.0, None, 3, kids, "clash")


def test_nested_paths_and_identity(spark):
    same = json.dumps([{"content": "x", "children": [None, {"id": "deep", "children": []}]}, None, "no node"])
    kid = lambda j: ("1", "kid", None, "1", 1.0, False, 2, j)
    rows = [tree(1, [kid(same), None, kid(same)]), tree(2, None), tree(3, []), tree(4, [kid(" "), kid("{broken")]), tree(None, [])]
    trees = spark.createDataFrame(rows, TREE)
    got = {(r.tree_id, r.node_path, r.parent_path) for r in nested.node_links(trees).collect()}
    want = {(1, "0", ""), *((1, f"0.{k}", "0") for k in (0, 2)), *((1, f"0.{k}.0", f"0.{k}") for k in (0, 2)), *((1, f"0.{k}.0.1", f"0.{k}.0") for k in (0, 2)), (2, "0", ""), (3, "0", ""), (4, "0", ""), (4, "0.0", "0"), (4, "0.1", "0")}
    assert got == want
    objects, bridge, _ = nested.merkle_tables(nested.written_objects(trees, True))
    assert objects.where("content = 'kid'").count() == 2  # with and without children: identical ones once
    assert {r.content for r in nested.flat_nodes(trees).where("depth = 2").collect()} == {"x"}
    assert nested.node_links(trees.limit(0)).count() == 0
    assert {(r.tree_id, r.node_path) for r in nested.broken_children(trees).collect()} == {(4, "0.1")}


def walked(node, path="0"):
    yield path
    for k, kid in enumerate(node.get("children") or []):
        if isinstance(kid, dict):
            yield from walked(kid, f"{path}.{k}")


def test_nested_trees_larger_than_a_fragment(spark):
    """Wide, deep and repeated subtrees against a plain recursive walk."""
    import random

    rng = random.Random(4)

    def grown(depth):
        return {"content": rng.choice("ab"), "children": [None if rng.random() < 0.1 else grown(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []}

    rows, want = [], set()
    for i in range(30):
        kids = [grown(7), grown(3), grown(3)]
        rows.append(tree(i, [("1", "kid", None, "1", 1.0, False, 2, json.dumps(kids))]))
        want |= {(i, p) for p in walked({"children": [{"children": kids}]})}
    objects = nested.written_objects(spark.createDataFrame(rows, TREE).coalesce(1), True, fragment=3)
    levels = objects.agg(F.max("levels")).first()[0]
    assert levels > nested.STEPS
    got = [(r.tree_id, r.node_path) for r in nested.occurrences(objects).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("depth", [200, 20000])
def test_deep_trees(spark, depth):
    deep = '[{"content":"x","children":' * depth + "[]" + "}]" * depth
    trees = spark.createDataFrame([tree(1, [("1", "kid", None, "1", 1.0, False, 2, deep)])], TREE)
    s = nested.node_links(trees).agg(F.count("*").alias("n"), F.max(F.length("node_path")).alias("m")).first()
    assert (s.n, s.m) == (depth + 2, 2 * (depth + 1) + 1)


def test_nested_json_of_any_depth(monkeypatch):
    depth = 20_000
    text = '[{"id": "x", "children": ' * depth + "[null]" + "}]" * depth
    nodes = list(nested.walk_up({"children_json": text}))
    tops = [o for o, below in nodes if below is not None]
    assert len(nodes) - len(tops) == depth and nodes[-1][0].height == depth and nodes[-1][0].levels == len(tops) - 1 < 40
    samples = ['[1, -2.5e3, "a\\"\\u00e9", true, null, [], {}, {"k": [{"z": {}}]}]', " [ ] ", '{"a": 1}', "[1,]", "[1 2]", '{"a"}', "[", "]", "[1]]", ""]
    wants = []
    for s in samples:
        try:
            wants.append(json.loads(s))
        except ValueError:
            wants.append(ValueError)
    real = json.loads

    def refuse(s):
        if s.strip()[:1] in ("[", "{", "]", ""):
            raise RecursionError
        return real(s)

    monkeypatch.setattr(nested.json, "loads", refuse)
    for s, want in zip(samples, wants, strict=True):
        if want is ValueError:
            with pytest.raises(ValueError):
                nested.parsed(s)
        else:
            assert nested.parsed(s) == want


def test_level_parents(spark):
    levels = [0, 1, 2, 2, 1, 3, 0, 2]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "g int, pos int, level int")
    got = [r.parent_pos for r in parsing.level_parents(df, "g", "pos", "level", [0, 1, 2, 3]).orderBy("pos").collect()]
    assert got == [max((j for j in range(i) if levels[j] < levels[i]), default=None) for i in range(len(levels))]


def test_chunks_cover_their_text(spark):
    df = spark.createDataFrame([(1, "One two. Three four! Five? " * 20), (2, ""), (3, None), (4, "no end")], "k int, text string")
    chunks = parsing.packed_chunks(df, "k", target=60).collect()
    assert all(c.n_chars <= 60 for c in chunks) and sum(c.n_sentences for c in chunks if c.k == 1) == 60
    assert parsing.articles(spark.createDataFrame([(1, "Điều 1. " + "a" * 30 + "\nĐiều 2. " + "b" * 30 + " theo Điều 9")], "k int, text string"), "k").count() == 2


LISTS = "qid int, item_id int, score double"


def test_cutoffs(spark):
    r = ranking.ranked(spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.8, 0.3, 0.2))] + [(2, 9, 0.1)], LISTS))
    kept = lambda df: sorted((x.qid, x.item_id) for x in df.collect())
    assert kept(cutoffs.largest_gap(r, 1, 0.05)) == [(1, 0), (1, 1), (2, 9)]
    assert kept(cutoffs.relative(r, 0.3)) == [(1, 0), (1, 1), (1, 2), (2, 9)]
    assert kept(cutoffs.fixed(r, 0.95, 4)) == [(1, 0), (1, 1), (2, 9)]
    assert kept(cutoffs.margin(r, 5, 0.3, 0.15)) == [(1, 0), (1, 1), (2, 9)]
    assert kept(cutoffs.keep_one(r.withColumn("bad", F.lit(True)), "bad")) == [(1, 0), (2, 9)]
    assert cutoffs.largest_gap(r.limit(0), 1, 0.1).count() == 0


def test_rrf_bases(spark):
    one = ranking.ranked(spark.createDataFrame([(1, 5, 2.0)], LISTS))
    assert ranking.rrf([one]).first().score == round(1 / 61, 8)
    assert ranking.rrf([one], base=0).first().score == round(1 / 60, 8)


def test_bm25_top_equals_the_relational_form(spark):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)} w{i % 7} gamma") for i in range(60)] + [(99, None), (98, "")], "item_id int, text string")
    asked = spark.createDataFrame([(1, "beta w3 beta"), (2, "nothing"), (3, None)], "qid int, text string")
    full = {(r.qid, r.item_id, r.score) for r in ranking.top_k(ranking.bm25(asked, docs), 7).collect()}
    assert full == {(r.qid, r.item_id, r.score) for r in ranking.bm25_top(asked, ranking.bm25_index(docs), 7).collect()} and full


def test_metrics(spark):
    key = lambda rows: spark.createDataFrame(rows, "qid int, key int")
    got = {r.qid: (r.p, r.r, r.f2) for r in evaluate.per_query(key([(1, 4), (1, 5), (2, 4)]), key([(1, 4), (1, 17), (2, 4), (2, 17)])).collect()}
    assert got[1] == (0.5, 0.5, 0.5) and got[2] == (1.0, 0.5, pytest.approx(2.5 / 4.5))
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "qid int")
    got = evaluate.per_query(key([(1, 4), (2, 4)]), key([(1, 4), (3, 4)]), asked)
    assert {r.qid: (r.p, r.r, r.f2) for r in got.collect()} == {1: (1.0, 1.0, 1.0), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (1.0, 1.0, 1.0)}
    assert evaluate.macro(got).first().n == 4


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    for text, want in [("theo Điều 112a và Điều 112 của Luật", ["112a", "112"]), ("điều 5, Điều  17", ["5", "17"]), ("Theo ĐIỀU 12 và Điều 24", ["12", "24"]), ("khoản 3 Điều 7 năm 2020", ["7"])]:
        assert one(X.article_numbers(F.lit(text))) == want
    assert one(X.unaccented(F.lit("Điều ĐƯỜNG"))) == "dieu duong"
    assert one(X.mixed_date(F.lit("31/02/2039"))) is None and one(X.mixed_date(F.lit("17-02-2040"))) == dt.date(2040, 2, 17)
    assert one(X.roman(F.lit(1994))) == "MCMXCIV" and one(X.clean_null(F.lit(" nan "))) is None
    assert one(X.html_text(F.lit("<p>a&amp;b</p><script>x</script><div>c</div>"))) == "a&b\nc"
    day = F.lit("2040-01-01").cast("date")
    assert one(validity.in_effect_on(day, F.lit("2039-01-01").cast("date"), day)) is False


def test_connectors(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, connectors.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    built = []
    for manifest in ({"n": 1}, {"n": 1}, {"n": 2}):
        connectors.cached_with_manifest(spark, str(tmp_path / "t"), manifest, lambda: built.append(1) or old)
    assert len(built) == 2


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i % 60), i % 3, "click", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.tumbling_counts(streaming.event_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("counts").collect()) == 200
    q = streaming.ingest(streaming.event_stream(spark, str(tmp_path / "in"), df.schema, 1), str(tmp_path / "out"), ["event_id"], "ts", str(tmp_path / "cp"), 4)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_ingest_keeps_the_earliest_delivery(spark, tmp_path):
    """Later files bring earlier and later deliveries of known keys; only what a batch touches is rewritten."""
    at = lambda day: dt.datetime(2024, 1, day)
    files = [[(k, at(10), f"a{k}") for k in range(40)], [(1, at(5), "earlier"), (2, at(15), "later"), (3, None, "never")], [(1, at(7), "between"), (50, None, "alone"), (1, at(4), "first")]]
    q = None
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "k int, ts timestamp, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = "k int, ts timestamp, v string"
        q = streaming.ingest(streaming.event_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), ["k"], "ts", str(tmp_path / "cp"), 8)
        q.awaitTermination(120)
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: f"a{k}" for k in range(40)} | {1: "first", 50: "alone"}
