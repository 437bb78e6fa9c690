"""Structure, chunks, selection and look-ups on small fixtures: brute force, order, and the awkward cases."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import evaluate, matching, mining, parsing, ranking, selection, sequential, structure, validity, versions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def of(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_gated_articles(spark):
    text = "mở đầu\nĐiều 1. a\nĐiều 2. b theo\nĐiều 40. không phải\nĐiều 2a. c\nĐiều 4. d\nĐiều 3. lùi\n"
    got = of(spark, [text, "Điều 9. muộn", "", None, "không"], structure.gated_articles)
    assert [b.label for b in got[0]] == ["", "1", "2", "2a", "4"] and "Điều 40." in got[0][2].body and "Điều 3." in got[0][4].body
    assert "".join(b.body for b in got[0]) == text
    assert [[b.label for b in x] for x in got[1:3]] == [[""], []] and not got[3] and got[4][0].body == "không"


def test_numbered_clauses(spark):
    got = of(spark, ["1. a\n2. b\n4. c\n3. d", "2. x\n1. y", "", None], structure.numbered_clauses)
    assert [(b.label, b.body) for b in got[0]] == [("1", "1. a\n"), ("2", "2. b\n4. c\n"), ("3", "3. d")]
    assert [(b.label, b.body) for b in got[1]] == [("", "2. x\n1. y")]


def test_guarded_articles(spark):
    got = of(spark, ["Điều 1. Người giữ kho phải ghi sổ theo Điều 5. Khi khác thì Điều 2. Người gác báo lại cho chủ"], lambda c: structure.guarded_articles(c, ["theo", "tại"]))
    assert [b.label for b in got[0]] == ["1", "2"]


def test_levels_quotes_and_breadcrumbs(spark):
    rules = [("article", 3, r"^Điều\s*(\d+)\."), ("clause", 4, r"^(\d+)\.")]
    got = of(spark, ["Điều 7. x", "3. y", "TIÊU ĐỀ", "thường", "12", ""], lambda c: structure.level_of(c, rules, ("title", 0), ("text", 7)))
    assert [(x.type, x.level, x.number) for x in got] == [("article", 3.0, "7"), ("clause", 4.0, "3"), ("title", 0.0, ""), ("text", 7.0, ""), ("text", 7.0, ""), ("text", 7.0, "")]
    lines = ["a", "“b", "c”", "d", "“e” f", "g"]
    array = F.array(*map(F.lit, lines))
    assert one(spark, structure.in_quotes(array)) == [False, True, True, False, True, False]
    heads = F.array(*map(F.lit, ["x", "A 1", "B 1", "y", "A 2", "z"]))
    assert one(spark, structure.breadcrumbs(heads, ["^A", "^B"])) == [["", ""], ["A 1", ""], ["A 1", "B 1"], ["A 1", "B 1"], ["A 2", ""], ["A 2", ""]]


def test_trimmed_at(spark):
    long = "x" * 300 + " PHỤ LỤC " + "y" * 300
    got = of(spark, [long, "ngắn PHỤ LỤC", "z" * 700, None, ""], lambda c: structure.trimmed_at(c, "PHỤ LỤC", 500))
    assert got == ["x" * 300, "ngắn PHỤ LỤC", "z" * 500, None, ""]


def test_soft_pieces():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", " ", ". ", "\n", "; "]) for _ in range(rng.randint(0, 120)))
        cut = structure.soft_pieces(text, 40)
        assert all(0 < len(p) <= 40 for p in cut) and "".join("".join(cut).split()) == "".join(text.split())
    assert structure.soft_pieces("một câu. hai câu ba", 14) == ["một câu.", "hai câu ba"] and structure.soft_pieces("x" * 100, 40) == ["x" * 40, "x" * 40, "x" * 20]


def test_sentence_chunks(spark):
    df = spark.createDataFrame([(1, "a. " * 300, 9), (2, None, 9), (3, "  ", 9), (4, "", 9)], "k int, text string, pos int")
    rows = structure.sentence_chunks(df, "k", most=100).collect()
    assert {r.k for r in rows} == {1} and [r.pos for r in sorted(rows, key=lambda r: r.pos)] == list(range(len(rows)))
    assert structure.sentence_chunks(df.limit(0), "k").count() == 0


def test_packed_segments_and_windows(spark):
    parts = F.array(*map(F.lit, ["aaaa", "bbb", "cc", "ddddddddd", "e"]))
    assert [(x.n, x.body) for x in one(spark, structure.packed_segments(parts, 8, 0))] == [(2, "aaaa\nbbb"), (1, "cc"), (1, "ddddddddd"), (1, "e")]
    assert [x.n for x in one(spark, structure.packed_segments(parts, 8, 100))] == [5]
    words = F.array(*[F.lit(str(i)) for i in range(10)])
    assert one(spark, structure.token_windows(words, 4, 1, 1)) == [["0", "1", "2", "3"], ["0", "3", "4", "5", "6"], ["0", "6", "7", "8", "9"]]
    assert one(spark, structure.token_windows(F.array().cast("array<string>"), 4, 1)) == []


def test_level_parents_of_unlisted_levels(spark):
    rows = [(1, 1, 0.0), (1, 2, 1.5), (1, 3, 2.0), (1, 4, 1.5), (1, 5, None), (2, 1, 3.0)]
    df = spark.createDataFrame(rows, "g int, p int, l double")
    assert {(r.g, r.p): r.parent_pos for r in parsing.level_parents(df, "g", "p", "l").collect()} == {(1, 1): None, (1, 2): 1, (1, 3): 2, (1, 4): 1, (1, 5): None, (2, 1): None}
    assert parsing.level_parents(df.limit(0), "g", "p", "l").count() == 0


def test_text_helpers(spark):
    assert of(spark, ["hòa", "ỦY BAN", "Thủy", None, ""], X.tones_moved) == ["hoà", "UỶ BAN", "Thuỷ", None, ""]
    assert one(spark, X.code_tokens(F.lit("Theo 22/2023/QH15, điều 5"))) == ["theo", "22/2023/qh15", "điều", "5"]
    assert str(one(spark, X.worded_date(F.lit("Có hiệu lực từ ngày 5 tháng 12 năm 2040"), ["có hiệu lực từ ngày"]))) == "2040-12-05"
    assert one(spark, X.worded_date(F.lit("có hiệu lực từ ngày 31 tháng 2 năm 2040"), ["có hiệu lực từ ngày"])) is None
    assert [one(spark, X.alpha(F.lit(n))) for n in (1, 26, 27, 702, 703, 0)] == ["a", "z", "aa", "zz", "aaa", None]
    import uuid

    assert one(spark, X.uuid5(str(uuid.NAMESPACE_URL), F.lit("văn bản"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "văn bản"))
    assert one(spark, X.expanded_labels(F.lit("Điều 12_13_ "))) == ["Điều 12", "Điều 13"]
    assert one(spark, X.name_in_url(F.lit("https://a.b/c/Luat-Quan-ly-675268.aspx"))) == "Luat Quan ly"
    assert of(spark, ["Ä\x90iá»\x81u", "Điều", "café", None], X.from_latin1) == ["Điều", "Điều", "café", None]
    page = "<title>T&amp;x</title><p>a&nbsp;b<script>var s = '<p>';</script></p><svg><text>no</text></svg><div>c &Agrave;<br>d</div>"
    got = one(spark, X.page_text(F.lit(page)))
    assert (got.title, got.text) == ("T&x", "a\xa0b\nc À\nd")
    assert [(m.text, m.at) for m in one(spark, X.mentions(F.lit("Điều 1 và Điều 22."), r"Điều \d+"))] == [("Điều 1", 0), ("Điều 22", 10)]
    assert of(spark, ["", None, "không"], lambda c: X.mentions(c, r"Điều \d+")) == [[], [], []]
    assert one(spark, selection.without_uncited(F.lit("Theo khoản 2 Điều 5 của luật (điều 7) và Điều 12a."), F.array(F.lit("12a")))) == "Theo luật và Điều 12a."


def test_segmenter_of_choice(spark):
    df = spark.createDataFrame([(1, "a-b c"), (2, None)], "i int, t string")
    assert {r.i: r.words for r in X.segmented(df, "t", lambda s: s.split("-")).collect()} == {1: ["a", "b c"], 2: []}


def test_validity_rules(spark):
    df = spark.createDataFrame([("x", None), (None, "Hết hiệu lực"), ("y", "Hết hiệu lực"), (None, None)], "c string, s string")
    rows = df.select(validity.expired(F.col("c"), F.col("s"), {"x"}, {"y"}, ["hết hiệu lực"]).alias("e"), validity.in_force(F.col("s"), ["còn"]).alias("f")).collect()
    assert [(r.e, r.f) for r in rows] == [(True, False), (True, False), (False, False), (False, False)]
    m = F.create_map(F.lit("het_1"), F.array(F.lit("a")), F.lit("con_1"), F.array().cast("array<string>"))
    assert one(spark, validity.status_of_relations(m, [("holds", "con", None), ("ended", "het", "het_2")], "none")) == "ended"


RANKED = "qid int, item_id int, score double, rank int, g string, y int"


def lists(spark, rng, n=40):
    rows = []
    for q in range(n):
        scores = sorted((round(rng.random(), 3) for _ in range(rng.randint(1, 12))), reverse=True)
        rows += [(q, 100 * q + k, s, k + 1, rng.choice(["a", "b", None]), rng.choice([0, 2030, 2035, 2040])) for k, s in enumerate(scores)]
    return spark.createDataFrame(rows, RANKED), rows


def test_versions(spark):
    df, rows = lists(spark, random.Random(2))
    got = {r.item_id for r in versions.family_collapsed(df, "g", "y").collect()}
    want = {i for q, i, _, _, g, y in rows if g is None or y == 0 or y >= max(b[5] for b in rows if b[0] == q and b[4] == g)}
    assert got == want
    gone = spark.createDataFrame([(i,) for _, i, *_ in rows[:3]], "old_code int")
    kept = versions.superseded_dropped(df, gone, "item_id", "g", "y").collect()
    assert {r.qid for r in kept} == {r[0] for r in rows}  # no list is emptied
    assert versions.older_dropped(df.limit(0), ["qid", "g"], "item_id", "y").count() == 0


def test_packed_context(spark):
    rng = random.Random(4)
    rows = [(q, k, 0.0, k + 1, None, rng.randint(1, 900)) for q in range(30) for k in range(rng.randint(1, 8))]
    want = {}
    for q in range(30):
        used = 0
        for _, k, _, _, _, n in (r for r in rows if r[0] == q):
            if used + n + 4 <= 1500:
                want[q, k] = n
                used += n + 4
                continue
            if 1500 - used > 200:
                want[q, k] = 1500 - used
            break
    got = selection.packed_context(spark.createDataFrame(rows, RANKED), "y", 1500).collect()
    assert {(r.qid, r.item_id): r.taken for r in got} == want


def test_groups_votes_and_positions(spark):
    df, rows = lists(spark, random.Random(9))
    got = {r.item_id for r in selection.of_few_groups(df, "g", 1, 2).collect()}
    want = set()
    for q in {r[0] for r in rows}:
        seen = []
        for _, i, _, _, g, _ in sorted((r for r in rows if r[0] == q), key=lambda r: r[3]):
            if g not in seen:
                seen.append(g)
                if len(seen) <= 2:
                    want.add(i)
    assert got == want
    chosen = spark.createDataFrame([(q, [3, 1, 3, 77]) for q in range(40)], "qid int, positions array<int>")
    picked = selection.by_positions(df, chosen).collect()
    assert {(r.qid, r.rank) for r in picked} == {(r[0], r[3]) for r in rows if r[3] in (1, 3)}
    votes = selection.weighted_votes([("x", 1.0, df), ("y", 3.0, df.where("rank = 1"))]).where("rank = 1").collect()
    assert all(v.n_sources == 2 for v in votes)
    assert selection.appearances([df, df.limit(0)], 2, 3).count() == 0


def test_matching(spark):
    left = spark.createDataFrame([(1, "x" * 5 + "shared run of words" + "y"), (2, None), (3, "short")], "a int, s string")
    right = spark.createDataFrame([(9, "before shared run of words after"), (8, ""), (7, None)], "b int, t string")
    assert [tuple(r) for r in matching.shared_runs(left, right, "a", "s", "b", "t", 10).collect()] == [(1, 9, 10)]
    rows = [("o", "k", 1, list("abcd")), ("n", "k", 2, list("abcd")), ("x", "k", 3, list("abzz")), ("m", "j", 9, list("abcd"))]
    df = spark.createDataFrame(rows, "c string, k string, y int, w array<string>")
    assert [tuple(r) for r in matching.newer_versions(df, "c", "k", "y", "w", 0.75).collect()] == [("o", "n")]


def test_numbers_over_a_whole_table(spark):
    rows = [(random.Random(i).randint(0, 50), i) for i in range(500)]
    got = ranking.numbered(spark.createDataFrame(rows, "a int, b int"), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rank)] == sorted(rows) and sorted(r.rank for r in got) == list(range(1, 501))


def test_numbers_within_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 30), i) for i in range(400)]
    got = ranking.numbered_within(spark.createDataFrame(rows, "g string, v int, i int"), "g", "v", "i").collect()
    want = {}
    for g in {r[0] for r in rows}:
        listed = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        want |= {r[2]: (k, len(listed)) for k, r in enumerate(listed, 1)}
    assert {r.i: (r.place, r.n) for r in got} == want
    values = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("c", 2.0), *[("d", float(x)) for x in range(20)]], "g string, v double")
    assert {r.g: (r.n, r.p50, r.p95) for r in evaluate.summary(values, "g", "v").collect()} == {"a": (2, 2.0, None), "b": (1, None, None), "c": (1, 2.0, None), "d": (20, 9.5, 19.0)}


def test_window_negatives(spark):
    hits = spark.createDataFrame([(1, i, 1.0 - i / 1000, i + 1) for i in range(100)], "qid int, item_id int, score double, rank int")
    pos = spark.createDataFrame([(1, 30), (2, 5)], "qid int, pos int")
    got = mining.window_negatives(hits, pos, (11, 60), 100, 2, 60).collect()
    assert len(got) == 60 and not {r.rank for r in got} & set(range(29, 34)) and all(r.rank > 60 for r in got if r.pick > 45) and all(r.rank <= 60 for r in got if r.pick <= 45)


def test_stages_without_gold(spark):
    pred = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 1)], "qid int, key int, rank int")
    gold = spark.createDataFrame([(1, 2)], "qid int, key int")
    got = {r.stage: (r.p, r.r, r.n, r.n_lost) for r in evaluate.stages(pred, gold, [("a", 2), ("b", 1)], 0.3).collect()}
    assert got == {"a": (0.25, 1.0, 1, 1), "b": (0.0, 0.0, 1, 1)}


def test_lists_of_neighbours(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)] + [(1000 + i, [1.0] * 16) for i in range(40)] + [(2000, None), (None, [1.0] * 16), (2001, [0.0] * 16)]
    v = spark.createDataFrame(rows, "item_id bigint, vector array<float>")
    clean = v.where("item_id is not null and vector is not null")
    exact = {(r.qid, r.item_id) for r in ranking.knn(clean).collect()}
    near = {(r.qid, r.item_id) for r in sequential.knn_lists(v).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and sequential.knn_lists(v.limit(0)).count() == 0


def test_bm25_of_empty_tables(spark):
    q = spark.createDataFrame([(1, "từ"), (2, None), (3, "")], "qid int, text string")
    c = spark.createDataFrame([(1, "từ ngữ"), (2, None), (3, "")], "item_id int, text string")
    assert [(r.qid, r.item_id) for r in ranking.bm25_top(q, ranking.bm25_index(c), 5).collect()] == [(1, 1)]
    assert ranking.bm25_top(q, ranking.bm25_index(c.limit(0)), 5).count() == 0 and ranking.bm25_top(q.limit(0), ranking.bm25_index(c), 5).count() == 0


def test_kept_index_is_reused(spark, tmp_path):
    q = spark.createDataFrame([(1, "từ")], "qid int, text string")
    c = spark.createDataFrame([(1, "từ ngữ"), (2, "khác")], "item_id int, text string")
    first = ranking.bm25_top(q, ranking.bm25_index(c, path=str(tmp_path / "i")), 5).collect()
    assert ranking.bm25_top(q, ranking.bm25_index(c.limit(0), path=str(tmp_path / "i")), 5).collect() == first and first


def test_reader_of_files(spark, tmp_path):
    from corpusloom.sources import connectors

    (tmp_path / "a.md").write_text("# Đầu\n\nthân\n")
    (tmp_path / "b.txt").write_text("một\nhai")
    (tmp_path / "c.html").write_text("<p>x</p><p>y</p>")
    (tmp_path / "d.docx").write_bytes(connectors.docx_bytes(["đoạn <1>", "", "hai"]))
    (tmp_path / "e.docx").write_bytes(b"broken")
    rows = connectors.read_documents(connectors.read_binary_folder(spark, str(tmp_path))).collect()
    got = {name: [(r.kind, r.text) for r in sorted(rows, key=lambda r: r.pos) if r.path.endswith(name)] for name in ("a.md", "b.txt", "c.html", "d.docx", "e.docx")}
    assert got == {"a.md": [("head", "Đầu"), ("p", "thân")], "b.txt": [("p", "một"), ("p", "hai")], "c.html": [("p", "x"), ("p", "y")], "d.docx": [("p", "đoạn <1>"), ("p", ""), ("p", "hai")], "e.docx": []}
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    df.coalesce(1).write.json(str(tmp_path / "j"))
    connectors.zipped(spark, str(tmp_path / "j"), str(tmp_path / "j.zip"))
    import zipfile

    with zipfile.ZipFile(tmp_path / "j.zip") as z:
        assert len(z.namelist()) == 1 and b'"s":"a"' in z.read(z.namelist()[0])


def test_clause_cover_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(14)]
    rows, want = [], set()
    for q in range(40):
        clauses = [rng.sample(vocabulary, rng.randint(1, 4)) for _ in range(rng.randint(0, 4))]
        scores = sorted((round(rng.random(), 3) for _ in range(rng.randint(1, 10))), reverse=True)
        items = [(q, k, s, k + 1, clauses, rng.sample(vocabulary, rng.randint(0, 8))) for k, s in enumerate(scores)]
        rows += items
        cover = lambda it, c: len(set(it[5]) & set(c)) / len(c)
        done = [it for it in items if it[2] >= max(0.3, 0.9 * items[0][2]) or it[3] == 1][:3]
        for c in clauses:
            if len(done) >= 3 or any(cover(it, c) >= 0.7 for it in done):
                continue
            free = [it for it in items if it not in done and cover(it, c) >= 0.4]
            if free:
                done.append(max(free, key=lambda it: (round(cover(it, c), 6), it[2], -it[3])))
        want |= {it[:2] for it in done}
    df = spark.createDataFrame(rows, "qid int, item_id int, score double, rank int, cl array<array<string>>, ws array<string>")
    got = selection.covering(df, "cl", "ws", 0.9, 0.3, 3, 0.7, 0.4)
    assert {(r.qid, r.item_id) for r in got.collect()} == want and selection.covering(df.limit(0), "cl", "ws", 0.9, 0.3, 3, 0.7, 0.4).count() == 0
