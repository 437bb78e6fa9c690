"""Operators for training text on small fixtures: brute force, round trips and the awkward cases."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import canon, leakage, mojibake, neardup, normalize, packing, split

AT = dt.datetime(2041, 3, 1)
RECORD = "id bigint, law_name string, content string, ingested_at timestamp, at int, class int"


def records(spark, rows):
    return spark.createDataFrame([(i, n, c, AT, 1, 2) for i, n, c in rows], RECORD)


# p7
@pytest.mark.parametrize(
    ("shown", "plain"),
    [("Ｈồ sơ", "Hồ sơ"), ("a b​c", "a bc"), ("νận", "vận"), ("ðịnh", "định"), ("tiếng", "tiếng"), ("085/2039/НĐ-НĐХ", "085/2039/HĐ-HĐX")],
)
def test_consistent_form(shown, plain):
    assert normalize.consistent(shown) == plain


@pytest.mark.parametrize("text", [None, "", "m² ½ № Δ π «Бродуга»", "  doubled  blanks ", "Ωμέγα και слово"])
def test_content_is_left_alone(text):
    assert normalize.consistent(text) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aăếđĐ xеоνＡ１​́ \n./-Бд")))
def test_consistent_form_is_stable(text):
    once = normalize.consistent(text)
    assert normalize.consistent(once) == once


def test_scripts():
    assert normalize.judge("νận") == "mixed" and normalize.judge("сор") == "whole" and normalize.judge("vận") == "single"
    assert normalize.respell("сор", whole_script=True) == "cop" and normalize.respell("Бpодуга") == "Бродуга"


@pytest.mark.parametrize(("shown", "plain"), [("dօng", "dong"), ("ᎪN", "AN"), ("ⲢHÒNG", "PHÒNG"), ("ꓡUẬT", "LUẬT"), ("ℒuật", "Luật"), ("𝐋uật", "Luật"), ("հợp", "hợp")])
def test_scripts_of_every_kind(shown, plain):
    assert normalize.consistent(shown) == plain


@pytest.mark.parametrize("text", ["ᏣᎳᎩ", "Հայաստան", "ⲟⲩⲣⲁⲛⲟⲥ", "Ⓛ", "日本 и νόμος", "µ ª º"])
def test_whole_words_of_other_scripts_stay(text):
    assert normalize.consistent(text) == text


def test_look_alikes_against_public_data(spark):
    """The table agrees with the confusables data of the ICU library that comes with Spark."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    pairs = [(latin, c) for latin, alike in normalize.LOOK_ALIKES.items() for c in alike]
    agree = [normalize.script(c) != "LATIN" and checker.getSkeleton(latin) == checker.getSkeleton(c) for latin, c in pairs]
    assert {c for (_, c), ok in zip(pairs, agree, strict=True) if not ok} <= set("Ԛκχ")


def test_field_cases(spark):
    registry = spark.createDataFrame([("c1", "Luật A"), ("c2", None), (None, "Ｘ")], "doc_code string, canonical_title string")
    rows = [(1, "ðịnh", "vận"), (2, None, "νận"), (3, "", None), (1, "ðịnh", "vận"), (None, "Ｘ", "Ｘ")]
    got = {tuple(r) for r in normalize.field_cases(records(spark, rows), registry).collect()}
    assert got == {("legal_knowledge_records", "1", "law_name"), ("legal_knowledge_records", "2", "content"), ("legal_doc_registry", "c1", "canonical_title")}
    assert normalize.field_cases(records(spark, []), registry.limit(0)).count() == 0


# p1
@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 5000])
def test_pieces_keep_every_word(n):
    rng = random.Random(n)
    text = "".join(f"w{i}" + rng.choice([" ", " ", "; ", ". ", ".\n"]) for i in range(n))
    listed, cut = text.split(), split.pieces(text)
    assert all(p[2] <= 1024 and p[3].split() == listed[p[1] : p[1] + p[2]] for p in cut)
    assert len(cut) == (0 if not n else 1) if n <= 1024 else len(cut) > 1
    for a, b in zip(cut, cut[1:]):
        assert a[1] + a[2] - b[1] == 64


def test_pieces_cut_at_the_strongest_boundary():
    text = "a " * 480 + "b.\n" + "c " * 600 + "d. " + "e " * 100
    assert split.pieces(text)[0][3].endswith("b.")


def test_long_records(spark):
    rows = [(1, "", "w " * 1030), (2, "", "w " * 1024), (3, "", None), (4, "", ""), (1, "", "w " * 1030), (5, "", "x" * 9000)]
    got = split.long_record_pieces(records(spark, rows)).collect()
    assert {r.item_id for r in got} == {1} and len(got) == 2


# p2
ENTRIES = [("1/2030/LX", "Luật Bảo hiểm tháp chuông bãi giữa", ["Luật 1/2030/LX"]), ("2/2031/LX", "Luật Bảo tồn đường ray gỗ theo mùa", None), ("3/2032/NĐ-HĐX", "Nghị định Quy định xử phạt vi phạm đối với cối xay ven đảo", []), ("4/2033/NĐ-HĐX", "Nghị định Quy định xử phạt vi phạm đối với cối xay khu cổ", [None])]


@pytest.mark.parametrize(
    ("name", "code"),
    [
        ("Luat Bao hiem thap chuong bai giua (PDF)", "1/2030/LX"),
        ("Luật Bảo hiểm tháp chuôngg bãi giữa", "1/2030/LX"),
        ("tháp chuông bãi giữa - Luật Bảo hiểm", "1/2030/LX"),
        ("LUẬT BẢO TỒN ĐƯỜNG RAY GỖ THEO MÙA, 2031", "2/2031/LX"),
        ("Luaatj Baor toonf dduwowngf ray goox theo muaf", "2/2031/LX"),
        ("số 3 / 2032 / NĐ-HĐX", "3/2032/NĐ-HĐX"),
        ("Luật Quản lý kính thiên văn", ""),
        ("N/A", ""),
        ("x, " * 3000, ""),
    ],
)
def test_names_are_resolved(name, code):
    assert canon.Registry(ENTRIES).resolve(name)[0] == code


NUMBERED = [*ENTRIES, ("5/2036/KH", "Kế hoạch phát triển bến đò nội đồng 2036", None), ("5/2037/KH", "Kế hoạch phát triển bến đò nội đồng 2037", None), ("6/2034/NQ", "Nghị quyết 12 về thả diều trên đê sông", None), ("7/2035/QD", "Quyết định cấp vé", ["Quyết định 127/2035/QD"])]


@pytest.mark.parametrize(
    ("name", "code"),
    [
        ("Ke hoach phat trien ben do noi dong 2037", "5/2037/KH"),
        ("Kế hoạch phát triển bến đò nội đồngg 2036", "5/2036/KH"),
        ("Nghị quyết 12 về thả diềuu trên đê sông", "6/2034/NQ"),
        ("Luat Bao hiem thap chuong bai giua so 01/203/LX", "1/2030/LX"),
        ("Luật Bảo hiểm tháp chuôngg bãi giữa số 01/20300/LX", "1/2030/LX"),
        ("Quyết định 127/20355/QD", "7/2035/QD"),
        ("Kế hoạch phát triển bến đò nội đồng", ""),
        ("Quyết định 128/2035/QD", ""),
    ],
)
def test_numbers_in_names(name, code):
    assert canon.Registry(NUMBERED).resolve(name)[0] == code


def test_equal_names_are_no_case():
    trie = canon.Registry(ENTRIES)
    assert all(trie.resolve(n) is None for n in ("", "  ", "luật  BẢO hiểm tháp chuông bãi giữa ", "Luật 1/2030/LX"))
    assert canon.Registry([]).resolve("Luật Bảo hiểm") == ("", -1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_levenshtein():
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcde") for _ in range(rng.randint(16, 24))) for _ in range(30)]
    trie = canon.Registry([(str(i), t, None) for i, t in enumerate(plain)])
    for t in plain:
        key = "".join(c for c in t if rng.random() > 0.08) + "d"
        want = {n: d for n, u in enumerate(plain) if (d := distance(key, u)) <= 3}
        for edits in range(4):
            got = trie.within(key, edits, False, (1 << 30) - 1)
            assert {n for mask in got.values() for n in range(30) if mask >> n & 1} == {n for n, d in want.items() if d <= edits}
            counts, n = trie.shared(key)
            assert all(counts[i] >= n - 3 * d for i, d in want.items())


def test_nearest_entries_against_brute_force():
    """Titles with digits and shared openings: no entry within the distance is lost, whatever the trigrams."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd12") for _ in range(rng.randint(2, 6)))
    opening = "mo dau chung cua cac van ban"
    titles = [f"{opening} " * (i % 2) + " ".join(word() for _ in range(rng.randint(4, 9))) for i in range(60)]
    trie = canon.Registry([(str(i), t, None) for i, t in enumerate(titles)])
    plain = [t.replace(" ", "") for t in titles]
    for _ in range(150):
        key = list(rng.choice(plain))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(key))
            key[at : at + rng.randint(0, 1)] = rng.choice("abcd12") * rng.randint(0, 1)
        key = "".join(key)
        most = canon.max_edits(len(key))
        apart = [distance(key, u) for u in plain]
        low = min(apart)
        found = trie.nearest([(key, *trie.shared(key))], False, 0, 5, -1)
        if low <= most:
            assert found[1] <= low  # an alias path may be nearer
            counts, n = trie.shared(key)
            reached = trie.within(key, most, False, sum(1 << i for i in range(60) if counts[i] >= n - 3 * most))
            assert {i for mask in reached.values() for i in range(60) if mask >> i & 1} >= {i for i, d in enumerate(apart) if d <= most}


def test_notes_around_a_name():
    trie = canon.Registry(NUMBERED)
    note = " ghi chú của người nhập liệu" * 400
    assert trie.resolve("Luật Bảo hiểm tháp chuôg bãi giữa - " + note)[0] == "1/2030/LX"
    assert trie.resolve("Toàn văn Luật Bảo hiểm tháp chuông bãi giữa bản scan")[0] == "1/2030/LX"
    assert trie.resolve("Luật Bảo hiểm tháp chuông bãi giữa năm 2034")[0] == "1/2030/LX"
    assert trie.resolve("tháp chuông bãi giữa-- Luật Bảo hiểm")[0] == "1/2030/LX" and trie.resolve("tháp chuông bãi giữa, 2032, Luật Bảo hiểm")[0] == "1/2030/LX"
    assert trie.resolve("chuong bai giua so 1/2030/LX - Luat Bao hiem thap")[0] == "1/2030/LX"
    assert trie.resolve(note)[0] == "" and trie.resolve(", " * 50_000 + "x")[0] == ""


def test_mapped_records(spark):
    registry = spark.createDataFrame(ENTRIES, "doc_code string, canonical_title string, aliases array<string>")
    rows = [(1, "Luật Bảo hiểm tháp chuông bãi giua", ""), (2, None, ""), (3, " ", ""), (4, ENTRIES[0][1], ""), (5, "xem bản scan", "")]
    assert {(r.id, r.doc_code) for r in canon.mapped_records(records(spark, rows), registry).collect()} == {(1, "1/2030/LX"), (5, "")}


# p4
def test_similar_records_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"t{i}" for i in range(400)]
    rows = []
    for family in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(28, 120))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), "", " ".join(words)))
    rows += [(900, "", rows[0][2].upper()), (901, "", None), (902, "", ""), rows[3], (903, "", "short " * 29)]
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, _, t in rows if len(w := normalize.words(t)) >= 30}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {tuple(r) for r in neardup.similar_records(records(spark, rows)).collect()} == want and len(want) > 20
    assert neardup.similar_records(records(spark, [])).count() == 0
    of = {r.id: r.representative for r in neardup.representatives(records(spark, rows)).collect()}
    pairs = {(r.id_a, r.id_b) for r in neardup.similar_representatives(records(spark, rows)).collect()}
    assert set(of) == {i for i, _, _ in rows} and {x for p in pairs for x in p} <= set(of.values())
    assert pairs | {(x, x) for x in of.values()} >= {tuple(sorted((of[a], of[b]))) for a, b in want} >= pairs


def test_similar_groups_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(100)]
        for step in range(rng.randint(1, 9)):  # a chain: its ends are not similar to each other
            words = words[8:] + [f"f{family}s{step}x{i}" for i in range(8)]
            rows.append((rng.randrange(10**6), "", " ".join(words)))
    rows += [(5, "", rows[3][2].upper()), (6, "", None), (7, "", ""), (8, "", "short " * 29), rows[4], (None, "", rows[0][2])]
    # a later delivery of record 21 is between 20 and 22: no link
    late = [[f"l{i}" for i in range(low, low + 100)] for low in (0, 14, 28)]
    rows += [(20, "", " ".join(late[0])), (21, "", "other " * 40), (22, "", " ".join(late[2]))]
    df = records(spark, rows).unionByName(records(spark, [(21, "", " ".join(late[1]))]).withColumn("ingested_at", F.lit(AT + dt.timedelta(days=1))))
    texts = {i: t for i, _, t in rows if i is not None}
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, t in texts.items() if len(w := normalize.words(t)) >= 30}
    want = {i: i for i in texts}
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {i: low if g == high else g for i, g in want.items()}
    got = [tuple(r) for r in neardup.similar_groups(df).collect()]
    assert len(got) == len(want) and dict(got) == want and len(set(want.values())) < 25
    assert neardup.similar_groups(records(spark, [])).count() == 0


def test_components_of_chains(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 100 != 99] + [(7, 7)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: m for k in (0, 100, 200) for x in order[k : k + 100] if x != (m := min(order[k : k + 100]))}


def test_hot_table_entries_stream_in_runs():
    rng = np.random.default_rng(1)
    entry = np.sort(rng.integers(0, 40, 3000))
    key = rng.integers(0, 900, 3000)
    order = np.lexsort((key, entry))
    entry, key = entry[order], key[order]
    runs, pairs, hot = neardup._Runs(), set(), set()
    for low in range(0, 3000, 170):
        parts = runs.feed(entry[low : low + 170], key[low : low + 170])
        parts += runs.feed(np.empty(0, np.int64), np.empty(0, np.int64), last=True) if low + 170 >= 3000 else []
        for x, y, is_hot in parts:
            (hot if is_hot else pairs).update(zip(x.tolist(), y.tolist(), strict=True))
    near = lambda a, b: (a ^ b).bit_count() <= neardup.MOST_BITS
    groups = {e: sorted(set(key[entry == e].tolist())) for e in set(entry.tolist())}
    assert hot == {(e, k) for e, ks in groups.items() if len(ks) > neardup.HOT for k in ks}
    assert pairs == {(a, b) for ks in groups.values() if len(ks) <= neardup.HOT for a in ks for b in ks if a < b and near(a, b)}


# p8
def test_packing(spark):
    rng = random.Random(2)
    sizes = [0, 4096, 4097, 9000] + [rng.randint(1, 1500) for _ in range(900)]
    counts = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    rows = packing.packed(packing.items_of(counts), shard_items=200).collect()
    load, got = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        got.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    assert max(load.values()) <= 4096 and len(load) <= -(-sum(sizes) // 4096) + 2
    for doc, size in enumerate(sizes):
        parts = sorted(got[doc])
        assert sum(n for _, n in parts) == size and len(parts) == max(1, -(-size // 4096))
    assert packing.packed(packing.items_of(counts.limit(0))).count() == 0


def hard_sizes(rng, bins, capacity=1000):
    """Three items to a bin that fill it exactly: best fit in order of size wastes many bins."""
    out = []
    for _ in range(bins):
        a = rng.randint(380, 490)
        b = rng.randint(250, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_lower_bound():
    rng = random.Random(1)
    assert packing.lower_bound([], 10) == 0 and packing.lower_bound([6, 6, 6], 10) == 3 and packing.lower_bound([5, 5, 6, 4], 10) == 2
    for _ in range(50):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(1, 9))]
        best, stack = 99, [((), 0)]
        while stack:
            rooms, i = stack.pop()
            if len(rooms) >= best:
                continue
            if i == len(sizes):
                best = len(rooms)
                continue
            stack += [(rooms[:n] + (r - sizes[i],) + rooms[n + 1 :], i + 1) for n, r in enumerate(rooms) if r >= sizes[i]] + [((*rooms, 10 - sizes[i]), i + 1)]
        assert packing.lower_bound(sizes, 10) <= best


def test_evolution_beats_best_fit():
    rng = random.Random(6)
    for bins in (40, 100):
        sizes = hard_sizes(rng, bins)
        plain = len(packing.best_fit([], list(range(len(sizes))), sizes, 1000))
        best = packing.evolve(sizes, 1000, [], 80, 8, 1)
        assert sorted(i for b in best for i in b) == list(range(len(sizes))) and max(sum(sizes[i] for i in b) for b in best) <= 1000
        assert len(best) - bins <= (plain - bins) / 2 and plain > bins


def test_evolution_reaches_the_bound():
    for low, high, gain in ((900, 1700, 40), (1000, 2500, 3), (1200, 1800, 35)):
        rng = random.Random(1)
        sizes = [rng.randint(low, high) for _ in range(2000)]
        plain = len(packing.best_fit([], list(range(2000)), sizes, 4096))
        best = packing.evolve(sizes, 4096, [], 80, 8, 1)
        assert sorted(i for b in best for i in b) == list(range(2000)) and max(sum(sizes[i] for i in b) for b in best) <= 4096
        assert packing.lower_bound(sizes, 4096) <= len(best) <= plain - gain


def test_islands_beat_best_fit(spark):
    sizes = hard_sizes(random.Random(7), 120)
    counts = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    plain = len(packing.best_fit([], list(range(len(sizes))), sizes, 1000))
    rows = packing.packed(packing.items_of(counts, 1000), 1000, shard_items=180).collect()
    assert {r.doc_id for r in rows} == set(range(len(sizes))) and len({r.container for r in rows}) < plain


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 60, 80)]
    a, b = packing.best_fit([], list(range(80)), sizes, 100), packing.best_fit([[79], [78]], list(range(78)), sizes, 100)
    child = packing.mutate(packing.crossover(a, b, sizes, 100, rng), sizes, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(80)) and all(sum(sizes[i] for i in x) <= 100 for x in child)


# p9
def test_leaks(spark):
    passage = "Người giữ kho phải đối chiếu sổ chuyến với biểu phí mỗi vụ gặt mới"
    items = spark.createDataFrame([(1, passage, "ngắn"), (2, None, "  "), (3, "x", passage + " và thêm")], "id bigint, question string, answer string")
    docs = [(1, "đầu " + passage.upper().replace(" ", ",\n- ") + " cuối"), (2, " ".join(passage.split()[:11]) + " khác"), (3, None), (4, ""), (5, "Nguoi giu kho phai doi chieu so chuyen voi bieu phi moi")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in leakage.leaks(documents, items).collect()} == {(1, 1), (1, 3), (5, 1), (5, 3)}
    cleaned = leakage.without_leaks(documents, items).where("doc_id = 1").first()
    assert "SỔ" not in cleaned.text and cleaned.text.startswith("đầu") and cleaned.text.endswith("cuối")
    assert leakage.leaks(documents, items.limit(0)).count() == 0


def test_leaks_are_cut_at_their_places(spark):
    """Letters that grow in lower case, and wide and composed ones, before, inside and after a passage."""
    passage = "Người giữ kho phải đối chiếu sổ chuyến với biểu phí mỗi vụ gặt mới"
    items = spark.createDataFrame([(1, passage, None)], "id bigint, question string, answer string")
    docs = [(1, "İİ đầu İ " + passage + " İ cuối"), (2, passage), (3, "Ｋhúc ｍở. " + passage + "! Đoạn kết " + passage.upper() + ".")]
    got = {r.doc_id: (r.n_spans, r.n_cut, r.text) for r in leakage.without_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    n = len(passage)
    assert got == {1: (1, n, "İİ đầu İ  İ cuối"), 2: (1, n, ""), 3: (2, 2 * n, "Khúc mở. ! Đoạn kết .")}


# p10
CLEAN = "Người trông coi vách yến có trách nhiệm đối chiếu giấy vào bến đã hết hạn trước ngày ba mươi tháng sáu."


@pytest.mark.parametrize("chain", ["cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp1252+cp1252", "cp1253", "cp1256", "cp1258", "windows-1258", "vni"])
def test_garbling_is_undone(chain):
    assert mojibake.Repair([chain]).undo(mojibake.garble(CLEAN, chain))[0] == CLEAN


@pytest.mark.parametrize("chain", ["gbk", "shift_jis", "big5", "cp1253", "cp1256", "cp1252", "cp1252+cp1252", "cp1258", "windows-1258"])
def test_transformations_are_inferred(spark, chain):
    """From one garbled document and clean ones with its words; restored are the words whose bytes all survive."""
    garbled = mojibake.garble(CLEAN, chain)
    documents = spark.createDataFrame([*((i, CLEAN + f" Số {i}.") for i in range(3)), (9, garbled), (10, "Chữ 漢字 đúng chỗ"), (11, None)], "doc_id bigint, text string")
    assert chain in mojibake.learned(documents)[0]
    got = {r.doc_id: r.text for r in mojibake.restored(documents).collect()}
    assert set(got) == {9}
    pairs = list(zip(CLEAN.split(" "), got[9].split(" "), garbled.split(" "), strict=True))
    kept = [(c, r) for c, r, g in pairs if "�" not in g]
    assert all(c == r for c, r in kept) and len(kept) > len(pairs) / 3


def test_runs_without_an_encoding_are_learned(spark):
    """A font's own signs: each run stands for what nearly all of its words agree on."""
    own = {"ề": "ʬ", "ị": "ʭʮ", "ờ": "ʯ"}
    clean = ["bền", "lề mề", "tiền kền rền", "nghị bịt trịnh", "thị vịt mịt", "người mười rười cười lười tời"]
    odd = "".join(own.get(c, c) for c in " ".join(clean))
    documents = spark.createDataFrame([(1, " ".join(clean)), (2, " ".join(clean).replace("ờ", "ở")), (3, odd)], "doc_id bigint, text string")
    assert mojibake.learned(documents)[1].get("ʭʮ") == "ị"
    assert "nghị" in mojibake.restored(documents).where("doc_id = 3").first().text


def test_garbled_documents(spark):
    rows = [(i, CLEAN + f" Số {i}.") for i in range(5)] + [(10, mojibake.garble(CLEAN, "cp1252")), (11, "Xem: " + mojibake.garble(CLEAN, "vni")), (12, "mất � dấu"), (13, "naïve, Übung, façade, 5 m², ½ «Бродуга» “§ 5” – …"), (14, None), (15, ""), (16, "council’s fee")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in mojibake.restored(documents).collect()}
    assert set(got) == {10, 11, 12} and got[10] == CLEAN and got[11] == "Xem: " + CLEAN
    assert mojibake.restored(documents.limit(0)).count() == 0
