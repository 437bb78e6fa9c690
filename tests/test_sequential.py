"""Order-dependent rules against plain Python, and the two-stage neighbours against exact ones."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import ranking, sequential


def test_gated_numbers(spark):
    rng = random.Random(1)
    given = [[rng.randint(1, 12) for _ in range(rng.randint(0, 12))] for _ in range(60)] + [None, []]

    def plain(numbers):
        done = []
        for n in numbers or []:
            if (not done and n <= 2) or (done and done[-1] < n <= done[-1] + 3):
                done.append(n)
        return done

    df = spark.createDataFrame(list(enumerate(given)), "i int, n array<int>")
    got = [r.v for r in df.select("i", sequential.gated_numbers(F.col("n")).alias("v")).orderBy("i").collect()]
    assert got == [plain(n) for n in given]


def test_labels_and_lines(spark):
    texts = ["a) x\nb) y\nd) z\nc) w", "b) x\na) y", "only a) here\n", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", sequential.labelled_points(F.col("t")).alias("v"), sequential.joined_lines(F.lit("broken\nline. Kept\nLine")).alias("j")).orderBy("i").collect()
    assert [r.v for r in rows] == ["abc", "", "", "", ""] and rows[0].j == "broken line. Kept\nLine"


def picked(rows, steps, strong):
    """Brute force of the rule: one item after another."""
    out = set()
    for q in {r[0] for r in rows}:
        listed = sorted((r for r in rows if r[0] == q), key=lambda r: r[2])[:8]
        listed = listed[:1] + sorted(listed[1:], key=lambda r: (-r[3], r[2]))
        chosen = []
        for r in listed:
            if not chosen:
                chosen.append(r)
                continue
            if len(chosen) > len(steps):
                break
            single, several, gap = steps[len(chosen) - 1]
            most = 2 if r[6] else 1
            if sum(x[4] == r[4] for x in chosen) >= most or (r[4] not in {x[4] for x in chosen} and len({x[4] for x in chosen}) >= most):
                continue
            if r[5] is not None and r[5] >= (several if r[6] else single) and (chosen[0][3] - r[3] <= gap or r[5] >= strong):
                chosen.append(r)
        out |= {r[:2] for r in chosen}
    return out


def test_greedy_evidence(spark):
    rng = random.Random(5)
    steps = [(0.40, 0.34, 0.11), (0.80, 0.54, 0.06), (1.00, 1.00, 0.06)]
    rows = []
    for q in range(60):
        scores = sorted((rng.choice([0.9, 0.85, rng.random()]) for _ in range(rng.randint(1, 12))), reverse=True)
        several = rng.choice([True, True, False, None])
        rows += [(q, 100 * q + k, k + 1, x, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, 0.35, 0.6, 0.9, 1.0]), several) for k, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "qid int, item_id int, rank int, score double, g string, e double, m boolean")
    got = sequential.greedy_evidence(df, "g", "e", "m", steps, 0.62)
    assert {(r.qid, r.item_id) for r in got.collect()} == picked(rows, steps, 0.62) and got.columns == df.columns
    assert sequential.greedy_evidence(df.limit(0), "g", "e", "m", steps, 0.62).count() == 0


def test_two_stage_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)] + [(1000, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "item_id bigint, vector array<float>")
    exact = {(r.qid, r.item_id) for r in ranking.knn(vectors).collect()}
    found = {(r.qid, r.item_id) for r in sequential.knn_two_stage(vectors).collect()}
    assert len(exact & found) / len(exact) >= 0.95


def test_equal_neighbours_by_id(spark):
    """Many identical vectors, in an order unlike that of their ids: the smallest ids win, at any batch size."""
    rng = random.Random(8)
    ids = rng.sample(range(1, 5000), 300)
    rows = [(i, [1.0, 2.0, 3.0] if n % 3 else [rng.gauss(0, 1) for _ in range(3)]) for n, i in enumerate(ids)] + [(0, [1.0, 2.0, 3.0])]
    copies = sorted(i for i, v in rows if v == [1.0, 2.0, 3.0])
    vectors = spark.createDataFrame(rows, "item_id bigint, vector array<float>").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (size, "64"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for found in (ranking.knn(vectors), sequential.knn_two_stage(vectors)):
                got = [r.item_id for r in found.where("qid = 0").orderBy("rank").collect()]
                assert got == copies[1:11]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
