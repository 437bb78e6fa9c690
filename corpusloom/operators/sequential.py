"""Rules that depend on order within one text or one question: folds inside the JVM, or one question at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import top_k


def gated_numbers(numbers: Column, gap: int = 3, first: int = 2) -> Column:
    """The header numbers, of an array in text order, that go on from the last accepted one by 1 to ``gap``.

    The first must be at most ``first``; null and empty arrays give an empty one.
    """

    def step(done: Column, n: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.when(last.isNull(), n <= first).otherwise((n > last) & (n <= last + gap))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(done, F.array(n))).otherwise(done)

    return F.aggregate(F.coalesce(numbers, F.array().cast("array<int>")), F.array().cast("array<int>"), step)


def gated_headers(labels: Column, gap: int = 3, first: int = 2) -> Column:
    """Of header labels ('12', '12a') in text order those that go on: by 1 to ``gap``, or the same number with a later letter."""
    kind = "array<struct<n:int,suffix:string>>"
    found = F.transform(labels, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("n"), F.regexp_extract(x, r"(\p{L}?)$", 1).alias("suffix")))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        goes_on = ((x["n"] == last["n"]) & (x["suffix"] > last["suffix"])) | ((x["n"] > last["n"]) & (x["n"] <= last["n"] + gap))
        return F.when(F.coalesce(F.when(last.isNull(), x["n"] <= first).otherwise(goes_on), F.lit(False)), F.concat(done, F.array(x))).otherwise(done)

    return F.aggregate(F.coalesce(found, F.array().cast(kind)), F.array().cast(kind), step)


def labelled_points(text: Column) -> Column:
    """The labels a), b), c) ... at line starts that come as the next expected one; empty with fewer than two."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([a-z])\)"), 1)

    def step(done: Column, x: Column) -> Column:
        return F.when(F.ascii(x) == F.lit(97) + F.length(done), F.concat(done, x)).otherwise(done)

    labels = F.aggregate(F.coalesce(found, F.array().cast("array<string>")), F.lit(""), step)
    return F.when(F.length(labels) >= 2, labels).otherwise("")


def joined_lines(text: Column) -> Column:
    """Lines broken inside a sentence put together again: a break before a lower-case letter is a blank."""
    return F.regexp_replace(text, r"(?<=[\p{L},])[ \t]*\n[ \t]*(?=\p{Ll}{2})", " ")


def greedy_evidence(df: DataFrame, group: str, evidence: str, multi: str, steps: list[tuple[float, float, float]], strong: float, candidates: int = 8) -> DataFrame:
    """Per question: the first item, then of the next ``candidates`` - 1, best score first, those with enough evidence.

    ``steps`` has for the second, third, ... place the least evidence of questions for one target and for several
    (``multi``), and the largest gap to the best score, which items of ``strong`` evidence may exceed. Questions for
    several targets take up to two items of a group and two groups, others one of one. The choice is a fold over a
    bounded array inside the JVM. A null evidence is none.
    """
    fields = [c for c in df.columns if c != "qid"]
    listed = df.where(F.col("rank") <= candidates).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct((F.col("rank") > 1).alias("_later"), (-F.col("score")).alias("_by"), F.col("rank").alias("_rank"), F.struct(*fields).alias("x")))).alias("c")
    )
    kind = df.select(F.array(F.struct(*fields)).alias("a")).schema["a"].dataType

    def add(done: Column, c: Column) -> Column:
        x, n = c["x"], F.size(done)
        many = F.coalesce(x[multi], F.lit(False))
        most = F.when(many, 2).otherwise(1)
        groups = F.array_distinct(F.transform(done, lambda y: y[group]))
        of_group = F.size(F.filter(done, lambda y: y[group].eqNullSafe(x[group])))
        place = F.lit(False)
        for at, (single, several, gap) in enumerate(steps, 1):
            close = (done[0]["score"] - x["score"] <= gap) | (x[evidence] >= strong)
            place = F.when(n == at, (x[evidence] >= F.when(many, several).otherwise(single)) & close).otherwise(place)
        fits = place & (of_group < most) & ((of_group > 0) | (F.size(groups) < most))
        return F.when((n == 0) | F.coalesce(fits, F.lit(False)), F.concat(done, F.array(x))).otherwise(done)

    chosen = listed.select("qid", F.explode(F.aggregate("c", F.array().cast(kind), add)).alias("x"))
    return chosen.select("qid", "x.*").select(*df.columns)


def knn_two_stage(vectors: DataFrame, every: int = 20, k: int = 10, prefetch: int = 10) -> DataFrame:
    """Neighbours by a first pass over vectors quantised to one byte, of which ``prefetch`` * k are scored exactly.

    Every row is searched; the queries are the rows whose id is divisible by ``every``.
    """
    from corpusloom.operators.ranking import knn

    scale = F.lit(127.0) / F.greatest(F.array_max(F.transform("vector", lambda x: F.abs(x))), F.lit(1e-12))
    small = vectors.select("item_id", F.transform("vector", lambda x: F.round(x * scale).cast("tinyint")).alias("vector"))
    near = knn(small, every, prefetch * k).select("qid", "item_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    unit = vectors.select("item_id", "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("norm"))
    asked = unit.where(F.col("item_id") % every == 0).withColumnsRenamed({"item_id": "qid", "vector": "qv", "norm": "qn"})
    scored = near.join(asked, "qid").join(unit, "item_id").select("qid", "item_id", F.round(dot(F.col("qv"), F.col("vector")) / F.greatest(F.col("qn") * F.col("norm"), F.lit(1e-30)), 6).alias("score"))
    return top_k(scored, k)


#: Rows the lists are fitted on, by hash order; every row is indexed.
FIT_ROWS = 20_000


def knn_lists(vectors: DataFrame, every: int = 20, k: int = 10, lists: int = 16, probes: int = 12, rounds: int = 8) -> DataFrame:
    """Approximate cosine neighbours: every row belongs to the list of its nearest centre, a query only meets ``probes`` lists.

    The centres are fitted on ``FIT_ROWS`` rows. The rows are scanned once per block of queries and never shuffled; of a
    batch only the rows of a query's lists are scored. The defaults find more than nine in ten exact neighbours even where
    vectors fall into no groups; where they do, fewer probes are enough.
    """
    import numpy as np
    import pyarrow as pa

    from corpusloom.operators.ranking import top_k

    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    there = vectors.where("item_id is not null and vector is not null")
    sample = there.orderBy(F.xxhash64("item_id"), "item_id").limit(FIT_ROWS).select("vector").collect()
    schema = "qid bigint, item_id bigint, score double"
    if not sample:
        return top_k(vectors.sparkSession.createDataFrame([], schema), k)
    data = unit(np.array([r.vector for r in sample], dtype=np.float64))
    centres = data[np.linspace(0, len(data) - 1, min(lists, len(data))).astype(int)]
    for _ in range(rounds):
        of = np.argmax(data @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, data)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], unit(sums), centres)
    asked, out = there.where(F.col("item_id") % every == 0).select("item_id", "vector"), None
    n_blocks = max(1, -(-asked.count() // 4096))
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        if not rows:
            continue
        ids, matrix = np.array([r.item_id for r in rows]), unit(np.array([r.vector for r in rows], dtype=np.float64))
        near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
        meets = np.zeros((len(rows), len(centres)), bool)
        np.put_along_axis(meets, near, True, axis=1)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, centres, meets))

        def run(batches, shared=shared):
            ids, matrix, centres, meets = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                items = batch.column("item_id").to_numpy()
                rows = unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(items), -1))
                of = np.argmax(rows @ centres.T, axis=1)
                for one in np.unique(of):
                    q, r = np.flatnonzero(meets[:, one]), np.flatnonzero(of == one)
                    if not len(q):
                        continue
                    r = r[np.argsort(items[r])]
                    scores = np.rint(matrix[q] @ rows[r].T * 1e6)
                    scores[ids[q][:, None] == items[r][None, :]] = -2e6
                    keys = np.arange(len(r)) - scores * len(r)  # equal scores in the order of their ids
                    keep = min(k, len(r))
                    best = np.argpartition(keys, keep - 1, axis=1)[:, :keep]
                    s = np.take_along_axis(scores, best, 1).ravel() / 1e6 + 0.0
                    ok = s > -1.5
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q], keep)[ok]), pa.array(items[r][best.ravel()][ok]), pa.array(s[ok])], names=["qid", "item_id", "score"])

        part = there.select("item_id", "vector").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return top_k(vectors.sparkSession.createDataFrame([], schema) if out is None else out, k)
