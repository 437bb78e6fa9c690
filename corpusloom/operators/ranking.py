"""Lexical and dense retrieval, fusion and merging over ranked lists: ranked(qid, item_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.functions.text import tokens
from corpusloom.session import written
from corpusloom.sources.connectors import folder_exists


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``rank`` from 1 within each qid, by the score descending, then ``order``, then the item."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *order, F.asc("item_id"))
    return df.withColumn("rank", F.row_number().over(w))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``rank`` from 1 over the whole table in an order, without one task for all: range parts, their sizes, places within."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", (place + F.col("_start")).cast("int")).drop("_part", "_start")


def numbered_within(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``place`` from 1 and ``n`` within each group, in an order that is total, however large a group is.

    The whole table is numbered by ranges, and each group's first number is taken off; no task holds a group.
    """
    placed = numbered(df, group, *order)
    sizes = placed.groupBy(group).agg(F.min("rank").alias("_s"), F.count("*").alias("n")).withColumnRenamed(group, "_g")
    joined = placed.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("place", F.col("rank") - F.col("_s") + 1).drop("rank", "_s", "_g")


def top_k(df: DataFrame, k: int) -> DataFrame:
    return ranked(df).where(F.col("rank") <= k)


def bm25(queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, plus: bool = True, tokenize=tokens) -> DataFrame:
    """(qid, item_id, score): BM25 with idf = ln(1 + (N - df + .5) / (df + .5)); a repeated query term adds up.

    ``plus`` keeps the numerator's (k1 + 1). All questions are answered in one plan: corpus terms are cut down to
    the query terms before they are counted, document frequencies and lengths cover the whole corpus.
    """
    asked = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    listed = corpus.select("item_id", tokenize(F.col("text")).alias("terms"))
    stats = listed.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    wanted = asked.select("term").distinct()
    postings = (
        listed.select("item_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy("item_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(frequency, "term").crossJoin(F.broadcast(stats)).select("qid", "term", (F.col("qtf") * idf * ((k1 + 1) if plus else 1)).alias("w"), "avgdl")
    part = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(weighted, "term").groupBy("qid", "item_id").agg(F.round(F.sum(part), 6).alias("score"))


#: Questions scored in one pass; more are taken in further passes, so what is broadcast is bounded.
QUERY_BLOCK = 2048


class Bm25Index(NamedTuple):
    """A kept index: (item_id, terms) per item and (term, df) per term, both written, and the corpus statistics."""

    items: DataFrame
    frequency: DataFrame
    n: int
    avgdl: float
    tokenize: Callable[[Column], Column]


def bm25_index(corpus: DataFrame, tokenize=tokens, path: str | None = None) -> Bm25Index:
    """Tokenize the corpus (item_id, text) once and count its terms; kept under ``path`` and reused if it is there already.

    Other columns of the corpus are kept for filters. Null and empty texts have no terms, but count as items.
    """
    spark = corpus.sparkSession
    listed = corpus.select(*[c for c in corpus.columns if c != "text"], tokenize(F.col("text")).alias("terms"))
    count = lambda items: items.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if path is None:
        items = written(listed, "items")
        frequency = written(count(items), "frequency")
    else:
        if not folder_exists(spark, f"{path}/frequency/_SUCCESS"):
            listed.write.mode("overwrite").parquet(f"{path}/items")
            count(spark.read.parquet(f"{path}/items")).write.mode("overwrite").parquet(f"{path}/frequency")
        items, frequency = spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/frequency")
    n, avgdl = items.agg(F.count("*"), F.avg(F.size("terms"))).first()
    return Bm25Index(items, frequency, n, avgdl or 0.0, tokenize)


def probable_idf(index: Bm25Index, df: Column) -> Column:
    """ln(1 + (N - df + .5) / (df + .5)), never negative."""
    return F.log(1 + (index.n - df + 0.5) / (df + 0.5))


def okapi_idf(epsilon: float = 0.25):
    """ln((N - df + .5) / (df + .5)); terms of more than half the corpus count ``epsilon`` times the mean of all terms."""

    def idf(index: Bm25Index, df: Column) -> Column:
        plain = lambda c: F.log(index.n - c + 0.5) - F.log(c + 0.5)
        mean = index.frequency.agg(F.avg(plain(F.col("df")))).first()[0] or 0.0
        return F.when(plain(df) < 0, F.lit(epsilon * mean)).otherwise(plain(df))

    return idf


def bm25_top(queries: DataFrame, index: Bm25Index, k: int, k1: float = 1.5, b: float = 0.75, plus: bool = True, idf=probable_idf, where: Column | None = None) -> DataFrame:
    """The k best items of each question, ranked; the scores are those of ``bm25``. Only scores above 0 count.

    The questions are taken in blocks of bounded size against all items: a block's term weights are one matrix, a
    batch of items is multiplied with it, and only the best of each question leave the batch. So a word that half
    the corpus holds costs a multiplication, not a row per question and item. ``where`` filters the items that may be
    found; frequencies and lengths stay those of the whole corpus.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.select("qid", F.explode(index.tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("qtf"))
    weights = asked.join(index.frequency, "term").select("qid", "term", (F.col("qtf") * idf(index, F.col("df")) * ((k1 + 1) if plus else 1)).alias("w"))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if n_blocks > 1:
        weights = written(weights, "weights")
    id_type, qid_type = index.items.schema["item_id"].dataType, to_arrow_type(queries.schema["qid"].dataType)
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("item_id", id_type), T.StructField("score", T.DoubleType())])
    items = (index.items if where is None else index.items.where(where)).where(F.size("terms") > 0).select("item_id", "terms")
    avgdl, out = index.avgdl, None
    for block in range(n_blocks):
        rows = weights.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == block).collect()
        qids = sorted({r.qid for r in rows})
        place, terms = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        matrix = np.zeros((len(terms), len(qids)))
        for r in rows:
            matrix[terms[r.term], place[r.qid]] = r.w
        shared = queries.sparkSession.sparkContext.broadcast((qids, list(terms), matrix))

        def run(batches, shared=shared):
            qids, terms, matrix = shared.value
            if not qids:
                return
            known = pa.array(terms)
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    some = batch.slice(low, 512)
                    listed = some.column("terms")
                    at = pc.fill_null(pc.index_in(listed.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                    dl = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
                    item = np.repeat(np.arange(len(dl)), dl)[at >= 0]
                    part = np.bincount(item * len(terms) + at[at >= 0], minlength=len(dl) * len(terms)).reshape(len(dl), -1).astype(np.float64)
                    part /= part + (k1 * (1 - b + b * dl / avgdl))[:, None]
                    scores = np.round(part @ matrix, 6)
                    keep = min(k, len(scores))
                    least = np.maximum(np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep], 1e-6)
                    item, q = np.nonzero(scores >= least)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in q.tolist()], qid_type), some.column("item_id").take(pa.array(item)), pa.array(scores[item, q])], names=["qid", "item_id", "score"])

        found = items.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


def by_overlap(found: DataFrame, queries: DataFrame, index: Bm25Index) -> DataFrame:
    """A ranked list with equal scores in the order of the distinct words shared with the question; 1 / rank for scores of 0 or less."""
    asked = queries.select("qid", F.array_distinct(index.tokenize(F.col("text"))).alias("_asked"))
    held = index.items.select("item_id", "terms")
    shared = found.drop("rank").join(asked, "qid").join(held, "item_id").withColumn("overlap", F.size(F.array_intersect("_asked", "terms"))).drop("_asked", "terms")
    out = ranked(shared, F.desc("overlap"))
    return out.withColumn("score", F.when(F.col("score") <= 0, 1 / F.col("rank")).otherwise(F.col("score")))


def knn(vectors: DataFrame, every: int = 20, k: int = 10) -> DataFrame:
    """Exact cosine neighbours of the stated query set, rows whose id is divisible by ``every``, against all rows.

    The queries come in blocks of bounded size to every row; one matrix product per pair of blocks, and only the k
    best of each query leave a block.
    """
    import numpy as np
    import pyarrow as pa

    asked = vectors.where(F.col("item_id") % every == 0).select("item_id", "vector")
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.greatest(F.lit(1), F.ceil(F.lit(asked.count()) / 4096)))).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("item_id", "vector"))).alias("queries")
    )
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())])
    out = None
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    for row in blocks.toLocalIterator():
        ids = np.array([q.item_id for q in row.queries])
        matrix = unit(np.array([q.vector for q in row.queries], dtype=np.float64))
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            ids, matrix = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                items = batch.column("item_id").to_numpy()
                vals = batch.column("vector")
                order = np.argsort(items)
                mat = unit(vals.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(items), -1))[order]
                items = items[order]
                # whole millionths, equal ones in the order of their ids: the k best of the batch are exact
                scores = matrix @ mat.T
                scores[(ids[:, None] == items[None, :]) | np.isnan(scores)] = -2.0
                scores *= 1e6
                np.rint(scores, out=scores)
                keys = np.arange(len(items)) - scores * len(items)
                keep = min(k, len(items))
                best = np.argpartition(keys, keep - 1, axis=1)[:, :keep]
                q = np.repeat(ids, keep)
                s = np.take_along_axis(scores, best, 1).ravel() / 1e6 + 0.0
                ok = s > -1.5
                yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(items[best.ravel()][ok]), pa.array(s[ok])], names=["qid", "item_id", "score"])

        part = vectors.where("item_id is not null and vector is not null").select("item_id", "vector").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return top_k(out, k)


def rrf(lists: list[DataFrame], k: int = 60, base: int = 1, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank), ranks counted from ``base``."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("qid", "item_id", (F.lit(w) / (k + F.col("rank") - 1 + base)).alias("s")) for x, w in zip(lists, weights, strict=True)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return ranked(union.groupBy("qid", "item_id").agg(F.round(F.sum("s"), 8).alias("score")))


def minmax(df: DataFrame, column: str = "score") -> DataFrame:
    """Score scaled to 0..1 within each qid; a range of 0 divides by 1."""
    w = Window.partitionBy("qid")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(column, (F.col(column) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def fused_scores(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha * normalised a + (1 - alpha) * normalised b; an item missing in a list scores 0 there."""
    x, y = minmax(a).select("qid", "item_id", F.col("score").alias("x")), minmax(b).select("qid", "item_id", F.col("score").alias("y"))
    both = x.join(y, ["qid", "item_id"], "full")
    return ranked(both.select("qid", "item_id", F.round(alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0)), 6).alias("score")))


def best_of(lists: list[DataFrame]) -> DataFrame:
    """Per (qid, item) the best score of several lists."""
    union = lists[0].select("qid", "item_id", "score")
    for x in lists[1:]:
        union = union.unionByName(x.select("qid", "item_id", "score"))
    return ranked(union.groupBy("qid", "item_id").agg(F.max("score").alias("score")))


def rrf_lists(rows: DataFrame, lists: str, per_list: int, most: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of any number of lists, named by a column; a question with one list keeps its scores."""
    place = F.row_number().over(Window.partitionBy("qid", lists).orderBy(F.desc("score"), "item_id"))
    n = F.size(F.collect_set(lists).over(Window.partitionBy("qid")))
    parts = rows.withColumn("_k", place).withColumn("_n", n).where(F.col("_k") <= per_list)
    each = F.when(F.col("_n") == 1, F.col("score")).otherwise(1.0 / (k + F.col("_k")))
    return top_k(parts.groupBy("qid", "item_id").agg(F.round(F.sum(each), 8).alias("score")), most)


def swept(rows: DataFrame, alphas: list[float], thresholds: list[float]) -> DataFrame:
    """(mode_, alpha, thr, f2, place): scores a and b combined as weighted sum and product, kept from a threshold on.

    ``g`` marks gold rows. F2 is that of all kept rows; settings without a hit are left out.
    """
    grid = [(m, a, x) for m in ("weighted", "product") for a in alphas for x in thresholds]
    settings = F.array(*[F.struct(F.lit(m).alias("mode_"), F.lit(a).alias("alpha"), F.lit(x).alias("thr")) for m, a, x in grid])
    total = rows.agg(F.count_if("g").alias("total"))
    each = rows.withColumn("c", F.explode(settings)).select("a", "b", "g", "c.*")
    score = F.when(F.col("mode_") == "weighted", F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b")).otherwise(F.col("a") * F.col("b"))
    kept = each.where(F.round(score, 9) >= F.col("thr")).groupBy("mode_", "alpha", "thr").agg(F.count("*").alias("n"), F.count_if("g").alias("hit")).where("hit > 0")
    p, r = F.col("hit") / F.col("n"), F.col("hit") / F.col("total")
    scored = kept.crossJoin(F.broadcast(total)).select("mode_", "alpha", "thr", F.round(5 * p * r / (4 * p + r), 6).alias("f2"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f2"), "mode_", "alpha", "thr")))  # one row per setting
