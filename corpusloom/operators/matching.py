"""Joins by likeness: shared runs of characters, versions, nearest mentions, look-ups one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import char_ngrams, jaccard
from corpusloom.session import written


#: Runs of the smaller side that are looked for in one pass over the other.
BLOCK_RUNS = 2_000_000


def _run_hashes(text: str, width: int):
    """64-bit hash of each run of ``width`` characters."""
    import numpy as np

    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(signs) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + signs[k : k + n]
    return out.view(np.int64)


def shared_runs(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str, width: int) -> DataFrame:
    """(left_key, right_key, n_runs): pairs of texts that share runs of ``width`` characters, each distinct run counted once.

    The hashes of the left side's runs are broadcast in blocks of bounded size; the right side is scanned once per block
    and only its runs that are among them leave the scan, to meet the left ones by equality.
    """
    import numpy as np
    import pyarrow as pa

    def hashed(batches):
        for batch in batches:
            found = [np.unique(_run_hashes(t, width)) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["h"])

    a = left.where(F.length(left_text) >= width).select(left_key, F.col(left_text).alias("_t"))
    b = right.where(F.length(right_text) >= width).select(right_key, F.col(right_text).alias("_t"))
    hashes = written(a.select("_t").mapInArrow(hashed, "h bigint").distinct(), "runs")
    n_blocks, out = max(1, -(-hashes.count() // BLOCK_RUNS)), None
    schema = f"`{right_key}` {b.schema[right_key].dataType.simpleString()}, _run string"
    for block in range(n_blocks):
        wanted = np.sort(np.array([r.h for r in hashes.where(F.pmod("h", F.lit(n_blocks)) == block).collect()], np.int64))
        shared = left.sparkSession.sparkContext.broadcast(wanted)

        def scan(batches, shared=shared):
            table = shared.value
            for batch in batches:
                index, runs = [], []
                for i, text in enumerate(batch.column("_t").to_pylist()):
                    h = _run_hashes(text, width)
                    if not len(table) or not len(h):
                        continue
                    at = np.searchsorted(table, h)
                    at[at == len(table)] = 0
                    hits = {text[k : k + width] for k in np.flatnonzero(table[at] == h).tolist()}
                    index += [i] * len(hits)
                    runs += hits
                yield pa.RecordBatch.from_arrays([batch.column(right_key).take(pa.array(index, pa.int64())), pa.array(runs, pa.string())], names=[right_key, "_run"])

        part = b.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    runs = a.select(left_key, F.explode(F.array_distinct(char_ngrams(F.col("_t"), width))).alias("_run"))
    return runs.join(out, "_run").groupBy(left_key, right_key).agg(F.count("*").alias("n_runs"))


def newer_versions(rows: DataFrame, key: str, kind: str, year: str, words: str, least: float) -> DataFrame:
    """(key, newer): rows with a newer one of their kind whose word sets have Jaccard similarity ``least`` or more.

    Pairs are only formed between sets that share one of their first words in order of frequency, as similar ones must.
    """
    df = rows.select(kind, F.explode(words).alias("_w")).groupBy(kind, "_w").agg(F.count("*").alias("_df"))
    sorted_ = rows.select(key, kind, year, words, F.explode(words).alias("_w")).join(df, [kind, "_w"]).groupBy(key, kind, year, words).agg(F.array_sort(F.collect_list(F.struct("_df", "_w"))).alias("_s"))
    most = (F.size("_s") - F.ceil(F.size("_s") * least) + 1).cast("int")
    prefix = sorted_.select(key, kind, year, words, F.explode(F.slice("_s", F.lit(1), most)).alias("_p")).withColumn("_p", F.col("_p._w"))
    other = prefix.withColumnsRenamed({key: "newer", year: "_y", words: "_v"})
    pairs = prefix.join(other, [kind, "_p"]).where((F.col("_y") > F.col(year)) & (F.col(key) != F.col("newer")))
    return pairs.where(jaccard(F.col(words), F.col("_v")) >= least).select(key, "newer").distinct()


def nearest_in(places: str, at: Column) -> Column:
    """Of an array<struct<text, at>> the one nearest to a place, the first of equals."""
    far = F.transform(places, lambda p: F.struct(F.abs(p["at"] - at).alias("far"), p["at"].alias("at"), p["text"].alias("text")))
    return F.array_min(far)


def first_lookup(rows: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with ``x`` and ``step``: the first of several look-ups (key column -> table of key and ``x``) that hits."""
    out = rows
    for n, (key, table) in enumerate(steps.items(), 1):
        out = out.join(table.withColumnRenamed("x", f"_x{n}"), key, "left")
    hits = [F.col(f"_x{n}") for n in range(1, len(steps) + 1)]
    step = F.lit(len(steps) + 1)
    for n in range(len(steps), 0, -1):
        step = F.when(hits[n - 1].isNotNull(), n).otherwise(step)
    return out.select(*rows.columns, F.coalesce(*hits).alias("x"), step.cast("int").alias("step"))


def overlaps(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(Jaccard, share of the smaller set, share of the first set) two sets have in common."""
    both = F.size(F.array_intersect(a, b))
    return jaccard(a, b), both / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)), both / F.greatest(F.size(a), F.lit(1))
