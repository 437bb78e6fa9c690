"""Evaluation texts leaking into training text (problem 9).

The words of all test items (case and accents ignored, đ = d) are cut into 12-grams and hashed; the set of hashes
is broadcast and every document's windows are looked up in it. A hit is verified word by word and grown to the
whole shared run. The test set is taken in blocks of a bounded number of n-grams, so what is broadcast never grows
beyond ``BLOCK_GRAMS`` whatever the test set holds; each block is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.normalize import WORD, consistent, fold

GRAM = 12
BLOCK_GRAMS = 2_000_000
SPANS = "doc_id bigint, item_id bigint, field string, first_word int, n_words int, start int, end int"


class _Folded(dict):
    """Folded words, kept up to a bound."""

    def __missing__(self, word: str) -> tuple[str, int]:
        if len(self) > 300_000:
            self.clear()
        plain = fold(word.lower())
        made = self[word] = (plain, xxhash.xxh64_intdigest(plain))
        return made


_FOLDED = _Folded()


def folded_words(text: str | None) -> list[str]:
    """The words as compared: consistent form, lower case, no accents, đ = d."""
    return [_FOLDED[w][0] for w in WORD.findall(consistent(text))] if text else []


def gram_hashes(word_hashes: np.ndarray) -> np.ndarray:
    """64-bit hash of each window of ``GRAM`` words."""
    n = len(word_hashes) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + n]
    return out


def item_fields(items: DataFrame) -> DataFrame:
    """(item_id, field, text) of questions and answers; null and blank ones have no passage."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("question", "answer")])
    return items.where("id is not null").select(F.col("id").alias("item_id"), F.explode(fields).alias("f")).select("item_id", "f.*").where("trim(text) <> ''")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str, list[str]]]]:
    """The test texts, streamed from the cluster partition by partition, in blocks of at most ``BLOCK_GRAMS`` n-grams."""
    block, size = [], 0
    for row in item_fields(items).distinct().toLocalIterator():
        listed = folded_words(row.text)
        if len(listed) < GRAM:
            continue
        if block and size + len(listed) > BLOCK_GRAMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.field, listed))
        size += len(listed)
    if block:
        yield block


def _scan(documents: DataFrame, block: list[tuple[int, str, list[str]]]) -> DataFrame:
    hashes, places = [], []
    for t, (_, _, listed) in enumerate(block):
        h = gram_hashes(np.array([xxhash.xxh64_intdigest(w) for w in listed], np.uint64))
        hashes.append(h)
        places += [(t, k) for k in range(len(h))]
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    shared = documents.sparkSession.sparkContext.broadcast((block, flat[order], np.array(places, np.int32)[order]))

    def spans_of(text: str, grams: np.ndarray, found: np.ndarray) -> list[tuple]:
        texts, table, where = shared.value
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        listed = [_FOLDED[text[a:b]][0] for a, b in spans]
        runs: dict[tuple[int, int], list[int]] = {}
        for at in found.tolist():
            low, high = np.searchsorted(table, grams[at], "left"), np.searchsorted(table, grams[at], "right")
            for t, k in where[low:high].tolist():
                if listed[at : at + GRAM] == texts[t][2][k : k + GRAM]:
                    runs.setdefault((t, at - k), []).append(at)
        out = []
        for (t, _), starts in runs.items():
            first = prev = starts[0]
            for at in [*starts[1:], None]:
                if at is not None and at == prev + 1:
                    prev = at
                    continue
                last = prev + GRAM - 1
                out.append((texts[t][0], texts[t][1], first, last - first + 1, spans[first][0], spans[last][1]))
                first = prev = at
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[1]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = consistent(text) if text else ""
                listed = WORD.findall(text)
                if len(listed) < GRAM:
                    continue
                grams = gram_hashes(np.fromiter((_FOLDED[w][1] for w in listed), np.uint64, len(listed)))
                at = np.searchsorted(table, grams)
                at[at == len(table)] = 0
                found = np.flatnonzero(table[at] == grams)
                if len(found):
                    rows += [(doc, *s) for s in spans_of(text, grams, found)]
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                names = ["doc_id", "item_id", "field", "first_word", "n_words", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, SPANS)


def leaked_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every run of at least 12 words a document shares with a question or answer.

    ``start`` and ``end`` are places in the consistent form. Empty tables, null and short texts give
    no rows. A document that repeats a passage has a row per place.
    """
    out = None
    for block in _blocks(items):
        part = _scan(documents, block)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], SPANS) if out is None else out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): which items each document leaks."""
    return leaked_spans(documents, items).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_spans, n_cut, text): the leaking documents with the shared runs, ``n_cut`` characters, cut out of the consistent form."""
    spans = leaked_spans(documents, items).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("text string, n_cut long")
    def cut(texts, spans):
        import pandas as pd

        def one(text, parts):
            text, out, at = consistent(text), [], 0
            for part in parts:
                out.append(text[at : max(at, part["start"])])
                at = max(at, part["end"])
            left = "".join([*out, text[at:]])
            return left, len(text) - len(left)

        return pd.DataFrame([one(t, s) for t, s in zip(texts, spans, strict=True)], columns=["text", "n_cut"])

    joined = documents.select("doc_id", F.col("text").alias("raw")).join(spans, "doc_id")
    return joined.select("doc_id", F.size("spans").alias("n_spans"), cut("raw", "spans").alias("c")).select("doc_id", "n_spans", "c.n_cut", "c.text")
