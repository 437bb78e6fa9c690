"""Splitting oversized items at natural boundaries (problem 1).

An item is a run of words (pieces between white space of its consistent form). While a stretch exceeds the
limit minus the overlap it is cut in two at the strongest boundary near its midpoint: paragraph before sentence
before clause before a plain blank. Then every piece but the first is given the last words of the piece before
it. Every word keeps its place; pieces never exceed the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.normalize import consistent
from corpusloom.operators.nested import occurrences, written_objects
from corpusloom.sources.tables import delivery_order

LIMIT, OVERLAP = 1024, 64
_WORD = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…][\"')\]»”’]*$")
_CLAUSE_END = re.compile(r"[;:][\"')\]»”’]*$")
_ITEM_START = re.compile(r"(?:\d{1,3}|\w)[.)]$")
PARAGRAPH, SENTENCE, CLAUSE, BLANK = 3, 2, 1, 0


def boundary(text: str, spans: list[tuple[int, int]], k: int) -> int:
    """Strength of the boundary before word ``k``: a line break, a sentence end, a clause end or a plain blank."""
    if "\n" in text[spans[k - 1][1] : spans[k][0]]:
        return PARAGRAPH
    word = text[spans[k - 1][0] : spans[k - 1][1]]
    if _SENTENCE_END.search(word) and not _ITEM_START.match(word):
        return SENTENCE
    return CLAUSE if _CLAUSE_END.search(word) else BLANK


def cut_points(strength: list[int], n: int, limit: int, overlap: int) -> list[int]:
    """Starts of the pieces of ``n`` words; ``strength[k]`` is that of the boundary before word k.

    Near the midpoint means the middle half of the stretch; among equal boundaries the nearest to the midpoint
    wins, then the earlier.
    """
    if n <= limit:
        return [0]
    core, starts, stack = limit - overlap, [], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= core:
            starts.append(a)
            continue
        middle, reach = (a + b) // 2, (b - a) // 4
        low, high = max(a + 1, middle - reach), min(b - 1, middle + reach)
        best = max(range(low, high + 1), key=lambda k: (strength[k], -abs(k - middle), -k))
        stack += [(best, b), (a, best)]
    return starts


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(piece number from 1, first word, words, text) of an item; one piece if it is within the limit, none for no words.

    ``overlap`` must be smaller than ``limit``. Texts are cut from the consistent form; white space at the ends
    of a piece is left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    text = consistent(text) or ""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if not n:
        return []
    strength = [0] * n
    if n > limit:
        for k in range(1, n):
            strength[k] = boundary(text, spans, k)
    starts = cut_points(strength, n, limit, overlap)
    out = []
    for i, start in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else n
        first = max(0, start - overlap) if i else start
        out.append((i + 1, first, end - first, text[spans[first][0] : spans[end - 1][1]]))
    return out


PIECE_SCHEMA = "piece int, n_pieces int, first_word int, n_words int, piece_text string"


def split_items(items: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = False) -> DataFrame:
    """``keys`` and the pieces of ``content``. ``only_long``: just items over the limit.

    An item over the limit has at least 2 * limit + 1 characters, so shorter texts never leave the JVM then.
    """
    if only_long:
        items = items.where(F.length("content") >= 2 * limit + 1)
    small = items.select(*keys, "content")
    schema = ", ".join(f"`{k}` {small.schema[k].dataType.simpleString()}" for k in keys) + ", " + PIECE_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index = [], []
            for i, text in enumerate(batch.column("content").to_pylist()):
                cut = pieces(text, limit, overlap)
                if only_long and len(cut) < 2:
                    continue
                rows += [(p, len(cut), first, n, t) for p, first, n, t in cut]
                index += [i] * len(cut)
            taken = batch.select(keys).take(pa.array(index, pa.int64()))
            types = [pa.int32()] * 4 + [pa.string()]
            made = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*keys, "piece", "n_pieces", "first_word", "n_words", "piece_text"])

    return small.mapInArrow(run, schema)


def long_record_pieces(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = True) -> DataFrame:
    """Pieces of record contents; the earliest delivery of a record counts."""
    earliest = records.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(delivery_order().alias("at"), F.xxhash64("content").alias("h"))).alias("first"))
    cut = split_items(records.where(F.col("id").isNotNull()).withColumn("at", delivery_order()).withColumn("h", F.xxhash64("content")), ["id", "at", "h"], limit, overlap, only_long)
    return (
        cut.join(earliest.select("id", F.col("first.at").alias("at"), F.col("first.h").alias("h")), ["id", "at", "h"], "left_semi")
        .dropDuplicates(["id", "piece"])
        .select(F.lit("legal_knowledge_records").alias("src"), F.col("id").alias("item_id"), F.lit("").alias("node_path"), "piece", "n_pieces", "first_word", "n_words", "piece_text")
    )


def long_node_pieces(trees: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = True) -> DataFrame:
    """Pieces of tree nodes' own contents: each distinct object is cut once, then joined with its occurrences."""
    objects = written_objects(trees, True)
    cut = split_items(objects, ["hash"], limit, overlap, only_long).dropDuplicates(["hash", "piece"])
    return (
        occurrences(objects)
        .join(cut, "hash")
        .select(F.lit("tree_output").alias("src"), F.col("tree_id").alias("item_id"), "node_path", "piece", "n_pieces", "first_word", "n_words", "piece_text")
    )


def all_pieces(records: DataFrame, trees: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every record and node content over the limit."""
    return long_record_pieces(records, limit, overlap).unionByName(long_node_pieces(trees, limit, overlap))
