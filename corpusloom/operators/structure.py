"""Structure of long texts: headers, labels, levels, breadcrumbs, and chunks that keep to it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import bound

_BLOCKS = "array<struct<label:string,body:string>>"


def blocks_at(text: Column, cut: str, label: str) -> Column:
    """array<struct<label, body>>: the text cut before each match of ``cut`` (a look-ahead); label '' where there is none."""
    return F.transform(F.split(text, cut), lambda b: F.struct(F.regexp_extract(b, label, 1).alias("label"), b.alias("body")))


def merged_blocks(blocks: Column, goes_on) -> Column:
    """Blocks whose label does not go on from the last accepted one are joined to the block before.

    ``goes_on(last, label)``: ``last`` is null before the first. What stands before the first label has label ''.
    """
    kind = f"struct<last:string,out:{_BLOCKS}>"

    def add(state: Column, b: Column) -> Column:
        out, n = state["out"], F.size(state["out"])
        fits = (b["label"] != "") & F.coalesce(goes_on(state["last"], b["label"]), F.lit(False))
        tail = F.get(out, n - 1)
        joined = F.concat(F.slice(out, F.lit(1), n - 1), F.array(F.struct(tail["label"].alias("label"), F.concat(tail["body"], b["body"]).alias("body"))))
        fresh = F.struct(F.when(fits, b["label"]).otherwise("").alias("label"), b["body"].alias("body"))
        return F.struct(F.when(fits, b["label"]).otherwise(state["last"]).alias("last"), F.when(fits | (n == 0), F.concat(out, F.array(fresh))).otherwise(joined).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast(_BLOCKS).alias("out")).cast(kind)
    return F.filter(F.aggregate(blocks, start, add, lambda s: s["out"]), lambda b: F.trim(b["body"]) != "")


def gated_articles(text: Column, gap: int = 3, first: int = 2) -> Column:
    """Articles whose numbers go on by 1 to ``gap``, or keep the number with a later letter; other headers are text."""
    number, suffix = (lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int")), (lambda x: F.regexp_extract(x, r"(\p{L}?)$", 1))

    def goes_on(last: Column, label: Column) -> Column:
        n, m = number(label), number(last)
        return F.when(last.isNull(), n <= first).otherwise(((n == m) & (suffix(label) > suffix(last))) | ((n > m) & (n <= m + gap)))

    return merged_blocks(blocks_at(text, r"(?m)(?=^Điều \d{1,6}[a-zđ]?\.)", r"^Điều (\d{1,6}[a-zđ]?)\."), goes_on)


def numbered_clauses(text: Column) -> Column:
    """Clauses 1., 2., 3. ... at line starts that come as the next expected number; fewer than two are one block without label."""
    found = merged_blocks(blocks_at(text, r"(?m)(?=^[ \t]*\d{1,2}\.[ \t])", r"^[ \t]*(\d{1,2})\.[ \t]"), lambda last, x: x.cast("int") == F.coalesce(last.cast("int"), F.lit(0)) + 1)
    labelled = F.size(F.filter(found, lambda b: b["label"] != ""))
    whole = F.array(F.struct(F.lit("").alias("label"), text.alias("body")))
    return F.when(labelled >= 2, found).otherwise(whole)


def guarded_articles(text: Column, references: list[str]) -> Column:
    """Articles whose header no reference runs into: none of these words (patterns of bounded length) stands right before it.

    A header needs a title sign behind it. Bodies of fewer than 20 characters are stray references and dropped.
    """
    cut = rf"(?<!(?:{'|'.join(references)})[ \t\n]{{0,3}})(?=Điều \d{{1,6}}\. ?[\p{{L}}\p{{N}}\"'(«“‘])"
    blocks = blocks_at(text, cut, r"^Điều (\d{1,6})\.")
    return F.filter(blocks, lambda b: (b["label"] != "") & (F.length(F.trim(b["body"])) >= 20))


def level_of(line: Column, rules: list[tuple[str, float, str]], title: tuple[str, float], otherwise: tuple[str, float]) -> Column:
    """struct(type, level, number) of a line by the first pattern that fits; a line in capitals without one is a title."""
    made = lambda kind, level, number: F.struct(F.lit(kind).alias("type"), F.lit(float(level)).alias("level"), number.alias("number"))
    out = None
    for kind, level, pattern in rules:
        hit = made(kind, level, F.regexp_extract(line, pattern, 1))
        out = F.when(line.rlike(pattern), hit) if out is None else out.when(line.rlike(pattern), hit)
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    return out.when(capitals, made(*title, F.lit(""))).otherwise(made(*otherwise, F.lit("")))


def in_quotes(lines: Column, opening: str = "“", closing: str = "”") -> Column:
    """For each line of an array whether it is inside quotes that opened before or in it, or ends them."""
    kind = "struct<open:int,out:array<boolean>>"

    def add(state: Column, line: Column) -> Column:
        opened, closed = F.regexp_count(line, F.lit(opening)), F.regexp_count(line, F.lit(closing))
        inside = (state["open"] > 0) | (opened > 0)
        return F.struct(F.greatest(state["open"] + opened - closed, F.lit(0)).alias("open"), F.concat(state["out"], F.array(inside)).alias("out"))

    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<boolean>").alias("out")).cast(kind)
    return F.aggregate(lines, start, add, lambda s: s["out"])


def breadcrumbs(lines: Column, levels: list[str]) -> Column:
    """For each line of an array the last header of each level (patterns, outermost first) at or before it; '' for none.

    A header ends the headers of the levels below it.
    """
    n = len(levels)
    kind = "struct<now:array<string>,out:array<array<string>>>"

    def add(state: Column, line: Column) -> Column:
        hits = [line.rlike(p) for p in levels]
        now = []
        for k in range(n):
            above = F.lit(False)
            for j in range(k):
                above = above | hits[j]
            now.append(F.when(hits[k], line).when(above, "").otherwise(state["now"][k]))
        made = F.array(*now)
        return F.struct(made.alias("now"), F.concat(state["out"], F.array(made)).alias("out"))

    start = F.struct(F.array(*[F.lit("")] * n).alias("now"), F.array().cast("array<array<string>>").alias("out")).cast(kind)
    return F.aggregate(lines, start, add, lambda s: s["out"])


def trimmed_at(text: Column, marker: str, most: int, least: int = 200) -> Column:
    """A text longer than ``most`` ends before a marker (pattern) behind its first ``least`` characters, and at ``most`` anyway."""
    rest = F.substring(text, F.lit(least + 2), F.length(text))
    at = F.length(F.get(F.split(rest, marker, 2), F.lit(0)))
    cut = F.when(at < F.length(rest), F.rtrim(F.substring(text, F.lit(1), at + least + 1))).otherwise(text)
    return F.when(F.length(text) <= most, text).otherwise(F.substring(cut, 1, most))


def soft_pieces(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters: cut behind the last sentence end in reach, or the last blank if that is early."""
    out, at = [], 0
    while len(text) - at > most:
        window = text[at : at + most]
        cut = max((m.end() for m in re.finditer(r"[.;:!?]\s+|\n+", window)), default=-1)
        if cut < most // 2:
            blank = window.rfind(" ")
            cut = blank + 1 if blank > 0 else most
        out.append(window[:cut].strip())
        at += cut
    return [p for p in [*out, text[at:].strip()] if p]


def sentence_chunks(texts: DataFrame, key: str, text: str = "text", most: int = 800) -> DataFrame:
    """(key, pos, piece): ``soft_pieces`` of each text in Arrow batches; null and blank texts have none."""
    small = texts.where(F.trim(text) != "").select(key, F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, p) for i, t in enumerate(batch.column("_t").to_pylist()) for n, p in enumerate(soft_pieces(t, most))]
            index = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(index), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[key, "pos", "piece"])

    return small.mapInArrow(run, f"`{key}` {small.schema[key].dataType.simpleString()}, pos int, piece string")


def packed_segments(segments: Column, target: int, whole: int) -> Column:
    """array<struct<n, body>>: segments put together in order up to ``target`` characters; all as one if that is at most ``whole``."""
    kind = "array<struct<n:int,body:string>>"
    one = F.array(F.struct(F.size(segments).alias("n"), F.array_join(segments, "\n").alias("body")))

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce(F.length(last["body"]) + 1 + F.length(s) <= target, F.lit(False))
        longer = F.struct((last["n"] + 1).alias("n"), F.concat(last["body"], F.lit("\n"), s).alias("body"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(F.struct(F.lit(1).alias("n"), s.alias("body")))))

    return F.when(F.length(F.array_join(segments, "\n")) <= whole, one).otherwise(F.aggregate(segments, F.array().cast(kind), add))


def sized_chunks(rows: DataFrame, key: str, segments: str, target: int, hard: int, whole: int) -> DataFrame:
    """(key, pos, piece): segments packed in order to ``target`` characters; one longer than ``hard`` is cut softly first.

    A text of at most ``whole`` characters is one chunk. No chunk is longer than the largest of the three limits.
    """
    small = rows.where(F.size(segments) > 0).select(key, F.col(segments).alias("_s"))

    def chunks(listed: list[str]) -> list[str]:
        listed = [x for x in listed if x]
        if len(full := "\n".join(listed)) <= whole:
            return [full] if full else []
        out: list[str] = []
        for part in (p for x in listed for p in ([x] if len(x) <= hard else soft_pieces(x, hard))):
            if out and len(out[-1]) + 1 + len(part) <= target:
                out[-1] += "\n" + part
            else:
                out.append(part)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, n, c) for i, listed in enumerate(batch.column("_s").to_pylist()) for n, c in enumerate(chunks(listed or []))]
            index = pa.array([r[0] for r in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(index), pa.array([r[1] for r in made], pa.int32()), pa.array([r[2] for r in made], pa.string())], names=[key, "pos", "piece"])

    return small.mapInArrow(run, f"`{key}` {small.schema[key].dataType.simpleString()}, pos int, piece string")


def token_windows(words: Column, width: int, overlap: int, header: int = 0) -> Column:
    """array<array<string>>: windows of ``width`` words, each ``overlap`` words into the one before; the first ``header`` words head all."""
    step = width - overlap

    def cut(w: Column) -> Column:
        head = F.slice(w, F.lit(1), F.lit(header)) if header else F.array().cast("array<string>")
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - overlap, F.lit(1)), F.lit(step))
        windows = F.transform(starts, lambda i: F.when(i == 1, F.slice(w, i, F.lit(width))).otherwise(F.concat(head, F.slice(w, i, F.lit(width)))))
        return F.when(F.size(w) > 0, windows).otherwise(F.array().cast("array<array<string>>"))

    return bound(words, cut)


def citation_keys(article: Column, clauses: Column, letters: Column) -> Column:
    """Every way a part can be cited: the article, each clause of it, each point of each clause."""
    by_clause = F.transform(clauses, lambda c: F.concat(F.lit("khoản "), c, F.lit(" "), article))
    points = F.flatten(F.transform(by_clause, lambda c: F.transform(letters, lambda p: F.concat(F.lit("điểm "), p, F.lit(" "), c))))
    return F.concat(F.array(article), by_clause, points)


def parse_kind(text: Column, native: str, foreign: str) -> Column:
    """struct(kind, lang): by the headers a text has ('article', 'foreign', 'numbered', 'empty'), and the language they are in."""
    a, b = F.coalesce(text.rlike(native), F.lit(False)), F.coalesce(text.rlike(foreign), F.lit(False))
    kind = F.when(a, "article").when(b, "foreign").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("numbered")
    return F.struct(kind.alias("kind"), F.when(a & b, "mixed").when(b, "en").otherwise("vi").alias("lang"))
