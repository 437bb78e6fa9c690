"""Structure of texts: articles, sentences, packed chunks, trees of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import VIETNAMESE, Profile, collapsed


def articles(texts: DataFrame, key: str, text: str = "text", profile: Profile = VIETNAMESE, least: int = 20) -> DataFrame:
    """(key, pos, number, body): blocks that begin with an article header at a line start; short ones are dropped.

    A text without headers is one block of number '0'.
    """
    blocks = F.split(text, f"(?m)(?={profile.article_header})".replace("(?m)(?=(?m)", "(?m)(?="))
    rows = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(blocks).alias("pos", "body"))
    number = F.coalesce(F.nullif(F.regexp_extract("body", profile.article_header.replace("(?m)", ""), 1), F.lit("")), F.lit("0"))
    return rows.select(key, "pos", number.alias("number"), F.trim("body").alias("body")).where(F.length("body") >= least)


def sentences(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, sentence): cut after sentence signs before white space."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), collapsed), lambda s: s != "")
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("pos", "sentence"))


def packed_chunks(texts: DataFrame, key: str, text: str = "text", target: int = 400) -> DataFrame:
    """(key, chunk, n_sentences, n_chars): sentences packed greedily, in order, into chunks of ``target`` characters.

    A sentence longer than the target is a chunk of its own. The fold runs inside the JVM, one text at a time.
    """
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), collapsed), lambda s: s != "")
    kind = "array<struct<n:int,size:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        size = F.length(s)
        fits = F.coalesce(last["size"] + 1 + size <= target, F.lit(False))
        longer = F.struct((last["n"] + 1).alias("n"), (last["size"] + 1 + size).alias("size"))
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(F.struct(F.lit(1).alias("n"), size.alias("size")))))

    chunks = F.aggregate(parts, F.array().cast(kind), add)
    rows = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(chunks).alias("chunk", "c"))
    return rows.select(key, "chunk", F.col("c.n").alias("n_sentences"), F.col("c.size").alias("n_chars"))


def windows(texts: DataFrame, key: str, text: str = "text", width: int = 1200, overlap: int = 200) -> DataFrame:
    """(key, start, part): overlapping character windows that cover the whole text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(width - overlap))
    return texts.where(F.length(text) > 0).select(key, F.explode(starts).alias("start"), text).select(key, "start", F.substring(F.col(text), F.col("start"), F.lit(width)).alias("part"))


#: Levels an outline may have; each costs a running maximum.
MOST_LEVELS = 64


def level_parents(nodes: DataFrame, group: str, pos: str, level: str, levels: list[float] | None = None) -> DataFrame:
    """``parent_pos``: the nearest earlier node of a smaller level, by one running maximum per level; null for roots.

    The levels are looked up if they are not given. A node without level has no parent and is none.
    """
    if levels is None:
        levels = [r[0] for r in nodes.where(F.col(level).isNotNull()).select(level).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(levels) > MOST_LEVELS:
            raise ValueError("more levels than MOST_LEVELS")
    if not levels:
        return nodes.withColumn("parent_pos", F.lit(None).cast(nodes.schema[pos].dataType))
    before = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(level) > v, F.max(F.when(F.col(level) == v, F.col(pos))).over(before)) for v in levels]
    return nodes.withColumn("parent_pos", F.greatest(*last) if len(last) > 1 else last[0])


def closure(nodes: DataFrame) -> DataFrame:
    """(tree_id, ancestor, descendant, depth), itself at depth 0, from node paths; no recursion and no join."""
    steps = F.split("node_path", r"\.")
    up = F.sequence(F.lit(1), F.size(steps))
    rows = nodes.select("tree_id", F.col("node_path").alias("descendant"), steps.alias("s"), F.explode(up).alias("k"))
    return rows.select("tree_id", F.array_join(F.slice("s", 1, F.col("k")), ".").alias("ancestor"), "descendant", (F.size("s") - F.col("k")).alias("depth"))
