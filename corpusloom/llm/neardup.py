"""Near-duplicate records with small edits (problem 4): multi-index hashing with exact verification.

The fingerprint of a text is a word of ``SEGMENTS`` x ``SYMBOLS`` min-hash symbols over its three-word shingles:
two texts of Jaccard similarity J agree in each symbol with probability J, so their Hamming distance, counted in
symbols, measures J. Each segment has a table. The Hamming ball of radius 1 around a segment is enumerated by
leaving out each symbol in turn: two segments share an entry exactly if they differ in at most one symbol. Pairs
that meet in a table are compared over the whole fingerprint, and those within reach are verified on the shingle
sets themselves. A pair at J meets in no table with probability (1 - J^5 - 5 (1 - J) J^4)^8: 0.0025 at 0.7, 0.0003
at 0.75, 0.00002 at 0.8.

Texts of the same word sequence are one class from the start: a class meets others once. A table entry shared by
many classes is cut into blocks that meet the rest one by one, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.normalize import words
from corpusloom.session import written
from corpusloom.sources.tables import delivery_order

WORDS, LEAST_WORDS, THRESHOLD = 3, 30, 0.7
SEGMENTS, SYMBOLS = 8, 5
#: Symbols two fingerprints must share of 40: a pair at 0.7 shares 28 on average; fewer than 14 about once in 10^6.
LEAST_SHARED = 14
BLOCK, HOT = 64, 256
_K = SEGMENTS * SYMBOLS
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 32, _K, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, _K, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _WordHashes(dict):
    """64-bit hashes of words, kept between batches up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles_of(lists: list[list[str]], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingle hashes of all word lists one after another, their starts); lists must hold ``width`` words or more."""
    get = _HASHES.__getitem__
    sizes = np.array([len(w) for w in lists])
    h = np.fromiter((get(w) for ws in lists for w in ws), np.uint64, int(sizes.sum()))
    n = len(h) - width + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        mixed = _mix((mixed + h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum(sizes)
    keep = np.ones(n, dtype=bool)
    for k in range(1, width):  # windows that run into the next text
        cross = ends[:-1] - k
        keep[cross[(cross >= 0) & (cross < n)]] = False
    starts = np.concatenate([[0], np.cumsum(sizes - width + 1)[:-1]])
    return (mixed[keep] >> np.uint64(32)).astype(np.uint32), starts


def fingerprints(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The min-hash symbols of each text, 16 bits each."""
    out = np.empty((len(starts), _K), dtype=np.uint16)
    work = np.empty_like(shingles)
    for j in range(_K):
        np.multiply(shingles, _FACTORS[j], out=work)
        np.bitwise_xor(work, _OFFSETS[j], out=work)
        least = np.minimum.reduceat(work, starts)
        out[:, j] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


SIGNED = "id bigint, at timestamp, class bigint, key bigint, symbols binary, shingles binary"
#: Of the 40 sketch bits a pair at 0.7 differs in 6.0 on average, in more than 15 about 3 times in 10^5.
MOST_BITS = 15
SKETCH_MASK = (1 << 40) - 1


def table_keys(prints: np.ndarray, classes: list[int]) -> np.ndarray:
    """What the tables hold for a class: 24 bits of its hash over 40 sketch bits, one of each symbol."""
    bits = (prints & np.uint16(1)).astype(np.int64) @ (np.int64(1) << np.arange(_K, dtype=np.int64))
    return (np.array(classes, dtype=np.int64) << np.int64(40)) | bits


def signed(records: DataFrame) -> DataFrame:
    """Every delivery with its class, fingerprint and shingle set; all null for texts of fewer than 30 words.

    ``class`` is a hash of the word sequence; null, empty and short texts have none and never pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [words(t) for t in batch.column("content").to_pylist()]
            long = [i for i, w in enumerate(lists) if len(w) >= LEAST_WORDS]
            classes: list = [None] * len(lists)
            symbols: list = [None] * len(lists)
            sets: list = [None] * len(lists)
            keys: list = [None] * len(lists)
            if long:
                flat, starts = shingles_of([lists[i] for i in long])
                prints = fingerprints(flat, starts)
                for row, (i, part) in enumerate(zip(long, np.split(flat, starts[1:]), strict=True)):
                    classes[i] = xxhash.xxh64_intdigest(" ".join(lists[i])) - (1 << 63)
                    symbols[i] = prints[row].tobytes()
                    sets[i] = part.tobytes()
                for i, key in zip(long, table_keys(prints, [classes[i] for i in long]).tolist(), strict=True):
                    keys[i] = key
            made = [
                batch.column("id"),
                batch.column("at"),
                pa.array(classes, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(symbols, pa.binary()),
                pa.array(sets, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["id", "at", "class", "key", "symbols", "shingles"])

    rows = records.where(F.col("id").isNotNull()).select("id", delivery_order().alias("at"), "content")
    return rows.mapInArrow(run, SIGNED)


def ball_entries(classes: DataFrame) -> DataFrame:
    """(key, entry): the table entries of the ball of radius 1 around each segment of ``symbols``."""
    size = 2 * SYMBOLS
    entries = [
        F.xxhash64(
            F.lit(s * SYMBOLS + out),
            F.substring("symbols", s * size + 1, 2 * out) if out else F.lit(b""),
            F.substring("symbols", s * size + 2 * out + 3, size - 2 * out - 2) if out < SYMBOLS - 1 else F.lit(b""),
        )
        for s in range(SEGMENTS)
        for out in range(SYMBOLS)
    ]
    return classes.select("key", F.explode(F.array(*entries)).alias("entry"))


def _near_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.int64(SKETCH_MASK)) <= MOST_BITS


class _Runs:
    """Pairs from rows sorted by (entry, key) that arrive in batches; runs of more than ``HOT`` keys come out as rows."""

    def __init__(self) -> None:
        self.entry = self.key = np.empty(0, np.int64)
        self.hot: int | None = None

    def feed(self, entry: np.ndarray, key: np.ndarray, last: bool = False) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """[(a or entry, b or key, whether these are rows of a hot entry)] of all runs that ended."""
        out = []
        if self.hot is not None:  # the run before was hot: its further rows go straight out
            n = int(np.searchsorted(entry, self.hot, side="right")) if len(entry) and entry[0] == self.hot else 0
            if n:
                out.append((entry[:n], key[:n], True))
                entry, key = entry[n:], key[n:]
            if len(entry) or last:
                self.hot = None
        e, k = np.concatenate([self.entry, entry]), np.concatenate([self.key, key])
        if len(e):
            fresh = np.r_[True, (e[1:] != e[:-1]) | (k[1:] != k[:-1])]
            e, k = e[fresh], k[fresh]
        starts = np.flatnonzero(np.r_[True, e[1:] != e[:-1]]) if len(e) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(e)])
        ended = len(e) if last or not len(e) else int(starts[-1])
        if ended < len(e) and sizes[-1] > HOT:
            self.hot, ended = int(e[-1]), len(e)
        self.entry, self.key = e[ended:], k[ended:]
        e, k = e[:ended], k[:ended]
        of = np.repeat(sizes, sizes)[:ended]
        if (of > HOT).any():
            out.append((e[of > HOT], k[of > HOT], True))
            e, k = e[of <= HOT], k[of <= HOT]
        at = np.arange(len(e))
        for step in range(1, HOT):
            at = at[at + step < len(e)]
            at = at[e[at] == e[at + step]]
            if not len(at):
                break
            a, b = k[at], k[at + step]
            near = _near_keys(a, b)
            out.append((a[near], b[near], False))
        return out


def _run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(parts):
        for x, y, hot in parts:
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), hot))], names=["x", "y", "hot"])

    runs, none = _Runs(), np.empty(0, np.int64)
    for batch in batches:
        yield from made(runs.feed(batch.column("entry").to_numpy(), batch.column("key").to_numpy()))
    yield from made(runs.feed(none, none, last=True))


def met_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: keys that share a table entry and whose sketches are within reach of each other.

    Rows are sorted by entry within their partition and paired as they stream by. Entries of more than ``HOT``
    distinct keys are not paired there: their keys are dealt into blocks of about ``BLOCK``, and each block meets
    all keys of the entry in tasks of its own.
    """
    rows = ball_entries(classes).repartition("entry").sortWithinPartitions("entry", "key")
    met = written(rows.mapInArrow(_run_pairs, "x bigint, y bigint, hot boolean"), "met")
    hot = met.where("hot").select(F.col("x").alias("entry"), F.col("y").alias("key"))
    parts = hot.groupBy("entry").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = hot.join(parts, "entry")
    left = members.select("entry", F.col("key").alias("a"), F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"))
    right = members.select("entry", F.col("key").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(SKETCH_MASK))) <= MOST_BITS
    more = left.join(right, ["entry", "part"]).where("a < b").where(near).select("a", "b")
    return met.where("not hot").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(more).distinct()


def _filtered(pairs: DataFrame, column: str, schema: str, judge) -> DataFrame:
    """Pairs joined with ``column`` of both classes and judged in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield judge(batch, batch.column(f"{column}_a").to_pylist(), batch.column(f"{column}_b").to_pylist())

    return pairs.mapInArrow(run, schema)


def _near_prints(batch: pa.RecordBatch, left: list[bytes], right: list[bytes]) -> pa.RecordBatch:
    a = np.frombuffer(b"".join(left), np.uint16).reshape(-1, _K)
    b = np.frombuffer(b"".join(right), np.uint16).reshape(-1, _K)
    return batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= LEAST_SHARED))


def jaccard(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle lists."""
    x, y = np.unique(np.frombuffer(a, np.uint32)), np.unique(np.frombuffer(b, np.uint32))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _similar_sets(batch: pa.RecordBatch, left: list[bytes], right: list[bytes]) -> pa.RecordBatch:
    values = pa.array([jaccard(a, b) for a, b in zip(left, right, strict=True)])
    out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), values], names=["a", "b", "similarity"])
    return out.filter(pa.array([v.as_py() >= THRESHOLD for v in values]))


def _with_both(pairs: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    side = classes.select("class", column)
    return pairs.join(side.withColumnsRenamed({"class": "a", column: f"{column}_a"}), "a").join(
        side.withColumnsRenamed({"class": "b", column: f"{column}_b"}), "b"
    )


def similar_classes(signatures: DataFrame) -> DataFrame:
    """(a, b, similarity): pairs of classes of similarity 0.7 or more, from written ``signed`` rows."""
    long = signatures.where("class is not null")
    met = met_pairs(long.select("key", "symbols"))
    prints = long.select("class", "key", "symbols").dropDuplicates(["class"])
    sides = [prints.withColumnsRenamed({"class": x, "key": f"key_{x}", "symbols": f"symbols_{x}"}) for x in "ab"]
    # classes whose keys are equal meet under no pair of keys, but under their own
    shared = prints.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"))
    keys = met.unionByName(shared).withColumnsRenamed({"a": "key_a", "b": "key_b"})
    both = keys.join(sides[0], "key_a").join(sides[1], "key_b").where("key_a < key_b or a < b").select("a", "b", "symbols_a", "symbols_b")
    near = written(_filtered(both, "symbols", "a bigint, b bigint", _near_prints), "near")
    # a written list of the classes still in play: small, it is broadcast after a look at its size, else shuffled
    needed = written(near.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "needed")
    sets = long.select("class", "shingles").join(needed, "class", "left_semi").dropDuplicates(["class"])
    return _filtered(_with_both(near, sets, "shingles"), "shingles", "a bigint, b bigint, similarity double", _similar_sets)


def class_members(signatures: DataFrame) -> DataFrame:
    """(id, class): each record's earliest delivery, if its text is long enough to have a class."""
    first = signatures.groupBy("id").agg(F.min(F.struct("at", "class")).alias("f"))
    return first.select("id", F.col("f.class").alias("class")).where("class is not null")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not the least of its connected component: that least node.

    Large and small stars in turn: each node hangs its larger, then its smaller neighbours on the least one it sees,
    which leaves the components as they are and ends, after few rounds, when every edge leads to a root. Rounds are
    written; the driver only sees whether one more is needed.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        inner = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
        if twice.unionByName(inner).isEmpty():
            return edges.withColumnsRenamed({"a": "node", "b": "root"})


def similar_groups(records: DataFrame) -> DataFrame:
    """(id, group) of every record: the least id it is linked to through records of similarity 0.7 or more, else its own.

    Only earliest deliveries link: a class that holds later deliveries alone is no record.
    """
    signatures = written(signed(records), "signed")
    first = written(signatures.groupBy("id").agg(F.min(F.struct("at", "class")).alias("f")).select("id", "f.class"), "first")
    members = first.where("class is not null")
    pairs = similar_classes(signatures).select("a", "b")
    for side in "ab":
        pairs = pairs.join(members.select(F.col("class").alias(side)), side, "left_semi")
    roots = components(pairs).withColumnRenamed("node", "class")
    joined = members.join(roots, "class", "left").select("id", F.coalesce("root", "class").alias("root"))
    heads = joined.groupBy("root").agg(F.min("id").alias("group"))
    alone = first.where("class is null").select("id", F.col("id").alias("group"))
    return joined.join(heads, "root").select("id", "group").unionByName(alone)


def representatives(records: DataFrame) -> DataFrame:
    """(id, representative): every record with the least id of those of its word sequence; itself if its text is short."""
    first = signed(records).groupBy("id").agg(F.min(F.struct("at", "class")).alias("f")).select("id", "f.class")
    first = written(first, "first")
    heads = first.where("class is not null").groupBy("class").agg(F.min("id").alias("representative"))
    return first.join(heads, "class", "left").select("id", F.coalesce("representative", "id").alias("representative"))


def similar_representatives(records: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: the pairs between representatives, one for each two classes of texts.

    With ``representatives`` these are all similar pairs, and no more rows than there are different similar texts.
    """
    signatures = written(signed(records), "signed")
    heads = class_members(signatures).groupBy("class").agg(F.min("id").alias("id"))
    pairs = similar_classes(signatures)
    for side in "ab":
        pairs = pairs.join(heads.withColumnsRenamed({"class": side, "id": f"id_{side}"}), side)
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")


def similar_records(records: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two records of similarity 0.7 or more, equal contents included."""
    signatures = written(signed(records), "signed")
    members = class_members(signatures)
    pairs = written(similar_classes(signatures).select("a", "b"), "pairs")
    left = members.withColumnsRenamed({"id": "x", "class": "a"})
    right = members.withColumnsRenamed({"id": "y", "class": "b"})
    across = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = (
        left.withColumnRenamed("a", "class")
        .join(members.withColumnRenamed("id", "y"), "class")
        .where("x < y")
        .select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    )
    return across.unionByName(within)
