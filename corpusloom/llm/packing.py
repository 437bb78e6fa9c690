"""Filling containers of fixed capacity with texts (problem 8): a grouping genetic algorithm on islands.

Texts are measured in tokens of a public tokenizer; one larger than the capacity is divided into full containers and
a rest. Items are dealt by hash into shards of bounded size. On each island of a shard a population of packings
evolves: crossover injects whole well-filled bins of one parent into the other, bins that hold an injected item are
dissolved, and the displaced items replace smaller ones in bins they fill better before the rest is placed best-fit,
largest first. Between epochs the best packing of each island migrates to the next. A shard is done when its packing
meets a lower bound, which proves it the best there is. The best packing of a shard wins; its poorly filled bins are
packed again together with those of other shards, dealt anew, as long as that saves containers.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written

CAPACITY = 4096
SHARD_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2000, 2, 2, 80, 8
#: Share of the children that have two parents.
CROSSED = 0.5
#: Bins filled less than this are packed again across shards.
WELL_FILLED = 0.98
#: The last round of packing again is one that saves less than this share of the containers it packs.
LEAST_GAIN = 0.001
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level tokenizer of a public vocabulary file."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens); null and empty texts have 0 tokens."""
    path = vocabulary_path(path)

    def run(batches):
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def items_of(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens): one item per text, several only if it alone exceeds the capacity."""
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0))
    return (
        counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
        .select("doc_id", (F.col("k") + 1).cast("int").alias("piece"), (F.col("k") * capacity).alias("token_start"), F.least(F.col("n_tokens") - F.col("k") * capacity, F.lit(capacity)).alias("n_tokens"))
    )


Packing = list[list[int]]


def best_fit(bins: Packing, loose: list[int], sizes: list[int], capacity: int) -> Packing:
    """Place loose items, largest first, each where it leaves the least room; opens bins as needed."""
    bins = [list(b) for b in bins]
    rooms = sorted((capacity - sum(sizes[i] for i in b), n) for n, b in enumerate(bins))
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - sizes[i], len(bins) - 1))
        else:
            room, n = rooms.pop(at)
            bins[n].append(i)
            insort(rooms, (room - sizes[i], n))
    return bins


def tight_fit(sizes: list[int], capacity: int) -> Packing:
    """One bin after another: the largest item left, then the one or two items that leave the least room, until none fits."""
    left = sorted(range(len(sizes)), key=lambda i: (sizes[i], -i))
    listed, bins = [sizes[i] for i in left], []
    while left:
        b, room = [left.pop()], capacity - listed.pop()
        while room > 0 and (at := bisect_right(listed, room) - 1) >= 0:
            best, take = listed[at], (at,)
            low, high = 0, at
            while low < high and best < room:
                both = listed[low] + listed[high]
                if both > room:
                    high -= 1
                    continue
                if both > best:
                    best, take = both, (low, high)
                low += 1
            for n in reversed(take):
                b.append(left.pop(n))
                del listed[n]
            room -= best
        bins.append(b)
    return bins


def fitness(bins: Packing, sizes: list[int], capacity: int) -> float:
    """Mean squared fill: few, well-filled bins."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that no packing can do without: items above half a container meet only what fits beside them."""
    ordered = sorted(sizes)
    sums = [0]
    for x in ordered:
        sums.append(sums[-1] + x)
    half, n = bisect_right(ordered, capacity // 2), len(ordered)
    best = -(-sums[n] // capacity)
    for k in {0, *ordered[:half]}:
        whole = bisect_right(ordered, capacity - k)  # items from here on leave no room for one of size k
        large, small = whole - half, sums[half] - sums[bisect_left(ordered, k)]
        free = large * capacity - (sums[whole] - sums[half])
        best = max(best, n - half + max(0, -(-(small - free) // capacity)))
    return best


def replaced(bins: Packing, loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Put loose items, one or two, in place of one or two smaller ones of a bin that they fill better; what is loose then.

    ``bins`` are changed. What comes out is smaller than what went in, and so easier to place.
    """
    loose = sorted(loose, key=lambda i: sizes[i])
    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        if room <= 0 or not loose:
            continue
        listed = [sizes[i] for i in loose]
        ones = [(sizes[i], (i,)) for i in b]
        outs = ones + [(sizes[i] + sizes[k], (i, k)) for n, i in enumerate(b) for k in b[n + 1 :]]
        best, take, give = 0, None, None
        for size, out in outs:
            most = size + room
            at = bisect_right(listed, most) - 1
            if at >= 0 and listed[at] - size > best:
                best, take, give = listed[at] - size, (at,), out
            low, high = 0, min(at, len(listed) - 1)
            while low < high:  # the fullest pair that fits
                both = listed[low] + listed[high]
                if both > most:
                    high -= 1
                    continue
                if both - size > best:
                    best, take, give = both - size, (low, high), out
                low += 1
            if best == room:
                break
        if take:
            b[:] = [i for i in b if i not in give] + [loose[n] for n in take]
            for n in sorted(take, reverse=True):
                del loose[n]
            for i in give:
                insort(loose, i, key=lambda x: sizes[x])
    return loose


def crossover(mother: Packing, father: Packing, sizes: list[int], capacity: int, rng) -> Packing:
    """Inject well-filled bins of the father into the mother; whole bins stay whole, displaced items are placed anew."""
    fills = np.array([sum(sizes[i] for i in b) for b in father])
    good = np.argsort(-fills, kind="stable")[: max(1, len(father) // 2)]
    chosen = rng.choice(good, size=max(1, len(good) // 2), replace=False)
    injected = [list(father[int(n)]) for n in sorted(chosen)]
    taken = {i for b in injected for i in b}
    kept, loose = [], []
    for b in mother:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    return best_fit(kept + injected, replaced(kept, loose, sizes, capacity), sizes, capacity)


def mutate(bins: Packing, sizes: list[int], capacity: int, rng) -> Packing:
    """Dissolve the emptiest bins and a few at random; the others take what fills them better in random order."""
    fills = np.array([sum(sizes[i] for i in b) for b in bins])
    gone = set(np.argsort(fills, kind="stable")[:2].tolist()) | set(rng.integers(0, len(bins), max(2, len(bins) // 50)).tolist())
    loose = [i for n in sorted(gone) for i in bins[n]]
    kept = [list(bins[n]) for n in rng.permutation(len(bins)).tolist() if n not in gone]
    return best_fit(kept, replaced(kept, loose, sizes, capacity), sizes, capacity)


def evolve(sizes: list[int], capacity: int, elites: list[Packing], generations: int, population: int, seed: int) -> Packing:
    """The best packing of one island after some generations, or one that meets the lower bound and so is the best there is.

    The first population is best fit in order of size and in random orders, and tight fit.
    """
    rng = np.random.default_rng(seed)
    least = lower_bound(sizes, capacity)
    everything = list(range(len(sizes)))
    pool = [*elites] or [best_fit([], everything, sizes, capacity)]
    if not elites and len(pool[0]) > least:
        pool.append(tight_fit(sizes, capacity))
    while len(pool) < population and min(map(len, pool)) > least:
        half = set(rng.permutation(len(sizes))[: len(sizes) // 2].tolist())
        first = best_fit([], sorted(half), sizes, capacity)
        pool.append(best_fit(first, [i for i in everything if i not in half], sizes, capacity))
    score = lambda b: (-len(b), fitness(b, sizes, capacity))
    pool.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(pool[0]) <= least:
            break
        a, b = np.sort(rng.integers(0, len(pool), 2))
        mother = pool[int(a)]
        if rng.random() < CROSSED:
            mother = crossover(mother, pool[int(b)], sizes, capacity, rng)
        child = mutate(mother, sizes, capacity, rng)
        pool = sorted([*pool, child], key=score, reverse=True)[:population]
    return pool[0]


_ROW = "shard long, island int, doc_id long, piece int, token_start long, n_tokens long, bin int, n_bins int, fit double, room long"


def _epoch(capacity: int, generations: int, population: int, epoch: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(group["shard"].iloc[0]), int(group["island"].iloc[0])
        elites, items = [], None
        for _, part in group.groupby("elite", sort=True):
            part = part.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
            items = part if items is None else items
            if (part["bin"] >= 0).all():
                bins: dict[int, list[int]] = {}
                for i, n in enumerate(part["bin"].tolist()):
                    bins.setdefault(n, []).append(i)
                elites.append(list(bins.values()))
        sizes = items["n_tokens"].astype(int).tolist()
        best = evolve(sizes, capacity, elites, generations, population, shard * 1009 + island * 31 + epoch)
        out = items[["shard", "island", "doc_id", "piece", "token_start", "n_tokens"]].copy()
        place, room = np.empty(len(sizes), int), np.empty(len(sizes), int)
        for n, b in enumerate(best):
            place[b], room[b] = n, capacity - sum(sizes[i] for i in b)
        return out.assign(bin=place, n_bins=len(best), fit=fitness(best, sizes, capacity), room=room)

    return run


def _pack_shards(items: DataFrame, n_shards: int, salt: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """Every item with its bin in the best packing of its shard."""
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(n_shards))
    now = items.withColumn("shard", shard).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).withColumn("bin", F.lit(-1)).withColumn("elite", F.lit(0))
    for epoch in range(epochs):
        now = now.groupBy("shard", "island").applyInPandas(_epoch(capacity, generations, population, epoch), _ROW)
        if epoch + 1 < epochs and islands > 1:  # the elite of each island also goes to the next one
            own = now.withColumn("elite", F.lit(0))
            now = own.unionByName(now.withColumn("island", (F.col("island") + 1) % islands).withColumn("elite", F.lit(1)))
        elif epoch + 1 < epochs:
            now = now.withColumn("elite", F.lit(0))
    now = written(now, "islands")
    best = now.groupBy("shard").agg(F.min(F.struct("n_bins", (-F.col("fit")).alias("unfit"), "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    return now.join(best, ["shard", "island"])


def packed(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container): every item in one container, none over the capacity."""
    items, out, round_no, before = written(items, "items"), None, 0, None
    columns = ["doc_id", "piece", "token_start", "n_tokens"]
    while True:
        n_shards = max(1, -(-items.count() // shard_items))
        done = _pack_shards(items, n_shards, round_no, capacity, islands, epochs, generations, population)
        done = written(done.withColumn("container", F.concat_ws("-", F.lit(round_no), "shard", "bin")), "packed")
        poor = F.col("room") > (1 - WELL_FILLED) * capacity
        bins = done.select("container", poor.alias("poor")).distinct().groupBy().agg(F.count("*").alias("n"), F.count_if("poor").alias("poor")).first()
        if before is not None and bins.n >= before[1]:  # nothing saved: the packing before stands
            return before[0] if out is None else out.unionByName(before[0])
        last = n_shards == 1 or bins.poor == 0 or (before is not None and before[1] - bins.n < LEAST_GAIN * before[1])
        final = (done if last else done.where(~poor)).select(*columns, "container")
        out = final if out is None else out.unionByName(final)
        if last:
            return out
        items = done.where(poor).select(*columns)
        before, round_no = (done.where(poor).select(*columns, "container"), bins.poor), round_no + 1


def containers(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every document assigned to containers of ``capacity`` tokens."""
    return packed(items_of(token_counts(documents, path), capacity), capacity)


def packing_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers used, the least possible, and the share of room left."""
    total = F.sum("n_tokens")
    return assigned.agg(
        F.count_distinct("container").alias("n_containers"),
        F.ceil(total / capacity).alias("least_possible"),
        total.alias("n_tokens"),
        (1 - F.try_divide(total, F.count_distinct("container") * capacity)).alias("room_left"),
    )
