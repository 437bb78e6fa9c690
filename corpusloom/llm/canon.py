"""Mapping freely entered names to a canonical list (problem 2).

The reference list becomes a trie of folded spellings (letters and digits only): titles and aliases, with alias paths
for the ways names are shortened: the document type or a template phrase left out, a first word cut to its letter. A
second trie holds the codes. A Levenshtein automaton walks the trie and returns every entry within a distance that
depends on the length; the nearest entry wins, a tie between entries means none.

Names are first brought to consistent form and folded; Telex spelling is undone, text in brackets and codes are set
aside. A name is looked up as it stands, then with the parts around a comma or dash in the other order, then as a name
cut off at its end, then without its first or last words, as names come with notes around them. Every look-up is a walk
of the trie. Entries the automaton cannot reach are not walked: the trigrams of every path of the trie, alias paths
included, are known, and an edit costs a key at most three, so nothing within the distance is lost.

Distinct names are resolved once each. The trie is built from the reference list, whose size is checked; the names
never leave the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.normalize import consistent, fold
from corpusloom.sources.tables import first_delivery

#: The reference list is shipped to the executors as a whole, and a node of the trie knows the entries below it: 5,000
#: entries of 60 letters take 200 MB and 2 s to build in each worker. A longer list must be resolved in parts.
MOST_ENTRIES = 5_000
#: The opening words of a title are template wording as long as this share of the titles opens with them.
TEMPLATE_SHARE = 0.03
MOST_EDITS = 5
#: So many edits are likelier than words around the name; more are less likely.
FEW_EDITS = 2
#: Words that may stand around a name and are no part of it.
EXTRA_WORDS = 3
#: Letters from which a name that is not marked as cut off may be one: a document type alone names no entry.
LEAST_OPEN = 14
_CODE = re.compile(r"(\d{1,4})\s*/\s*(\d{4})\s*/\s*([a-z]{1,5}(?:-[a-z]{1,5}|\s*-\s*[a-z]{1,3}(?![a-z]))?)")
#: A code tail with digits too many or too few.
_NEAR_CODE = re.compile(r"(?:\bso\s+)?\b\d{1,6}\s*/\s*\d{1,6}\s*/\s*[a-z]{1,5}(?:-[a-z]{1,5}|\s*-\s*[a-z]{1,3}(?![a-z]))?\b")
_SO = re.compile(r"\bso\s+(?=\d{1,6}\s*/)")
_BRACKETS = re.compile(r"\([^()]*\)?|\[[^\[\]]*\]?")
_CUT = re.compile(r"(?:\.{2,}|…|\bv\s*\.\s*v\b\.?)")
_TELEX_WORD = re.compile(r"(?<![^\W\d_])[a-z]+(?![^\W\d_])")
_PART = re.compile(r"\s*[-–—]{2,}\s*|\s+[-–—]\s*|\s*[-–—]\s+|\s*,\s*|\s*;\s*")
_KEY_WORD = re.compile(r"[a-z0-9]+")


def plain(text: str) -> str:
    """Case ignored, white space collapsed and trimmed, of the consistent form: equality of names."""
    return " ".join((consistent(text) or "").lower().split())


def squeezed(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text)


def _untelex_word(match: re.Match) -> str:
    word = match[0]
    for double, single in (("dd", "d"), ("aa", "a"), ("ee", "e"), ("oo", "o")):
        word = word.replace(double, single)
    word = word.replace("w", "")
    return word[0] + re.sub(r"[sfrxj]", "", word[1:]) if len(word) > 1 else word


def is_telex(text: str) -> bool:
    """Whether many of the words in plain letters carry Telex signs that unaccented Vietnamese never has."""
    listed = _TELEX_WORD.findall(text)
    signs = sum(1 for w in listed if len(w) > 1 and re.search(r"[wfj]|dd|aa|ee|oo|.[rsx]$", w))
    return signs >= 2 and signs >= 0.3 * len(listed)


def reading(name: str) -> tuple[str, str, bool, list[str]]:
    """(folded text, the same with mistyped codes, whether the name was cut off, its codes) of a name."""
    text = (consistent(name) or "").lower().replace("_", " ")
    codes = [squeezed("".join(c)) for c in _CODE.findall(fold(text))]
    text = _BRACKETS.sub(" ", text)
    if is_telex(text):
        text = _TELEX_WORD.sub(_untelex_word, text)
    text = fold(text)
    if codes:
        text = _CODE.sub(" ", _SO.sub(" ", text))
    cut = bool(_CUT.search(text))
    text = _CUT.sub(" ", text).strip(" .,;:-")
    return _NEAR_CODE.sub(" ", text).strip(" .,;:-"), _SO.sub(" ", text), cut, codes


def part_keys(text: str, most: int) -> list[str]:
    """Keys of at most ``most`` letters: the text, around each comma or dash right before left, and left alone; last part before first."""
    whole = squeezed(text)
    keys = [whole] if len(whole) <= most else []
    at = done = 0
    parts = _PART.split(text)
    if len(parts) > 2:
        keys.append(squeezed(parts[-1] + parts[0]))
    for m in _PART.finditer(text):
        at += len(squeezed(text[done : m.start()]))
        done = m.start()
        if len(whole) <= most:
            keys.append(whole[at:] + whole[:at])
        if at > most:
            break
        keys.append(whole[:at])
    return [k for k in dict.fromkeys(keys) if 0 < len(k) <= most]


def trimmed_keys(text: str, most: int, n: int) -> list[str]:
    """Keys of at most ``most`` letters without ``n`` words at the ends of the text or of the parts around a comma or dash."""
    keys = []
    for first in range(n + 1):
        listed = _KEY_WORD.findall(text)[first:]
        keys.append("".join(listed[: len(listed) - (n - first)]))
    for m in _PART.finditer(text):
        if m.start() > 2 * most:
            break
        left, right = _KEY_WORD.findall(text[: m.start()]), _KEY_WORD.findall(text[m.end() :])
        keys += ["".join(right[:-n] + left), "".join(right + left[n:]), "".join(left[:-n]), "".join(left[n:])]
    return [k for k in dict.fromkeys(keys) if 6 <= len(k) <= most]


class _Node:
    __slots__ = ("depth", "next", "more", "skips", "ends", "mask")

    def __init__(self, depth: int = 0) -> None:
        self.depth = depth
        self.next: dict[str, _Node] = {}
        self.more: list[tuple[str, _Node]] = []
        self.skips: list[_Node] = []
        self.ends = 0
        self.mask = 0


class Registry:
    """The tries over the reference list [(code, title, aliases)]."""

    def __init__(self, entries: Iterable[tuple[str, str | None, Iterable[str | None] | None]]) -> None:
        entries = list(entries)
        self.codes = [e[0] for e in entries]
        self.equal: set[str] = set()
        self.root, self.code_root = _Node(), _Node()
        self.with_word: dict[str, int] = {}
        folded: list[tuple[int, list[str]]] = []
        for n, (code, title, aliases) in enumerate(entries):
            self._add(n, [squeezed(fold(code).lower())], self.code_root)
            for k, name in enumerate([title, *(aliases or [])]):
                if not name or not plain(name):
                    continue
                self.equal.add(plain(name))
                listed = _KEY_WORD.findall(fold(plain(name)))
                for word in listed:
                    self.with_word[word] = self.with_word.get(word, 0) | 1 << n
                folded.append((n, listed))
                bare = _KEY_WORD.findall(reading(name)[0])
                if k == 0 and bare and bare != listed:
                    folded.append((n, bare))
        self.longest = max((sum(map(len, w)) for _, w in folded), default=0)
        stops = [self._add(n, listed, self.root) for n, listed in folded]
        for (_, listed), at in zip(folded, stops, strict=True):
            self._shorten(listed, at, max(3, TEMPLATE_SHARE * len(entries)))
        grams = self._path_grams()
        self.gram_rows = {g: r for r, g in enumerate(grams)}
        size = (len(entries) + 7) // 8
        bits = np.frombuffer(b"".join([*(m.to_bytes(size, "little") for m in grams.values()), bytes(size)]), np.uint8).reshape(len(grams) + 1, size)
        self.has_gram = np.unpackbits(bits, axis=1, bitorder="little")[:, : max(1, len(entries))]  # the last row: unknown grams

    def _path_grams(self) -> dict[str, int]:
        """Every run of three letters on any path of the trie, shortcuts included, with the entries below its end."""
        grams: dict[str, int] = {}

        def arcs(node: _Node, skips: int) -> Iterator[tuple[str, _Node, int]]:
            for c, target in [*node.next.items(), *node.more]:
                yield c, target, skips
            if skips < 2:
                for target in node.skips:
                    yield from arcs(target, skips + 1)

        todo, seen = [self.root], {id(self.root)}
        while todo:
            node = todo.pop()
            for target in node.next.values():
                if id(target) not in seen:
                    seen.add(id(target))
                    todo.append(target)
            for a, first, s in arcs(node, 0):
                for b, second, t in arcs(first, s):
                    for c, third, _ in arcs(second, t):
                        grams[a + b + c] = grams.get(a + b + c, 0) | third.mask
        return grams

    def _add(self, n: int, listed: list[str], root: _Node) -> list[_Node]:
        at, stops = root, [root]
        at.mask |= 1 << n
        for word in listed:
            for c in word:
                at = at.next.setdefault(c, _Node(at.depth + 1))
                at.mask |= 1 << n
            stops.append(at)
        at.ends |= 1 << n
        return stops

    def _shorten(self, listed: list[str], stops: list[_Node], least: float) -> None:
        """Alias paths past template words: left out, cut to their first letter, 'mot' written as a digit."""
        shared = 0
        while shared < len(listed) - 1 and stops[shared + 1].mask.bit_count() >= least:
            shared += 1
        for i, word in enumerate(listed[:-1]):
            if stops[i + 1].mask.bit_count() >= 3 or i < shared:
                for c in (word[0], *("1" * (word == "mot"))):
                    if not any(x == c and y is stops[i + 1] for x, y in stops[i].more):
                        stops[i].more.append((c, stops[i + 1]))
            if i < shared:
                for j in range(i + 1, min(i + 5, shared) + 1):
                    if stops[j] not in stops[i].skips:
                        stops[i].skips.append(stops[j])

    def shared(self, key: str) -> tuple[np.ndarray, int]:
        """(for each entry the trigrams of the key on its paths, the trigrams of the key)."""
        rows = [self.gram_rows.get(key[i : i + 3], -1) for i in range(len(key) - 2)]
        return self.has_gram[rows].sum(axis=0, dtype=np.int32), len(rows)

    def at(self, key: str, root: _Node) -> int:
        """The entries whose path the key is, as a bit mask."""
        for c in key:
            root = root.next.get(c)
            if root is None:
                return 0
        return root.ends

    def within(self, key: str, most: int, cut: bool, alive: int) -> dict[tuple[int, int], int]:
        """The entries of ``alive`` within ``most`` edits of the key: {(edits, shortcuts): entries as a bit mask}.

        At most two shortcuts (template phrases left out) are taken. ``cut``: the key may be a prefix.
        """
        m, found = len(key), {}
        if not alive:
            return found
        # nodes in the order of depth, each once per number of shortcuts, its states {place in key: edits} merged
        waiting: dict[int, dict[tuple[int, int], tuple[_Node, dict[int, int]]]] = {0: {(0, 0): (self.root, dict.fromkeys(range(most + 1)))}}
        for place in range(most + 1):
            waiting[0][0, 0][1][place] = place

        def reach(target: _Node, skipped: int, state: dict[int, int]) -> None:
            level = waiting.setdefault(target.depth, {})
            mark = (id(target), skipped)
            there = level.get(mark)
            if there is None:
                level[mark] = (target, state)
                return
            merged = there[1]
            for place, cost in state.items():
                if cost < merged.get(place, 99):
                    merged[place] = cost

        depth = 0
        while waiting:
            level = waiting.pop(depth, None)
            depth += 1
            for (_, skipped), (node, state) in (level or {}).items():
                if m in state:
                    ends = (node.mask if cut else node.ends) & alive
                    if ends:
                        mark = (state[m], skipped)
                        found[mark] = found.get(mark, 0) | ends
                if skipped < 2:
                    for target in node.skips:
                        if target.mask & alive:
                            reach(target, skipped + 1, dict(state))
                ordered = sorted(state.items())
                for c, target in [*node.next.items(), *node.more]:
                    if not target.mask & alive:
                        continue
                    made: dict[int, int] = {}
                    for place, cost in ordered:
                        if cost < most and cost + 1 < made.get(place, 99):  # a letter of the entry is missing in the key
                            made[place] = cost + 1
                        if place < m:
                            step = cost + (key[place] != c)
                            if step <= most and step < made.get(place + 1, 99):
                                made[place + 1] = step
                    for place in sorted(made):  # letters of the key that the entry has not
                        cost = made[place] + 1
                        while cost <= most and place < m and cost < made.get(place + 1, 99):
                            place += 1
                            made[place] = cost
                            cost += 1
                    if made:
                        reach(target, skipped, made)
        return found

    def spelt(self, keys: list[str]) -> int:
        """The entry, as a bit mask, of the first key that is the path of one entry alone; 0 if there is none."""
        return next((hit for key in keys if (hit := self.at(key, self.root)).bit_count() == 1), 0)

    def nearest(self, known: list[tuple[str, np.ndarray, int]], cut: bool, least: int, most: int, used: int) -> tuple[int, int] | None:
        """(the nearest entries as a bit mask, edits) over all keys, by walks of growing distance; None if none is near.

        ``known``: keys with what they share with the entries. ``used``: the entries that hold all words of the name;
        with two edits or more only those count.
        """
        for edits in range(least, most + 1):
            best: dict[tuple[int, int], int] = {}
            for key, counts, n in known:
                if edits > max_edits(len(key)):
                    continue
                near = np.packbits(counts >= n - 3 * edits, bitorder="little")
                alive = int.from_bytes(near.tobytes(), "little") & (used if edits >= 2 else -1)
                for mark, found in self.within(key, edits, cut, alive).items():
                    best[mark] = best.get(mark, 0) | found
            if best:
                low = min(best)
                return best[low], low[0]
        return None

    def resolve(self, name: str) -> tuple[str, int] | None:
        """(code, edits) of the entry a name means, ('', -1) if none; None for blank names and exact equals."""
        same = plain(name)
        if not same or same in self.equal:
            return None
        text, whole, cut, codes = reading(name)
        for code in codes:
            hit = self.at(code, self.code_root)
            if hit:
                return self.codes[hit.bit_length() - 1], 0
        longest = self.longest + MOST_EDITS
        keys = part_keys(text, longest)
        if whole != text:  # a mistyped code may be part of the entry's spelling
            keys += [k for k in part_keys(whole, longest)[:1] if k not in keys]
        hit = self.spelt(keys)
        if hit:
            return self.codes[hit.bit_length() - 1], 0
        used = -1
        for word in set(re.findall(r"[a-z]{3,}", text)):
            used &= self.with_word.get(word, -1)
        known = [(key, *self.shared(key)) for key in keys]
        found = self.nearest(known, cut, 0, FEW_EDITS, used)
        if not found:
            trimmed = [trimmed_keys(text, longest, n) for n in range(1, EXTRA_WORDS + 1)]
            hit = next(filter(None, map(self.spelt, trimmed)), 0)
            if hit:
                return self.codes[hit.bit_length() - 1], 0
            found = self.nearest(known, cut, FEW_EDITS + 1, MOST_EDITS, used)
            if not found and not cut:
                found = self.nearest([k for k in known if len(k[0]) >= LEAST_OPEN], True, 0, 1, used)
            for keys in trimmed:
                found = found or self.nearest([(key, *self.shared(key)) for key in keys], cut, 1, MOST_EDITS, -1)
        if found and found[0].bit_count() == 1:
            return self.codes[found[0].bit_length() - 1], found[1]
        return "", -1


def max_edits(length: int) -> int:
    """The distance allowed at a length: 0 below 6 letters, 1 below 14, then 2 and one more per 12 letters, at most 5."""
    return 0 if length < 6 else 1 if length < 14 else min(MOST_EDITS, 2 + (length - 14) // 12)


@lru_cache(maxsize=2)
def _registry(entries: tuple) -> Registry:
    """Built once in each worker."""
    return Registry(entries)


def resolved_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(law_name, doc_code, edits) of distinct names; those equal to an entry's title or alias, or blank, are left out."""
    if registry.count() > MOST_ENTRIES:
        raise ValueError("the reference list is larger than MOST_ENTRIES; resolve against parts of it")
    listed = [(r[0], r[1], tuple(r[2] or ())) for r in registry.where("doc_code is not null").select("doc_code", "canonical_title", "aliases").orderBy("doc_code").collect()]
    listed = tuple(listed)
    shared = names.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie = _registry(shared.value)
            rows = [(n, *r) for n in batch.column("law_name").to_pylist() if (r := trie.resolve(n)) is not None]
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["law_name", "doc_code", "edits"])

    # few bytes, much work: a fixed number of parts, which adaptive execution does not merge
    context = names.sparkSession.sparkContext
    parts = max(context.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = names.where("law_name is not null").select("law_name").distinct().repartition(parts)
    return distinct.mapInArrow(run, "law_name string, doc_code string, edits int")


def mapped_records(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, law_name, doc_code, edits): each record's first delivery whose name is not already an entry's; '' means unmatched."""
    first = first_delivery(records, "id", "ingested_at", ["law_name"]).select("id", "law_name")
    return first.join(resolved_names(first, registry), "law_name")


def unmatched_names(records: DataFrame, registry: DataFrame) -> DataFrame:
    """The names that mean no entry, with the number of records."""
    return mapped_records(records, registry).where("doc_code = ''").groupBy("law_name").agg(F.count("*").alias("n_records"))
