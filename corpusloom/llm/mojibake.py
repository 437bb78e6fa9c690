"""Garbled text from wrong character encodings (problem 10).

Words that hold signs no clean text holds are joined with clean words on what both have left when every non-ASCII
run is stripped: a garbled word and its near-twin share that skeleton. Each such pair is aligned, run by run, and what
turns the twin's characters into the garbled runs is inferred: a written and a read encoding, one after another, of all
those Python knows, if one explains the whole word; else the runs vote for the characters they stand for. What enough
distinct pairs agree on is learned and applied to all documents, whole or in stretches, longest runs first, so doubly
garbled text is undone as well. Encodings that write a base letter and a mark (VNI, Windows-1258) keep base letters in
ASCII and are joined on their own skeleton. Only counts reach the driver: at most one for each pair of encodings, and
the runs no encoding explains, whose number is checked.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Signs clean texts of these languages hold.
SIGNS = "“”‘’–—…«»·§°±²³¹½¼¾×÷№£€¥©®™•†‡′″→≤≥≠¡¿ºªµ"
VOWELS, TONES = "aăâeêioôơuưy", ("", "̀", "́", "̃", "̉", "̣")
LETTERS = "".join(sorted({c for v in VOWELS + VOWELS.upper() for t in TONES if not (c := unicodedata.normalize("NFC", v + t)).isascii()} | set("đĐ")))
WESTERN = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c) not in LETTERS and chr(c) not in SIGNS)
#: Distinct twin pairs that must agree on an encoding, and garbled words that must agree on a run without one.
LEAST_PAIRS, LEAST_WORDS, AGREED = 2, 5, 0.9
#: Runs without an encoding that may be learned; more are refused, not cut.
MOST_RUNS = 100_000
#: Encodings that write marks behind base letters, as they show when read in a Western one.
MARKED = ("vni", "windows-1258")
# VNI writes a base letter and a mark; đ, ư, ơ and the toned i are single signs.
VNI_MARKS = {"ù": "́", "ø": "̀", "û": "̉", "õ": "̃", "ï": "̣", "â": "̂", "á": "̂́", "à": "̂̀", "å": "̂̉", "ã": "̂̃", "ä": "̣̂", "ê": "̆", "é": "̆́", "è": "̆̀", "ú": "̆̉", "ü": "̆̃", "ë": "̣̆"}
VNI_SINGLE = {"ñ": "đ", "ö": "ư", "ô": "ơ", "í": "í", "ì": "ì", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ"}
_WORD = re.compile(r"[^ \n\t\r]+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_STRANGE = re.compile(f"[^\x00-\x7f{LETTERS}{SIGNS}̛̣̀́̂̃̆̉ ​‌‍﻿­⁠]")
_CLEAN_WORD = re.compile(f"[\x21-\x7e{LETTERS}“”‘’«»]+")
_ONSET = "(?:ngh|ng|nh|gh|gi|kh|ph|th|tr|ch|qu|[bcdđghklmnpqrstvx])?"
_SYLLABLE = re.compile(f"{_ONSET}[{VOWELS}]{{1,3}}(?:ch|nh|ng|[cmnpt])?$")
# Signs that give such an encoding away.
_TELLS = {"vni": re.compile("[øûïåäëñöæîüØÛÏÅÄËÑÖÆÎÜ]"), "windows-1258": re.compile("[ðÐÞ]|(?<=[a-zâêôãõý])[ÌÒ]|[âêôãõý][ìò]")}


@cache
def encodings_known() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(single-byte, multi-byte) text encodings of Python that read ASCII as it is and something beyond it."""
    import codecs
    from encodings.aliases import aliases

    plain = bytes(range(0x20, 0x7F))
    one, many = [], []
    for name in sorted(set(aliases.values())):
        try:
            if name.startswith(("utf", "unicode")) or not codecs.lookup(name)._is_text_encoding or plain.decode(name) != plain.decode("ascii"):
                continue
            high = [bytes([b]).decode(name, "ignore") for b in range(0x80, 0x100)]
            second = bytes([0xA1]).decode(name, "ignore")
            pairs = sum(bytes([b, 0xA1]).decode(name, "ignore") not in ("", second) for b in range(0x81, 0xFF) if not high[b - 0x80])
        except (LookupError, UnicodeError):
            continue
        if pairs > 20:
            many.append(name)
        elif any(high):
            one.append(name)
    return tuple(one), tuple(many)


@cache
def _table(codec: str) -> tuple[str, ...]:
    """Byte to character; bytes the encoding leaves open stay the control sign of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@cache
def _bytes(codec: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(codec))))}


def _read(data: bytes, codec: str) -> str:
    if codec in encodings_known()[1]:
        return data.decode(codec, "replace")
    table = _table(codec)
    return "".join(table[b] for b in data)


def unread(text: str, codec: str) -> str | None:
    """What was written in UTF-8 and read in the encoding as ``text``; None if that cannot be."""
    try:
        if codec in encodings_known()[1]:
            return text.encode(codec).decode("utf-8")
        back = _bytes(codec)
        return bytes([back[c] for c in text]).decode("utf-8")
    except (KeyError, UnicodeError):
        return None


def cp1258(text: str) -> str:
    """``text`` written in Windows-1258, whose tones are signs of their own, and read as Windows-1252."""
    out = []
    for c in text:
        parts = unicodedata.normalize("NFD", c)
        tone = next((m for m in parts if m in TONES[1:]), "")
        stem = unicodedata.normalize("NFC", parts.replace(tone, "")) if tone else c
        try:
            whole = c.encode("cp1258")
        except UnicodeEncodeError:
            try:
                whole = (stem + tone).encode("cp1258")
            except UnicodeEncodeError:
                out.append(c)
                continue
        out.append(_read(whole, "cp1252"))
    return "".join(out)


def garble(text: str, chain: str) -> str:
    """``text`` written in UTF-8 and read in each encoding of the chain ('cp1252', 'cp1252+latin_1') in turn; or in a marked one."""
    if chain in MARKED:
        return vni(text) if chain == "vni" else cp1258(text)
    for codec in chain.split("+"):
        text = _read(text.encode("utf-8"), codec)
    return text


@cache
def _vni_back() -> dict[str, str]:
    marks = {"".join(sorted(m, key=lambda c: c not in "\u0302\u0306")): k for k, m in VNI_MARKS.items()}
    out = {}
    for letter in LETTERS:
        low = letter.lower()
        single = next((k for k, v in VNI_SINGLE.items() if v == low), None)
        if single:
            made = single
        else:
            parts = unicodedata.normalize("NFD", low)
            base, rest = parts[0], parts[1:]
            horn = "̛" in rest
            order = sorted(rest.replace("̛", ""), key=lambda c: c not in "\u0302\u0306")
            stem = {"u": "ö", "o": "ô"}[base] if horn else base
            mark = "".join(order)
            made = stem + (marks.get(mark, "") if mark else "")
            if mark and mark not in marks:
                continue
        out[letter] = made.upper() if letter != low else made
    return out


def vni(text: str) -> str:
    """``text`` as VNI shows when read in a Western encoding."""
    table = _vni_back()
    return "".join(table.get(c, c) for c in text)


@cache
def mapping(chain: str) -> dict[str, str]:
    """Garbled run to character, for every character of the clean alphabet."""
    out: dict[str, str] = {}
    for c in LETTERS if chain in MARKED else LETTERS + SIGNS + WESTERN:
        run = garble(c, chain)
        if run != c and (chain in MARKED or len(run) > 1):
            out.setdefault(run, c)
    return out


def skeleton(word: str) -> str:
    """The word with each non-ASCII run as one placeholder."""
    return _RUN.sub("\0", word)


def swallowed(word: str) -> list[str]:
    """The skeletons a word can have where a multi-byte encoding took the letter behind a run as its second byte."""
    after = [m.end() for m in _RUN.finditer(word) if word[m.end() : m.end() + 1].isalpha()]
    gone = [{k} for k in after] + [set(after)] * (len(after) > 1)
    return list(dict.fromkeys(_RUN.sub("\0", "".join(c for i, c in enumerate(word) if i not in g)) for g in gone))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, strange, skeleton, n): the distinct words with non-ASCII characters; ``strange`` holds signs no clean word has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text and not text.isascii():
                    counts.update(_WORD.findall(text))
            rows = []
            for w, n in counts.items():
                if w.isascii():
                    continue
                bare = w.strip(".,;:!?()[]\"'")
                strange = bool(_STRANGE.search(w) or any(garbled_pairs(w)))
                if strange or _CLEAN_WORD.fullmatch(bare):
                    keys = [skeleton(bare)]
                    if not strange:
                        keys += ["m:" + k for k in swallowed(bare)] + [f"{t}:{skeleton(garble(bare, t))}" for t in MARKED]
                    else:
                        keys += ["m:" + keys[0]] * bool(_WIDE.search(bare)) + [f"{t}:{keys[0]}" for t in MARKED if _TELLS[t].search(w)]
                    rows += [(bare, strange, k, n) for k in keys]
            if rows:
                types = (pa.string(), pa.bool_(), pa.string(), pa.int64())
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["word", "strange", "skeleton", "n"])

    found = documents.where("text is not null").select("text").mapInArrow(run, "word string, strange boolean, skeleton string, n bigint")
    return found.groupBy("word", "strange", "skeleton").agg(F.sum("n").alias("n")).where(F.col("skeleton").rlike("[a-zA-Z]"))


def garbled_pairs(word: str) -> Iterator[str]:
    """Neighbours of non-ASCII signs of which at least one is no letter: clean words have none inside."""
    for m in _RUN.finditer(word):
        part = m[0]
        if len(part) > 1 and any(c.isalpha() for c in part) and any(not c.isalpha() and not unicodedata.combining(c) for c in part[1:]):
            yield part


@lru_cache(maxsize=50_000)
def readings(garbled: str) -> dict[str, list[str]]:
    """Every text the garbled one can have been, with the chains of encodings that explain it."""
    one, many = encodings_known()
    out: dict[str, list[str]] = {}
    for last in (*one, *many):
        text = unread(garbled, last)
        if text is None or text == garbled:
            continue
        out.setdefault(text, []).append(last)
        if not text.isascii():
            for first in one:
                before = unread(text, first)
                if before is not None and before != text:
                    out.setdefault(before, []).append(f"{first}+{last}")
    return out


def infer(garbled: str, clean: str) -> list[str]:
    """The transformations under which each character of the clean word stands as its run in the garbled one."""
    return [*readings(garbled).get(clean, []), *(t for t in MARKED if garble(clean, t) == garbled)]


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """(garbled run, clean run) of two words whose ASCII parts are the same; [] if they are not."""
    if skeleton(garbled) != skeleton(clean):
        return []
    pairs = zip(_RUN.findall(garbled), _RUN.findall(clean), strict=True)
    return [(g, c) for g, c in pairs if g != c]


_VOTES = "chain string, run string, text string, pairs bigint, words bigint"


def votes(documents: DataFrame) -> DataFrame:
    """(chain, run, text, pairs, words): the distinct twin pairs, and the words, that speak for a chain of encodings, or
    for a run standing for a text where no chain explains the word; with no ``text``, the garbled words that hold the run."""
    words = vocabulary(documents)
    bad = words.where("strange").select("skeleton", F.col("word").alias("garbled"), "n")
    good = words.where("not strange").select("skeleton", F.col("word").alias("clean"))
    twins = bad.join(good, "skeleton").groupBy("garbled").agg(F.max("n").alias("n"), F.collect_set("clean").alias("clean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, seen = Counter(), Counter()
            for g, n, cleans in zip(*(batch.column(k).to_pylist() for k in ("garbled", "n", "clean")), strict=True):
                found = [(chain, None, None) for c in cleans for chain in infer(g, c)]
                if not found and len(_NON_ASCII.sub("", g)) >= 2:
                    runs = {(r, t) for c in cleans for r, t in aligned(g, c) if _STRANGE.search(r)}
                    found = [(None, r, t) for r, t in runs] + [(None, r, None) for r in {r for r, _ in runs}]
                pairs.update(found)
                for mark in set(found):
                    seen[mark] += n
            if pairs:
                rows = [(*mark, k, seen[mark]) for mark, k in pairs.items()]
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["chain", "run", "text", "pairs", "words"])

    return twins.mapInArrow(run, _VOTES).groupBy("chain", "run", "text").agg(F.sum("pairs").alias("pairs"), F.sum("words").alias("words"))


def transformations(documents: DataFrame) -> DataFrame:
    """(chain, pairs, words): each transformation with the distinct twin pairs and the words it explains."""
    return votes(documents).where("chain is not null").select("chain", "pairs", "words")


def learned(documents: DataFrame) -> tuple[list[str], dict[str, str]]:
    """(chains, best first; runs no chain explains with the text that nearly all of their words agree on)."""
    found = votes(documents)
    total = F.max(F.when(F.col("text").isNull(), F.col("pairs"))).over(Window.partitionBy("run"))
    sure = found.where("chain is null").withColumn("all", total).where(F.col("text").isNotNull() & (F.col("pairs") >= LEAST_WORDS) & (F.col("pairs") >= AGREED * F.col("all")))
    runs = sure.groupBy("run").agg(F.count("*").alias("k"), F.first("text").alias("text"), F.first("pairs").alias("pairs")).where("k = 1")
    chains = found.where((F.col("chain").isNotNull()) & (F.col("pairs") >= LEAST_PAIRS)).select("chain", "run", "text", "pairs")
    rows = chains.unionByName(runs.select(F.lit(None).cast("string").alias("chain"), "run", "text", "pairs")).limit(MOST_RUNS + 10_000).collect()
    if sum(r.chain is None for r in rows) > MOST_RUNS:
        raise ValueError("more runs without an encoding than MOST_RUNS")
    order = sorted((r for r in rows if r.chain), key=lambda r: (-r.pairs, r.chain))
    return [r.chain for r in order], {r.run: r.text for r in rows if not r.chain}


class Repair:
    """The learned mappings, ready to apply."""

    def __init__(self, learned: list[str], runs: dict[str, str] | None = None) -> None:
        many = encodings_known()[1]
        self.wide = [c for c in learned if c in many]
        order = sorted((c for c in learned if c not in MARKED and c not in many and c.split("+")[-1] not in many), key=lambda c: (-c.count("+"), learned.index(c)))
        table: dict[str, str] = {}
        for chain in order:
            for run, char in mapping(chain).items():
                table.setdefault(run, char)
        known = re.compile("|".join(map(re.escape, table))) if table else None
        for run, text in (runs or {}).items():
            if not (known and known.search(run)):  # else a known run that lost bytes, which may stand for several
                table.setdefault(run, text)
        for c in LETTERS + SIGNS:
            table.pop(c, None)
        self.table = table
        listed = sorted(table, key=len, reverse=True)
        self.runs = re.compile("|".join(map(re.escape, listed))) if listed else None
        #: What is left of a run whose last bytes were lost: it stands before a letter, blank or end.
        heads = sorted({r[:k] for r in listed for k in range(2, len(r))} - set(listed), key=len, reverse=True)
        heads = [h for h in heads if any(not c.isalpha() for c in h[1:]) and h[0].isalpha()]
        self.heads = re.compile("(?:" + "|".join(map(re.escape, heads)) + r")(?=[a-z])") if heads else None
        self.marked = {t: (m := mapping(t), re.compile("|".join(map(re.escape, sorted(m, key=len, reverse=True))))) for t in MARKED if t in learned}

    def undo(self, text: str) -> tuple[str, int]:
        """(restored text, runs replaced or found beyond repair)."""
        n = 0
        if self.wide and _WIDE.search(text):
            text, n = self._undo_wide(text)
        if self.runs:
            text, k = self.runs.subn(lambda m: self.table[m[0]], text)
            n += k
        lost = text.count("�") + (len(self.heads.findall(text)) if self.heads else 0)
        for kind, (table, runs) in self.marked.items():
            if _TELLS[kind].search(text):
                text, k = _undo_marked(text, kind, table, runs)
                n += k
        return text, n + lost

    def _undo_wide(self, text: str) -> tuple[str, int]:
        """Stretches between blanks that a multi-byte encoding took for other scripts."""
        n = 0

        def one(match: re.Match) -> str:
            nonlocal n
            for codec in self.wide:
                made = unread(match[0], codec)
                if made is not None and not _WIDE.search(made):
                    n += 1
                    return made
            return match[0]

        return _WIDE_WORD.sub(one, text), n


def _undo_marked(text: str, kind: str, table: dict[str, str], runs: re.Pattern) -> tuple[str, int]:
    """Words that become syllables, in stretches with a word that gives the encoding away; two such words in all.

    A word with a letter the encoding never shows, or with lost bytes, ends a stretch: it was read rightly, or garbled
    otherwise.
    """
    shown, tell = _shown(kind), _TELLS[kind]
    parts, hits, changes, start = re.split(r"([ \n\t\r]+)", text), 0, {}, 0
    stops = [i for i, part in enumerate(parts) if any(c == "�" or (not c.isascii() and c not in shown and c.isalpha()) for c in part)]
    for stop in [*stops, len(parts)]:
        made = {i: runs.sub(lambda m: table[m[0]], parts[i]) for i in range(start, stop) if not parts[i].isascii()}
        made = {i: w for i, w in made.items() if w != parts[i] and _syllable(re.sub(r"[^\w]", "", w).lower())}
        told = sum(bool(tell.search(parts[i])) for i in made)
        if told:
            hits += told
            changes |= made
        start = stop + 1
    if hits < 2:
        return text, 0
    return "".join(changes.get(i, part) for i, part in enumerate(parts)), len(changes)


@cache
def _shown(kind: str) -> frozenset[str]:
    """Every sign the encoding can show."""
    return frozenset(c for letter in LETTERS for c in garble(letter, kind))


def _syllable(word: str) -> bool:
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if c not in "̣̀́̃̉")
    return bool(_SYLLABLE.match(unicodedata.normalize("NFC", bare)))


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, n_runs, text): every garbled document with its text restored as far as it can be.

    Null and empty texts are not garbled. Replacement signs and runs whose bytes were lost mark a document but stay.
    """
    chains, runs = learned(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(chains, runs)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and not text.isascii() and _SUSPECT.search(text):
                    made, n = repair.undo(text)
                    if n:
                        out.append((doc, n, made))
            if out:
                types = (pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_runs", "text"])

    return documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_runs int, text string")


_WIDE = re.compile("[⺀-\ud7ff豈-\ufaff｟-\uffee]")
_WIDE_WORD = re.compile("[^ \n\t\r]*[⺀-\ud7ff豈-\ufaff｟-\uffee][^ \n\t\r]*")
_SUSPECT = re.compile(f"[^\x00-\x7f{LETTERS}“”‘’–—…]")
