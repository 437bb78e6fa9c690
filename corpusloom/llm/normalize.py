"""One consistent form for text that looks the same (problem 7).

Every token is judged by the scripts its letters resolve to: each letter has the set of scripts it can be read in, its
own and those of the letters that look like it. If the letters' own scripts have nothing in common, the token is of
mixed script, and it is respelled in a script of the intersection of their resolved sets, Latin first. A token whose
letters all belong to one foreign script but can all be read as Latin is a whole-script confusable: reported, and
respelled only on request, since words wholly in Greek or Cyrillic are content. The script of a letter is taken from its
Unicode name, so every script is covered. What remains (full-width forms, mathematical and script letters, blanks,
invisible signs, uncomposed accents) is normalised by form. Encircled letters and the like are signs, not letters, and
stay. Clean text, nearly all of it, is recognised by one regular expression and never taken apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import delivery_order

# Letters of other scripts that look like the Latin letter before them.
LOOK_ALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻⲎꓧ", "I": "ІΙⲒꓲ", "J": "ЈᎫꓙ",
    "K": "КΚᏦⲔꓗ", "L": "Ꮮꓡ", "M": "МΜᎷⲘꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡᏢⲢꓑ", "Q": "Ԛ", "R": "ᏒꓣᎡ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢⲦꓔ",
    "U": "Սꓴ", "V": "ᏙꓦѴ", "W": "ԜᎳꓪ", "X": "ХΧⲬꓫ", "Y": "УҮΥⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "аα", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ",
    "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уүγ",
}
LATIN_LIKE = {"ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g", "ꞵ": "b"}
# Signs that print nothing, and blanks that are not the plain blank.
INVISIBLE = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
BLANKS = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
ALIKE_SIGNS = {"\u2010": "-", "\u2011": "-", "\u037e": ";", "\u02bc": "'"}
CIRCUMFLEX_LIKE, TONES = "\u031b\u0302\u0306", "\u0323\u0300\u0301\u0303\u0309"

_TO_LATIN = {c: latin for latin, alike in LOOK_ALIKES.items() for c in alike}
_CLEAN = "".join(
    sorted(
        {unicodedata.normalize("NFC", b + m) for b in "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY" for m in ["", *TONES]} | set("đĐ")
    )
)
_SUSPECT = re.compile(f"[^\n\t\r -~{_CLEAN}“”‘’–—…«»²³¹½¼¾№§°·•×£€©®]")
_INVISIBLE = re.compile(f"[{INVISIBLE}\U000e0000-\U000e007f\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_BLANK = re.compile(f"[{BLANKS}]")
_SCRIPT_LETTERS = "".join(c for c in map(chr, range(0x2100, 0x2150)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c).isascii())
_WIDE = re.compile(f"[\uff01-\uff5e\ufb00-\ufb06\U0001d400-\U0001d7ff{_SCRIPT_LETTERS}]")
_MARKS = re.compile("[\u0300-\u036f]")
_MARK_RUN = re.compile(f"[{CIRCUMFLEX_LIKE}{TONES}]{{2,}}")
_FOREIGN = re.compile("[Ͱ-ԯἀ-῿" + "".join(_TO_LATIN) + "]")
_CHUNK = re.compile(r"\S*" + _FOREIGN.pattern + r"\S*")
_LETTERS = re.compile(r"[^\W\d_][^\W\d_\u0300-\u036f]*(?:[\u0300-\u036f][^\W\d_]*)*")
_LATIN_LIKE = re.compile("[" + "".join(LATIN_LIKE) + "]")


@cache
def script(char: str) -> str:
    """The script of a letter, by the first word of its Unicode name; '' for what is no letter of a script."""
    if unicodedata.category(char)[0] != "L":
        return ""
    first = unicodedata.name(char, "").split(" ")[0]
    return "" if first in ("MODIFIER", "MATHEMATICAL", "FEMININE", "MASCULINE", "MICRO") else first


@cache
def spellings(char: str) -> dict[str, str]:
    """How a letter can be spelled in each script that has it or a look-alike; {} for signs, which any script takes."""
    own = script(char)
    if not own:
        return {}
    latin = _TO_LATIN.get(char, char if char in LOOK_ALIKES else None)
    out = {script(c): c for c in reversed(LOOK_ALIKES[latin])} | {"LATIN": latin} if latin else {}
    return out | {own: char}


def judge(token: str) -> str:
    """'single', 'mixed' or 'whole' (all letters of one foreign script, each with a Latin look-alike)."""
    own = {s for c in token if (s := script(c))}
    if len(own) > 1:
        return "mixed"
    return "whole" if own and own != {"LATIN"} and all("LATIN" in spellings(c) for c in token if script(c)) else "single"


def respell(token: str, whole_script: bool = False) -> str:
    """The token in a script in which every letter has a spelling: Latin, else the commonest; unchanged if there is none."""
    kind = judge(token)
    if kind == "single" or (kind == "whole" and not whole_script):
        return token
    letters = [c for c in token if script(c)]
    common = set.intersection(*(set(spellings(c)) for c in letters))
    if not common:
        return token
    counts = Counter(map(script, letters))
    chosen = min(common, key=lambda s: (s != "LATIN", -counts[s], s))
    return "".join(spellings(c).get(chosen, c) for c in token)


def _chunk(match: re.Match, whole_script: bool) -> str:
    chunk = match[0]
    if "/" in chunk and any(c.isdigit() for c in chunk):  # a law code is one token
        return respell(chunk, whole_script)
    return _LETTERS.sub(lambda m: respell(m[0], whole_script), chunk)


def _marks(match: re.Match) -> str:
    return "".join(sorted(match[0], key=lambda c: (c not in CIRCUMFLEX_LIKE, unicodedata.combining(c))))


def consistent(text: str | None, whole_script: bool = False) -> str | None:
    """The consistent form: composed letters, plain Latin letters, digits, punctuation and blanks, nothing invisible.

    None stays None, '' stays ''. Doubled and outer plain blanks, and signs that are content, stay.
    """
    if not text or not _SUSPECT.search(text):
        return text
    text = _BLANK.sub(" ", _INVISIBLE.sub("", text))
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    for odd, plain in ALIKE_SIGNS.items():
        if odd in text:
            text = text.replace(odd, plain)
    if _MARKS.search(text):
        text = unicodedata.normalize("NFC", _MARK_RUN.sub(_marks, unicodedata.normalize("NFD", text)))
    text = _LATIN_LIKE.sub(lambda m: LATIN_LIKE[m[0]], text)
    if _FOREIGN.search(text):
        text = _CHUNK.sub(lambda m: _chunk(m, whole_script), text)
        text = unicodedata.normalize("NFC", text)
    return text


WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the consistent form, in lower case; [] for None."""
    return WORD.findall(consistent(text).lower()) if text else []


_FOLD = str.maketrans(
    {c: unicodedata.normalize("NFD", c)[0] for c in _CLEAN if c not in "đĐ"} | {"đ": "d", "Đ": "D"}
)


def fold(text: str) -> str:
    """Without accents, đ = d; case is kept."""
    out = text.translate(_FOLD)
    if out.isascii():
        return out
    return "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c))


def add_differs(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and, for each field, ``{field}_differs``: whether its consistent form is another text. Null: false."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {k: batch.column(k) for k in keep}
            for field in fields:
                texts = batch.column(field).to_pylist()
                made[f"{field}_differs"] = pa.array([bool(t) and consistent(t) != t for t in texts], pa.bool_())
            yield pa.RecordBatch.from_pydict(made)

    small = df.select(*keep, *fields)
    schema = T.StructType(
        [small.schema[k] for k in keep] + [T.StructField(f"{f}_differs", T.BooleanType()) for f in fields]
    )
    return small.mapInArrow(run, schema)


def field_cases(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(src, item_key, field) of every record and registry field whose text differs from its consistent form.

    A record's earliest delivery counts. Only flags are shuffled, never texts. Rows without key are no items.
    """
    flags = ["content_differs", "law_name_differs"]
    seen = add_differs(
        records.select("id", delivery_order().alias("at"), "content", "law_name").where(F.col("id").isNotNull()),
        ["content", "law_name"],
        ["id", "at"],
    )
    # only ids with a flagged delivery can have a case: the others never reach the shuffle's final rows
    first = seen.groupBy("id").agg(F.min(F.struct("at", *flags)).alias("f")).where(F.col("f.content_differs") | F.col("f.law_name_differs"))
    cases = F.array_compact(F.array(F.when(F.col("f.content_differs"), "content"), F.when(F.col("f.law_name_differs"), "law_name")))
    from_records = first.select(
        F.lit("legal_knowledge_records").alias("src"), F.col("id").cast("string").alias("item_key"), F.explode(cases).alias("field")
    )
    titles = add_differs(registry.where(F.col("doc_code").isNotNull()), ["canonical_title"], ["doc_code"])
    from_titles = titles.where("canonical_title_differs").select(
        F.lit("legal_doc_registry").alias("src"), F.col("doc_code").alias("item_key"), F.lit("canonical_title").alias("field")
    )
    return from_records.unionByName(from_titles.distinct())
