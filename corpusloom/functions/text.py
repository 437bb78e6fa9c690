"""Scalar text functions as column expressions; language-specific patterns come from a profile."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
# Accented Vietnamese letters and their base letters.
ACCENTED = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
BASE = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


@dataclass(frozen=True)
class Profile:
    """Patterns of one language and document family."""

    article: str = r"(?i)\b(?:article|section|§)\s*(\d+[a-z]?)"
    code: str = r"\d{1,4}/\d{4}/\p{Lu}+(?:-\p{Lu}+)?"
    article_header: str = r"(?m)^(?:Article|Section)\s+(\d+)"


VIETNAMESE = Profile(article=r"(?iu)đi[eề]u\s+(\d+[a-zđ]?)", article_header=r"(?m)^Điều\s+(\d+)")


def clean_null(text: Column) -> Column:
    """Null for blank and 'nan'; trimmed otherwise."""
    return F.when((F.trim(text) == "") | (F.lower(F.trim(text)) == "nan"), None).otherwise(F.trim(text))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def long_tokens(text: Column) -> Column:
    """``tokens`` of two signs or more."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), F.array().cast("array<string>"))


def blank_tokens(text: Column) -> Column:
    """What stands between blanks, in lower case: for texts that were cut into words before."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([^ \t\n\r\f\x0b]+)"), 1), F.array().cast("array<string>"))


def unaccented(text: Column) -> Column:
    """Lower case without Vietnamese accents, đ = d."""
    return F.translate(F.lower(text), ACCENTED, BASE)


def code_of(text: Column, profile: Profile = VIETNAMESE) -> Column:
    return F.nullif(F.regexp_extract(text, f"({profile.code})", 1), F.lit(""))


def article_numbers(text: Column, profile: Profile = VIETNAMESE) -> Column:
    """Distinct article numbers with their letter suffix, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(profile.article), 1), F.lower))


def year_of_code(code: Column) -> Column:
    """The year in a code, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(code, r"/(\d{4})/", 1), F.lit("")).cast("int"), F.lit(0))


def mixed_date(text: Column) -> Column:
    """A date in one of the three spellings, tried in order; null if impossible."""
    return F.coalesce(*[F.try_to_date(F.when(text.rlike(p), text), f) for p, f in ((r"^\d\d/\d\d/\d{4}$", "dd/MM/yyyy"), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"), (r"^\d\d-\d\d-\d{4}$", "dd-MM-yyyy"))])


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters; empty for shorter texts."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, a line per block tag, the common entities decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def softmax_first(a: Column, b: Column) -> Column:
    """Probability of the first of two logits."""
    return 1 / (1 + F.exp(b - a))


def roman(number: Column) -> Column:
    """1..3999 as a Roman numeral; null outside."""
    # The numerals of ones, tens, hundreds and thousands.
    ones, tens = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
    hundreds, thousands = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]
    pick = lambda listed, i: F.array(*map(F.lit, listed))[i.cast("int")]
    made = F.concat(pick(thousands, F.floor(number / 1000)), pick(hundreds, F.floor(number % 1000 / 100)), pick(tens, F.floor(number % 100 / 10)), pick(ones, number % 10))
    return F.when((number >= 1) & (number <= 3999), made)


def alpha(number: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa ...; null below 1."""
    letter = lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (n % 26 + 1).cast("int"), F.lit(1))
    n = number - 1
    one, two = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    made = F.concat(F.when(two >= 0, letter(two)).otherwise(""), F.when(one >= 0, letter(one)).otherwise(""), letter(n))
    return F.when((number >= 1) & (number <= 18278), made)


def normalized(text: Column, form: str = "NFC") -> Column:
    """A Unicode normal form, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return made(text)


def tone_pairs() -> list[tuple[str, str]]:
    """(old, new) places of the tone mark in oa, oe and uy, in lower, title and upper case."""
    out = []
    for first, second in (("o", "a"), ("o", "e"), ("u", "y")):
        for mark in "̣̀́̉̃":
            old, new = unicodedata.normalize("NFC", first + mark + second), unicodedata.normalize("NFC", first + second + mark)
            out += [(old, new), (old.capitalize(), new.capitalize()), (old.upper(), new.upper())]
    return out


def tones_moved(text: Column) -> Column:
    """Tone marks of oa, oe and uy on the second vowel."""
    for old, new in tone_pairs():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def title_without(title: Column, code: Column, tails: list[str]) -> Column:
    """White space collapsed, the first of the ``tails`` (patterns) and all behind it cut off, 'số' and the code left out."""
    cut = F.regexp_replace(collapsed(title), r"(?iu)\s+(?:" + "|".join(tails) + r")(?![\p{L}\p{N}_]).*$", "")
    named = F.concat(F.lit(r"(?iu)\s+số\s+\Q"), F.coalesce(code, F.lit("")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return collapsed(F.when(F.coalesce(code, F.lit("")) == "", cut).otherwise(F.regexp_replace(cut, named, "")))


def name_cleaned(name: Column, code: Column, prefix: str, tail: str) -> Column:
    """A name without prefix and tail (patterns), 'số' and the code anywhere, and separators at its ends."""
    bare = F.regexp_replace(name, rf"(?iu)^\s*{prefix}\s*:\s*", "")
    bare = F.regexp_replace(bare, F.concat(F.lit(r"(?iu)\s*số\s+\Q"), F.coalesce(code, F.lit("")), F.lit(r"\E")), "")
    return F.regexp_replace(collapsed(F.regexp_replace(bare, rf"(?iu)\s*{tail}.*$", "")), r"^[ |–-]+|[ |–-]+$", "")


def worded_date(text: Column, before: list[str]) -> Column:
    """The date of 'ngày d tháng m năm y' behind the first of the phrases that is there; null if it is impossible."""
    out = None
    for phrase in before:
        parts = [F.regexp_extract(text, rf"(?iu){phrase}\s+(\d{{1,2}})\s+tháng\s+(\d{{1,2}})\s+năm\s+(\d{{4}})", k) for k in (1, 2, 3)]
        found = F.when(parts[2] != "", F.concat_ws("-", parts[2], F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")))
        out = found if out is None else F.coalesce(out, found)
    return F.try_to_date(out, "yyyy-MM-dd")


def code_tokens(text: Column) -> Column:
    """Lower-case words and numbers, with codes such as 22/2023/qh15 kept whole."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+/[\p{L}\p{N}_/.-]+|\p{L}+|\d+)"), 1), F.array().cast("array<string>"))


def replaced_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Phrases replaced one after another."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def search_tokens(text: Column, synonyms: list[tuple[str, str]], stopwords: list[str], code: str = r"\d+/\d+(?:/\p{Lu}[\p{Lu}-]*)?") -> Column:
    """Tokens of two letters or more after synonyms and without stopwords, and the codes once more, whole."""
    words = F.filter(tokens(replaced_in_order(F.lower(text), synonyms)), lambda w: (F.length(w) > 1) & ~w.isin(stopwords))
    return F.concat(words, F.coalesce(F.regexp_extract_all(text, F.lit(f"({code})"), 1), F.array().cast("array<string>")))


def content_tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct words without accents and stopwords, in order of first mention."""
    return F.array_except(tokens(unaccented(text)), F.array(*map(F.lit, stopwords)).cast("array<string>"))


def first_label(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The label of the first rule with a keyword in the text, case ignored."""
    low, out = F.coalesce(F.lower(text), F.lit("")), None
    for label, words in rules:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def page_text(html: Column) -> Column:
    """struct(title, text) of a page by an HTML parser: scripts skipped, a line per block tag, all entities decoded."""

    @F.pandas_udf("title string, text string")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_page(p) for p in pages], columns=["title", "text"])

    return read(html)


def _page(html: str | None) -> tuple[str | None, str | None]:
    from html.parser import HTMLParser

    if html is None:
        return None, None
    # Tags without text of their own, and tags that end a line.
    skipped, blocks = {"script", "style", "noscript", "svg"}, {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "title", "table", "ul", "ol", "section", "article"}
    parts: list[str] = []
    title: list[str] = []

    class Reader(HTMLParser):
        hidden, in_title = 0, False

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in skipped
            self.in_title = self.in_title or tag == "title"
            if tag in blocks:
                parts.append("\n")

        def handle_endtag(self, tag):
            self.hidden = max(0, self.hidden - (tag in skipped))
            self.in_title = self.in_title and tag != "title"
            if tag in blocks:
                parts.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                (title if self.in_title else parts).append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", line).strip(" ") for line in "".join(parts).split("\n"))
    return " ".join("".join(title).split()) or None, "\n".join(line for line in lines if line)


def paragraphs_of(html: Column, css_class: str) -> Column:
    """The texts of the paragraphs of a class."""
    found = F.regexp_extract_all(html, F.lit(rf'(?is)<p\b[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*>(.*?)</p\s*>'), 1)
    return F.transform(found, html_text)


def markdown_table(rows: Column) -> Column:
    """An array of arrays of strings as lines '| a | b |'; null cells are empty."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))), "\n")


def without_labels(text: Column, labels: list[str]) -> Column:
    """Without thoughts in think tags and labels such as 'Answer:' at the start."""
    bare = F.regexp_replace(text, r"(?is)<think>.*?(?:</think>|$)", "")
    return F.trim(F.regexp_replace(bare, r"(?iu)^\s*(?:" + "|".join(labels) + r")\s*:\s*", ""))


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def snippet(text: Column, most: int) -> Column:
    """At most so many characters, an ellipsis in place of the rest."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def first_tokens(text: Column, most: int) -> Column:
    """The first words of a text, with one blank between them."""
    words = F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, most), " ")


def json_in(text: Column, schema: str) -> Column:
    """The JSON object that stands in a text, from the first brace to the last."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def slug(text: Column) -> Column:
    """Plain letters and digits with hyphens between them."""
    return F.regexp_replace(F.regexp_replace(unaccented(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def expanded_labels(label: Column, prefix: str = "Điều ") -> Column:
    """'12_13' as ['Điều 12', 'Điều 13']; blank parts are left out."""
    bare = F.regexp_replace(F.trim(label), rf"(?iu)^{prefix.strip()}\s+", "")
    return F.transform(F.filter(F.split(bare, "_"), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit(prefix), F.trim(p)))


def name_in_url(url: Column) -> Column:
    """The words of the last part of an address, without suffix and number."""
    last = F.regexp_replace(F.regexp_extract(url, r"/([^/]+)/*$", 1), r"(?i)\.(?:aspx|html?)$", "")
    return F.trim(F.replace(F.regexp_replace(last, r"-\d+$", ""), F.lit("-"), F.lit(" ")))


def from_latin1(text: Column) -> Column:
    """UTF-8 read as Latin-1, put right; unchanged where it is not."""
    data = F.encode(text, "ISO-8859-1")
    fits = ~text.rlike(r"[^\x{00}-\x{ff}]") & F.is_valid_utf8(data)
    return F.when(fits, F.decode(data, "UTF-8")).otherwise(text)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a lambda function an expression is computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mentions(text: Column, pattern: str) -> Column:
    """array<struct<text, at>>: every match of a pattern without groups, with its place from 0."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.array().cast("array<string>"))
    kind = "struct<at:int,out:array<struct<text:string,at:int>>>"

    def add(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["gap"])
        here = F.struct(x["text"].alias("text"), at.alias("at"))
        return F.struct((at + F.length(x["text"])).alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,at:int>>").alias("out")).cast(kind)
    # as many gaps as matches: the last piece of the split stands behind all of them
    pairs = bound(found, lambda f: F.zip_with(F.slice(F.split(F.coalesce(text, F.lit("")), pattern), F.lit(1), F.size(f)), f, lambda gap, m: F.struct(gap.alias("gap"), m.alias("text"))))
    return F.aggregate(pairs, start, add, lambda s: s["out"])


def segmented(df, column: str, segmenter: Callable[[str], list[str]] | None = None):
    """``df`` with ``words``: those a segmenter (text -> words) gives, in Arrow batches; by default ``tokens``, in the JVM."""
    if segmenter is None:
        return df.withColumn("words", tokens(F.col(column)))

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [] if x is None else list(segmenter(x)))

    return df.withColumn("words", words(F.col(column)))


def clauses(text: Column, connectives: str, least: int, most: int) -> Column:
    """The first clauses of at least so many characters between connectives (a pattern)."""
    parts = F.transform(F.split(text, connectives), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: F.length(x) >= least), 1, most)


def without_lines(text: Column, equal: list[str], holding: list[str]) -> Column:
    """Without the lines that, trimmed, equal one of a list, or hold one of some markers, case ignored."""

    def bad(line: Column) -> Column:
        out = F.trim(line).isin(equal)
        for marker in holding:
            out = out | F.lower(line).contains(marker)
        return out

    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~bad(x)), "\n")



def letters_only(text: Column) -> Column:
    """Lower-case runs of letters and digits with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def groups_in(text: Column, groups: list[tuple[str, str]]) -> Column:
    """The names of the (name, phrase) groups of which the text holds the phrase, case ignored."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(phrase), name) for name, phrase in groups]))
