"""Several values packed in one field (problem 6), as column expressions.

The field is split on its quote sign: odd pieces are literals, even pieces hold the delimiters. Delimiters of
the even pieces become one private separator, the pieces are joined again and split on it, so a delimiter
inside quotes never splits. A doubled quote leaves an empty even piece between two literals and is put back.
A quote that opens amid a bare value belongs to the value. Everything runs inside the JVM.

Results: null and blank fields give an empty array; blank and null members are left out; text in round
brackets stays with its value; values are trimmed of Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import bound
from corpusloom.sources.tables import first_delivery

#: Private signs; where a field holds one of them itself, it stands as ``KEPT`` and its number until the end.
SEP, ESCAPED_QUOTE, ESCAPED_SLASH, KEPT = "\ue000", "\ue001", "\ue002", "\ue003"
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A complete reference ends in a pipe and an article; only after one, or at the start, does a bare comma divide.
ARTICLE_END = r"\|\s*+(?:(?iu:điều)\s*+)?\d++\p{L}?+\s*+\.?+(?:\s*+\([^()]*+\))?+\s*+"
REFERENCE_RULES = [
    (r"\s*[;；\t\r\n](?:\s*[;；\t\r\n])*\s*", SEP),
    (rf"(^|{SEP})\s*,(?:\s*,)*\s*", f"$1{SEP}"),
    (rf"({ARTICLE_END}),(?:\s*,)*\s*", f"$1{SEP}"),
]
LIST_RULES = [(r"\s*(?:[,;；、/&\t\r\n]|(?<=\s)(?iu:và|and)(?=\s))(?![^()]*\))\s*", SEP)]
CONTAINER_RULES = [(r"\s*,\s*", SEP), (rf"(?<![^\s{SEP}])(?:null|None|NULL)(?![^\s{SEP}])", "")]
_OPENS = r"(?:^|[,;；、/&\t\r\n\[{]|\s(?:và|and)\s)\s*$"


def _ruled(piece: Column, rules: list[tuple[str, str]]) -> Column:
    for rule, to in rules:
        piece = F.regexp_replace(piece, rule, to)
    return piece


def _kept(field: Column) -> Column:
    """The field without private signs of its own."""
    held = field.rlike(f"[{SEP}{ESCAPED_QUOTE}{ESCAPED_SLASH}{KEPT}]")
    out = F.replace(field, F.lit(KEPT), F.lit(KEPT + "3"))
    for n, sign in enumerate((SEP, ESCAPED_QUOTE, ESCAPED_SLASH)):
        out = F.replace(out, F.lit(sign), F.lit(f"{KEPT}{n}"))
    return F.when(held, out).otherwise(field)


def _given_back(value: Column) -> Column:
    out = value
    for n, sign in enumerate((SEP, ESCAPED_QUOTE, ESCAPED_SLASH, KEPT)):
        out = F.replace(out, F.lit(f"{KEPT}{n}"), F.lit(sign))
    return F.when(value.contains(KEPT), out).otherwise(value)


def trimmed(text: Column) -> Column:
    """Without white space around it, Unicode blanks included."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def _unescaped(piece: Column) -> Column:
    """A JSON literal with backslashes, read by the JSON parser; as it stands if it is none."""
    again = F.replace(F.replace(piece, F.lit(ESCAPED_QUOTE), F.lit('\\"')), F.lit(ESCAPED_SLASH), F.lit("\\\\"))
    parsed = F.from_json(F.concat(F.lit('["'), again, F.lit('"]')), "array<string>")[0]
    return F.when(again.contains("\\"), F.coalesce(parsed, again)).otherwise(piece)


def packed_values(field: Column, rules: list[tuple[str, str]]) -> Column:
    """The values of a field that may be a JSON array, a printed list or set, quoted or bare delimited text."""
    field = _kept(field)
    container = field.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$")
    single = container & field.rlike(r"^\s*[\[{]\s*(?:(?:None|null)?\s*,\s*)*'")
    plain = F.when(
        container,
        F.replace(F.replace(field, F.lit("\\\\"), F.lit(ESCAPED_SLASH)), F.lit('\\"'), F.lit(ESCAPED_QUOTE)),
    ).otherwise(field)
    bare = F.regexp_replace(plain, r"^\s*[\[{]|[\]}]\s*$", "")
    pieces = F.when(single, F.split(bare, "'")).when(container, F.split(bare, '"')).otherwise(F.split(plain, '"'))

    def in_container(piece: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, _ruled(piece, CONTAINER_RULES)).otherwise(_unescaped(piece))

    def in_text(all_pieces: Column):
        def one(piece: Column, i: Column) -> Column:
            inner = (i > 0) & (i < F.size(all_pieces) - 1)
            outside = (
                F.when(inner & (piece == ""), F.lit('"'))
                .when(inner & (F.trim(piece) == ""), F.lit(SEP))
                .otherwise(_ruled(piece, rules))
            )
            before = F.element_at(all_pieces, i)  # i counts from 0, element_at from 1: the piece before
            opens = before.rlike(_OPENS) | ((i > 1) & (before == ""))
            closed = i < F.size(all_pieces) - 1
            literal = F.when(opens & closed, piece).otherwise(
                F.concat(F.lit('"'), F.when(closed, piece).otherwise(_ruled(piece, rules)), F.when(closed, '"').otherwise(""))
            )
            return F.when(i % 2 == 0, outside).otherwise(literal)

        return one

    # most fields hold no quote: they need no folding
    simple = ~container & ~field.contains('"')
    text = (
        F.when(simple, _ruled(field, rules))
        .when(container, F.array_join(F.transform(pieces, in_container), ""))
        .otherwise(bound(pieces, lambda ps: F.array_join(F.transform(ps, in_text(ps)), "")))
    )
    values = F.transform(F.split(text, SEP), lambda v: trimmed(_given_back(F.translate(v, ESCAPED_QUOTE + ESCAPED_SLASH, '"\\'))))
    return F.coalesce(F.filter(values, lambda v: v != ""), F.array().cast("array<string>"))


def articles_of(field: Column) -> Column:
    """The values of an ``article`` field."""
    return packed_values(field, LIST_RULES)


def references_of(field: Column) -> Column:
    """The references of an ``extra`` field."""
    return packed_values(field, REFERENCE_RULES)


def value_rows(records: DataFrame) -> DataFrame:
    """(id, field, pos, value): one row per value of ``article`` and ``extra``, of each record's first delivery."""
    first = first_delivery(records, "id", "ingested_at", ["article", "extra"])
    fields = F.array(
        F.struct(F.lit("article").alias("field"), articles_of(F.col("article")).alias("vals")),
        F.struct(F.lit("extra").alias("field"), references_of(F.col("extra")).alias("vals")),
    )
    return (
        first.select("id", F.explode(fields).alias("f"))
        .select("id", F.col("f.field").alias("field"), F.size("f.vals").alias("n"), F.posexplode("f.vals").alias("pos", "value"))
        .select("id", "field", (F.col("pos") + 1).cast("bigint").alias("pos"), "value", "n")
    )


def packed_cases(records: DataFrame) -> DataFrame:
    """``value_rows`` of the fields with two or more values."""
    return value_rows(records).where("n >= 2").drop("n")
