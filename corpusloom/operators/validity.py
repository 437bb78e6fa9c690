"""Predicates over status and dates of legal texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_after(code: Column, effective: Column, expiry: Column, cutoff: str, unknown: bool = True) -> Column:
    """Whether a text holds after the cutoff: in force, or partly; expired only if its expiry lies after; else by dates."""
    at = F.lit(cutoff).cast("date")
    return (
        F.when(code.isin("con_hieu_luc", "het_mot_phan"), True)
        .when(code == "het_hieu_luc", F.coalesce(expiry > at, F.lit(False)))
        .when(effective.isNotNull(), (effective <= at) & F.coalesce(expiry > at, F.lit(True)))
        .otherwise(unknown)
    )


def in_effect_on(day: Column, effective: Column, expiry: Column) -> Column:
    """effective <= day < expiry; an unknown start counts as long past, an unknown end as never."""
    return F.coalesce(effective <= day, F.lit(True)) & F.coalesce(expiry > day, F.lit(True))


def expired(code: Column, status: Column, ended: set[str], holding: set[str], words: list[str]) -> Column:
    """By code where it is known, else by words in the status."""
    low = F.coalesce(F.lower(status), F.lit(""))
    by_words = F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return F.when(code.isin(*sorted(ended)), True).when(code.isin(*sorted(holding)), False).otherwise(by_words)


def in_force(status: Column, markers: list[str]) -> Column:
    """Only with a marker in the status; null and blank are not in force."""
    low = F.coalesce(F.lower(status), F.lit(""))
    return F.exists(F.array(*map(F.lit, markers)), lambda w: low.contains(w))


def status_of_relations(relations: Column, rules: list[tuple[str, str, str | None]], otherwise: str) -> Column:
    """The first (status, prefix, excepted prefix) of which a key with a non-empty value has the prefix."""
    keys = F.map_keys(F.map_filter(relations, lambda k, v: F.size(v) > 0))
    out = None

    def has(prefix: str, excepted: str | None) -> Column:
        return F.exists(keys, lambda k: F.startswith(k, F.lit(prefix)) & (~F.startswith(k, F.lit(excepted)) if excepted else F.lit(True)))

    for status, prefix, excepted in rules:
        hit = has(prefix, excepted)
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out.otherwise(otherwise)
