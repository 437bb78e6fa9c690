"""All named queries of the core."""

from __future__ import annotations

from corpusloom.plans import answers, corpus, filters, general, inout, language, parts, relations, retrieval, rules, selects

MODULES = (general, retrieval, corpus, rules)
NAMED = (language, filters, relations, selects, answers, parts, inout)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {k: v for m in NAMED for k, v in m.query.queries.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()} | {k: v for m in NAMED for k, v in m.query.oracle.items()}


def flagship(spark, sf_dir):
    return retrieval.bm25_family(spark, sf_dir)
