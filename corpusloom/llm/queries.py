"""Named queries of the operators for training text."""

from __future__ import annotations

import re

from corpusloom.llm import canon, leakage, mojibake, neardup, normalize, packing, split
from corpusloom.plans.general import trees_sql
from corpusloom.session import tune
from corpusloom.sources.tables import table, wide


def _records(spark, sf_dir, *columns):
    return wide(tune(spark), sf_dir, "legal_knowledge_records", "id", "ingested_at", *columns)


def p1_pieces(spark, sf_dir):
    return split.all_pieces(_records(spark, sf_dir, "content"), wide(spark, sf_dir, "tree_output"))


def p1_found(spark, sf_dir):
    return p1_pieces(spark, sf_dir).where("piece = 1 and n_pieces > 1").select("src", "item_id", "node_path")


def p2_found(spark, sf_dir):
    return p2_mapped(spark, sf_dir).select("id", "doc_code")


def p2_mapped(spark, sf_dir):
    return canon.mapped_records(_records(spark, sf_dir, "law_name"), table(spark, sf_dir, "legal_doc_registry"))


def p2_unmatched(spark, sf_dir):
    return canon.unmatched_names(_records(spark, sf_dir, "law_name"), table(spark, sf_dir, "legal_doc_registry"))


def p4_found(spark, sf_dir):
    return neardup.similar_records(_records(spark, sf_dir, "content"))


def p4_groups(spark, sf_dir):
    return neardup.similar_groups(_records(spark, sf_dir, "content"))


def p4_pairs(spark, sf_dir):
    """Similar pairs of representatives; p4_members has the records they stand for."""
    return neardup.similar_representatives(_records(spark, sf_dir, "content"))


def p4_members(spark, sf_dir):
    return neardup.representatives(_records(spark, sf_dir, "content"))


def p7_found(spark, sf_dir):
    return normalize.field_cases(_records(spark, sf_dir, "content", "law_name"), table(spark, sf_dir, "legal_doc_registry"))


def p8_containers(spark, sf_dir):
    return packing.containers(wide(tune(spark), sf_dir, "documents", "doc_id", "text"))


def p8_report(spark, sf_dir):
    return packing.packing_report(p8_containers(spark, sf_dir))


def p10_found(spark, sf_dir):
    return p10_restored(spark, sf_dir).select("doc_id").distinct()


def p10_restored(spark, sf_dir):
    return mojibake.restored(wide(tune(spark), sf_dir, "documents", "doc_id", "text"))


def p10_transformations(spark, sf_dir):
    return mojibake.transformations(wide(tune(spark), sf_dir, "documents", "doc_id", "text"))


def p9_found(spark, sf_dir):
    return leakage.leaks(wide(tune(spark), sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p9_spans(spark, sf_dir):
    return leakage.leaked_spans(wide(tune(spark), sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p9_cleaned(spark, sf_dir):
    return leakage.without_leaks(wide(tune(spark), sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


QUERIES = (p8_containers, p8_report, p10_found, p10_restored, p10_transformations, p2_found, p2_mapped, p2_unmatched, p9_found, p9_spans, p9_cleaned, p1_found, p1_pieces, p4_found, p4_groups, p4_pairs, p4_members, p7_found)


def queries():
    return {f.__name__: f for f in QUERIES}


def _consistent_sql(c: str) -> str:
    """The consistent form as SQL can say it: signs and letters one by one, without a look at whole tokens."""
    pairs = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | normalize._TO_LATIN | normalize.LATIN_LIKE
    old, new = "".join(pairs), "".join(pairs.values()).replace("'", "''")
    bare = f"regexp_replace(regexp_replace({c}, '[{_re2(normalize.INVISIBLE)}\\x00-\\x08\\x0e-\\x1f]', '', 'g'), '[{_re2(normalize.BLANKS)}]', ' ', 'g')"
    return f"translate(nfc_normalize({bare}), '{old}', '{new}')"


def _re2(signs: str) -> str:
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", signs)


def _first_sql(c: str) -> str:
    return f"SELECT id, arg_min({c}, coalesce(ingested_at, TIMESTAMP '9999-12-31')) {c} FROM legal_knowledge_records WHERE id IS NOT NULL GROUP BY id"


_FOREIGN_WORD = r"(^|[^\p{L}\p{M}/])(\p{Cyrillic}+|\p{Greek}+)([^\p{L}\p{M}/]|$)"
_PIECES = r"len(regexp_extract_all({c}, '[^ \t\n\r\f\x0b\x{{85}}\x{{2028}}\x{{2029}}]+'))"
_WORDS = r"regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+')"
_GRAMS = "list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))"


def oracle_sql():
    """DuckDB SQL of what can be said without the methods: sizes, shared runs of words, similarity by brute force."""
    kid = "json_extract_string(kid, '$.content')"
    trees = trees_sql(", content", f", {kid}")
    p1 = f"{trees} SELECT 'tree_output' src, tree_id item_id, node_path FROM t WHERE {_PIECES.format(c=_consistent_sql('content'))} > 1024 UNION ALL SELECT 'legal_knowledge_records', id, '' FROM ({_first_sql('content')}) WHERE {_PIECES.format(c=_consistent_sql('content'))} > 1024"
    plain = lambda c: f"replace(strip_accents(lower({_consistent_sql(c)})), 'đ', 'd')"
    p9 = f"""WITH i AS (SELECT id, unnest({_GRAMS.format(n=12)}) g FROM (SELECT id, {_WORDS.format(c=plain('x'))} w FROM (SELECT id, question x FROM eval_items UNION ALL SELECT id, answer FROM eval_items) WHERE x IS NOT NULL)),
d AS (SELECT doc_id, unnest({_GRAMS.format(n=12)}) g FROM (SELECT doc_id, {_WORDS.format(c=plain('text'))} w FROM documents WHERE text IS NOT NULL)) SELECT DISTINCT doc_id, id item_id FROM d JOIN i USING (g)"""
    base = f"""r AS (SELECT id, {_WORDS.format(c=f"lower({_consistent_sql('content')})")} w FROM ({_first_sql('content')}) WHERE content IS NOT NULL), s AS (SELECT id, {_GRAMS.format(n=3)} l FROM r WHERE len(w) >= 30), g AS (SELECT id, len(l) n, unnest(l) g FROM s), k AS (SELECT a.id id_a, b.id id_b, a.n na, b.n nb, count(*) k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY ALL), p AS (SELECT id_a, id_b, k / (na + nb - k) similarity FROM k WHERE k >= 0.7 * (na + nb - k))"""
    heads = "m AS (SELECT id, CASE WHEN len(w) >= 30 THEN min(id) OVER (PARTITION BY w) ELSE id END representative FROM r)"
    p4 = {
        "p4_found": f"WITH {base} SELECT id_a, id_b FROM p",
        "p4_pairs": f"WITH {base}, {heads} SELECT id_a, id_b, similarity FROM p JOIN m a ON id_a = a.id AND a.representative = id_a JOIN m b ON id_b = b.id AND b.representative = id_b",
        "p4_members": f"WITH {base}, {heads} SELECT i.id, coalesce(representative, i.id) representative FROM (SELECT DISTINCT id FROM legal_knowledge_records WHERE id IS NOT NULL) i LEFT JOIN m USING (id)",
        "p4_groups": f'WITH RECURSIVE {base}, e AS (SELECT id_a a, id_b b FROM p UNION ALL SELECT id_b, id_a FROM p), c(id, r) AS (SELECT DISTINCT id, id FROM legal_knowledge_records WHERE id IS NOT NULL UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a) SELECT id, min(r) "group" FROM c GROUP BY id',
    }
    # words wholly in one foreign script are content: they are left out before the comparison, twice as neighbours share a blank
    own = lambda c: f"regexp_replace(regexp_replace({c}, '{_FOREIGN_WORD}', '\\1\\3', 'g'), '{_FOREIGN_WORD}', '\\1\\3', 'g')"
    differs = lambda c: f"{own(c)} <> {_consistent_sql(own(c))}"
    records = " UNION ALL ".join(f"SELECT 'legal_knowledge_records' src, CAST(id AS VARCHAR) item_key, '{c}' field FROM ({_first_sql(c)}) WHERE {differs(c)}" for c in ("content", "law_name"))
    p7 = f"{records} UNION ALL SELECT DISTINCT 'legal_doc_registry', doc_code, 'canonical_title' FROM legal_doc_registry WHERE doc_code IS NOT NULL AND {differs('canonical_title')}"
    return {"p1_found": p1, "p9_found": p9, "p7_found": p7, **p4}
