"""Named queries of the general data problems, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

from corpusloom.operators import nested, packed, references
from corpusloom.session import tune
from corpusloom.sources.tables import table, wide


def p3_found(spark, sf_dir):
    return nested.node_links(wide(tune(spark), sf_dir, "tree_output"))


def p3_nodes(spark, sf_dir):
    return nested.flat_nodes(wide(tune(spark), sf_dir, "tree_output"))


def p3_broken(spark, sf_dir):
    """Nodes whose child list cannot be read."""
    return nested.broken_children(wide(tune(spark), sf_dir, "tree_output"))


def _orphans(spark, sf_dir):
    return references.orphans(wide(tune(spark), sf_dir, "legal_knowledge_records", "id", "law_id", "article", "extra", "ingested_at"), table(spark, sf_dir, "legal_doc_registry"))


def p5_found(spark, sf_dir):
    return _orphans(spark, sf_dir).drop("field").distinct()


def p5_counts(spark, sf_dir):
    return references.orphan_counts(_orphans(spark, sf_dir))


def p6_found(spark, sf_dir):
    return packed.packed_cases(wide(tune(spark), sf_dir, "legal_knowledge_records", "id", "article", "extra", "ingested_at"))


QUERIES = {f.__name__: f for f in (p3_found, p3_nodes, p3_broken, p5_found, p5_counts, p6_found)}

def trees_sql(root: str = "", kid: str = "") -> str:
    """The recursive table t(tree_id, node_path, parent_path, kids) of all nodes; further columns of root and ``kid``."""
    return f"""
WITH RECURSIVE t AS (
  SELECT tree_id, '0' AS node_path, '' AS parent_path, CAST(to_json(children) AS JSON) AS kids{root} FROM tree_output
  UNION ALL
  SELECT tree_id, node_path || '.' || i, node_path,
         CASE WHEN json_type(kid, '$.children') = 'ARRAY' THEN json_extract(kid, '$.children')
              WHEN json_valid(json_extract_string(kid, '$.children_json')) THEN CAST(json_extract_string(kid, '$.children_json') AS JSON) END{kid}
  FROM (SELECT tree_id, node_path, i, json_extract(kids, '$[' || i || ']') AS kid
        FROM (SELECT tree_id, node_path, kids, unnest(range(CAST(json_array_length(kids) AS BIGINT))) AS i
              FROM t WHERE json_type(kids) = 'ARRAY'))
  WHERE json_type(kid) = 'OBJECT')
"""


_CODE = r"nullif(upper(regexp_replace({c}, '\s', '', 'g')), '')"
_FIRST = "SELECT id, arg_min({c}, coalesce(ingested_at, TIMESTAMP '9999-12-31')) {c}, strftime(min(ingested_at), '%Y-%m') period FROM legal_knowledge_records WHERE id IS NOT NULL GROUP BY id"
_UNPACKED = "CASE WHEN left(trim({c}), 1) = '[' AND json_valid({c}) THEN array_to_string(from_json({c}, '[\"VARCHAR\"]'), ';') ELSE {c} END"
_NUMBER = r"CAST(CAST(regexp_extract({c}, '{p}(\d+)', 1) AS BIGINT) AS VARCHAR) || lower(regexp_extract({c}, '{p}\d+(\p{{L}}?)', 1))"
#: (id, period, law, ref): the references of ``extra``, found by their shape: a code, a name and an article between pipes.
REFERENCES_SQL = (
    f"SELECT id, period, {_CODE.format(c='split_part(z, chr(124), 1)')} law, " + _NUMBER.format(c="split_part(z, chr(124), 3)", p="") + " ref "
    r"FROM (SELECT id, period, unnest(regexp_extract_all(x, '[^|;；,\"''\[\]{}\t\n\r]*\|[^|]*\|\s*(?:(?i:điều)\s*)?\d+\p{L}?')) z "
    f"FROM (SELECT id, period, {_UNPACKED.format(c='extra')} x FROM ({_FIRST.format(c='extra')})))"
)
_SUPPLIED = (
    "SELECT law, " + _NUMBER.format(c="v", p="^") + f" ref, min(period) since FROM (SELECT {_CODE.format(c='law_id')} law, a.period, "
    r"unnest(regexp_extract_all(regexp_replace(" + _UNPACKED.format(c="article") + r", '\([^)]*\)?', ' ', 'g'), '\d{1,9}\p{L}?')) v "
    f"FROM ({_FIRST.format(c='article')}) a JOIN ({_FIRST.format(c='law_id')}) l USING (id)) WHERE law IS NOT NULL GROUP BY ALL"
)
_ORPHANS = (
    f"SELECT DISTINCT id, coalesce(period, '') period, {_CODE.format(c='law_id')} ref_law_id, '' ref_article, 'law_id' field FROM ({_FIRST.format(c='law_id')}) "
    f"WHERE ref_law_id IS NOT NULL AND ref_law_id NOT IN (SELECT {_CODE.format(c='doc_code')} FROM legal_doc_registry WHERE doc_code IS NOT NULL) "
    f"UNION ALL SELECT DISTINCT id, r.period, r.law, r.ref, 'extra' FROM ({REFERENCES_SQL}) r LEFT JOIN ({_SUPPLIED}) s ON r.law = s.law AND r.ref = s.ref WHERE r.law IS NOT NULL AND (since IS NULL OR since > r.period)"
)

_BROKEN = "json_type(kid, '$.children') IS DISTINCT FROM 'ARRAY' AND trim(json_extract_string(kid, '$.children_json')) <> '' AND NOT json_valid(json_extract_string(kid, '$.children_json'))"

ORACLE = {
    "p3_found": trees_sql() + "SELECT tree_id, node_path, parent_path FROM t",
    "p5_found": f"SELECT DISTINCT id, period, ref_law_id, ref_article FROM ({_ORPHANS})",
    "p5_counts": f"SELECT 'legal_knowledge_records' src, field, period, count(*) n_refs, count(DISTINCT id) n_records FROM ({_ORPHANS}) GROUP BY ALL",
    "p3_nodes": trees_sql(
        ", CAST(0 AS INTEGER) AS pos, id, content, type, number, level, is_edit, num_tokens",
        ", CAST(i AS INTEGER), " + ", ".join(f"json_extract_string(kid, '$.{c}')" for c in nested.TEXTS) + ", CAST(json_extract(kid, '$.level') AS DOUBLE), CAST(json_extract(kid, '$.is_edit') AS BOOLEAN), CAST(json_extract(kid, '$.num_tokens') AS BIGINT)",
    ) + "SELECT * EXCLUDE (kids), CAST(len(node_path) - len(replace(node_path, '.', '')) AS INTEGER) depth FROM t",
    "p3_broken": trees_sql(", false AS bad", ", " + _BROKEN) + "SELECT tree_id, node_path FROM t WHERE bad",
}
