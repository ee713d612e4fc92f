"""Registered queries of the general data-cleaning operators (problems 2, 4 and 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factspan.operators import drift, nested, quantities
from factspan.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.found(table(spark, d, "drift_lines"))


def p2_scripts(spark: SparkSession, d: str) -> DataFrame:
    return drift.edit_scripts(table(spark, d, "drift_lines"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "drift_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.found(table(spark, d, "facts"), table(spark, d, "fact_types"))


def p4_converted(spark: SparkSession, d: str) -> DataFrame:
    return quantities.converted(table(spark, d, "facts"), table(spark, d, "fact_types"))


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    return quantities.unit_report(table(spark, d, "facts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "extraction_cells"))


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(table(spark, d, "extraction_cells"), "cell_id", "payload", once=True)


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "extraction_cells"), "items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_scripts, p2_table, p4_found, p4_converted, p4_units, p5_found, p5_nodes, p5_items)
}

_KIND = "CASE json_type({0}) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE CASE WHEN {0} IS NULL THEN 'null' ELSE 'number' END END"
_VAL = "CASE WHEN json_type({0}) NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string({0}, '$') END"

SQL: dict[str, str] = {
    "p5_items": f"""
WITH c AS (SELECT DISTINCT cell_id, substr(md5(payload), 1, 16) AS doc, CAST(payload AS JSON) AS p FROM extraction_cells WHERE payload IS NOT NULL AND json_valid(payload)),
m AS (SELECT cell_id, doc, CAST(list_position(json_keys(p), 'items') - 1 AS VARCHAR) AS label, json_extract(p, '$.items') AS v FROM c WHERE list_contains(json_keys(p), 'items')),
e AS (SELECT cell_id, doc, label, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE [v] END AS xs FROM m))
SELECT cell_id, doc, label, '' AS parent_label, CASE json_type(v) WHEN 'NULL' THEN 'null' ELSE 'array' END AS kind, NULL AS val FROM m
UNION ALL SELECT cell_id, doc, label || '.' || i, '', {_KIND.format("x")}, {_VAL.format("x")} FROM e
""",
    "p5_found": """
WITH c AS (SELECT DISTINCT cell_id, CAST(payload AS JSON) AS p FROM extraction_cells WHERE payload IS NOT NULL AND json_valid(payload)),
l AS (SELECT cell_id, CASE json_type(p, '$.items') WHEN 'ARRAY' THEN CAST(json_extract(p, '$.items') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(p, '$.items')] ELSE CAST([] AS JSON[]) END AS items FROM c),
i AS (SELECT cell_id, unnest(range(len(items))) AS item_no, unnest(items) AS item FROM l),
o AS (SELECT * FROM i WHERE json_type(item) = 'OBJECT'),
el AS (SELECT cell_id, item_no, CASE json_type(item, '$.condition.electrolyte') WHEN 'ARRAY' THEN CAST(json_extract(item, '$.condition.electrolyte') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(item, '$.condition.electrolyte')] ELSE CAST([] AS JSON[]) END AS es FROM o),
e AS (SELECT cell_id, item_no, unnest(range(len(es))) AS child_no, unnest(es) AS e FROM el),
vl AS (SELECT cell_id, item_no, CASE json_type(item, '$.evidence') WHEN 'ARRAY' THEN CAST(json_extract(item, '$.evidence') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(item, '$.evidence')] ELSE CAST([] AS JSON[]) END AS vs FROM o),
v AS (SELECT cell_id, item_no, unnest(range(len(vs))) AS evidence_no, unnest(vs) AS v FROM vl),
al AS (SELECT cell_id, item_no, evidence_no, CASE json_type(v, '$.paper.authors') WHEN 'ARRAY' THEN CAST(json_extract(v, '$.paper.authors') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(v, '$.paper.authors')] WHEN 'VARCHAR' THEN [json_extract(v, '$.paper.authors')] ELSE CAST([] AS JSON[]) END AS xs FROM v),
a AS (SELECT cell_id, item_no, evidence_no, unnest(range(len(xs))) AS child_no, unnest(xs) AS x FROM al)
SELECT cell_id, CAST(item_no AS INT) AS item_no, -1 AS evidence_no, 'electrolyte' AS child, CAST(child_no AS INT) AS child_no,
       coalesce(json_extract_string(e, '$.formula'), '') AS val,
       coalesce(CAST(round(TRY_CAST(json_extract_string(e, '$.concentration') AS DOUBLE) * 1000000) AS BIGINT), -1) AS amount
FROM e WHERE json_type(e) = 'OBJECT'
UNION ALL
SELECT cell_id, CAST(item_no AS INT), CAST(evidence_no AS INT), 'doi', 0, json_extract_string(v, '$.paper.doi'), -1
FROM v WHERE json_extract_string(v, '$.paper.doi') IS NOT NULL
UNION ALL
SELECT cell_id, CAST(item_no AS INT), CAST(evidence_no AS INT), 'author', CAST(child_no AS INT),
       CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') ELSE concat_ws(' ', nullif(trim(json_extract_string(x, '$.given')), ''), nullif(trim(json_extract_string(x, '$.family')), '')) END, -1
FROM a WHERE json_type(x) IN ('VARCHAR', 'OBJECT')
""",
}
