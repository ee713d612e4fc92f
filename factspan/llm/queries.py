"""Registered queries of the language-model operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factspan.llm import encoding, leaks, personal, survivors, terms
from factspan.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.found(table(spark, d, "facts"), table(spark, d, "matrix_rows"))


def p1_fact_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.fact_survivors(table(spark, d, "facts"))


def p1_cell_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.export_survivors(table(spark, d, "matrix_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.found(table(spark, d, "facts"), table(spark, d, "vocab_terms"))


def p3_misses(spark: SparkSession, d: str) -> DataFrame:
    return terms.misses(table(spark, d, "facts"), table(spark, d, "vocab_terms"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encoded(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "documents"), personal.secret_key(spark))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"))


def p8_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return personal.surrogates(table(spark, d, "documents"), personal.secret_key(spark))


def p8_pseudonymised(spark: SparkSession, d: str) -> DataFrame:
    return personal.pseudonymised(table(spark, d, "documents"), personal.secret_key(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_fact_records, p1_cell_records, p3_found, p3_misses, p6_ids, p7_found, p7_items, p8_found, p8_redacted, p8_surrogates, p8_pseudonymised)
}

_MISSING = "('', '-', '--', '?', '.', 'n/a', 'na', 'n.a.', 'none', 'null', 'nan', 'unknown', 'missing', 'tbd', 'other')"
SQL: dict[str, str] = {
    "p1_found": f"""
WITH f AS (
  SELECT fact_id, lower(trim(sha)) AS sha, type, evidence.page AS page, evidence.bbox_x0 AS x0, evidence.bbox_y0 AS y0,
         evidence.bbox_x1 AS x1, evidence.bbox_y1 AS y1, confidence, extracted_at,
         value IS NOT NULL AND NOT isnan(value) AND value NOT IN (-999, -9999, -99999, -999999, 999999) AS ok
  FROM facts),
g AS (
  SELECT a.fact_id, min(b.fact_id) AS first_id, count(*) AS n
  FROM f a JOIN f b ON a.sha = b.sha AND a.type = b.type AND a.page = b.page AND abs(a.x0 - b.x0) < 1.5
    AND abs(a.y0 - b.y0) < 1.5 AND abs(a.x1 - b.x1) < 1.5 AND abs(a.y1 - b.y1) < 1.5
  GROUP BY a.fact_id HAVING count(*) > 1),
fr AS (
  SELECT first_id, fact_id, row_number() OVER (PARTITION BY first_id ORDER BY confidence DESC NULLS LAST, extracted_at DESC, fact_id) AS r
  FROM g JOIN f USING (fact_id) WHERE ok),
m AS (
  SELECT row_id, lower(trim(paper_sha8)) AS paper, regexp_extract(lower(source_file), 'llm_matrix_(.+?)_[0-9]{{4}}', 1) AS fp,
         regexp_replace(lower(trim(label)), '[ _]+', '-', 'g') AS label, regexp_replace(lower(trim(mode)), '[ _]+', '-', 'g') AS mode,
         lower(trim(prompt_hash)) AS prompt, parser, model_id, recorded_at
  FROM matrix_rows),
mg AS (
  SELECT *, min(row_id) OVER w AS first_id, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY paper, fp, label, mode, prompt)),
ml AS (
  SELECT first_id, row_id, recorded_at, 'parser' AS field, parser AS v FROM mg WHERE n > 1
  UNION ALL SELECT first_id, row_id, recorded_at, 'model_id', model_id FROM mg WHERE n > 1),
mr AS (
  SELECT *, row_number() OVER (PARTITION BY first_id, field ORDER BY recorded_at DESC NULLS LAST, row_id) AS r
  FROM ml WHERE v IS NOT NULL AND lower(trim(v)) NOT IN {_MISSING})
SELECT 'facts' AS tbl, first_id, 'value' AS field, fact_id AS best_id FROM fr WHERE r = 1
UNION ALL SELECT 'matrix_rows', first_id, field, row_id FROM mr WHERE r = 1
""",
    "p1_cell_records": f"""
WITH m AS (
  SELECT row_id, lower(trim(paper_sha8)) AS paper, regexp_extract(lower(source_file), 'llm_matrix_(.+?)_[0-9]{{4}}', 1) AS file_parser,
         regexp_replace(lower(trim(label)), '[ _]+', '-', 'g') AS label, regexp_replace(lower(trim(mode)), '[ _]+', '-', 'g') AS mode, lower(trim(prompt_hash)) AS prompt, recorded_at,
         CASE WHEN lower(trim(parser)) NOT IN {_MISSING} THEN parser END AS parser, CASE WHEN lower(trim(model_id)) NOT IN {_MISSING} THEN model_id END AS model_id
  FROM matrix_rows),
o AS (SELECT *, (parser IS NOT NULL)::INT + (model_id IS NOT NULL)::INT AS n_has, CASE WHEN coalesce(paper, '') = '' OR coalesce(file_parser, '') = '' OR coalesce(label, '') = '' OR coalesce(mode, '') = '' OR coalesce(prompt, '') = '' THEN row_id END AS own FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY paper, file_parser, label, mode, prompt, own ORDER BY recorded_at DESC NULLS LAST, n_has DESC, row_id) AS k FROM o)
SELECT paper, file_parser, label, mode, prompt, CAST(count(*) AS BIGINT) AS n_rows, min(row_id) AS first_id, arg_min(row_id, k) AS best_id,
  arg_min(parser, k) FILTER (parser IS NOT NULL) AS parser, arg_min(row_id, k) FILTER (parser IS NOT NULL) AS parser_id,
  arg_min(model_id, k) FILTER (model_id IS NOT NULL) AS model_id, arg_min(row_id, k) FILTER (model_id IS NOT NULL) AS model_id_id
FROM r GROUP BY paper, file_parser, label, mode, prompt, own
""",
}
