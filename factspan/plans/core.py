"""Registered queries of the reference's operators on the given tables, each with SQL where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factspan.functions import numbers, text, units
from factspan.operators import evidence, graph, latest, records, scoring
from factspan.session import staged, table
from factspan.sources import files, spans
from factspan.vocab import CANONICAL_UNIT, PARSERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Names in the SQL below that stand for a subquery.
VIEWS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"\b[A-Z]+_VIEW\b", lambda m: VIEWS[m.group(0)], sql)
        return f

    return register


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


papers, matrix, cells_, docs, events = map(_t, ("papers", "matrix_rows", "extraction_cells", "documents", "events"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts with NaN as what it is, a missing value: null. The one rule for NaN of all queries here and their SQL."""
    return table(spark, d, "facts").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


VIEWS["FACTS_VIEW"] = "(SELECT * REPLACE (CASE WHEN NOT isnan(value) THEN value END AS value) FROM facts)"


def _parser(c: str = "parser") -> Column:
    return F.lower(F.trim(c))


def _file_parser() -> Column:
    return F.regexp_extract("source_file", r"llm_matrix_(.+?)_\d{4}", 1)


_FP = "regexp_extract(source_file, 'llm_matrix_(.+?)_[0-9]{4}', 1)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered cell once."""
    return latest.first(cells_(spark, d), ["cell_id"], ["loaded_at"])


_CELLS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at) AS rn_ FROM extraction_cells) WHERE rn_ = 1)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """cell columns, item_no, type, value: the items of each cell that are objects."""
    raw = F.from_json(F.get_json_object("payload", "$.items"), "array<string>")
    x = _cells(spark, d).select("cell_id", "paper_sha", "parser", "label", "mode", F.posexplode(raw).alias("item_no", "item"))
    x = x.where(F.col("item").startswith("{"))
    return x.withColumn("type", F.get_json_object("item", "$.type")).withColumn("value", F.get_json_object("item", "$.value").try_cast("double"))


_ITEMS = f"""(SELECT * FROM (
  SELECT cell_id, paper_sha, parser, label, mode, unnest(range(n)) AS item_no, unnest(items) AS item,
         json_extract_string(unnest(items), '$.type') AS type, TRY_CAST(json_extract_string(unnest(items), '$.value') AS DOUBLE) AS value
  FROM (SELECT *, len(items) AS n FROM (SELECT *, CASE json_type(CAST(payload AS JSON), '$.items') WHEN 'ARRAY' THEN CAST(json_extract(CAST(payload AS JSON), '$.items') AS JSON[]) ELSE CAST([] AS JSON[]) END AS items FROM {_CELLS}))
) WHERE json_type(item) = 'OBJECT')"""


VIEWS["ITEMS_VIEW"], VIEWS["CELLS_VIEW"] = _ITEMS, _CELLS


# --- aggregations -------------------------------------------------------------------------------------------------


@query("""SELECT lower(trim(parser)) AS parser, model, count(*) AS n_facts, count(DISTINCT lower(sha)) AS n_papers,
 count(DISTINCT type) AS n_types, count(DISTINCT type) / 11.0::DOUBLE AS coverage FROM facts WHERE evidence IS NOT NULL GROUP BY 1, 2""")
def q_flagship(spark, d):
    f = facts(spark, d).where("evidence is not null")
    return f.groupBy(_parser().alias("parser"), "model").agg(
        F.count("*").alias("n_facts"), F.countDistinct(F.lower("sha")).alias("n_papers"), F.countDistinct("type").alias("n_types"),
        (F.countDistinct("type") / len(CANONICAL_UNIT)).alias("coverage"),
    )


@query("SELECT type, count(*) AS n FROM facts WHERE evidence IS NOT NULL GROUP BY type")
def q_type_counts(spark, d):
    return facts(spark, d).where("evidence is not null").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT lower(sha)) AS n_papers, count(DISTINCT type) AS n_types FROM facts WHERE evidence IS NOT NULL")
def q_paper_count(spark, d):
    return facts(spark, d).where("evidence is not null").agg(F.countDistinct(F.lower("sha")).alias("n_papers"), F.countDistinct("type").alias("n_types"))


@query("SELECT lower(sha) AS sha, count(*) AS n FROM facts GROUP BY 1")
def q_facts_per_paper(spark, d):
    return facts(spark, d).groupBy(F.lower("sha").alias("sha")).agg(F.count("*").alias("n"))


@query("SELECT lower(trim(parser)) AS parser, model, count(DISTINCT fact_id) AS n FROM facts GROUP BY 1, 2")
def q_parser_model_cells(spark, d):
    return facts(spark, d).groupBy(_parser().alias("parser"), "model").agg(F.countDistinct("fact_id").alias("n"))


@query("""SELECT type, value, count(DISTINCT lower(trim(parser))) AS n, string_agg(DISTINCT lower(trim(parser)), ', ' ORDER BY lower(trim(parser))) AS parsers
 FROM FACTS_VIEW WHERE value IS NOT NULL GROUP BY type, value HAVING count(DISTINCT lower(trim(parser))) > 1""")
def q_parser_agreement(spark, d):
    f = facts(spark, d).where("value is not null")
    g = f.groupBy("type", "value").agg(F.array_sort(F.collect_set(_parser())).alias("p"))  # at most five parsers
    return g.where("size(p) > 1").select("type", "value", F.size("p").cast("long").alias("n"), F.array_join("p", ", ").alias("parsers"))


@query("SELECT event_type, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total FROM events GROUP BY event_type")
def q_ledger_by_kind(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))


_DROPS = f"""(SELECT parser, json_extract_string(e, '$.stage') AS stage, json_extract_string(e, '$.reason') AS reason FROM (
 SELECT parser, unnest(CAST(json_extract(CAST(payload AS JSON), '$.errors') AS JSON[])) AS e FROM {_CELLS}))"""


def _drops(spark, d):
    e = F.explode(F.from_json(F.get_json_object("payload", "$.errors"), "array<struct<stage string, reason string>>"))
    return _cells(spark, d).select("parser", e.alias("e")).select("parser", "e.*")


_ADVICE = " UNION ALL ".join(f"SELECT '{b}' AS bucket, '{a}' AS advice" for b, a in evidence.ADVICE.items())


@query(f"""WITH b AS (SELECT parser, CASE WHEN stage = 'extract' AND contains(reason, '!= canonical') THEN 'unit mismatch'
 WHEN stage = 'extract' AND contains(reason, 'mis-citation') THEN 'mis-citation'
 WHEN stage = 'extract' AND contains(reason, 'no valid span citation') THEN 'unresolvable evidence'
 WHEN stage = 'extract' AND contains(reason, 'expected dict') THEN 'malformed item'
 WHEN stage = 'extract' THEN 'schema/validation error' WHEN stage = 'shacl' THEN 'SHACL violation' WHEN stage = 'insert' THEN 'insert refusal'
 ELSE 'other' END AS bucket FROM {_DROPS}), n AS (SELECT parser, bucket, count(*) AS n FROM b GROUP BY 1, 2)
SELECT parser, bucket, n, CAST(round_even(100.0 * n / sum(n) OVER (PARTITION BY parser), 0) AS INT) AS pct, n >= 3 AS systematic, CASE WHEN n >= 3 THEN a.advice END AS advice FROM n LEFT JOIN ({_ADVICE}) a USING (bucket)""")
def q_drop_buckets(spark, d):
    return evidence.drop_buckets(_drops(spark, d), ["parser"])


@query(f"SELECT stage, reason, count(*) AS n FROM {_DROPS} GROUP BY 1, 2")
def q_drop_log(spark, d):
    return _drops(spark, d).groupBy("stage", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT parser, coalesce(json_array_length(CAST(payload AS JSON), '$.items'), 0) AS i, coalesce(json_array_length(CAST(payload AS JSON), '$.errors'), 0) AS e FROM {_CELLS})
SELECT parser, count(*) AS n_cells, CAST(sum(i + e) AS BIGINT) AS n_found, CAST(sum(e) AS BIGINT) AS n_dropped, CAST(sum(i) AS BIGINT) AS n_valid FROM c GROUP BY parser""")
def q_funnel(spark, d):
    n = lambda m: F.coalesce(F.json_array_length(F.get_json_object("payload", f"$.{m}")), F.lit(0))
    c = _cells(spark, d).select("parser", n("items").alias("i"), n("errors").alias("e"))
    return c.groupBy("parser").agg(
        F.count("*").alias("n_cells"), F.sum(F.col("i") + F.col("e")).alias("n_found"), F.sum("e").alias("n_dropped"), F.sum("i").alias("n_valid")
    )


@query("""SELECT row_id, round(coalesce(r, 0), 9) AS recall, round(coalesce(p, 0), 9) AS "precision", round(coalesce(2 * r * p / nullif(r + p, 0), 0), 9) AS f1
 FROM (SELECT row_id, tp::DOUBLE / nullif(gt_total, 0) AS r, tp::DOUBLE / nullif(n_valid, 0) AS p FROM matrix_rows)""")
def q_prf(spark, d):
    r, p = F.try_divide(F.col("tp"), F.col("gt_total")), F.try_divide(F.col("tp"), F.col("n_valid"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    m = matrix(spark, d).select("row_id", r.alias("r"), p.alias("p"))
    return m.select("row_id", zero(F.col("r")).alias("recall"), zero(F.col("p")).alias("precision"), zero(F.try_divide(2 * F.col("r") * F.col("p"), F.col("r") + F.col("p"))).alias("f1"))


def _matrix_keys(spark, d):
    m = matrix(spark, d)
    return m.withColumn("parser", _file_parser()).withColumn("paper", F.lower(F.trim("paper_sha8"))).withColumn("label", F.regexp_replace(F.lower(F.trim("label")), "[ _]", "-"))


_MATRIX = f"(SELECT * EXCLUDE (parser, label), {_FP} AS parser, lower(trim(paper_sha8)) AS paper, regexp_replace(lower(trim(label)), '[ _]', '-', 'g') AS label FROM matrix_rows)"


@query(f"""SELECT mode, parser, label, round(avg(f1), 9) AS macro_f1, round(avg(recall), 9) AS macro_recall, round(avg("precision"), 9) AS macro_precision,
 round(sum(tp)::DOUBLE / nullif(sum(gt_total), 0), 9) AS micro_recall, round(CAST(sum(CAST(eur_per_paper AS DECIMAL(20,8))) AS DOUBLE), 5) AS eur, CAST(sum(CAST(eur_per_paper AS DECIMAL(20,8))) AS DOUBLE) / nullif(sum(tp), 0) AS eur_per_tp, CAST(sum(tp) AS BIGINT) AS tp,
 round(avg(latency_s), 6) AS latency_s, count(DISTINCT paper) AS n_papers FROM {_MATRIX} GROUP BY 1, 2, 3""")
def q_macro_micro(spark, d):
    m = scoring.macro_micro(_matrix_keys(spark, d), ["mode", "parser", "label"])
    return m.withColumns({c: F.round(c, 9) for c in ("macro_f1", "macro_recall", "macro_precision", "micro_recall")}).withColumns({"latency_s": F.round("latency_s", 6), "eur": F.round("eur", 5)})


@query(f"""WITH p AS (SELECT label, parser, avg(f1) AS f1 FROM {_MATRIX} GROUP BY 1, 2)
SELECT label, round(avg(f1), 9) AS mean_f1 FROM p GROUP BY label HAVING count(*) = 5""")
def q_complete_block(spark, d):
    p = _matrix_keys(spark, d).groupBy("label", "parser").agg(F.avg("f1").alias("f1"))
    return scoring.complete_block(p, ["label"], "parser", len(PARSERS), "f1").withColumn("mean_f1", F.round("mean_f1", 9))


@query(f"""WITH g AS (SELECT parser, label, sum(tp) AS tp, sum(gt_total - tp) AS miss FROM {_MATRIX} GROUP BY ROLLUP (parser, label)),
t AS (SELECT sum(gt_total - tp) AS miss FROM matrix_rows)
SELECT parser, label, CAST(g.tp AS BIGINT) AS tp, CAST(g.miss AS BIGINT) AS miss, round(100.0 * g.miss / nullif(t.miss, 0), 6) AS pct_of_misses FROM g, t""")
def q_grand_totals(spark, d):
    m = _matrix_keys(spark, d)
    g = m.rollup("parser", "label").agg(F.sum("tp").alias("tp"), F.sum(F.col("gt_total") - F.col("tp")).alias("miss"))
    # the rollup's own last row is the grand total; the window runs over the groups, not over the rows
    g = g.withColumn("all_miss", F.max(F.when(F.col("parser").isNull() & F.col("label").isNull(), F.col("miss"))).over(W.partitionBy()))
    return g.select("parser", "label", "tp", "miss", F.round(F.try_divide(100.0 * F.col("miss"), F.col("all_miss")), 6).alias("pct_of_misses"))


@query("""SELECT lower(trim(parser)) AS parser, sha, count(*) AS n, count(*) FILTER (hit) AS covered, count(*) FILTER (dist) AS n_distinctive, count(*) FILTER (hit AND dist) AS covered_distinctive
FROM (SELECT parser, sha, value <> floor(value) OR abs(value) >= 100 AS dist,
 regexp_matches(replace(t, ',', ''), '(^|[^0-9])' || replace(replace(format('{:g}', value), '.', '\\.'), '+', '\\+') || '([^0-9]|$)')
 OR (value = floor(value) AND abs(value) < 1e15 AND regexp_matches(replace(t, ',', ''), '(^|[^0-9])' || CAST(CAST(value AS BIGINT) AS VARCHAR) || '([^0-9]|$)')) AS hit
 FROM (SELECT parser, lower(sha) AS sha, value, coalesce(evidence.source_text, '') AS t FROM FACTS_VIEW WHERE value IS NOT NULL)) GROUP BY 1, 2""")
def q_coverage(spark, d):
    f = facts(spark, d).where("value is not null")
    f = f.select(_parser().alias("parser"), F.lower("sha").alias("sha"), numbers.printed_in(F.col("value"), F.col("evidence.source_text")).alias("hit"), numbers.distinctive(F.col("value")).alias("dist"))
    one = lambda c: F.count_if(c)
    return f.groupBy("parser", "sha").agg(F.count("*").alias("n"), one(F.col("hit")).alias("covered"), one(F.col("dist")).alias("n_distinctive"), one(F.col("hit") & F.col("dist")).alias("covered_distinctive"))


@query("""WITH v AS (SELECT DISTINCT type, value, lower(substr(sha, 1, 8)) AS sha8, lower(trim(parser)) AS parser FROM FACTS_VIEW WHERE value IS NOT NULL),
k AS (SELECT DISTINCT type, value, sha8 FROM v), p AS (SELECT unnest(['mineru', 'dots', 'paddle', 'docling', 'chandra']) AS parser)
SELECT k.type, k.value, k.sha8, string_agg(p.parser, ',' ORDER BY p.parser) AS lacking FROM k, p
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.type = k.type AND v.value = k.value AND v.sha8 = k.sha8 AND v.parser = p.parser) GROUP BY 1, 2, 3""")
def q_parsers_lacking(spark, d):
    f = facts(spark, d).where("value is not null")
    g = f.groupBy("type", "value", F.lower(F.substring("sha", 1, 8)).alias("sha8")).agg(F.collect_set(_parser()).alias("have"))
    lack = F.array_sort(F.array_except(F.array(*map(F.lit, PARSERS)), "have"))
    return g.select("type", "value", "sha8", F.array_join(lack, ",").alias("lacking")).where("lacking <> ''")


@query(f"SELECT parser, max(recall) AS best_recall FROM {_MATRIX} GROUP BY parser")
def q_best_recall(spark, d):
    return _matrix_keys(spark, d).groupBy("parser").agg(F.max("recall").alias("best_recall"))


@query(f"SELECT label, round(sum(coalesce(in_tokens, 0) * 0.4e-6 + coalesce(out_tokens, 0) * 1.6e-6) * 0.92, 6) AS eur FROM {_CELLS} GROUP BY label")
def q_token_cost(spark, d):
    c = records.token_cost_eur({"in": F.col("in_tokens"), "out": F.col("out_tokens")}, {"in": 0.4, "out": 1.6})
    return _cells(spark, d).groupBy("label").agg(F.round(F.sum(c), 6).alias("eur"))


@query(f"SELECT parser, round(sum(latency_s / 3600 * 0.44 * 0.92), 6) AS eur FROM {_CELLS} GROUP BY parser")
def q_gpu_cost(spark, d):
    return _cells(spark, d).groupBy("parser").agg(F.round(F.sum(records.gpu_cost_eur(F.col("latency_s"), 0.44)), 6).alias("eur"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events)
SELECT e.event_type, n, cost, top FROM (SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20,8))) AS DOUBLE) AS cost FROM events GROUP BY 1) e
JOIN (SELECT event_type, string_agg(event_id, ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1) t USING (event_type)""")
def q_issue_counts(spark, d):
    e = events(spark, d)
    n = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,8)")).cast("double").alias("cost"))
    k = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))  # Spark keeps three rows per kind and task before the shuffle
    top = e.withColumn("k", k).where("k <= 3").groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("top"))
    return n.join(top, "event_type")


@query(f"SELECT cell_id, label, latency_s FROM {_CELLS} WHERE latency_s IS NOT NULL ORDER BY latency_s DESC, cell_id LIMIT 3")
def q_slowest(spark, d):
    return latest.last_n(_cells(spark, d).where("latency_s is not null").select("cell_id", "label", "latency_s"), 3, [F.desc("latency_s"), F.asc("cell_id")])


# --- latest, first, running ---------------------------------------------------------------------------------------


@query("SELECT paper_sha, max(cell_id) AS cell_id FROM extraction_cells GROUP BY 1")
def q_latest_run(spark, d):
    return latest.latest(cells_(spark, d).select("paper_sha", "cell_id"), ["paper_sha"], ["cell_id"])


@query(f"SELECT paper_sha, parser, arg_max(label, cell_id) AS label, max(cell_id) AS cell_id FROM {_CELLS} GROUP BY 1, 2")
def q_latest_run_per_parser(spark, d):
    return latest.latest(_cells(spark, d).select("paper_sha", "parser", "label", "cell_id"), ["paper_sha", "parser"], ["cell_id"])


@query(f"SELECT paper, parser, row_id, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY paper, parser ORDER BY recorded_at DESC, row_id DESC) AS r FROM {_MATRIX}) WHERE r = 1")
def q_latest_export(spark, d):
    return latest.latest(_matrix_keys(spark, d).select("paper", "parser", "row_id", "recorded_at"), ["paper", "parser"], ["recorded_at", "row_id"])


@query("SELECT min(fact_id) AS fact_id FROM FACTS_VIEW GROUP BY type, value, unit_label, evidence.source_text")
def q_keep_first(spark, d):
    f = facts(spark, d).select("fact_id", "type", "value", "unit_label", F.col("evidence.source_text").alias("source_text"))
    return latest.first(f, ["type", "value", "unit_label", "source_text"], ["fact_id"]).select("fact_id")


@query("SELECT lower(sha) AS sha, type, value, min(fact_id) AS fact_id FROM FACTS_VIEW GROUP BY 1, 2, 3")
def q_keep_first_value(spark, d):
    return latest.first(facts(spark, d).select(F.lower("sha").alias("sha"), "type", "value", "fact_id"), ["sha", "type", "value"], ["fact_id"])


def _spend(spark, d):
    return events(spark, d).where("event_type = 'purchase'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")


@query("""WITH t AS (SELECT event_id, value, sum(coalesce(value, 0)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events WHERE event_type = 'purchase'),
m AS (SELECT unnest([1000.0, 5000.0, 10000.0, 20000.0, 50000.0]) AS mark)
SELECT m.mark::DOUBLE AS mark, event_id FROM t, m WHERE total - coalesce(value, 0) < mark AND mark <= total""")
def q_marks_crossed(spark, d):
    t = latest.running_total(_spend(spark, d), "value", ["ts", "event_id"])
    return latest.marks_crossed(t, [1000, 5000, 10000, 20000, 50000]).select("mark", "event_id")


@query("""WITH t AS (SELECT sum(coalesce(value, 0)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events WHERE event_type = 'purchase')
SELECT total <= 20000 AS allowed, total >= 16000 AS warned, count(*) AS n FROM t GROUP BY 1, 2""")
def q_budget_gate(spark, d):
    return records.budget_gate(_spend(spark, d), "value", ["ts", "event_id"], 20000.0).groupBy("allowed", "warned").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS s FROM events WHERE event_type = 'purchase' GROUP BY 1),
c AS (SELECT day, sum(s) OVER (ORDER BY day) AS total FROM d) SELECT CAST(day AS VARCHAR) AS day, round(total - coalesce(lag(total) OVER (ORDER BY day), 0), 4) AS delta FROM c""")
def q_spend_delta(spark, d):
    s = _spend(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("s"))
    c = s.withColumn("total", F.sum("s").over(W.orderBy("day")))  # one row per day
    return c.select(F.col("day").cast("string").alias("day"), F.round(F.col("total") - F.coalesce(F.lag("total").over(W.orderBy("day")), F.lit(0.0)), 4).alias("delta"))


@query("""SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE trim(event_type) <> '')
WHERE event_type IS DISTINCT FROM p""")
def q_changes_only(spark, d):
    return latest.changes_only(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("""SELECT event_id, round(epoch_us(nt)::DOUBLE / 1e6 - epoch_us(ts)::DOUBLE / 1e6, 3) AS elapsed_s FROM (
 SELECT *, lead(event_type) OVER w AS n, lead(ts) OVER w AS nt FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type = 'view' AND n = 'click'""")
def q_paired(spark, d):
    p = latest.paired(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", "view", "click", "ts")
    return p.select("event_id", F.round("elapsed_s", 3).alias("elapsed_s"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1")
def q_first_view(spark, d):
    return latest.first(events(spark, d).where("event_type = 'view'").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def q_last_500(spark, d):
    return latest.last_n(events(spark, d).select("ts", "event_id"), 500, [F.desc("ts"), F.desc("event_id")]).select("event_id")


# --- sources, projections, scalars --------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS span_id, line AS text FROM (
 SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE length(trim(line, ' ')) > 0""")
def q_line_spans(spark, d):
    return spans.line_spans(docs(spark, d).where("text is not null"))


@query("""SELECT doc_id, string_agg('[' || span_id || '] (p' || page || ') ' || line, chr(10) ORDER BY span_id) AS projection FROM (
 SELECT doc_id, coalesce(section_no, 1) AS page, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span_id, line FROM (
 SELECT doc_id, section_no, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, section_no, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE length(trim(line, ' ')) > 0) GROUP BY 1""")
def q_projection(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    page = F.coalesce("section_no", F.lit(1))
    out = F.array_join(F.transform(lines, lambda x, i: text.numbered(i, page, x)), "\n")
    return docs(spark, d).where("text is not null").select("doc_id", out.alias("projection")).where("projection <> ''")


@query("""WITH s AS (SELECT lower(sha) AS sha, sum(length(evidence.source_text) + 1) AS n FROM facts GROUP BY 1)
SELECT s.sha, CASE WHEN n // 4 <= 2000 THEN 0 ELSE evidence.page END AS batch, count(*) AS n_spans FROM facts f JOIN s ON lower(f.sha) = s.sha GROUP BY 1, 2""")
def q_batches(spark, d):
    f = facts(spark, d).select(F.lower("sha").alias("sha"), F.col("evidence.page").alias("page"), F.length("evidence.source_text").alias("n"))
    size = f.groupBy("sha").agg(F.sum(F.col("n") + 1).alias("total"))
    b = F.when(F.floor(F.col("total") / 4) <= 2000, F.lit(0)).otherwise(F.col("page"))
    return f.join(size, "sha").groupBy("sha", b.alias("batch")).agg(F.count("*").alias("n_spans"))


@query("""SELECT doc_id || ':' || span_id || ': ' || substr(line, 1, 200) AS hit FROM (
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span_id, line FROM (
 SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE length(trim(line, ' ')) > 0)
WHERE regexp_matches(line, 'Tafel slope of') ORDER BY doc_id, span_id LIMIT 100""")
def q_search(spark, d):
    return files.search_lines(spans.line_spans(docs(spark, d)), "doc_id", "span_id", "text", "Tafel slope of")


@query(f"SELECT cell_id, type, value, CASE WHEN value IS NULL THEN json_extract_string(item, '$.value') END AS raw_value FROM {_ITEMS}")
def q_cell_items(spark, d):
    i = _items(spark, d)
    return i.select("cell_id", "type", "value", F.when(F.col("value").isNull(), F.get_json_object("item", "$.value")).alias("raw_value"))


_SIG = r"""sig AS (SELECT u, coalesce(string_agg(base || '^' || power, ',' ORDER BY base || '^' || power) FILTER (power <> 0), '') AS sig FROM (
 SELECT u, CASE base WHEN 'dec' THEN 'decade' WHEN 'decades' THEN 'decade' WHEN 'unitless' THEN 'dimensionless' ELSE base END AS base, CAST(sum(sgn * power) AS BIGINT) AS power FROM (
 SELECT u, sgn, CASE WHEN regexp_matches(tok, '^[a-zμ%°]+(-?[0-9]+)?$') THEN regexp_extract(tok, '^([a-zμ%°]+)', 1) ELSE tok END AS base,
  CASE WHEN regexp_matches(tok, '^[a-zμ%°]+-?[0-9]+$') THEN CAST(regexp_extract(tok, '(-?[0-9]+)$', 1) AS INT) ELSE 1 END AS power FROM (
 SELECT u, 1 AS sgn, unnest(string_split_regex(trim(split_part(t, '/', 1)), '[ ·*]+')) AS tok FROM plain
 UNION ALL SELECT u, -1, unnest(string_split_regex(trim(substr(t, strpos(t, '/') + 1)), '[ ·*]+')) FROM plain WHERE contains(t, '/')) WHERE tok NOT IN ('', '1')) GROUP BY 1, 2) GROUP BY u)"""
_PLAIN = r"""plain AS (SELECT u, CASE WHEN trim(t) = '' THEN 'dimensionless' ELSE trim(t) END AS t FROM (SELECT u, replace(regexp_replace(regexp_replace(replace(lower(
 translate(coalesce(u, ''), '⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺', '0123456789-+')), chr(92), ' '), '[{}]', '', 'g'), '_[a-z0-9]+', '', 'g'), '^', '') AS t FROM us))"""


@query(f"WITH us AS (SELECT DISTINCT unit_label AS u FROM facts), {_PLAIN}, {_SIG} SELECT u AS unit_label, sig AS signature FROM sig")
def q_unit_signatures(spark, d):
    u = facts(spark, d).select("unit_label").distinct()
    return u.select("unit_label", F.array_join(units.unit_signature(F.col("unit_label")), ",").alias("signature"))


@query(f"""WITH us AS (SELECT DISTINCT unit_label AS u FROM facts UNION SELECT canonical_unit FROM fact_types), {_PLAIN}, {_SIG}
SELECT f.type, a.sig = b.sig AS fits, count(*) AS n FROM facts f JOIN fact_types t USING (type) JOIN sig a ON f.unit_label IS NOT DISTINCT FROM a.u JOIN sig b ON t.canonical_unit = b.u GROUP BY 1, 2""")
def q_unit_guard(spark, d):
    f = facts(spark, d).groupBy("type", "unit_label").agg(F.count("*").alias("n"))  # units are worked out once per spelling
    fits = units.units_match(F.col("unit_label"), units.canonical_unit(F.col("type")))
    return f.withColumn("fits", fits).groupBy("type", "fits").agg(F.sum("n").alias("n"))


@query("""SELECT type, abs(value) <= coalesce(magnitude_ceiling, 'infinity'::DOUBLE) OR value IS NULL AS ok, count(*) AS n FROM FACTS_VIEW JOIN fact_types USING (type) GROUP BY 1, 2""")
def q_magnitude(spark, d):
    f = facts(spark, d)
    return f.groupBy("type", units.magnitude_ok(F.col("type"), F.col("value")).alias("ok")).agg(F.count("*").alias("n"))


@query(r"""SELECT lower(trim(parser)) AS parser, length(vd) < 2 OR contains(regexp_replace(t, '[^0-9]', '', 'g'), vd) AS cited, count(*) AS n FROM (
 SELECT parser, coalesce(regexp_replace(format('{:g}', value), '[^0-9]', '', 'g'), '') AS vd, coalesce(evidence.source_text, '') AS t FROM facts) GROUP BY 1, 2""")
def q_citation_guard(spark, d):
    f = facts(spark, d)
    return f.groupBy(_parser().alias("parser"), numbers.digits_inside(F.col("value"), F.coalesce("evidence.source_text", F.lit(""))).alias("cited")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, TRY_CAST(regexp_extract(text, '[-+]?[0-9]*\.?[0-9]+') AS DOUBLE) AS first_number FROM documents")
def q_first_number(spark, d):
    return docs(spark, d).select("doc_id", numbers.first_number(F.col("text")).alias("first_number"))


@query("""SELECT l_returnflag, abs(l_extendedprice - l_quantity * p_retailprice) <= greatest(abs(l_quantity * p_retailprice) * 0.01, CASE WHEN abs(l_quantity * p_retailprice) >= 1 THEN 0.5 ELSE 1e-4 END) AS within, count(*) AS n
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def q_tolerance(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_returnflag", numbers.within_tolerance(F.col("l_quantity") * F.col("p_retailprice"), F.col("l_extendedprice")).alias("within")).agg(F.count("*").alias("n"))


@query("SELECT fact_id, evidence.bbox_x0 AS x0, round(842 - evidence.bbox_y1, 6) AS y0, evidence.bbox_x1 AS x1, round(842 - evidence.bbox_y0, 6) AS y1 FROM facts")
def q_flipped_boxes(spark, d):
    b = text.flipped(F.lit(842.0), *(F.col(f"evidence.bbox_{c}") for c in ("x0", "y0", "x1", "y1")))
    f = facts(spark, d).select("fact_id", b.alias("b"))
    return f.select("fact_id", "b.x0", F.round("b.y0", 6).alias("y0"), "b.x1", F.round("b.y1", 6).alias("y1"))


@query("""SELECT lower(trim(parser)) AS parser, CASE lower(trim(parser)) WHEN 'docling' THEN 'points' WHEN 'paddle' THEN 'pixels' ELSE 'none' END AS unit, count(*) AS n,
 count(*) FILTER (evidence.bbox_x0 >= -1 AND evidence.bbox_y0 >= -1 AND evidence.bbox_x1 <= 596 AND evidence.bbox_y1 <= 843) AS drawable FROM facts GROUP BY 1, 2""")
def q_page_units(spark, d):
    box = F.struct(*(F.col(f"evidence.bbox_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    drawn = text.on_page(box, F.lit(595.0), F.lit(842.0), F.lit(595.0), F.lit(842.0))
    return facts(spark, d).groupBy(_parser().alias("parser"), text.page_unit(_parser()).alias("unit")).agg(F.count("*").alias("n"), F.count(drawn).alias("drawable"))


@query(f"SELECT cell_id, substr(sha256(substr(paper_sha, 1, 8) || chr(0) || parser || chr(0) || label || chr(0) || mode || chr(0) || prompt_hash), 1, 12) AS cell_key FROM {_CELLS}")
def q_cell_keys(spark, d):
    return files.cell_key(_cells(spark, d)).select("cell_id", "cell_key")


@query(r"""SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 197) || '...' ELSE t END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents)""")
def q_one_line(spark, d):
    return docs(spark, d).select("doc_id", text.one_line(F.col("text")).alias("line"))


# --- joins, checks, records ---------------------------------------------------------------------------------------


@query("SELECT lower(sha256) AS sha FROM papers WHERE lower(sha256) IN (SELECT lower(sha) FROM facts) AND lower(sha256) IN (SELECT lower(paper_sha) FROM extraction_cells)")
def q_papers_with_both(spark, d):
    p = papers(spark, d).select(F.lower("sha256").alias("sha"))
    return p.join(facts(spark, d).select(F.lower("sha").alias("sha")), "sha", "left_semi").join(cells_(spark, d).select(F.lower("paper_sha").alias("sha")), "sha", "left_semi")


@query("""SELECT 'paper without facts' AS what, lower(sha256) AS sha FROM papers WHERE lower(sha256) NOT IN (SELECT lower(sha) FROM facts WHERE sha IS NOT NULL)
UNION SELECT 'facts without paper', lower(sha) FROM facts WHERE lower(sha) NOT IN (SELECT lower(sha256) FROM papers)""")
def q_loose_ends(spark, d):
    p, f = papers(spark, d).select(F.lower("sha256").alias("sha")).distinct(), facts(spark, d).select(F.lower("sha").alias("sha")).distinct()
    a = p.join(f, "sha", "left_anti").select(F.lit("paper without facts").alias("what"), "sha")
    return a.unionByName(f.join(p, "sha", "left_anti").select(F.lit("facts without paper").alias("what"), "sha"))


@query("SELECT lower(sha) AS sha, count(DISTINCT lower(trim(parser))) AS n_parsers FROM facts GROUP BY 1 HAVING count(DISTINCT lower(trim(parser))) < 5")
def q_unseen(spark, d):
    g = facts(spark, d).groupBy(F.lower("sha").alias("sha")).agg(F.countDistinct(_parser()).alias("n_parsers"))
    return g.where(F.col("n_parsers") < len(PARSERS))


@query("""WITH f AS (SELECT lower(sha) AS sha, count(DISTINCT lower(trim(parser))) AS n_parsers, count(*) AS n_facts FROM facts GROUP BY 1),
c AS (SELECT lower(paper_sha) AS sha, count(DISTINCT cell_id) AS n_runs FROM extraction_cells GROUP BY 1), p AS (SELECT lower(sha256) AS sha, filename FROM papers)
SELECT sha, filename, coalesce(n_parsers, 0) AS n_parsers, coalesce(n_facts, 0) AS n_facts, coalesce(n_runs, 0) AS n_runs,
 CASE WHEN filename IS NULL THEN 'not in papers' WHEN coalesce(n_parsers, 0) = 0 THEN 'needs parsing' WHEN coalesce(n_runs, 0) = 0 THEN 'needs extraction' ELSE 'extracted' END AS status
FROM p FULL JOIN f USING (sha) FULL JOIN c USING (sha)""")
def q_workspace_status(spark, d):
    return records.workspace_status(papers(spark, d), facts(spark, d), cells_(spark, d))


@query("""SELECT 'foreign key' AS "check", count(*) AS n FROM facts WHERE sha NOT IN (SELECT sha256 FROM papers) HAVING count(*) > 0
UNION ALL SELECT 'check parser', count(*) FROM facts WHERE coalesce(parser NOT IN ('mineru', 'dots', 'paddle', 'docling', 'chandra'), true) HAVING count(*) > 0
UNION ALL SELECT 'primary key', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM facts GROUP BY fact_id) WHERE n > 1 HAVING count(*) > 0""")
def q_constraints(spark, d):
    return records.constraint_problems(facts(spark, d).select("fact_id", "sha", "parser"), ["fact_id"], papers(spark, d), "sha", "sha256", {"parser": PARSERS})


_ENUM = " UNION ALL ".join(
    f"SELECT fact_id, '{s}' AS slot, condition.{s} AS entry FROM facts WHERE condition.{s} NOT IN ({', '.join(repr(x) for x in v)})"
    for s, v in records.ENUMS.items()
)


@query(_ENUM)
def q_enum_problems(spark, d):
    return records.enum_problems(facts(spark, d))


def _requests(spark, d):
    """Negative values as correction requests: flagged, with their size as the corrected value."""
    f = facts(spark, d).where("value < 0")
    return f.select(
        F.col("fact_id").alias("id"), "fact_id", F.lit("reader").alias("author"), F.col("evidence.source_text").alias("comment"), F.abs("value").alias("corrected_value"),
        F.lit(None).cast("string").alias("corrected_unit"), F.lit(True).alias("flagged_wrong"), F.col("extracted_at").alias("at"),
    )


@query("SELECT fact_id, CASE WHEN value < 0 AND trim(coalesce(evidence.source_text, '')) <> '' THEN abs(value) ELSE value END AS value, coalesce(value < 0, false) AND trim(coalesce(evidence.source_text, '')) <> '' AS flagged_wrong FROM FACTS_VIEW")
def q_facts_current(spark, d):
    f = facts(spark, d)
    accepted, _ = records.corrections_applied(_requests(spark, d), f)
    return records.facts_current(f, accepted).select("fact_id", "value", "flagged_wrong")


@query("SELECT fact_id, value AS prior_value, unit_label AS prior_unit, abs(value) AS corrected_value FROM FACTS_VIEW WHERE value < 0 AND evidence IS NOT NULL AND trim(coalesce(evidence.source_text, '')) <> ''")
def q_corrections(spark, d):
    return records.corrections_applied(_requests(spark, d), facts(spark, d))[0].select("fact_id", "prior_value", "prior_unit", "corrected_value")


@query(f"""WITH us AS (SELECT DISTINCT unit_label AS u FROM facts UNION SELECT canonical_unit FROM fact_types), {_PLAIN}, {_SIG},
g AS (SELECT f.type, coalesce(regexp_replace(format('{{:g}}', f.value), '[^0-9]', '', 'g'), '') AS vd, f.value, r.value IS NOT NULL AND f.value IS NULL AS odd, magnitude_ceiling, f.evidence.source_text AS t, a.sig = b.sig AS fits
 FROM FACTS_VIEW f JOIN facts r USING (fact_id) JOIN fact_types ft ON f.type = ft.type JOIN sig a ON f.unit_label IS NOT DISTINCT FROM a.u JOIN sig b ON ft.canonical_unit = b.u)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t IS NULL THEN 'no valid span citation for ' || type WHEN length(vd) >= 2 AND NOT contains(regexp_replace(t, '[^0-9]', '', 'g'), vd) THEN 'likely mis-citation for ' || type
 WHEN odd THEN 'value is no number' WHEN NOT fits THEN 'unit_label != canonical for ' || type WHEN abs(value) > magnitude_ceiling THEN 'magnitude exceeds the plausible ceiling for ' || type END AS reason FROM g) GROUP BY 1""")
def q_guard_chain(spark, d):
    f = table(spark, d, "facts").select("type", F.col("value").cast("string").alias("value_text"), "unit_label", "evidence.source_text")
    f = evidence.with_unit_fit(f.withColumn("value", evidence.number_or_null(F.col("value_text"))))
    r = evidence.drop_reason(F.col("type"), F.col("value_text"), F.col("value"), F.col("unit_fits"), F.col("source_text"), F.lit(True))
    return f.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT c.cell_id, d.payload IS NOT NULL AS cached FROM {_CELLS} c LEFT JOIN (SELECT paper_sha, parser, label, mode, prompt_hash, model_id, arg_max(payload, (saved_at, cell_id)) AS payload FROM extraction_cells GROUP BY ALL) d
 ON c.paper_sha = d.paper_sha AND c.parser = d.parser AND c.label = d.label AND c.mode = d.mode AND c.prompt_hash = d.prompt_hash AND c.model_id = d.model_id""")
def q_cached_cells(spark, d):
    c = _cells(spark, d)
    wanted = c.select("cell_id", "paper_sha", "parser", "label", "mode", "prompt_hash", "model_id")
    return files.cached_cells(wanted, c).select("cell_id", F.col("payload").isNotNull().alias("cached"))


@query("""SELECT fact_id, type, value, unit_label, confidence, evidence.page AS page, parser, model, evidence.source_text AS source_text FROM FACTS_VIEW""")
def q_export(spark, d):
    return files.exported(facts(spark, d)).drop("bbox")


@query(f"""SELECT source_file, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, count(*) AS n_rows, round(max(eur_per_paper) - min(eur_per_paper), 4) AS spent_eur FROM {_MATRIX} GROUP BY 1""")
def q_snapshot_meta(spark, d):
    m = files.snapshot_meta(_matrix_keys(spark, d), ["source_file"], F.col("eur_per_paper"), F.col("eur_per_paper"))
    return m.withColumn("labels", F.array_join("labels", ",")).withColumn("modes", F.array_join("modes", ","))


# --- graph --------------------------------------------------------------------------------------------------------


@query("""SELECT type, unit_label, lower(sha) AS sha, lower(trim(parser)) AS parser, model, round(value, 6) AS value, round(condition.current_density, 6) AS current_density FROM FACTS_VIEW WHERE evidence IS NOT NULL""")
def q_graph_view(spark, d):
    v = graph.fact_view(graph.fact_quads(facts(spark, d).withColumn("evidence", F.col("evidence").withField("parser_name", _parser())), graph.VIEWED, distinct=False))
    return v.select("type", "unit_label", F.substring("paper", 7, 64).alias("sha"), "parser", "model", F.round("value", 6).alias("value"), F.round("current_density", 6).alias("current_density"))


@query("""SELECT 'value' AS p, count(*) AS n FROM FACTS_VIEW WHERE value IS NOT NULL UNION ALL SELECT 'unitLabel', count(*) FROM facts WHERE unit_label IS NOT NULL
UNION ALL SELECT 'confidence', count(*) FROM facts WHERE confidence IS NOT NULL UNION ALL SELECT 'sha256', count(DISTINCT lower(sha)) FROM facts
UNION ALL SELECT 'runId', count(*) FROM facts WHERE run_id IS NOT NULL UNION ALL SELECT 'extractionModel', count(*) FROM facts WHERE model IS NOT NULL AND run_id IS NOT NULL
UNION ALL SELECT 'formula', count(*) FROM facts WHERE condition.electrolyte.formula IS NOT NULL UNION ALL SELECT 'hadPrimarySource', count(*) FROM facts""")
def q_quad_census(spark, d):
    names = ["value", "unitLabel", "confidence", "sha256", "runId", "extractionModel", "formula", "hadPrimarySource"]
    return graph.fact_quads(facts(spark, d), names).groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT model, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM facts WHERE run_id IS NOT NULL GROUP BY 1")
def q_graph_runs(spark, d):
    q = graph.fact_quads(facts(spark, d), ["hadPrimarySource", "runId", "extractionModel"], distinct=False)
    anchored = graph.star(q, {"hadPrimarySource": "ev"}, need=("hadPrimarySource",)).select("s")
    return graph.run_values(q).join(anchored, "s").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("n_runs"))


@query("SELECT unit_label, round(value, 6) AS value FROM FACTS_VIEW WHERE type = 'Overpotential' AND unit_label = 'mV' AND value IS NOT NULL AND evidence IS NOT NULL")
def q_overpotentials_mv(spark, d):
    q = graph.fact_quads(facts(spark, d).where("type = 'Overpotential'"), ["unitLabel", "hadPrimarySource", "value"], distinct=False)
    s = graph.star(q, {"unitLabel": "unit_label", "hadPrimarySource": "ev"}, {"value": "value"}, ("unitLabel", "hadPrimarySource", "value"))
    return s.where("unit_label = 'mV'").select("unit_label", F.round("value", 6).alias("value"))


# --- evaluation ---------------------------------------------------------------------------------------------------


def _gold_cells(spark, d, i):
    """paper_sha, gold_cell, gold, present: the first cell of each paper is its gold.

    present tells whether any other cell of the paper has the value; that is joined per tuple, not gathered per paper.
    """
    first_cell = _cells(spark, d).groupBy("paper_sha").agg(F.min("cell_id").alias("gold_cell"))
    gi = i.join(first_cell.select("paper_sha", F.col("gold_cell").alias("cell_id")), ["paper_sha", "cell_id"])
    seen = i.join(first_cell, "paper_sha").where("cell_id <> gold_cell").select("paper_sha", F.round("value", 3).alias("v")).distinct().withColumn("there", F.lit(True))
    gi = gi.withColumn("v", F.round("value", 3)).join(seen, ["paper_sha", "v"], "left")
    g = F.array_sort(F.collect_list(F.struct("item_no", "type", "value", F.coalesce("there", F.lit(False)).alias("there"))))
    gold = gi.groupBy("paper_sha", F.col("cell_id").alias("gold_cell")).agg(g.alias("g"))
    return gold.select("paper_sha", "gold_cell", F.transform("g", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("gold"), F.transform("g", lambda x: x["there"]).alias("present"))


def _scoring_cells(spark, d):
    """Cells with preds, gold and present: the first cell of each paper is its gold, the others are scored against it.

    A cell's items are one payload, so the arrays are of its size. The items are parsed once and staged.
    """
    i = staged(_items(spark, d).where("type is not null").drop("item", "payload"))
    arr = F.array_sort(F.collect_list(F.struct("item_no", "type", "value")))
    per = i.groupBy("cell_id", "paper_sha", "parser", "label", "mode").agg(F.transform(arr, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("preds"))
    return per.join(_gold_cells(spark, d, i), "paper_sha").where("cell_id <> gold_cell")


@query(f"""WITH i AS (SELECT * FROM {_ITEMS} WHERE mode = 'raw'), k AS (SELECT paper_sha, label FROM i GROUP BY 1, 2 HAVING count(DISTINCT parser) >= 2)
SELECT paper_sha, label, type, value, min(cell_id) AS cell_id FROM i JOIN k USING (paper_sha, label) GROUP BY 1, 2, 3, 4""")
def q_parser_union(spark, d):
    i = _items(spark, d).where("mode = 'raw'").select("paper_sha", "label", "parser", "type", "value", "cell_id", "item_no")
    return scoring.unioned(i, ["paper_sha", "label"], "parser", 2, ["cell_id", "item_no"]).select("paper_sha", "label", "type", "value", "cell_id")


@query(f"""WITH i AS (SELECT paper_sha, type FROM {_ITEMS} WHERE type IS NOT NULL GROUP BY 1, 2), p AS (SELECT DISTINCT paper_sha FROM i)
SELECT p.paper_sha, string_agg(t.type, ',' ORDER BY t.type) AS missing FROM p, fact_types t WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.paper_sha = p.paper_sha AND i.type = t.type) GROUP BY 1""")
def q_missing_types(spark, d):
    g = _items(spark, d).where("type is not null").groupBy("paper_sha").agg(F.collect_set("type").alias("have"))
    return g.select("paper_sha", F.array_join(scoring.missing_types(F.col("have"), sorted(CANONICAL_UNIT)), ",").alias("missing")).where("missing <> ''")


@query("""SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey
 JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def q_star_join(spark, d):
    n, c, o = (table(spark, d, x) for x in ("nation", "customer", "orders"))
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("n_customers"), F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
