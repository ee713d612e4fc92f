"""Registered queries on ledgers, logs, sinks, settings, the graph store and evaluation arms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factspan.operators import graph, latest, records, scoring
from factspan.plans.core import _CELLS, _ITEMS, _MATRIX, _cells, _gold_cells, _items, _matrix_keys, _parser, _requests, _scoring_cells, _spend, docs, events, facts, matrix, papers, query
from factspan.session import scratch, table
from factspan.sources import files
from factspan.vocab import CANONICAL_UNIT, PARSERS

_PURCHASES = "(SELECT event_id, ts, value FROM events WHERE event_type = 'purchase')"


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def q_content_hash(spark, d):
    content = F.encode("text", "UTF-8")
    return docs(spark, d).where("text is not null").select("doc_id", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


@query("SELECT sha256(text) AS sha256, max(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS last_path, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS first_path FROM documents WHERE text IS NOT NULL GROUP BY 1")
def q_hash_index(spark, d):
    f = docs(spark, d).where("text is not null").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    return files.hash_index(f).withColumnRenamed("path", "last_path").join(files.hash_index(f, last=False).withColumnRenamed("path", "first_path"), "sha256")


@query("""WITH r AS (SELECT paper_sha, parser, arg_max(cell_id, (saved_at, cell_id)) AS path FROM CELLS_VIEW GROUP BY 1, 2)
SELECT r.paper_sha, r.parser, CASE WHEN json_array_length(CAST(payload AS JSON), '$.items') > 2 THEN path END AS path FROM r JOIN CELLS_VIEW c ON c.cell_id = r.path""")
def q_parse_lookup(spark, d):
    """The newest output of each paper and parser; outputs of two items or fewer count as lost blobs."""
    c = _cells(spark, d).withColumn("path", F.col("cell_id"))
    blobs = c.where(F.json_array_length(F.get_json_object("payload", "$.items")) > 2).select("path")
    return latest.parse_lookup(c.select("paper_sha", "parser", "saved_at", "cell_id", "path"), blobs, ["paper_sha", "parser"], ["saved_at", "cell_id"], "path")


_METRIC = ["parser", "label", "model_id", "role", "mode", "n_valid", "n_errors", "tp", "gt_total", "recall", "precision", "f1", "in_tokens", "out_tokens", "eur_per_paper", "eur_per_tp", "latency_s", "temperature", "prompt_hash"]


@query(
    "SELECT CAST(row_id AS VARCHAR) AS paper, "
    + ", ".join(f"nullif({c}, '') AS {c}" if c in ("parser", "label", "model_id", "role", "mode", "prompt_hash") else f'"{c}"' for c in _METRIC)
    + " FROM matrix_rows"
)
def q_metric_csv(spark, d):
    """Metric rows written as CSV and read again with their types."""
    path = scratch(spark, "metrics")
    m = matrix(spark, d).withColumn("paper", F.col("row_id").cast("string"))
    files.write_csv(m.select(*(c.split(" ")[0] for c in files.METRICS.split(", "))), path)
    return files.metric_rows(spark, path)


@query("""SELECT json_extract_string(p, '$.type') AS type, json_extract_string(p, '$.unit_label') AS unit_label, count(*) AS n FROM (SELECT TRY_CAST(payload AS JSON) AS p FROM drift_lines) WHERE json_type(p) = 'OBJECT' GROUP BY 1, 2""")
def q_json_lines(spark, d):
    """Lines appended to a log and read back; torn ones are skipped."""
    path = scratch(spark, "log")
    table(spark, d, "drift_lines").select("payload").where("payload is not null").write.mode("append").text(path)
    return files.json_lines(spark, path, "type string, unit_label string").groupBy("type", "unit_label").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS role, user_id FROM events")
def q_log_append(spark, d):
    """Two appends to one log, read back whole."""
    path = scratch(spark, "log")
    e = events(spark, d).select("event_id", F.col("event_type").alias("role"), "user_id")
    files.lines_appended(e.where("event_id % 2 = 0"), path)
    files.lines_appended(e.where("event_id % 2 = 1"), path)
    return files.json_lines(spark, path, "event_id long, role string, user_id long").select("event_id", "role", "user_id")


@query("SELECT series, line_id FROM (SELECT series, line_id, row_number() OVER (PARTITION BY series ORDER BY file_date DESC, file_name DESC, line_no DESC, line_id DESC) AS r FROM drift_lines) WHERE r <= 5")
def q_log_tail(spark, d):
    order = [F.desc(c) for c in ("file_date", "file_name", "line_no", "line_id")]
    return files.log_tail(table(spark, d, "drift_lines").select("series", "line_id", "file_date", "file_name", "line_no"), ["series"], order, 5).select("series", "line_id")


_NOTE = "SELECT doc_id, source, lang, substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 40) AS said, text FROM documents WHERE text IS NOT NULL"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'note-' || doc_id END AS name, CASE WHEN doc_id % 7 <> 0 THEN nullif(trim(said, ' '), '') END AS description,
 CASE WHEN doc_id % 7 <> 0 THEN array_to_string(list_filter([source, lang], lambda x: x IS NOT NULL AND trim(x) <> ''), ',') END AS targets, CASE WHEN doc_id % 7 <> 0 THEN length(text) END AS n_body, doc_id % 7 = 0 AS refused FROM ({_NOTE})""")
def q_front_matter(spark, d):
    """Documents as skill files; every seventh comes without its head."""
    n = docs(spark, d).where("text is not null").select("doc_id", "source", "lang", F.substring(F.regexp_replace("text", "[^A-Za-z ]", ""), 1, 40).alias("said"), "text")
    head = F.concat(F.lit("---\nname: note-"), F.col("doc_id"), F.lit("\ndescription: "), "said", F.lit("\ntargets: ["), F.concat_ws(", ", "source", "lang"), F.lit("]\n---\n"))
    f = files.front_matter_of(n.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 7 != 0, F.concat(head, "text")).otherwise(F.concat(F.lit("no head\n"), "text")).alias("text")))
    given = F.col("problem").isNull()
    return f.select(F.col("path").alias("doc_id"), "name", "description", F.when(given, F.array_join("targets", ",")).alias("targets"), F.length("body").alias("n_body"), (~given).alias("refused"))


@query("""WITH t AS (SELECT cell_id, parser, list_sort(list_distinct(list(type))) AS types FROM (SELECT c.cell_id, c.parser, i.type FROM CELLS_VIEW c JOIN ITEMS_VIEW i USING (cell_id) WHERE i.type IS NOT NULL) GROUP BY 1, 2)
SELECT CAST(cell_id AS VARCHAR) AS name, 'uses: ' || parser AS reason FROM t WHERE parser = 'chandra'
UNION ALL SELECT CAST(cell_id AS VARCHAR), 'targets: ' || array_to_string(list_filter(types, lambda x: x IN ('ECSA', 'Stability')), ', ') FROM t WHERE len(list_filter(types, lambda x: x IN ('ECSA', 'Stability'))) > 0""")
def q_skill_gate(spark, d):
    """Cells as skills: their types against a vocabulary without two of the classes, their parser against the tools."""
    i = _items(spark, d).where("type is not null").groupBy("cell_id", "parser").agg(F.array_sort(F.collect_set("type")).alias("targets"))
    s = i.select(F.col("cell_id").cast("string").alias("name"), "targets", F.array().cast("array<string>").alias("reads"), F.array("parser").alias("uses"))
    return records.skill_problems(s, [t for t in CANONICAL_UNIT if t not in ("ECSA", "Stability")], [], [p for p in PARSERS if p != "chandra"])


@query("""WITH l AS (SELECT lower(term) AS label, term_id FROM vocab_terms UNION SELECT lower(gloss), term_id FROM vocab_terms), k AS (SELECT label, count(DISTINCT term_id) AS n, min(term_id) AS iri FROM l GROUP BY 1),
w AS (SELECT DISTINCT condition.cell_type AS entry FROM facts WHERE condition.cell_type IS NOT NULL UNION SELECT DISTINCT condition.cell_type_family FROM facts WHERE condition.cell_type_family IS NOT NULL)
SELECT entry, CASE WHEN n = 1 THEN iri END AS iri, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' END AS problem FROM w LEFT JOIN k ON lower(entry) = label""")
def q_ontology_labels(spark, d):
    v = table(spark, d, "vocab_terms")
    labels = v.select(F.col("term").alias("label"), F.col("term_id").alias("iri")).unionByName(v.select(F.col("gloss").alias("label"), F.col("term_id").alias("iri")))
    f = facts(spark, d)
    w = f.select(F.col("condition.cell_type").alias("entry")).unionByName(f.select(F.col("condition.cell_type_family").alias("entry"))).where("entry is not null").distinct()
    return graph.resolved(w, "entry", labels)


@query(f"SELECT paper, parser, label, arg_max(f1, row_id) AS f1, max(row_id) AS row_id FROM {_MATRIX} GROUP BY 1, 2, 3")
def q_upserted(spark, d):
    m = _matrix_keys(spark, d).select("paper", "parser", "label", "f1", "row_id")
    return latest.upserted(m.where("row_id % 2 = 0"), m.where("row_id % 2 = 1"), ["paper", "parser", "label"], "row_id")


@query("""WITH p AS (SELECT lower(doi) AS doi, sha256, added_at, added_at < TIMESTAMP '2026-05-01' AS old FROM papers WHERE doi IS NOT NULL)
SELECT doi, sha256 FROM p WHERE old UNION ALL SELECT doi, arg_min(sha256, (added_at, sha256)) FROM p WHERE NOT old AND doi NOT IN (SELECT doi FROM p WHERE old) GROUP BY 1""")
def q_inserted_if_absent(spark, d):
    p = papers(spark, d).where("doi is not null").select(F.lower("doi").alias("doi"), "sha256", F.col("added_at").cast("timestamp").alias("at"))
    p = p.withColumn("seq", F.struct("at", "sha256"))
    old = F.col("at") < F.lit("2026-05-01").cast("timestamp")
    return latest.inserted_if_absent(p.where(old), p.where(~old), ["doi"], "seq").select("doi", "sha256")


@query("""SELECT kind, provider, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(20,12))) AS DOUBLE) AS eur FROM (
 SELECT 'llm' AS kind, label AS provider, round((coalesce(in_tokens, 0) * (0.4::DOUBLE / 1e6::DOUBLE) + coalesce(out_tokens, 0) * (1.6::DOUBLE / 1e6::DOUBLE)) * 0.92::DOUBLE, 8) AS amount FROM CELLS_VIEW
 UNION ALL SELECT 'gpu', NULL, round(latency_s / 3600 * 0.44::DOUBLE * 0.92::DOUBLE, 8) FROM CELLS_VIEW WHERE latency_s IS NOT NULL) GROUP BY 1, 2""")
def q_ledger(spark, d):
    e = records.ledger_entries(_cells(spark, d), {"in": 0.4, "out": 1.6}, 0.44)
    return e.groupBy("kind", "provider").agg(F.count("*").alias("n"), F.sum(F.round("amount_eur", 8).cast("decimal(20,12)")).cast("double").alias("eur"))


@query("SELECT kind, provider, cell_id, ts FROM (SELECT 'llm' AS kind, label AS provider, cell_id, saved_at AS ts FROM CELLS_VIEW UNION ALL SELECT 'gpu', NULL, cell_id, saved_at FROM CELLS_VIEW WHERE latency_s IS NOT NULL) ORDER BY ts DESC, cell_id DESC, kind LIMIT 10")
def q_last_ledger(spark, d):
    e = records.ledger_entries(_cells(spark, d), {"in": 0.4, "out": 1.6}, 0.44).select("kind", "provider", "cell_id", "ts")
    return latest.last_n(e, 10, [F.desc("ts"), F.desc("cell_id"), F.asc("kind")])


@query("SELECT event_type || '.' || user_id AS key, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1")
def q_settings(spark, d):
    """Settings by key, the last one written."""
    kv = events(spark, d).select(F.concat_ws(".", "event_type", "user_id").alias("key"), F.col("props").alias("value"), F.struct("ts", "event_id").alias("seq"))
    return latest.upserted(kv.limit(0), kv, ["key"], "seq").select("key", "value")


@query(r"""SELECT '<sourceText> "' || replace(replace(replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '" .' AS statement, n FROM (SELECT evidence.source_text AS t, count(*) AS n FROM facts WHERE evidence.source_text IS NOT NULL GROUP BY 1)
UNION ALL SELECT '<page> "' || evidence.page || '"^^<http://www.w3.org/2001/XMLSchema#integer> .', count(*) FROM facts WHERE evidence.page IS NOT NULL GROUP BY 1
UNION ALL SELECT '<sha256> "' || lower(sha) || '" .', 1 FROM (SELECT DISTINCT lower(sha) AS sha FROM facts)
UNION ALL SELECT '<unitLabel> "' || unit_label || '" .', count(*) FROM facts WHERE unit_label IS NOT NULL GROUP BY 1""")
def q_turtle(spark, d):
    """Statements of the default graph without their subjects, which are hashes, counted."""
    q = graph.fact_quads(facts(spark, d), ["sourceText", "page", "sha256", "unitLabel", "runId"])
    return graph.turtle_lines(q).select(F.regexp_replace("line", r"^\S+ ", "").alias("statement")).groupBy("statement").agg(F.count("*").alias("n"))


# --- projections and filters --------------------------------------------------------------------------------------


@query("SELECT fact_id, CASE WHEN type IN ('ECSA', 'Stability') THEN 'https://example.org/terms#' || type ELSE type END AS name FROM facts WHERE type IS NOT NULL")
def q_friendly_types(spark, d):
    """Class IRIs by their names; two classes are missing from the names and keep their IRI."""
    iri = lambda c: F.concat(F.lit("ex:"), c)
    whole = lambda c: graph.expanded(iri(F.col(c)), {"ex": "https://example.org/terms#"})
    names = table(spark, d, "fact_types").where("type not in ('ECSA', 'Stability')").select(whole("type").alias("iri"), F.col("type").alias("name"))
    return graph.friendly(facts(spark, d).where("type is not null").select("fact_id", whole("type").alias("iri")), "iri", names).select("fact_id", "name")


@query("SELECT fact_id FROM facts WHERE lower(trim(parser)) = 'dots' AND model = 'elm-local'")
def q_cell_filter(spark, d):
    return files.cell_filter(facts(spark, d).withColumn("parser", _parser()), "dots", "elm-local").select("fact_id")


@query("SELECT ref, CASE WHEN regexp_full_match(ref, '[0-9a-fA-F]{64}') THEN lower(ref) END AS sha, regexp_full_match(ref, '[0-9a-fA-F]+') AS hex FROM (SELECT filename AS ref FROM papers UNION ALL SELECT sha FROM facts WHERE sha IS NOT NULL UNION ALL SELECT paper_sha8 FROM matrix_rows WHERE paper_sha8 IS NOT NULL)")
def q_paper_refs(spark, d):
    r = papers(spark, d).select(F.col("filename").alias("ref")).unionByName(facts(spark, d).select(F.col("sha").alias("ref")).where("ref is not null")).unionByName(matrix(spark, d).select(F.col("paper_sha8").alias("ref")).where("ref is not null"))
    return r.select("ref", files.paper_ref(F.col("ref")).alias("sha"), files.is_hex(F.col("ref")).alias("hex"))


@query("SELECT event_id AS call_id, CASE WHEN user_id % 5 IN (0, 1) THEN '[redacted: secret path]' ELSE props END AS content FROM events WHERE event_type = 'view'")
def q_masked_results(spark, d):
    v = events(spark, d).where("event_type = 'view'")
    k = F.col("user_id") % 5
    path = F.when(k == 0, "conf/.env").when(k == 1, "keys/server.pem").otherwise(F.concat(F.lit("notes/"), "user_id", F.lit(".md")))
    return files.masked_results(v.select(F.col("event_id").alias("call_id"), F.col("props").alias("content")), v.select(F.col("event_id").alias("call_id"), path.alias("path")))


# --- windows and limits -------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS k FROM events GROUP BY 1 QUALIFY k <= 5),
e AS (SELECT s.k, ts, event_id, event_type, lag(event_type) OVER (ORDER BY s.k DESC, ts, event_id) AS p FROM events JOIN s USING (user_id))
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY k, ts DESC, event_id DESC) AS r FROM e WHERE event_type IS DISTINCT FROM p) WHERE r <= 200""")
def q_history(spark, d):
    """What was entered in the last five sessions, oldest first, repeats in a row once, the last 200."""
    e = events(spark, d)
    last = latest.last_n(e.groupBy("user_id").agg(F.max("ts").alias("at")), 5, [F.desc("at"), F.asc("user_id")])
    last = last.withColumn("k", F.row_number().over(W.orderBy(F.desc("at"), "user_id")))  # five rows
    h = e.join(last.select("user_id", "k"), "user_id")
    runs = latest.changes_only(h, ["k"], ["ts", "event_id"], "event_type")
    # a run may reach over the end of a session: its last entry is compared with the first of the next
    ends = h.groupBy("k").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("ending")).select((F.col("k") - 1).alias("k"), "ending")
    firsts = h.groupBy("k").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    same = firsts.join(ends, "k").where("event_type = ending").select("event_id")
    return latest.last_n(runs.join(same, "event_id", "left_anti"), 200, [F.asc("k"), F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("SELECT fact_id, page FROM (SELECT fact_id, evidence.page AS page FROM facts) ORDER BY page, fact_id")
def q_facts_by_page(spark, d):
    return facts(spark, d).select("fact_id", F.col("evidence.page").alias("page")).orderBy(F.asc_nulls_first("page"), "fact_id")


@query(f"SELECT parser, label, max(f1) AS f1, max(row_id) AS row_id FROM {_MATRIX} GROUP BY 1, 2 ORDER BY f1 DESC NULLS LAST, row_id DESC LIMIT 25")
def q_top_candidates(spark, d):
    g = _matrix_keys(spark, d).groupBy("parser", "label").agg(F.max("f1").alias("f1"), F.max("row_id").alias("row_id"))
    return latest.last_n(g, 25, [F.desc_nulls_last("f1"), F.desc("row_id")])


@query("SELECT source_file, max(recorded_at) AS last_at, count(*) AS n FROM matrix_rows GROUP BY 1 ORDER BY last_at DESC, source_file LIMIT 20")
def q_newest_snapshots(spark, d):
    g = matrix(spark, d).groupBy("source_file").agg(F.max("recorded_at").alias("last_at"), F.count("*").alias("n"))
    return latest.last_n(g, 20, [F.desc("last_at"), F.asc("source_file")])


@query(f"""WITH RECURSIVE o AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS k FROM {_PURCHASES}),
s(k, spent, event_id, allowed) AS (SELECT 0::BIGINT, 0.0::DOUBLE, NULL::BIGINT, NULL::BOOLEAN UNION ALL
 SELECT o.k, CASE WHEN spent + value <= 5000 THEN spent + value ELSE spent END, o.event_id, spent + value <= 5000 FROM s JOIN o ON o.k = s.k + 1)
SELECT event_id, allowed FROM s WHERE k > 0""")
def q_capped(spark, d):
    """Spending against a cap, refused entries not counted as spent."""
    return records.capped(_spend(spark, d), "value", ["ts", "event_id"], 5000.0).select("event_id", "allowed")


@query(
    r"""SELECT fact_id AS id, '{"id":' || fact_id || ',"fact_id":' || fact_id || ',"author":"reader","prior_unit":' || coalesce(CAST(to_json(unit_label) AS VARCHAR), '') || ',"flagged_wrong":true}' AS record
FROM FACTS_VIEW WHERE value < 0 AND evidence IS NOT NULL AND trim(coalesce(evidence.source_text, '')) <> '' AND unit_label IS NOT NULL"""
)
def q_audit_records(spark, d):
    a = records.corrections_applied(_requests(spark, d), facts(spark, d))[0].where("prior_unit is not null")
    return records.audit_records(a.select("id", "fact_id", "author", "prior_unit", "flagged_wrong"))


# --- graph --------------------------------------------------------------------------------------------------------


@query("""SELECT 'data' AS graph, 'value' AS predicate, count(*) AS n FROM FACTS_VIEW WHERE value IS NOT NULL UNION ALL SELECT 'data', 'unitLabel', count(*) FROM facts WHERE unit_label IS NOT NULL
UNION ALL SELECT 'data', 'sha256', count(DISTINCT lower(sha)) FROM facts UNION ALL SELECT 'run', 'runId', count(*) FROM facts WHERE run_id IS NOT NULL""")
def q_quad_store(spark, d):
    """Quads written to a store and read back; the census opens four predicates of it."""
    q = graph.stored(graph.fact_quads(facts(spark, d), ["value", "unitLabel", "confidence", "sha256", "runId"]), scratch(spark, "quads"))
    return q.where(F.col("predicate").isin("value", "unitLabel", "sha256", "runId")).groupBy("graph", "predicate").agg(F.count("*").alias("n"))


@query("SELECT unit, count(*) AS n FROM (SELECT CASE unit_label WHEN 'mV' THEN 'millivolt' ELSE unit_label END AS unit FROM facts WHERE unit_label IS NOT NULL) GROUP BY 1")
def q_graph_update(spark, d):
    """DELETE and INSERT of one literal wherever it stands, as a new version of the quads."""
    q = graph.updated(graph.fact_quads(facts(spark, d), ["unitLabel"]), (F.col("p") == "unitLabel") & (F.col("o_lex") == "mV"), {"o_lex": F.lit("millivolt")})
    return q.groupBy(F.col("o_lex").alias("unit")).agg(F.count("*").alias("n"))


@query("SELECT lower(sha) AS sha, fact_id, extracted_at AS at, value AS prior_value, abs(value) AS corrected_value, true AS flagged FROM FACTS_VIEW WHERE value < 0 AND evidence IS NOT NULL AND trim(coalesce(evidence.source_text, '')) <> ''")
def q_corrections_read(spark, d):
    """Corrections per paper, oldest first; the facts stay as they are."""
    a = records.corrections_applied(_requests(spark, d), facts(spark, d))[0]
    c = a.join(facts(spark, d).select("fact_id", F.lower("sha").alias("sha")), "fact_id")
    return c.select("sha", "fact_id", "at", "prior_value", "corrected_value", F.col("flagged_wrong").alias("flagged")).orderBy("sha", "at", "fact_id")


# --- sets ---------------------------------------------------------------------------------------------------------


@query("SELECT lower(sha) AS sha, type, value, unit_label, evidence.source_text AS source_text, min(fact_id) AS fact_id FROM FACTS_VIEW WHERE fact_id % 4 <> 3 GROUP BY 1, 2, 3, 4, 5")
def q_sample_union(spark, d):
    """Three samples of one extraction put together, each fact once, the first kept."""
    f = facts(spark, d).select("fact_id", F.lower("sha").alias("sha"), "type", "value", "unit_label", F.col("evidence.source_text").alias("source_text"))
    samples = f.where("fact_id % 4 = 0").unionByName(f.where("fact_id % 4 = 1")).unionByName(f.where("fact_id % 4 = 2"))
    return latest.first(samples, ["sha", "type", "value", "unit_label", "source_text"], ["fact_id"])


@query("""WITH a AS (SELECT paper_sha, type, value, cell_id, item_no FROM ITEMS_VIEW WHERE mode = 'raw' AND type IS NOT NULL), b AS (SELECT paper_sha, type, value, cell_id, item_no FROM ITEMS_VIEW WHERE mode = 'requery' AND type IS NOT NULL),
u AS (SELECT *, 1 AS pass FROM a UNION ALL SELECT *, 2 FROM b WHERE paper_sha IN (SELECT paper_sha FROM a) AND NOT EXISTS (SELECT 1 FROM a WHERE a.paper_sha = b.paper_sha AND a.type = b.type))
SELECT paper_sha, type, value, arg_min(cell_id, (pass, cell_id, item_no)) AS cell_id FROM u GROUP BY 1, 2, 3""")
def q_requery_union(spark, d):
    i = _items(spark, d).where("type is not null").select("paper_sha", "mode", "type", "value", "cell_id", "item_no")
    one, two = (i.where(F.col("mode") == m).drop("mode") for m in ("raw", "requery"))
    return scoring.requeried(one, two, ["paper_sha"], sorted(CANONICAL_UNIT), ["cell_id", "item_no"]).select("paper_sha", "type", "value", "cell_id")


@query("SELECT paper_sha, parser, type, value, min(cell_id) AS cell_id FROM ITEMS_VIEW WHERE mode = 'raw' AND label IN ('dune-flash', 'boreal-pro') GROUP BY 1, 2, 3, 4")
def q_model_union(spark, d):
    i = _items(spark, d).where("mode = 'raw' and label in ('dune-flash', 'boreal-pro')").select("paper_sha", "parser", "label", "type", "value", "cell_id", "item_no")
    return scoring.unioned(i, ["paper_sha", "parser"], "label", 1, ["cell_id", "item_no"]).select("paper_sha", "parser", "type", "value", "cell_id")


@query("""WITH x AS (SELECT cell_id, list(CAST(item_no AS INT) ORDER BY item_no) AS items, list(coalesce(TRY_CAST(json_extract_string(item, '$.confidence') AS DOUBLE) >= 0.5, false) ORDER BY item_no) AS v FROM ITEMS_VIEW GROUP BY 1)
SELECT cell_id, array_to_string(CASE WHEN cell_id % 6 = 0 AND len(v) > 1 THEN items ELSE list_filter(items, lambda a, i: v[i]) END, ',') AS kept FROM x""")
def q_judged(spark, d):
    """Items a judge keeps; every sixth verdict is one too short, which keeps all."""
    ok = F.coalesce(F.get_json_object("item", "$.confidence").try_cast("double") >= 0.5, F.lit(False))
    a = _items(spark, d).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("item_no", ok.alias("ok")))).alias("a"))  # items of one payload
    v = F.transform("a", lambda x: x["ok"])
    short = F.when((F.col("cell_id") % 6 == 0) & (F.size("a") > 1), F.slice(v, F.lit(1), F.size("a") - 1)).otherwise(v)
    kept = scoring.judged(F.transform("a", lambda x: x["item_no"].cast("string")), short)
    return a.select("cell_id", F.array_join(kept, ",").alias("kept"))


# --- evaluation ---------------------------------------------------------------------------------------------------

_FITS = "abs({p} - {g}) <= greatest(abs({g}) * 0.01::DOUBLE, CASE WHEN abs({g}) >= 1 THEN 0.5::DOUBLE ELSE 1e-4::DOUBLE END)"
_GREEDY_FIT = _FITS.format(p="preds[pi + 1].value", g="gold[x + 1].value")
_WRONG_FIT = _FITS.format(p="preds[x + 1].value", g="gold[gi + 1].value")
_GOLD = f"""it AS (SELECT * FROM {_ITEMS} WHERE type IS NOT NULL), fc AS (SELECT paper_sha, min(cell_id) AS gold_cell FROM {_CELLS} GROUP BY 1),
pr AS (SELECT cell_id, paper_sha, parser, label, mode, list({{'type': type, 'value': value}} ORDER BY item_no) AS preds FROM it GROUP BY ALL),
seen AS (SELECT DISTINCT paper_sha, round(value, 3) AS v FROM it JOIN fc USING (paper_sha) WHERE cell_id <> gold_cell),
gd AS (SELECT it.paper_sha AS paper_sha, gold_cell, list({{'type': type, 'value': value}} ORDER BY item_no) AS gold, list(s.v IS NOT NULL ORDER BY item_no) AS present
 FROM it JOIN fc USING (paper_sha) LEFT JOIN seen s ON s.paper_sha = it.paper_sha AND s.v = round(value, 3) WHERE cell_id = gold_cell GROUP BY 1, 2),
"""
_GREEDY = f"""g(cell_id, pi, hp, hg) AS (SELECT cell_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM sc UNION ALL
 SELECT cell_id, pi + 1, CASE WHEN hit IS NULL THEN hp ELSE list_append(hp, pi) END, CASE WHEN hit IS NULL THEN hg ELSE list_append(hg, hit) END FROM (
  SELECT g.*, list_filter(range(len(gold)), lambda x: gold[x + 1].type = preds[pi + 1].type AND {_GREEDY_FIT} AND NOT list_contains(hg, x))[1] AS hit FROM g JOIN sc USING (cell_id) WHERE pi < len(preds))),
h AS (SELECT sc.*, hp, hg FROM sc JOIN g USING (cell_id) WHERE pi = len(preds)),
"""
_SCORED = "WITH RECURSIVE " + _GOLD + "sc AS (SELECT pr.*, gold, present FROM pr JOIN gd USING (paper_sha) WHERE cell_id <> gold_cell),\n" + _GREEDY
_PRF = "len(hp) AS tp, len(preds) AS n_preds, len(gold) AS n_gold, len(hp)::DOUBLE / len(gold) AS recall, len(hp)::DOUBLE / len(preds) AS \"precision\""


@query(f"""{_SCORED} r AS (SELECT cell_id, {_PRF} FROM h)
SELECT cell_id, CAST(tp AS INT) AS tp, CAST(n_preds AS INT) AS n_preds, CAST(n_gold AS INT) AS n_gold, recall, "precision", coalesce(2 * recall * "precision" / nullif(recall + "precision", 0), 0) AS f1 FROM r""")
def q_greedy_score(spark, d):
    s = scoring.scored(_scoring_cells(spark, d))
    return s.select("cell_id", "tp", "n_preds", "n_gold", "recall", "precision", "f1")


_CLASSIFIED = f"""{_SCORED}
w(cell_id, gi, wp, wg) AS (SELECT cell_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM h UNION ALL
 SELECT cell_id, gi + 1, CASE WHEN hit IS NULL THEN wp ELSE list_append(wp, hit) END, CASE WHEN hit IS NULL THEN wg ELSE list_append(wg, gi) END FROM (
  SELECT w.*, CASE WHEN NOT list_contains(hg, gi) AND gold[gi + 1].value IS NOT NULL AND present[gi + 1] THEN
   list_filter(range(len(preds)), lambda x: {_WRONG_FIT} AND NOT list_contains(hp, x) AND NOT list_contains(wp, x))[1] END AS hit FROM w JOIN h USING (cell_id) WHERE gi < len(gold))),
k AS (SELECT h.*, wp, wg FROM h JOIN w USING (cell_id) WHERE gi = len(gold)),
t AS (SELECT cell_id, parser, label, unnest(gold).type AS type, unnest(list_transform(range(len(gold)), lambda x: CASE WHEN list_contains(hg, x) THEN 'hit' WHEN list_contains(wg, x) THEN 'wrong_type' WHEN NOT present[x + 1] THEN 'coverage_gap' ELSE 'model_gap' END)) AS status FROM k)"""
_STATUSES = ("hit", "wrong_type", "coverage_gap", "model_gap")


@query(f"""{_CLASSIFIED} SELECT parser, label, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUSES)}, any_value(fp) AS fp, count(DISTINCT cell_id) AS n_cells
FROM t JOIN (SELECT parser, label, CAST(sum(len(preds) - len(hp) - len(wp)) AS BIGINT) AS fp FROM k GROUP BY 1, 2) USING (parser, label) GROUP BY 1, 2""")
def q_taxonomy(spark, d):
    c = scoring.classified(_scoring_cells(spark, d))
    n = lambda s: F.sum(F.size(F.filter("per_tuple", lambda x: x["status"] == s))).alias(s)
    return c.groupBy("parser", "label").agg(*(n(s) for s in _STATUSES), F.sum("fp").alias("fp"), F.count("*").alias("n_cells"))


@query(f"""{_CLASSIFIED}, c AS (SELECT type, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUSES)}, count(*) AS n FROM t GROUP BY 1)
SELECT type, hit, wrong_type, coverage_gap, model_gap, hit::DOUBLE / n AS recall, coalesce(hit::DOUBLE / nullif(n - coverage_gap, 0), 0) AS reachable_recall FROM c""")
def q_recall_by_type(spark, d):
    t = scoring.classified(_scoring_cells(spark, d)).select(F.explode("per_tuple").alias("t"))
    p = t.groupBy("t.type").pivot("t.status", list(_STATUSES)).count().na.fill(0)
    total = F.col("hit") + F.col("wrong_type") + F.col("coverage_gap") + F.col("model_gap")
    return p.withColumn("recall", F.col("hit") / total).withColumn("reachable_recall", F.coalesce(F.try_divide(F.col("hit"), total - F.col("coverage_gap")), F.lit(0.0)))


@query(f"""{_SCORED} f AS (SELECT paper_sha, label, cell_id, unnest(list_filter(range(len(preds)), lambda x: NOT list_contains(hp, x))) AS x, preds FROM h),
v AS (SELECT preds[x + 1].type AS type, round(preds[x + 1].value, 3) AS value, substr(paper_sha, 1, 8) AS sha8, label, cell_id, x,
 row_number() OVER (PARTITION BY cell_id ORDER BY x) - 1 AS k FROM f WHERE preds[x + 1].value IS NOT NULL),
p AS (SELECT type, value, sha8, count(DISTINCT label) AS n_models, min(cell_id * 10000 + x) AS seq FROM v GROUP BY 1, 2, 3)
SELECT type, value, sha8, n_models, CASE WHEN n_models >= 3 THEN 'likely real' WHEN n_models = 2 THEN 'ambiguous' ELSE 'likely invented' END AS band
FROM (SELECT *, row_number() OVER (PARTITION BY type, value ORDER BY n_models DESC, seq) AS r FROM p) WHERE r = 1""")
def q_false_positive_agreement(spark, d):
    s = scoring.scored(_scoring_cells(spark, d))
    left = F.filter(scoring.indexes(F.col("preds")), lambda i: ~F.exists("hits", lambda x: x["pi"] == i))
    f = s.select("paper_sha", "label", "cell_id", "preds", F.explode(left).alias("x")).withColumn("t", F.get("preds", F.col("x")))
    return scoring.agreement(f.select(F.col("t.type").alias("type"), F.col("t.value").alias("value"), F.col("paper_sha").alias("sha"), "label", (F.col("cell_id") * 10000 + F.col("x")).alias("seq")))


@query(f"""{_SCORED} r AS (SELECT mode, {_PRF} FROM h) SELECT mode, count(*) AS n_cells, CAST(sum(tp) AS BIGINT) AS tp, round(avg(recall), 9) AS recall FROM r GROUP BY 1""")
def q_arms(spark, d):
    """The arms of the evaluation, scored from cached cells without a call to any model."""
    s = scoring.scored(_scoring_cells(spark, d))
    return s.groupBy("mode").agg(F.count("*").alias("n_cells"), F.sum("tp").alias("tp"), F.round(F.avg("recall"), 9).alias("recall"))


@query(f"""WITH RECURSIVE {_GOLD} kk AS (SELECT paper_sha, label FROM it WHERE mode = 'raw' GROUP BY 1, 2 HAVING count(DISTINCT parser) >= 2),
fi AS (SELECT paper_sha, label, type, value, min((cell_id, item_no)) AS o FROM it JOIN kk USING (paper_sha, label) WHERE mode = 'raw' GROUP BY 1, 2, 3, 4),
sc AS (SELECT paper_sha || ' ' || label AS cell_id, paper_sha, label, preds, gold FROM (SELECT paper_sha, label, list({{'type': type, 'value': value}} ORDER BY o) AS preds FROM fi GROUP BY 1, 2) JOIN gd USING (paper_sha)),
{_GREEDY} r AS (SELECT label, {_PRF} FROM h) SELECT label, count(*) AS n_papers, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_preds) AS BIGINT) AS n_preds FROM r GROUP BY 1""")
def q_union_arm(spark, d):
    """The parser-union arm: raw cells of a paper and model over all parsers as one prediction list, scored."""
    i = _items(spark, d).where("mode = 'raw' and type is not null").select("paper_sha", "label", "parser", "type", "value", "cell_id", "item_no")
    u = scoring.unioned(i, ["paper_sha", "label"], "parser", 2, ["cell_id", "item_no"])
    arr = F.array_sort(F.collect_list(F.struct("cell_id", "item_no", "type", "value")))
    per = u.groupBy("paper_sha", "label").agg(F.transform(arr, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("preds"))
    s = scoring.scored(per.join(_gold(spark, d), "paper_sha"))
    return s.groupBy("label").agg(F.count("*").alias("n_papers"), F.sum("tp").alias("tp"), F.sum("n_preds").alias("n_preds"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _gold_cells(spark, d, _items(spark, d).where("type is not null")).select("paper_sha", "gold")
