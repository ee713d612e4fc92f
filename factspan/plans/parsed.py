"""Registered queries on parser outputs, citations, guards, drops and boxes, each with its SQL.

Parser outputs are not among the given tables, so Spark derives them: the facts of one paper and parser, 64 ids at a
time, are written in the JSON of their parser and read again by its adapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.functions import numbers, text, units
from factspan.operators import evidence, records
from factspan.plans.core import _CELLS, _PLAIN, _SIG, VIEWS, _cells, facts, query
from factspan.session import table
from factspan.sources import spans

_SIDES = ("x0", "y0", "x1", "y1")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """sha, parser, part, raw: what each parser would have written; a file holds at most 64 pieces of text."""
    b = facts(spark, d).select(
        F.lower(F.trim("sha")).alias("sha"), F.lower(F.trim("parser")).alias("parser"), F.floor(F.col("fact_id") / 64).alias("part"),
        "fact_id", F.col("evidence.page").alias("page"), F.col("evidence.source_text").alias("text"), *(F.col(f"evidence.bbox_{c}").alias(c) for c in _SIDES),
    )
    g = b.groupBy("sha", "parser", "part").agg(F.array_sort(F.collect_list(F.struct("fact_id", "page", "text", *_SIDES))).alias("b"), F.max("page").alias("last"))
    box = lambda x: F.array(*(x[c] for c in _SIDES))
    half = lambda x: F.floor(F.length(x["text"]) / 2).cast("int")
    two = lambda x: F.array(F.struct(F.substring(x["text"], F.lit(1), half(x)).alias("content")).alias("c"))
    pages = F.sequence(F.lit(1), F.col("last"))
    of = lambda p: F.filter("b", lambda x: x["page"] == p)
    mineru = F.transform(pages, lambda p: F.transform(of(p), lambda x: F.struct(F.lit("text").alias("type"), F.struct(two(x).alias("parts"), F.substring(x["text"], half(x) + 1, F.lit(1_000_000)).alias("math_content")).alias("inner"), box(x).alias("bbox"))))
    dots = F.struct(F.transform(pages, lambda p: F.transform(of(p), lambda x: F.struct(x["text"].alias("text"), box(x).alias("bbox")))).alias("pages"))
    size = lambda p: (F.when(p % 2 == 0, 595).otherwise(842).alias("width"), F.when(p % 2 == 0, 842).otherwise(595).alias("height"))
    paddle = F.struct(F.transform(pages, lambda p: F.struct(F.struct((p - 1).alias("page_index"), *size(p), F.transform(of(p), lambda x: F.struct(x["text"].alias("block_content"), box(x).alias("block_bbox"))).alias("parsing_res_list")).alias("res"))).alias("pages"))
    prov = lambda x: F.array(F.struct(x["page"].alias("page_no"), F.struct(*(x[c].alias(n) for c, n in zip(_SIDES, "ltrb"))).alias("bbox"))).alias("prov")
    is_table = lambda x: x["text"].contains("|")
    texts = F.transform(F.filter("b", lambda x: ~is_table(x)), lambda x: F.struct(F.lit("").alias("text"), x["text"].alias("orig"), prov(x)))
    grid = lambda x: F.struct(F.array(F.transform(F.split(x["text"], r"\|"), lambda c: F.struct(c.alias("text")))).alias("grid")).alias("data")
    tables = F.transform(F.filter("b", is_table), lambda x: F.struct(prov(x), grid(x)))
    seen = F.array_distinct(F.transform("b", lambda x: x["page"]))
    sized = F.map_from_entries(F.transform(seen, lambda p: F.struct(p.cast("string").alias("k"), F.struct(F.struct(*size(p)).alias("size")).alias("v"))))
    docling = F.struct(texts.alias("texts"), tables.alias("tables"), sized.alias("pages"))
    raw = F.when(F.col("parser") == "mineru", F.to_json(mineru)).when(F.col("parser") == "dots", F.to_json(dots)).when(F.col("parser") == "paddle", F.to_json(paddle))
    return g.select("sha", "parser", "part", raw.when(F.col("parser") == "docling", F.to_json(docling)).otherwise(F.concat(F.lit("# "), "sha")).alias("raw"))


VIEWS["BLOCKS_VIEW"] = r"""(SELECT * FROM (SELECT lower(trim(sha)) AS sha, lower(trim(parser)) AS parser, fact_id // 64 AS part, fact_id, evidence.page AS page, evidence.source_text AS text,
 evidence.bbox_x0 AS x0, evidence.bbox_y0 AS y0, evidence.bbox_x1 AS x1, evidence.bbox_y1 AS y1 FROM facts) WHERE regexp_matches(text, '\S') AND page IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL)"""
_KEYS = ("sha", "parser", "part")


def _spans_of(spark: SparkSession, d: str, parser: str) -> DataFrame:
    s = spans.spans(_files(spark, d).where(F.col("parser") == parser), _KEYS)
    return s.select("sha", "part", "span_id", "page", "text", "bbox.x0", "bbox.y1")


@query("""SELECT sha, part, CAST(row_number() OVER (PARTITION BY sha, part ORDER BY page, fact_id) - 1 AS INT) AS span_id, page,
 substr(text, 1, length(text) // 2) || ' ' || substr(text, length(text) // 2 + 1) AS text, x0, y1 FROM BLOCKS_VIEW WHERE parser = 'mineru'""")
def q_spans_mineru(spark, d):
    return _spans_of(spark, d, "mineru")


@query("SELECT sha, part, CAST(row_number() OVER (PARTITION BY sha, part ORDER BY page, fact_id) - 1 AS INT) AS span_id, page, text, x0, y1 FROM BLOCKS_VIEW WHERE parser = 'dots'")
def q_spans_dots(spark, d):
    return _spans_of(spark, d, "dots")


@query("SELECT sha, part, CAST(row_number() OVER (PARTITION BY sha, part ORDER BY page, fact_id) - 1 AS INT) AS span_id, page, text, x0, y1 FROM BLOCKS_VIEW WHERE parser = 'paddle'")
def q_spans_paddle(spark, d):
    return _spans_of(spark, d, "paddle")


@query("""SELECT sha, part, CAST(row_number() OVER (PARTITION BY sha, part ORDER BY contains(text, '|'), fact_id) - 1 AS INT) AS span_id, page,
 array_to_string(string_split(text, '|'), ' ') AS text, x0, y1 FROM BLOCKS_VIEW WHERE parser = 'docling'""")
def q_spans_docling(spark, d):
    return _spans_of(spark, d, "docling")


@query("SELECT parser, count(*) AS n_spans FROM BLOCKS_VIEW WHERE parser <> 'chandra' AND part % 5 <> 4 GROUP BY 1")
def q_spans(spark, d):
    """All adapters behind their dispatcher; every fifth file is torn and the markdown has no geometry: no spans."""
    torn = F.when(F.col("part") % 5 == 4, F.substring("raw", F.lit(1), F.floor(F.length("raw") * 0.6).cast("int"))).otherwise(F.col("raw"))
    return spans.spans(_files(spark, d).withColumn("raw", torn), _KEYS).groupBy("parser").agg(F.count("*").alias("n_spans"))


@query("""WITH b AS (SELECT lower(trim(sha)) AS sha, lower(trim(parser)) AS parser, fact_id // 64 AS part, evidence.page AS page FROM facts),
p AS (SELECT DISTINCT sha, parser, part, page FROM b WHERE parser = 'docling' UNION SELECT sha, parser, part, unnest(range(1, max(page) + 1)) FROM b WHERE parser = 'paddle' GROUP BY 1, 2, 3)
SELECT sha, parser, part, page, CASE WHEN page % 2 = 0 THEN 595.0 ELSE 842.0 END::DOUBLE AS width, CASE WHEN page % 2 = 0 THEN 842.0 ELSE 595.0 END::DOUBLE AS height FROM p""")
def q_page_sizes(spark, d):
    f = _files(spark, d)
    return f.select(*_KEYS, F.explode(spans.page_sizes(F.col("parser"), F.col("raw"))).alias("p")).select(*_KEYS, "p.*")


# --- citations and guards -----------------------------------------------------------------------------------------


def _cited_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(items, spans): each fact's text as a span of its paper and parser, each fact as a candidate that cites it and the next."""
    f = table(spark, d, "facts").select("*", F.lower("sha").alias("_sha"), F.lower(F.trim("parser")).alias("_parser"))
    own, nxt, i = F.col("fact_id"), F.col("fact_id") + 1, F.col("fact_id")
    ids = F.when(i % 79 == 0, F.array().cast("array<bigint>")).when(i % 5 == 0, F.array(nxt, own)).otherwise(F.array(own, nxt))
    kind = F.when(i % 83 == 0, "Nonsense").when(i % 89 == 0, "Paper").otherwise(F.col("type"))
    items = f.select(
        i.alias("item_id"), F.col("_sha").alias("sha"), F.col("_parser").alias("parser"), (i % 97 != 0).alias("is_object"), kind.alias("type"), "unit_label",
        F.when(i % 71 == 0, "about 5").otherwise(F.col("value").cast("string")).alias("value_text"),
        F.when(i % 3 == 0, F.concat(F.lit("p="), F.col("confidence").cast("string"))).otherwise(F.col("confidence").cast("string")).alias("confidence_text"),
        ids.alias("span_ids"), F.to_json("condition").alias("condition"), F.col("condition.iR_correction").alias("ir"), F.col("confidence").alias("said_confidence"),
    )
    box = F.struct(*(F.col(f"evidence.bbox_{c}").alias(c) for c in _SIDES))
    s = f.select(F.col("_sha").alias("sha"), F.col("_parser").alias("parser"), i.alias("span_id"), F.col("evidence.page").alias("page"), F.col("evidence.source_text").alias("text"), box.alias("bbox"))
    return items, s


VIEWS["CITED_VIEW"] = r"""(SELECT i.*, s.text AS t1, u.text AS t2, s.page AS p1, u.page AS p2, s.x0 AS x1, u.x0 AS x2,
 CASE WHEN length(vd) >= 2 AND contains(regexp_replace(s.text, '[^0-9]', '', 'g'), vd) THEN 1 WHEN length(vd) >= 2 AND contains(regexp_replace(u.text, '[^0-9]', '', 'g'), vd) THEN 2 ELSE 0 END AS hit
FROM (SELECT fact_id AS item_id, lower(sha) AS sha, lower(trim(parser)) AS parser, fact_id % 97 <> 0 AS is_object, CASE WHEN fact_id % 83 = 0 THEN 'Nonsense' WHEN fact_id % 89 = 0 THEN 'Paper' ELSE type END AS type, unit_label, confidence,
  condition.iR_correction AS ir, CASE WHEN fact_id % 71 = 0 OR isnan(value) THEN NULL ELSE value END AS value, fact_id % 71 = 0 OR value IS NOT NULL AS given,
  CASE WHEN fact_id % 71 = 0 OR value IS NULL OR isnan(value) THEN '' ELSE regexp_replace(format('{:g}', value), '[^0-9]', '', 'g') END AS vd,
  CASE WHEN fact_id % 79 = 0 THEN NULL WHEN fact_id % 5 = 0 THEN fact_id + 1 ELSE fact_id END AS a, CASE WHEN fact_id % 79 = 0 THEN NULL WHEN fact_id % 5 = 0 THEN fact_id ELSE fact_id + 1 END AS b FROM facts) i
LEFT JOIN (SELECT fact_id, lower(sha) AS sha, lower(trim(parser)) AS parser, evidence.source_text AS text, evidence.page AS page, evidence.bbox_x0 AS x0 FROM facts) s ON s.fact_id = i.a AND s.sha = i.sha AND s.parser = i.parser
LEFT JOIN (SELECT fact_id, lower(sha) AS sha, lower(trim(parser)) AS parser, evidence.source_text AS text, evidence.page AS page, evidence.bbox_x0 AS x0 FROM facts) u ON u.fact_id = i.b AND u.sha = i.sha AND u.parser = i.parser)"""
_PINNED = "CASE hit WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE nullif(concat_ws(' ', t1, t2), '') END"


@query(f"""SELECT item_id, CASE hit WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE coalesce(p1, p2) END AS page, {_PINNED} AS source_text,
 CASE hit WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE least(coalesce(x1, x2), coalesce(x2, x1)) END AS x0 FROM CITED_VIEW""")
def q_cited_evidence(spark, d):
    items, s = _cited_items(spark, d)
    v = F.col("value_text").try_cast("double")
    e = evidence.cited(items, s).select("item_id", evidence.pinned(F.col("cited"), F.when(~F.isnan(v), v)).alias("e"))
    return e.select("item_id", "e.page", "e.source_text", "e.bbox.x0")


def _rederived_sql(source: str) -> str:
    """CTEs ending in red(id, new): the value in its canonical milli unit, from source with id, value, canon, said."""
    space = "[ \\t\\n\\r\\x0b\\f\\x{a0}\\x{2009}\\x{202f}]"
    return rf"""rd0 AS (SELECT *, regexp_extract(canon, '^m([VA])\b', 1) AS base, replace(regexp_replace(replace(coalesce(said, ''), '\mu', 'µ'), '\\mathrm|\\,|\\;|[{{}}\\]', '', 'g'), 'μ', 'µ') AS plain FROM ({source})),
rd1 AS (SELECT id, value, base, plain, unnest([1, 2]) AS k, unnest([format('{{:g}}', value), CASE WHEN value = floor(value) AND abs(value) < 1e15 THEN CAST(CAST(value AS BIGINT) AS VARCHAR) END]) AS form FROM rd0 WHERE value IS NOT NULL AND base <> ''),
rd2 AS (SELECT *, string_split(plain, form) AS ps FROM rd1 WHERE form IS NOT NULL),
rd3 AS (SELECT *, list_filter(range(1, len(ps)), lambda i: NOT regexp_matches(ps[i], '[0-9]$') AND NOT regexp_matches(ps[i + 1], '^\.?[0-9]') AND (i = 1 OR ps[i] <> '') AND (i + 1 = len(ps) OR ps[i + 1] <> '')) AS pos_ FROM rd2),
rd4 AS (SELECT *, regexp_extract(ps[pos_[1] + 1], '^{space}*([µunm]){space}*' || base, 1) AS prefix FROM rd3 WHERE len(pos_) = 1),
red AS (SELECT id, arg_min(value * CASE prefix WHEN 'n' THEN 1e-9::DOUBLE / 1e-3::DOUBLE WHEN 'm' THEN 1.0::DOUBLE ELSE 1e-6::DOUBLE / 1e-3::DOUBLE END, k) AS new FROM rd4 WHERE prefix <> '' GROUP BY id)"""


@query(f"""WITH {_rederived_sql("SELECT fact_id AS id, value, canonical_unit AS canon, evidence.source_text AS said FROM FACTS_VIEW JOIN fact_types USING (type)")}
SELECT fact_id, value, new AS rederived FROM facts JOIN red ON id = fact_id WHERE value <> new""")
def q_rederived(spark, d):
    f = facts(spark, d)
    new = units.rederived_milli(F.col("value"), units.canonical_unit(F.col("type")), F.col("evidence.source_text"))
    return f.select("fact_id", "value", new.alias("rederived")).where("value <> rederived")


VIEWS["JUDGED_VIEW"] = rf"""(WITH c AS (SELECT *, {_PINNED} AS said FROM CITED_VIEW), us AS (SELECT DISTINCT unit_label AS u FROM facts UNION SELECT canonical_unit FROM fact_types), {_PLAIN}, {_SIG},
{_rederived_sql("SELECT item_id AS id, value, canonical_unit AS canon, said FROM c JOIN fact_types USING (type) WHERE said IS NOT NULL")},
j AS (SELECT c.*, t.type IS NOT NULL AS m, coalesce(new, c.value) AS converted, magnitude_ceiling, x.sig = y.sig AS fits FROM c LEFT JOIN fact_types t USING (type) LEFT JOIN red ON id = item_id
 LEFT JOIN sig x ON c.unit_label IS NOT DISTINCT FROM x.u LEFT JOIN sig y ON t.canonical_unit = y.u)
SELECT *, CASE WHEN NOT is_object THEN 'item is no object, expected dict' WHEN m AND said IS NULL THEN 'no valid span citation for ' || type
 WHEN m AND length(vd) >= 2 AND NOT contains(regexp_replace(said, '[^0-9]', '', 'g'), vd) THEN 'likely mis-citation for ' || type
 WHEN NOT m AND type NOT IN ('Paper') THEN 'unknown class' WHEN given AND value IS NULL THEN 'value is no number' WHEN m AND NOT fits THEN 'unit_label != canonical for ' || type
 WHEN m AND abs(converted) > magnitude_ceiling THEN 'magnitude exceeds the plausible ceiling for ' || type END AS reason FROM j)"""
VIEWS["JUDGED_VIEW"] = VIEWS["JUDGED_VIEW"].replace("CITED_VIEW", VIEWS["CITED_VIEW"])


@query("""SELECT item_id, reason AS drop_reason, CASE WHEN reason IS NULL THEN converted ELSE value END AS value, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence FROM JUDGED_VIEW""")
def q_guarded(spark, d):
    """The whole chain: citation, pin, conversion, guards in order, salvage; every item comes out once."""
    return evidence.guarded(*_cited_items(spark, d)).select("item_id", "drop_reason", "value", "confidence")


@query("""SELECT stage, reason, count(*) AS n FROM (SELECT CASE WHEN reason IS NOT NULL THEN 'extract' WHEN ir = 'unknown' THEN 'shacl' WHEN said IS NULL THEN 'insert' END AS stage,
 CASE WHEN reason IS NOT NULL THEN reason WHEN ir = 'unknown' THEN 'iR_correction is unknown' ELSE 'no evidence' END AS reason FROM JUDGED_VIEW) WHERE stage IS NOT NULL GROUP BY 1, 2""")
def q_drop_stages(spark, d):
    """Drops of all three stages; the shape asked for here takes iR_correction as known or absent."""
    j = evidence.guarded(*_cited_items(spark, d))
    shape = F.when(F.col("ir") == "unknown", F.lit("iR_correction is unknown"))
    return evidence.drop_log(j, shape).groupBy("stage", "reason").agg(F.count("*").alias("n"))


_SLOTS = {s: s.replace(".", "_") for s in evidence.NUMERIC_SLOTS}
_SLOT_SQL = ", ".join(
    rf"TRY_CAST(nullif(regexp_extract(coalesce(json_extract_string(p, '$.condition.{s}'), json_extract_string(p, '$.condition.{s.replace('electrolyte.', 'electrolyte[0].')}')), '[-+]?[0-9]*\.?[0-9]+'), '') AS DOUBLE) AS {n}" for s, n in _SLOTS.items()
)


@query(f"SELECT line_id, {_SLOT_SQL} FROM (SELECT DISTINCT line_id, TRY_CAST(payload AS JSON) AS p FROM drift_lines) WHERE json_type(p) = 'OBJECT'")
def q_condition_salvage(spark, d):
    lines = table(spark, d, "drift_lines").select("line_id", "payload").distinct().where(F.json_object_keys("payload").isNotNull())
    return lines.select("line_id", *evidence.salvaged_condition(F.get_json_object("payload", "$.condition")))


@query("""SELECT cell_id, item_no, CASE WHEN c BETWEEN 0 AND 1 THEN c END AS confidence FROM (SELECT cell_id, item_no, TRY_CAST(json_extract_string(item, '$.confidence') AS DOUBLE) * CASE WHEN cell_id % 4 = 0 THEN 100 ELSE 1 END AS c FROM ITEMS_VIEW)""")
def q_confidence_salvage(spark, d):
    """Confidences as models write them: bare, in words, or, from every fourth cell, in percent and so out of range."""
    from factspan.plans.core import _items

    said = F.get_json_object("item", "$.confidence")
    text_ = F.when(F.col("cell_id") % 4 == 0, (said.try_cast("double") * 100).cast("string")).when(F.col("cell_id") % 4 == 1, F.concat(F.lit("about "), said)).otherwise(said)
    return _items(spark, d).select("cell_id", "item_no", numbers.salvaged_confidence(text_).alias("confidence"))


@query(f"""SELECT cell_id, cell_id % 4 <> 3 AND coalesce(json_type(CAST(payload AS JSON), '$.items') = 'ARRAY', false) AS readable,
 CASE WHEN cell_id % 4 <> 3 AND json_type(CAST(payload AS JSON), '$.items') = 'ARRAY' THEN CAST(json_array_length(CAST(payload AS JSON), '$.items') AS INT) END AS n_items FROM {_CELLS}""")
def q_response_items(spark, d):
    """Replies as models send them: bare, fenced with and without a language, or cut off."""
    c = F.col("cell_id") % 4
    fenced = lambda head: F.concat(F.lit(f"Here it is:\n```{head}\n"), "payload", F.lit("\n```\nAnything else?"))
    reply = F.when(c == 0, F.col("payload")).when(c == 1, fenced("json")).when(c == 2, fenced("")).otherwise(F.substring("payload", F.lit(1), F.length("payload") - 1))
    items = evidence.response_items(reply)
    return _cells(spark, d).select("cell_id", items.isNotNull().alias("readable"), F.when(items.isNotNull(), F.size(items)).alias("n_items"))


# --- text and boxes -----------------------------------------------------------------------------------------------

# What NFKC makes of the compatibility characters that stand in these texts.
_NFKC = "translate({0}, '⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺µ' || chr(160) || chr(8201) || chr(8239), '0123456789−+μ   ')"


def _cleaned_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({_NFKC.format(c)}, '\\[a-zA-Z]+|\\,', ' ', 'g'), '[${{}}^_]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT fact_id, {_cleaned_sql('evidence.source_text')} AS cleaned FROM facts")
def q_latex_cleaned(spark, d):
    return facts(spark, d).select("fact_id", text.latex_cleaned(F.col("evidence.source_text")).alias("cleaned"))


_PHRASE = r"""SELECT *, list_position(list_transform(ws, lambda w: contains(regexp_replace(w, '[^0-9]', '', 'g'), vd)), true) AS pos_ FROM (SELECT *, string_split(cleaned, ' ') AS ws FROM (
 SELECT fact_id, value, evidence, sha, {0} AS cleaned, regexp_replace(format('{{:g}}', value), '[^0-9]', '', 'g') AS vd FROM FACTS_VIEW WHERE value IS NOT NULL))""".format(_cleaned_sql("evidence.source_text"))


@query(f"SELECT fact_id, array_to_string(ws[greatest(pos_ - 3, 1) : pos_ + 3], ' ') AS phrase FROM ({_PHRASE}) WHERE pos_ > 0 AND vd <> ''")
def q_phrases(spark, d):
    t = text.latex_cleaned(F.col("evidence.source_text"))
    return facts(spark, d).select("fact_id", text.phrase_around(t, numbers.value_digits(F.col("value"))).alias("phrase")).where("phrase is not null")


@query(rf"""WITH f AS ({_PHRASE}), b AS (SELECT lower(sha) AS sha, evidence.page AS page, evidence.bbox_x0 AS x0, evidence.bbox_x1 AS x1, string_split({_cleaned_sql('evidence.source_text')}, ' ') AS ws FROM facts),
w AS (SELECT sha, page, x0, x1, ws, len(ws) AS n, unnest(range(len(ws))) AS k FROM b),
v AS (SELECT *, array_to_string(ws[greatest(k - 3, 0) + 1 : least(k + 3, n - 1) + 1], ' ') AS phrase, nullif(regexp_extract(ws[k + 1], '-?[0-9]+(?:\.[0-9]+)?'), '') AS number FROM w),
ph AS (SELECT sha, page, phrase, min(x0 + (x1 - x0) * greatest(k - 3, 0) / n) AS bx FROM v GROUP BY 1, 2, 3 HAVING count(*) = 1),
nu AS (SELECT sha, page, number, min(x0 + (x1 - x0) * k / n) AS bx FROM v WHERE number IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT a.fact_id, coalesce(ph.bx, nu.bx, a.evidence.bbox_x0) AS x0, coalesce(ph.bx, nu.bx) IS NOT NULL AS refined, a.evidence.source_text AS source_text FROM FACTS_VIEW a
LEFT JOIN f ON f.fact_id = a.fact_id LEFT JOIN ph ON ph.sha = lower(a.sha) AND ph.page = a.evidence.page AND f.pos_ > 0 AND f.vd <> '' AND ph.phrase = array_to_string(f.ws[greatest(f.pos_ - 3, 1) : f.pos_ + 3], ' ')
LEFT JOIN nu ON nu.sha = lower(a.sha) AND nu.page = a.evidence.page AND nu.number = format('{{:g}}', a.value)""")
def q_tightened(spark, d):
    """A new version of the facts with boxes tightened to where the value stands; what tells their origin is unchanged."""
    box = F.struct(*(F.col(f"evidence.bbox_{c}").alias(c) for c in _SIDES))
    f = facts(spark, d).select("fact_id", F.lower("sha").alias("sha"), F.col("evidence.page").alias("page"), "value", F.col("evidence.source_text").alias("source_text"), box.alias("bbox"))
    words = evidence.words_of(f.select("sha", "page", F.col("source_text").alias("text"), "bbox"), ["sha", "page"])
    t = evidence.tightened(f, words, ["sha", "page"])
    return t.select("fact_id", "box.x0", "refined", "source_text")


# --- shapes -------------------------------------------------------------------------------------------------------

_SHAPE = {"type": "string", "value": "number", "unit_label": "string", "condition": "object"}
_KIND = "CASE json_type(p, '$.{0}') WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END"
_ODD = ", ".join(f"CASE WHEN json_type(p, '$.{m}') IS NULL OR json_type(p, '$.{m}') = 'NULL' THEN NULL WHEN {_KIND.format(m)} = 'array' THEN 'several {m}' WHEN {_KIND.format(m)} <> '{k}' THEN 'no {k} {m}' END" for m, k in _SHAPE.items())
_ABSENT = ", ".join(f"CASE WHEN json_extract_string(p, '$.{m}') IS NULL THEN 'missing member {m}' END" for m in ("type", "value"))
VIEWS["SHAPE_VIEW"] = f"""(SELECT line_id, line_no, list_sort(CASE WHEN coalesce(json_type(p) <> 'OBJECT', true) THEN ['no object'] ELSE list_concat(
 list_transform(list_filter(json_keys(p), lambda k: NOT list_contains({list(_SHAPE)}, k)), lambda k: 'unknown member ' || k), list_filter([{_ABSENT}, {_ODD}], lambda x: x IS NOT NULL)) END) AS ps
 FROM (SELECT *, TRY_CAST(payload AS JSON) AS p FROM drift_lines))"""


@query("SELECT problem, count(*) AS n FROM (SELECT unnest(ps) AS problem FROM SHAPE_VIEW) GROUP BY 1")
def q_closed_shape(spark, d):
    p = records.closed_shape(table(spark, d, "drift_lines"), "line_id", "payload", _SHAPE, ["type", "value"])
    return p.groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT line_id, line_no, len(ps) = 0 AS ok, array_to_string(ps, '; ') AS report FROM SHAPE_VIEW")
def q_validated(spark, d):
    v = records.validated(table(spark, d, "drift_lines"), "payload", _SHAPE, ["type", "value"])
    return v.select("line_id", "line_no", "ok", "report")
