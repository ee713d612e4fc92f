"""From candidate items with span citations to guarded facts and reasoned drops.

An item is kept or dropped by an ordered chain of guards whose first failure is the reason; everything stays in Column
expressions, so the chain is one projection over the joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.functions import numbers, units
from factspan.functions.text import latex_cleaned, one_line, phrase_around
from factspan.operators.latest import first
from factspan.vocab import CANONICAL_UNIT, OTHER_CLASSES

#: Slots of a condition that are salvaged from text; catalyst_loading is not among them.
NUMERIC_SLOTS = ["current_density", "electrode_potential_vs_rhe", "temperature_C", "scan_rate", "electrolyte.concentration", "electrolyte.electrolyte_ph"]


def cited(items: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("sha", "parser")) -> DataFrame:
    """items with cited: the spans each cites, in the order of citation, as array<struct<pos, span_id, page, text, bbox>>.

    items: item_id, keys and span_ids; invalid ids fall out, an item without any valid one has null. Citations are
    exploded and joined on keys and span_id, which spreads a paper's spans over its citations rather than gathering
    its spans.
    """
    c = items.select("item_id", *keys, F.posexplode("span_ids").alias("pos", "span_id"))
    hit = c.join(spans, [*keys, "span_id"])
    per = hit.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "span_id", "page", "text", "bbox"))).alias("cited"))
    return items.join(per, "item_id", "left")


def pinned(spans: Column, value: Column) -> Column:
    """The evidence of a value: the first cited span that prints its digits, else the union of all cited.

    Values of fewer than two digits take the union: outer box, page of the first citation, texts joined by a blank.
    Null if nothing is cited.
    """
    digits = numbers.value_digits(value)
    hits = F.filter(spans, lambda s: F.regexp_replace(s["text"], r"(?U)\D", "").contains(digits))
    hit = F.get(hits, F.lit(0))
    side = lambda f, n: f(F.transform(spans, lambda s: s["bbox"][n]))
    union = F.struct(
        F.get(spans, F.lit(0))["page"].alias("page"),
        F.struct(side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1")).alias("bbox"),
        F.array_join(F.transform(spans, lambda s: s["text"]), " ").alias("source_text"),
    )
    one = F.struct(hit["page"].alias("page"), hit["bbox"].alias("bbox"), hit["text"].alias("source_text"))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.when((F.length(digits) >= 2) & hit.isNotNull(), one).otherwise(union))


def number_or_null(text: Column) -> Column:
    """A value given as text as double; null for what is no number, NaN included."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v), v)


def with_unit_fit(df: DataFrame) -> DataFrame:
    """df with unit_fits: whether unit_label is the type's canonical unit.

    Signatures are worked out once for each type and spelling met and joined back, null-safely, as spellings are few
    and a signature is long to compute.
    """
    met = df.select(F.col("type").alias("_t"), F.col("unit_label").alias("_u")).distinct()
    met = met.withColumn("unit_fits", units.units_match(F.col("_u"), units.canonical_unit(F.col("_t"))))
    on = F.col("type").eqNullSafe(F.col("_t")) & F.col("unit_label").eqNullSafe(F.col("_u"))
    return df.join(met, on, "left").drop("_t", "_u")


def drop_reason(type_: Column, value_text: Column, value: Column, unit_fits: Column, source_text: Column, is_object: Column, converted: Column | None = None) -> Column:
    """Why an item is dropped, by the first guard that fails; null if it passes all.

    Order: an object; resolvable evidence for measurements; the value's digits in the cited text; a known class; a
    number or nothing as value; the canonical unit (no unit only where dimensionless); a plausible magnitude, asked of
    converted, the value in the unit its text prints, where given. A value that is present but no number is a schema
    error, so that it cannot pass as a legal null.
    """
    measurement = type_.isin(list(CANONICAL_UNIT))
    return (
        F.when(~is_object, F.lit("item is no object, expected dict"))
        .when(measurement & source_text.isNull(), F.concat(F.lit("no valid span citation for "), type_))
        .when(measurement & ~numbers.digits_inside(value, source_text), F.concat(F.lit("likely mis-citation for "), type_))
        .when(type_.isNull() | ~(measurement | type_.isin(OTHER_CLASSES)), F.lit("unknown class"))
        .when(value_text.isNotNull() & value.isNull(), F.lit("value is no number"))
        .when(measurement & ~unit_fits, F.concat(F.lit("unit_label != canonical for "), type_))
        .when(measurement & ~units.magnitude_ok(type_, value if converted is None else converted), F.concat(F.lit("magnitude exceeds the plausible ceiling for "), type_))
    )


def guarded(items: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("sha", "parser")) -> DataFrame:
    """items with evidence, value, confidence, salvaged and drop_reason (null for facts); valid plus dropped is all of items.

    items: item_id, keys, is_object, type, value_text, unit_label, confidence_text, span_ids and, where there is one,
    condition as JSON text. The value is brought to the unit its evidence prints before unit and magnitude are judged,
    and what cannot be read of confidence or condition never sinks an item.
    """
    d = with_unit_fit(cited(items, spans, keys)).withColumn("value", number_or_null(F.col("value_text")))
    d = d.withColumn("evidence", pinned(F.col("cited"), F.col("value"))).drop("cited")
    said = F.col("evidence.source_text")
    milli = units.rederived_milli(F.col("value"), units.canonical_unit(F.col("type")), said)
    d = d.withColumn("_converted", F.when(said.isNotNull(), milli).otherwise(F.col("value")))
    reason = drop_reason(F.col("type"), F.col("value_text"), F.col("value"), F.col("unit_fits"), said, F.col("is_object"), F.col("_converted"))
    d = d.withColumn("drop_reason", reason).withColumn("value", F.when(F.col("drop_reason").isNull(), F.col("_converted")).otherwise(F.col("value")))
    d = d.withColumn("confidence", numbers.salvaged_confidence(F.col("confidence_text"))).drop("unit_fits", "_converted")
    return d.withColumn("salvaged", F.struct(*salvaged_condition(F.col("condition")))) if "condition" in items.columns else d


def salvaged_condition(condition: Column) -> list[Column]:
    """The numeric slots of a condition given as JSON text, each as double or null; electrolytes in a list count by the first."""
    at = lambda s: F.coalesce(F.get_json_object(condition, f"$.{s}"), F.get_json_object(condition, f"$.{s.replace('electrolyte.', 'electrolyte[0].')}"))
    return [numbers.first_number(at(s)).alias(s.replace(".", "_")) for s in NUMERIC_SLOTS]


def response_items(text: Column) -> Column:
    """The items of a model's reply as an array of JSON texts: the reply itself if it is JSON, else its first fenced block.

    Null where neither is an object with a list of items; other members are ignored.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    items = lambda t: F.from_json(F.when(F.get_json_object(t, "$.items").startswith("["), F.get_json_object(t, "$.items")), "array<string>")
    return F.coalesce(items(text), items(fenced))


def words_of(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phrase, number, x0, y0, x1, y1: each word of each block of text with the phrase around it and its box.

    blocks: keys, text and bbox, one row per block. A word's box is its share of the block's width. phrase is the word
    with three on either side; its box reaches from the first to the last of these. number is the number in a word.
    """
    ws = F.split(F.trim(latex_cleaned(F.col("text"))), r"\s+")
    b = blocks.select(*keys, "bbox", ws.alias("ws")).withColumn("n", F.size("ws"))
    start, end = lambda k: F.greatest(k - 3, F.lit(0)), lambda k: F.least(k + 3, F.col("n") - 1)
    one = lambda w, k: F.struct(
        F.array_join(F.slice("ws", start(k) + 1, end(k) - start(k) + 1), " ").alias("phrase"),
        F.nullif(F.regexp_extract(w, r"-?\d+(?:\.\d+)?", 0), F.lit("")).alias("number"), k.alias("k"), start(k).alias("a"), end(k).alias("z"),
    )
    w = b.select(*keys, "bbox", "n", F.explode(F.transform("ws", one)).alias("w"))
    x = lambda k: F.col("bbox.x0") + (F.col("bbox.x1") - F.col("bbox.x0")) * k / F.col("n")
    box = lambda a, z: F.struct(x(a).alias("x0"), F.col("bbox.y0").alias("y0"), x(z + 1).alias("x1"), F.col("bbox.y1").alias("y1"))
    return w.select(*keys, "w.phrase", "w.number", box(F.col("w.a"), F.col("w.z")).alias("phrase_box"), box(F.col("w.k"), F.col("w.k")).alias("word_box"))


def tightened(facts: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """facts with box and refined: the place of the value on its page, where exactly one word of the page tells it.

    facts: keys, value, source_text, bbox. Tried first is the phrase around the value in its source text, then the
    value alone; a phrase or number that stands nowhere or more than once on the page settles nothing, and the box the
    fact came with is kept. Everything else of the fact stays as it is. Words are counted per page and phrase before
    they are joined, so no page is gathered.
    """
    digits = numbers.value_digits(F.col("value"))
    f = facts.withColumn("phrase", phrase_around(latex_cleaned(F.col("source_text")), digits)).withColumn("number", numbers.c_general(F.col("value")))
    once = lambda by, box: words.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.count("*").alias("n"), F.min(box).alias(f"_{box}")).where("n = 1").drop("n")
    f = f.join(once("phrase", "phrase_box"), [*keys, "phrase"], "left").join(once("number", "word_box"), [*keys, "number"], "left")
    hit = F.coalesce("_phrase_box", "_word_box")
    return f.withColumn("box", F.coalesce(hit, "bbox")).withColumn("refined", hit.isNotNull()).drop("phrase", "number", "_phrase_box", "_word_box")


def facts_kept_first(facts: DataFrame, order: list[str]) -> DataFrame:
    """One fact per (sha, type, value, unit, source text): the first by order."""
    return first(facts, ["sha", "type", "value", "unit_label", "source_text"], order)


def drop_log(judged: DataFrame, shape_problem: Column | None = None) -> DataFrame:
    """item_id, stage, reason, item: what each of the three stages dropped, an item by the first that drops it.

    extract: the guard chain (item: the raw item on one line of 200 characters). shacl: facts whose closed shape has a
    problem. insert: what is left and has no evidence, such as classes that are no measurements. judged: guarded().
    """
    shape = shape_problem if shape_problem is not None else F.lit(None).cast("string")
    d = judged.withColumn("_shape", shape)
    stage = F.when(F.col("drop_reason").isNotNull(), "extract").when(F.col("_shape").isNotNull(), "shacl").when(F.col("evidence").isNull(), "insert")
    why = F.when(stage == "extract", F.col("drop_reason")).when(stage == "shacl", F.col("_shape")).otherwise(F.lit("no evidence"))
    raw = one_line(F.to_json(F.struct("type", "value_text", "unit_label")))
    return d.where(stage.isNotNull()).select("item_id", stage.alias("stage"), why.alias("reason"), F.when(stage == "extract", raw).otherwise(F.col("type")).alias("item"))


# Labels of drop buckets with the text or stage that puts a drop into them, tried in this order.
BUCKETS = [
    ("extract", "!= canonical", "unit mismatch"),
    ("extract", "mis-citation", "mis-citation"),
    ("extract", "no valid span citation", "unresolvable evidence"),
    ("extract", "expected dict", "malformed item"),
    ("extract", "", "schema/validation error"),
    ("shacl", "", "SHACL violation"),
    ("insert", "", "insert refusal"),
]
#: What to do about a bucket that is systematic.
ADVICE = {
    "unit mismatch": "name the canonical units in the instructions",
    "mis-citation": "ask for the span that prints the number",
    "unresolvable evidence": "check span numbers of this parser",
    "malformed item": "ask for objects only",
    "schema/validation error": "compare the members with the schema",
    "SHACL violation": "compare the shape with the schema",
    "insert refusal": "leave out classes that are no measurements",
}
#: Drops of one bucket from which it counts as systematic.
SYSTEMATIC = 3


def bucket(stage: Column, reason: Column) -> Column:
    out = F.lit("other")
    for s, text, label in reversed(BUCKETS):
        out = F.when((stage == s) & F.coalesce(reason, F.lit("")).contains(text), label).otherwise(out)
    return out


def drop_buckets(drops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, n, share in percent (half to even), whether the bucket is systematic, and then what to do.

    Totals come from the counts, not from the rows again: the window over a key holds at most eight rows.
    """
    from pyspark.sql import Window as W

    n = drops.groupBy(*keys, bucket(F.col("stage"), F.col("reason")).alias("bucket")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    return n.withColumn("pct", F.bround(100 * F.col("n") / total).cast("int")).withColumn("systematic", F.col("n") >= SYSTEMATIC).withColumn(
        "advice", F.when(F.col("systematic"), F.try_element_at(units.literal_map(ADVICE), F.col("bucket")))
    )
