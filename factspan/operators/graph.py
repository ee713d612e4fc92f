"""Facts as quads and back: the provenance graph as one table.

quads(s, p, o_kind, o_lex, o_num, g); g is null in the default graph. Star patterns over a subject are answered by one
pivot over the predicates instead of a self-join per pattern; patterns across subjects join such pivots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.session import staged

COLUMNS = ["s", "p", "o_kind", "o_lex", "o_num", "g"]
CONDITION_NUMBERS = ["current_density", "electrode_potential_vs_rhe", "temperature_C", "scan_rate", "catalyst_loading"]
CONDITION_TEXTS = ["cell_type", "iR_correction", "normalization_basis", "cell_type_family", "electrolyte_family", "scan_rate_regime"]


def _quad(s: Column, p: str, kind: str, lex: Column, num: Column | None = None, g: Column | None = None) -> Column:
    return F.struct(
        s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), lex.cast("string").alias("o_lex"),
        (num if num is not None else F.lit(None)).cast("double").alias("o_num"), (g if g is not None else F.lit(None)).cast("string").alias("g"),
    )


def fact_quads(facts: DataFrame, only: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """The quads of all facts with evidence; facts without any are refused.

    Node names are hashes of what identifies the fact, so that inserting a run again adds nothing; another run_id makes
    another node. Slots that are null make no quad, and a condition or electrolyte with no slot set makes no node. The
    run's own graph holds runId and, where known, extractionModel. Equal quads collapse, unless distinct is False for
    readers to whom repeats make no difference (star). only: the predicates to make; all if None.
    """
    key = F.sha2(F.concat_ws("\u0001", "run_id", "sha", "parser", "type", F.col("value").cast("string"), "unit_label", F.col("fact_id").cast("string")), 256)
    d = facts.where(F.col("evidence").isNotNull()).withColumn("_k", F.substring(key, 1, 32))
    m, e, c, y = (F.concat(F.lit(f"{n}/"), F.col("_k")) for n in ("measurement", "evidence", "condition", "electrolyte"))
    paper, run = F.concat(F.lit("paper/"), F.lower("sha")), F.concat(F.lit("run/"), F.col("run_id"))
    quad = lambda s, p, kind, lex, when=None, num=None, g=None: (p, _quad(s, p, kind, lex, num, g) if when is None else F.when(when, _quad(s, p, kind, lex, num, g)))
    num = lambda s, p, col: quad(s, p, "literal", F.col(col), F.col(col).isNotNull(), F.col(col))
    txt = lambda s, p, col: quad(s, p, "literal", F.col(col), F.col(col).isNotNull())
    el = [f"condition.electrolyte.{x}" for x in ("formula", "concentration", "electrolyte_ph")]
    slots = [f"condition.{x}" for x in CONDITION_NUMBERS + CONDITION_TEXTS]
    any_el = F.coalesce(*(F.col(x).cast("string") for x in el)).isNotNull()
    any_c = F.coalesce(*(F.col(x).cast("string") for x in slots)).isNotNull() | any_el
    ran = F.col("run_id").isNotNull()
    quads = [
        quad(m, "type", "iri", F.col("type")), num(m, "value", "value"), txt(m, "unitLabel", "unit_label"), num(m, "confidence", "confidence"),
        quad(m, "hadPrimarySource", "bnode", e), quad(e, "type", "iri", F.lit("Entity")), quad(e, "paper", "iri", paper),
        num(e, "page", "evidence.page"), *(num(e, x, f"evidence.{x}") for x in ("bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1")),
        txt(e, "parserName", "evidence.parser_name"), txt(e, "sourceText", "evidence.source_text"),
        quad(paper, "type", "iri", F.lit("Paper")), quad(paper, "sha256", "literal", F.lower("sha")),
        quad(m, "condition", "bnode", c, any_c), quad(c, "type", "iri", F.lit("Condition"), any_c),
        *(num(c, x, f"condition.{x}") for x in CONDITION_NUMBERS), *(txt(c, x, f"condition.{x}") for x in CONDITION_TEXTS),
        quad(c, "electrolyte", "bnode", y, any_el), quad(y, "type", "iri", F.lit("Electrolyte"), any_el),
        txt(y, "formula", el[0]), num(y, "concentration", el[1]), num(y, "electrolytePh", el[2]),
        quad(m, "runId", "literal", F.col("run_id"), ran, g=run), quad(m, "extractionModel", "literal", F.col("model"), ran & F.col("model").isNotNull(), g=run),
    ]
    quads = [q for p, q in quads if only is None or p in only]
    out = d.select(F.explode(F.filter(F.array(*quads), lambda q: q.isNotNull())).alias("q")).select("q.*")
    return out.dropDuplicates(COLUMNS) if distinct else out


def star(quads: DataFrame, texts: dict[str, str], numbers: dict[str, str] | None = None, need: tuple[str, ...] = ()) -> DataFrame:
    """s and one column per predicate, from one pass over the default graph; subjects lacking a needed one fall out.

    texts and numbers: column name by predicate. Predicates not in need are optional. A predicate with several objects
    shows the smallest.
    """
    wanted = {**texts, **(numbers or {})}
    aggs = [F.min(F.when(F.col("p") == p, F.col("o_num" if numbers and p in numbers else "o_lex"))).alias(c) for p, c in wanted.items()]
    out = quads.where(F.col("g").isNull() & F.col("p").isin(list(wanted))).groupBy("s").agg(*aggs)
    for p in need:
        out = out.where(F.col(wanted[p]).isNotNull())
    return out


def run_values(quads: DataFrame) -> DataFrame:
    """s, g, run_id, model: what run graphs say about measurements. Default-graph patterns never see these."""
    named = quads.where(F.col("g").isNotNull())
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o_lex")))
    return named.groupBy("s", "g").agg(pick("runId").alias("run_id"), pick("extractionModel").alias("model"))


#: Predicates that fact_view reads.
VIEWED = ["type", "unitLabel", "hadPrimarySource", "condition", "value", "confidence", "paper", "parserName", "page", "current_density", "runId", "extractionModel"]


def fact_view(quads: DataFrame) -> DataFrame:
    """One row per measurement with evidence: type, value, unit, confidence, paper, page, parser, run, model, density.

    Measurement and evidence are required, the rest optional; the condition's current density comes by one optional
    chain, all or nothing. All stars come from one pass over the quads, one row per subject, which is staged and then
    joined with itself along the edges.
    """
    texts = {"type": "type", "unitLabel": "unit_label", "hadPrimarySource": "ev", "condition": "cond", "paper": "paper", "parserName": "parser"}
    numbers = {"value": "value", "confidence": "confidence", "page": "page", "current_density": "current_density"}
    plain = F.col("g").isNull()
    pick = lambda p, c: F.min(F.when(plain & (F.col("p") == p), F.col(c)))
    named = lambda p: F.min(F.when(~plain & (F.col("p") == p), F.struct("g", "o_lex")))["o_lex"]
    aggs = [pick(p, "o_lex").alias(c) for p, c in texts.items()] + [pick(p, "o_num").alias(c) for p, c in numbers.items()]
    s = staged(quads.where(F.col("p").isin(VIEWED)).groupBy("s").agg(*aggs, named("runId").alias("run_id"), named("extractionModel").alias("model")))
    m = s.where("ev is not null").select("s", "type", "value", "unit_label", "confidence", "ev", "cond", "run_id", "model")
    e = s.where("paper is not null").select(F.col("s").alias("ev"), "paper", "page", "parser")
    c = s.where("current_density is not null").select(F.col("s").alias("cond"), "current_density")
    out = m.join(e, "ev").join(c, "cond", "left")
    return out.select("s", "type", "value", "unit_label", "confidence", "paper", "page", "parser", "run_id", "model", "current_density")


def stored(quads: DataFrame, path: str) -> DataFrame:
    """quads written as a store, a folder per kind of graph and predicate, and opened again: a star reads its predicates only."""
    kind = F.when(F.col("g").isNull(), "data").otherwise("run")
    quads.withColumn("graph", kind).withColumn("predicate", F.col("p")).write.mode("append").partitionBy("graph", "predicate").parquet(path)
    return opened(quads.sparkSession, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def updated(quads: DataFrame, where: Column, to: dict[str, Column]) -> DataFrame:
    """quads with columns of those that match replaced: DELETE and INSERT as a new version; equal quads collapse."""
    hit = F.coalesce(where, F.lit(False))
    return quads.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in to.items()}).dropDuplicates(COLUMNS)


def friendly(df: DataFrame, iri: str, names: DataFrame) -> DataFrame:
    """df with name: what names (iri, name) calls the IRI, else the IRI itself. names is a vocabulary of a few hundred rows."""
    n = names.select(F.col("iri").alias("_iri"), F.col("name"))
    return df.join(n, F.col(iri) == F.col("_iri"), "left").withColumn("name", F.coalesce("name", iri)).drop("_iri")


def resolved(wanted: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """wanted with iri and problem: the class a label stands for; 'ambiguous' where it names several, 'unknown' where none.

    labels: label, iri. Labels are compared without regard to case.
    """
    known = labels.groupBy(F.lower("label").alias("_label")).agg(F.countDistinct("iri").alias("_n"), F.min("iri").alias("iri"))
    out = wanted.join(known, F.lower(label) == F.col("_label"), "left")
    problem = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous")
    return out.withColumn("problem", problem).withColumn("iri", F.when(F.col("_n") == 1, F.col("iri"))).drop("_label", "_n")


def expanded(curie: Column, prefixes: dict[str, str]) -> Column:
    """prefix:name in full; unknown prefixes and other texts as they are."""
    out = curie
    for p, iri in prefixes.items():
        out = F.when(curie.startswith(f"{p}:"), F.concat(F.lit(iri), F.substring_index(curie, ":", -1))).otherwise(out)
    return out


# Characters a Turtle literal must escape, with their escapes, and the datatypes of number literals.
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
INTEGERS = ["page"]


def turtle_lines(quads: DataFrame) -> DataFrame:
    """line: the default graph as Turtle statements, one per quad; numbers are typed, texts escaped, named graphs left out."""
    text = F.col("o_lex")
    for raw, escaped in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    kind = F.when(F.col("p").isin(INTEGERS), "integer").otherwise("float")
    number = F.concat(F.lit('"'), F.col("o_lex"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#'), kind, F.lit(">"))
    literal = F.when(F.col("o_num").isNotNull(), number).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    node = lambda c, kind: F.when(kind == "bnode", F.concat(F.lit("_:"), F.replace(c, F.lit("/"), F.lit("-")))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o_lex"), F.col("o_kind")))
    blank = F.when(F.substring_index("s", "/", 1).isin("evidence", "condition", "electrolyte"), "bnode").otherwise("iri")
    return quads.where(F.col("g").isNull()).select(F.concat(node(F.col("s"), blank), F.lit(" <"), F.col("p"), F.lit("> "), obj, F.lit(" .")).alias("line"))
