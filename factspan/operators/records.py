"""Corrections, ledgers, run funnels, integrity checks and status: the bookkeeping of an extraction workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.operators.latest import latest, running_total
from factspan.session import staged
from factspan.vocab import ENUMS

# The exchange rate of the reference's cost reports, share of the cap from which it warns.
EUR_PER_USD = 0.92
SOFT_SHARE = 0.8


def corrections_applied(requests: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): accepted requests carry prior value and unit; refused ones a reason.

    requests: id, fact_id, author, comment, corrected_value, corrected_unit, flagged_wrong, at. A request needs a
    comment, at least one of value, unit or flag, and a fact with evidence. The facts themselves stay as they are.
    """
    anchored = facts.where(F.col("evidence").isNotNull()).select("fact_id", F.col("value").alias("prior_value"), F.col("unit_label").alias("prior_unit"), F.lit(True).alias("_there"))
    r = requests.join(anchored, "fact_id", "left")
    reason = (
        F.when(F.length(F.trim(F.coalesce("comment", F.lit("")))) == 0, "empty comment")
        .when(F.col("corrected_value").isNull() & F.col("corrected_unit").isNull() & ~F.coalesce("flagged_wrong", F.lit(False)), "nothing to correct")
        .when(F.col("_there").isNull(), "no such fact with evidence")
    )
    r = r.withColumn("reason", reason).drop("_there")
    return r.where("reason is null").drop("reason"), r.where("reason is not null")


def facts_current(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """facts with the newest correction laid over value and unit, and flagged_wrong; facts alone stay the raw view."""
    last = latest(corrections.select("fact_id", "at", "id", "corrected_value", "corrected_unit", "flagged_wrong"), ["fact_id"], ["at", "id"])
    j = facts.join(last, "fact_id", "left")
    return (
        j.withColumn("value", F.coalesce("corrected_value", "value"))
        .withColumn("unit_label", F.coalesce("corrected_unit", "unit_label"))
        .withColumn("flagged_wrong", F.coalesce("flagged_wrong", F.lit(False)))
        .drop("at", "id", "corrected_value", "corrected_unit")
    )


def budget_gate(ledger: DataFrame, value: str, order: list[str], cap: float) -> DataFrame:
    """ledger with before, total, allowed (total at most cap; equality passes) and warned (from 80 % of the cap).

    Every entry counts as spent, as in an append-only ledger that is checked afterwards.
    """
    t = running_total(ledger, value, order)
    return t.withColumn("allowed", F.col("total") <= cap).withColumn("warned", F.col("total") >= SOFT_SHARE * cap)


def ledger_entries(cells: DataFrame, usd_per_million: dict[str, float], usd_per_hour: float) -> DataFrame:
    """ts, kind, provider, amount_eur, cell_id: what each run adds to the ledger, its tokens and its seconds on a GPU."""
    llm = cells.select(F.col("saved_at").alias("ts"), F.lit("llm").alias("kind"), F.col("label").alias("provider"), token_cost_eur({"in": F.col("in_tokens"), "out": F.col("out_tokens")}, usd_per_million).alias("amount_eur"), "cell_id")
    gpu = cells.select(F.col("saved_at").alias("ts"), F.lit("gpu").alias("kind"), F.lit(None).cast("string").alias("provider"), gpu_cost_eur(F.col("latency_s"), usd_per_hour).alias("amount_eur"), "cell_id")
    return llm.unionByName(gpu.where("amount_eur is not null"))


def token_cost_eur(tokens: dict[str, Column], usd_per_million: dict[str, float]) -> Column:
    """Euro for the tokens of each tier; tiers without a price count nothing."""
    usd = sum((F.coalesce(c, F.lit(0)) * F.lit(usd_per_million.get(k, 0.0) / 1e6) for k, c in tokens.items()), F.lit(0.0))
    return usd * EUR_PER_USD


def gpu_cost_eur(seconds: Column, usd_per_hour: float) -> Column:
    return seconds / 3600 * usd_per_hour * EUR_PER_USD


def capped(ledger: DataFrame, value: str, order: list[str], cap: float) -> DataFrame:
    """ledger with allowed: whether an entry still fitted under cap when its turn came; refused ones are not spent.

    An entry is refused if what was spent before and itself exceed the cap. Found by rounds of running totals: up to
    the first entry that does not fit all are spent; that one is refused, and with it every later one dearer than what
    is left, as this only shrinks. So each round is a distributed running total, and the rounds end after a few, when
    all later entries fit or none does. Null values count as zero. order must be total.
    """
    key, v = F.struct(*order), F.coalesce(F.col(value), F.lit(0.0))
    rest, spent, out = staged(ledger.withColumn("_v", v)), 0.0, []
    while True:
        t = staged(running_total(rest, "_v", order))
        stop = t.where(F.col("total") + spent > cap).agg(F.min(key).alias("k")).first()["k"]  # one row
        if stop is None:
            out.append(t.withColumn("allowed", F.lit(True)))
            break
        first = F.struct(*(F.lit(x).cast(t.schema[c].dataType).alias(c) for c, x in zip(order, stop)))
        fits = t.where(key < first)
        out.append(fits.withColumn("allowed", F.lit(True)))
        spent += fits.agg(F.sum("_v")).first()[0] or 0.0
        later = t.where(key >= first)
        dear = (F.col("_v") > cap - spent) | (key == first)
        out.append(later.where(dear).withColumn("allowed", F.lit(False)))
        rest = staged(later.where(~dear).drop("total", "before"))
        if rest.isEmpty():
            break
    whole = out[0].select(*ledger.columns, "allowed")
    for o in out[1:]:
        whole = whole.unionByName(o.select(*ledger.columns, "allowed"))
    return whole


def cap_accepted(spent: float, cap: float) -> bool:
    """Whether a new cap may be set: one below what is already spent is refused."""
    return cap >= spent


def audit_records(accepted: DataFrame) -> DataFrame:
    """id, record: each accepted correction with what it replaced as one JSON text; nulls are left out."""
    return accepted.select("id", F.to_json(F.struct(*(c for c in accepted.columns))).alias("record"))


def json_kind(json: Column, member: str) -> Column:
    """number, string, boolean, object or array: the kind of a member of a JSON object; null if absent or null."""
    text = F.get_json_object(json, f"$.{member}")
    quoted = F.regexp_extract(F.to_json(F.variant_get(F.try_parse_json(json), f"$.{member}", "variant")), r"^(.)", 1)
    kind = F.when(quoted == '"', "string").when(quoted == "{", "object").when(quoted == "[", "array").when(quoted.isin("t", "f"), "boolean").otherwise("number")
    return F.when(text.isNotNull(), kind)


def shape_report(json: Column, allowed: dict[str, str], required: list[str]) -> Column:
    """Sorted problems of one JSON text: unknown, missing, of another kind, several where one is due; empty if none.

    allowed: member name to number, string, boolean, object or array; a list where another kind is due is a member
    given more than once. Texts that are no JSON object have the problem 'no object'.
    """
    keys = F.json_object_keys(json)
    unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, allowed))), lambda k: F.concat(F.lit("unknown member "), k))
    absent = [F.when(F.get_json_object(json, f"$.{k}").isNull(), F.lit(f"missing member {k}")) for k in required]
    kinds = {k: json_kind(json, k) for k in allowed}
    odd = [F.when((kinds[k] == "array") & F.lit(t != "array"), F.lit(f"several {k}")).when(kinds[k] != t, F.lit(f"no {t} {k}")) for k, t in allowed.items()]
    found = F.concat(unknown, F.filter(F.array(*absent, *odd), lambda x: x.isNotNull()))
    return F.array_sort(F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(found))


def closed_shape(records: DataFrame, id_col: str, json_col: str, allowed: dict[str, str], required: list[str]) -> DataFrame:
    """id, problem: a row for each problem shape_report() finds; no row for good ones."""
    return records.select(F.col(id_col), F.explode(shape_report(F.col(json_col), allowed, required)).alias("problem"))


def validated(records: DataFrame, json_col: str, allowed: dict[str, str], required: list[str]) -> DataFrame:
    """records, each with ok and report, in their own rows and order: nothing is dropped or moved."""
    r = records.withColumn("_r", shape_report(F.col(json_col), allowed, required))
    return r.withColumn("ok", F.size("_r") == 0).withColumn("report", F.array_join("_r", "; ")).drop("_r")


def enum_problems(facts: DataFrame) -> DataFrame:
    """fact_id, slot, entry: entries of enumerated condition slots outside their lists."""
    slots = F.array(*(F.struct(F.lit(s).alias("slot"), F.col(f"condition.{s}").alias("entry"), (~F.col(f"condition.{s}").isin(v)).alias("bad")) for s, v in ENUMS.items()))
    return facts.select("fact_id", F.explode(slots).alias("x")).where("x.bad").select("fact_id", "x.slot", "x.entry")


def constraint_problems(child: DataFrame, key: list[str], parent: DataFrame, fk: str, pk: str, allowed: dict[str, list[str]]) -> DataFrame:
    """check, n: rows with unknown parents, values outside lists, and surplus rows of repeated keys."""
    orphans = child.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti").select(F.lit("foreign key").alias("check"))
    outside = [child.where(~F.coalesce(F.col(c).isin(v), F.lit(False))).select(F.lit(f"check {c}").alias("check")) for c, v in allowed.items()]
    twice = child.groupBy(*key).count().where("count > 1").select(F.lit("primary key").alias("check"), (F.col("count") - 1).alias("n"))
    ones = orphans
    for o in outside:
        ones = ones.unionByName(o)
    return ones.withColumn("n", F.lit(1).cast("long")).unionByName(twice).groupBy("check").agg(F.sum("n").alias("n"))


def status_label(n_parsers: Column, n_runs: Column) -> Column:
    return F.when(F.coalesce(n_parsers, F.lit(0)) == 0, "needs parsing").when(F.coalesce(n_runs, F.lit(0)) == 0, "needs extraction").otherwise("extracted")


def workspace_status(papers: DataFrame, facts: DataFrame, cells: DataFrame) -> DataFrame:
    """sha, filename, n_parsers, n_facts, n_runs, status: papers with what is known of them, and shas without a paper.

    Facts and cells are counted per paper before they are joined, so a paper with a third of all facts is one row.
    """
    f = facts.groupBy(F.lower("sha").alias("sha")).agg(F.countDistinct(F.lower(F.trim("parser"))).alias("n_parsers"), F.count("*").alias("n_facts"))
    c = cells.groupBy(F.lower("paper_sha").alias("sha")).agg(F.countDistinct("cell_id").alias("n_runs"))
    p = papers.select(F.lower("sha256").alias("sha"), "filename")
    out = p.join(f, "sha", "full").join(c, "sha", "full")
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("n_parsers", "n_facts", "n_runs")}
    return out.withColumns(zero).withColumn("status", F.when(F.col("filename").isNull(), "not in papers").otherwise(status_label(F.col("n_parsers"), F.col("n_runs"))))


def skill_problems(skills: DataFrame, measurement_types: list[str], classes: list[str], tools: list[str]) -> DataFrame:
    """name, reason: skills whose targets, reads or uses go beyond what exists; good ones have no row."""
    over = lambda c, known: F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    checks = F.array(*(F.struct(F.lit(n).alias("what"), over(n, known).alias("over")) for n, known in (("targets", measurement_types), ("reads", classes), ("uses", tools))))
    e = skills.select("name", F.explode(checks).alias("x")).where(F.size("x.over") > 0)
    return e.select("name", F.concat(F.col("x.what"), F.lit(": "), F.array_join("x.over", ", ")).alias("reason"))
