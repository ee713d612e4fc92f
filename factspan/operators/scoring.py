"""Scoring of extracted tuples against gold: greedy tolerance matching, taxonomy, unions and agreement.

Matching is order-dependent: predictions in order claim the first unclaimed gold tuple of their type within tolerance.
It is a fold over the arrays of one cell (a payload, so of bounded size) in Column expressions; a plain band join would
count a gold tuple twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.functions.numbers import within_tolerance

_PAIR = "array<struct<pi:int,gi:int>>"


def indexes(a: Column) -> Column:
    """0 .. size - 1; empty for empty and null arrays, where sequence() would count down."""
    n = F.coalesce(F.size(a), F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def greedy_pairs(preds: Column, gold: Column) -> Column:
    """array<struct<pi, gi>>: which prediction claimed which gold tuple; both are array<struct<type, value>>."""

    def step(done: Column, pi: Column) -> Column:
        p = F.get(preds, pi)

        def fits(gi: Column) -> Column:
            g = F.get(gold, gi)
            return (g["type"] == p["type"]) & within_tolerance(g["value"], p["value"]) & ~F.exists(done, lambda x: x["gi"] == gi)

        hit = F.get(F.filter(indexes(gold), fits), F.lit(0))
        more = F.concat(done, F.array(F.struct(pi.cast("int").alias("pi"), hit.cast("int").alias("gi"))))
        return F.when(hit.isNotNull(), more).otherwise(done)

    return F.aggregate(indexes(preds), F.array().cast(_PAIR), step)


def wrong_type_pairs(preds: Column, gold: Column, present: Column, hits: Column) -> Column:
    """Of the gold tuples left over and present in the parse: the first unused prediction of any type within tolerance."""

    def step(done: Column, gi: Column) -> Column:
        g = F.get(gold, gi)
        used = F.concat(hits, done)
        taken = F.exists(hits, lambda x: x["gi"] == gi)
        fits = lambda pi: within_tolerance(g["value"], F.get(preds, pi)["value"]) & ~F.exists(used, lambda x: x["pi"] == pi)
        ok = ~taken & g["value"].isNotNull() & F.coalesce(F.get(present, gi), F.lit(True))
        hit = F.when(ok, F.get(F.filter(indexes(preds), fits), F.lit(0)))
        more = F.concat(done, F.array(F.struct(hit.cast("int").alias("pi"), gi.cast("int").alias("gi"))))
        return F.when(hit.isNotNull(), more).otherwise(done)

    return F.aggregate(indexes(gold), F.array().cast(_PAIR), step)


def scored(cells: DataFrame) -> DataFrame:
    """cells with tp, n_preds, n_gold, recall, precision, f1 from preds and gold; ratios over nothing are 0."""
    d = cells.withColumn("hits", greedy_pairs(F.col("preds"), F.col("gold")))
    d = d.withColumn("tp", F.size("hits")).withColumn("n_preds", F.coalesce(F.size("preds"), F.lit(0))).withColumn("n_gold", F.coalesce(F.size("gold"), F.lit(0)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    d = d.withColumn("recall", ratio(F.col("tp"), F.col("n_gold"))).withColumn("precision", ratio(F.col("tp"), F.col("n_preds")))
    return d.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def classified(cells: DataFrame) -> DataFrame:
    """cells with per_tuple (type, value, status, predicted_as) and fp, from preds, gold and present.

    Statuses: hit; wrong_type, where an unused prediction of another type has the value of a present tuple;
    coverage_gap, where the value is not in the parse; model_gap. fp: predictions used for neither.
    """
    d = cells.withColumn("hits", greedy_pairs(F.col("preds"), F.col("gold")))
    d = d.withColumn("wrong", wrong_type_pairs(F.col("preds"), F.col("gold"), F.col("present"), F.col("hits")))

    def one(gi: Column) -> Column:
        g = F.get(F.col("gold"), gi)
        w = F.get(F.filter("wrong", lambda x: x["gi"] == gi), F.lit(0))
        there = F.coalesce(F.get(F.col("present"), gi), F.lit(True))
        status = F.when(F.exists("hits", lambda x: x["gi"] == gi), "hit").when(w.isNotNull(), "wrong_type").when(~there, "coverage_gap").otherwise("model_gap")
        return F.struct(g["type"].alias("type"), g["value"].alias("value"), status.alias("status"), F.get(F.col("preds"), w["pi"])["type"].alias("predicted_as"))

    d = d.withColumn("per_tuple", F.transform(indexes(F.col("gold")), one))
    return d.withColumn("fp", F.coalesce(F.size("preds"), F.lit(0)) - F.size("hits") - F.size("wrong"))


def false_positives(preds: Column, hits: Column) -> Column:
    """Predictions that claimed no gold tuple."""
    left = F.filter(indexes(preds), lambda i: ~F.exists(hits, lambda x: x["pi"] == i))
    return F.transform(left, lambda i: F.get(preds, i))


def agreement(fps: DataFrame) -> DataFrame:
    """type, value, sha8, n_models, band: per false value the paper in which most models agree, first seen on a tie.

    fps: type, value, sha, label, seq. Three or more models make a value likely real, one likely invented.
    """
    v = fps.where(F.col("value").isNotNull()).withColumn("value", F.round("value", 3))
    per = v.groupBy("type", "value", F.substring("sha", 1, 8).alias("sha8")).agg(F.countDistinct("label").alias("n_models"), F.min("seq").alias("seq"))
    best = per.groupBy("type", "value").agg(F.max_by(F.struct("sha8", "n_models"), F.struct("n_models", -F.col("seq"))).alias("b"))
    band = F.when(F.col("n_models") >= 3, "likely real").when(F.col("n_models") == 2, "ambiguous").otherwise("likely invented")
    return best.select("type", "value", "b.*").withColumn("band", band)


def _euro(c: str) -> Column:
    """A sum of amounts of money, exact in whatever order it is added up."""
    return F.sum(F.col(c).cast("decimal(20,8)"))


def macro_micro(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means over papers and ratios of sums per group; empty sums give nulls."""
    return rows.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"), F.avg("precision").alias("macro_precision"),
        F.try_divide(F.sum("tp"), F.sum("gt_total")).alias("micro_recall"),
        F.try_divide(_euro("eur_per_paper").cast("double"), F.sum("tp")).alias("eur_per_tp"), _euro("eur_per_paper").cast("double").alias("eur"), F.sum("tp").alias("tp"),
        F.avg("latency_s").alias("latency_s"), F.countDistinct("paper").alias("n_papers"),
    )


def complete_block(per_parser: DataFrame, keys: list[str], over: str, n: int, value: str) -> DataFrame:
    """The mean of value over over, for keys that have all n of them."""
    g = per_parser.groupBy(*keys).agg(F.countDistinct(over).alias("_n"), F.avg(value).alias(f"mean_{value}"))
    return g.where(F.col("_n") == n).drop("_n")


def unioned(items: DataFrame, keys: list[str], source: str, least: int, order: list[str]) -> DataFrame:
    """Items of keys found by at least so many sources, each (type, value) once: the first by order."""
    from factspan.operators.latest import first

    enough = items.groupBy(*keys).agg(F.countDistinct(source).alias("_n")).where(F.col("_n") >= least).select(*keys)
    return first(items.join(enough, keys, "left_semi"), [*keys, "type", "value"], order)


def requeried(first_pass: DataFrame, second_pass: DataFrame, keys: list[str], vocabulary: list[str], order: list[str]) -> DataFrame:
    """The first pass with what the second found of types the first lacks, each (type, value) once.

    Where the first pass lacks no type of the vocabulary, or there was none, the second adds nothing.
    """
    have = first_pass.where(F.col("type").isin(vocabulary)).groupBy(*keys).agg(F.collect_set("type").alias("_have"))  # at most the vocabulary
    asked = have.where(F.size("_have") < len(vocabulary))
    more = second_pass.join(asked, keys).where(~F.array_contains("_have", F.col("type"))).drop("_have")
    from factspan.operators.latest import first

    both = first_pass.withColumn("_pass", F.lit(1)).unionByName(more.withColumn("_pass", F.lit(2)))
    return first(both, [*keys, "type", "value"], ["_pass", *order]).drop("_pass")


def judged(items: Column, verdict: Column) -> Column:
    """Items with a true verdict; all of them where the verdict has another length or is null."""
    keep = F.filter(F.arrays_zip(items.alias("i"), verdict.alias("v")), lambda z: F.coalesce(z["v"], F.lit(False)))
    return F.when(F.size(items) == F.size(verdict), F.transform(keep, lambda z: z["i"])).otherwise(items)


def missing_types(found: Column, vocabulary: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, vocabulary)), found))
