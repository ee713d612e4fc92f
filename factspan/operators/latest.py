"""Latest and first per key, running totals, and what changes along an order.

Picking one row per key is an aggregation (max_by, min_by), which combines before the shuffle, so a key with a third of
all rows sends one row per partition. Running totals over everything go range by range: totals of the ranges are
summed first, then each range runs on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factspan.session import staged


def _others(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def latest(df: DataFrame, keys: list[str], by: list[Column | str]) -> DataFrame:
    """The row with the greatest by of each key; null keys are a key, null by is the smallest."""
    order = F.struct(*by)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*_others(df, keys)), order).alias("_b"))
    return best.select(*keys, "_b.*")


def first(df: DataFrame, keys: list[str], by: list[Column | str]) -> DataFrame:
    """The row with the smallest by of each key: a keep-first duplicate filter with a stated order."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*_others(df, keys)), F.struct(*by)).alias("_b"))
    return best.select(*keys, "_b.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old with the rows of new in place of those with their keys; seq tells which of several is the last written."""
    return latest(old.unionByName(new, allowMissingColumns=True), keys, [seq])


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old and the rows of new whose keys it lacks, the first of several by seq."""
    fresh = first(new.join(old.select(*keys).distinct(), keys, "left_anti"), keys, [seq])
    return old.unionByName(fresh, allowMissingColumns=True)


def parse_lookup(runs: DataFrame, blobs: DataFrame, keys: list[str], by: list[Column | str], path: str) -> DataFrame:
    """keys and path of the newest run of each key, whatever its version; path is null where its blob is missing.

    A missing blob is not made up for by an older run. blobs: the paths that exist.
    """
    newest = latest(runs.select(*keys, *by, path), keys, by).select(*keys, path)
    there = blobs.select(F.col(path).alias("_there")).distinct()
    return newest.join(there, F.col(path) == F.col("_there"), "left").withColumn(path, F.col("_there")).drop("_there")


def running_total(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """df with before and total: the sum of value over all earlier rows, and with the row itself.

    Rows are split into ranges of the order, which Spark cuts by a sample so that they are of like size however the
    rows lie in time. Only one number per range passes the window over ranges; rows are sorted inside their range.
    order must be total. Null values count as zero.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    d = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = d.groupBy("_range").agg(F.sum(v).alias("_s"))
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offset = sums.select("_range", F.coalesce(F.sum("_s").over(ahead), F.lit(0.0)).alias("_o"))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.join(offset, "_range").withColumn("total", F.col("_o") + F.sum(v).over(inside))
    return d.withColumn("before", F.col("total") - v).drop("_range", "_o")


def marks_crossed(totals: DataFrame, marks: list[float]) -> DataFrame:
    """A row per row of totals and mark with before < mark <= total."""
    m = F.explode(F.array(*(F.lit(float(x)) for x in marks)))
    return totals.withColumn("mark", m).where((F.col("before") < F.col("mark")) & (F.col("mark") <= F.col("total")))


def changes_only(df: DataFrame, keys: list[str], order: list[str], what: str) -> DataFrame:
    """Rows whose text differs from the one before; blank ones are skipped first, so runs collapse to their first row."""
    d = df.where(F.length(F.trim(F.col(what))) > 0)
    prev = F.lag(what).over(W.partitionBy(*keys).orderBy(*order))
    return d.withColumn("_prev", prev).where(~F.col(what).eqNullSafe(F.col("_prev"))).drop("_prev")


def paired(df: DataFrame, keys: list[str], order: list[str], kind: str, opens: str, closes: str, at: str) -> DataFrame:
    """Openings followed at once by a closing, with the seconds between."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.where(F.col(kind).isin(opens, closes)).withColumn("_next", F.lead(kind).over(w)).withColumn("closed_at", F.lead(at).over(w))
    d = d.where((F.col(kind) == opens) & (F.col("_next") == closes)).drop("_next")
    return d.withColumn("elapsed_s", (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6)


def last_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The last n rows by an order that must be total; Spark keeps n rows per task and n in the end."""
    return df.orderBy(*order).limit(n)
