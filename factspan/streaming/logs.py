"""Append-only logs as streams (an extension: the batch operators are the contract)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON line files of a folder as they arrive; malformed lines are left out."""
    raw = spark.readStream.schema("value string").format("text").load(folder)
    parsed = raw.withColumn("r", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.where("r is not null and r._broken is null").select("r.*").drop("_broken")


def spend_per_window(log: DataFrame, at: str, amount: str, kind: str, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """window start, kind, n, amount; events later than late are dropped, state older than that is forgotten."""
    w = log.withWatermark(at, late).groupBy(F.window(at, window), kind)
    return w.agg(F.count("*").alias("n"), F.sum(amount).alias("amount")).select(F.col("window.start").alias("start"), kind, "n", "amount")


def sessions(log: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """start, end, n of a key's sessions: a gap without events ends one, as an idle watchdog would."""
    w = log.withWatermark(at, late).groupBy(F.session_window(at, gap), key)
    return w.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
