"""Sources and sinks: hashed binaries, JSON cells, metric CSV, JSON lines, front matter, regex search, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factspan.functions.text import content_key

METRICS = (
    "parser string, label string, model_id string, role string, mode string, paper string, n_valid int, n_errors int, tp int, gt_total int, "
    "recall double, precision double, f1 double, in_tokens long, out_tokens long, eur_per_paper double, eur_per_tp double, latency_s double, "
    "temperature double, prompt_hash string"
)
# File names that hold secrets and are never searched; folders that are skipped.
SECRET = r"(?i)(^|/)(\.env[^/]*|id_rsa[^/]*|[^/]*\.(pem|key|p12|pfx)|credentials[^/]*|secrets?\.[^/]*)$"
SKIPPED = r"(^|/)(\.git|__pycache__|node_modules|\.venv)(/|$)"


def hashed_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, sha256, bytes: identity of files by their content, hashed where they are read."""
    f = spark.read.format("binaryFile").load(pattern)
    return f.select("path", F.sha2("content", 256).alias("sha256"), "length").withColumnRenamed("length", "bytes")


def hash_index(files: DataFrame, last: bool = True) -> DataFrame:
    """sha256, path: the last (or first) path of each content in the order of paths."""
    return files.groupBy("sha256").agg((F.max if last else F.min)("path").alias("path"))


def paper_ref(ref: Column) -> Column:
    """A reference given as 64 hex digits, in lower case; null for paths."""
    return F.when(ref.rlike(r"^[0-9a-fA-F]{64}$"), F.lower(ref))


def is_hex(ref: Column) -> Column:
    return F.coalesce(ref.rlike(r"^[0-9a-fA-F]+$"), F.lit(False))


def json_cells(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per JSON file with its path; files need not share a schema."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def metric_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric CSV with a header, typed; blanks are null, malformed fields too."""
    return spark.read.csv(pattern, header=True, schema=METRICS, nullValue="", mode="PERMISSIVE", quote='"', escape='"', multiLine=True)


def json_lines(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines with their path; malformed and torn lines are left out."""
    raw = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.withColumn("r", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.where("r is not null and r._broken is null").select("path", "r.*").drop("_broken")


def front_matter(spark: SparkSession, pattern: str) -> DataFrame:
    """front_matter_of() the files of a pattern, by their path."""
    d = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return front_matter_of(d)


def front_matter_of(files: DataFrame) -> DataFrame:
    """path, name, description, kind, targets, reads, uses, body, problem: skills with a fenced head of key: value lines.

    files: path and text. Lists are written [a, b]. A text without the fence has only a problem.
    """
    fence = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    d = files.select("path", "text", F.regexp_extract("text", fence, 1).alias("head"), F.regexp_extract("text", fence, 2).alias("body"))
    line = lambda k: F.expr(f"nullif(trim(both '\"' from trim(regexp_extract(head, '(?m)^{k}:[ ]*(.*)$', 1))), '')")
    items = lambda k: F.filter(F.split(F.translate(line(k), "[]", ""), r"\s*,\s*"), lambda x: F.trim(x) != "")
    fenced = F.coalesce(F.col("text").rlike(fence), F.lit(False))
    return d.select(
        "path", *(line(k).alias(k) for k in ("name", "description", "kind")), *(items(k).alias(k) for k in ("targets", "reads", "uses")),
        F.when(fenced, F.col("body")).alias("body"), F.when(~fenced, F.lit("no front matter")).alias("problem"),
    )


def lines_appended(records: DataFrame, path: str) -> None:
    """Adds each record as one JSON line to a log folder; nulls are left out, dates and numbers written as text."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def log_tail(log: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The last limit records of each log by an order that must be total; Spark keeps limit rows per key and task first."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return log.withColumn("_at", at).where(F.col("_at") <= limit).drop("_at")


def masked_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """results with content replaced where the call it answers read a secret path: what is kept of a session on disk.

    results: call_id, content; calls: call_id, path. Results of unknown calls stay as they are.
    """
    secret = calls.where(F.col("path").rlike(SECRET)).select("call_id", F.lit(True).alias("_secret")).distinct()
    masked = F.when(F.col("_secret"), F.lit("[redacted: secret path]")).otherwise(F.col("content"))
    return results.join(secret, "call_id", "left").withColumn("content", masked).drop("_secret")


def cell_filter(facts: DataFrame, parser: str | None = None, model: str | None = None) -> DataFrame:
    """Facts of one parser and model; a filter that is not given lets all pass, nulls pass only then."""
    out = facts if parser is None else facts.where(F.col("parser") == parser)
    return out if model is None else out.where(F.col("model") == model)


def search_lines(lines: DataFrame, path: str, number: str, text: str, pattern: str, cap: int = 100) -> DataFrame:
    """hit: 'path:line: text' of the first cap lines, by path and number, that match; texts are cut to 200 characters.

    Secret files and skipped folders are never searched. The cap is the feature: a report, not a filter of data.
    """
    d = lines.where(~F.col(path).cast("string").rlike(SECRET) & ~F.col(path).cast("string").rlike(SKIPPED) & F.col(text).rlike(pattern))
    top = d.orderBy(path, number).limit(cap)
    return top.select(F.concat(F.col(path).cast("string"), F.lit(":"), F.col(number).cast("string"), F.lit(": "), F.substring(text, 1, 200)).alias("hit"))


def cell_key(df: DataFrame) -> DataFrame:
    """df with cell_key: what a cached extraction is found under."""
    return df.withColumn("cell_key", content_key(F.substring("paper_sha", 1, 8), F.col("parser"), F.col("label"), F.col("mode"), F.col("prompt_hash")))


def cached_cells(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """wanted with payload where a cell of the same key and model is cached, else null: another model is a miss."""
    keys = ["paper_sha", "parser", "label", "mode", "prompt_hash"]
    have = cells.groupBy(*keys, "model_id").agg(F.max_by("payload", F.struct("saved_at", "cell_id")).alias("payload"))
    return wanted.join(have, [*keys, "model_id"], "left")


def exported(facts: DataFrame) -> DataFrame:
    """The ten columns of a fact export; the box as JSON."""
    box = F.to_json(F.array(*(F.col(f"evidence.bbox_{c}") for c in ("x0", "y0", "x1", "y1"))))
    return facts.select("fact_id", "type", "value", "unit_label", "confidence", F.col("evidence.page").alias("page"), box.alias("bbox"), "parser", "model", F.col("evidence.source_text").alias("source_text"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and standard quoting; texts keep their blanks at both ends, nulls are empty."""
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def snapshot_meta(rows: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """One row per snapshot: its models and modes, row count, and what it cost."""
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("mode")).alias("modes"),
        F.count("*").alias("n_rows"), F.round(F.max(end) - F.min(start), 4).alias("spent_eur"),
    )
