"""Deeply nested records as flat tables (problem 5), by Dewey labelling.

Every node of a record gets the ordinals of the way to it as its label, 0.3.1 for the second entry of the fourth member
of the first member. A parent's label is its child's without the last ordinal; nodes of one schema path are one table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members that hold a list; a single entry counts as a list of one.
LISTS = ("items", "items.condition.electrolyte", "items.evidence", "items.evidence.paper.authors", "errors")
ELECTROLYTE, DOI, AUTHORS = "items.condition.electrolyte", "items.evidence.paper.doi", "items.evidence.paper.authors"
_NODES = "id long, doc string, label string, path string, entry boolean, kind string, val string"


def labelled(record: object, lists: tuple[str, ...], wanted: Callable[[str], bool]) -> Iterator[tuple]:
    """(label, path, entry, kind, val) of each node; entry marks the entries of a list, which share its path."""
    stack: list[tuple[str, str, bool, object]] = [("", "", False, record)]
    while stack:
        label, path, entry, v = stack.pop()
        if path in lists and not entry and v is not None and not isinstance(v, list):
            v = [v]
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}.get(type(v), "null")
        if path and wanted(path):
            val = None if kind in ("object", "array", "null") else v if kind == "string" else json.dumps(v)
            yield label, path, entry, kind, val
        below = f"{label}." if label else ""
        if kind == "object":
            stack.extend((f"{below}{i}", f"{path}.{k}" if path else k, False, x) for i, (k, x) in enumerate(v.items()))
        elif kind == "array":
            stack.extend((f"{below}{i}", path, True, x) for i, x in enumerate(v))


def nodes(df: DataFrame, id_col: str, json_col: str, lists: tuple[str, ...] = LISTS, under: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """id, doc (hash of the record), label, path, entry, kind, val of every node of every record.

    under: only nodes of these paths and below them are returned. once: a record delivered several times under one id
    is walked once. Null and unreadable records have no nodes; members that are null keep a node of kind null. Labels
    are unique within an id and doc: two records of one id are told apart by doc. Extra columns of df are ignored.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = (lambda p: any(p == u or p.startswith(u + ".") for u in under)) if under else lambda p: True
        for b in batches:
            rows = []
            for i, doc, text in zip(b["id"], b["doc"], b["text"]):
                try:
                    record = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows.extend((i, doc, *n) for n in labelled(record, lists, wanted))
            yield pd.DataFrame(rows, columns=["id", "doc", "label", "path", "entry", "kind", "val"])

    text = F.col(json_col)
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.substring(F.md5(text), 1, 16).alias("doc"), text.alias("text"))
    src = src.dropDuplicates(["id", "doc"]) if once else src
    return src.mapInPandas(walk, _NODES)


def parent(label: Column, steps: int = 1) -> Column:
    """The label of the node so many steps above, by truncation; '' above the top."""
    return F.regexp_replace(label, r"(?:^|\.)\d+" * steps + "$", "")


def ordinal(label: Column, depth: int) -> Column:
    """The ordinal at a depth counted from 1."""
    return F.split_part(label, F.lit("."), F.lit(depth)).cast("int")


def found(cells: DataFrame) -> DataFrame:
    """p5_found: electrolyte components, paper dois and authors with the item and evidence they belong to.

    The members formula, concentration, given and family are brought to their component or author by the parent's
    label. A record delivered twice under one id has the same hash and labels and so comes once. Items that are no
    objects keep their number; null entries have no row; a component or author that is plain text stands for its
    formula or name.
    """
    n = nodes(cells, "cell_id", "payload", under=(ELECTROLYTE, DOI, AUTHORS)).where("kind <> 'null' or path like '%.formula' or path like '%.concentration'")
    leaf = F.element_at(F.split("path", r"\."), -1)
    head = (F.col("path").isin(ELECTROLYTE, AUTHORS) & F.col("entry") & (F.col("kind") != "array")) | ((F.col("path") == DOI) & (F.col("val").isNotNull()))
    part = F.col("path").isin(f"{ELECTROLYTE}.formula", f"{ELECTROLYTE}.concentration", f"{AUTHORS}.given", f"{AUTHORS}.family")
    n = n.where(head | part).withColumn("leaf", F.when(head, F.lit("")).otherwise(leaf))
    n = n.withColumn("at", F.when(head, F.col("label")).otherwise(parent(F.col("label"))))
    n = n.withColumn("of", F.when(head, F.col("path")).otherwise(F.regexp_replace("path", r"\.[^.]+$", "")))
    pick = lambda name: F.max(F.when(F.col("leaf") == name, F.col("val")))
    g = n.groupBy("id", "doc", "of", "at").agg(
        F.max(F.col("leaf") == "").alias("whole"), pick("").alias("own"),
        *(pick(x).alias(x) for x in ("formula", "concentration", "given", "family")),
    ).where("whole")
    amount = F.round(F.trim("concentration").try_cast("double") * 1e6).cast("long")
    last = F.substring_index("at", ".", -1).cast("int")
    el, doi = F.col("of") == ELECTROLYTE, F.col("of") == DOI
    name = F.coalesce(F.col("own"), F.concat_ws(" ", F.expr("nullif(trim(given), '')"), F.expr("nullif(trim(family), '')")))
    out = g.select(
        F.col("id").alias("cell_id"),
        ordinal(F.col("at"), 2).alias("item_no"),
        F.when(el, F.lit(-1)).otherwise(ordinal(F.col("at"), 4)).alias("evidence_no"),
        F.when(el, F.lit("electrolyte")).when(doi, F.lit("doi")).otherwise(F.lit("author")).alias("child"),
        F.when(doi, F.lit(0)).otherwise(last).alias("child_no"),
        F.when(el, F.coalesce("own", "formula", F.lit(""))).otherwise(name).alias("val"),
        F.when(el, F.coalesce(amount, F.lit(-1))).otherwise(F.lit(-1)).cast("long").alias("amount"),
    )
    return out.where("child = 'electrolyte' or trim(val) <> ''").distinct()


def flat_table(cells: DataFrame, path: str) -> DataFrame:
    """cell_id, doc, label, parent_label, kind, val of the nodes of one schema path: one of the related flat tables.

    doc and parent_label lead to the parent's row, also where one id was delivered with different records.
    """
    n = nodes(cells, "cell_id", "payload", under=(path,), once=True).where(F.col("path") == path)
    up = F.when(F.col("entry"), parent(F.col("label"), 2)).otherwise(parent(F.col("label")))
    return n.select(F.col("id").alias("cell_id"), "doc", "label", up.alias("parent_label"), "kind", "val")
