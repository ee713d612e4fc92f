"""Best representative of each duplicate group (problem 1), by skyline selection.

A record is dominated if another of its group carries every field it carries, is at least as trusted and as recent,
and better in something. Undominated records form the first layer, the undominated of the rest the second, and so on.
A lexicographic policy (trust, recency, smallest id) orders a layer; fields the first record lacks are filled from the
next record of the layer, then from the next layers.

Layers come from one window per group: with records sorted by the policy, a record is dominated exactly if one before
it carries at least its fields and is at least as recent, so a running maximum of the recency per field combination
tells. Each group is first thinned in salted parts, which is exact: the first layers of the whole are found among the
first layers of the parts.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.functions.marks import number_present, squeezed, text_present
from factspan.session import staged

#: Parts into which each group is split before its layers are taken.
SALTS = 16
#: Corners of coinciding boxes are less than this many points apart.
BOX_TOLERANCE = 1.5


def _policy() -> list[Column]:
    return [F.col("_trust").desc_nulls_last(), F.col("_recent").desc_nulls_last(), F.col("_count").desc(), F.col("_id")]


def _undominated(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """df with _top: whether the record is undominated in its group of keys."""
    before = W.partitionBy(*keys).orderBy(*_policy()).rowsBetween(W.unboundedPreceding, -1)
    dominated = F.lit(False)
    for mask in product((False, True), repeat=len(fields)):
        mine = reduce(lambda a, b: a & b, [F.col(f"_has_{f}") == F.lit(m) for f, m in zip(fields, mask)])
        carries = reduce(lambda a, b: a & b, [F.col(f"_has_{f}") for f, m in zip(fields, mask) if m], F.lit(True))
        latest = F.max(F.when(carries, F.coalesce("_recent", F.lit("0001-01-01").cast("timestamp")))).over(before)
        recent = F.coalesce("_recent", F.lit("0001-01-01").cast("timestamp"))
        dominated = dominated | (mine & F.coalesce(latest >= recent, F.lit(False)))
    return df.withColumn("_top", ~dominated)


def skyline(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    present: dict[str, Column],
    trust: Column,
    recency: Column,
    layers: int = 1,
    extents: list[str] | None = None,
) -> DataFrame:
    """The first layers of each group: df's columns with _layer, _n (rows of the part) and _first (its smallest id).

    present tells for each field whether the record carries it. Null trust or recency is the lowest; exact ties go to
    the smaller id, which then dominates. _n and _first are held by one record of each part, so that their sum and
    minimum over a group are those of all its rows, dropped ones included. extents: columns of which every record also
    gets the range in its part, as _lo_ and _hi_.
    """
    d = df.withColumn("_id", F.col(id_col)).withColumn("_trust", trust).withColumn("_recent", recency.cast("timestamp"))
    for f, c in present.items():
        d = d.withColumn(f"_has_{f}", F.coalesce(c, F.lit(False)))
    d = d.withColumn("_count", sum((F.col(f"_has_{f}").cast("int") for f in present), F.lit(0)))
    d = d.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    part = [*keys, "_salt"]
    d = _layered(d, part, list(present), layers)
    whole = W.partitionBy(*part)
    first = F.row_number().over(W.partitionBy(*part).orderBy(*_policy())) == 1
    over = {f"_{side}_{c}": fn(c).over(whole) for c in extents or [] for side, fn in (("lo", F.min), ("hi", F.max))}
    d = d.withColumns({"_at": F.when(first, 1), "_n": F.count("*").over(whole), "_first": F.min("_id").over(whole), **over})
    d = d.withColumns({c: F.when(F.col("_at") == 1, F.col(c)) for c in ("_n", "_first")}).drop("_at")
    return d.where(F.col("_layer") <= layers)


def _layered(d: DataFrame, keys: list[str], fields: list[str], layers: int) -> DataFrame:
    """_layer: 1 for undominated records, 2 for those undominated without them, ...; layers + 1 for the rest."""
    d = _undominated(d, keys, fields).withColumn("_layer", F.when(F.col("_top"), 1).otherwise(2))
    for k in range(2, layers + 1):
        d = _undominated(d, [*keys, "_layer"], fields)
        d = d.withColumn("_layer", F.when((F.col("_layer") == k) & ~F.col("_top"), k + 1).otherwise(F.col("_layer")))
    return d.drop("_top")


def resolve(thinned: DataFrame, keys: list[str], fields: dict[str, Column], layers: int = 1) -> DataFrame:
    """One row per group: keys, n_rows, first_id, best_id, and per field its value and the id it was taken from.

    thinned: what skyline() left of the parts. The layers are taken once more over the whole group; then each field
    comes from the first record, by layer and policy, that carries it. Groups where no record carries a field have
    nulls for it.
    """
    d = _layered(thinned, keys, list(fields), layers)
    rank = F.struct("_layer", (-F.coalesce("_trust", F.lit(float("-inf")))).alias("t"), (-F.coalesce(F.unix_micros("_recent"), F.lit(-(2**62)))).alias("r"), (-F.col("_count")).alias("c"), "_id")
    aggs = [F.sum("_n").alias("n_rows"), F.min("_first").alias("first_id"), F.min_by("_id", rank).alias("best_id")]
    for f, c in fields.items():
        has = F.col(f"_has_{f}")
        aggs.append(F.min_by(F.when(has, F.struct(c.alias("v"), F.col("_id").alias("i"))), F.when(has, rank)).alias(f"_b_{f}"))
    out = d.groupBy(*keys).agg(*aggs)
    for f in fields:
        out = out.withColumn(f, F.col(f"_b_{f}.v")).withColumn(f"{f}_id", F.col(f"_b_{f}.i"))
    return out.drop(*(f"_b_{f}" for f in fields))


def box_groups(cells: DataFrame, boxes: DataFrame, keys: list[str], corners: list[str]) -> DataFrame:
    """cells with _group: within keys, the smallest cell of the boxes linked to a cell's by corners under BOX_TOLERANCE apart.

    cells: one row per grid cell of boxes (or part of one), with _cell, its name, and _lo_ and _hi_, the range of each
    corner in it. One coordinate after the other, cells are sorted and cut where the gap to all before is at least the
    tolerance, until no cut is left. A piece under the tolerance in every coordinate is one group, as all its boxes
    coincide. Pieces that are longer are chains or neighbours in some coordinates only; their boxes are compared cell
    by cell and the links followed to their end (linked_cells). All windows share the partitioning by keys; rows here
    are distinct places on one page, of which a page has a limited number.
    """
    cut: list[str] = []
    for i, c in enumerate([*corners] * 2):
        w = W.partitionBy(*keys, *cut).orderBy(F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), F.col("_id"))
        reach = F.max(f"_hi_{c}").over(w.rowsBetween(W.unboundedPreceding, -1))
        cells = cells.withColumn("_new", F.when(F.col(f"_lo_{c}") - reach >= BOX_TOLERANCE, 1).otherwise(0))
        cells = cells.withColumn(f"_g{i}", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
        cut.append(f"_g{i}")
    piece = W.partitionBy(*keys, *cut)
    long = reduce(lambda a, b: a | b, [F.max(f"_hi_{c}").over(piece) - F.min(f"_lo_{c}").over(piece) >= BOX_TOLERANCE for c in corners])
    cells = cells.withColumn("_group", F.min("_cell").over(piece)).withColumn("_long", long).drop(*cut)
    unsure = staged(cells.where("_long").select(*keys, "_cell").distinct())
    if unsure.isEmpty():
        return cells.drop("_long")
    linked = linked_cells(boxes.join(unsure, [*keys, "_cell"], "left_semi"), keys, corners)
    return cells.join(linked, [*keys, "_cell"], "left").withColumn("_group", F.when(F.col("_long"), F.coalesce("_label", "_cell")).otherwise(F.col("_group"))).drop("_long", "_label")


def linked_cells(boxes: DataFrame, keys: list[str], corners: list[str]) -> DataFrame:
    """keys, _cell, _label: for cells of boxes, the smallest cell reached over links between boxes of neighbouring cells.

    Two cells are linked if any box of one is within the tolerance of any box of the other in all corners; boxes of
    one cell always are. Labels are passed along links, and from label to label, until none changes.
    """
    grid = [f"_{c}" for c in corners]
    b = boxes.select(*keys, "_cell", *grid, *corners).distinct()
    steps = F.array(*(F.struct(*(F.lit(d).alias(g) for d, g in zip(ds, grid))) for ds in product((-1, 0, 1), repeat=len(grid)) if any(ds)))
    other = b.select(*keys, F.col("_cell").alias("_from"), *(F.col(c).alias(f"o{c}") for c in corners), *(F.col(g).alias(f"f{g}") for g in grid))
    other = other.withColumn("_s", F.explode(steps)).withColumns({g: F.col(f"f{g}") + F.col(f"_s.{g}") for g in grid})
    near = reduce(lambda x, y: x & y, [F.abs(F.col(c) - F.col(f"o{c}")) < BOX_TOLERANCE for c in corners])
    links = staged(b.join(other, [*keys, *grid]).where(near).select(*keys, "_cell", "_from").distinct())
    labels = staged(b.select(*keys, "_cell").distinct().withColumn("_label", F.col("_cell")))
    while True:
        seen = links.join(labels.withColumnRenamed("_cell", "_from"), [*keys, "_from"]).groupBy(*keys, "_cell").agg(F.min("_label").alias("_near"))
        new = labels.join(seen, [*keys, "_cell"], "left").withColumn("_low", F.least("_label", F.coalesce("_near", "_label")))
        up = labels.select(*keys, F.col("_cell").alias("_low"), F.col("_label").alias("_top"))  # the label of the label: paths halve
        new = staged(new.join(up, [*keys, "_low"], "left").select(*keys, "_cell", F.least("_low", F.coalesce("_top", "_low")).alias("_next"), "_label"))
        settled = new.where("_next <> _label").isEmpty()
        labels = new.select(*keys, "_cell", F.col("_next").alias("_label"))
        if settled:
            return labels


def fact_survivors(facts: DataFrame) -> DataFrame:
    """sha, type, page, n_rows, first_id, best_id, value, value_id, parser, parser_id, model, model_id_id: one row per group of facts.

    Facts of one paper, type and page whose boxes coincide are one measurement. Boxes that fall in one grid cell of
    the tolerance coincide for certain, so a cell (salted) is thinned to its skyline before cells are linked. Letter
    case and blanks of sha and parser are ignored. Facts without paper, type, page or box belong to no group and are
    left out. Trust is the confidence, recency extracted_at.
    """
    corners = ["x0", "y0", "x1", "y1"]
    d = facts.select(
        F.trim(F.lower("sha")).alias("sha"), "type", F.col("evidence.page").alias("page"), "fact_id", "value",
        F.trim(F.lower("parser")).alias("parser"), F.trim("model").alias("model"), "confidence", "extracted_at",
        *(F.col(f"evidence.bbox_{c}").alias(c) for c in corners),
    ).dropna(subset=["sha", "type", "page", "fact_id", *corners])
    cell = [f"_{c}" for c in corners]
    for c in corners:
        d = d.withColumn(f"_{c}", F.floor(F.col(c) / BOX_TOLERANCE))
    d = d.withColumn("_cell", F.concat_ws(" ", *cell))
    keys = ["sha", "type", "page"]
    present = {"value": number_present(F.col("value")), "parser": text_present(F.col("parser")), "model": text_present(F.col("model"))}
    trust = F.when(~F.isnan("confidence"), F.col("confidence"))
    thin = skyline(d, [*keys, *cell], "fact_id", present, trust, F.col("extracted_at"), extents=corners)
    thin = box_groups(staged(thin), d, keys, corners)
    out = resolve(thin, [*keys, "_group"], {"value": F.col("value"), "parser": F.col("parser"), "model": F.col("model")})
    return out.drop("_group")


def plain_name(c: Column) -> Column:
    """A spelling-free form of labels and modes: lower case, blanks and underscores as hyphens."""
    return F.regexp_replace(squeezed(c), r"[ _]+", "-")


def export_survivors(matrix_rows: DataFrame) -> DataFrame:
    """cell keys, n_rows, first_id, best_id, parser, parser_id, model_id, model_id_id: one row per benchmark cell.

    Exports of one paper, parser (that of the source file's name), label, mode and prompt_hash, however spelled, are
    one cell. Recency is recorded_at; all exports are trusted alike. A row that lacks any of these is no duplicate of
    any other: it is a cell of its own.
    """
    d = matrix_rows.where(F.col("row_id").isNotNull()).select(
        squeezed(F.col("paper_sha8")).alias("paper"),
        F.lower(F.regexp_extract("source_file", r"(?i)^.*?llm_matrix_(.+?)_\d{4}", 1)).alias("file_parser"),
        plain_name(F.col("label")).alias("label"), plain_name(F.col("mode")).alias("mode"),
        squeezed(F.col("prompt_hash")).alias("prompt"), "row_id", "parser", "model_id", "recorded_at",
    )
    names = ["paper", "file_parser", "label", "mode", "prompt"]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k) != "") for k in names])
    d = d.withColumn("own", F.when(~F.coalesce(whole, F.lit(False)), F.col("row_id")))
    keys = [*names, "own"]
    present = {"parser": text_present(F.col("parser")), "model_id": text_present(F.col("model_id"))}
    thin = skyline(d, keys, "row_id", present, F.lit(0.0), F.col("recorded_at"))
    return resolve(thin, keys, {"parser": F.col("parser"), "model_id": F.col("model_id")}).drop("own")


def found(facts: DataFrame, matrix_rows: DataFrame) -> DataFrame:
    """p1_found: of each group of two or more rows, the row each field is taken from."""
    f = fact_survivors(facts).where((F.col("n_rows") > 1) & F.col("value_id").isNotNull())
    m = export_survivors(matrix_rows).where(F.col("n_rows") > 1)
    one = lambda d, tbl, field: d.where(F.col(f"{field}_id").isNotNull()).select(F.lit(tbl).alias("tbl"), "first_id", F.lit(field).alias("field"), F.col(f"{field}_id").alias("best_id"))
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), F.col(f"{x}_id").alias("best_id")) for x in ("parser", "model_id"))))
    both = m.select("first_id", pairs.alias("p")).select(F.lit("matrix_rows").alias("tbl"), "first_id", "p.*").where(F.col("best_id").isNotNull())
    return one(f, "facts", "value").unionByName(both)
