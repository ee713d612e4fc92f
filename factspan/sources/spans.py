"""Parser outputs as numbered spans: one row per citeable piece of text with its page and box.

Input: a DataFrame with sha, parser and raw, the parser's JSON of one file as text. A file is one row, so its spans are
numbered where it is read, without a shuffle. Unknown parsers, markdown and broken JSON give no spans. Span ids count
from 0 in the order of the file, over all its pages; texts stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX = "array<double>"
_SPAN = "array<struct<page: int, text: string, bbox: struct<x0: double, y0: double, x1: double, y1: double>>>"
_SIDES = ("x0", "y0", "x1", "y1")


def _span(page: Column, text: Column, box: Column) -> Column:
    """One span; box is an array of four numbers."""
    b = F.when(F.size(box) == 4, F.struct(*(F.get(box, F.lit(i)).alias(n) for i, n in enumerate(_SIDES))))
    return F.struct(page.cast("int").alias("page"), text.alias("text"), b.alias("bbox"))


def _some(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _strings(json: Column, members: str) -> Column:
    """Every string under one of the members, at any depth, in order, joined by a blank."""
    raw = F.regexp_extract_all(json, F.lit(rf'"(?:{members})"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_join(F.transform(raw, lambda s: F.get_json_object(F.concat(F.lit('{"t":"'), s, F.lit('"}')), "$.t")), " ")


def _mineru(raw: Column) -> Column:
    """Pages of blocks; a block's text is every content and math_content string in it."""
    block = lambda p: lambda b: _span(p + 1, _strings(b, "content|math_content"), F.from_json(F.get_json_object(b, "$.bbox"), _BOX))
    return F.flatten(_some(F.transform(F.from_json(raw, "array<array<string>>"), lambda blocks, p: F.transform(blocks, block(p)))))


def _dots(raw: Column) -> Column:
    pages = F.from_json(raw, f"pages array<array<struct<text string, bbox {_BOX}>>>")["pages"]
    block = lambda p: lambda b: _span(p + 1, b["text"], b["bbox"])
    return F.flatten(_some(F.transform(pages, lambda blocks, p: F.transform(blocks, block(p)))))


def _paddle(raw: Column) -> Column:
    """Pages without an index have no spans."""
    pages = F.from_json(raw, f"pages array<struct<res struct<page_index int, parsing_res_list array<struct<block_content string, block_bbox {_BOX}>>>>>")["pages"]
    block = lambda n: lambda b: _span(n + 1, b["block_content"], b["block_bbox"])
    return F.flatten(_some(F.transform(pages, lambda p: F.transform(p["res"]["parsing_res_list"], block(p["res"]["page_index"])))))


def _docling(raw: Column) -> Column:
    """Texts, one span per place, then tables with every text in their data, however deep."""
    place = "prov array<struct<page_no int, bbox struct<l double, t double, r double, b double>>>"
    d = F.from_json(raw, f"texts array<struct<text string, orig string, {place}>>, tables array<struct<{place}, data string>>")
    at = lambda text: lambda v: _span(v["page_no"], text, F.array(*(v["bbox"][x] for x in "ltrb")))
    said = lambda t: F.when(F.length(t["text"]) > 0, t["text"]).otherwise(t["orig"])
    texts = F.transform(d["texts"], lambda t: F.transform(t["prov"], at(said(t))))
    tables = F.transform(d["tables"], lambda t: F.transform(t["prov"], at(_strings(t["data"], "text"))))
    whole = lambda a: F.coalesce(F.flatten(_some(a)), F.array().cast(_SPAN))
    return F.concat(whole(texts), whole(tables))


_ADAPTERS = {"mineru": _mineru, "dots": _dots, "paddle": _paddle, "docling": _docling}


def span_array(parser: Column, raw: Column) -> Column:
    """The spans of one file in order; empty for parsers without geometry and unreadable files.

    A span needs a page, a text that is not blank and a box of four numbers.
    """
    out = F.array().cast(_SPAN)
    for name, adapter in _ADAPTERS.items():
        out = F.when(F.lower(F.trim(parser)) == name, adapter(raw)).otherwise(out)
    whole = lambda s: F.coalesce(s["text"].rlike(r"\S"), F.lit(False)) & s["page"].isNotNull() & F.forall(F.array(*(s["bbox"][n] for n in _SIDES)), lambda x: x.isNotNull())
    return F.filter(F.coalesce(out, F.array().cast(_SPAN)), whole)


def spans(parsed: DataFrame, keys: tuple[str, ...] = ("sha", "parser")) -> DataFrame:
    """keys, span_id, page, text, bbox of all parser outputs, each read by its own parser's adapter.

    keys tell a file apart and come with its spans. Null and empty outputs have no rows; extra columns are left out.
    """
    out = parsed.select(*keys, F.posexplode(span_array(F.col("parser"), F.col("raw"))).alias("span_id", "s"))
    return out.select(*keys, "span_id", "s.page", "s.text", "s.bbox")


def page_sizes(parser: Column, raw: Column) -> Column:
    """array<struct<page, width, height>>: page sizes a file tells: docling in points, paddle in pixels, others none."""
    entries = F.map_entries(F.from_json(raw, "pages map<string, struct<size struct<width double, height double>>>")["pages"])
    points = F.transform(entries, lambda e: F.struct(e["key"].try_cast("int").alias("page"), e["value"]["size"]["width"].alias("width"), e["value"]["size"]["height"].alias("height")))
    pages = F.from_json(raw, "pages array<struct<res struct<page_index int, width double, height double>>>")["pages"]
    pixels = F.transform(pages, lambda p: F.struct((p["res"]["page_index"] + 1).alias("page"), p["res"]["width"].alias("width"), p["res"]["height"].alias("height")))
    name = F.lower(F.trim(parser))
    out = F.when(name == "docling", points).when(name == "paddle", pixels)
    return F.filter(out, lambda x: x["page"].isNotNull() & x["width"].isNotNull() & x["height"].isNotNull())


def line_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, span_id, text: the non-blank lines of plain texts, numbered from 0 with blank lines left out."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    return documents.select(F.col(id_col), F.posexplode(lines).alias("span_id", "text"))


def batches(s: DataFrame, keys: list[str], max_tokens: int = 120_000) -> DataFrame:
    """s with batch: 0 where the whole projection is at most max_tokens (four characters each), else the page.

    The size of a projection is summed before the shuffle and joined back, so a long paper is never in one task.
    """
    size = s.groupBy(*keys).agg(F.sum(F.length("text") + 1).alias("_size"))
    return s.join(size, keys).withColumn("batch", F.when(F.floor(F.col("_size") / 4) <= max_tokens, F.lit(0)).otherwise(F.col("page"))).drop("_size")
