"""Text and geometry helpers of the evidence pipeline."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def latex_cleaned(c: Column) -> Column:
    """NFKC form without LaTeX commands, markup and repeated blanks. Only texts that are not ASCII leave the JVM."""
    t = F.regexp_replace(F.regexp_replace(_nfkc(c), r"\\[a-zA-Z]+|\\,", " "), r"[${}^_]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def phrase_around(text: Column, digits: Column, words: int = 3) -> Column:
    """The first word whose digits contain the given ones, with so many words on either side; null if none does."""
    ws = F.split(F.trim(text), r"\s+")
    at = F.array_position(F.transform(ws, lambda w: F.regexp_replace(w, r"\D", "").contains(digits)), True).cast("int")
    start = F.greatest(at - words, F.lit(1))
    return F.when((at > 0) & (digits != ""), F.array_join(F.slice(ws, start, at + words - start + 1), " "))


def one_line(c: Column, cap: int = 200) -> Column:
    """Blanks collapsed; cut to cap characters with an ellipsis."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap - 3), F.lit("..."))).otherwise(t)


def content_key(*parts: Column) -> Column:
    """Twelve hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 12)


def numbered(span_id: Column, page: Column, text: Column) -> Column:
    """[id] (pN) text: a line of the projection that an extractor cites."""
    return F.format_string("[%d] (p%d) %s", span_id, page, text)


def flipped(height: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with its origin moved from one left corner of the page to the other."""
    return F.struct(x0.alias("x0"), (height - y1).alias("y0"), x1.alias("x1"), (height - y0).alias("y1"))


def on_page(box: Column, width: Column, height: Column, ref_width: Column, ref_height: Column, slack: float = 1.0) -> Column:
    """The box in points: as it is if it fits the page, scaled from reference pixels if that fits, else null."""

    def fits(b: Column) -> Column:
        return (b["x0"] >= -slack) & (b["y0"] >= -slack) & (b["x1"] <= width + slack) & (b["y1"] <= height + slack)

    sx, sy = F.try_divide(width, ref_width), F.try_divide(height, ref_height)
    scaled = F.struct((box["x0"] * sx).alias("x0"), (box["y0"] * sy).alias("y0"), (box["x1"] * sx).alias("x1"), (box["y1"] * sy).alias("y1"))
    return F.when(fits(box), box).when(fits(scaled), scaled)


def page_unit(parser: Column) -> Column:
    """Unit of a parser's page geometry: points, pixels, or none."""
    return F.when(parser == "docling", "points").when(parser == "paddle", "pixels").otherwise("none")
