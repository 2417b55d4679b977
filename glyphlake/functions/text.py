"""Text expressions: counts, bands, names, normal form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Normal form C; null becomes ''."""
    return F.pandas_udf(_nfc, "string")(F.coalesce(c, F.lit("")))


def char_count(c: Column, mode: str = "lines") -> Column:
    """Characters without line feeds (``lines``), or without line feeds and blanks (``dense``)."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(""))
    return F.length(text if mode == "lines" else F.replace(text, F.lit(" "), F.lit("")))


def line_count(c: Column) -> Column:
    """0 for '', else the number of lines that hold anything but white space, 1 at least."""
    text = F.coalesce(c, F.lit(""))
    full = F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"\S"))))
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), full))


#: Lower bounds of confidence bands (fixed values).
BANDS = ((0.95, "Excellent"), (0.85, "Good"), (0.7, "Fair"))


def confidence_band(c: Column) -> Column:
    band = F.lit("Low")
    for least, name in reversed(BANDS):
        band = F.when(c >= least, name).otherwise(band)
    return band


def strip_ext(c: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(c, r"\.[^.]+$", "")


def extension(c: Column) -> Column:
    """Lower-case text after the last dot; '' without a dot."""
    return F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))


def milliseconds(c: Column, digits: int = 2) -> Column:
    """A duration rounded for display, halves to even."""
    return F.bround(c, digits)


def score(c: Column) -> Column:
    """A confidence rounded to four digits, halves to even."""
    return F.bround(c, 4)


def percent(c: Column, digits: int = 1) -> Column:
    return F.round(c * 100, digits)


def right_edge(x: Column, w: Column) -> Column:
    return x + w


def centre(x: Column, w: Column) -> Column:
    return x + w / 2
