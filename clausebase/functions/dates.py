"""Dates in the forms d.m.y and d Month y, as ISO strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the accepted forms
NUMERIC = r"(?U)\b(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2,4})\b"
TEXTUAL = r"(?U)\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})\b"
NEARBY = r"(?U)\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}|\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?,?\s+\d{4}"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PIVOT = 69
#: Decimal digits of other scripts, which the patterns accept, and their values.
DIGITS = {c: str(n) for c in map(chr, range(0x80, 0x10000)) if (n := unicodedata.decimal(c, None)) is not None}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def month_number(name: Column) -> Column:
    """Of a full name, its first three letters, or sept; null otherwise."""
    low, out = F.lower(name), F.lit(None).cast("int")
    for k, month in enumerate(MONTHS, 1):
        out = F.when(low.isin(month, month[:3], *(["sept"] if k == 9 else [])), k).otherwise(out)
    return out


def _iso(y: Column, m: Column, d: Column) -> Column:
    """ISO date, null if there is no such day; years below 1 are none."""
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when((y >= 1) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def _parts(text: Column, pattern: str) -> Column:
    """The three groups of the first match; empty strings where there is none."""
    return F.array(*[F.regexp_extract(text, pattern, k) for k in (1, 2, 3)])


def _numeric(p: Column) -> Column:
    d, m, y = (F.get(p, F.lit(k)).cast("int") for k in range(3))
    year = F.when(y >= 100, y).when(y <= PIVOT, 2000 + y).otherwise(1900 + y)
    return F.when(F.get(p, F.lit(2)) != "", _iso(year, m, d))


def _textual(p: Column) -> Column:
    month = month_number(F.get(p, F.lit(1)))
    return F.when(month.isNotNull(), _iso(F.get(p, F.lit(2)).cast("int"), month, F.get(p, F.lit(0)).cast("int")))


def parse_date(text: Column) -> Column:
    """The first numeric date if it exists in the calendar, else the first textual one, else null."""
    text = F.translate(text, "".join(DIGITS), "".join(DIGITS.values()))
    return F.coalesce(let(_parts(text, NUMERIC), _numeric), let(_parts(text, TEXTUAL), _textual))


def nearby_date(*texts: Column) -> Column:
    """The first date-like string of the first text that has one: row, enclosing element, anchor."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, NEARBY, 0), F.lit("")) for t in texts])
