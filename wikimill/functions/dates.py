"""Date texts and date macros."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import woven
from .keys import as_col, let

KOREAN_DATE = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
DOTTED_DATE = r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?"


def iso_date(c: Column | str) -> Column:
    """First ``YYYY년 M월 D일`` (else ``YYYY. M. D.``) in the text as ``YYYY-MM-DD``, null when there is none."""
    c = as_col(c)

    def parts(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(c, pattern, g) for g in (1, 2, 3))
        return F.concat_ws("-", y, *(F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), 2, "0") for x in (m, d)))

    return F.when(c.rlike(KOREAN_DATE), parts(KOREAN_DATE)).when(c.rlike(DOTTED_DATE), parts(DOTTED_DATE))


def _parts(raw: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a ``YYYY-MM-DD`` argument."""
    return tuple(F.substring(raw, at, n).cast("int") for at, n in ((1, 4), (6, 2), (9, 2)))


def _in_range(m: Column, d: Column) -> Column:
    return m.between(1, 12) & d.between(1, 31)


def dday(raw: Column, as_of: Column) -> Column:
    """Days from the date to today in UTC+9, with ``+`` for today and the past; null for an invalid date.

    Day 31 of a shorter month rolls over into the next one.
    """
    y, m, d = _parts(raw)
    today = F.to_date(as_of + F.expr("INTERVAL 9 HOURS"))
    n = F.when(_in_range(m, d), F.datediff(today, F.date_add(F.make_date(y, m, F.lit(1)), d - 1)))
    return let(n, lambda v: F.when(v >= 0, F.concat(F.lit("+"), v.cast("string"))).otherwise(v.cast("string")))


def age(raw: Column, as_of: Column) -> Column:
    """Full years at today's date in UTC+9, never below zero; null for an invalid date."""
    y, m, d = _parts(raw)
    today = F.to_date(as_of + F.expr("INTERVAL 9 HOURS"))
    before = (F.month(today) < m) | ((F.month(today) == m) & (F.dayofmonth(today) < d))
    years = F.year(today) - y - F.when(before, 1).otherwise(0)
    return F.when(_in_range(m, d), F.greatest(F.lit(0), years).cast("string"))


def expand_date_macros(html: Column | str, as_of: Column) -> Column:
    """Replace every dday and age macro of a text; invalid dates stay as written."""

    def replace(text: Column, name: str, value: Callable[[Column, Column], Column]) -> Column:
        pattern = rf"(?i)(?:\[|&#91;){name}\((\d{{4}}-\d{{2}}-\d{{2}})\)(?:\]|&#93;)"

        def piece(z: Column) -> Column:
            return F.concat(z["piece"], F.coalesce(value(z["g1"], as_of), z["raw"], F.lit("")))

        return F.array_join(F.transform(woven(text, pattern, 1), piece), "")

    return let(replace(as_col(html), "dday", dday), lambda t: replace(t, "age", age))
