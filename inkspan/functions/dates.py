"""Month-precise dates as text: YYYY-MM or YYYY; ranges; month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.binding import once

# The grammar of dates.
_YEAR = "(?:19|20)\\d{2}"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_PRESENT = "至今|现在|目前|今|present|now|current"
_SEPARATOR = "\\s*(?:-|–|—|~|～|至|到|\\bto\\b)+\\s*"
_DATE = (
    f"(?:({_YEAR})\\s*[.\\-/年]\\s*(1[0-2]|0?[1-9])(?!\\d)\\s*月?"
    f"|(jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]*\\.?\\s*,?\\s*({_YEAR})"
    f"|({_YEAR})\\s*年?)"
)
RANGE = f"(?i)(?<!\\d){_DATE}{_SEPARATOR}(?:{_DATE}|({_PRESENT}))(?!\\d)"
SINGLE = f"(?i)(?<!\\d){_DATE}(?!\\d)"


_CUT = "\x01"


def _groups(found: Column, pattern: str, n: int) -> Column:
    """The n groups of a text that ``pattern`` matches wholly, as an array, by one match; empty where a group is missing.

    A match alone has the same groups as inside its text: what ends with it ends before no digit in both.
    """
    return F.split(F.regexp_replace(found, pattern, _CUT.join(f"${i + 1}" for i in range(n))), _CUT, -1)


def _date(groups: Column, first: int) -> tuple[Column, Column]:
    """(year, month or null) of the date whose groups begin at ``first`` (from 0)."""
    g = [F.get(groups, F.lit(first + i)) for i in range(5)]
    name = F.lower(F.substring(g[2], 1, 3))
    month = F.coalesce(*[F.when(name == m, F.lit(i + 1)) for i, m in enumerate(_MONTHS)])
    year = F.when(g[0] != "", g[0]).when(g[3] != "", g[3]).when(g[4] != "", g[4])
    return year, F.when(g[0] != "", F.when(g[1] != "", g[1]).cast("int")).when(g[3] != "", month)


def _text(year: Column, month: Column, with_month: Column) -> Column:
    return F.when(with_month & month.isNotNull(), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(year)


def find_date_range(text: Column) -> Column:
    """First range of a text, else its first single date: struct(start, end, is_present, span_start, span_end), or null.

    The coarser end decides the precision of both. A single bare year counts only with 年 or if it is the whole text.
    """
    return once(text, _first_range)


def _first_range(text: Column) -> Column:
    def span(whole: Column, groups: Column) -> Column:
        (y1, m1), (y2, m2) = _date(groups, 0), _date(groups, 5)
        present = F.get(groups, F.lit(10)) != ""
        fine = m1.isNotNull() & (present | m2.isNotNull())
        at = F.instr(text, whole) - 1
        return F.struct(
            _text(y1, m1, fine).alias("start"),
            F.when(~present, _text(y2, m2, fine)).alias("end"),
            present.alias("is_present"),
            at.alias("span_start"),
            (at + F.length(whole)).alias("span_end"),
        )

    def single(good: Column) -> Column:
        y, m = _date(_groups(good, SINGLE, 5), 0)
        # the first place where the match stands free of digits
        at = F.regexp_instr(text, F.concat(F.lit("(?<!\\d)\\Q"), good, F.lit("\\E(?!\\d)"))) - 1
        return F.when(good.isNotNull(), F.struct(_text(y, m, F.lit(True)).alias("start"), F.lit(None).cast("string").alias("end"), F.lit(False).alias("is_present"), at.alias("span_start"), (at + F.length(good)).alias("span_end")))

    singles = F.regexp_extract_all(text, F.lit(SINGLE), F.lit(0))
    good = F.get(F.filter(singles, lambda s: ~F.trim(s).rlike(f"^{_YEAR}$") | (F.trim(s) == F.trim(text))), F.lit(0))
    return once(F.regexp_extract(text, RANGE, 0), lambda whole: F.when(whole != "", once(_groups(whole, RANGE, 11), lambda g: span(whole, g))).otherwise(once(good, single)))


def month_number(c: Column) -> Column:
    """Months since year 0 of a YYYY-MM text; null for coarser ones."""
    return F.when(F.length(c) == 7, F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int"))


def months_between(earlier: Column, later: Column) -> Column:
    return month_number(later) - month_number(earlier)


def is_date_line(text: Column) -> Column:
    """Whether a date covers half of the line or more."""
    wide = lambda t, found: (found["span_end"] - found["span_start"]) * 2 >= F.length(F.trim(t))
    return F.coalesce(once(text, lambda t: once(_first_range(t), lambda found: wide(t, found))), F.lit(False))


def window_start(today: Column, days: int) -> Column:
    return F.date_sub(today, days - 1)


def covered_months(spans: Column) -> Column:
    """Length of the union of month spans, an array of struct(start, end) month numbers."""
    return F.aggregate(
        F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"])),
        F.struct(F.lit(0).alias("total"), F.lit(-(1 << 30)).alias("until")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["until"]))).alias("total"),
            F.greatest(acc["until"], s["end"]).alias("until"),
        ),
        lambda acc: acc["total"],
    )
