"""Date functions. "Today" is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schedlake.functions.times import WEEKDAY_CHARS

# Month names and the names of the days of a lunar month.
MONTH_NAMES = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]
DAY_LABELS = [
    "初一", "初二", "初三", "初四", "初五", "初六", "初七", "初八", "初九", "初十",
    "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十",
    "廿一", "廿二", "廿三", "廿四", "廿五", "廿六", "廿七", "廿八", "廿九", "三十",
]


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def iso_weekday(d: Column) -> Column:
    return F.weekday(d) + 1


def weekday_label(d: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), _pick(WEEKDAY_CHARS, F.weekday(d)))


def lunar_month_label(month: Column, leap: Column) -> Column:
    return F.concat(F.when(leap, "閏").otherwise(""), _pick(MONTH_NAMES, month - 1), F.lit("月"))


def lunar_day_label(day: Column) -> Column:
    return _pick(DAY_LABELS, day - 1)


def folk_month(label: Column) -> Column:
    """Folk name of the first and last lunar month; the longer prefix is tried first."""
    return (
        F.when(label.startswith("十二月"), F.concat(F.lit("臘月"), F.substr(label, F.lit(4))))
        .when(label.startswith("一月"), F.concat(F.lit("正月"), F.substr(label, F.lit(3))))
        .otherwise(label)
    )


def short_date(d: Column) -> Column:
    """M/D with the weekday in brackets."""
    return F.concat(F.month(d).cast("string"), F.lit("/"), F.day(d).cast("string"), F.lit("("), weekday_label(d), F.lit(")"))


def date_line(d: Column) -> Column:
    return F.concat(F.lit("今天:"), F.date_format(d, "yyyy/MM/dd"), F.lit(" "), weekday_label(d, "週"))


def roc_date(text: Column) -> Column:
    """Date of ``N年M月D日`` text counted from 1912; NULL when the text has another form."""
    form = r"^([0-9]+)年([0-9]+)月([0-9]+)日"
    part = lambda i: F.regexp_extract(text, form, i).try_cast("int")
    return F.when(
        text.rlike(form),
        F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", part(1) + 1911, part(2), part(3)))),
    )


def in_wrapping_window(d: Column, start_md: Column, end_md: Column) -> Column:
    """MM-dd window that may wrap the year end."""
    md = F.date_format(d, "MM-dd")
    wraps = start_md > end_md
    return F.when(wraps, (md >= start_md) | (md <= end_md)).otherwise((md >= start_md) & (md <= end_md))
