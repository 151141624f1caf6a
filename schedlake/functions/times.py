"""Clock times as HH:MM text, weekday sets and weekday bit masks (bit 0 = Monday)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schedlake.functions.text import strip

# Time formats.
CLOCK = r"^([01]?[0-9]|2[0-3])[:：]([0-5][0-9])$"
CLOCK_STRICT = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
CLOCK_SHAPE = r"^[0-9]{2}:[0-9]{2}$"

# Weekday names, Monday first.
WEEKDAY_CHARS = ["一", "二", "三", "四", "五", "六", "日"]


def clock(c: Column) -> Column:
    """Zero-padded HH:MM from loose input (blanks, full-width colon, one-digit hour); NULL when it is no time."""
    t = strip(c)
    hour = F.regexp_extract(t, CLOCK, 1)
    return F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.regexp_extract(t, CLOCK, 2)))


def is_clock(c: Column) -> Column:
    """Strictly HH:MM; NULL counts as invalid."""
    return F.coalesce(c.rlike(CLOCK_STRICT), F.lit(False))


def minutes(c: Column) -> Column:
    """Minutes since midnight of h:m text; NULL unless it is exactly two integers."""
    parts = F.split(c, ":")
    return F.when(
        F.size(parts) == 2,
        F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int"),
    )


def weekday_bit(weekday: Column) -> Column:
    """Bit of an ISO weekday; NULL or out-of-range gives 0."""
    return F.when(weekday.between(1, 7), F.call_function("shiftleft", F.lit(1), weekday.cast("int") - 1)).otherwise(F.lit(0))


def mask_days(mask: Column) -> Column:
    """Sorted ISO weekdays of a mask."""
    return F.filter(F.sequence(F.lit(1), F.lit(7)), lambda d: F.call_function("shiftright", mask, (d - 1)) % 2 == 1)


def run_mask_days(mask: Column) -> Column:
    """ISO weekdays at which a 7-character, Sunday-first run mask holds '2'; other lengths give an empty array."""
    days = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substr(mask, i + 1, F.lit(1)) == "2")
    iso = F.sort_array(F.transform(days, lambda i: F.when(i == 0, 7).otherwise(i)))
    return F.when(F.length(mask) == 7, iso).otherwise(F.array().cast("array<int>"))


def char_days(chars: Column) -> Column:
    """Sorted ISO weekdays of comma-separated weekday characters; anything else is ignored."""
    digits = F.split(F.translate(chars, "".join(WEEKDAY_CHARS), "1234567"), ",")
    return F.sort_array(F.array_distinct(F.filter(digits, lambda d: F.length(d) == 1).cast("array<int>")))


def weekday_name(weekday: Column, prefix: str = "週") -> Column:
    return F.concat(F.lit(prefix), F.get(F.array(*[F.lit(c) for c in WEEKDAY_CHARS]), weekday - 1))


def weekday_list(days: Column) -> Column:
    """``週一、週三`` for an array of ISO weekdays."""
    return F.array_join(F.transform(days, lambda d: weekday_name(d)), "、")


def time_text(arrive: Column, depart: Column, passing: Column) -> Column:
    """Time phrase by shape: passing at a moment or in a window, arrival only, or a stop interval."""
    moment = F.format_string("約 %s 經過", arrive)
    window = F.format_string("約 %s〜%s 經過", arrive, depart)
    return (
        F.when(F.coalesce(passing, F.lit(False)), F.when(arrive.eqNullSafe(depart), moment).otherwise(F.when(depart.isNull(), moment).otherwise(window)))
        .when(depart.isNull(), F.format_string("約 %s 抵達", arrive))
        .otherwise(F.concat(arrive, F.lit("〜"), depart))
    )
